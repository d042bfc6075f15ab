"""The queries that SQL cannot express, each against a version in plain Python on the smallest tables."""

import hashlib
import json
import os
import re
from collections import OrderedDict

import duckdb
import pytest
from pyspark.sql import functions as F

from lorebank.functions import wordlists as L
from lorebank.operators import loop
from lorebank.plans import registry
from lorebank.plans.curation import acted, clarity, graph
from lorebank.plans.mcq_queries import caller, topk
from lorebank.plans.text_queries import blueprints
from lorebank.sources import domain as D
from lorebank.sources import html

from .test_graph import walk as merge_walk
from .test_model import walk

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
Q = registry.QUERIES


def rows(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet").collect()


def test_every_query_is_checked():
    here = {n.removeprefix("test_query_") for n in globals() if n.startswith("test_query_")}
    assert set(Q) - set(registry.ORACLES) == here


def test_query_web_queries(spark):
    want = set()
    for b in blueprints(spark, DIR).collect():
        every = [(b.bangla_query, "bn"), (b.english_query, "en")]
        if len(b.keywords) >= 2:
            every.append((" ".join(b.keywords[:5]) + " Bangladesh facts", "en"))
        every += [(f"{e} {b.topic} Bangladesh", "en") for e in b.entities[:2]]
        found, seen = [], set()
        for q, lang in every:
            q = q.strip(" ")
            if q.lower() not in seen:
                seen.add(q.lower())
                found += [(q, lang)] * (len(q) > 3)
        want |= {(b.fact_id, i, q, lang) for i, (q, lang) in enumerate(found[:6])}
    assert {(r.fact_id, r.pos, r.q, r.lang) for r in Q["web_queries"](spark, DIR).collect()} == want


def sentences(text):
    out = []
    for p in (x.strip() for x in re.split(r"(?<=[.।!?])\s+", text)):
        if p and not re.search(r"[|\t]", p) and 6 <= len(p.split()) <= 80 and re.search("[a-zA-Zঀ-৿]", p):
            out.append(p if re.search("[.।!?]$", p) else p + ".")
    return out


def test_query_scan_urls(spark):
    want, seen = set(), set()
    for r in sorted(rows(spark, "pages"), key=lambda r: r.page_id):
        host = re.sub(r"^www\.", "", (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r.url or "") or ["", ""])[1].lower())
        if any(d in host for d in L.BLOCKED_DOMAINS):
            continue
        for pos, s in enumerate(sentences(html.read(r.html))[:15]):
            h = hashlib.md5(s.encode()).hexdigest()[:12]
            if h not in seen:
                seen.add(h)
                want.add((r.page_id, pos, s, h))
    assert {(r.page_id, r.pos, r.sentence, r.hash) for r in Q["scan_urls"](spark, DIR).collect()} == want


def test_query_json_repair(spark):
    want = {r.event_id: json.loads(r.props) for r in rows(spark, "events")}
    assert {r.event_id: json.loads(r.json) for r in Q["json_repair"](spark, DIR).collect()} == want


def test_query_api_rate_limit(spark):
    limit, kept, want = {"purchase": 5, "click": 10}, {}, {}
    for r in sorted(rows(spark, "events"), key=lambda r: (r.ts, r.event_id)):
        zone = r.event_type if r.event_type in limit else "default"
        now, log = r.ts.timestamp(), kept.setdefault((r.user_id, zone), [])
        log[:] = [t for t in log if now - t < 5 * 86400]
        most = limit.get(zone, 30)
        want[r.event_id] = (len(log) < most, 0 if len(log) < most else max(1, int(log[0] + 5 * 86400 - now) + 1))
        if len(log) < most:
            log.append(now)
    got = {r.call_id: (r.allowed, r.retry_after) for r in Q["api_rate_limit"](spark, DIR).collect()}
    assert {i: a for i, (a, _) in got.items()} == {i: a for i, (a, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) <= 1 for i in got)  # whole seconds of sums of floats


def test_query_ttl_cache(spark):
    caches, want = {}, {}
    for r in sorted(rows(spark, "events"), key=lambda r: (r.ts, r.event_id)):
        now, held = r.ts.timestamp(), caches.setdefault(r.event_type, OrderedDict())
        hit = r.user_id in held and now < held[r.user_id]
        want[r.event_id] = hit
        if not hit:
            held.pop(r.user_id, None)
            if len(held) >= 64:
                for k in [k for k, t in held.items() if now >= t]:
                    del held[k]
                while len(held) >= 64:
                    held.popitem(last=False)
            held[r.user_id] = now + 86400
    assert {r.seq: r.hit for r in Q["ttl_cache"](spark, DIR).collect()} == want


def merged(spark):
    """Pairs of near documents, and the walk over them."""
    sets = sorted((r.doc_id, frozenset(re.findall(r"[^\W]+", (r.text or "").lower()))) for r in rows(spark, "documents"))
    score = {r.id: r.score for r in clarity(spark, DIR).collect()}
    pairs = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[n + 1 :] if a and b and len(a & b) >= 0.85 * len(a | b)]
    gone, out = set(), set()
    for i, j in pairs:
        if i not in gone and j not in gone:
            x = i if score[j] > score[i] else j
            gone.add(x)
            out.add((i + j - x, x))
    return pairs, out


def test_query_dedup_near(spark):
    assert {(r.kept, r.removed) for r in Q["dedup_near"](spark, DIR).collect()} == merged(spark)[1]


def test_query_m_rrr(spark):
    pairs, out = merged(spark)
    assert Q["m_rrr"](spark, DIR).first().value == round(len(out) / len(pairs), 4)


def merged_facts(spark):
    """Near duplicate facts: the pairs, and the merges of the walk with their similarities."""
    facts = sorted((r.fact_id, frozenset(re.findall(r"[^\W]+", r.text.lower())), r.composite) for r in D.scored_facts(spark, DIR).select("fact_id", "text", "composite").collect())
    by_size, pairs = {}, []
    for i, a, _ in facts:
        by_size.setdefault(len(a), []).append((i, a))
    for n, small in by_size.items():
        for m, large in by_size.items():
            if n <= m and n >= 0.85 * m:
                for i, a in small:
                    for j, b in large:
                        k = len(a & b)
                        if (n < m or i < j) and k >= 0.85 * (n + m - k):
                            pairs.append((min(i, j), max(i, j), round(k / (n + m - k), 4)))
    score, gone, out = {i: c for i, _, c in facts}, set(), []
    for i, j, x in sorted(pairs):
        if i not in gone and j not in gone:
            lost = i if score[j] > score[i] else j
            gone.add(lost)
            out.append((j if lost == i else i, lost, x))
    return pairs, out


def test_query_deduplication_details(spark):
    assert sorted(map(tuple, Q["deduplication_details"](spark, DIR).collect())) == sorted(merged_facts(spark)[1])


def test_query_deduplication_report(spark):
    pairs, out = merged_facts(spark)
    r = Q["deduplication_report"](spark, DIR).first()
    assert pairs and (r.duplicates_found, r.pairs_merged, r.facts_remaining) == (len(pairs), len(out), D.facts(spark, DIR).count() - len(out))


def test_query_deduplicate_graph(spark):
    nodes, edges = graph(spark, DIR)
    edges = [(r.src, r.dst, r.relation) for r in sorted(edges.collect(), key=lambda r: (r.seq, r.relation))]
    merges = [(f"FACT_{a}", f"FACT_{b}") for a, b, _ in merged_facts(spark)[1]]
    want = merge_walk([r.node_id for r in nodes.collect()], edges, merges)[0]
    assert sorted(map(tuple, Q["deduplicate_graph"](spark, DIR).collect())) == want


def test_query_full_report(spark):
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{t}'")
    got = {r.metric: r.value for r in Q["full_report"](spark, DIR).collect()}
    assert set(got) == {n for n in Q if n.startswith("m_")} and len(got) == 27
    for name in set(got) - {"m_rrr"}:
        want = con.execute(registry.ORACLES[name]).fetchone()[0]
        assert got[name] == (None if want is None else pytest.approx(float(want), abs=1e-9)), name
    pairs, out = merged(spark)
    assert got["m_rrr"] == round(len(out) / len(pairs), 4)


def in_order(spark):
    """(id, text) of the facts in the order of their chunks, by which the first of equal questions is chosen."""
    facts = loop.chunked(topk(spark, DIR)).collect()
    return [(r.fact_id, r.text) for r in sorted(facts, key=lambda r: (r.chunk, str(r.fact_id)))]


def test_query_crj_round(spark):
    got = Q["crj_round"](spark, DIR).where("passed").collect()
    assert sorted((r.fact_id, 0, r.question, r.quality) for r in got) == walk(in_order(spark), set(), 1)


def test_query_crj_loop(spark):
    got = sorted((r.fact_id, r.round, r.quality) for r in Q["crj_loop"](spark, DIR).collect())
    assert got == sorted((i, k, q) for i, k, _, q in walk(in_order(spark), set())) and {k for _, k, _ in got} == {0, 1, 2}


def test_chunks_are_dealt_over_tasks_whatever_their_bytes(spark):
    facts = spark.range(400).select(F.floor(F.col("id") / 10).alias("chunk"), F.col("id").cast("string").alias("fact_id"), F.lit("a fact of few words").alias("text"))
    made = loop.challenge(facts, loop.Round(), caller()).withColumn("task", F.spark_partition_id())
    assert made.count() == 800 and made.select("task").distinct().count() > 4


def test_only_changed_facts_without_a_verdict_are_scored_again(spark):
    f = acted(spark, DIR)
    asked = ~F.col("verdict").isin("ACCEPT", "REJECT") & (F.col("refined") != F.col("text"))
    assert f.where(F.col("again").isNotNull() != asked).count() == 0 and f.where(asked).count() > 0


def test_query_all_difficulties(spark):
    best = sorted(topk(spark, DIR).collect(), key=lambda r: (-r.composite, r.fact_id))[:5]
    got = Q["all_difficulties"](spark, DIR).collect()
    assert {r.fact_id for r in got} <= {r.fact_id for r in best} and {r.difficulty for r in got} <= {"easy", "medium", "hard"}
    easy = sorted((r.fact_id, r.round, r.quality) for r in got if r.difficulty == "easy")
    assert easy == sorted((i, k, q) for i, k, _, q in walk([(r.fact_id, r.text) for r in best], set()))


def test_query_model_scores(spark):
    want = {f"{r.conv_id}-{r.turn}": (0.9, 0.8, 0.7, []) if r.turn % 2 == 0 else (0.0, 0.0, 0.0, ["FORMAT_ERROR"]) for r in rows(spark, "conversations")}
    assert {r.mcq_id: (r.grounding, r.clarity, r.distractor, r.codes) for r in Q["model_scores"](spark, DIR).collect()} == want

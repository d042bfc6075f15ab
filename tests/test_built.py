"""Top-1 matches, substring joins, filters of seen questions, counters, streams and the report against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorebank.operators import counters, memory
from lorebank.operators import similarity as S
from lorebank.plans import registry
from lorebank.plans.memory_queries import own_composites, rated
from lorebank.sources import bank, store
from lorebank.streaming import limits, runs

DIR = "/root/testdata/sf0.001"
Q = registry.QUERIES


def words(rng, n, of=60):
    return " ".join(f"w{min(int(rng.expovariate(0.1)), of)}" for _ in range(n))


@pytest.mark.parametrize("held", [1_000_000, 60])
def test_best_match(spark, held, monkeypatch):
    monkeypatch.setattr(S, "HELD", held)
    rng = random.Random(4)
    corpus = [words(rng, rng.randint(1, 30)) for _ in range(120)] + ["", None, "alone", "alone"]
    asked = [words(rng, rng.randint(1, 40)) for _ in range(200)] + corpus[:20] + ["", None, "alone", "nowhere", "!?"]
    sets = [set(x.split()) for x in corpus if x]
    got = S.best_match(spark.createDataFrame(list(enumerate(asked)), "id long, text string"), spark.createDataFrame([(x,) for x in corpus], "text string"))
    rows = got.collect()
    for r in rows:
        mine = set(re.findall(r"\w+", asked[r.id] or ""))
        assert r.best == max((len(mine & x) / len(mine | x) for x in sets if mine), default=0.0), asked[r.id]
        assert r.checked <= len(sets)
    assert len(rows) == len(asked) and sum(r.checked for r in rows) < 0.7 * len(asked) * len(sets)
    assert "Join" not in got._jdf.queryExecution().toString()


def test_best_match_without_a_corpus(spark):
    asked = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert {r.id: r.best for r in S.best_match(asked, asked.select("text").limit(0)).collect()} == {1: 0.0, 2: 0.0}
    assert S.best_match(asked.limit(0), asked.select("text")).collect() == []


def test_substring_join(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("ab1২") for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(300, None)]
    needles = {"".join(rng.choice("ab1২") for _ in range(rng.randint(0, 6))) for _ in range(1_000)} | {"zzz", "abz"}
    rows = spark.createDataFrame(texts, "id long, text string")
    found = memory.containing(rows, spark.createDataFrame([(x,) for x in [*needles, "a", None]], "needle string"))
    assert sorted(map(tuple, found.collect())) == sorted((i, x) for i, t in texts if t for x in needles | {"a"} if x and x in t)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert memory.containing(rows, rows.select(F.lit("").alias("needle"))).collect() == []


def test_seen_questions_that_a_filter_passes(spark):
    seen = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    fresh = spark.range(39_000, 60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).unionByName(spark.createDataFrame([(-1, None)], "id long, h string"))
    whole = store.build_filter(seen)
    asked = store.possibly_seen(fresh, whole)
    assert asked.where("id < 40000 and id >= 0 and not possible").count() == 0 and asked.where("id >= 40000 and possible").count() <= 0.02 * 20_000
    assert sorted(r.id for r in store.unseen(fresh, seen, whole).collect()) == [-1, *range(40_000, 60_000)]
    blocks = whole.first().blocks
    parts = [store.build_filter(seen.where(F.crc32(F.col("h").cast("binary")) % 3 == k), blocks) for k in range(3)]
    both = lambda f: sorted((r.block, bytes(r.bits)) for r in f.collect())
    assert both(store.merge_filters(*parts)) == both(whole)
    none = store.build_filter(seen.limit(0))
    assert store.unseen(fresh, seen.limit(0), none).count() == 21_001


def test_states_of_parts_add_up(spark):
    rows = spark.createDataFrame([(i, (i * 37 % 400) / 1.0 if i % 9 else None, i % 4 or None) for i in range(500)], "id long, v double, k int")
    state = lambda x: [counters.counter(x, "n"), counters.counter(x, "sum", F.col("k")), counters.labelled(x, "by", "k", F.col("k")), counters.histogram(x, "h", F.col("v"))]
    parts = [s for k in range(3) for s in state(rows.where(F.col("id") % 3 == k))]
    whole = sorted(map(tuple, counters.merged(*state(rows)).collect()))
    assert sorted(map(tuple, counters.merged(*parts).collect())) == whole
    got = {(n, x): v for n, x, v in whole}
    values = [(i * 37 % 400) for i in range(500) if i % 9]
    assert got["h_bucket", 'le="60"'] == sum(v <= 60 for v in values) and got["h_bucket", 'le="+Inf"'] == got["h_count", ""] == len(values) and got["by", 'k="2"'] == 125
    assert "h_sum " + str(float(sum(values))) in {r.line for r in counters.page(counters.merged(*parts)).collect()}


def test_a_replayed_batch_of_ratings_changes_nothing(spark, tmp_path):
    rows = rated(spark, DIR)
    kept, batches = f"{tmp_path}/kept", [rows.where(F.col("id") % 4 == k) for k in range(4)]
    keep = None

    class Ratings:
        """Takes the place of a stream: hands out what it is given to do with each batch."""

        class writeStream:
            @staticmethod
            def foreachBatch(f):
                nonlocal keep
                keep = f
                return Ratings

        option = trigger = staticmethod(lambda *a, **b: Ratings)
        start = staticmethod(lambda: None)

    runs.penalty_stream(Ratings, kept, "")
    for k in (0, 1, 1, 2, 3, 2):
        keep(batches[k], k)
    want = sorted(map(tuple, memory.penalties(rows, own_composites(spark, DIR)).collect()))
    assert sorted(map(tuple, runs.penalised(spark, kept, own_composites(spark, DIR)).collect())) == want and len({c for _, c, _ in want}) > 20
    assert {r.composite for r in memory.penalties(rows).collect()} <= {0.0, 0.1, 0.2, 0.3, 0.4}  # from .5, without composites


def test_null_keys_are_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        calls = spark.createDataFrame([(i, None if i % 2 else "u", "generate", float(i) / 10) for i in range(80)], "call_id long, key string, zone string, at double")
        got = limits.rate_limit(calls, 60.0).where("allowed").collect()
        assert len([r for r in got if r.call_id % 2]) == len([r for r in got if r.call_id % 2 == 0]) == 5
        log = spark.createDataFrame([(None, i, float(i), "k") for i in range(40)], "cache string, seq long, at double, key string")
        assert limits.replay_cache(log, 4, 1000.0).where("not hit").count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_of_a_run_appended_later(spark, tmp_path):
    at = f"{tmp_path}/runs"
    line = lambda run, second, stage: bank.run_lines(spark.createDataFrame([(run, f"2026-01-01 00:00:{second:02}")], "pipeline_run_id string, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp")), stage)
    for run, second, stage in (("r1", 0, "start"), ("r2", 3, "start"), ("r1", 4, "web"), ("r1", 9, "complete"), ("r2", 5, "complete")):
        bank.append_run_log(line(run, second, stage), at)
    got = {(r.pipeline_run_id, r.stage): r.execution_time_ms for r in bank.scan_run_log(spark, at).collect()}
    assert got == {("r1", "start"): 0, ("r2", "start"): 0, ("r1", "web"): 4000, ("r1", "complete"): 9000, ("r2", "complete"): 2000}


def test_a_month_saved_twice(spark, tmp_path):
    at = f"{tmp_path}/snap"
    nodes = spark.createDataFrame([("FACT_1", "FACT", "text", 0.5, ["a"]), ("TOPIC_X", "TOPIC", None, None, None)], "node_id string, type string, text string, composite double, tags array<string>")
    edges = spark.createDataFrame([("FACT_1", "TOPIC_X", "ABOUT", 1)], "src string, dst string, relation string, seq long")
    bank.save_snapshot(nodes, edges, at, "2026-01")
    bank.save_snapshot(nodes.drop("tags"), edges, at, "2026-02")
    bank.save_snapshot(nodes, edges, at, "2026-01")
    n, e, topics = bank.load_snapshot(spark, at, "2026-01")
    got = {r.node_id: (r.type, r.a, r.b, r.c) for r in n.select("node_id", "type", bank.attribute("text", "string").alias("a"), bank.attribute("composite", "double").alias("b"), bank.attribute("tags", "array<string>").alias("c")).collect()}
    assert got == {"FACT_1": ("FACT", "text", 0.5, ["a"]), "TOPIC_X": ("TOPIC", None, None, None)} and sorted(map(tuple, e.collect())) == [("FACT_1", "TOPIC_X", "ABOUT", 1)]
    assert [tuple(r) for r in topics.collect()] == [("TOPIC_X", 1, 0, 0, 0)]
    bank.save_snapshot(nodes, edges, at, "2026-01", topics.withColumn("unmapped_facts", F.lit(7).cast("long")))
    assert bank.load_snapshot(spark, at, "2026-01")[2].first().unmapped_facts == 7
    assert bank.load_snapshot(spark, at, "2026-02")[0].select(bank.attribute("tags", "array<string>").alias("t")).distinct().collect()[0].t is None


def test_the_report_reads_each_table_once(spark):
    plan = Q["full_report"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    scans = re.findall(r"Relation \[([^\]#]+)#", plan)
    assert len(scans) <= 24 and scans.count("o_orderkey") <= 1 and scans.count("l_orderkey") == 0 and scans.count("event_id") == 0 and scans.count("conv_id") == 1

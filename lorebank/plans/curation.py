"""Queries over the fact graph: selection, topics, graph operators and deduplication."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import metrics
from ..operators import similarity as S
from ..sources import bank, store
from ..sources import domain as D
from ..sources.scratch import place, written
from .registry import query
from .text_queries import REFINED, RUNS, SCORED

FS = D.scored_facts


def q(name: str, body: str):
    return query(name, D.sql(SCORED + body, "parts"))


@q("facts_quality_topk", "SELECT topic, count(*) AS n, round(avg(composite) * 1e6) / 1e6 AS avg_composite, round(max(composite) * 1e6) / 1e6 AS best FROM scored WHERE verdict <> 'REJECT' GROUP BY topic")
def facts_quality_topk(s, d):
    return FS(s, d).where("verdict <> 'REJECT'").groupBy("topic").agg(F.count("*").alias("n"), T.rnd(F.avg("composite"), 6).alias("avg_composite"), T.rnd(F.max("composite"), 6).alias("best")).orderBy("topic")


@q("fact_fallback_all", "SELECT fact_id, upper(coalesce(topic, 'general')[1:1]) || lower(coalesce(topic, 'general')[2:]) AS topic FROM scored")
def fact_fallback_all(s, d):
    return D.facts(s, d).select("fact_id", F.initcap(F.coalesce("topic", F.lit("general"))).alias("topic"))


@q("unmapped_facts", "SELECT fact_id FROM scored WHERE source_url = ''")
def unmapped_facts(s, d):
    return D.facts(s, d).where("source_url = ''").select("fact_id")


@q("fact_lookup", "SELECT fact_id, text, verdict FROM scored WHERE fact_id = '1-1'")
def fact_lookup(s, d):
    return FS(s, d).where("fact_id = '1-1'").select("fact_id", "text", "verdict")


@q("web_quality_gate", "SELECT fact_id, round(composite * 1e6) / 1e6 AS composite FROM scored WHERE composite >= 0.5")
def web_quality_gate(s, d):
    return FS(s, d).where("composite >= 0.5").select("fact_id", T.rnd(F.col("composite"), 6).alias("composite"))


@q("topk_facts", "SELECT fact_id, round(composite * 1e6) / 1e6 AS composite FROM scored ORDER BY round(composite * 1e6) DESC, fact_id LIMIT 5")
def topk_facts(s, d):
    return FS(s, d).select("fact_id", T.rnd(F.col("composite"), 6).alias("composite")).orderBy(F.desc("composite"), "fact_id").limit(5)


@q("topic_fact_counts", "SELECT coalesce(topic, 'General') AS topic, count(*) AS n FROM scored GROUP BY 1")
def topic_fact_counts(s, d):
    return D.facts(s, d).groupBy(F.coalesce("topic", F.lit("General")).alias("topic")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@q("topic_stats", "SELECT topic, count(*) AS fact_count, count(*) FILTER (text LIKE '%?') AS question_count, count(*) FILTER (source_url = '') AS unmapped, count(DISTINCT publisher) AS sources FROM scored GROUP BY topic")
def topic_stats(s, d):
    return D.facts(s, d).groupBy("topic").agg(F.count("*").alias("fact_count"), F.count_if(F.col("text").endswith("?")).alias("question_count"), F.count_if(F.col("source_url") == "").alias("unmapped"), F.size(F.collect_set("publisher")).cast("bigint").alias("sources"))


@q("topic_density", ", n AS (SELECT topic, count(*) AS f, count(*) FILTER (text LIKE '%?') AS qn, count(*) FILTER (source_url = '') AS u FROM scored GROUP BY topic) SELECT topic, 'EXPAND_DEPTH' AS action, 'facts' AS reason, f AS n FROM n WHERE f > 50 UNION ALL SELECT topic, 'EXPAND_DEPTH', 'questions', qn FROM n WHERE qn > 30 UNION ALL SELECT topic, 'EXPAND_WIDTH', 'unmapped', u FROM n WHERE u > 10")
def topic_density(s, d):
    n = topic_stats(s, d)
    row = lambda c, least, action, reason: F.when(F.col(c) > least, F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"), F.col(c).alias("n")))
    rows = F.array_compact(F.array(row("fact_count", 50, "EXPAND_DEPTH", "facts"), row("question_count", 30, "EXPAND_DEPTH", "questions"), row("unmapped", 10, "EXPAND_WIDTH", "unmapped")))
    return n.select("topic", F.explode(rows).alias("x")).select("topic", "x.*")


GRAPH = SCORED + RUNS + """,
ent AS (SELECT DISTINCT fact_id, 'ENTITY_' || regexp_replace(trim(e), '\\s', '_', 'g') AS ename, regexp_replace(trim(e), '\\s', '_', 'g') AS x FROM kept WHERE n <= 8),
nodes AS (SELECT 'FACT_' || fact_id AS node_id, 'FACT' AS type FROM facts UNION SELECT 'TOPIC_' || upper(topic), 'TOPIC' FROM facts UNION SELECT 'SOURCE_' || sha256(source_url)[1:12], 'SOURCE' FROM facts UNION SELECT ename, 'ENTITY' FROM ent),
edges AS (SELECT 'FACT_' || fact_id AS src, 'TOPIC_' || upper(topic) AS dst, 'ABOUT' AS relation, fact_id AS seq FROM facts UNION ALL SELECT 'FACT_' || fact_id, 'SOURCE_' || sha256(source_url)[1:12], 'SUPPORTED_BY', fact_id FROM facts UNION ALL SELECT ename, 'FACT_' || fact_id, 'SUBJECT_OF', fact_id FROM ent)
"""


def g(name: str, body: str):
    return query(name, D.sql(GRAPH + body, "parts"))


def graph(s, d):
    return G.build(written(D.facts(s, d), "facts"))  # read by each kind of node and edge


@g("graph_build", "SELECT src, dst, relation FROM edges")
def graph_build(s, d):
    return graph(s, d)[1].select("src", "dst", "relation")


@g("graph_nodes", "SELECT node_id, type FROM nodes")
def graph_nodes(s, d):
    return graph(s, d)[0].select("node_id", "type")


@g("node_type_counts", "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_type_counts(s, d):
    return graph(s, d)[0].groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("type")).agg(F.count("*").alias("n"))


@g("health_counts", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE type = 'FACT') AS facts, (SELECT count(DISTINCT topic) FROM facts) AS memory_size")
def health_counts(s, d):
    return graph(s, d)[0].agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "FACT").alias("facts"), F.count_if(F.col("type") == "TOPIC").alias("memory_size"))


@g("one_hop", "SELECT 'FACT_' || fact_id AS node_id FROM facts WHERE lower(topic) = 'de'")
def one_hop(s, d):
    return G.one_hop(*graph(s, d), "De").select("node_id")


@query("scan_json_bank", "SELECT conv_id || '-' || turn AS id, text, coalesce(nullif(role, ''), 'General') AS topic FROM conversations WHERE text <> ''")
def scan_json_bank(s, d):
    """The bank's entries, here of one file for each turn."""
    c = D.table(s, d, "conversations")
    entry = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.col("role").alias("topic"))
    return bank.entries(c.select(F.to_json(F.struct(F.array(entry).alias("questions"))).alias("value"))).select("id", "text", "topic")


@g("add_questions", """, qs AS (SELECT conv_id * 1000 + turn AS question_id, role, conv_id, turn FROM conversations),
asks AS (SELECT DISTINCT question_id, fact_id FROM (SELECT question_id, unnest([conv_id || '-1', conv_id || '-' || (turn + 1)]) AS fact_id FROM qs) WHERE fact_id IN (SELECT fact_id FROM facts))
SELECT 'QUESTION_' || question_id AS src, 'TOPIC_' || upper(role) AS dst, 'ABOUT' AS relation FROM qs
UNION ALL SELECT 'QUESTION_' || question_id, 'FACT_' || fact_id, 'ASKS_FOR' FROM asks
UNION ALL SELECT 'QUESTION_' || question_id, 'QUESTION_' || (question_id - 1), CASE WHEN role = 'user' THEN 'REFINES' ELSE 'DERIVED_FROM' END FROM qs WHERE turn > 0
UNION ALL SELECT 'QUESTION_' || question_id, NULL, 'unmapped' FROM qs WHERE question_id NOT IN (SELECT question_id FROM asks)""")
def add_questions(s, d):
    """Edges of questions, and those of which no fact exists; here turns, which ask for facts of the document with their number."""
    c = D.table(s, d, "conversations")
    ask = F.array(D.fact_id(F.col("conv_id"), F.lit(1)), D.fact_id(F.col("conv_id"), F.col("turn") + 1))
    number = F.col("conv_id") * 1000 + F.col("turn")
    questions = c.select(
        number.alias("question_id"), F.col("role").alias("topic"), ask.alias("fact_ids"), F.when(F.col("turn") > 0, number - 1).alias("parent_id"), (F.col("role") == "user").alias("refines")
    )
    nodes, edges = G.add_questions(graph(s, d)[0], questions)
    lost = nodes.where("unmapped").select(F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit("unmapped").alias("relation"))
    return edges.select("src", "dst", "relation").unionByName(lost)


@g("remove_fact", """, gone AS (SELECT 'FACT_' || fact_id AS node_id FROM scored WHERE verdict = 'REJECT')
SELECT src, dst, relation FROM edges WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)""")
def remove_fact(s, d):
    gone = FS(s, d).where("verdict = 'REJECT'").select(F.concat(F.lit("FACT_"), "fact_id").alias("node_id"))
    return G.remove(*graph(s, d), gone)[1].select("src", "dst", "relation")


@g("merge_nodes", """,
p AS (SELECT fact_id, 'FACT_' || fact_id AS removed, 'FACT_' || min(fact_id) OVER (PARTITION BY text) AS kept FROM facts),
m AS (SELECT * FROM p WHERE removed <> kept),
still AS (SELECT src, dst, relation FROM edges WHERE src NOT IN (SELECT removed FROM m) AND dst NOT IN (SELECT removed FROM m)),
moved AS (SELECT coalesce(a.kept, src) AS src, coalesce(b.kept, dst) AS dst, relation, coalesce(a.fact_id, b.fact_id) AS w
          FROM edges LEFT JOIN m a ON a.removed = src LEFT JOIN m b ON b.removed = dst WHERE a.kept IS NOT NULL OR b.kept IS NOT NULL),
new AS (SELECT src, dst, relation FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY w, relation) AS n FROM moved ANTI JOIN still USING (src, dst)) WHERE n = 1)
FROM still UNION ALL FROM new""")
def merge_nodes(s, d):
    """Edges of the graph when each fact is merged into the first one with its text, in order of the ids."""
    f = D.facts(s, d)
    first = f.groupBy("text").agg(F.min("fact_id").alias("first"))
    node = lambda c: F.concat(F.lit("FACT_"), F.col(c))
    pairs = f.join(first, "text").where("fact_id <> first").select(node("first").alias("kept"), node("fact_id").alias("removed"), F.col("fact_id").alias("at"))
    return G.merge(*graph(s, d), pairs)[1].select("src", "dst", "relation")


def facts_once(s, d):
    """Facts with their composite, written once for what reads them several times."""
    return written(FS(s, d).select("fact_id", "text", "topic", "source_url", "composite"), "facts")


def near_facts(facts):
    """(kept, removed, similarity, found): the merges of near duplicate facts, the better one kept, and how many pairs there are."""
    f = facts.where("fact_id is not null").select(F.col("fact_id").alias("id"), "text", F.col("composite").alias("score"))
    members, near = S.near_classes(f)
    merges = S.merge_classes(members, near, f.select("id", "score"))
    return written(S.with_similarity(merges, members, near), "merges"), S.count_pairs(members, near)


@query("deduplicate_graph")
def deduplicate_graph(s, d):
    """The edges of the graph after all near duplicate facts were merged, pair by pair in order of the pairs' ids."""
    f = facts_once(s, d)
    merges, _ = near_facts(f)
    nodes, edges = G.build(f)
    edges = written(edges, "edges")  # read by several joins
    node = lambda c: F.concat(F.lit("FACT_"), F.col(c))
    # pairs in order of their first and then their second id; a character before all of those of ids parts the two
    at = F.concat_ws(" ", F.least("kept", "removed"), F.greatest("kept", "removed"))
    return G.merge(nodes, edges, merges.select(node("kept").alias("kept"), node("removed").alias("removed"), at.alias("at")))[1].select("src", "dst", "relation")


@query("deduplication_details")
def deduplication_details(s, d):
    """Each merge with the similarity of its pair."""
    return near_facts(facts_once(s, d))[0]


@query("deduplication_report")
def deduplication_report(s, d):
    """How many pairs of near duplicate facts were found and merged, and how many facts remain."""
    f = facts_once(s, d)
    merges, found = near_facts(f)
    merged = merges.agg(F.count("*").alias("pairs_merged"))
    facts = f.where("fact_id is not null").agg(F.count("*").alias("n"))
    every = found.select(F.col("f").cast("long").alias("duplicates_found")).crossJoin(merged).crossJoin(facts)  # one row each
    return every.select("duplicates_found", "pairs_merged", (F.col("n") - F.col("pairs_merged")).alias("facts_remaining"))


@g("well_linked", "SELECT 'FACT_' || fact_id AS node_id, fact_id IN (SELECT fact_id FROM ent) AS ok FROM facts")
def well_linked(s, d):
    return G.well_linked(*graph(s, d))


@g("m_gcs", "SELECT round(avg(CAST(fact_id IN (SELECT fact_id FROM ent) AS INT)) * 1e4) / 1e4 AS value FROM facts")
def m_gcs(s, d):
    return well_linked(s, d).agg(F.coalesce(T.rnd(F.avg(F.col("ok").cast("int")), 4), F.lit(0.0)).alias("value"))


@g("fact_source_lookup", "SELECT fact_id, source_url, publisher FROM facts")
def fact_source_lookup(s, d):
    f = D.facts(s, d)
    first = graph(s, d)[1].where("relation = 'SUPPORTED_BY'").groupBy("src").agg(F.min_by("dst", "seq").alias("dst"))
    src = f.select("fact_id", F.concat(F.lit("FACT_"), "fact_id").alias("src"), "source_url", "publisher")
    return src.join(first, "src").select("fact_id", "source_url", "publisher")


#: What becomes of each fact: the refined text is scored once more, by the same expressions over other tables.
AGAIN = ", factsb AS (SELECT fact_id, value AS text, topic, publisher, source_url FROM refined JOIN facts USING (fact_id))" + re.sub(r"\b(facts|tok2?|s[12]|scored)\b", r"\1b", SCORED)
ACT = REFINED + AGAIN + """, act AS (SELECT s.fact_id, s.verdict, s.tags, CASE WHEN s.verdict IN ('ACCEPT', 'REJECT') THEN s.verdict WHEN r.value = r.text THEN 'SALVAGEABLE_ACCEPT' WHEN b.composite >= 0.40 THEN 'REFINED_ACCEPT' ELSE 'REJECT_AFTER_REFINE' END AS action
FROM scored s JOIN refined r USING (fact_id) JOIN scoredb b USING (fact_id))
"""
TAG_NAMES = ("who_question", "when_question", "where_question", "numeric_ranking", "poor_candidate")


def acted(s, d):
    """Scored facts with what becomes of each: the refined text is scored once more."""
    f = FS(s, d).withColumn("refined", T.refine_text(F.col("text")))
    again = T.fact_composite(T.linguistic_clarity(F.col("refined")), T.factual_structure(F.col("refined")), F.col("reliability"), F.col("freshness"))
    settled = F.col("verdict").isin("ACCEPT", "REJECT")
    asked = F.when(~settled & (F.col("refined") != F.col("text")), again)  # the others' score is not asked for
    f = f.select("*", F.inline(F.array(F.struct(asked.alias("again")))))  # computed once, as in scored_facts
    changed = F.when(F.col("again") >= 0.40, "REFINED_ACCEPT").otherwise("REJECT_AFTER_REFINE")
    action = F.when(settled, F.col("verdict")).when(F.col("refined") != F.col("text"), changed).otherwise("SALVAGEABLE_ACCEPT")
    return f.withColumn("action", action)


ACCEPTED = ("ACCEPT", "REFINED_ACCEPT", "SALVAGEABLE_ACCEPT")


def stay(acted):
    """fact_id, text, topic, composite of the facts that stay, as they are after refinement."""
    new = F.col("action") == "REFINED_ACCEPT"
    now = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b))
    return acted.where(F.col("action").isin(*ACCEPTED)).select("fact_id", "topic", now("refined", "text").alias("text"), now("again", "composite").alias("composite"))


def usable(s, d):
    """The same with their readiness."""
    f = stay(acted(s, d))
    # a generator, as in scored_facts: a filter on the readiness does not compute it once more
    return f.select("*", F.inline(F.array(F.struct(T.mcq_readiness(F.col("composite"), T.mcq_tags(F.col("text"))).alias("readiness")))))


@q("facts_by_topic_ready", ACT + """, now AS (SELECT a.fact_id, s.topic, CASE WHEN action = 'REFINED_ACCEPT' THEN b.text ELSE s.text END AS text, CASE WHEN action = 'REFINED_ACCEPT' THEN b.readiness ELSE s.readiness END AS readiness
FROM act a JOIN scored s USING (fact_id) JOIN scoredb b USING (fact_id) WHERE action IN ('ACCEPT', 'REFINED_ACCEPT', 'SALVAGEABLE_ACCEPT'))
SELECT fact_id, text, readiness FROM now WHERE topic = 'en' AND readiness >= 0.5""")
def facts_by_topic_ready(s, d):
    return usable(s, d).where("topic = 'en' and readiness >= 0.5").select("fact_id", "text", "readiness")


@q("fact_action", ACT + "SELECT fact_id, verdict, action FROM act")
def fact_action(s, d):
    return acted(s, d).select("fact_id", "verdict", "action")


#: The facts that stay, and which of them a walk over their near pairs removes: the pairs share a token among their rarest, and
#: the walk takes the first ids in order, each with all of its later partners.
LEFT = """, done AS MATERIALIZED (FROM act),
now AS MATERIALIZED (SELECT a.fact_id AS id, CASE WHEN action = 'REFINED_ACCEPT' THEN b.text ELSE s.text END AS text, CASE WHEN action = 'REFINED_ACCEPT' THEN b.composite ELSE s.composite END AS score,
  CASE WHEN action = 'REFINED_ACCEPT' THEN b.tags ELSE s.tags END AS tags FROM done a JOIN scored s USING (fact_id) JOIN scoredb b USING (fact_id) WHERE action IN ('ACCEPT', 'REFINED_ACCEPT', 'SALVAGEABLE_ACCEPT')),
sets AS MATERIALIZED (SELECT id, score, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM now),
held AS (SELECT id, len(w) AS n, unnest(w) AS t FROM sets),
rare AS (SELECT id, t FROM (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS pos FROM held JOIN (SELECT t, count(*) AS df FROM held GROUP BY t) USING (t)) WHERE pos <= n - ceil(0.85 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.id AS i, b.id AS j FROM rare a JOIN rare b ON a.t = b.t AND a.id < b.id),
near AS (SELECT i, j, b.score > a.score AS higher FROM cand JOIN sets a ON a.id = i JOIN sets b ON b.id = j WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE >= 0.85),
firsts AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY i) AS k, list(struct_pack(j := j, higher := higher) ORDER BY j) AS later FROM near GROUP BY i),
walk(k, gone) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL
  SELECT k, CASE WHEN i IS NULL THEN gone WHEN stop > 0 THEN list_concat(gone, list_transform(rest[1:stop - 1], lambda e: e.j), [i]) ELSE list_concat(gone, list_transform(rest, lambda e: e.j)) END
  FROM (SELECT *, coalesce(list_position(list_transform(rest, lambda e: e.higher), true), 0) AS stop
        FROM (SELECT f.k, gone, CASE WHEN NOT list_contains(gone, f.i) THEN f.i END AS i, list_filter(f.later, lambda e: NOT list_contains(gone, e.j)) AS rest FROM walk JOIN firsts f ON f.k = walk.k + 1))),
merged AS MATERIALIZED (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)),
remain AS (SELECT tags FROM now WHERE id IS NULL OR id NOT IN (SELECT id FROM merged))
"""
ACTIONS = ("ACCEPT", "REJECT", "REFINE")


@query("quality_pipeline_summary", D.sql(SCORED + ACT + LEFT + "SELECT (SELECT count(*) FROM done) AS total, " + ", ".join(f"(SELECT count(*) FROM done WHERE contains(action, '{x}')) AS {x.lower()}" for x in ACTIONS) + ", (SELECT count(*) FROM merged) AS duplicates_merged, count(*) AS facts_remaining" + "".join(f", count(*) FILTER (list_contains(tags, '{x}')) AS {x}" for x in TAG_NAMES) + " FROM remain", "parts").replace("WITH ", "WITH RECURSIVE ", 1))
def quality_pipeline_summary(s, d):
    """What became of the facts: scored and refined or rejected, then near duplicates merged, then those that remain tagged."""
    f = written(acted(s, d).select("fact_id", "topic", "text", "refined", "composite", "again", "action"), "acted")
    acts = f.agg(F.count("*").alias("total"), *[F.count_if(F.col("action").contains(x)).alias(x.lower()) for x in ACTIONS])
    rows = stay(f).select(F.col("fact_id").alias("id"), "text", F.col("composite").alias("score"))
    merges = written(S.merge_classes(*S.near_classes(rows), rows.where("id is not null").select("id", "score")), "merges")
    left = rows.join(merges.select(F.col("removed").alias("id")), "id", "left_anti").select(T.mcq_tags(F.col("text")).alias("tags"))
    left = left.select(F.inline(F.array(F.struct("tags"))))  # computed once, as in scored_facts
    remain = left.agg(F.count("*").alias("facts_remaining"), *[F.count_if(F.array_contains("tags", t)).alias(t) for t in TAG_NAMES])
    return acts.crossJoin(merges.agg(F.count("*").alias("duplicates_merged"))).crossJoin(remain)  # one row each


@q("quality_report_groups", "SELECT verdict, tag, count(*) AS n FROM (SELECT verdict, unnest(tags) AS tag FROM scored) GROUP BY ALL")
def quality_report_groups(s, d):
    # every fact has a tag; explode would filter by the tags, and so compute them twice
    return FS(s, d).select("verdict", F.explode_outer("tags").alias("tag")).groupBy("verdict", "tag").agg(F.count("*").alias("n"))


#: The order of the sections of the report.
SECTIONS = ("ACCEPT", "REFINED_ACCEPT", "SALVAGEABLE_ACCEPT", "REFINE", "SALVAGEABLE", "REJECT", "UNSCORED")


@q("quality_report", ACT + """, told AS (SELECT fact_id, CASE WHEN action = 'REJECT_AFTER_REFINE' THEN 'REJECT' ELSE action END AS verdict FROM act)
SELECT list_position(['ACCEPT', 'REFINED_ACCEPT', 'SALVAGEABLE_ACCEPT', 'REFINE', 'SALVAGEABLE', 'REJECT', 'UNSCORED'], t.verdict)::INT AS section, t.verdict, t.fact_id,
       CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS text, round(composite * 1e6) / 1e6 AS score, array_to_string(tags, ',') AS tags
FROM told t JOIN scored USING (fact_id)""")
def quality_report(s, d):
    """A line for each fact, in sections by verdict: its text, cut to 80 characters, its score and its tags."""
    verdict = F.when(F.col("action") == "REJECT_AFTER_REFINE", "REJECT").otherwise(F.coalesce("action", F.lit("UNSCORED")))
    rows = acted(s, d).withColumn("verdict", verdict)
    short = F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 80), F.lit("..."))).otherwise(F.col("text"))
    section = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("verdict")).cast("int")
    out = rows.select(section.alias("section"), "verdict", "fact_id", short.alias("text"), T.rnd(F.col("composite"), 6).alias("score"), F.array_join("tags", ",").alias("tags"))
    return written(out, "report").orderBy("section", "fact_id")  # sorting reads its input twice


@g("snapshot_nodes", ", ids AS (SELECT 'FACT_' || fact_id AS node_id, fact_id AS seq FROM facts UNION ALL SELECT 'TOPIC_' || upper(topic), fact_id FROM facts UNION ALL SELECT 'SOURCE_' || sha256(source_url)[1:12], fact_id FROM facts UNION ALL SELECT ename, fact_id FROM ent) SELECT node_id, type, min(seq) AS first_fact FROM nodes JOIN ids USING (node_id) GROUP BY ALL")
def snapshot_nodes(s, d):
    """The nodes of a month that was saved twice, with an attribute of theirs."""
    nodes, edges = (written(rows, "graph") for rows in graph(s, d))  # made once, saved twice
    path = place(s, "snapshots")
    for _ in range(2):
        bank.save_snapshot(nodes, edges, path, "2026-01")
    return bank.load_snapshot(s, path, "2026-01")[0].select("node_id", "type", bank.attribute("seq", "string").alias("first_fact"))


@g("snapshot_topics", "SELECT 'TOPIC_' || upper(topic) AS node_id, count(*) AS fact_count FROM facts GROUP BY ALL")
def snapshot_topics(s, d):
    """The counters of topics of a snapshot that was saved without them."""
    nodes, edges = graph(s, d)
    path = place(s, "snapshots")
    bank.save_snapshot(nodes, edges, path, "2026-01")
    return bank.load_snapshot(s, path, "2026-01")[2].select("node_id", "fact_count")


@query("unseen_questions", "WITH f AS (SELECT conv_id, turn, role, sha256(lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))) AS h FROM conversations) SELECT conv_id, turn FROM f WHERE role <> 'system' AND h NOT IN (SELECT h FROM f WHERE role = 'system' AND h IS NOT NULL)")
def unseen_questions(s, d):
    """The turns of users and assistants that no turn of the system repeats; what a filter calls new is not looked up."""
    c = D.table(s, d, "conversations").select("conv_id", "turn", "role", T.fingerprint(F.col("text")).alias("h"))
    seen = c.where("role = 'system'").select("h").distinct()
    return store.unseen(c.where("role <> 'system'").select("conv_id", "turn", "h"), seen, store.build_filter(seen)).select("conv_id", "turn")


@q("dedup_exact", "SELECT fact_id FROM (SELECT fact_id, row_number() OVER (PARTITION BY md5(text)[1:12] ORDER BY fact_id) AS n FROM scored) WHERE n = 1")
def dedup_exact(s, d):
    return S.first_by(D.facts(s, d).withColumn("h", F.substring(F.md5("text"), 1, 12)), "h", "fact_id").where("is_first").select("fact_id")


@query("dedup_fingerprint", "WITH f AS (SELECT conv_id, turn, role, sha256(lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))) AS h FROM conversations), seen AS (SELECT DISTINCT h FROM f WHERE role = 'system'), x AS (SELECT f.*, f.h IN (SELECT h FROM seen) AS old, row_number() OVER (PARTITION BY h ORDER BY conv_id, turn) AS n FROM f WHERE role <> 'system') SELECT conv_id, turn, NOT old AND n = 1 AS is_unique FROM x")
def dedup_fingerprint(s, d):
    c = D.table(s, d, "conversations").withColumn("h", T.fingerprint(F.col("text")))
    seen = c.where("role = 'system'").select("h").distinct().withColumn("old", F.lit(True))
    rows = S.first_by(c.where("role <> 'system'"), "h", "conv_id", "turn").join(seen, "h", "left")
    return rows.select("conv_id", "turn", (F.col("is_first") & F.col("old").isNull()).alias("is_unique"))


def doc_rows(s, d):
    return D.spread(D.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


PAIRS = r"""WITH s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS na, len(b.w) AS nb FROM s a JOIN s b ON a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w)) AND len(a.w) > 0),
pairs AS (SELECT i, j, round(k / (na + nb - k)::DOUBLE * 1e4) / 1e4 AS similarity FROM p WHERE k / (na + nb - k)::DOUBLE >= 0.85)
"""


@query("near_dup_pairs", PAIRS + "SELECT * FROM pairs")
def near_dup_pairs(s, d):
    return S.near_pairs(doc_rows(s, d))


@query("near_dup_classes", PAIRS + """, m AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY list_sort(w)) AS cls FROM s WHERE len(w) > 0),
l AS (SELECT id, count(*) AS n FROM (SELECT i AS id FROM pairs UNION ALL SELECT j FROM pairs) GROUP BY id)
SELECT id, cls, coalesce(n, 0) AS n_links FROM m LEFT JOIN l USING (id)""")
def near_dup_classes(s, d):
    """One row for each document with words: the least id with the same token set, and how many documents it is near to."""
    return S.link_counts(*S.near_classes(doc_rows(s, d)))


def clear(rows):
    return rows.select("id", T.linguistic_clarity(F.col("text")).alias("score"))


def clarity(s, d):
    return clear(doc_rows(s, d))


@query("dedup_near")
def dedup_near(s, d):
    return S.merge_classes(*S.near_classes(doc_rows(s, d)), clarity(s, d))


@query("m_rrr")
def m_rrr(s, d):
    return merged_share(doc_rows(s, d))


def merged_share(rows):
    """(value): merged pairs over found pairs of rows (id, text); 1 if none is found."""
    members, near = S.near_classes(rows)
    found = S.count_pairs(members, near)
    return S.merge_classes(members, near, clear(rows)).agg(F.count("*").alias("m")).crossJoin(found).select(F.when(F.col("f") == 0, 1.0).otherwise(T.rnd(F.col("m") / F.nullif("f", F.lit(0)), 4)).alias("value"))


BEST = r"""WITH q AS (SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\s\p{P}\p{S}]+'), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(text), '[\s\p{P}\p{S}]+'), lambda x: x <> '')) AS v FROM benchmark),
best AS (SELECT id, max(coalesce(len(list_intersect(w, v)) / nullif(len(w) + len(v) - len(list_intersect(w, v)), 0)::DOUBLE, 0)) AS best FROM q, c GROUP BY id)
"""


def matched(s, d):
    return S.best_match(doc_rows(s, d), D.table(s, d, "benchmark"))


@query("best_corpus_match", BEST + "SELECT id, round(best * 1e6) / 1e6 AS best FROM best")
def best_corpus_match(s, d):
    return matched(s, d).select("id", T.rnd(F.col("best"), 6).alias("best"))


@query("corpus_alignment", BEST + "SELECT count(*) AS total, round(avg(best) * 1e3) / 1e3 AS mean_best, round(avg(CAST(best > 0.3 AS INT)) * 1e3) / 1e3 AS share FROM best")
def corpus_alignment(s, d):
    return matched(s, d).agg(F.count("*").alias("total"), T.rnd(F.avg("best"), 3).alias("mean_best"), T.rnd(F.avg((F.col("best") > 0.3).cast("int")), 3).alias("share"))


@query("m_qss", BEST + "SELECT round(avg(best) * 1e4) / 1e4 AS value FROM best")
def m_qss(s, d):
    return matched(s, d).agg(T.rnd(F.avg("best"), 4).alias("value"))


@q("m_fqs", "SELECT round(avg(composite) * 1e4) / 1e4 AS value FROM scored")
def m_fqs(s, d):
    return metrics.mean(FS(s, d), "composite")


TARGETS = ("en", "fr", "de", "es", "xx")


def targets(s):
    return s.createDataFrame([(t,) for t in TARGETS], "topic string")


def used(facts):
    """The facts of accepted questions: here the first two sentences of each document."""
    return facts.where(D.place_of(F.col("fact_id")) <= 2).select("fact_id")


@q("m_tcs", ", n AS (SELECT topic, count(*) AS n FROM scored WHERE verdict <> 'REJECT' GROUP BY topic), t AS (SELECT unnest(['en', 'fr', 'de', 'es', 'xx']) AS topic) SELECT round(avg(CAST(coalesce(n, 0) >= 3 AS INT)) * 1e4) / 1e4 AS value FROM t LEFT JOIN n USING (topic)")
def m_tcs(s, d):
    return metrics.topic_coverage(FS(s, d), targets(s))


@q("m_fus", "SELECT round(avg(CAST(CAST(split_part(fact_id, '-', -1) AS BIGINT) <= 2 AS INT)) * 1e4) / 1e4 AS value FROM scored WHERE verdict <> 'REJECT'")
def m_fus(s, d):
    f = FS(s, d)
    return metrics.fact_utilisation(f, used(f))

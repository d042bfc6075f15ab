"""The domain tables, from the driver's tables: facts, pages, episodes, questions, ratings and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a table with fewer files than the session has cores, dealt over these; a larger table as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = len(rows._jdf.inputFiles())  # counted where they are listed: their names stay in the JVM
    return rows.repartition(cores) if files < cores else rows


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, text, topic, publisher, source_url: all sentences of documents.

    A fact_id is the document's id, a hyphen and the place of the sentence, so documents may have any 64-bit id. A null
    doc_id gives a null fact_id.
    """
    return facts_of(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")))


def facts_of(docs: DataFrame) -> DataFrame:
    """The same of documents (doc_id, lang, source, text)."""
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    site = F.when(n < 5, ".gov.bd/").when(n < 10, ".edu/").when(n < 15, ".wikipedia.org/")
    url = F.coalesce(F.concat(F.lit("https://"), F.col("source"), site), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", url.alias("source_url"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "text"))
    return rows.select(fact_id(F.col("doc_id"), F.col("pos") + 1).alias("fact_id"), "text", F.col("lang").alias("topic"), F.col("source").alias("publisher"), "source_url")


def fact_id(document: Column, place: Column) -> Column:
    return F.concat(document.cast("string"), F.lit("-"), place.cast("string"))


def document_of(fact: Column) -> Column:
    """The id of the document that a fact_id names."""
    return F.regexp_extract(fact, "^(.*)-[0-9]+$", 1).cast("long")


def place_of(fact: Column) -> Column:
    return F.substring_index(fact, "-", -1).cast("long")


def scored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts with the parts of their quality, composite, verdict, tags and readiness."""
    return scored(facts(spark, sf_dir))


def scored(facts: DataFrame) -> DataFrame:
    """The same of a table of facts."""
    t = F.col("text")
    part = F.struct(
        T.linguistic_clarity(t).alias("clarity"), T.factual_structure(t).alias("structure"), T.source_reliability(F.col("source_url"), F.col("publisher")).alias("reliability"), F.lit(0.7).alias("freshness")
    )
    # a generator of one row keeps filters on the scores from being pushed below them, where each use would compute them anew
    parts = facts.select("*", F.inline(F.array(part)))
    found = parts.withColumn("composite", T.fact_composite(F.col("clarity"), F.col("structure"), F.col("reliability"), F.col("freshness")))
    tagged = found.withColumns({"verdict": T.fact_verdict(F.col("composite")), "tags": T.mcq_tags(t)})
    return tagged.withColumn("readiness", T.mcq_readiness(F.col("composite"), F.col("tags")))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("episode_id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 500000.0).alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("accepted"), F.col("o_custkey").alias("asker"),
    )


def episode_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("fact_id"))


#: Scores of questions by a number of theirs, on both sides of each bound and on it; by what is left of the number, else by the column named.
FORMATS = {5: 0.75, 6: 0.50, 7: 0.45}
GROUNDINGS, DISTRACTORS, LEFT = {0: 0.80, 1: 0.79, 2: 0.55, 3: 0.30}, {0: 0.55, 1: 0.54, 2: 0.10}, 12
#: What the screening by rules found of each line.
RULES = {5: "DUPLICATE_OPTIONS", 6: "FORMAT_ERROR", 7: "FORMAT_ERROR"}


def _chosen(number: Column, given: dict, other: Column) -> Column:
    out = other
    for n, x in given.items():
        out = F.when(number == n, F.lit(x)).otherwise(out)
    return out


def episode_mcqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with their scores and ``rules``, the code that the screening by rules gave, or ''."""
    line = F.col("l_linenumber")
    x = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("mcq_id"),
        F.col("l_orderkey").alias("episode_id"),
        F.col("l_partkey").alias("fact_id"),
        _chosen(line, FORMATS, F.lit(1.0)).alias("format"),
        _chosen(line, RULES, F.lit("")).alias("rules"),
        _chosen(F.col("l_partkey") % LEFT, GROUNDINGS, 1 - F.col("l_discount")).alias("grounding"),
        (F.col("l_quantity") / 50.0).alias("clarity"),
        _chosen(F.col("l_suppkey") % LEFT, DISTRACTORS, 1 - F.col("l_tax")).alias("distractor"),
        F.when(F.col("l_returnflag") == "A", "easy").when(F.col("l_returnflag") == "N", "medium").otherwise("hard").alias("difficulty"),
    )
    quality = F.lit(0.20) * F.col("format") + F.lit(0.35) * F.col("grounding") + F.lit(0.25) * F.col("clarity") + F.lit(0.20) * F.col("distractor")
    return x.withColumn("quality", quality)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("episode_id"), (F.floor("value") % 5 + 1).cast("int").alias("rating"), F.col("event_type").alias("category"),
        F.col("ts").alias("created_at"), F.get_json_object("props", "$.k").cast("bigint").alias("fact_id"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"), "ts", F.col("event_type").alias("stage"), F.col("value").alias("seconds"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run, here a user's events of one day, with the columns of operators.metrics.TELEMETRY."""
    n = lambda c: F.count_if(F.expr(c))
    runs = run_log(spark, sf_dir).groupBy("run_id", F.to_date("ts").alias("day"))
    return runs.agg(
        F.lit(1).alias("pipeline_runs"), F.bool_and(F.col("stage") != "error").cast("int").alias("successful_runs"), (F.sum("seconds") / 1000.0).alias("cost_usd"), F.sum("seconds").alias("processing_seconds"),
        F.count("*").alias("agent_interactions"), n("stage = 'signup'").alias("episodes_assisted"), n("stage <> 'error'").alias("generations"), n("stage = 'purchase'").alias("accepted_mcqs"),
        n("stage = 'click'").alias("regenerated_mcqs"), n("stage = 'click' and seconds > 50").alias("improved_after_regen"), n("stage = 'error'").alias("initial_failures"),
        n("stage = 'error' and seconds > 40").alias("corrected_failures"), n("stage = 'click' and seconds < 200").alias("regen_with_feedback"),
        n("stage = 'click' and seconds > 80 and seconds < 200").alias("regen_improved_with_feedback"), n("stage = 'error' and seconds < 100").alias("low_quality_identified"),
        n("stage = 'error' and seconds < 30").alias("low_quality_removed"), F.size(F.collect_set("stage")).alias("iterations_to_target"),
    )


#: The same tables as DuckDB common table expressions.
CTE = {
    "parts": r"""parts AS (SELECT doc_id, lang, source, unnest(string_split(regexp_replace(text, '([.।!?])\s+', '\1' || chr(30), 'g'), chr(30))) AS raw, generate_subscripts(string_split(regexp_replace(text, '([.।!?])\s+', '\1' || chr(30), 'g'), chr(30)), 1) AS n FROM documents),
good AS (SELECT doc_id, lang, source, n, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS p FROM parts),
fine AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos FROM good WHERE p <> '' AND NOT regexp_matches(p, '[|\t]') AND len(regexp_extract_all(p, '\S+')) BETWEEN 6 AND 80 AND regexp_matches(p, '[a-zA-Z\x{0980}-\x{09FF}]')),
facts AS (SELECT doc_id || '-' || pos AS fact_id, CASE WHEN regexp_matches(p, '[.।!?]$') THEN p ELSE p || '.' END AS text, lang AS topic, source AS publisher,
  CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS INT) < 5 THEN 'https://' || source || '.gov.bd/' WHEN CAST(regexp_extract(source, '[0-9]+') AS INT) < 10 THEN 'https://' || source || '.edu/'
       WHEN CAST(regexp_extract(source, '[0-9]+') AS INT) < 15 THEN 'https://' || source || '.wikipedia.org/' ELSE '' END AS source_url FROM fine)""",
    "episodes": "episodes AS (SELECT o_orderkey AS episode_id, o_orderpriority AS topic, o_orderdate AS ts, o_totalprice / 500000.0::DOUBLE AS score, CAST(o_orderstatus = 'F' AS INT) AS accepted, o_custkey AS asker FROM orders)",
    "episode_facts": "episode_facts AS (SELECT l_orderkey AS episode_id, l_partkey AS fact_id FROM lineitem)",
    "mcqs": """mcqs AS (
  SELECT *, 0.20::DOUBLE * format + 0.35::DOUBLE * grounding + 0.25::DOUBLE * clarity + 0.20::DOUBLE * distractor AS quality FROM (
    SELECT l_orderkey || '-' || l_linenumber AS mcq_id, l_orderkey AS episode_id, l_partkey AS fact_id, l_quantity / 50::DOUBLE AS clarity,
           CASE l_linenumber WHEN 5 THEN 0.75::DOUBLE WHEN 6 THEN 0.50::DOUBLE WHEN 7 THEN 0.45::DOUBLE ELSE 1::DOUBLE END AS format,
           CASE l_linenumber WHEN 5 THEN 'DUPLICATE_OPTIONS' WHEN 6 THEN 'FORMAT_ERROR' WHEN 7 THEN 'FORMAT_ERROR' ELSE '' END AS rules,
           CASE l_partkey % 12 WHEN 0 THEN 0.80::DOUBLE WHEN 1 THEN 0.79::DOUBLE WHEN 2 THEN 0.55::DOUBLE WHEN 3 THEN 0.30::DOUBLE ELSE 1 - l_discount END AS grounding,
           CASE l_suppkey % 12 WHEN 0 THEN 0.55::DOUBLE WHEN 1 THEN 0.54::DOUBLE WHEN 2 THEN 0.10::DOUBLE ELSE 1 - l_tax END AS distractor,
           CASE l_returnflag WHEN 'A' THEN 'easy' WHEN 'N' THEN 'medium' ELSE 'hard' END AS difficulty
    FROM lineitem))""",
    "feedback": "feedback AS (SELECT event_id AS id, user_id AS episode_id, CAST(floor(value) % 5 + 1 AS INT) AS rating, event_type AS category, ts AS created_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS fact_id FROM events)",
    "run_log": "run_log AS (SELECT event_id AS seq, user_id AS run_id, ts, event_type AS stage, value AS seconds FROM events)",
    "telemetry": """telemetry AS (SELECT 1 AS pipeline_runs, CAST(bool_and(event_type <> 'error') AS INT) AS successful_runs, sum(value) / 1000 AS cost_usd, sum(value) AS processing_seconds, count(*) AS agent_interactions,
  count(*) FILTER (event_type = 'signup') AS episodes_assisted, count(*) FILTER (event_type <> 'error') AS generations, count(*) FILTER (event_type = 'purchase') AS accepted_mcqs, count(*) FILTER (event_type = 'click') AS regenerated_mcqs,
  count(*) FILTER (event_type = 'click' AND value > 50) AS improved_after_regen, count(*) FILTER (event_type = 'error') AS initial_failures, count(*) FILTER (event_type = 'error' AND value > 40) AS corrected_failures,
  count(*) FILTER (event_type = 'click' AND value < 200) AS regen_with_feedback, count(*) FILTER (event_type = 'click' AND value > 80 AND value < 200) AS regen_improved_with_feedback,
  count(*) FILTER (event_type = 'error' AND value < 100) AS low_quality_identified, count(*) FILTER (event_type = 'error' AND value < 30) AS low_quality_removed, count(DISTINCT event_type) AS iterations_to_target
FROM events GROUP BY user_id, CAST(ts AS DATE))""",
}


def sql(body: str, *tables: str) -> str:
    """DuckDB SQL with the named domain tables in front of ``body``, which may start with further expressions and a comma."""
    return "WITH " + ",\n".join(CTE[t] for t in tables) + "\n" + body

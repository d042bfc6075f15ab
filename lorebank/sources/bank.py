"""The JSON question bank, the run log, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from ..operators.graph import topic_counters

ENTRY = "struct<id:string,fact_text:string,text:string,fact:string,question_bn:string,question:string,topic:string,correct_answer:string,explanation:string,options:map<string,string>,difficulty:string>"


def scan_json_bank(spark: SparkSession, path: str) -> DataFrame:
    """text, topic of every entry of JSON files: under questions, else facts, else the file itself; a list is its entries.

    The text is the first non-empty of fact_text, text, fact, question_bn, question; entries without one are dropped. A
    missing topic is General. A file that cannot be parsed gives no row.
    """
    return entries(spark.read.option("wholetext", True).text(path))


def entries(raw: DataFrame) -> DataFrame:
    """The entries of whole files (value), as in ``scan_json_bank``."""
    as_list = F.from_json("value", f"array<{ENTRY}>", {"mode": "PERMISSIVE"})
    as_dict = F.from_json("value", f"struct<questions:array<{ENTRY}>,facts:array<{ENTRY}>>")
    alone = F.array(F.from_json("value", ENTRY))
    listed = F.col("value").rlike(r"^\s*\[")
    every = F.when(listed, as_list).otherwise(F.coalesce(as_dict["questions"], as_dict["facts"], alone))
    rows = raw.select(F.explode(every).alias("e"))
    some = lambda c: F.nullif(F.col(f"e.{c}"), F.lit(""))
    text = F.coalesce(*[some(c) for c in ("fact_text", "text", "fact", "question_bn", "question")])
    return rows.select(F.col("e.id").alias("id"), text.alias("text"), F.coalesce(some("topic"), F.lit("General")).alias("topic"), "e.options", "e.correct_answer").where("text is not null")


RUN_LOG = "pipeline_run_id string, timestamp timestamp, stage string, input map<string,string>, output map<string,string>, metrics map<string,string>, failure_mode string, execution_time_ms bigint"


def scan_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).json(path)


def append_run_log(rows: DataFrame, path: str) -> None:
    """Adds lines. Where ``execution_time_ms`` is null it becomes the time since the run's first line, in the log or among ``rows``; 0 for the start."""
    spark = rows.sparkSession
    first = rows.select("pipeline_run_id", "timestamp")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        before = scan_run_log(spark, path).select("pipeline_run_id", "timestamp")
        first = first.unionByName(before.join(rows.select("pipeline_run_id").distinct(), "pipeline_run_id", "left_semi"))
    started = first.groupBy("pipeline_run_id").agg(F.min("timestamp").alias("started"))
    same = F.col("pipeline_run_id").eqNullSafe(F.col("run"))
    timed = rows.join(started.withColumnRenamed("pipeline_run_id", "run"), same, "left")
    elapsed = F.coalesce("execution_time_ms", F.unix_millis("timestamp") - F.unix_millis("started"))
    timed.select(*[elapsed.alias(c) if c == "execution_time_ms" else c for c in rows.columns]).write.mode("append").json(path)


def run_lines(runs: DataFrame, stage: str, failure: str = "none") -> DataFrame:
    """Lines of the log for ``stage`` (start, a stage's name, complete) of runs (pipeline_run_id, timestamp, and of input, output, metrics, failure_mode those that there are)."""
    have = set(runs.columns)
    maps = {c: F.coalesce(F.col(c), F.create_map()).cast("map<string,string>") if c in have else F.create_map().cast("map<string,string>") for c in ("input", "output", "metrics")}
    mode = F.coalesce(F.col("failure_mode"), F.lit(failure)) if "failure_mode" in have else F.lit(failure)
    took = F.lit(0 if stage == "start" else None).cast("bigint")
    return runs.select("pipeline_run_id", "timestamp", F.lit(stage).alias("stage"), *[x.alias(c) for c, x in maps.items()], mode.alias("failure_mode"), took.alias("execution_time_ms"))


def clear_run_log(spark: SparkSession, path: str) -> None:
    """The log without any line."""
    spark.createDataFrame([], RUN_LOG).write.mode("overwrite").json(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled; nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


#: Columns of a node that stand by themselves in a snapshot; all others are its attributes, as open as JSON.
NODE = ("node_id", "type")


def save_snapshot(nodes: DataFrame, edges: DataFrame, path: str, month: str, topics: DataFrame | None = None) -> None:
    """The graph of a month, in place of what was saved for the month before; other months stay.

    Nodes (node_id, type and any others) keep the others as one VARIANT column, so nodes of different kinds and months may
    have different ones. topics: the counters of topics, see ``operators.graph.topic_counters``.
    """
    others = [c for c in nodes.columns if c not in NODE]
    open_ = F.to_variant_object(F.struct(*others)) if others else F.parse_json(F.lit("{}"))
    tables = {"nodes": nodes.select(*NODE, open_.alias("attributes")), "edges": edges}
    if topics is not None:
        tables["topics"] = topics
    made = {name: written(rows, name) for name, rows in tables.items()}  # what is saved may read what is saved over
    for name, rows in made.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/snapshot_month={month}")


def load_snapshot(spark: SparkSession, path: str, month: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, topics) of a month: nodes with their attributes as a VARIANT, see ``attribute``. A snapshot without
    counters of topics gets them from its edges."""
    nodes, edges = (spark.read.parquet(f"{path}/{n}/snapshot_month={month}") for n in ("nodes", "edges"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/topics/snapshot_month={month}")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return nodes, edges, spark.read.parquet(str(at.toString()))
    return nodes, edges, topic_counters(nodes, edges)


def attribute(name: str, kind: str) -> Column:
    """An attribute of the nodes of a snapshot; null where a node has none of this name."""
    return F.try_variant_get("attributes", f"$.{name}", kind)

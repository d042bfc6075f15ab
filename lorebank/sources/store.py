"""The event memory as tables in a folder: creation, writes, updates, forgetting, and small stores beside it.

The tables are Spark tables of Parquet files, partitioned by the period (a month) of their episode and bucketed by episode_id. So a
span of time reads its periods alone, what hangs on an episode is joined to it without a shuffle, and within a bucket rows are
sorted by what else is looked up. An update or a deletion overwrites the periods that it touches and no others.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory as M
from .scratch import written

#: The five tables and their columns.
TABLES = {
    "episodes": "episode_id string, input_question string, intent string, blueprint string, topic string, timestamp timestamp, generation_config string, embedding binary, overall_score double, accepted int, decay_score double",
    "episode_facts": "episode_id string, fact_id string",
    "episode_mcqs": "mcq_id string, episode_id string, question string, options string, correct_answer string, difficulty string, quality_score double, format_score double, grounding_score double, clarity_score double, distractor_score double, regeneration_round int",
    "rejection_logs": "episode_id string, reason string, judge_feedback string, timestamp timestamp",
    "feedback": "episode_id string, mcq_id string, fact_ids string, rating int, category string, comment string, created_at timestamp",
}
#: What a column holds where a row does not say.
DEFAULTS = {
    "generation_config": "{}", "overall_score": 0.0, "accepted": 0, "options": "[]", "correct_answer": "", "difficulty": "medium", "question": "", "quality_score": 0.0, "format_score": 0.0,
    "grounding_score": 0.0, "clarity_score": 0.0, "distractor_score": 0.0, "regeneration_round": 0, "fact_ids": "[]", "rating": 3,
}


#: What rows of a bucket are sorted by, beside their episode: the other columns that are looked up.
SORTED = {"episode_facts": "fact_id", "feedback": "rating"}
#: Buckets of a period of a table, and the period that a partition holds: a month, or a year ("yyyy") where months are small. Files
#: follow both, so a folder keeps what it was made with. A bucket is written by one task, so take as many as tasks should write.
BUCKETS, PERIOD = 8, "yyyy-MM"
#: The period of rows without a time, and of those that hang on no episode.
TIMELESS = "none"


class Store:
    """The tables under a path. The catalog of the session knows them by names made from it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, period: str = PERIOD):
        self.spark, self.path, self.buckets, self.period = spark, path.rstrip("/"), buckets, period
        self._prefix = "memory_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]

    def table(self, name: str) -> str:
        """The table's name in the catalog."""
        return f"{self._prefix}_{name}"

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _folder(self, path: str):
        """The file system that a path is in."""
        return self._at(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def create(self) -> None:
        """Defines the tables, over the files that are there, if any; an older definition gets the columns that it lacks."""
        for name, schema in TABLES.items():
            table = self.table(name)
            order = f"SORTED BY ({SORTED[name]}) " if name in SORTED else ""
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({schema}, period string) USING parquet PARTITIONED BY (period) "
                f"CLUSTERED BY (episode_id) {order}INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
            have = set(self.spark.table(table).columns)
            self._folder(f"{self.path}/{name}").mkdirs(self._at(f"{self.path}/{name}"))
            lacking = [c for c in schema.split(", ") if c.split(" ")[0] not in have]
            if lacking:
                self.spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(lacking)})")
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")

    def read(self, name: str, periods: list[str] | None = None) -> DataFrame:
        """A table with the period of its rows, or these periods of it; columns that older files lack have their defaults."""
        columns = [c.split(" ")[0] for c in TABLES[name].split(", ")]
        rows = self.spark.table(self.table(name)).select(*columns, "period")
        if periods is not None:
            rows = rows.where(F.col("period").isin(periods))
        return rows.fillna({c: v for c, v in DEFAULTS.items() if c in columns})

    def between(self, start: str, end: str) -> DataFrame:
        """The episodes of a span of time, both ends included; only its periods are read."""
        span = F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
        return self.read("episodes").where(F.col("period").between(start[: len(self.period)], end[: len(self.period)]) & span)

    def _write(self, name: str, rows: DataFrame, overwrite: bool = False) -> None:
        """Appends rows, or overwrites the periods that they have; each task holds one bucket, so it writes one file a period."""
        columns = [c.split(" ")[0] for c in TABLES[name].split(", ")]
        session = self.spark.conf
        dealt = rows.select(*columns, "period").repartition(self.buckets, "episode_id")
        key, before = "spark.sql.sources.partitionOverwriteMode", session.get("spark.sql.sources.partitionOverwriteMode")
        session.set(key, "dynamic")
        try:
            # by position in the table, where added columns come last
            dealt.select(*self.spark.table(self.table(name)).columns).write.insertInto(self.table(name), overwrite=overwrite)
        finally:
            session.set(key, before)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows (with ``period``); columns that they lack, and nulls, get their defaults, other columns are left out."""
        of = dict(rows.dtypes)
        columns = []
        for column, kind in (c.rsplit(" ", 1) for c in TABLES[name].split(", ")):
            value = F.col(column) if column in of else F.lit(None)
            if of.get(column, "").startswith(("map", "array", "struct")):
                value = F.to_json(value)
            if column in DEFAULTS:
                value = F.coalesce(value.cast(kind), F.lit(DEFAULTS[column]))
            columns.append(value.cast(kind).alias(column))
        self._write(name, rows.select(*columns, F.coalesce("period", F.lit(TIMELESS)).alias("period")))

    def _keep(self, name: str, periods: list[str], gone: DataFrame) -> None:
        """These periods of a table without the rows of episodes that are ``gone``; a period that loses all of them goes."""
        left = written(self.read(name, periods).join(gone, "episode_id", "left_anti"), name)
        self._write(name, left, overwrite=True)
        lost = sorted(set(periods) - {r.period for r in left.select("period").distinct().collect()})
        for period in lost:
            at = f"{self.path}/{name}/period={period}"
            self._folder(at).delete(self._at(at), True)
        if lost:
            self.spark.sql(f"ALTER TABLE {self.table(name)} DROP IF EXISTS " + ", ".join(f"PARTITION (period = '{m}')" for m in lost))

    def write_episodes(self, episodes: DataFrame, facts: DataFrame, mcqs: DataFrame | None = None) -> None:
        """New episodes with the ids of their facts and with their questions. A new episode's decay is that of age 0.

        What hangs on an episode is kept in its period. The episodes come last: one is there only when its facts and
        questions are.
        """
        period = F.date_format(F.col("timestamp").cast("timestamp"), self.period)
        episodes = episodes.withColumn("period", period)
        of = episodes.select(F.col("episode_id").cast("string"), "period").dropDuplicates(["episode_id"])
        hung = lambda rows: rows.withColumn("episode_id", F.col("episode_id").cast("string")).join(of, "episode_id", "left")
        self.append("episode_facts", hung(facts))
        if mcqs is not None:
            self.append("episode_mcqs", hung(mcqs))
        score, accepted = (F.coalesce(F.col(c), F.lit(0)) for c in ("overall_score", "accepted"))
        self.append("episodes", episodes.withColumn("decay_score", T.decay(F.lit(0), accepted, score)))

    def update_episodes(self, updates: DataFrame, now) -> None:
        """Changes of episodes (episode_id, accepted, overall_score, regeneration_round, rejection_reason, judge_feedback; null: as before).

        The decay of each is that of its age at ``now``, a timestamp column. A round goes to all its questions; a reason or
        a word of the judge is logged. Ids without an episode are left out; of several changes of one id the greatest
        counts, compared column by column in this order. Only the periods of changed episodes are written.
        """
        names = ("accepted", "overall_score", "regeneration_round", "rejection_reason", "judge_feedback")
        one = updates.groupBy(F.col("episode_id").cast("string").alias("episode_id")).agg(F.max(F.struct(*names)).alias("x")).select("episode_id", "x.*")
        new = one.withColumnsRenamed({"accepted": "new_accepted", "overall_score": "new_score", "regeneration_round": "new_round"})
        new = written(new.join(self.read("episodes").select("episode_id", F.col("period").alias("in_period")), "episode_id"), "updates")
        periods = [r.in_period for r in new.select("in_period").distinct().collect()]
        if not periods:
            return
        changed = self.read("episodes", periods).join(new.withColumn("is_new", F.lit(True)), "episode_id", "left")
        score, accepted = F.coalesce("new_score", "overall_score"), F.coalesce("new_accepted", "accepted")
        age = F.floor((M.seconds(now) - M.seconds(F.col("timestamp"))) / M.DAY)
        decay = F.when(F.col("is_new"), T.decay(age, accepted, score)).otherwise(F.col("decay_score"))
        changed = changed.withColumns({"decay_score": decay, "overall_score": score, "accepted": accepted.cast("int")})
        told = new.where("rejection_reason is not null or judge_feedback is not null")
        if told.limit(1).count():
            self.append("rejection_logs", told.select("episode_id", F.col("rejection_reason").alias("reason"), "judge_feedback", now.alias("timestamp"), F.col("in_period").alias("period")))
        rounds = new.where("new_round is not null").select("episode_id", "new_round", "in_period")
        again = [r.in_period for r in rounds.select("in_period").distinct().collect()]
        if again:
            mcqs = self.read("episode_mcqs", again).join(rounds.drop("in_period"), "episode_id", "left")
            self._write("episode_mcqs", mcqs.withColumn("regeneration_round", F.coalesce("new_round", "regeneration_round").cast("int")), overwrite=True)
        self._write("episodes", changed, overwrite=True)

    def doomed(self, now, threshold: float = 0.1, max_age: int = 90) -> DataFrame:
        """(episode_id, period) to forget: not (accepted and above .85), and with a stored decay below the threshold or old and rejected."""
        old = M.seconds(F.col("timestamp")) < M.seconds(now) - max_age * M.DAY
        safe = (F.col("accepted") == 1) & (F.col("overall_score") > 0.85)
        return self.read("episodes").where(~safe & ((F.col("decay_score") < threshold) | (old & (F.col("accepted") == 0)))).select("episode_id", "period")

    def forget(self, now, threshold: float = 0.1, max_age: int = 90, dry_run: bool = False) -> int:
        """Deletes the episodes that are to be forgotten, with all that hangs on them but feedback; how many. A dry run only counts.

        The episodes go before what hangs on them, so none is ever there without it. What a run that broke off in between
        left hanging on no episode goes with ``sweep``.
        """
        gone = written(self.doomed(now, threshold, max_age), "doomed")
        periods = sorted(r.period for r in gone.select("period").distinct().collect())
        n = gone.count()
        if not dry_run and n:
            for name in ("episodes", "episode_facts", "episode_mcqs", "rejection_logs"):
                self._keep(name, periods, gone.select("episode_id"))
        return n

    def sweep(self) -> None:
        """Deletes what hangs on no episode, but feedback."""
        there = self.read("episodes").select("episode_id")
        for name in ("episode_facts", "episode_mcqs", "rejection_logs"):
            lost = written(self.read(name).join(there, "episode_id", "left_anti").select("episode_id", "period").distinct(), "lost")
            periods = sorted(r.period for r in lost.select("period").distinct().collect())
            if periods:
                self._keep(name, periods, lost.select("episode_id"))

    def write_feedback(self, rows: DataFrame) -> int:
        """Adds ratings, in the period they were given; those outside 1 to 5 are refused, and their number is given back."""
        rating = F.coalesce(F.col("rating"), F.lit(DEFAULTS["rating"]))
        period = F.date_format(F.col("created_at").cast("timestamp"), self.period) if "created_at" in rows.columns else F.lit(None).cast("string")
        self.append("feedback", rows.where(rating.between(1, 5)).withColumn("period", period))
        return rows.where(~rating.between(1, 5)).count()


#: Fingerprints in a line of a store of seen questions.
LINE = 10_000


def load_seen(spark: SparkSession, path: str) -> DataFrame:
    """(h) the fingerprints of a store of seen questions: JSON lines or one JSON text with the list ``fingerprints``; none if there is no store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "h string")
    whole = spark.read.schema("fingerprints array<string>").option("multiLine", path.endswith(".json")).json(path)
    return whole.select(F.explode("fingerprints").alias("h")).distinct()


def save_seen(seen: DataFrame, path: str) -> None:
    """Fingerprints (h) as JSON lines, each a list of up to about LINE of them."""
    parts = F.greatest(F.lit(1), F.ceil(F.count("*") / LINE))
    distinct = seen.select("h").distinct()
    cut = distinct.crossJoin(F.broadcast(distinct.agg(parts.alias("parts")))).withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")))
    cut.groupBy("part").agg(F.array_sort(F.collect_list("h")).alias("fingerprints")).select("fingerprints").write.mode("overwrite").json(path)


#: Bits of a filter for each fingerprint, how many of them one sets, and the bits of a block, which is a built-in bitmap.
ROOM, SET, BLOCK = 14, 5, 32768


def _spots(h: str, blocks: int) -> list[Column]:
    """The block of a fingerprint and its bits there, each from a hash of its own."""
    return [F.pmod(F.xxhash64(F.col(h), F.lit(-1)), F.lit(blocks)), *[F.pmod(F.xxhash64(F.col(h), F.lit(i)), F.lit(BLOCK)) for i in range(SET)]]


def build_filter(seen: DataFrame, blocks: int | None = None) -> DataFrame:
    """(block, bits, blocks): a Bloom filter of fingerprints (h), one bitmap for each block that has any.

    All bits of a fingerprint lie in one block, so a look-up meets one row. ``blocks`` is chosen by the number of
    fingerprints; filters of the same number of blocks can be merged.
    """
    blocks = blocks or max(1, -(-seen.count() * ROOM // BLOCK))
    block, *bits = _spots("h", blocks)
    each = seen.where("h is not null").select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    return each.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("blocks", F.lit(blocks).cast("long"))


def merge_filters(*filters: DataFrame) -> DataFrame:
    """One filter of all fingerprints of several, which have to have the same number of blocks."""
    every = reduce(DataFrame.unionByName, filters)
    return every.groupBy("block", "blocks").agg(F.bitmap_or_agg("bits").alias("bits")).select("block", "bits", "blocks")


def possibly_seen(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (h and any others) with ``possible``: false if the fingerprint is surely not in the filter; a null one is not."""
    one = found.select("blocks").limit(1).collect()
    if not one:
        return rows.withColumn("possible", F.lit(False))
    block, *bits = _spots("h", one[0].blocks)
    byte = lambda bit: F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    test = lambda bit: F.getbit(byte(bit), F.pmod(bit, F.lit(8)).cast("int")) == 1
    joined = rows.withColumn("block", block).join(found.select("block", "bits"), "block", "left")
    every = reduce(lambda a, b: a & b, [test(bit) for bit in bits])
    return joined.withColumn("possible", F.coalesce(F.col("h").isNotNull() & F.col("bits").isNotNull() & every, F.lit(False))).drop("block", "bits")


def unseen(rows: DataFrame, seen: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (h and any others) whose fingerprint is not among those ``seen`` (h); null ones are not.

    What the filter ``found`` of these says is new passes by itself; only the rest, mostly true repeats, meets the store.
    """
    asked = possibly_seen(rows, found)
    return asked.where("not possible").drop("possible").unionByName(asked.where("possible").drop("possible").join(seen.select("h"), "h", "left_anti").select(*rows.columns))


def save_improvement_log(evaluations: DataFrame, path: str, generated_at: str) -> None:
    """All evaluations (with ``passed``) as JSON lines in path/evaluations, and their number and pass rate in path/summary."""
    evaluations.write.mode("overwrite").json(f"{path}/evaluations")
    rate = F.coalesce(T.rnd(F.avg(F.col("passed").cast("int")), 3), F.lit(0.0))
    summary = evaluations.agg(F.count("*").alias("total_evaluated"), rate.alias("pass_rate")).select(F.lit(generated_at).alias("generated_at"), "*")
    summary.write.mode("overwrite").json(f"{path}/summary")


def export_stats(rows: DataFrame) -> DataFrame:
    """(kind, key, n, avg_quality) of exported questions: all, by topic and by difficulty; an unnamed one is Unknown or unknown."""
    whole = rows.agg(F.count("*").alias("n"), T.rnd(F.avg("quality"), 3).alias("avg_quality")).select(F.lit("total").alias("kind"), F.lit("all").alias("key"), "n", "avg_quality")
    none = F.lit(None).cast("double").alias("avg_quality")
    for kind, other in (("topic", "Unknown"), ("difficulty", "unknown")):
        by = rows.groupBy(F.coalesce(kind, F.lit(other)).alias("key")).agg(F.count("*").alias("n"))
        whole = whole.unionByName(by.select(F.lit(kind).alias("kind"), "key", "n", none))
    return whole

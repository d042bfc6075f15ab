"""Streams whose results outlive a restart: the time since the start of a run, and penalties from ratings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import memory as M

#: The state store that ``elapsed_stream`` needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Started(StatefulProcessor):
    """Keeps the first time of each run, for ``kept`` milliseconds if any, and gives each line the time since then."""

    def __init__(self, kept: int | None):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "us long", ttlDurationMs=self.kept) if self.kept else handle.getValueState("first", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        first = min(int(f["us"].min()) for f in frames)
        if self.first.exists():
            first = min(first, self.first.get()[0])
        self.first.update((first,))
        for f in frames:
            yield pd.DataFrame({"run_id": f["run_id"], "seq": f["seq"], "elapsed_ms": f["us"] // 1000 - first // 1000})

    def close(self) -> None:
        pass


def elapsed_stream(lines: DataFrame, kept: int | None = None) -> DataFrame:
    """(run_id, seq, elapsed_ms) of a stream of lines (run_id, seq, ts): the time since the first line of their run so far.

    The start of a run is state that goes with the checkpoint of the query, so a line that arrives in a later batch, or
    after a restart, counts from the same start. A line that is older than those that came before it moves the start for the
    lines after it. Lines without a time are left out. The session's state store has to be ROCKSDB.

    With ``kept`` the start is forgotten so many milliseconds after the last line of the run. That goes by the clock, so such a
    query makes batches as long as it runs: start it with a trigger of some interval, not with one that ends.
    """
    rows = lines.where("ts is not null").select(F.col("run_id").cast("string"), F.col("seq").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("run_id").transformWithStateInPandas(Started(kept), "run_id string, seq long, elapsed_ms long", "append", "ProcessingTime" if kept else "None")


def elapsed(lines: DataFrame) -> DataFrame:
    """The same of a table that holds all lines."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = lines.where("ts is not null").select(F.col("run_id").cast("string").alias("run_id"), F.col("seq").cast("long").alias("seq"), ms.alias("ms"))
    first = rows.groupBy(F.col("run_id").alias("run")).agg(F.min("ms").alias("first"))
    return rows.join(first, F.col("run_id").eqNullSafe(F.col("run"))).select("run_id", "seq", (F.col("ms") - F.col("first")).alias("elapsed_ms"))


def penalty_stream(ratings: DataFrame, path: str, checkpoint: str):
    """Starts a query over a stream of ratings that keeps what each batch takes from each fact under ``path``; see ``penalised``.

    The result of a batch stands in a folder named after its number, which a replay overwrites, so each rating counts once
    however often a batch is run.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        M.low_points(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return ratings.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def penalised(spark: SparkSession, path: str, composites: DataFrame | None = None) -> DataFrame:
    """The penalties of all batches that ``penalty_stream`` has kept, from the facts' own ``composites`` (fact_id, composite)."""
    return M.from_points(M.merged_points(spark.read.parquet(path)), composites)

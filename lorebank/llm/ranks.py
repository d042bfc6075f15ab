"""Places of rows in a global order, without any task that holds more than a range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in this order, from 1 on.

    The order has to tell rows apart well enough to be cut into ranges: add a number of the row if many may be equal.
    The sorted rows are written in the shared folder with their partition and place in it; the sizes of the partitions,
    one number each, are added up on the driver. An empty table gives none.
    """
    at = F.monotonically_increasing_id()  # after a sort: the range in the high bits, the place in it in the low 33
    placed = written(rows.orderBy(*order).withColumn("__at", at), name)
    part = F.shiftright("__at", 33).alias("__part")
    before, offsets = 0, []
    for r in placed.groupBy(part).agg(F.count("*").alias("n")).orderBy("__part").collect():
        offsets.append((r["__part"], before))
        before += r.n
    base = placed.sparkSession.createDataFrame(offsets, "__part long, __before long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = placed.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(base), "__part")  # a row for each partition
    return joined.withColumn(name, F.col("__before") + inside).drop("__part", "__before", "__at")

"""Written intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets one of its own; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lorebank-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _mine(spark: SparkSession) -> str:
    return f"{folder(spark)}/lorebank/{spark.sparkContext.applicationId}"


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_mine(spark)}/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str = "table", *, group: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors.

    Rows of megabytes need a ``group``, the most rows of a row group: its writer looks at its size only every 100 rows, and
    a reader holds the columns of a whole one.
    """
    spark = df.sparkSession
    path = place(spark, name)
    (df.write if group is None else df.write.option("parquet.block.row.count.limit", group)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of groups that Python works on together.
TOGETHER = 1 << 16


def dealt(groups: DataFrame, key: str, rows: DataFrame) -> GroupedData:
    """``groups`` (with a column ``key``) by a hash of their key, for work in Python on many small groups at once: as many parts as the
    written table ``rows`` has TOGETHER, two for each core at least. Parts keep to their number, as few bytes can be much work."""
    n = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TOGETHER))
    return groups.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition(n, "part").groupBy("part")


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this application has written, once no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_mine(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

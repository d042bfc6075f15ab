"""Bounded samples of labelled rows that are the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Times the sample that the first, rough choice leaves; the count of different values behind it is a sketch's, some per cent off.
MARGIN = 4.0


def least_hashed(rows: DataFrame, by: str, hashed: str, sample: int, classes: int) -> DataFrame:
    """For each value of ``by`` the rows with the ``sample`` least values of ``hashed``, a 64-bit hash; of equal ones one.

    So there are at most ``sample * classes`` rows, however large the table is and however often a value is repeated.
    More than ``classes`` values of ``by`` are refused. Different values of ``hashed`` are counted by a sketch, rows far
    above the limit go without a shuffle, and the rest are ranked.
    """
    sizes = {r.k: r.n for r in rows.groupBy(F.col(by).alias("k")).agg(F.approx_count_distinct(hashed).alias("n")).limit(classes + 1).collect()}
    if len(sizes) > classes:
        raise ValueError(f"more than {classes} values of {by}")
    if not sizes:
        return rows.limit(0)
    upto = {k: min(2**63 - 1, int(2**64 * MARGIN * sample / max(n, 1)) - 2**63) for k, n in sizes.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in upto.items() for x in kv]), F.col(by))
    some = rows.where(F.col(hashed) <= limit).dropDuplicates([by, hashed])
    rank = F.row_number().over(Window.partitionBy(by).orderBy(hashed))
    return some.withColumn("__rank", rank).where(F.col("__rank") <= sample).drop("__rank")

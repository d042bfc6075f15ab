"""Counters and histograms as a table (name, label, value) that partial results of batches and streams add up to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the buckets of a run's time, in seconds.
BUCKETS = (1, 5, 10, 30, 60, 120, 300)
STATE = "name string, label string, value double"


def counter(rows: DataFrame, name: str, amount: Column | None = None) -> DataFrame:
    """The sum of an amount, or the number of rows."""
    total = F.count("*") if amount is None else F.coalesce(F.sum(amount), F.lit(0))
    return rows.agg(total.cast("double").alias("value")).select(F.lit(name).alias("name"), F.lit("").alias("label"), "value")


def labelled(rows: DataFrame, name: str, key: str, label: Column) -> DataFrame:
    """The number of rows for each value of a label; rows without one are not counted."""
    by = rows.where(label.isNotNull()).groupBy(F.concat(F.lit(f'{key}="'), label.cast("string"), F.lit('"')).alias("label"))
    return by.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("name"), "label", "value")


def histogram(rows: DataFrame, name: str, value: Column, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative buckets, sum and number of the values, which are not null: one row of aggregates, unfolded."""
    upto = lambda bound: F.count_if(value <= bound).cast("double")
    parts = [(f"{name}_bucket", f'le="{b}"', upto(b)) for b in bounds]
    parts += [(f"{name}_bucket", 'le="+Inf"', F.count(value).cast("double")), (f"{name}_count", "", F.count(value).cast("double")), (f"{name}_sum", "", F.coalesce(F.sum(value), F.lit(0.0)))]
    one = rows.agg(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("label"), v.cast("double").alias("value")) for n, x, v in parts]).alias("x"))
    return one.select(F.inline("x"))


def merged(*states: DataFrame) -> DataFrame:
    """The state of all that went into several: each value is the sum of theirs."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy("name", "label").agg(F.sum("value").alias("value"))


def page(state: DataFrame) -> DataFrame:
    """(line) the state as lines of the text format that scrapers read."""
    name = F.when(F.col("label") == "", F.col("name")).otherwise(F.concat("name", F.lit("{"), "label", F.lit("}")))
    return state.select(F.concat_ws(" ", name, F.col("value").cast("string")).alias("line"))

"""Text for people: questions, batch reports and metrics as columns of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def question(text: Column, options: Column, correct: Column) -> Column:
    """A question with its options in the order of their keys, the right one marked."""
    entries = F.sort_array(F.map_entries(F.coalesce(options, F.create_map().cast("map<string,string>"))))
    lines = F.transform(entries, lambda e: F.concat(F.when(e["key"] == correct, "* ").otherwise("  "), e["key"], F.lit(") "), e["value"]))
    return F.concat_ws("\n", F.array(text), lines)


def report(total: Column, passed: Column, rate: Column) -> Column:
    return F.format_string("%d of %d passed (%.1f %%)", passed, total, rate * 100)


def metrics(rows: DataFrame) -> DataFrame:
    """(line) one line for each metric (metric, value), by name; a metric without a value is n/a."""
    shown = F.coalesce(F.format_string("%.4f", F.col("value")), F.lit("n/a"))
    value = F.when(F.col("value").isNull(), F.lit("n/a")).otherwise(shown)
    return rows.orderBy("metric").select(F.concat(F.rpad("metric", 12, " "), value).alias("line"))

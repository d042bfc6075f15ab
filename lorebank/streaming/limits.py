"""Keyed state over time: the sliding-log rate limiter, the expiring cache, and streaming counts of ratings and stages."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Calls in a window by zone, without and with a user.
LIMITS = {"generate": 5, "feedback": 10, "default": 30}
USER_LIMITS = {"generate": 20, "feedback": 50, "default": 100}


def decide(times: list[float], kept: list[float], limit: int, window: float) -> tuple[list[bool], list[int], list[float]]:
    """Decisions for one key's calls in time order, given the accepted calls still in the log; refused calls are not logged."""
    ok, retry = [], []
    for now in times:
        while kept and now - kept[0] >= window:
            kept.pop(0)
        if len(kept) >= limit:
            ok.append(False)
            retry.append(max(1, int(kept[0] + window - now) + 1))
        else:
            kept.append(now)
            ok.append(True)
            retry.append(0)
    return ok, retry, kept


def _in_order(rows: DataFrame, keys: list[str], step, schema: str) -> DataFrame:
    """``step(state, frame)`` over the rows of each key, which come sorted, a batch at a time; state starts as None for each key.
    A null is a key like any other.

    Only the state of one key and one batch of rows are held, however long the log of a key is. What a step decides
    depends on all rows of the key before it, so those of one key stay in one task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            for key, part in frame.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)  # a null key arrives as NaN, which never equals itself
                if key != now:
                    now, state = key, None
                state, out = step(state, key, part)
                yield out

    order = [k for k in ("at", "call_id", "seq") if k in rows.columns]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def rate_limit(calls: DataFrame, window: float = 60.0, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(call_id, allowed, retry_after) of calls (call_id, key, zone, at), at in seconds. State is one log for each key and zone, of at most its limit."""

    def step(kept, key, pdf):
        ok, retry, kept = decide(pdf["at"].tolist(), kept or [], limits.get(key[1], limits["default"]), window)
        return kept, pd.DataFrame({"call_id": pdf["call_id"].to_numpy(), "allowed": ok, "retry_after": retry})

    return _in_order(calls.select("call_id", "key", "zone", "at"), ["key", "zone"], step, "call_id long, allowed boolean, retry_after int")


def rate_limit_stream(calls: DataFrame, window: float = 60.0, limits: dict[str, int] = LIMITS) -> DataFrame:
    """The same for a streaming DataFrame: the log of each key and zone is kept as state between batches."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["at", "call_id"])
        kept = list(state.get[0]) if state.exists else []
        ok, retry, kept = decide(pdf["at"].tolist(), kept, limits.get(key[1], limits["default"]), window)
        state.update((kept,))
        yield pd.DataFrame({"call_id": pdf["call_id"].to_numpy(), "allowed": ok, "retry_after": retry})

    return calls.groupBy("key", "zone").applyInPandasWithState(run, "call_id long, allowed boolean, retry_after int", "log array<double>", "append", "NoTimeout")


def replay_cache(log: DataFrame, size: int, ttl: float) -> DataFrame:
    """(seq, hit) of gets in an access log (cache, seq, at, key): a hit is neither expired nor pushed out, first in first out; a miss sets.
    State is what one cache holds, at most ``size`` keys."""

    def step(held, _, pdf):
        held = OrderedDict() if held is None else held
        hits = []
        for key, now in zip(pdf["key"], pdf["at"], strict=True):
            hit = key in held and now < held[key]
            hits.append(hit)
            if not hit:
                held.pop(key, None)
                if len(held) >= size:
                    for k in [k for k, t in held.items() if now >= t]:
                        del held[k]
                    while len(held) >= size:
                        held.popitem(last=False)
                held[key] = now + ttl
        return held, pd.DataFrame({"seq": pdf["seq"].to_numpy(), "hit": hits})

    return _in_order(log.select("cache", "seq", "at", "key"), ["cache"], step, "seq long, hit boolean")


def ratings_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Counts of ratings from a folder of Parquet files that grows."""
    return spark.readStream.schema(schema).parquet(path).groupBy("rating").agg(F.count("*").alias("n"))


def latency_stream(spark: SparkSession, path: str, schema: str, lateness: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Runs and seconds by stage and window from a growing folder of the run log; rows later than ``lateness`` are dropped."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", lateness).groupBy(F.window("ts", span), "stage").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))


def finished(counts: DataFrame, name: str) -> DataFrame:
    """The table of a streaming count after all that is there now has been read: a row for each key, held by the driver."""
    query = counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.table(name)

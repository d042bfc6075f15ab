"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their n-grams.

A byte automaton reads the words of a slice of texts: a table of 256 classes marks the word bytes of the Arrow buffer, and
where the marks change, words start and end. The CRC-32 of every word is then computed for all of them at once, one byte a
step through the table of the polynomial; a run of several words goes on from the states that its first words left.

Drawing without replacement in proportion to exp(weight) is taking the greatest sums of weight and Gumbel noise. The
noise of a document comes from a digest of its id, so the draw is the same in every run and however the table is cut.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import ALNUM, LOWER, Texts, slices
from .ranks import ranked
from ..sources.scratch import written

#: Bytes of a word that the automaton takes in steps; what a longer word has beyond them is added by zlib, word by word.
STEPS = 64
#: Noise and weights are in thousandths.
UNIT = 1000

_FULL = np.uint32(0xFFFFFFFF)


def crc_table(polynomial: int = 0xEDB88320) -> np.ndarray:
    """What each low byte does to a state of the reflected CRC-32."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, state >> 1 ^ np.uint32(polynomial), state >> 1).astype(np.uint32)
    return state


_TABLE = crc_table()


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC states after data[start:end] of each, all moving on by one byte a step, the longest for the most steps."""
    size = ends - starts
    steps = np.minimum(size, STEPS)
    by = np.argsort(STEPS - steps.astype(np.uint8), kind="stable")
    now, at = state[by], starts[by]
    alive = len(by) - np.cumsum(np.bincount(steps, minlength=STEPS + 1))  # how many take more than k steps
    for k in range(STEPS):
        n = alive[k]
        if not n:
            break
        now[:n] = _TABLE[(now[:n] ^ data[at[:n] + k]) & 0xFF] ^ now[:n] >> 8
    out = np.empty_like(now)
    out[by] = now
    for i in np.flatnonzero(size > STEPS).tolist():
        out[i] = zlib.crc32(data[starts[i] + STEPS : ends[i]].tobytes(), int(out[i] ^ _FULL)) ^ 0xFFFFFFFF
    return out


def features(t: Texts, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of run from ``low`` to ``high`` words: the text and the CRC-32 of each run, in the order of texts.

    A run's bytes are its words, A-Z as a-z, joined by one space.
    """
    starts, ends = t.words(ALNUM)
    first, last = t.bounds(starts)
    text = np.repeat(np.arange(len(t)), last - first)
    data = LOWER[t.data]
    run = np.arange(len(starts))
    state = np.full(len(starts), _FULL, np.uint32)
    for n in range(1, high + 1):
        if n > 1:
            go = run + n - 1 < last[text]
            run, text, state = run[go], text[go], state[go]
            state = _TABLE[(state ^ np.uint32(0x20)) & 0xFF] ^ state >> 8
        state = advance(state, data, starts[run + n - 1], ends[run + n - 1])
        if n >= low:
            yield text, state ^ _FULL


def _count(buckets: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in slices(batch.column(0)):
                for _, crc in features(t, low, high):
                    total += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    return run


def counts(texts: DataFrame, buckets: int, low: int = 1, high: int = 1) -> np.ndarray:
    """How many features of all ``texts`` (text) fall in each bucket; a task sends at most a row for each bucket."""
    some = texts.select(F.col("text").cast("string")).mapInArrow(_count(buckets, low, high), "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for r in some.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target than in the source, both with one more of each."""
    k = len(source)
    all_s, all_t = float(int(source.sum()) + k), float(int(target.sum()) + k)
    return np.array([math.floor(UNIT * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(shipped, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        buckets = len(gain)
        for batch in batches:
            n = np.zeros(len(batch), np.int64)
            weight, words = n.copy(), n.copy()
            for t in slices(batch.column(1)):
                for length, (text, crc) in enumerate(features(t, 1, high), 1):
                    each = np.bincount(text, minlength=len(t))
                    if length == 1:
                        words[t.first : t.first + len(t)] = each
                    if length >= low:
                        sums = np.append(0, np.cumsum(gain[crc % buckets]))
                        upto = np.cumsum(each)
                        n[t.first : t.first + len(t)] += each
                        weight[t.first : t.first + len(t)] += sums[upto] - sums[upto - each]
            yield pa.record_batch([batch.column(0), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gain: np.ndarray, low: int = 1, high: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of ``docs`` (doc_id, text): the sum of the gains of its features."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_weigh(shipped, low, high), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, low: int = 1, high: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Features are the runs of ``low`` to ``high`` consecutive words (letters, digits and non-ASCII characters, A-Z as a-z),
    repeats counted, hashed by CRC-32 into ``buckets``. weight sums the gains of a row's features; score adds the noise
    of its id under ``seed``. Of the rows with at least ``least_words`` words the greatest scores, ``percent`` in a
    hundred rounded down, are drawn: rank counts them from 1, equal scores by id; it is null for the others.

    A null or empty text has no features and the weight 0. A row without an id has a weight, but no score, and is neither
    drawn nor counted. Rows that share an id share its noise; those that also share the score stand next to each other, the one
    with fewer features first. Empty tables are allowed: with an empty target all texts are drawn towards what is rare.
    Texts are read whole, twice: once for the counts and once for the weights.
    """
    gain = gains(counts(docs, buckets, low, high), counts(target, buckets, low, high))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weights(docs, gain, low, high).withColumn("score", F.col("weight") + noise)
    rows = rows.withColumn("__in", (F.col("n_words") >= least_words) & F.col("score").isNotNull())
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "scored")  # read three times: counted, sampled, sorted
    drawn = rows.where("__in").count() * percent // 100
    order = [F.col("__in").desc(), F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("__row")]
    rank = F.when(F.col("__in") & (F.col("rank") <= drawn), F.col("rank"))
    return ranked(rows, order).withColumn("rank", rank).drop("__in", "__row")


def draw(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ids were drawn in ``ranks``, with all their columns; ids are compared, so they should be keys."""
    return docs.join(ranks.where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi")

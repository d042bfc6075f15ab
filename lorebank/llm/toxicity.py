"""Toxicity by a linear classifier on letter n-grams that are scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams. Training takes a bounded sample of labelled texts: r, the log of the ratio of
an n-gram's smoothed rates in toxic and other texts, selects and scales the features, and a logistic regression over
the scaled features gives their weights. The n-grams are counted on the executors; the driver gets the features, and for
each sampled text the features that it has. Scoring looks up one weight for each n-gram, and counts each n-gram once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_np import Texts, slices
from .language_id import folded
from .samples import least_hashed
from ..sources.scratch import written

BITS = 20
SIZES = (4, 5, 6)
#: Training texts of each class, at most.
SAMPLE = 1500
#: Features kept, those with the strongest ratios among n-grams in at least LEAST training texts.
FEATURES = 20_000
LEAST = 6
SMOOTH = 0.5
ROUNDS = 200
PENALTY = 2.0


def grams(t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the n-grams of each size that lie within one text."""
    x = folded(t).astype(np.uint64)
    size = t.hi - t.lo
    left = np.repeat(t.hi, size) - np.arange(len(x))
    for n in SIZES:
        if len(x) < n:
            return
        g = np.zeros(len(x) - n + 1, np.uint64)
        for k in range(n):
            g = (g << np.uint64(8)) | x[k : k + len(g)]
        h = (g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)
        ok = left[: len(g)] >= n
        yield np.flatnonzero(ok), h[ok].astype(np.int64)


def _sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, one text after the other, and their ends."""
    found = [np.empty(0, np.int64)]
    for place, h in grams(t):
        found.append((np.searchsorted(t.lo, place, "right") - 1) << BITS | h)
    every = np.unique(np.concatenate(found))
    return every & ((1 << BITS) - 1), np.searchsorted(every, np.arange(1, len(t) + 1) << BITS)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n0, n1) of (toxic, text) rows: the texts of each class of a partition that have an n-gram."""
    n = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        toxic = batch.column(0).to_numpy()
        for t in slices(batch.column(1), 1 << 18):
            gram, ends = _sets(t)
            label = np.repeat(toxic[t.first : t.first + len(t)], np.diff(np.append(0, ends)))
            for k in (0, 1):
                n[k] += np.bincount(gram[label == k], minlength=1 << BITS)
    seen = np.flatnonzero(n.any(0))
    yield pa.record_batch([pa.array(seen), pa.array(n[0, seen]), pa.array(n[1, seen])], ["gram", "n0", "n1"])


def _feature_rows(shipped):
    """(toxic, features) of (toxic, text) rows: the places, in the shipped n-grams, of those that a text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.full(1 << BITS, -1, np.int32)
        code[shipped.value] = np.arange(len(shipped.value))
        for batch in batches:
            for t in slices(batch.column(1), 1 << 18):
                gram, ends = _sets(t)
                parts = np.split(code[gram], ends[:-1])
                yield pa.record_batch([batch.column(0).slice(t.first, len(t)), pa.array([p[p >= 0].tobytes() for p in parts], pa.binary())], ["toxic", "features"])

    return run


def fit(y: np.ndarray, rows: list[np.ndarray], scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features, whose log-count ratios are ``scale``, and a bias, by logistic regression on labelled rows of features."""
    size = np.array([len(c) for c in rows])
    col, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    value = scale[col] / np.abs(scale).max()
    each = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)  # both classes weigh the same
    w, b = np.zeros(len(scale)), 0.0
    step_w, step_b = np.zeros(len(scale)), 0.0
    for _ in range(ROUNDS):  # gradient steps scaled by their running squares
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * value, len(rows)) + b, -30, 30)))
        e = (p - y) * each
        gw = np.bincount(col, e[row] * value, len(scale)) / len(y) + PENALTY * w / len(y)
        gb = e.mean()
        step_w, step_b = 0.9 * step_w + 0.1 * gw * gw, 0.9 * step_b + 0.1 * gb * gb
        w -= 0.02 * gw / (np.sqrt(step_w) + 1e-6)
        b -= 0.02 * gb / (np.sqrt(step_b) + 1e-6)
    return w * scale / np.abs(scale).max(), float(b)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> dict[str, Any]:
    """Weights by hash and a bias, from texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks 0 or 1, where ``usable`` holds.

    Of each class the ``sample`` labelled ids with the least hashes are used, as far as they have a text; of texts that
    share an id the one with the least hash. An id with both labels is toxic; other labels, and null ids, do not count.
    Texts are read whole. With one class or none, or no n-gram in LEAST texts, the score is constant.
    """
    weights = np.zeros(1 << BITS, np.float32)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(F.lit(True) if usable is None else usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = least_hashed(known.withColumn("hash", F.xxhash64("doc_id")), "toxic", "hash", sample, 2).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most 2 * sample rows
    found = written(found.select("toxic", "text"), "labelled")
    n = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {"weights": weights, "bias": 5.0 if 1 in n else -5.0}
    counted = found.mapInArrow(_count_rows, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rate = lambda k: F.log((F.col(f"n{k}") + SMOOTH) / (n[k] + 2 * SMOOTH))
    rated = counted.where(F.col("n0") + F.col("n1") >= LEAST).withColumn("r", rate(1) - rate(0)).where("r <> 0")
    use = rated.orderBy(F.desc(F.abs("r") * F.sqrt(F.col("n0") + F.col("n1"))), "gram").limit(FEATURES).select("gram", "r").collect()
    if not use:
        return {"weights": weights, "bias": float(np.log(n[1] / n[0]))}
    use.sort(key=lambda r: r.gram)
    gram, scale = np.array([r.gram for r in use]), np.array([r.r for r in use])
    shipped = docs.sparkSession.sparkContext.broadcast(gram)
    rows = sorted((r.toxic, bytes(r.features)) for r in found.mapInArrow(_feature_rows(shipped), "toxic int, features binary").collect())
    weights[gram], bias = fit(np.array([t for t, _ in rows], np.float64), [np.frombuffer(x, np.int32) for _, x in rows], scale)
    return {"weights": weights, "bias": bias}


def _scored(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        weights = model["weights"]
        for batch in batches:
            for t in slices(batch.column(1), 1 << 19):
                found = [np.empty(0, np.int64)]
                for place, h in grams(t):
                    live = np.flatnonzero(weights[h])
                    found.append((np.searchsorted(t.lo, place[live], "right") - 1) << BITS | h[live])
                every = np.unique(np.concatenate(found))
                total = np.bincount(every >> BITS, weights[every & ((1 << BITS) - 1)], len(t)) + model["bias"]
                score = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
                yield pa.record_batch([batch.column(0).slice(t.first, len(t)), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict[str, Any]) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text): 0 to 1, higher if toxic is likelier.

    A null text is empty and gets the bias alone. Only text is an input, read whole however long; equal texts have equal
    scores. Rows are kept as they are, repeated or not, with or without an id; an empty table gives none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scored(shipped), "doc_id long, score double")

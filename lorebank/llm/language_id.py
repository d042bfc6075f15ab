"""Language identification by nearest centroid.

A text is a vector over hashed letter n-grams: 1 + log of the counts, times the idf of the training sample, made to
length one. Each language has several centroids, from spherical k-means over its training vectors. The cosine to the
nearest centroid names the language. A text is rejected if that cosine is less than nearly all training texts of the
language have, cut to about its length, with centroids that were fitted without them; so is a text without letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_np import LOWER, Texts, slices
from .samples import least_hashed
from ..sources.scratch import written

#: Dimensions of a vector, centroids of a language, and (a bound) the different training texts of a language.
DIM = 4096
CENTROIDS = 3
SAMPLE = 500
#: Least bytes of each length class, and the share of training texts, cut to these, that rejection may lose.
LENGTHS = (4, 16, 64, 256, 1024)
REJECT = 0.01
#: Parts of the training texts, each of which is scored by centroids of the others.
FOLDS = 4
#: Languages that are learned, at most; a table with more is refused.
LANGUAGES = 500
#: Bytes and texts that are worked on together: a text takes a row of DIM numbers, however short it is.
SLICE, ROWS = 1 << 18, 512

UNKNOWN = "und"

#: Bytes as small classes: a-z as 1 to 26, the bytes of other characters from 27 on, all else 0.
_CLASS = np.zeros(256, np.uint32)
_CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x80:] = 27 + np.arange(128)
_CLASS = _CLASS[LOWER]


def folded(t: Texts) -> np.ndarray:
    """The classes of the bytes, with Latin capitals of two bytes as their small letters too."""
    x = _CLASS[t.data]
    if len(x):
        capital = np.zeros(len(x), bool)
        capital[1:] = (t.data[:-1] == 0xC3) & (t.data[1:] >= 0x80) & (t.data[1:] <= 0x9E)
        x[capital] += 0x20
    return x


def counts(t: Texts) -> np.ndarray:
    """A row of hashed counts for each text: n-grams of two and three classes, none across texts or of blanks alone."""
    x = folded(t)
    out = np.zeros(len(t) * DIM, np.float32)
    size = t.hi - t.lo
    row = np.repeat(np.arange(len(t), dtype=np.int64) * DIM, size)
    place = np.arange(len(x))
    left = np.repeat(t.hi, size) - place if len(x) else place
    gram = x
    for n in (2, 3):
        if len(x) < n:
            break
        gram = gram[:-1] * np.uint32(256) + x[n - 1 :]
        ok = (left[: len(gram)] >= n) & (gram != 0)
        h = (gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
        out += np.bincount((row[: len(gram)] + h)[ok], minlength=len(out))
    return out.reshape(len(t), DIM)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def clustered(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; fewer centroids if there are fewer different vectors."""
    centre = [v.sum(0)]
    near = v @ centre[0]
    seeds = [int(near.argmax())]
    while len(seeds) < min(k, len(v)):
        best = (v @ v[seeds].T).max(1)
        i = int(best.argmin())
        if best[i] > 0.999:
            break
        seeds.append(i)
    c = v[seeds]
    for _ in range(8):
        at = (v @ c.T).argmax(1)
        c = np.array([v[at == j].sum(0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def has_letter(data: np.ndarray) -> bool:
    low = LOWER[data]
    if ((low >= 0x61) & (low <= 0x7A)).any():
        return True
    return any(c.isalpha() for c in data.tobytes().decode("utf-8", "ignore"))


def _cut(t: Texts, most: int) -> Texts:
    """The texts of at least ``most`` bytes, cut to so many."""
    lo = t.lo[t.hi - t.lo >= most]
    return Texts(t.data[(lo[:, None] + np.arange(most)).ravel()], np.arange(len(lo)) * most, np.arange(1, len(lo) + 1) * most, 0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the places and values of its counts, then those of it cut to each of LENGTHS that it has."""
    for batch in batches:
        for t in slices(batch.column(1), SLICE, ROWS):
            found = [[v] for v in counts(t)]
            for most in LENGTHS:
                long = np.flatnonzero(t.hi - t.lo >= most)
                for i, v in zip(long, counts(_cut(t, most)), strict=True):
                    found[i].append(v)
            at = [[np.flatnonzero(v).astype(np.int32).tobytes() for v in x] for x in found]
            tf = [[v[v > 0].tobytes() for v in x] for x in found]
            kind = pa.list_(pa.binary())
            yield pa.record_batch([batch.column(0).slice(t.first, len(t)), pa.array(at, kind), pa.array(tf, kind)], ["lang", "at", "tf"])


def _dense(rows: list, k: int = 0) -> np.ndarray:
    out = np.zeros((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        out[i, np.frombuffer(r["at"][k], np.int32)] = np.frombuffer(r["tf"][k], np.float32)
    return out


def thresholds(rows: list, v: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The least cosine for each length class of a language with these sampled rows, whose vectors are ``v``.

    A class that no text reaches has the threshold of the class below it; a language of one text rejects nothing.
    """
    cosine: list[list[float]] = [[] for _ in LENGTHS]
    for fold in range(min(FOLDS, len(rows)) if len(rows) > 1 else 0):
        out = np.arange(len(rows)) % FOLDS == fold
        c = clustered(v[~out], CENTROIDS)
        for k in range(len(LENGTHS)):
            long = [r for r, x in zip(rows, out, strict=True) if x and len(r["at"]) > k + 1]
            if long:
                cosine[k] += (vectors(_dense(long, k + 1), idf) @ c.T).max(1).tolist()
    least = [0.0]
    for x in cosine:
        least.append(float(np.quantile(x, REJECT)) if x else least[-1])
    return np.array(least[1:])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, n): how many texts have a count at each place, and at -1 how many there are."""
    seen = np.zeros(DIM + 1, np.int64)
    for batch in batches:
        for x in batch.column(1):
            seen[np.frombuffer(x[0].as_py(), np.int32)] += 1
            seen[DIM] += 1
    at = np.append(np.arange(DIM), -1)
    yield pa.record_batch([pa.array(at[seen > 0], pa.int32()), pa.array(seen[seen > 0])], ["at", "n"])


def _fitted(idf: np.ndarray):
    """Centroids and thresholds of one language from its sampled texts."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["at"], r["tf"]))
        v = vectors(_dense(rows), idf)
        centroids = clustered(v, CENTROIDS).astype(np.float32)
        columns = [[rows[0]["lang"]], [len(centroids)], [centroids.tobytes()], [thresholds(rows, v, idf).tolist()]]
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.float64())), strict=True)], ["lang", "k", "centroids", "reject"])

    return run


def train(docs: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> dict[str, Any]:
    """A model from the text and non-null lang of rows of ``docs`` (doc_id, text, lang) for which ``usable`` holds.

    Of each language the ``sample`` different texts with the least hashes are taken, as hashed counts, so copies count once
    and every run learns the same. Each language is clustered in a task of its own; the driver gets how many texts have a
    count at each place, and the centroids and thresholds. More than LANGUAGES languages are refused. Texts labelled with
    two languages are examples of both. Without any labelled text the model knows no language, and calls every text und.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if usable is None else usable))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    chosen = least_hashed(rows, "lang", "hash", sample, LANGUAGES)
    sampled = written(chosen.select("lang", "text").mapInArrow(_sampled, "lang string, at array<binary>, tf array<binary>"), "sampled")
    seen = np.zeros(DIM + 1)
    for r in sampled.select("lang", "at").mapInArrow(_frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most DIM + 1
        seen[r["at"]] = r.n
    if not seen[DIM]:
        return {"languages": [], "idf": np.ones(DIM, np.float32), "centroids": np.zeros((0, DIM), np.float32), "of": np.zeros(0, np.int64), "reject": np.zeros((0, len(LENGTHS)))}
    idf = (np.log((1 + seen[DIM]) / (1 + seen[:DIM])) + 1).astype(np.float32)
    fit = sampled.groupBy("lang").applyInArrow(_fitted(idf), "lang string, k int, centroids binary, reject array<double>")
    found = sorted(fit.collect(), key=lambda r: r.lang)  # at most LANGUAGES rows of CENTROIDS vectors
    of = np.repeat(np.arange(len(found)), [r.k for r in found])
    all_of = np.frombuffer(b"".join(r.centroids for r in found), np.float32).reshape(-1, DIM)
    return {"languages": [r.lang for r in found], "idf": idf, "centroids": all_of, "of": of, "reject": np.array([r.reject for r in found])}


def _predicted(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        names = np.array([*model["languages"], UNKNOWN], object)
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
            for t in slices(batch.column("__text"), SLICE, ROWS):
                cosine = vectors(counts(t), model["idf"]) @ model["centroids"].T if len(model["of"]) else np.zeros((len(t), 1), np.float32)
                best = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(t)), best].astype(np.float64), 0, 1)
                lang = model["of"][best] if len(model["of"]) else np.zeros(len(t), np.int64)
                size = np.maximum(np.searchsorted(LENGTHS, t.hi - t.lo, "right") - 1, 0)
                least = model["reject"][lang, size] if len(model["of"]) else np.zeros(len(t))
                letters = np.array([has_letter(t.data[a:b]) for a, b in zip(t.lo, t.hi, strict=True)], bool)
                lang = np.where(letters, lang, len(names) - 1)
                score = np.where(letters, score, 0.0)
                out = [batch.column(i).slice(t.first, len(t)) for i in keep]
                out += [pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array((score < least) | ~letters)]
                yield pa.RecordBatch.from_arrays(out, names=[*[batch.schema.names[i] for i in keep], "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: dict[str, Any], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row of ``docs``, with lang_pred, score (the cosine, 0 to 1) and rejected.

    A null text, or one without any letter, is und with score 0 and rejected; a text below the threshold of the language
    it is nearest to is rejected with its score. Of equally near languages it is the first in order, so also where no
    n-gram of the text is known (a text of one letter): that one, with score 0. Only text is an input, read whole however
    long. Rows are kept as they are, repeated or not; an empty table gives none. The model, of a size bounded by
    LANGUAGES, is sent to the executors.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(_predicted(shipped), f"{kinds}, lang_pred string, score double, rejected boolean")

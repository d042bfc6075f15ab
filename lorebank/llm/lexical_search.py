"""Ranked lexical search over an impact-ordered index, score at a time.

Index: a shard (some consecutive documents of a partition, about SHARD bytes of text) has its own dictionary, and for each
term its documents in groups of exactly equal impact, the highest first. The impact of a term in a document is the whole
number (10**9 * tf) div (1000 * tf + 8 * m), where m weighs the document's length against the average. As it needs the
length of all documents, a first pass over the texts counts their words. Shards cut lists by documents, so that no task
holds a whole list, however frequent a term is.

Search: in a shard the groups of a query's terms are taken in falling order of what they add to a score. Once the sum of
what each term can still add is less than the k-th best score, no other document can come in; when few enough documents
are left that can, their scores are completed from the rest of the lists, and those are exact. A task carries the best
of one shard into the next, so later shards stop earlier, or are passed over.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytes_np import ALNUM, LOWER, SLICE, Texts, hash_words, ragged, slices
from .decontamination import item_words
from ..sources.scratch import written

#: Bytes of text of a shard, as long as the task has more; a longer text is a shard of its own.
SHARD = 4 << 20
#: Most bytes of query texts that are sent to the executors at once.
PART = 8 << 20
#: Documents that may be left when scores are completed, besides k; and by how much the level falls from round to round.
LEFT = 64
FALL = 0.7
#: Keys over which the best of all tasks are dealt before the last ranking, so that it reads k of each.
SALTS = 32

#: terms in the order of their hashes under the seed; for each the end of its documents and of its groups; for each group its impact and its end.
_INDEX = "seed int, doc_ids array<long>, terms array<string>, ends array<int>, groups array<int>, impacts array<int>, upto array<int>, docs array<int>"
_HITS = "item int, doc_id long, score long"


@dataclass
class Index:
    """The written index, the number of documents with a term, and of all terms."""

    table: DataFrame
    n_docs: int
    n_terms: int


def _joined(parts: list[Texts]) -> Texts:
    """The texts of some slices as one."""
    base = np.cumsum([0] + [len(t.data) for t in parts])
    lo = np.concatenate([t.lo + b for t, b in zip(parts, base, strict=False)])
    hi = np.concatenate([t.hi + b for t, b in zip(parts, base, strict=False)])
    return Texts(np.concatenate([t.data for t in parts]), lo, hi, 0)


def _index_row(t: Texts, ids: pa.Array, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """Dictionary and impact-ordered lists of the texts of one shard."""
    starts, ends = t.words(ALNUM)
    lo, hi = t.bounds(starts)
    doc = np.repeat(np.arange(len(t), dtype=np.int32), hi - lo)
    seed = 0
    while True:
        h = t.hashes(starts, ends, seed=seed)
        by = np.argsort(h, kind="stable")
        if t.same_words(starts, ends, h, by):
            break
        seed += 1  # two words of the shard share a hash
    h, doc = h[by], doc[by]
    new_term = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
    new = np.flatnonzero(new_term | np.append(True, doc[1:] != doc[:-1])) if len(h) else np.empty(0, np.int64)
    first = by[new_term]  # an occurrence of each term
    tf, doc, of = np.diff(np.append(new, len(h))), doc[new], np.cumsum(new_term[new]) - 1
    value = impact(tf, length_weight(hi - lo, n_docs, n_terms)[doc])
    order = np.lexsort((-value, of))  # stable: documents stay in order within a group
    doc, value, of = doc[order], value[order], of[order]
    group = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)
    upto = np.append(group[1:], len(of))[: len(group)]
    end = np.searchsorted(of, np.arange(len(first)), "right")
    size = ends[first] - starts[first]
    item, i = ragged(size)
    letters = LOWER[t.data[starts[first][item] + i]]
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(letters))
    columns = [ids, terms, end, np.searchsorted(group, end), value[group], upto, doc]
    lists = [x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32)) for x in columns]  # an impact is below 10**6
    row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    return pa.record_batch([pa.array([seed], pa.int32()), *row], [f.split()[0] for f in _INDEX.split(", ")])


def _index(most: int, n_docs: int, n_terms: int):
    """The index of the texts of a partition, in shards of about ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, size = [], [], 0
        for batch in batches:
            for t in slices(batch.column(1), min(most, SLICE)):
                if parts and size + len(t.data) > most:
                    yield _index_row(_joined(parts), pa.concat_arrays(ids), n_docs, n_terms)
                    parts, ids, size = [], [], 0
                # copied: the batch's own buffers go with it
                parts.append(Texts(t.data.copy(), t.lo, t.hi, 0))
                ids.append(pa.array(batch.column(0).slice(t.first, len(t)).to_pylist(), pa.int64()))
                size += len(t.data)
        if parts:
            yield _index_row(_joined(parts), pa.concat_arrays(ids), n_docs, n_terms)

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: the documents with a term, and all terms."""
    n_docs = n_terms = 0
    for batch in batches:
        for t in slices(batch.column(0)):
            starts, _ = t.words(ALNUM)
            lo, hi = t.bounds(starts)
            n_docs, n_terms = n_docs + int((hi > lo).sum()), n_terms + len(starts)
    yield pa.record_batch([pa.array([n_docs]), pa.array([n_terms])], ["n", "l"])


def length_weight(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of ``n`` terms: 25, and 75 for each average length; exact where the product leaves 64 bits."""
    if 75 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 25 + 75 * n.astype(np.int64) * n_docs // max(n_terms, 1)
    return np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build_index(docs: DataFrame) -> Index:
    """The impact-ordered index of all ``docs`` (doc_id, text), one row a shard, written in the shared folder.

    Terms are the maximal runs of letters, digits and non-ASCII characters, A-Z as a-z; a null text has none. Whole texts
    are indexed; each row is a document of its own, whether its id is null or repeated. An empty table gives an empty index.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.select("text").mapInArrow(_lengths, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    n_docs, n_terms = size.n or 0, size.l or 0
    return Index(written(rows.mapInArrow(_index(SHARD, n_docs, n_terms), _INDEX), "impacts", group=1), n_docs, n_terms)


class Queries:
    """Some queries as numbers of terms, with how often each holds a term, and the terms' weights once they are known."""

    def __init__(self, texts: list[str | None]):
        bags = [Counter(item_words(x)) for x in texts]
        self.terms = sorted({w for b in bags for w in b})
        number = {w: i for i, w in enumerate(self.terms)}
        self.bags = [[(number[w], k) for w, k in b.items()] for b in bags]
        self.weight: list[int] = []
        self._by_seed: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def weighted(self, df: dict[int, int], n_docs: int) -> Queries:
        self.weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.terms))]
        return self

    def places(self, seed: int, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(term, place): which terms the dictionary of a shard has, and where. Hashes look up, words decide."""
        if seed not in self._by_seed:
            h = hash_words(self.terms, seed)
            by = np.argsort(h)
            self._by_seed[seed] = h[by], by
        h, number = self._by_seed[seed]
        if not len(terms) or not len(h):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = hash_words(terms, seed)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        some = np.flatnonzero(hashes[at] == h)
        words = terms.take(pa.array(at[some])).to_pylist()
        some = some[[self.terms[i] == w.encode() for i, w in zip(number[some].tolist(), words, strict=True)]] if len(some) else some
        return number[some], at[some]


def _df(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shipped.value
        total = np.zeros(len(queries.terms), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                seed = batch.column(0)[i].as_py()
                terms, ends = (batch.column(c)[i].values for c in (1, 2))
                number, at = queries.places(seed, terms)
                total[number] += np.diff(ends.to_numpy(), prepend=0)[at]
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], ["term", "n"])

    return run


def best_of_shard(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, their exact scores, postings added before the stop) of all that can be among the best ``k``.

    Each list has what its groups add to a score, falling; the places where the groups end; and the documents. Documents
    that cannot reach ``floor``, or the k-th best score of the ``n`` documents, may be left out; none with such a score is.
    """
    score = np.zeros(n, np.int64)
    done = [0] * len(lists)
    rest = sum(int(adds[0]) for adds, _, _ in lists)
    level = max((int(adds[0]) for adds, _, _ in lists), default=0)
    added = 0
    if rest < max(floor, 1):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    while True:
        level = min(level - 1, int(level * FALL))
        rest = 0
        for j, (adds, upto, docs) in enumerate(lists):
            g, was = len(adds) - int(np.searchsorted(adds[::-1], level)), done[j]
            if g > was:
                a, b = int(upto[was - 1]) if was else 0, int(upto[g - 1])
                score[docs[a:b]] += np.repeat(adds[was:g], np.diff(upto[was:g], prepend=a))  # a list has each document once
                done[j], added = g, added + b - a
            rest += int(adds[g]) if g < len(adds) else 0
        kth = int(np.partition(score, n - k)[n - k]) if n > k else 0
        able = np.flatnonzero(score + rest >= max(floor, kth, 1))
        if not rest:
            return able, score[able], added
        if len(able) <= k + LEFT:
            break
    wanted = np.zeros(n, bool)
    wanted[able] = True
    for j, (adds, upto, docs) in enumerate(lists):
        was = done[j]
        if was < len(adds):
            a = int(upto[was - 1]) if was else 0
            mine = np.flatnonzero(wanted[docs[a:]])
            score[docs[a:][mine]] += adds[np.searchsorted(upto, a + mine, "right")]
    return able, score[able], added


def _search(shipped, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shipped.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in queries.bags]  # (-score, no id, id), the best first
        for batch in batches:
            for i in range(len(batch)):
                seed = batch.column(0)[i].as_py()
                ids, terms, ends, groups, impacts, upto, docs = (batch.column(c)[i].values for c in range(1, 8))
                number, at = queries.places(seed, terms)
                place = dict(zip(number.tolist(), at.tolist(), strict=True))
                ends, groups, impacts, upto, docs = (x.to_numpy() for x in (ends, groups, impacts, upto, docs))
                for q, bag in enumerate(queries.bags):
                    lists = []
                    for term, times in bag:
                        p, w = place.get(term), queries.weight[term] * times
                        if p is not None and w:
                            a, g = (int(ends[p - 1]), int(groups[p - 1])) if p else (0, 0)
                            lists.append((impacts[g : groups[p]].astype(np.int64) * w, upto[g : groups[p]] - a, docs[a : ends[p]]))
                    if not lists:
                        continue
                    mine = best[q]
                    found, score, _ = best_of_shard(lists, len(ids), k, -mine[-1][0] if len(mine) == k else 0)
                    if len(found):
                        names = ids.take(pa.array(found)).to_pylist()
                        best[q] = sorted(mine + [(-s, d is None, d or 0) for s, d in zip(score.tolist(), names, strict=True)])[:k]
        rows = [(q, None if none else d, -s) for q, mine in enumerate(best) for s, none, d in mine]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return run


def _top(rows: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _parts(items: DataFrame) -> Iterator[list]:
    """The items in parts of at most PART bytes of text; a longer text is alone."""
    part, size = [], 0
    for r in items.toLocalIterator():
        n = len((r.text or "").encode())
        if part and size + n > PART:
            yield part
            part, size = [], 0
        part.append(r)
        size += n
    if part:
        yield part


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents for each row of ``items`` (item_id, text), best first.

    A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); a score sums weight times impact over the item's terms,
    repeats included. Only scores above 0 count, and equal ones are ranked by ascending doc_id, a row without an id last.
    An item without terms, or without any in the documents, has no rows; items that share an id are searched each
    by itself, and so are those without one. Items of more than PART bytes of text are searched in parts, each a pass over
    the index; one part is sent to the executors at a time.
    """
    context = items.sparkSession.sparkContext
    out = None
    kind = items.schema["item_id"].dataType
    for part in _parts(items.select("item_id", F.col("text").cast("string").alias("text"))):
        queries = Queries([r.text for r in part])
        counted = index.table.select("seed", "terms", "ends").mapInArrow(_df(context.broadcast(queries)), "term int, n long")
        df = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most a row for each term of the part
        hits = index.table.mapInArrow(_search(context.broadcast(queries.weighted(df, index.n_docs)), k), _HITS)
        hits = _top(hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "item", "salt").drop("salt")
        names = items.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], "item int, item_id " + kind.simpleString())
        top = _top(hits, k, "item").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a part has at most PART bytes
        if out is None:
            out = top
        else:
            out = written(out.unionByName(top), "found")
    return out if out is not None else items.sparkSession.createDataFrame([], "item_id " + kind.simpleString() + ", rank int, doc_id long, score long")

"""Benchmark decontamination over a positional inverted index that is sharded by document.

Index: each shard (some consecutive documents of a partition) stores, for every test term that occurs in it, the list of
the term's places, which number the words of the shard's documents one after the other. Only terms of the test texts
have postings; no query could ask for others. A word is looked up by its hash and taken by its bytes, so postings, and
all that follows from them, are exact. Corpus frequencies of the terms are summed over all shards.

Query: a window is a sequence of terms. In a shard its lists are intersected from the rarest term on: the places of the
rarest term, less its offset in the window, are candidate starts; each further list, less its own offset, keeps those
it also holds. What remains are exact phrase matches. A proximity match is a span of document words, at most ``slop``
longer than the window, that holds the window's terms in any order, each as often as the window does; around the places
of the rarest term that have all others near, the shortest such span is sought.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import ALNUM, LOWER, Vocabulary, slices
from ..sources.scratch import written

#: Most bytes of test texts that one part of the query holds, and so sends to each executor; a longer text is a part of its own.
PART = 8 << 20
#: Words of a shard, at least, as long as its Arrow batch has more.
SHARD = 1 << 17

_SPLIT = bytes(b if ALNUM[b] else 0x20 for b in range(256))
INDEX = "doc_ids array<long>, n_words array<long>, terms array<int>, ends array<int>, places array<int>"
#: A proximity match: the item, the first word of the span in the document, and its words.
NEAR = "array<struct<item:string,start:long,length:long>>"
_NEAR = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
#: A shard with what the parts so far have found: its words as bits, and for each document the ids and the nearness.
CARRIED = f"{INDEX}, bits binary, found array<array<string>>, near array<{NEAR}>"


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters."""
    return (text or "").encode().translate(bytes(LOWER)).translate(_SPLIT).split()


class Windows:
    """The distinct windows of some items as numbers of words, one after the other, and for each the numbers of the items that hold it.

    Window w is codes[at[w]:at[w + 1]], its items are items[of[w]:of[w + 1]]. An item without an id has windows too, but is
    no item in a result.
    """

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        self.ids = [None if i is None else str(i) for i, _ in items]
        words = [item_words(text) for _, text in items]
        self.terms = sorted(set(chain.from_iterable(words)))
        number = {w: i for i, w in enumerate(self.terms)}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for k, w in enumerate(words):
            if w:
                n = min(width, len(w))
                rows.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(np.array([number[x] for x in w], np.int32), n))
                owners.setdefault(n, []).append(np.full(len(w) - n + 1, k, np.int32))
        codes, sizes, held, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        named = np.array([i is not None for i in self.ids], bool)
        for n in sorted(rows):
            different, which = np.unique(np.concatenate(rows[n]), axis=0, return_inverse=True)
            owner = np.concatenate(owners[n])
            pairs = np.unique(np.stack([which.ravel(), owner], 1)[named[owner]], axis=0)
            codes.append(different.ravel())
            sizes.append(np.full(len(different), n))
            held.append(pairs[:, 1].astype(np.int32))
            counts.append(np.bincount(pairs[:, 0], minlength=len(different)))
        self.codes, self.items = np.concatenate(codes), np.concatenate(held)
        self.at = np.append(0, np.cumsum(np.concatenate(sizes)))
        self.of = np.append(0, np.cumsum(np.concatenate(counts)))

    def numbered(self, vocabulary: Vocabulary) -> Windows:
        """Makes ``codes`` places in the vocabulary, which has all words; these themselves are not needed any more."""
        if self.terms:
            self.codes = vocabulary.numbers(self.terms).astype(np.int32)[self.codes]
        self.terms = []
        return self

    def by_rarest(self, rarity: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
        """The windows of which all terms occur, in order of their rarest term, the first of equal ones; and the range of each such term."""
        if len(self.at) == 1:
            return np.empty(0, np.int64), {}
        size = np.diff(self.at)
        place = np.arange(len(self.codes)) - np.repeat(self.at[:-1], size)
        least = np.minimum.reduceat(rarity[self.codes] << 20 | np.minimum(place, (1 << 20) - 1), self.at[:-1])
        able = np.flatnonzero(least >> 20)
        rarest = self.codes[self.at[:-1][able] + (least[able] & (1 << 20) - 1)]
        by = np.argsort(rarest, kind="stable")
        term, first = np.unique(rarest[by], return_index=True)
        last = np.append(first, len(by))[1:]
        return able[by], {t: (a, b) for t, a, b in zip(term.tolist(), first.tolist(), last.tolist(), strict=True)}


def _index(shipped):
    """Postings of the words of a vocabulary, in shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shipped.value
        for batch in batches:
            ids, words, hits, where, base = [], [], [], [], 0

            def shard() -> pa.RecordBatch:
                code, place = np.concatenate(hits), np.concatenate(where)
                by = np.argsort(code, kind="stable")
                code, place = code[by], place[by]
                first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
                ends = np.append(first[1:], len(code)) if len(code) else first
                doc = pa.concat_arrays([x.cast(pa.int64()) for x in ids])
                row = [doc, np.concatenate(words), code[first].astype(np.int32), ends.astype(np.int32), place.astype(np.int32)]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t)) for x, t in zip(row, types, strict=True)]
                return pa.record_batch(lists, ["doc_ids", "n_words", "terms", "ends", "places"])

            for t in slices(batch.column(1)):
                starts, ends = t.words(ALNUM)
                lo, hi = t.bounds(starts)
                ids.append(batch.column(0).slice(t.first, len(t)))
                words.append(hi - lo)
                found, at = vocabulary.find(t, starts, ends)
                hits.append(at)
                where.append(found + base)
                base += len(starts)
                if base >= SHARD:
                    yield shard()
                    ids, words, hits, where, base = [], [], [], [], 0
            if ids:
                yield shard()

    return run


def build_index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text) for the words of a vocabulary, one row a shard, written in the shared folder."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the different words of the test texts
    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_index(shipped), INDEX), "index")


def frequencies(index: DataFrame) -> DataFrame:
    """(term, n): how often each indexed term occurs in all documents."""
    size = F.expr("transform(ends, (e, i) -> struct(terms[i] as term, e - if(i = 0, 0, ends[i - 1]) as k))")
    return index.select(F.explode(size).alias("x")).groupBy("x.term").agg(F.sum("x.k").alias("n"))


def _starts(lists: dict[int, np.ndarray], codes: list[int], order: list[int], doc: np.ndarray) -> np.ndarray:
    """Starts of exact matches of a window, intersecting its offset-adjusted lists in this order."""
    at = None
    for k in order:
        places = lists.get(codes[k])
        if places is None:
            return np.empty(0, np.int64)
        if at is None:
            at = places - k
        elif len(places) < 8 * len(at):
            at = np.intersect1d(at, places - k, assume_unique=True)
        else:
            i = places.searchsorted(at + k)
            at = at[(i < len(places)) & (places[np.minimum(i, len(places) - 1)] == at + k)]
        if not len(at):
            return at
    at = at[at >= 0]
    last = np.minimum(at + len(codes) - 1, len(doc) - 1)
    return at[(doc[at] == doc[last]) & (at + len(codes) <= len(doc))]


def _close(lists: dict[int, np.ndarray], need: list[tuple[int, int]], doc: np.ndarray, reach: int) -> np.ndarray:
    """Places of the first (rarest) term that have every other one in less than ``reach`` words of their document."""
    at = lists.get(need[0][0])
    if at is None:
        return np.empty(0, np.int64)
    for term, _ in need[1:]:
        places = lists.get(term)
        if places is None:
            return np.empty(0, np.int64)
        i = places.searchsorted(at)
        above, below = places[np.minimum(i, len(places) - 1)], places[np.maximum(i - 1, 0)]
        mine = doc[at]
        at = at[((np.abs(above - at) < reach) & (doc[above] == mine)) | ((at - below < reach) & (below <= at) & (doc[below] == mine))]
        if not len(at):
            return at
    return at


def _spans(close: np.ndarray, lists: dict[int, np.ndarray], need: list[tuple[int, int]], doc: np.ndarray, reach: int) -> Iterator[tuple[int, int]]:
    """(start, length) of spans of at most ``reach`` words of one document, around places that are ``close``, that hold each
    term as often as needed: for each end the latest start."""
    for p in close.tolist():
        around = []
        for term, _ in need:
            places = lists[term]
            lo, hi = places.searchsorted([p - reach + 1, p + reach])
            around += [(x, term) for x in places[lo:hi].tolist() if doc[x] == doc[p]]
        around.sort()
        left, have, lacking = 0, dict.fromkeys((t for t, _ in need), 0), len(need)
        want = dict(need)
        for x, term in around:
            have[term] += 1
            lacking -= have[term] == want[term]
            while not lacking and have[around[left][1]] > want[around[left][1]]:
                have[around[left][1]] -= 1
                left += 1
            if not lacking and x - around[left][0] < reach:
                yield around[left][0], x - around[left][0] + 1


def _match(shipped, last: bool = True):
    """Adds the hits of the shipped (windows, frequencies, slop) to what a shard carries; the last part gives a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, rarity, slop = shipped.value
        order, ranges = windows.by_rarest(rarity)
        rare = rarity.item
        for batch in batches:
            for row in range(len(batch)):
                ids, n, terms, ends, places = (batch.column(c)[row].values for c in range(5))
                n, terms, ends, places = n.to_numpy(), terms.to_numpy().tolist(), ends.to_numpy(), places.to_numpy().astype(np.int64)
                lists = {t: places[a:b] for t, a, b in zip(terms, np.append(0, ends[:-1]).tolist() if len(ends) else [], ends.tolist(), strict=True)}
                doc = np.repeat(np.arange(len(n)), n)
                first = np.cumsum(n) - n
                hit = np.zeros(len(doc) + 1, np.int32)
                near: dict[int, dict[str, tuple[int, int]]] = {}
                items: dict[int, set[int]] = {}
                for t in terms:
                    for w in order[slice(*ranges.get(t, (0, 0)))].tolist():
                        # what is needed of a window is made when a shard has all its terms: kept for all, it would be large
                        codes = windows.codes[windows.at[w] : windows.at[w + 1]].tolist()
                        if not lists.keys() >= set(codes):
                            continue
                        need = sorted(Counter(codes).items(), key=lambda x: (rare(x[0]), x[0]))
                        reach = len(codes) + (slop or 0)
                        close = _close(lists, need, doc, reach) if slop is not None else None
                        if close is not None and not len(close):
                            continue  # what is not even near is no phrase
                        at = _starts(lists, codes, sorted(range(len(codes)), key=lambda k, c=codes: (rare(c[k]), k)), doc)
                        mine = windows.items[windows.of[w] : windows.of[w + 1]].tolist()
                        if len(at):
                            np.add.at(hit, at, 1)
                            np.add.at(hit, at + len(codes), -1)
                            for d in np.unique(doc[at]).tolist():
                                items.setdefault(d, set()).update(mine)
                        if close is not None and mine:
                            for start, length in _spans(close, lists, need, doc, reach):
                                d = int(doc[start])
                                for k in mine:
                                    _shorter(near.setdefault(d, {}), windows.ids[k], length, start - int(first[d]))
                inside = np.cumsum(hit[:-1]) > 0
                found = [sorted(windows.ids[k] for k in items[d]) if d in items else [] for d in range(len(n))]
                if batch.num_columns > 5:
                    bits, before, was = (batch.column(c)[row].as_py() for c in (5, 6, 7))
                    inside |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(doc)).astype(bool)
                    found = [sorted(a + b) if b else a for a, b in zip(before, found, strict=True)]
                    for d, old in enumerate(was):
                        for x in old:
                            _shorter(near.setdefault(d, {}), x["item"], x["length"], x["start"])
                spans = [[{"item": k, "start": s, "length": m} for k, (m, s) in sorted(near.get(d, {}).items())] for d in range(len(n))]
                if not last:
                    carried = [pa.array([np.packbits(inside).tobytes()]), pa.array([found], pa.list_(pa.list_(pa.string()))), pa.array([spans], pa.list_(_NEAR))]
                    yield pa.record_batch([*(batch.column(c).slice(row, 1) for c in range(5)), *carried], ["doc_ids", "n_words", "terms", "ends", "places", "bits", "found", "near"])
                    continue
                n_hit = np.bincount(doc, weights=inside, minlength=len(n)).astype(np.int64)
                yield pa.record_batch([ids, pa.array(n), pa.array(n_hit), pa.array(found, pa.list_(pa.string())), pa.array(spans, _NEAR)], ["doc_id", "n_words", "n_hit", "items", "near"])

    return run


def _shorter(of: dict[str, tuple[int, int]], item: str, length: int, start: int) -> None:
    if item not in of or (length, start) < of[item]:
        of[item] = length, start


def _parts(items: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in parts of at most PART bytes of text; a longer text is alone."""
    part, size = [], 0
    for r in items.toLocalIterator():
        n = len((r.text or "").encode())
        if part and size + n > PART:
            yield part
            part, size = [], 0
        part.append((r.item_id, r.text))
        size += n
    yield part


def find(docs: DataFrame, items: DataFrame, *, width: int = 10, slop: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near) for each row of ``docs`` (doc_id, text), against ``items`` (item_id, text).

    n_hit counts the words inside any occurrence of a window of ``width`` consecutive item words (a shorter item is one
    window); items are the ids, sorted as strings, of the items with an occurring window. near, empty without ``slop``,
    has for each item the shortest span, of equal ones the first, that holds all words of one of its windows in any order
    and is at most ``slop`` words longer than the window; start counts the document's words from 0.

    A null or empty text has no words: no hits, and as an item no windows. Items that share an id count once; one without
    an id has hits, but is in no list. Rows are kept as they are, so repeated rows, or rows without an id, are in the
    result as often. Very long texts are read whole.

    Test texts of more than PART bytes are taken in parts: the index holds the words of all, each part is one pass over
    it that adds its hits to what the shards carry, and documents are counted after the last. The different words of all
    test texts are held by the driver and sent to the executors, with their frequencies.
    """
    context = docs.sparkSession.sparkContext
    items = items.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    out = f"doc_id long, n_words long, n_hit long, items array<string>, near {NEAR}"
    if size <= PART:
        windows = Windows([(r.item_id, r.text) for r in items.collect()], width)
        vocabulary = Vocabulary(windows.terms)
        index = build_index(docs, vocabulary)
        rarity = _rarity(index, vocabulary)
        return index.mapInArrow(_match(context.broadcast((windows.numbered(vocabulary), rarity, slop))), out)
    items = written(items, "items")
    words: set[bytes] = set()
    for part in _parts(items):
        words.update(x for _, text in part for x in item_words(text))
    vocabulary = Vocabulary(list(words))
    shards = build_index(docs, vocabulary)
    rarity = _rarity(shards, vocabulary)
    for part in _parts(items):
        windows = Windows(part, width).numbered(vocabulary)
        shards = written(shards.mapInArrow(_match(context.broadcast((windows, rarity, slop)), last=False), CARRIED), "part")
    return shards.mapInArrow(_match(context.broadcast((Windows([], width), rarity, None))), out)


def _rarity(index: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each word of the vocabulary occurs, 0 for those that do not."""
    out = np.zeros(len(vocabulary.codes), np.int64)
    for r in frequencies(index).collect():  # at most a row for each test term
        out[r.term] = r.n
    return out


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 2) -> DataFrame:
    """The digest columns of find(): n_items, the sha256 of the comma-joined item ids, contaminated, and the proximity
    matches as comma-joined item:start:length."""
    ids = F.array_distinct("items")
    spans = F.array_join(F.transform("near", lambda x: F.concat_ws(":", x["item"], x["start"], x["length"])), ",")
    return find(docs, items, width=width, slop=slop).select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"), spans.alias("near"),
    )

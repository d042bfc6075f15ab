"""Byte-pair encoding and decoding with a contiguous rank array.

A word is held as two short arrays: its parts (token ids, each ending at a boundary) and the rank of each pair of
neighbours. The least rank is found by a scan, its right part is deleted and the ranks of the two new neighbours are
looked up again, until no pair has a rank. Words that a worker has not met are merged together: their arrays are the columns
of matrices, with links to the next parts that are left, and each round deletes one boundary in every column that still has a
rank. Only words of more than LONG parts go through a heap, which gives the same merges in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts beyond which a word is merged with a heap.
LONG = 192
#: Words whose result a worker remembers, and the characters of the longest of them: longer ones are merged each time they come.
REMEMBERED, KEPT = 400_000, 64
#: The same of an encoder, whose results are ids.
ENCODED = 100_000
#: Characters of text that are worked on together.
TOGETHER = 512 << 10

_NONE = 1 << 62
_ID = (1 << 20) - 1
#: In matrices a rank stands with its place in the low bits, so the least of a column tells both; no rank, no key; words of a matrix.
_PLACES = 6
_LAST = np.int32((1 << 31) - 1)
_FREE = -1 << 62
_BLOCK = 8192

#: Characters outside those that the quick patterns know: ASCII and the letters from U+00C0 to U+024F.
ODD = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]").search
QUICK = r"a-zA-ZÀ-ÖØ-öø-ɏ"

# Fixed values of the tokenizer format: Unicode white space, and the printable stand-ins of the 256 bytes.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Model:
    """Vocabulary and ranked merges of a tokenizers file of type BPE over bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spec, self.key = spec, uuid.uuid4().hex
        vocab, self.suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        del spec["model"]  # each worker holds what is left

    def merge(self, word: bytes) -> list[int]:
        """The token ids of one pre-token."""
        if not word:
            return []
        first = self.first
        parts = [first[b] for b in word[:-1]]
        parts.append(self.last[word[-1]])
        if len(parts) > LONG:
            return self._merge_long(parts)
        look = self.pairs.get
        ranks = [look(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = new = least & _ID
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look(parts[i - 1] << 20 | new, _NONE)
            if i < len(ranks):
                ranks[i] = look(new << 20 | parts[i + 1], _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        look, n = self.pairs.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := look(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or look(parts[i] << 20 | parts[j]) != rank:
                continue
            parts[i], parts[j] = rank & _ID, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := look(parts[i] << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := look(parts[h] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of many words, one after the other, and the number of each word's ids."""
        if not hasattr(self, "_held"):
            self._tabulate()
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 48)):
            some = np.flatnonzero((size > lo) & (size <= hi))
            for k in range(0, len(some), _BLOCK):
                which = some[k : k + _BLOCK]
                kept += self._merge_columns(which, raw, start[which], size[which], hi)
        for i in np.flatnonzero(size > 48).tolist():
            ids = np.array(self.merge(words[i]), np.int32)
            kept.append((np.array([i]), np.array([len(ids)]), ids))
        count = np.zeros(len(words), np.int64)
        for which, n, _ in kept:
            count[which] = n
        start = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for which, n, ids in kept:
            flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, count

    def _tabulate(self) -> None:
        """The pairs in a hash table with open addressing, and the ranks of all pairs of bytes, within a word and at its end."""
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        values = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        rank = values >> 20
        self._new = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self._new[rank] = values & _ID
        bits = (4 * len(keys) + 15).bit_length()
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._held, self._rank = np.full(1 << bits, _FREE), np.full(1 << bits, _LAST)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            first = np.zeros(len(left), bool)
            first[np.unique(slot[left], return_index=True)[1]] = True
            first &= self._held[slot[left]] == _FREE
            put = left[first]
            self._held[slot[put]], self._rank[slot[put]] = keys[put], rank[put] << _PLACES
            left = left[~first]
            slot[left] = slot[left] + 1 & self._mask
        self._first, self._last = np.array(self.first, np.int32), np.array(self.last, np.int32)
        self._inner = self._ranks(np.repeat(self._first, 256), np.tile(self._first, 256))
        self._outer = self._ranks(np.repeat(self._first, 256), np.tile(self._last, 256))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).view(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs, above their places; parts of -1 make none."""
        key = a.astype(np.int64) << 20 | b
        slot = self._slot(key)
        out, held = self._rank[slot], self._held[slot]
        other = np.flatnonzero(held != key)
        out[other] = _LAST
        other = other[held[other] != _FREE]
        while len(other):
            slot[other] = at = slot[other] + 1 & self._mask
            held = self._held[at]
            same = held == key[other]
            out[other[same]] = self._rank[at[same]]
            other = other[~same & (held != _FREE)]
        return out

    def _merge_columns(self, which: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merges words of at most ``width`` bytes; (words, number of ids of each, their ids) as they are done.

        A part stands in the row of its first byte, from 1 on, with the rank of it and the next part; the outer rows stay empty.
        """
        n = len(which)
        at = np.arange(width)[:, None]
        bytes_ = raw[np.minimum(start + at, len(raw) - 1)]
        parts, ranks = np.full((width + 2, n), -1, np.int32), np.full((width + 2, n), _LAST)
        parts[1:-1] = np.where(at < size, self._first[bytes_], -1)
        parts[size, np.arange(n)] = self._last[bytes_[size - 1, np.arange(n)]]
        two = bytes_[:-1].astype(np.int32) << 8 | bytes_[1:]
        ranks[1:width] = np.where(at[:-1] < size - 2, self._inner[two], _LAST)
        some = np.flatnonzero(size > 1)
        ranks[size[some] - 1, some] = self._outer[two[size[some] - 2, some]]
        place = np.arange(width + 2, dtype=np.int8)[:, None]
        ranks |= place
        after, before = np.repeat(place + np.int8(1), n, 1), np.repeat(place - np.int8(1), n, 1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            least = ranks[1:-1].min(0)
            go = np.flatnonzero(least != _LAST)
            if len(go) < 0.6 * n or not n:  # what is done leaves the matrices, not in every round
                done = np.flatnonzero(least == _LAST)
                left = parts[1:-1, done].T
                out.append((which[done], (left >= 0).sum(1), left[left >= 0]))
                if not len(go):
                    return out
                which, least, n = which[go], least[go], len(go)
                parts, ranks, after, before = (x.take(go, 1) for x in (parts, ranks, after, before))
                go = np.arange(n)
            else:
                least = least[go]
            part, rank, following, preceding = (x.reshape(-1) for x in (parts, ranks, after, before))  # no copies
            here, new = least & (1 << _PLACES) - 1, self._new[least >> _PLACES]
            i = here.astype(np.int64) * n + go
            j = following[i].astype(np.int64) * n + go
            next_ = following[j]
            k = next_.astype(np.int64) * n + go
            last = preceding[i]
            h = last.astype(np.int64) * n + go
            part[i], part[j], rank[j] = new, -1, _LAST
            following[i], preceding[k] = next_, here
            both = self._ranks(np.concatenate([part[h], new]), np.concatenate([new, part[k]]))
            rank[h], rank[i] = both[: len(go)] | last, both[len(go) :] | here

    def splitter(self) -> regex.Pattern | None:
        """Finds the special strings in a text; the longest at a place wins, as they are matched as they stand."""
        words = sorted(self.special, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, words)) + ")") if words else None


def together(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column (null: empty) in lists of about TOGETHER characters."""
    some, size = [], 0
    for x in column:
        text = x.as_py() or ""
        some.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


class Encoder:
    """Encodes whole texts as a file of the lower-casing kind with word ends asks: NFC, blanks, lower case, words."""

    def __init__(self, model: Model):
        self.model, self.special = model, model.splitter()
        pattern = model.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern.replace(r"\s", SPACE)).findall
        self.quick = re.compile(rf"[{QUICK}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s0-9{QUICK}]+").findall
        self.ids: dict[str, bytes] = {}
        self.passing: list[str] = []
        # a special string is kept as it stands, which no word can be, as words hold no letters next to signs
        self.marks = {s: i.to_bytes(4, "little") for s, i in model.special.items()}

    def words(self, text: str) -> list[str]:
        special = self.special
        if special is not None and "<|" in text and special.search(text):
            return list(chain.from_iterable([part] if part in self.marks else self.plain(part) for part in special.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character by itself: no final form
        text = text.lower()
        return self.find(text) if ODD(text) else self.quick(text)

    def learn(self, words: Iterable[str]) -> None:
        """Merges the words that are not known yet; those of more than KEPT characters are known until the next call."""
        words = set(words)
        for w in self.passing:
            self.ids.pop(w, None)
        fresh = list(words.difference(self.ids))
        if len(self.ids) + len(fresh) > ENCODED:
            self.ids.clear()
            fresh = list(words)
        flat, count = self.model.merge_many([w.encode() for w in fresh])
        end = np.cumsum(count)
        first, last = (end - count).tolist(), end.tolist()
        raw = flat.astype("<u4").tobytes()
        self.ids.update(zip(fresh, [raw[4 * i : 4 * j] for i, j in zip(first, last, strict=True)], strict=True))
        self.ids.update(self.marks)
        self.passing = [w for w in fresh if len(w) > KEPT]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """For each text the ids as little-endian 32-bit integers."""
        cut = [self.words(t) for t in texts]
        self.learn(chain.from_iterable(cut))
        ids = self.ids.__getitem__
        for words in cut:
            yield b"".join(map(ids, words))


_LIVE: dict[str, Any] = {}


def live(kind: str, make, shipped) -> Any:
    """One object a worker process for what was shipped, so words stay known from task to task."""
    key = f"{kind}-{shipped.value.key}"
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = make(shipped.value)
    return _LIVE[key]


def _encode_rows(shipped, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = live("encoder", Encoder, shipped)
        sha = hashlib.sha256
        for batch in batches:
            ids, n, first, second, whole, decoded = batch.column(0), [], [], [], [], []
            for a in chain.from_iterable(map(coder.encode_all, together(batch.column(1)))):
                b = decode(a, coder.model)
                n.append(len(a) // 4)
                if texts:
                    whole.append(a)
                    decoded.append(b)
                else:
                    first.append(sha(a).hexdigest())
                    second.append(sha(b.encode()).hexdigest())
            out = [ids, pa.array(n, pa.int64())]
            out += [pa.array(whole, pa.binary()), pa.array(decoded, pa.string())] if texts else [pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.record_batch(out, ["doc_id", "n_tokens", "x", "y"])

    return run


def encode(docs: DataFrame, path: str, *, texts: bool = True) -> DataFrame:
    """Encodes and decodes every text of ``docs`` (doc_id, text) with the tokenizer file at ``path``, read by the driver.

    With texts: (doc_id, n_tokens, ids binary: little-endian unsigned 32-bit, decoded string); else the digests
    ids_sha256 and decoded_sha256 of these, made without keeping them. A null text is empty: no ids, decoded to ''.
    The special strings of the file become their ids wherever they stand. Of pairs of the same rank in a word the first is
    merged first. Texts are read whole however long. Rows are kept as they are, repeated or not; an empty table gives none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Model(path))  # bounded by the vocabulary file
    kinds = "ids binary, decoded string" if texts else "ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", *[k.split()[0] for k in kinds.split(", ")]]
    run = _encode_rows(shipped, texts)

    def named(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(named, f"doc_id long, n_tokens long, {kinds}")


def decode(ids: bytes, model: Model) -> str:
    """The text of packed ids: their tokens joined by blanks, special ones included, as the file has no decoder."""
    return " ".join(map(model.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

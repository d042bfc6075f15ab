"""Vectorised work on the UTF-8 bytes of an Arrow string column: words, their hashes, and slices of bounded size.

A word is hashed eight bytes at a time, each taken in by a mixing step that starts from the seed and the length; the few
longer than LONG get a keyed BLAKE2b. Unlike a polynomial, no kind of word collides by its form, whatever the seed. Where
a result must not rest on hashes at all, ``Texts.same_words`` and ``Vocabulary.find`` compare the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text makes a slice of its own.
SLICE = 1 << 20

#: Pairs of words that are compared at once.
PAIRS = 1 << 15

#: Bytes of a word that are hashed in steps of eight; longer words are hashed one by one.
LONG = 64

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
#: Masks of the first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ragged(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of each element, and its index within the group."""
    group = np.repeat(np.arange(len(size)), size)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)


def table(members: bytes | list[int], invert: bool = False) -> np.ndarray:
    """A look-up table of 256 booleans."""
    t = np.zeros(256, bool)
    t[list(members)] = True
    return ~t if invert else t


#: Word bytes of the two tokenisations: all but blanks; and letters, digits and every byte of a non-ASCII character.
NOT_BLANK = table([0x20, *range(0x09, 0x0E)], invert=True)
ALNUM = table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Texts:
    """Some texts of one slice: ``data`` holds their bytes, text i is data[lo[i]:hi[i]]."""

    def __init__(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: int):
        self.data, self.lo, self.hi, self.first = data, lo, hi, first

    def __len__(self) -> int:
        return len(self.lo)

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that ``inside`` marks; no run crosses texts."""
        ok = inside[self.data]
        if not len(ok):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        before = np.empty_like(ok)
        before[0], before[1:] = False, ok[:-1]
        cut = self.lo[self.lo < len(ok)]
        before[cut] = False
        after = np.empty_like(ok)
        after[-1], after[:-1] = False, ok[1:]
        after[cut[cut > 0] - 1] = False
        return np.flatnonzero(ok & ~before), np.flatnonzero(ok & ~after) + 1

    def bounds(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the first and the past-the-last index of its words."""
        return np.searchsorted(starts, self.lo), np.searchsorted(starts, self.hi)

    def eights(self, fold: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with A-Z as a-z unless fold is None, and the eight from each place on as a number."""
        data = np.append(self.data if fold is None else fold[self.data], np.zeros(8, np.uint8))
        return data, np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z as a-z unless fold is None."""
        data, eight = self.eights(fold)
        size = ends - starts
        h = mix(size.astype(U) * _STEP ^ U(seed))
        short = size <= LONG
        live = np.flatnonzero(short & (size > 0))
        for at in range(0, LONG, 8):
            if not len(live):
                break
            chunk = eight[starts[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]
            h[live] = mix((h[live] ^ chunk) + _STEP)
            live = live[size[live] > at + 8]
        key = int(seed).to_bytes(8, "little")
        for i in np.flatnonzero(~short).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
        return h

    def same_words(self, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, by: np.ndarray | None = None) -> bool:
        """Whether all words with the same hash are the same, A-Z being a-z; ``by`` is the order of the hashes, if it is known."""
        by = np.argsort(h, kind="stable") if by is None else by
        a, b = by[:-1], by[1:]
        twin = h[a] == h[b]
        a, b = a[twin], b[twin]
        size = ends[a] - starts[a]
        if (size != ends[b] - starts[b]).any():
            return False
        for k in range(0, len(a), PAIRS):  # some at a time: each byte takes several numbers
            first, second = starts[a[k : k + PAIRS]], starts[b[k : k + PAIRS]]
            pair, i = ragged(size[k : k + PAIRS])
            if (LOWER[self.data[first[pair] + i]] != LOWER[self.data[second[pair] + i]]).any():
                return False
        return True


def hash_words(words: list[bytes] | pa.StringArray, seed: int = 0) -> np.ndarray:
    """The hashes that Texts.hashes gives for these words, as they are."""
    if not len(words):
        return np.empty(0, U)
    if isinstance(words, pa.StringArray):
        _, at, raw = words.buffers()
        hi = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        return Texts(np.frombuffer(raw, np.uint8), hi[:-1], hi[1:], 0).hashes(hi[:-1], hi[1:], None, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    hi = np.cumsum(size)
    t = Texts(np.frombuffer(b"".join(words), np.uint8), hi - size, hi, 0)
    return t.hashes(hi - size, hi, None, seed)


class Vocabulary:
    """Different lower-cased words by their hashes, under the first seed that gives each its own."""

    def __init__(self, words: list[bytes]):
        words, self.seed = sorted(set(words)), 0
        while True:
            h = hash_words(words, self.seed)
            if len(np.unique(h)) == len(words):
                break
            self.seed += 1
        by = np.argsort(h)
        words = [words[i] for i in by.tolist()]
        self.codes = h[by]
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.head = np.frombuffer(b"".join(w[:8].ljust(8, b"\0") for w in words), "<u8")
        # the first code with these highest bits; few have the same
        self.bits = max(8, (8 * len(words)).bit_length())
        top = self.codes >> U(64 - self.bits)
        self.slot = np.searchsorted(top, np.arange(1 << self.bits, dtype=U)).astype(np.int32)
        self.deep = int(np.bincount(top.astype(np.int64)).max()) if len(words) else 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The places of words that are in the vocabulary."""
        return np.searchsorted(self.codes, hash_words(words, self.seed))

    def find(self, t: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, word): which of the words of ``t`` are in the vocabulary, and where; bytes decide, hashes only look up."""
        if not len(self.codes) or not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = t.hashes(starts, ends, seed=self.seed)
        at = np.minimum(self.slot[(h >> U(64 - self.bits)).astype(np.int64)], len(self.codes) - 1)
        for _ in range(self.deep - 1):
            at += (self.codes[at] != h) & (at < len(self.codes) - 1)
        place = np.flatnonzero(self.codes[at] == h)
        word, size = at[place].astype(np.int64), (ends - starts)[place]
        good = self.size[word] == size
        _, eight = t.eights()
        good &= eight[starts[place]] & _FIRST[np.minimum(size, 8)] == self.head[word]
        long = np.flatnonzero(good & (size > 8))
        item, i = ragged(size[long])
        wrong = LOWER[t.data[starts[place[long]][item] + i]] != self.data[self.first[word[long]][item] + i]
        if wrong.any():
            good[long[np.unique(item[wrong])]] = False
        return (place, word) if good.all() else (place[good], word[good])


def slices(column: pa.Array, most: int = SLICE, texts: int = 1 << 62) -> Iterator[Texts]:
    """The texts of a string column in slices of about ``most`` bytes, and of at most ``texts``; a null is an empty text."""
    n = len(column)
    if not n:
        return
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    lo, hi = offsets[:-1], offsets[1:]
    if column.null_count:
        hi = np.where(column.is_valid().to_numpy(zero_copy_only=False), hi, lo)
    i = 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1), i + texts)
        yield Texts(data[offsets[i] : offsets[j]], lo[i:j] - offsets[i], hi[i:j] - offsets[i], i)
        i = j

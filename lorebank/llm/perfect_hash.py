"""Minimal perfect hash functions of 64-bit keys, with fingerprints: levels of bits, as in BBHash (Limasset et al., 2017).

On each level the keys that are left fall into about ROOM bits each; a bit that one key alone falls on is set and is that
key's, the others go on to the next level. The set bits in front of a key's bit, over all levels, number it: n keys get the
numbers from 0 to n - 1. A lookup tests few bits and adds up one count, whatever n is.
"""

from __future__ import annotations

import numpy as np

from .bytes_np import U, mix

#: Bits of a level for each key that is left.
ROOM = 1.5

_STEP = U(0x9E3779B97F4A7C15)


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys ^ U((level + 1) * int(_STEP) & (1 << 64) - 1)) % U(size)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits of each key, independent of its places."""
    return (mix(keys + _STEP) >> U(32)).astype(np.uint32)


class PerfectHash:
    """The function as the sizes of its levels in bits, all their bits in words of 64, and the set bits before each word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.base = np.append(0, np.cumsum(sizes))
        self.before = np.cumsum(np.bitwise_count(words).astype(np.int64)) - np.bitwise_count(words)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """For different keys (uint64); equal ones would never be told apart and are refused."""
        if len(np.unique(keys)) != len(keys):
            raise ValueError("a perfect hash function takes different keys only")
        sizes, levels, left = [], [], keys
        while len(left):
            size = max(64, -(-int(len(left) * ROOM) // 64) * 64)
            at = _spot(left, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.empty(0, "<u8"))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that is none of them some number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self.base[level] + _spot(keys[left], level, size).astype(np.int64)
            word, bit = self.words[at >> 6], U(1) << (at & 63).astype(U)
            mine = (word & bit) != 0
            out[left[mine]] = self.before[at[mine] >> 6] + np.bitwise_count(word[mine] & (bit[mine] - U(1)))
            left = left[~mine]
        return out

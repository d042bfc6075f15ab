"""Exact Jaccard self-join of word-shingle sets by universe partitioning, and the components of its links.

A set of n shingles belongs to a size band. The band cuts the universe of shingle hashes into m segments, so two sets
that differ in at most H elements agree in some of any H + 1 segments, or differ by one element in a segment that
counts twice (the pigeonhole). Each set indexes its segment subsets; a probing set (the larger of a pair) chooses which
segments it compares, at cost: the emptiest segments, which unrelated sets share by chance, are left out, and in the
bands of small sets a segment may instead be compared within its one-deletion neighbourhood.

Equal sets are one node from the start. Sets that meet in a bucket with few probes become candidate pairs, each with a
probe, however long the bucket is; a bucket without a probe gives nothing. Sets that meet in a bucket of many probes
become a hot group, which is cut into blocks; each block of probes is compared with each block of sets inside one task,
and only a spanning forest of the links leaves the task. So the rows stay linear in the number of copies, and no link
between different sets is lost. A signature that a sample of the texts shows to be in a large share of all sets is not
brought together by its hash: its rows pass as members of a hot group. A cheap lower bound of the distance (differences
of counts in hash ranges) drops most pairs before their texts are fetched.

What is left is decided on the words: hashes, under a seed drawn for each run, are checked to tell the words and the
shingles of the texts at hand apart, and where they do not, the sets of words themselves are compared.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_np import LOWER, NOT_BLANK, SLICE, U, Texts, mix, ragged, slices
from .components import components
from ..sources.scratch import written

#: Sets up to this size also use one-deletion neighbourhoods.
SMALL = 40
#: Ratio of the ends of a size band.
BAND = 1.4
#: Segments above the least number, so that a probe can leave out the emptiest ones.
SPARE = 1.15
#: A bucket of more probes than this is a hot group.
PROBES = 8
#: Rows of one bucket that are held at once; the rest of a longer one, whose probes come first, streams past these.
HELD = 4096
#: One in so many texts is read beforehand. A signature with LEAST of its rows, and at least the SHARE of them, is wide.
SAMPLED, LEAST, SHARE = 64, 64, 10_000
#: Sets in a block of a hot group, and members from which a group is first compared with a block of pivots.
BLOCK = 1024
PIVOTED = 4096
#: Shingles in a block, about: sets of long texts make smaller blocks.
ITEMS = 1 << 20
#: Digests that may be shared by different sets: about 500 are at 10**11 sets. Each is sent to all tasks.
SHARED = 1_000_000
#: Texts already seen in a task, by their sets, whose signatures are not sent again.
SEEN = 200_000

_K = [U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)]


class Bands:
    """Size bands for a threshold of ``percent`` per cent, with the number of sets in each (``load``), if known."""

    def __init__(self, percent: int, longest: int, load: dict[int, int] | None = None):
        self.percent, lo, ends = percent, 1, []
        while not ends or ends[-1] < longest:
            ends.append(max(lo, int(lo * BAND)))
            lo = ends[-1] + 1
        self.hi = np.array(ends, np.int64)
        top = self.hi * 100 // percent  # the largest set that can be linked with one of the band
        most = self.reach(top + self.hi)
        self.small = self.hi <= SMALL
        self.m = np.where(self.small, np.maximum(1, -(-2 * (most + 1) // 3)), np.ceil(SPARE * (most + 1)).astype(np.int64) + 1)
        self.load = np.array([(load or {}).get(b, 1000) for b in range(len(ends))], np.float64)

    def differ(self, total: np.ndarray) -> np.ndarray:
        """The most elements in which two linked sets of exactly so many elements together differ."""
        need = -(-self.percent * total // (100 + self.percent))
        return total - 2 * need

    def reach(self, total: np.ndarray) -> np.ndarray:
        """The same for at most so many elements: unlike differ() it never falls as the total grows."""
        return (100 - self.percent) * total // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hi, n)


class Shingles:
    """The shingles of some texts before repeats are dropped: hash x[i] of the words that start at word at[i] of text doc[i]."""

    def __init__(self, t: Texts, width: int, seed: int):
        self.t, self.width = t, width
        self.starts, self.ends = t.words(NOT_BLANK)
        self.words = t.hashes(self.starts, self.ends, seed=seed)
        lo, hi = t.bounds(self.starts)
        self.k = hi - lo
        self.many = np.maximum(self.k - width + 1, np.minimum(self.k, 1))
        self.doc, i = ragged(self.many)
        self.at = lo[self.doc] + i
        x = np.zeros(len(self.at), U)
        for j, word, ok in self._words():
            x += np.where(ok, word * _K[j % len(_K)] * U(2 * (j // len(_K)) + 1), U(0x9FB21C651E98DF25 * (2 * j + 1) % (1 << 64)))
        self.x = mix(x)

    def _words(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The j-th word of every shingle, and whether it has one."""
        padded = np.append(self.words, np.zeros(self.width, U))
        for j in range(self.width):
            yield j, padded[self.at + j], self.k[self.doc] > j

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct shingle hashes of each text, one after the other, and their numbers."""
        parts, sizes, p = [], np.zeros(len(self.t), np.int64), 0
        for d, m in enumerate(self.many.tolist()):
            if m:
                s = np.sort(self.x[p : p + m])
                p += m
                s = s[np.append(True, s[1:] != s[:-1])]
                parts.append(s)
                sizes[d] = len(s)
        return (np.concatenate(parts) if parts else np.empty(0, U)), sizes

    def told_apart(self) -> bool:
        """Whether shingles of these texts with the same hash are the same words."""
        if not self.t.same_words(self.starts, self.ends, self.words):
            return False
        by = np.argsort(self.x, kind="stable")
        a, b = by[:-1], by[1:]
        twin = self.x[a] == self.x[b]
        a, b = a[twin], b[twin]
        return all(bool((ok[a] == ok[b]).all() and (word[a] == word[b])[ok[a]].all()) for _, word, ok in self._words())

    def plain(self) -> list[frozenset]:
        """The sets as words."""
        out = []
        for lo, hi in zip(self.t.lo, self.t.hi, strict=True):
            w = bytes(LOWER[self.t.data[lo:hi]]).split()  # at the same blanks as NOT_BLANK
            whole = [tuple(w)] if w and len(w) < self.width else [tuple(w[i : i + self.width]) for i in range(len(w) - self.width + 1)]
            out.append(frozenset(whole))
        return out


def shingles(t: Texts, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and their numbers."""
    return Shingles(t, width, seed).sets()


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 over consecutive groups of these sizes."""
    total = np.append(U(0), np.cumsum(values, dtype=U))
    end = np.cumsum(size)
    return total[end] - total[end - size]


class Names:
    """Digests of sets: the node (above 0 and odd; 0 for the empty set), and a check of 64 other bits.

    Nodes of ``bits`` bits suffice until different sets share one. Those few (``shared``, known once all sets were seen)
    are named anew by node and check together.
    """

    def __init__(self, bits: int = 63, seed: int = 0):
        self.bits, self.seed, self.shared = bits, seed, np.empty(0, np.int64)

    def of(self, sets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = mix(_sums(mix(sets ^ _K[4]), n) + n.astype(U) * _K[5])
        b = mix(_sums(mix(sets ^ _K[6]), n) + n.astype(U) * _K[1])
        node = np.where(n > 0, (a >> U(64 - self.bits)) | U(1), U(0)).astype(np.int64)
        return self.renamed(node, b.view(np.int64)), b.view(np.int64)

    def renamed(self, node: np.ndarray, check: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return node
        other = (mix(node.view(U) * _K[3] ^ mix(check.view(U))) >> U(1)) | U(1)
        return np.where(np.isin(node, self.shared), other.view(np.int64), node)


def _width(n: np.ndarray) -> np.ndarray:
    """log2 of the number of ranges in the sketch of a set of this size: 64, or the power of two at or below n / 8."""
    return np.maximum(6, np.log2(np.maximum(n, 1)).astype(np.int64) - 3)


def sketch(s: np.ndarray) -> bytes:
    """Counts, at most 255, of the set's hashes in equal ranges."""
    w = int(_width(np.array([len(s)]))[0])
    return np.minimum(np.bincount((s >> U(64 - w)).astype(np.int64), minlength=1 << w), 255).astype(np.uint8).tobytes()


def far(a: bytes, b: bytes, most: int) -> bool:
    """True only if two sets with these sketches differ in more than ``most`` elements."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    full = bool((x == 255).any() or (y == 255).any())
    if full:
        return False
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(1)
    return int(np.abs(x - y).sum()) > most


def signatures(sets: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, probe) rows of some sets: segment subsets of the own band, and the chosen probes of each band in reach."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own = bands.of(n)
    end = np.cumsum(n)
    mixed = mix(sets ^ _K[0])
    top = sets >> U(32)
    least = -(-bands.percent * n // 100)
    for down in range(len(bands.hi)):
        b = own - down
        live = (b >= 0) & (n > 0)
        live[live] = bands.hi[b[live]] >= least[live]
        which = np.flatnonzero(live)
        if not len(which):
            break
        for small in (False, True):
            d = which[bands.small[b[which]] == small]
            if not len(d):
                continue
            m, size = bands.m[b[d]], n[d]
            doc, i = ragged(size)
            at = (end[d] - size)[doc] + i
            seg0 = np.cumsum(m) - m
            seg = seg0[doc] + ((top[at] * m[doc].astype(U)) >> U(32)).astype(np.int64)
            count = np.bincount(seg, minlength=int(m.sum()))
            total = _sums(mixed[at], count)
            owner, number = ragged(m)
            place = mix(b[d][owner].astype(U) * _K[2] + number.astype(U) * _K[3])
            key = mix(total + place + count.astype(U) * _K[5])
            need = bands.reach(n[d] + np.minimum(n[d], bands.hi[b[d]])) + 1
            load = bands.load[b[d]]
            whole = 1.0 + load[owner] * np.exp2(-3.0 * count)
            if small:
                near = (count + 1) * (1.0 + load[owner] * np.exp2(-3.0 * np.maximum(count - 1, 0)))
                cost = np.concatenate([whole, np.maximum(near - whole, whole)])
                order = np.lexsort((np.tile([0, 1], (len(whole), 1)).T.ravel(), cost, np.tile(owner, 2)))
                _, rank = ragged(2 * m)
                take = np.zeros(2 * len(whole), bool)
                take[order[rank < need[np.tile(owner, 2)[order]]]] = True
                one, two = take[: len(whole)], take[len(whole) :]
                less = mix(total[seg] - mixed[at] + place[seg] + (count[seg] - 1).astype(U) * _K[5])
                if down == 0:
                    out.append((d[doc], less, two[seg]))
                else:
                    out.append((d[doc[two[seg]]], less[two[seg]], np.ones(int(two[seg].sum()), bool)))
            else:
                order = np.lexsort((whole, owner))
                _, rank = ragged(m)
                one = np.zeros(len(whole), bool)
                one[order[rank < need[owner[order]]]] = True
            if down == 0:
                out.append((d[owner], key, one))
            else:
                out.append((d[owner[one]], key[one], np.ones(int(one.sum()), bool)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _set_rows(width: int, names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                sets, n = shingles(t, width, names.seed)
                node, check = names.of(sets, n)
                ids = batch.column(0).slice(t.first, len(t))
                yield pa.record_batch([ids, pa.array(n), pa.array(node), pa.array(check)], ["doc_id", "n_shingles", "node", "check"])

    return run


def _renamed_rows(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, check = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names.renamed(node, check)), batch.column(3)], ["doc_id", "n_shingles", "node", "check"])

    return run


def _signature_rows(width: int, names: Names, bands: Bands, wide: np.ndarray):
    """(sig, grp, node) rows. A bucket is sig with its lowest bit set; that bit is 0 for probes, so they come first in it.

    A row of a ``wide`` bucket has that as its group, and spreads by its node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for t in slices(batch.column(0), SLICE // 4):
                sets, n = shingles(t, width, names.seed)
                node, _ = names.of(sets, n)
                new = np.zeros(len(n), bool)
                for i, x in enumerate(node.tolist()):
                    if x and x not in seen:
                        new[i] = True
                        seen.add(x)
                if len(seen) > SEEN:
                    seen.clear()
                keep = np.repeat(new, n)
                node, sets, n = node[new], sets[keep], n[new]
                which, key, probe = signatures(sets, n, bands)
                bucket = key.view(np.int64) | 1
                apart = np.isin(bucket, wide) if len(wide) else np.zeros(len(bucket), bool)
                spread = np.where(apart, mix(node[which].view(U)).view(np.int64) | 1, bucket) - probe
                yield pa.record_batch([pa.array(spread), pa.array(bucket, mask=~apart), pa.array(node[which])], ["sig", "grp", "node"])

    return run


#: What comes of a bucket: a pair (a, b), or a member a of the hot group grp, which probes it or is only indexed.
FOUND = "grp long, a long, b long, probe boolean"


def _found(a: np.ndarray, b: np.ndarray | None = None, grp: np.ndarray | None = None, probe: np.ndarray | None = None) -> pa.RecordBatch:
    whole = [pa.nulls(len(a), kind) if x is None else pa.array(x) for x, kind in ((grp, pa.int64()), (a, None), (b, pa.int64()), (probe, pa.bool_()))]
    return pa.record_batch(whole, ["grp", "a", "b", "probe"])


def _pairs(probe: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
    """Every pair of a probe and a member that are two sets; what is a pair twice is dropped later."""
    a, b = np.repeat(probe, len(member)), np.tile(member, len(probe))
    a, b = a[a != b], b[a != b]
    return _found(np.minimum(a, b), np.maximum(a, b))


def _closed(sig: np.ndarray, node: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """What comes of whole buckets."""
    bucket = sig | 1
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(first, len(sig)))
    for s in np.unique(size[size > 1]).tolist():
        at = first[size == s][:, None] + np.arange(s)
        probe, base = (sig[at] & 1) == 0, node[at]
        live = (base != base[:, :1]).any(1) & probe.any(1)
        base, probe = base[live], probe[live]
        if not len(base):
            continue
        hot = probe.sum(1) > probes
        if hot.any():
            yield _found(base[hot].ravel(), None, np.repeat(base[hot].min(1), s), probe[hot].ravel())
        base, probe = base[~hot], probe[~hot]
        g, i = np.nonzero(probe)
        if len(g):
            p, q = np.repeat(base[g, i], s), base[g].ravel()
            p, q = p[p != q], q[p != q]
            yield _found(np.minimum(p, q), np.maximum(p, q))


class _Open:
    """A bucket that is too long to be held: its probes are known, as they come first, unless there are too many."""

    def __init__(self, sig: np.ndarray, node: np.ndarray, probes: int):
        self.bucket, self.probe, self.leader = sig[0] | 1, node[(sig & 1) == 0], int(node.min())
        self.hot = len(self.probe) > probes

    def rows(self, sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.hot:
            yield _found(node, None, np.full(len(node), self.leader), (sig & 1) == 0)
        elif len(self.probe):
            yield _pairs(self.probe, node)


def _candidates(most: int, probes: int):
    """From (sig, grp, node) rows by sig: candidate pairs, each with a probe, and members of hot groups.

    ``most`` rows of a bucket are held at once; more than ``probes`` probes make it hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sig, held = np.empty(0, np.int64), np.empty(0, np.int64)
        passing: _Open | None = None
        for batch in batches:
            sig, grp, node = (batch.column(i) for i in range(3))
            sig, node = sig.to_numpy(), node.to_numpy()
            if grp.null_count < len(grp):
                wide = grp.is_valid().to_numpy(zero_copy_only=False)
                yield _found(node[wide], None, grp.drop_null().to_numpy(), (sig[wide] & 1) == 0)
                sig, node = sig[~wide], node[~wide]
            sig, node = np.append(held_sig, sig), np.append(held, node)
            held_sig, held = sig[:0], node[:0]
            if passing is not None and len(sig):
                other = np.flatnonzero((sig | 1) != passing.bucket)
                k = int(other[0]) if len(other) else len(sig)
                yield from passing.rows(sig[:k], node[:k])
                if k == len(sig):
                    continue
                sig, node, passing = sig[k:], node[k:], None
            if not len(sig):
                continue
            other = np.flatnonzero((sig | 1) != (sig[-1] | 1))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from _closed(sig[:last], node[:last], probes)
            held_sig, held = sig[last:], node[last:]
            if len(held) > max(most, probes + 1):
                passing = _Open(held_sig, held, probes)
                yield from passing.rows(held_sig, held)
                held_sig, held = held_sig[:0], held[:0]
        if len(held):
            yield from _closed(held_sig, held, probes)

    return run


def _sketch_rows(width: int, names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                sets, n = shingles(t, width, names.seed)
                at = np.append(0, np.cumsum(n))
                parts = [sets[at[i] : at[i + 1]] for i in range(len(n))]
                out = [pa.array(names.of(sets, n)[0]), pa.array(n), pa.array([sketch(s) for s in parts], pa.binary()), batch.column(1).slice(t.first, len(t))]
                yield pa.record_batch(out, ["node", "n", "sketch", "text"])

    return run


def _near_pairs(percent: int):
    """Keeps the pairs whose sketches allow a link."""
    bands = Bands(percent, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(i) for i in range(6))
            na, nb = na.to_numpy(), nb.to_numpy()
            ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            most = bands.differ(na + nb)
            for i in np.flatnonzero(ok):
                if far(sa[i].as_py(), sb[i].as_py(), int(most[i])):
                    ok[i] = False
            keep = pa.array(ok)
            yield pa.record_batch([a.filter(keep), b.filter(keep)], ["a", "b"])

    return run


def _linked(percent: int, shared: int, n: int, m: int) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def _true_pairs(percent: int, width: int, seed: int):
    """Keeps the pairs (a, b, text of a, text of b) whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.add(*(pa.compute.binary_length(batch.column(c)) for c in (2, 3))).to_numpy()
            part = np.cumsum(size, dtype=np.int64) // SLICE
            for first, end in zip(*_runs(part), strict=True):
                k = end - first
                both = pa.concat_arrays([batch.column(c).slice(first, k) for c in (2, 3)])
                s = Shingles(next(slices(both, 1 << 62)), width, seed)
                ok = np.zeros(k, bool)
                if s.told_apart():
                    sets, n = s.sets()
                    at = np.append(0, np.cumsum(n))
                    for i in range(k):
                        p, q = sets[at[i] : at[i + 1]], sets[at[k + i] : at[k + i + 1]]
                        x = np.sort(np.concatenate([p, q]))
                        ok[i] = _linked(percent, int((x[1:] == x[:-1]).sum()), len(p), len(q))
                else:
                    sets = s.plain()
                    for i in range(k):
                        p, q = sets[i], sets[k + i]
                        ok[i] = _linked(percent, len(p & q), len(p), len(q))
                keep = pa.array(ok)
                yield pa.record_batch([batch.column(c).slice(first, k).filter(keep) for c in (0, 1)], ["a", "b"])

    return run


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of equal values."""
    cut = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
    return ([0, *cut], [*cut, len(x)]) if len(x) else ([], [])


def forest(sets: list[np.ndarray], nodes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets of numbers. Intersections come from matrix products over shared elements."""
    k = len(sets)
    n = np.array([len(s) for s in sets])
    value = np.concatenate(sets) if k else np.empty(0, U)
    member = np.repeat(np.arange(k), n)
    order = np.argsort(value, kind="stable")
    value, member = value[order], member[order]
    new = np.append(True, value[1:] != value[:-1]) if len(value) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(column) else np.empty(0, bool)
    keep = shared[column] if len(column) else np.empty(0, bool)
    member, column = member[keep], (np.cumsum(shared) - 1)[column[keep]] if len(column) else column
    meet = np.zeros((k, k), np.float32)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((k, min(width, int(shared.sum()) - at)), np.float32)
        x[member[lo:hi], column[lo:hi] - at] = 1
        meet += x @ x.T
    link = 100 * meet >= percent * (n[:, None] + n[None, :] - meet)
    left, out = np.ones(k, bool), []
    for root in range(k):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            i = front.pop()
            for j in np.flatnonzero(link[i] & left).tolist():
                left[j] = False
                out.append((int(nodes[i]), int(nodes[j])))
                front.append(j)
    return out


def _numbered(sets: list[frozenset]) -> list[np.ndarray]:
    """Sets of words as sets of numbers."""
    number: dict[tuple, int] = {}
    return [np.array(sorted(number.setdefault(x, len(number)) for x in s), U) for s in sets]


def _block_links(percent: int, width: int, seed: int):
    def run(table):
        node = table.column("node").to_numpy()
        first = np.unique(node, return_index=True)[1]
        text = table.column("text").combine_chunks()
        text = (text.chunk(0) if isinstance(text, pa.ChunkedArray) else text).take(pa.array(first))
        s = Shingles(next(slices(text, 1 << 62)), width, seed)
        if s.told_apart():
            x, n = s.sets()
            at = np.append(0, np.cumsum(n))
            sets = [x[at[i] : at[i + 1]] for i in range(len(n))]
        else:
            sets = _numbered(s.plain())
        links = forest(sets, node[first], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _joined(pairs: DataFrame, about: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(about.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in ("a", "b")])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, bits: int = 63) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``; component_id is the least id reachable by links.

    Words are runs of non-blank characters with A-Z lower-cased; a set is the distinct ``width``-word shingles, the whole
    sequence if it is shorter, and empty for a null or blank text. Two sets link when 100 * |intersection| >= percent *
    |union|; an empty set links with nothing, and its component is its own id. Rows that share an id count as one
    document. A row with a null id keeps its size; its component is that of an equal or linked set with an id, else null.
    An empty table gives no rows. Very long texts are read whole. Columns besides the two named are not read, so they may
    have any name.

    Links between different sets are decided on words. Equal sets are found by digests of ``bits`` and 64 further bits of
    shingle hashes under a seed drawn for the run; fewer bits only make shared digests, and so the second naming, likelier.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    names, layout = Names(bits, secrets.randbits(63)), "doc_id long, n_shingles long, node long, check long"
    rows = written(docs.mapInArrow(_set_rows(width, names), layout), "sets")
    while True:
        full = rows.where("node <> 0")
        nodes = full.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("n_shingles").alias("n"), (F.min("check") != F.max("check")).alias("clash"))
        sizes = nodes.groupBy("n").agg(F.count("*").alias("k"), F.max("clash").alias("clash")).where("n > 0")
        longest, clash = sizes.agg(F.max("n"), F.max("clash")).first()
        if not clash:
            break
        if len(names.shared):
            raise RuntimeError("different sets share a digest of 127 bits")
        names.shared = np.array([r.node for r in nodes.where("clash").select("node").limit(SHARED + 1).collect()], np.int64)
        if len(names.shared) > SHARED:
            raise RuntimeError(f"more than {SHARED} digests of {bits} bits are shared by different sets")
        rows = written(rows.mapInArrow(_renamed_rows(names), layout), "sets")
    links = spark.createDataFrame([], "a long, b long")
    if longest:
        plain = Bands(percent, longest)
        ends = F.array(*[F.lit(int(x)) for x in plain.hi])
        band = F.size(F.filter(ends, lambda e: e < F.col("n")))
        bands = Bands(percent, longest, {r.b: r.k for r in sizes.groupBy(band.alias("b")).agg(F.sum("k").alias("k")).collect()})
        links = _links(docs, nodes, width, percent, names, bands)
    # rows that share an id but not their set are one document: their sets link with the least of them
    several = full.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most")
    if several.limit(1).count():
        links = links.unionByName(full.join(several.select("doc_id", "b"), "doc_id").select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    named = nodes.join(components(links), "node", "left").withColumns({"root": F.coalesce("root", "node")})
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = written(named.join(least, "root").select("node", "component_id"), "components")
    return rows.join(placed, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _wide(docs: DataFrame, width: int, names: Names, bands: Bands) -> np.ndarray:
    """Signatures in a large share of all sets, by one in SAMPLED texts: at most SHARE."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    sig = some.select("text").mapInArrow(_signature_rows(width, names, bands, np.empty(0, np.int64)), "sig long, grp long, node long").select(F.col("sig").bitwiseOR(F.lit(1)).alias("sig"))
    size = written(sig.groupBy("sig").agg(F.count("*").alias("k")), "sample")
    total = size.agg(F.sum("k")).first()[0] or 0
    return np.array([r.sig for r in size.where(F.col("k") >= max(LEAST, total // SHARE)).select("sig").collect()], np.int64)


def _links(docs: DataFrame, nodes: DataFrame, width: int, percent: int, names: Names, bands: Bands) -> DataFrame:
    wide = _wide(docs, width, names, bands)
    sig = docs.select("text").mapInArrow(_signature_rows(width, names, bands, wide), "sig long, grp long, node long")
    shuffled = sig.repartition(F.col("sig").bitwiseOR(F.lit(1))).sortWithinPartitions("sig")
    found = written(shuffled.mapInArrow(_candidates(HELD, PROBES), FOUND).distinct(), "candidates")
    pairs = found.where("grp is null").select("a", "b")
    # written before it is joined by group, so that the join may deal the rows of one group over many tasks
    hot = found.where("grp is not null").groupBy("grp", F.col("a").alias("node")).agg(F.max("probe").alias("probe"))
    hot = written(hot.join(nodes.select("node", "n"), "node"), "members")
    # a group is worth comparing if something in it probes, and something else is there
    size = hot.groupBy("grp").agg(F.count("*").alias("k"), F.count_if("probe").alias("p"), F.sum("n").alias("w")).where("p > 0 and k > 1")
    hot = written(hot.drop("n").join(size, "grp"), "hot")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(hot.select("node")).distinct()
    ids = nodes.join(wanted, "node").where("least is not null").select(F.col("least").alias("doc_id"))
    texts = docs.join(ids.distinct(), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    sets = written(texts.mapInArrow(_sketch_rows(width, names), "node long, n long, sketch binary, text string").dropDuplicates(["node"]), "items")
    near = _joined(pairs, sets.select("node", "n", "sketch"), "n", "sketch").mapInArrow(_near_pairs(percent), "a long, b long")
    near = written(near, "near")
    links = _joined(near, sets.select("node", "text"), "text").mapInArrow(_true_pairs(percent, width, names.seed), "a long, b long")
    if hot.limit(1).count():
        links = links.unionByName(_hot_links(hot, sets, percent, width, names.seed))
    return links


def _dealt(hot: DataFrame, sets: DataFrame, percent: int, width: int, seed: int) -> DataFrame:
    """Links inside groups (grp, node, probe, k members, p probes, w shingles), as forests of pairs of blocks of about BLOCK sets and ITEMS shingles at most.

    Where most members probe, all blocks meet each other; else the blocks of probes meet the blocks of all members.
    """

    def cut(n: str, salt: int) -> tuple[Column, Column]:
        blocks = F.ceil(F.greatest(F.col(n) / F.lit(BLOCK), F.col("w") / F.col("k") * F.col(n) / F.lit(ITEMS))).cast("int")
        return blocks, F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")

    (all_blocks, mine), (probe_blocks, asking) = cut("k", 1), cut("p", 2)
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("other")
    every = hot.where("2 * p > k").select("grp", "node", all_blocks.alias("n"), mine.alias("mine"), upto(all_blocks)).where("n = 1 or mine <> other")
    every = every.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node")
    few = hot.where("2 * p <= k")
    asked = few.select("grp", "node", mine.alias("j"), upto(probe_blocks)).select("grp", F.col("other").alias("i"), "j", "node")
    asks = few.where("probe").select("grp", "node", asking.alias("i"), upto(all_blocks)).select("grp", "i", F.col("other").alias("j"), "node")
    held = every.unionByName(asked).unionByName(asks).join(sets.select("node", "text"), "node")
    return held.groupBy("grp", "i", "j").applyInArrow(_block_links(percent, width, seed), "a long, b long")


def _hot_links(hot: DataFrame, sets: DataFrame, percent: int, width: int, seed: int) -> DataFrame:
    """The links inside hot groups, as forests.

    A group of more than PIVOTED members is first compared with about BLOCK of its probes. Two sets of one component need
    no further look, so only the sets outside its largest component are then compared with all: a group of near copies
    costs about its size, not the square of it.
    """
    large = (F.col("k") > PIVOTED) & (2 * F.col("p") > F.col("k"))
    if not hot.where(large).limit(1).count():
        return _dealt(hot, sets, percent, width, seed)
    pivot = F.xxhash64("node", F.lit(3)) / F.lit(2.0**63) < 2.0 * BLOCK / F.col("p") - 1.0
    first = hot.where(large).withColumns({"probe": pivot & F.col("probe"), "p": F.lit(BLOCK)})
    seen = written(_dealt(first.withColumn("k", F.greatest("k", F.lit(2 * BLOCK))), sets, percent, width, seed), "pivots")
    rooted = hot.where(large).join(components(seen), "node", "left").select("grp", "node", "k", "w", F.coalesce("root", "node").alias("root"))
    main = rooted.groupBy("grp", "root").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("root", "n").alias("main"), F.max("n").alias("n"))
    outside = rooted.join(main, "grp").select("grp", "node", (F.col("root") != F.col("main")).alias("probe"), "k", (F.col("k") - F.col("n")).alias("p"), "w").where("p > 0")
    rest = hot.where(~large).select("grp", "node", "probe", "k", "p", "w").unionByName(outside)
    return seen.unionByName(_dealt(written(rest, "outside"), sets, percent, width, seed))

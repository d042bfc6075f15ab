"""Token ids in binary files, with keyed access through a minimal perfect hash index.

A store is a folder:

    ids/shard=<s>/   one file a shard of whole documents: HEADER, the keys (64 bits each), the end of each document (in ids, from the
                     shard's start, 64 bits), then nothing but ids, 16 or 32 bits each as the vocabulary needs; all little-endian.
                     Shards in ascending order hold the documents in ascending order of keys, those without one first.
    shards/          Parquet: for each shard its documents and ids, and those of all shards before it
    index/           Parquet: for each part of the keys, dealt by a hash, a minimal perfect hash function, and by its numbers the
                     fingerprint, shard and row of the key's first document, and how many documents have the key

A key is found in constant time: its hash names the part, the function its number there; a fingerprint that differs tells
a key that is not in the store but for one in 2**32, and what is read is compared with the key stored beside it.

Spark writes the files: a shard is one value of its text writer, which passes bytes as they are and ends the value by a line
feed. So they reach any file system that Spark does, and a lost executor's files come from its task's second run.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder, Model, live, together
from .perfect_hash import PerfectHash, fingerprint
from ..sources.scratch import written

#: Name, version, bytes of an id, documents, documents without a key, ids.
HEADER = struct.Struct("<8sIIQQQ")
NAME, VERSION = b"TOKENIDS", 1
#: Bytes of ids of a shard, at least, as long as its range has more.
SHARD = 8 << 20
#: Bytes of text of a range of keys, about, and the most ranges; one task sorts and packs a range.
RANGE, MOST_RANGES = 64 << 20, 10_000
#: Keys of a part of the index, about; and rows of a repeated key that are made together.
PART, RUN = 1 << 13, 1 << 12
#: A shard's number is that of its range and, in these low bits, its place in the range.
PLACES = 20

_INDEX = "part long, sizes array<long>, words binary, fingerprints array<int>, shards array<long>, rows array<long>, copies array<long>"


@dataclass
class Store:
    """A written store."""

    spark: SparkSession
    path: str

    def files(self) -> DataFrame:
        """(shard, content) of all files."""
        rows = self.spark.read.format("binaryFile").load(f"{self.path}/ids")
        return rows.select(F.col("shard").cast("long"), "content")

    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/shards")

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")


class Shard:
    """The parts of a file, as arrays over its bytes."""

    def __init__(self, content: bytes | memoryview):
        name, version, width, n, self.nameless, self.n_ids = HEADER.unpack_from(content)
        if name != NAME or version != VERSION:
            raise ValueError("not a file of token ids")
        self.keys = np.frombuffer(content, "<i8", n, HEADER.size)
        self.ends = np.frombuffer(content, "<i8", n, HEADER.size + 8 * n)
        self.ids = np.frombuffer(content, f"<u{width}", self.n_ids, HEADER.size + 16 * n)
        self.starts = np.append(0, self.ends[:-1])

    def key_column(self) -> pa.Array:
        """The keys, null for the first documents if they have none."""
        return pa.array(self.keys, pa.int64(), mask=np.arange(len(self.keys)) < self.nameless)

    def document(self, row: int) -> np.ndarray:
        """The ids of a document, with the end id."""
        return self.ids[self.starts[row] : self.ends[row]]


def packed(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A file of these documents; those without a key come first."""
    ends = np.cumsum(np.fromiter(map(len, ids), "<i8", len(ids))) // width
    nameless = sum(k is None for k in keys)
    head = HEADER.pack(NAME, VERSION, width, len(keys), nameless, int(ends[-1]) if len(ends) else 0)
    return b"".join([head, np.array([k or 0 for k in keys], "<i8").tobytes(), ends.astype("<i8").tobytes(), *ids])


def _encode(shipped, cuts: np.ndarray, end: int, width: int):
    """(range, key, ids): encoded texts with the end id, and the range of keys they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, stop = live("encoder", Encoder, shipped), np.array([end], f"<u{width}").tobytes()
        turn = 0
        for batch in batches:
            keys, texts = batch.column(0), together(batch.column(1))
            at = 0
            for some in texts:
                ids = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() + stop for x in coder.encode_all(some)]
                mine = keys.slice(at, len(ids))
                at += len(ids)
                key = mine.fill_null(0).to_numpy()
                low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
                # a key that several cuts fall on has the ranges between them: its documents take turns
                to = np.where(high > low, low + 1 + (turn + np.arange(len(key))) % np.maximum(high - low, 1), low)
                turn += len(key)
                to[mine.is_null().to_numpy(zero_copy_only=False)] = 0
                yield pa.record_batch([pa.array(to, pa.int32()), mine, pa.array(ids, pa.binary())], ["range", "key", "ids"])

    return run


def _pack(width: int, size: int):
    """(shard, content): the sorted documents of a range, cut into shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held = -1, 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []

        def shard() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now << PLACES | number], pa.int64()), pa.array([packed(keys, ids, width)], pa.binary())], ["shard", "content"])

        for batch in batches:
            for at, key, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys and (at != now or held >= size):
                    yield shard()
                    number = number + 1 if at == now else 0
                    keys, ids, held = [], [], 0
                now = at
                keys.append(key)
                ids.append(x)
                held += len(x)
        if keys:
            yield shard()

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, row, key, n): what a file says of its documents."""
    for batch in batches:
        for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = Shard(content.as_buffer())
            n = len(s.keys)
            yield pa.record_batch([pa.array(np.full(n, number)), pa.array(np.arange(n)), s.key_column(), pa.array(s.ends - s.starts)], ["shard", "row", "key", "n"])


def _function(table: pa.Table) -> pa.Table:
    """The perfect hash function of the keys of a part, and what it leads to."""
    keys = table.column("key").to_numpy().astype(np.int64).view(np.uint64)
    f = PerfectHash.of(keys)
    by = np.argsort(f.numbers(keys))
    values = [fingerprint(keys[by]).view(np.int32), *(table.column(c).to_numpy()[by] for c in ("shard", "row", "copies"))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (f.sizes, *values)]
    columns = [table.column("part").combine_chunks().slice(0, 1), lists[0], pa.array([f.words.tobytes()], pa.binary()), *lists[1:]]
    return pa.table(columns, [c.split()[0] for c in _INDEX.split(", ")])


def _locate(asked: pa.Table, index: pa.Table) -> pa.Table:
    """(key, shard, row, copies) of the asked keys of a part that the index has."""
    key = asked.column("key").to_numpy()
    if index.num_rows and len(key):
        get = lambda c: index.column(c)[0].values.to_numpy()
        keys = key.astype(np.int64).view(np.uint64)
        f = PerfectHash(get("sizes"), np.frombuffer(index.column("words")[0].as_py(), "<u8"))
        number = f.numbers(keys)
        number[number >= 0] = np.where(get("fingerprints")[number[number >= 0]].view(np.uint32) == fingerprint(keys[number >= 0]), number[number >= 0], -1)
        key, number = key[number >= 0], number[number >= 0]
        found = [key, *(get(c)[number] for c in ("shards", "rows", "copies"))]
    else:
        found = [np.empty(0, np.int64)] * 4
    return pa.table([pa.array(x, pa.int64()) for x in found], ["key", "shard", "row", "copies"])


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")


def build_index(store: Store) -> Store:
    """Writes shards/ and index/ from the files; a store that lost them gets them back."""
    entries = written(store.files().mapInArrow(_entries, "shard long, row long, key long, n long"), "entries")
    sizes = entries.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_ids"), F.count_if(F.col("key").isNull()).alias("n_nameless"))
    sizes = sizes.withColumn("range", F.shiftright("shard", PLACES))
    docs, ids, before = 0, 0, []
    for r in sizes.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("n_ids").alias("i")).orderBy("range").collect():  # at most MOST_RANGES rows
        before.append((r.range, docs, ids))
        docs, ids = docs + r.d, ids + r.i
    base = F.broadcast(store.spark.createDataFrame(before, "range long, d long, i long"))
    w = Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c, of: (F.col(of) + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(c.replace("n_", "") + "_before")
    sizes.join(base, "range").select("shard", "n_docs", "n_ids", "n_nameless", ahead("n_docs", "d"), ahead("n_ids", "i")).write.parquet(f"{store.path}/shards")

    parts = max(1, -(-docs // PART))
    first = F.min(F.struct("shard", "row")).alias("first")
    keys = entries.where("key is not null").groupBy("key").agg(first, F.count("*").alias("copies"))
    keys = keys.select(_part("key", parts), "key", "first.shard", "first.row", "copies")
    keys.groupBy("part").applyInArrow(_function, _INDEX).write.parquet(f"{store.path}/index")
    return store


def write(docs: DataFrame, vocabulary: str, path: str, *, end: int = 1, shard: int = SHARD) -> Store:
    """Encodes every text of ``docs`` (doc_id, text) with the tokenizer file ``vocabulary`` and writes the store at ``path``.

    The id ``end`` is appended to each document; a null or empty text has no other. Documents stand in ascending order of
    doc_id, those without one first. Rows that share an id are all written, next to each other: those of a frequent id are
    dealt over several ranges, within one they follow a checksum. Texts are taken whole however long; a shard ends with the
    document that reaches ``shard`` bytes. An empty table gives a store without files.
    """
    spark = docs.sparkSession
    model = Model(vocabulary)
    width = 2 if max(len(model.tokens) - 1, end) < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size.n:
        spark.createDataFrame([], "shard long, n_docs long, n_ids long, n_nameless long, docs_before long, ids_before long").write.parquet(f"{path}/shards")
        spark.createDataFrame([], _INDEX).write.parquet(f"{path}/index")
        spark.createDataFrame([], "value string").write.text(f"{path}/ids")
        return Store(spark, path)
    ranges = min(MOST_RANGES, max(-(-(size.bytes or 0) // RANGE), spark.sparkContext.defaultParallelism))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("key", F.array(*map(F.lit, shares)), 100 * ranges).alias("c")).first().c if shares else []
    shipped = spark.sparkContext.broadcast(model)  # bounded by the vocabulary file
    dealt = rows.mapInArrow(_encode(shipped, np.array(cuts or [], np.int64), end, width), "range int, key long, ids binary")
    ordered = dealt.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", F.crc32("ids"))
    files = ordered.mapInArrow(_pack(width, shard), "shard long, content binary")
    files.select("shard", F.col("content").cast("string").alias("value")).write.partitionBy("shard").text(f"{path}/ids")
    return build_index(Store(spark, path))


def locate(store: Store, keys: DataFrame) -> DataFrame:
    """(key, shard, row, copies) of the different ``keys`` (key) that the index has: the place of the first document of each.

    A key that is not in the store may pass for another, once in 2**32; a null key is in no index.
    """
    parts = max(1, -(-(store.shards().agg(F.sum("n_docs").alias("n")).first().n or 0) // PART))  # as the index was dealt
    asked = keys.where("key is not null").distinct().select("key", _part("key", parts))
    return asked.groupBy("part").cogroup(store.index().groupBy("part")).applyInArrow(_locate, "key long, shard long, row long, copies long")


def _rows(store: Store, keys: DataFrame) -> DataFrame:
    """(key, at): the number of each document of the store that has one of the ``keys``, through the index."""
    found = locate(store, keys).join(store.shards().select("shard", "docs_before"), "shard").select("key", (F.col("docs_before") + F.col("row")).alias("at"), "copies")
    nameless = store.shards().agg(F.sum("n_nameless").alias("copies")).where("copies > 0")
    null = keys.where("key is null").select("key").limit(1).crossJoin(nameless).select("key", F.lit(0).cast("long").alias("at"), "copies")  # one row and one row
    # documents that share a key follow each other: they are made in runs, which are dealt anew, so a frequent key is no long task
    runs = found.unionByName(null).select("key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("copies") - 1, F.lit(RUN))).alias("a"), (F.col("at") + F.col("copies") - 1).alias("z"))
    return runs.repartition("a").select("key", F.explode(F.sequence(F.col("a"), F.least(F.col("z"), F.col("a") + RUN - 1), F.lit(1))).alias("at"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, row, stored, offset, n_tokens, ids_crc32): what the ids of a file's documents are."""
    for batch in batches:
        for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = Shard(content.as_buffer())
            n = len(s.keys)
            wide = s.ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(s.starts.tolist(), s.ends.tolist(), strict=True)]
            columns = [np.full(n, number), np.arange(n), s.key_column(), s.starts, s.ends - s.starts, np.array(crc, np.int64)]
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["shard", "row", "stored", "offset", "n_tokens", "ids_crc32"])


def read_digests(store: Store, keys: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the store that has one of the ``keys`` (key), read from the files.

    The index leads from a key to its documents. start counts the ids of all documents before it, n_tokens its own with the
    end id, ids_crc32 is the CRC-32 of these as little-endian 32-bit integers. Documents without a key are asked for by
    a null one. A key that several documents have gives a row for each; a repeated key asks once.
    """
    if not store.shards().limit(1).count():
        return store.spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = store.files().mapInArrow(_digests, "shard long, row long, stored long, offset long, n_tokens long, ids_crc32 long")
    rows = rows.join(store.shards(), "shard").withColumn("at", F.col("docs_before") + F.col("row"))
    same = rows.join(_rows(store, keys), "at").where(F.col("key").eqNullSafe(F.col("stored")))
    return same.select(F.col("key").alias("doc_id"), (F.col("ids_before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _cut(asked: pa.Table, files: pa.Table) -> pa.Table:
    keys, ids = [], []
    if files.num_rows:
        s = Shard(files.column("content")[0].as_buffer())
        for key, row in zip(asked.column("key").to_pylist(), asked.column("row").to_pylist(), strict=True):
            if s.key_column()[row].as_py() == key:
                keys.append(key)
                ids.append(s.document(row).astype("<u4").tobytes())
    return pa.table([pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["key", "ids"])


def fetch(store: Store, keys: DataFrame) -> DataFrame:
    """(key, ids) of the different ``keys`` (key): the ids of the first document of each, little-endian unsigned 32-bit.

    Only files of shards that hold an asked key are read, as the shard is a part of their path. Keys that are not in the
    store, and null ones, have no row.
    """
    if not store.shards().limit(1).count():
        return store.spark.createDataFrame([], "key long, ids binary")
    found = locate(store, keys).select("key", "shard", "row")
    files = store.files().join(found.select("shard").distinct(), "shard", "left_semi")
    return found.groupBy("shard").cogroup(files.groupBy("shard")).applyInArrow(_cut, "key long, ids binary")


def sequential(store: Store) -> DataFrame:
    """(shard, row, key, ids) of all documents, as a training job reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Shard(content.as_buffer())
                ids = [s.document(i).astype("<u4").tobytes() for i in range(len(s.keys))]
                yield pa.record_batch([pa.array(np.full(len(ids), number)), pa.array(np.arange(len(ids))), s.key_column(), pa.array(ids, pa.binary())], ["shard", "row", "key", "ids"])

    if not store.shards().limit(1).count():
        return store.spark.createDataFrame([], "shard long, row long, key long, ids binary")
    return store.files().mapInArrow(run, "shard long, row long, key long, ids binary")

"""Resampling, ranked search and id files against brute force and the tokenizers library, and on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorebank.llm import bytes_np, id_files, lexical_search, resampling
from lorebank.llm.perfect_hash import PerfectHash, fingerprint
from lorebank.llm.queries import queries
from lorebank.llm.ranks import ranked
from lorebank.sources.scratch import place

from .test_llm import DIR, LOW, ODD

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{DIR}/benchmark.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7, 8, 9, 1, 2, "x", 3.0) for i, t in enumerate(ODD)] + [(3, "a", 7, 8, 9, 1, 2, "x", 3.0), (None, "no id at all", *[None] * 7)] + [(20, "wide words " + "w" * 300 + " one two " * 12, 7, 8, 9, 1, 2, "x", 3.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, rank long, score long, weight long, shard long, row long, term string, __row double")


# resampling


def brute_resample(rows, target, buckets, low, high, percent, least, seed):
    def grams(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = collections.Counter(bucket(g) for _, x in rows for g in grams(x))
    t = collections.Counter(bucket(g) for x in target for g in grams(x))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    out, n = [], 0
    for i, x in rows:
        g = [bucket(y) for y in grams(x)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in g)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        able = len(words(x)) >= least and score is not None
        n += able
        out.append([i, len(words(x)), len(g), weight, score, able])
    best = sorted((r for r in out if r[-1]), key=lambda r: (-r[4], r[0], r[2]))[: n * percent // 100]
    place = {id(r): k for k, r in enumerate(best, 1)}
    return [(*r[:5], place.get(id(r))) for r in out]


@pytest.mark.parametrize("buckets, low, high, percent, least", [(10_000, 1, 1, 10, 20), (97, 1, 3, 50, 1), (1_000, 2, 2, 100, 2)])
def test_resampling(spark, docs, odd, items, buckets, low, high, percent, least):
    table = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100).unionByName(odd.select("doc_id", "text"))
    got = resampling.resample(table, items, buckets=buckets, low=low, high=high, percent=percent, least_words=least, seed=7).collect()
    want = brute_resample([tuple(r) for r in table.collect()], [r.text for r in items.collect()], buckets, low, high, percent, least, 7)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_resampling_of_odd_tables(spark, odd, items):
    got = {r.doc_id: r for r in resampling.resample(odd, items.limit(0), percent=100, least_words=1).collect()}
    assert got[0].n_features == got[1].n_features == 0 and got[0].weight == 0 and got[0].score is not None and got[0].rank is None
    assert got[None].weight and got[None].score is None and got[None].rank is None
    assert set(resampling.resample(odd, items).columns) == {"doc_id", "n_words", "n_features", "weight", "score", "rank"}
    assert resampling.resample(odd.limit(0), items).collect() == []
    same = spark.createDataFrame([(5, "the same words " * 9)] * 50 + [(6, "others")], "doc_id long, text string")
    assert sorted(r.rank for r in resampling.resample(same, items, percent=100).collect() if r.rank) == list(range(1, 51))


def test_the_drawn_texts_are_more_like_the_target(spark, docs, items):
    near = docs.where("lang = 'es'").select("text")  # drawn towards one language, mostly that language is drawn
    drawn = resampling.draw(docs, resampling.resample(docs, near, percent=10))
    share = lambda rows: rows.where("lang = 'es'").count() / max(rows.count(), 1)
    assert share(drawn) > 4 * share(docs) and set(drawn.columns) == set(docs.columns)


def test_crc_of_all_kinds_of_words():
    rng = random.Random(3)
    for _ in range(30):
        texts = ["".join(rng.choice("aZ0 é-中") for _ in range(rng.choice([0, 1, 5, 60, 200]))) for _ in range(20)] + ["x" * n for n in (63, 64, 65, 1000)]
        (t,) = bytes_np.slices(pa.array(texts))
        got = [x for n in resampling.features(t, 1, 3) for x in zip(n[0].tolist(), n[1].tolist(), strict=True)]
        want = [(i, zlib.crc32(" ".join(w[k : k + n]).encode())) for n in (1, 2, 3) for i, x in enumerate(texts) for w in [words(x)] for k in range(len(w) - n + 1)]
        assert got == want


def test_places_in_an_order(spark):
    rows = spark.range(10_000).withColumn("v", F.xxhash64("id") % 50)
    got = ranked(rows, [F.col("v").desc(), F.col("id")]).collect()
    want = sorted(rows.collect(), key=lambda r: (-r.v, r.id))
    assert {r.id: r["rank"] for r in got} == {r.id: k for k, r in enumerate(want, 1)}


# search


def brute_search(rows, asked, k):
    bags = [(i, collections.Counter(words(x))) for i, x in rows]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for q, text in asked:
        found = []
        for i, b in bags:
            m = 25 + 75 * b.total() * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m)) for w in words(text) if b[w])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


ASKED = [(1, "the same TEXT here"), (1, "word a a b"), (2, None), (3, ""), (4, "nowhere-to-be-found"), (None, "no id é 中文"), (5, "the the the and of to in la de und"), (6, "one")]


def _same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("shard, part, k", [(8 << 20, 8 << 20, 10), (3_000, 8 << 20, 3), (200, 40, 1)])
def test_search(spark, docs, odd, items, shard, part, k, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search, "PART", part)
    monkeypatch.setattr(lexical_search, "LEFT", 0 if k == 1 else 64)
    table = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100).unionByName(odd.select("doc_id", "text")).repartition(3)
    asked = spark.createDataFrame(ASKED, "item_id long, text string")
    if part > 40:
        asked = asked.unionByName(items.select("item_id", "text").withColumn("item_id", F.col("item_id") + 10))
    got = lexical_search.search(lexical_search.build_index(table), asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    _same(got.collect(), brute_search([tuple(r) for r in table.collect()], [tuple(r) for r in asked.collect()], k))


def test_search_of_odd_tables(spark, docs, odd, items):
    empty = lexical_search.build_index(odd.limit(0))
    assert (empty.n_docs, empty.n_terms) == (0, 0) and lexical_search.search(empty, items).collect() == []
    assert lexical_search.search(lexical_search.build_index(odd), items.limit(0)).collect() == []
    wordless = spark.createDataFrame([(1, None), (2, " .. ")], "doc_id long, text string")
    assert lexical_search.search(lexical_search.build_index(wordless), items).collect() == []
    named = spark.createDataFrame([("q", "here")], "item_id string, text string")
    assert [(r.item_id, r.doc_id) for r in lexical_search.search(lexical_search.build_index(odd), named).collect()] == [("q", 8), ("q", 9)]  # equal scores by id


def _lists(rng, n):
    lists = []
    for _ in range(rng.randint(1, 6)):
        ids = rng.sample(range(n), rng.randint(1, n))
        adds = sorted((rng.choice([1, 2, 3, rng.randint(1, 1000)]) * rng.choice([1, 1, 50]) for _ in ids), reverse=True)
        new = [i for i in range(len(adds)) if not i or adds[i] != adds[i - 1]]
        lists.append((np.array([adds[i] for i in new]), np.array([*new[1:], len(adds)]), np.array(ids)))
    return lists


def test_a_shard_gives_every_document_that_can_be_among_the_best(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(lexical_search, "LEFT", 2)
    for _ in range(400):
        n, k = rng.randint(1, 60), rng.randint(1, 5)
        lists = _lists(rng, n)
        score = np.zeros(n, np.int64)
        for adds, upto, ids in lists:
            score[ids] += np.repeat(adds, np.diff(upto, prepend=0))
        floor = rng.choice([0, 0, int(np.sort(score)[-1]), rng.randint(0, int(score.max()) + 5)])
        found, got, _ = lexical_search.best_of_shard(lists, n, k, floor)
        assert (score[found] == got).all()
        kth = np.sort(score)[-k] if n >= k else 0
        assert set(np.flatnonzero(score >= max(kth, floor, 1)).tolist()) <= set(found.tolist())


def test_lists_are_left_once_the_best_are_proven():
    n = 100_000
    rare = (np.array([10**9]), np.array([20]), np.arange(20))
    frequent = (np.arange(2000, 0, -1), np.arange(1, 2001) * (n // 2000), np.random.default_rng(1).permutation(n))
    found, _, added = lexical_search.best_of_shard([rare, frequent], n, 10, 0)
    assert added < n // 10 and set(found.tolist()) <= set(range(20))
    assert lexical_search.best_of_shard([frequent], n, 10, 2001)[2] == 0  # a shard that cannot reach the floor is passed over


def test_search_where_hashes_collide(monkeypatch):
    few = bytes_np.Texts.hashes
    monkeypatch.setattr(bytes_np.Texts, "hashes", lambda self, *a, seed=0, **b: few(self, *a, seed=seed, **b) >> np.uint64(54 if seed < 3 else 0))
    (t,) = bytes_np.slices(pa.array([" ".join(f"w{i}" for i in range(300)), "w1 w2 w2"]))
    row = lexical_search._index_row(t, pa.array([1, 2]), 2, 303)
    assert row.column("seed")[0].as_py() == 3 and sorted(row.column("terms")[0].as_py()) == sorted(f"w{i}" for i in range(300))


def test_a_shard_is_written_and_read_alone(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD", 20_000)
    index = lexical_search.build_index(docs.select("doc_id", "text").coalesce(1))
    (file,) = [pq.ParquetFile(x.removeprefix("file://")) for x in index.table.inputFiles()]
    assert file.metadata.num_row_groups == file.metadata.num_rows > 5


def test_lengths_beyond_64_bits():
    got = lexical_search.length_weight(np.array([10**12, 5]), 10**10, 10**13)
    assert got.tolist() == [25 + 75 * 10**12 * 10**10 // 10**13, 25 + 75 * 5 * 10**10 // 10**13]


# id files


def library_rows(rows, end=1):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    out = []
    for i, x in rows:
        ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, end]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    return out


def _check_store(got, rows):
    """Whatever the order among documents that share an id is: starts follow the order of ids and leave no gap."""
    want = library_rows(rows)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((*key(r), r[1], r[2]) for r in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [key((r.doc_id,)) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


@pytest.mark.parametrize("shard, ranges", [(8 << 20, 64 << 20), (500, 20_000)])
def test_id_files(spark, docs, odd, shard, ranges, monkeypatch):
    monkeypatch.setattr(id_files, "RANGE", ranges)
    monkeypatch.setattr(id_files, "PART", 50)
    table = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100).unionByName(odd.select("doc_id", "text")).unionByName(odd.select(F.lit(None).cast("long").alias("doc_id"), "text").limit(3))
    store = id_files.write(table, VOCABULARY, place(spark, "ids"), shard=shard)
    rows = [tuple(r) for r in table.collect()]
    asked = table.select(F.col("doc_id").alias("key"))
    got = id_files.read_digests(store, asked.unionByName(spark.createDataFrame([(10**9,), (-5,)], "key long"))).collect()
    _check_store(got, rows)
    if shard == 500:
        assert store.shards().count() > 50
    want = collections.defaultdict(list)
    for i, _, _, ids in library_rows(rows):
        want[i].append(np.array(ids, "<u4").tobytes())
    some = id_files.fetch(store, spark.createDataFrame([(3,), (105,), (105,), (199,), (10**9,), (None,)], "key long")).collect()
    assert sorted(r.key for r in some) == [3, 105, 199] and all(bytes(r.ids) in want[r.key] for r in some)
    every = id_files.sequential(store).orderBy("shard", "row").collect()
    assert sorted(bytes(r.ids) for r in every) == sorted(x for v in want.values() for x in v)


def test_a_frequent_id_is_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(id_files, "RANGE", 2_000)
    rows = [(7, f"some words {i % 5}") for i in range(3_000)] + [(i, "a b") for i in range(100, 2_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = id_files.write(table, VOCABULARY, place(spark, "ids"), shard=300)
    assert store.files().join(id_files.sequential(store).where("key = 7").select("shard").distinct(), "shard").select(F.shiftright("shard", id_files.PLACES)).distinct().count() > 4
    _check_store(id_files.read_digests(store, table.select(F.col("doc_id").alias("key"))).collect(), rows)


def test_id_files_of_empty_tables_and_lost_indexes(spark, odd):
    store = id_files.write(odd.limit(0), VOCABULARY, place(spark, "ids"))
    keys = odd.select(F.col("doc_id").alias("key"))
    assert id_files.read_digests(store, keys).collect() == [] and id_files.fetch(store, keys).collect() == [] and id_files.sequential(store).collect() == []
    store = id_files.write(odd, VOCABULARY, place(spark, "ids"))
    assert id_files.read_digests(store, keys.limit(0)).collect() == []
    only = spark.createDataFrame([(None,)], "key long")
    assert [r.n_tokens for r in id_files.read_digests(store, only).collect()] == [r[1] for r in library_rows([(None, "no id at all")])]
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store.path)
    fs = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for lost in ("index", "shards"):
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.path}/{lost}"), True)
    assert id_files.read_digests(id_files.build_index(store), keys).count() == odd.count()


def test_perfect_hashes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 64, 1_000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.int64)).view(np.uint64) if n != 1_000 else np.arange(1_000, dtype=np.uint64)
        f = PerfectHash.of(keys)
        assert sorted(f.numbers(keys).tolist()) == list(range(len(keys)))
        assert len(f.words) * 64 <= 5 * len(keys) + 64 * len(f.sizes)
        others = rng.integers(0, 1 << 63, 1_000, np.int64).view(np.uint64)
        numbers = f.numbers(others)
        assert ((numbers >= -1) & (numbers < max(len(keys), 1))).all()
        prints = np.zeros(max(len(keys), 1), np.uint32)
        prints[f.numbers(keys)] = fingerprint(keys)
        assert ((numbers >= 0) & (prints[numbers] == fingerprint(others))).sum() <= 1
    with pytest.raises(ValueError):
        PerfectHash.of(np.array([1, 1], np.uint64))


def test_files_are_refused_if_they_are_none():
    good = id_files.packed([None, 3], [b"\1\0\2\0", b"\7\0"], 2)
    s = id_files.Shard(good + b"\n")
    assert (s.key_column().to_pylist(), s.document(0).tolist(), s.document(1).tolist()) == ([None, 3], [1, 2], [7])
    with pytest.raises(ValueError):
        id_files.Shard(b"x" + good)


def test_registered_queries(spark, docs, items):
    every = queries()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = every["op11_importance_resampling"](spark, DIR)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    _same(got.collect(), [(r[0], *r[2:]) for r in brute_resample(rows, [r.text for r in items.collect()], 10_000, 1, 1, 10, 20, 2024)])
    got = every["op12_lexical_search"](spark, DIR)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    _same(got.collect(), brute_search(rows, [(r.item_id, r.text) for r in items.collect()], 10))
    got = every["op13_id_files"](spark, DIR)
    assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "start", "n_tokens", "ids_crc32")}
    _check_store(got.collect(), rows)

"""The training-data operators against brute force, the tokenizers library and held-out labels, and on odd tables."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorebank.llm import bpe, bytes_np, decontamination, html_extract, language_id, ngram_jaccard, pii, quality_rules, token_counts, toxicity, url_filters
from lorebank.llm.components import components
from lorebank.llm.queries import held_out, op3_url_filters, queries
from lorebank.llm.samples import least_hashed

DIR = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [None, "", " \n\t", "a", "a b c", "word " * 4000, "é" * 3000, "ẞΣς 中文 ½ \x85", "same text here to repeat again", "same text here to repeat again", "<|endoftext|> x@y.zz; +1 (234) 555-0000; 4111111111111111; 1.2.3.4"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0, 7, 8, 9) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 0, 7, 8, 9), (None, "no id at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, n long, key long")


def shingles(text, k):
    w = re.findall(r"[^ \t-\r]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("k, percent, bits", [(4, 85, 63), (2, 60, 63), (4, 85, 10)])
def test_jaccard(spark, k, percent, bits, monkeypatch):
    r = random.Random(k)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice((3, 6, 9, 14, 40, 120, 300)))] for _ in range(25)]
    rows = []
    for i in range(420):
        w = list(base[min(int(r.expovariate(0.25)), 24)])
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            w[r.randrange(len(w))] = f"x{r.randint(0, 60)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 20)
    out = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=k, percent=percent, bits=bits)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out.collect()} == brute_components(rows, k, percent)


@pytest.mark.parametrize("limits", [{"HELD": 16, "PROBES": 3}, {"HELD": 9, "PROBES": 0, "PIVOTED": 20}, {"SAMPLED": 1, "LEAST": 4, "SHARE": 10**9, "PIVOTED": 30}, {"PROBES": 1, "PIVOTED": 10, "BLOCK": 5}, {"PROBES": 2, "ITEMS": 150, "BLOCK": 1024}, {"PROBES": 2, "ITEMS": 150, "PIVOTED": 20}])
def test_jaccard_of_long_buckets_and_wide_signatures(spark, limits, monkeypatch):
    """The ways for large tables, at limits low enough for a small one."""
    r = random.Random(8)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice((3, 6, 9, 14, 40, 120)))] for _ in range(8)]
    rows = []
    for i in range(300):
        w = list(base[min(int(r.expovariate(0.5)), 7)])
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            w[r.randrange(len(w))] = f"x{r.randint(0, 60)}"
        rows.append((i, " ".join(w)))
    for name, value in {"BLOCK": 20, **limits}.items():
        monkeypatch.setattr(ngram_jaccard, name, value)
    out = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=2, percent=60)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out.collect()} == brute_components(rows, 2, 60)


@pytest.mark.parametrize("percent", [80, 85])
def test_unrelated_sets_make_no_hot_group(percent):
    """Segments that unrelated sets lack by chance make long buckets, which give nothing as none or few probe them."""
    r = np.random.default_rng(5)
    k, n = 20_000, 100
    sets = np.sort(r.integers(0, 1 << 63, (k, n), np.uint64) * np.uint64(2), axis=1).ravel()
    bands = ngram_jaccard.Bands(percent, n, {int(ngram_jaccard.Bands(percent, n).of(np.array([n]))[0]): k})
    which, key, probe = ngram_jaccard.signatures(sets, np.full(k, n), bands)
    sig, node = (key.view(np.int64) | 1) - probe, 2 * which + 1
    order = np.argsort(sig, kind="stable")
    key, node = sig[order], node[order]
    assert np.unique(key | 1, return_counts=True)[1].max() > 256
    batches = [pa.record_batch([pa.array(key[i : i + 10_000]), pa.nulls(len(key[i : i + 10_000]), pa.int64()), pa.array(node[i : i + 10_000])], ["sig", "grp", "node"]) for i in range(0, len(key), 10_000)]
    found = list(ngram_jaccard._candidates(256, ngram_jaccard.PROBES)(batches))
    assert sum(len(b) - b.column(0).null_count for b in found) == 0
    assert sum(map(len, found)) < k


def test_long_buckets_in_parts():
    """However its rows are cut into batches, a long bucket gives every pair with a probe, or all its members once it is hot."""
    for probes, total in ((0, 900), (3, 900), (9, 900)):
        node = np.concatenate([np.arange(1, total + 1) * 2 + 1, [7001, 7003]])
        sig = np.concatenate([5 - (np.arange(total) < probes), [7, 7]])
        for cut in (1, 7, 1000):
            batches = [pa.record_batch([pa.array(sig[i : i + cut]), pa.nulls(len(sig[i : i + cut]), pa.int64()), pa.array(node[i : i + cut])], ["sig", "grp", "node"]) for i in range(0, len(sig), cut)]
            rows = [r for b in ngram_jaccard._candidates(50, 8)(batches) for r in b.to_pylist()]
            if probes == 9:
                assert {(r["a"], r["probe"]) for r in rows if r["grp"] is not None} == {(int(x), i < probes) for i, x in enumerate(node[:total])}
            else:
                ids = node[:total].tolist()
                assert {(r["a"], r["b"]) for r in rows} == {(min(p, q), max(p, q)) for p in ids[:probes] for q in ids if p != q}


def test_jaccard_through_a_row_without_id(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(5, " ".join(w)), (None, " ".join(w[3:])), (2, " ".join(w[6:])), (None, " ".join(w[:-2]))]
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=96)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(94, 2), (97, 2), (98, 2), (100, 2)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (60, 61)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 60: 60, 61: 60}


def test_token_counts_and_bpe(spark, docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    a, b = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    rows = [(r.doc_id, r.text or "") for r in both.collect()]
    counted = token_counts.token_counts(both, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = collections.Counter((i, len(t.encode()), len(a.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in counted) == want
    want = collections.Counter()
    for i, t in rows:
        ids = b.encode(t, add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), b.decode(ids, skip_special_tokens=False)] += 1
    coded = bpe.encode(both, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in coded) == want
    model = bpe.Model(public_tokenizers.path("word_bpe_49k.json"))
    assert all(bpe.decode(bytes(r.ids), model) == r.decoded for r in coded)


def test_merges_agree():
    model, r = bpe.Model(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    words = [bytes(r.choice(b"theandinger ") for _ in range(r.randint(1, 300))) for _ in range(400)]
    flat, count = model.merge_many(words)
    assert flat.tolist() == [i for w in words for i in model.merge(w)]
    assert count.tolist() == [len(model._merge_long([*(model.first[b] for b in w[:-1]), model.last[w[-1]]])) for w in words]


def test_url_filters(spark):
    rules = spark.createDataFrame([("com", "/a", "block"), ("x.com", "/a/b", "allow"), ("x.com", "/", "block"), (None, "/", "block"), ("", "", "block")], "host string, path string, action string")
    urls = ["http://x.com/a/bc?q", "https://y.X.com/", "http://com/a", "http://ax.com/a/b", "http://other.org/a", "none", None, "http://x.com", "a://b://com/a"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[0], 1)], "page_id long, url string, host int")
    got = sorted((r.page_id, r.host, r.rule, r.verdict) for r in url_filters.judge(pages, rules.where("host <> ''")).collect() if r.page_id not in (4, 5, 6, 7))
    assert got == [(0, "x.com", "x.com/a/b", "allow"), (0, "x.com", "x.com/a/b", "allow"), (1, "y.x.com", "x.com/", "block"), (2, "com", "com/a", "block"), (3, "ax.com", "com/a", "block"), (8, "b:", None, "allow")]
    lone = spark.createDataFrame([("ÉX.com", "/", "block"), ("Ex.Com", "/", "block")], "host string, path string, action string")
    asked = spark.createDataFrame([(1, "http://a.ÉX.com/"), (2, "http://éx.com/"), (3, "http://EX.cOM/"), (4, None)], "page_id long, url string")
    assert [(r.page_id, r.host, r.rule) for r in url_filters.judge(asked, lone).orderBy("page_id").collect()] == [(1, "a.Éx.com", "ÉX.com/"), (2, "éx.com", None), (3, "ex.com", "Ex.Com/"), (4, "", None)]
    assert {r.verdict for r in url_filters.judge(asked, lone.limit(0)).collect()} == {"allow"} and url_filters.judge(asked.limit(0), lone).count() == 0
    assert op3_url_filters(spark, DIR).count() == spark.read.parquet(f"{DIR}/pages.parquet").count()


@pytest.mark.parametrize("shares, per", [(1, 10**6), (256, 10**6), (4, 20)])
def test_url_filters_of_hot_hosts(spark, shares, per, monkeypatch):
    """Against brute force, with one host in most urls, equal urls, and more rules than a salt should have urls."""
    monkeypatch.setattr(url_filters, "SHARES", shares)
    monkeypatch.setattr(url_filters, "PER", per)
    r = random.Random(4)
    rules = sorted({(".".join(r.choice(("a", "b", "c")) for _ in range(r.randint(1, 3))), "/" + "".join(r.choice("xy") for _ in range(r.randint(0, 3)))) for _ in range(40)})
    rules = [(h, p, r.choice(("allow", "block"))) for h, p in rules]
    urls = [f"http://{'a.b.c' if r.random() < 0.7 else '.'.join(r.choice('abcd') for _ in range(r.randint(1, 4)))}/{''.join(r.choice('xy') for _ in range(r.randint(0, 4)))}" for _ in range(600)]
    out = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, action string"))
    want = {}
    for i, u in enumerate(urls):
        h, _, p = u[7:].partition("/")
        fit = [(len(rh) + len(rp), len(rp), rh + rp, act) for rh, rp, act in rules if (h == rh or h.endswith("." + rh)) and f"/{p}".startswith(rp)]
        want[i] = max(fit)[2:] if fit else (None, "allow")
    assert {x.page_id: (x.rule, x.verdict) for x in out.collect()} == want


def test_language(spark, docs, odd):
    model = language_id.train(docs, ~held_out())
    out = language_id.predict(docs, model, ("doc_id", "lang")).where(held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and not any(r.rejected for r in out)
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language_id.predict(odd, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0, True) and got[4][0] != "und"
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}


def test_language_rejects_noise_and_unlearned_languages(spark):
    import base64

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("text is not null and length(text) >= 64")
    r = random.Random(4)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (100, 400, 2000) for _ in range(20)]
    noise += [base64.b64encode(r.randbytes(300)).decode() for _ in range(20)]
    noise += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。"]
    model = language_id.train(docs, ~held_out())
    assert all(x.rejected for x in language_id.predict(spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string"), model).collect())
    clean = [x.rejected for x in language_id.predict(docs.where(held_out()), model).collect()]
    assert sum(clean) <= 0.02 * len(clean)
    other = [x.rejected for x in language_id.predict(docs.where("lang = 'es'"), language_id.train(docs.where("lang <> 'es'"))).collect()]
    assert sum(other) >= 0.9 * len(other)


def brute_language(model, text):
    """Score and language from plain counts, without the operator's slices and matrices."""
    small = (text or "").encode()
    x = [int(language_id.folded(bytes_np.Texts(np.frombuffer(small, np.uint8), np.array([0]), np.array([len(small)]), 0))[i]) for i in range(len(small))]
    tf = collections.Counter()
    for n in (2, 3):
        for i in range(len(x) - n + 1):
            gram = 0
            for c in x[i : i + n]:
                gram = gram * 256 + c
            if gram:
                tf[(((gram * 2654435761 + n * 40503) & 0xFFFFFFFF) >> 20)] += 1
    v = {k: np.log1p(c) * float(model["idf"][k]) for k, c in tf.items()}
    size = sum(w * w for w in v.values()) ** 0.5
    cosine = [sum(w / size * float(c[k]) for k, w in v.items()) if size else 0.0 for c in model["centroids"]]
    best = int(np.argmax(np.round(cosine, 5)))
    return model["languages"][model["of"][best]], cosine[best]


def test_language_query_on_held_out_rows(spark):
    """The registered query: most held-out languages right, and every score that of a brute-force version."""
    size = "/root/testdata/sf0.1"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{size}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries()["op5_language_id"](spark, size).collect()}
    assert set(got) == set(truth) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    asked = [r for i, r in got.items() if r.held_out and truth[i][0]]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in asked) >= 0.97 * len(asked)
    assert sum(r.rejected for r in asked) <= 0.02 * len(asked) and all(0 <= r.score <= 1 for r in got.values())
    docs = spark.read.parquet(f"{size}/documents.parquet")
    model = language_id.train(docs, ~held_out())
    for i in sorted(truth)[::250]:
        if got[i].lang_pred != "und":
            lang, score = brute_language(model, truth[i][1])
            assert abs(got[i].score - score) < 1e-4 and (got[i].lang_pred == lang or len(truth[i][1]) < 20)


def test_language_sample_is_bounded_and_the_same(spark):
    """Copies count once, however many, and the sample does not depend on how the table is cut."""
    rows = [(i, f"the text number {i} of many in this language", "en") for i in range(400)] + [(1000 + i, "the same text again and again", "en") for i in range(3000)] + [(5000, "un texte", "fr"), (5001, None, "fr"), (5002, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marked = docs.withColumn("hash", F.xxhash64("text")).where("lang is not null and text is not null")
    some = least_hashed(marked, "lang", "hash", 50, 5).collect()
    want = sorted({r.hash for r in marked.where("lang = 'en'").collect()})[:50]
    assert sorted(r.hash for r in some if r.lang == "en") == want and sum(r.lang == "fr" for r in some) == 1
    a, b = (language_id.train(df, sample=50) for df in (docs, docs.repartition(13)))
    assert all(np.array_equal(a[k], b[k]) for k in ("idf", "centroids", "reject"))
    with pytest.raises(ValueError):
        least_hashed(marked, "text", "hash", 5, 3)
    assert least_hashed(marked.limit(0), "lang", "hash", 5, 3).count() == 0


def test_language_ties_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "aba aba aba", "b"), (2, "aba aba aba", "a"), (3, "xyx xyx", "c")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "aba"), (2, "q"), (3, "aba " * 300_000), (3, "aba " * 300_000), (4, "12 34")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(asked, language_id.train(docs)).collect()]
    assert sorted(got) == [(1, "a"), (2, "a"), (3, "a"), (3, "a"), (4, "und")]


def reference_spans(t):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        out += [(m.start(), m.end(), 2)] * (12 <= len(d) <= 19 and pii.luhn(d))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii(spark, docs, odd):
    r = random.Random(2)
    texts = ["".join(r.choice("a.b@-+1234 05.()%_") for _ in range(60)) for _ in range(3000)]
    assert all(reference_spans(x) == [tuple(s) for s in pii.base_spans(x)] for x in texts)
    found = {x.doc_id: x for x in pii.find(odd.where("doc_id is not null")).collect()}
    assert found[0].spans == "" and found[0].redacted is None and found[1].redacted == ""
    assert [found[10][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1] and "x@y.zz" not in found[10].redacted
    spans = list(pii.all_spans(["call me: phone (555) 123-4567, bye", "mail jo.doe (at) example (dot) org now", "we stood at home. there", "order 2020-01-02 12"], pii.trained()))
    assert [len(s) for _, s in spans] == [1, 1, 0, 0]
    beside = "so +1 (269) 555-3296 4524132264652843 it, 4524132264652843 27.65.93.188 was, order 1234567890123456"
    base, every = next(pii.all_spans([beside], pii.trained()))
    assert [beside[s.start : s.end] for s in base] == ["27.65.93.188"]
    assert [beside[s.start : s.end] for s in every] == ["+1 (269) 555-3296", "4524132264652843", "4524132264652843", "27.65.93.188"]


def test_pii_query(spark, docs):
    """The registered query on the whole table: digests of the base spans of a plain scan, all of them among the spans."""
    got = {r.doc_id: r for r in queries()["op7_pii"](spark, DIR).collect()}
    for r in docs.collect():
        base = reference_spans(r.text or "")
        names = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base]
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest() and set(names) <= set(filter(None, row.spans.split(",")))
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(k == x[2] for x in base) for k in range(4)]


def test_pii_recall_on_texts_that_were_not_learned(spark):
    """Base spans of other texts, written another way, are found in their own surroundings; other texts get next to no spans."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = pii.train(docs.where("doc_id % 2 = 0"))
    r, hit, asked = random.Random(9), collections.Counter(), collections.Counter()
    texts = [x.text or "" for x in docs.where("doc_id % 2 = 1").collect()]
    for text in texts:
        for kind, personal, before, body, after in pii.surroundings(text):
            other = pii.written_otherwise(kind, body, r) if personal else None
            if other:
                asked[kind] += 1
                spans = next(pii.all_spans([before + other + after], model))[1]
                hit[kind] += any(s.start < len(before) + len(other) and len(before) < s.end for s in spans)
    assert all(asked[k] >= 20 and hit[k] >= 0.9 * asked[k] for k in range(4)), (hit, asked)
    added = sum(len(every) - len(base) for base, every in pii.all_spans(texts, model))
    assert added <= 0.005 * len(texts)


def test_pii_sample_is_the_same_and_may_be_empty(spark, docs):
    a, b = (pii.train(df) for df in (docs, docs.repartition(7)))
    assert a[1] == b[1] and a[0].trees == b[0].trees
    assert pii.train(docs.limit(0)) is pii.plain() and pii.train(spark.createDataFrame([(1, None), (2, "no digits")], "doc_id long, text string")) is pii.plain()


def test_pii_in_a_text_of_many_numbers():
    """Overlaps are looked up in order: time grows with the number of spans, not with its square."""
    text = " ".join(f"+1 (269) 555-{i:04d}, {i:03d}-555-{i:04d} tel" for i in range(20_000))
    began = time.time()
    base, every = next(pii.all_spans([text], pii.plain()))
    assert len(base) >= 19_000 and time.time() - began < 20
    got = pii.Covered([(5, 9), (1, 3), (2, 4), (20, 30)])
    assert [got.meets(a, b) for a, b in ((0, 1), (3, 4), (4, 5), (8, 12), (9, 20), (19, 21), (30, 31))] == [False, True, False, True, False, True, False]
    got.add(9, 12)
    assert got.meets(11, 12) and not got.meets(12, 20)


def test_quality(spark, docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10_000_000))
    got = {r.doc_id: r for r in quality_rules.apply_policy(quality_rules.ledger(both)).collect()}
    for x in both.collect():
        t = x.text or ""
        w = re.findall(r"[^ \t-\r]+", t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [line for line in t.split("\n") if re.search(r"[^ \t-\r]", line)]
        r = got[x.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.kept and r.base_failed)
    rules = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(both)).collect()}
    for version, names in quality_rules.POLICIES.items():
        some = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(both), version).collect()}
        failed = [{n for n in names if r.failed >> quality_rules.RULES.index(n) & 1} for r in quality_rules.ledger(both).collect()]
        assert {n: (r.n_failed, r.n_only, r.n_kept_without) for n, r in some.items()} == {n: (sum(n in f for f in failed), sum(f == {n} for f in failed), sum(f <= {n} for f in failed)) for n in names}
    assert set(rules) == set(quality_rules.POLICIES[quality_rules.CURRENT])
    assert {(r.n_failed, r.n_only, r.n_kept_without) for r in quality_rules.ablations(quality_rules.ledger(both.limit(0))).collect()} == {(0, 0, 0)}


def test_toxicity(spark):
    r = random.Random(3)
    bad, good = ("zorgle", "fribbit", "quaxnik"), ("apple", "river", "stone", "cloud", "green", "paper")
    rows = [(i, " ".join(r.choice(good) for _ in range(30)) + (" " + r.choice(bad) + " " + r.choice(good)) * (i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.train(docs, labels, ~held_out())).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows) and got[9999] < 0.3
    flat = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(x.score < 0.3 for x in toxicity.score(docs, flat).collect())


def test_toxicity_query_on_held_out_rows(spark):
    """The registered query at its threshold, and every score that of a brute-force version."""
    size = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries()["op9_toxicity"](spark, size).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{size}/labels.parquet").collect()}
    asked = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and labels.get(i) is not None]
    caught, told = sum(y and p for y, p in asked), sum(p for _, p in asked)
    assert caught >= 0.9 * sum(y for y, _ in asked) and caught >= 0.85 * told, (caught, told, sum(y for y, _ in asked))
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    docs = spark.read.parquet(f"{size}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{size}/labels.parquet"), ~held_out())
    again = {r.doc_id: r.score for r in toxicity.score(docs.repartition(5), model).collect()}
    assert again == {i: r.score for i, r in got.items()}
    for r in docs.where("doc_id % 200 = 0").collect():
        raw = (r.text or "").encode()
        x = language_id.folded(bytes_np.Texts(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), 0)).tolist()
        grams = set()
        for n in toxicity.SIZES:
            for i in range(len(x) - n + 1):
                g = 0
                for c in x[i : i + n]:
                    g = g << 8 | c
                grams.add((((g * 0x9E3779B97F4A7C15 + n) & (2**64 - 1)) * 0xD6E8FEB86659FD93 & (2**64 - 1)) >> (64 - toxicity.BITS))
        total = sum(float(model["weights"][g]) for g in grams) + model["bias"]
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(total, -50, 50)))) < 1e-4


def test_toxicity_of_long_texts_ties_and_repeated_ids(spark):
    docs = spark.createDataFrame([(i, f"{'zorgle frib' if i % 2 else 'apple tree'} number {i}") for i in range(60)] + [(1, "apple tree again")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    asked = spark.createDataFrame([(1, "zorgle frib " * 100_000), (2, "apple tree " * 100_000), (3, "apple tree"), (3, "apple tree"), (None, "zorgle frib")], "doc_id long, text string")
    got = [(r.doc_id, r.score) for r in toxicity.score(asked, model).collect()]
    assert len(got) == 5 and got[0][1] > 0.5 > got[1][1] and got[2] == got[3] and got[4][1] > 0.5


def test_decontamination(spark, docs, odd):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(900, "a b c"), (901, None), (902, "")], "item_id long, text string"))
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10_000_000))
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
    at = {}
    for r in items.collect():
        w = words(r.text)
        for s in range(max(len(w) - 9, min(len(w), 1))):
            at.setdefault(tuple(w[s : s + 10]), set()).add(str(r.item_id))
    sizes, want = {len(k) for k in at}, collections.Counter()
    for r in both.collect():
        w, found = words(r.text), set()
        hit = [0] * len(w)
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in at:
                    found |= at[tuple(w[s : s + n])]
                    hit[s : s + n] = [1] * n
        want[r.doc_id, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()] += 1
    got = decontamination.contamination(both, items).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    near = decontamination.find(spark.createDataFrame([(1, "c x a y b"), (2, "a b z z z z z z z z z z c")], "doc_id long, text string"), items.where("item_id = 900"), slop=2).collect()
    assert {r.doc_id: ([tuple(x) for x in r.near], r.n_hit) for r in near} == {1: ([("900", 0, 5)], 0), 2: ([], 0)}


@pytest.mark.parametrize("part", [8 << 20, 40])
def test_proximity(spark, part, monkeypatch):
    """Spans that hold the words of a window in any order, each as often, and hits of items without an id, against brute force."""
    r = random.Random(3)
    some = lambda lo, hi: " ".join(r.choice("abcdefgh") for _ in range(r.randint(lo, hi)))
    docs = [(i, some(0, 30)) for i in range(300)]
    items = [(k, some(1, 7)) for k in range(12)] + [(None, "a b c d e"), (3, "h h h")]
    monkeypatch.setattr(decontamination, "PART", part)
    want = {}
    for i, text in docs:
        w, best, found, hit = text.split(), {}, set(), set()
        for k, x in ((k, t.split()) for k, t in items):
            for win in (x[s : s + 5] for s in range(max(len(x) - 4, 1))):
                need = collections.Counter(win)
                for a in range(len(w)):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        found |= {str(k)} - {"None"}
                    ends = [b for b in range(a + len(win), min(len(w), a + len(win) + 2) + 1) if not need - collections.Counter(w[a:b])]
                    if ends and k is not None:
                        best[str(k)] = min(best.get(str(k), (99, 0)), (ends[0] - a, a))
        want[i] = (len(w), len(hit), sorted(found), sorted((k, s, m) for k, (m, s) in best.items()))
    out = decontamination.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=5, slop=2)
    assert {x.doc_id: (x.n_words, x.n_hit, sorted(set(x["items"])), sorted(map(tuple, x.near))) for x in out.collect()} == want


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_that_collide_by_their_form(spark, n):
    """Words that every polynomial hash modulo 2 ** 64 takes for the same are different to both operators."""
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b} c"), (4, f"{b} {a} c"), (5, a.upper())], "doc_id long, text string")
    got = decontamination.contamination(docs, spark.createDataFrame([(9, a)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_hit, r.contaminated, r.n_near) for r in got} == {1: (1, True, 1), 2: (0, False, 0), 3: (1, True, 1), 4: (1, True, 1), 5: (1, True, 1)}
    groups = ngram_jaccard.jaccard_components(docs, width=2, percent=85).collect()
    assert {r.doc_id: r.component_id for r in groups} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_words_decide_where_hashes_collide(monkeypatch):
    """Texts whose words all share one hash are still told apart: by their bytes in the vocabulary, as words in the sets."""
    texts = ["a b c d e f", "a b c d e g", "x y z u v w", "A B C D E F h", "", "a b"]
    col = pa.array(texts)
    monkeypatch.setattr(bytes_np.Texts, "hashes", lambda self, s, e, fold=None, seed=0: (np.zeros(len(s), np.uint64) if seed < 3 else (self.data[s] | 32).astype(np.uint64) * np.uint64(2**40)))
    vocabulary = bytes_np.Vocabulary([b"a", b"x", b"w", b"h"])
    t = next(bytes_np.slices(col))
    starts, ends = t.words(bytes_np.NOT_BLANK)
    place, word = vocabulary.find(t, starts, ends)
    assert vocabulary.seed == 3 and [chr(t.data[starts[p]] | 32) for p in place] == list("aaxwaha")
    assert len(word) == len(place)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    batch = pa.record_batch([pa.array([i for i, _ in pairs]), pa.array([j for _, j in pairs]), pa.array([texts[i] for i, _ in pairs]), pa.array([texts[j] for _, j in pairs])], ["a", "b", "x", "y"])
    sets = [shingles(x, 1) for x in texts]
    linked = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])}
    assert not ngram_jaccard.Shingles(t, 1, 0).told_apart()
    got = [tuple(r.values()) for out in ngram_jaccard._true_pairs(70, 1, 0)([batch]) for r in out.to_pylist()]
    assert set(got) == linked == {(1, 0), (3, 0)}
    table = pa.table({"node": pa.array([*range(6), 0]), "text": pa.array([*texts, texts[0]])})
    edges = ngram_jaccard._block_links(70, 1, 0)(table).to_pylist()
    assert len(edges) == 2 and all((max(e.values()), min(e.values())) in linked for e in edges)


def test_decontamination_in_parts(spark, docs, odd, monkeypatch):
    """Windows of two parts that overlap in a document, an id in both, and a text longer than a part: as in one part."""
    mine = [(900, "a b c"), (901, None), (902, "b c d e"), (900, "d e f g"), (903, "z " * 3000)]
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame(mine, "item_id long, text string"))
    texts = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(77, "x a b c d e f g y"), (78, "z " * 12)], "doc_id long, text string"))
    rows = lambda: sorted(map(repr, decontamination.find(texts, items, slop=2).collect()))
    whole = rows()
    assert any("doc_id=77, n_words=9, n_hit=7, items=['900', '900', '902']" in x for x in whole)
    monkeypatch.setattr(decontamination, "PART", 400)
    assert rows() == whole


def test_odd_and_empty_tables(spark, odd):
    for df, n in ((odd, 13), (odd.limit(0), 0)):
        assert ngram_jaccard.jaccard_components(df).count() == n
        assert quality_rules.ledger(df).count() == n
        assert language_id.predict(df, language_id.train(df)).count() == n
        assert decontamination.find(df, spark.createDataFrame([], "item_id long, text string")).count() == n
        assert pii.find(df).count() == n
    got = {r.doc_id: r for r in ngram_jaccard.jaccard_components(odd).collect()}
    assert got[0].component_id == 0 and got[0].n_shingles == 0 and got[9].component_id == 8 and got[None].n_shingles == 1


def test_odd_tables_of_the_other_operators(spark, odd):
    """Extra columns with clashing names, a null id, repeated ids and no rows: every row comes back, null texts as empty ones."""
    path = public_tokenizers.path
    odd = odd.withColumns({"toxic": F.lit("x"), "score": F.lit(0), "grams": F.lit(1), "ids": F.lit(1), "host": F.lit(1), "rule": F.lit(1), "html": F.col("text"), "url": F.col("text"), "page_id": F.col("doc_id")})
    labels = spark.createDataFrame([(3, 1, "a"), (3, 0, "b"), (4, None, "c"), (None, 1, "d"), (5, 7, "e")], "doc_id long, toxic int, text string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, action string")
    for df, n in ((odd, 13), (odd.limit(0), 0)):
        counts = token_counts.token_counts(df, path("byte_bpe_50k.json"), 512).collect()
        coded = bpe.encode(df, path("word_bpe_49k.json"), texts=False).collect()
        pages = html_extract.extract(df).collect()
        judged = url_filters.judge(df, rules).collect()
        scored = toxicity.score(df, toxicity.train(df, labels)).collect()
        assert {len(x) for x in (counts, coded, pages, judged, scored)} == {n}
        assert all(r.n_tokens == 0 for x in (counts, coded) for r in x if r.doc_id in (0, 1))
        assert all(r.text == "" and r.n_chars == 0 for r in pages if r.page_id in (0, 1)) and all(r.verdict == "allow" for r in judged)
        assert all(0 <= r.score <= 1 for r in scored)


def test_pipeline_stages_on_odd_tables(spark, odd):
    import corpus_pipeline

    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, DIR)
            assert out.count() <= df.count()
            assert name == "bpe" or out.columns == list(corpus_pipeline.COLUMNS)
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, odd, DIR).collect()}
    assert {0, 1, 2, 8} <= kept and 9 not in kept


def test_pipeline_judges_rows_one_by_one(spark):
    """Rows without an id, and rows that share one, go for what they are themselves."""
    import corpus_pipeline

    item = next(r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() if len(re.findall(r"\w+", r.text)) >= 10)
    mine = " ".join(f"word{i}" for i in range(60))
    rows = [(None, f"before {item} after"), (1, f"see {item}"), (1, "nothing of it"), (2, "nothing of it either"), (None, mine), (7, mine), (5, mine + " more"), (None, mine), (5, "another text"), (None, "x y z"), (None, "X Y Z"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda df: sorted((repr(r.doc_id), repr(r.text)) for r in df.collect())
    clean = [(i, t) for i, t in rows if not t or item not in t]
    assert left(corpus_pipeline.drop_contaminated(spark, docs, DIR)) == sorted((repr(i), repr(t)) for i, t in clean)
    kept = collections.Counter((r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, DIR).collect())
    assert kept == {(1, f"see {item}".lower()): 1, (1, "nothing of it"): 1, (2, "nothing of it either"): 1, (5, mine + " more"): 1, (5, "another text"): 1, (None, "x y z"): 1, (None, ""): 2}


def test_registered_queries(spark, docs):
    """The columns of the registered queries on the whole table, beside those that other tests look at."""
    q = queries()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in q["op1_ngram_jaccard"](spark, DIR).collect()} == brute_components(rows, 4, 85)
    a, b = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    counts = {r.doc_id: r for r in q["op2_token_counts"](spark, DIR).collect()}
    coded = {r.doc_id: r for r in q["op6_bpe"](spark, DIR).collect()}
    quality = {r.doc_id: r for r in q["op8_quality_rules"](spark, DIR).collect()}
    for i, text in rows:
        text = text or ""
        n = len(a.encode(text, add_special_tokens=False).ids)
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(text.encode()), n, n > 512)
        ids = b.encode(text, add_special_tokens=False).ids
        assert coded[i].n_tokens == len(ids) and coded[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(b.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        w, r = re.findall(r"[^ \t-\r]+", text), quality[i]
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w)) and not (r.kept and r.base_failed)
    hits = {r.doc_id: r for r in q["op10_decontamination"](spark, DIR).collect()}
    assert len(hits) == len(rows) and all(r.contaminated == (r.n_hit > 0) == (r.n_items > 0) and r.n_near >= r.n_items for r in hits.values())
    pages = {r.page_id: r for r in q["op4_html_extraction"](spark, DIR).collect()}
    assert all(r.n_chars == len(r.text) > 0 for r in pages.values())


def test_pipeline(spark, docs):
    import corpus_pipeline

    out = [r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    keep = {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(LOW))
    windows = {tuple(w[s : s + 10]) for w in map(words, items) for s in range(max(len(w) - 9, 1))}
    dirty = {i for i, t in rows for w in [words(t)] if any(tuple(w[s : s + 10]) in windows for s in range(len(w)))}
    assert sorted(out) == sorted(keep - dirty)
    coded = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DIR).collect()}
    clean = pii.find(docs.where(F.col("doc_id").isin(out)), model=pii.train(docs.where(F.col("doc_id").isin(out))))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in clean.collect():
        ids = tokenizer.encode(r.redacted, add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert coded[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert not r.spans or r.redacted != docs.where(F.col("doc_id") == r.doc_id).first().text


def test_names():
    assert {n.split("_")[0] for n in queries()} == {f"op{n}" for n in range(1, 11)} | {"pipeline"}

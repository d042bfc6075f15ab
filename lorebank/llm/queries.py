"""The thin queries over the driver's tables: each applies one operator to a whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import domain
from ..sources.scratch import place
from . import bpe, decontamination, html_extract, id_files, language_id, lexical_search, ngram_jaccard, pii, quality_rules, resampling, token_counts, toxicity, url_filters

#: The url rules of the contract.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Score from which a text counts as toxic.
TOXIC = 0.3


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return domain.spread(domain.table(spark, sf_dir, table))


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that are kept out of training."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_read(spark, sf_dir, "documents"), width=4, percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filters.judge(_read(spark, sf_dir, "pages"), rules)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs, ~held_out())
    return language_id.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), texts=False)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = pii.find(docs, model=pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(_read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), buckets=10_000, low=1, high=1, percent=10, least_words=20, seed=2024)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"), 10)


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    store = id_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), place(spark, "id-files"), end=1)
    return id_files.read_digests(store, docs.select(F.col("doc_id").cast("long").alias("key")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_ngram_jaccard, op2_token_counts, op3_url_filters, op4_html_extraction, op5_language_id, op6_bpe, op7_pii, op8_quality_rules, op9_toxicity, op10_decontamination,
        op11_importance_resampling, op12_lexical_search, op13_id_files, pipeline,
    )
    return {f.__name__: f for f in ops}


#: Words of letters, digits and non-ASCII characters, A-Z as a-z.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

ORACLE = {
    "op3_url_filters": f"""
WITH rules(rh, rp, action) AS (VALUES {_RULE_ROWS}),
urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
fit AS (
  SELECT u.page_id, u.host, u.path, r.rh || r.rp AS rule, r.action, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rh) + length(r.rp) DESC NULLS LAST) AS n
  FROM urls u LEFT JOIN rules r ON (u.host = r.rh OR suffix(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE n = 1
""",
    "op8_quality_rules": r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t-\r]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM base),
grams AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
keyed AS (SELECT doc_id, i, array_to_string(words[i:i + 4], chr(10)) AS g FROM grams),
twice AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM w LEFT JOIN cover USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 50 * n_words OR (n_dup_lines >= 3 AND 100 * n_repeat_words > 15 * n_words)
            OR word_chars > 20 * n_words OR 100 * n_upper > 60 * word_chars) AS kept
FROM m
""",
    "op11_importance_resampling": f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
source AS (SELECT r, unnest(ws) AS w FROM d),
target AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
vocabulary AS (SELECT w, hex(w) AS h FROM (SELECT w FROM source UNION SELECT w FROM target)),
bytes AS (SELECT w, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM vocabulary),
hashed AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM source JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM source) + 10000 AS s, (SELECT count(*) FROM target) + 10000 AS t),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * sums.s::DOUBLE / ((s.n + 1)::DOUBLE * sums.t::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM source JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
noise AS (SELECT r, floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS g FROM d),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + g AS score FROM d JOIN noise USING (r) LEFT JOIN weights USING (r)),
ranked AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank FROM ranked
""",
    "op12_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
sizes AS (SELECT r, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
total AS (SELECT count(*)::BIGINT AS n, coalesce(sum(n), 0)::BIGINT AS l FROM sizes),
postings AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
df AS (SELECT w, floor(1000 * ln((2 * total.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM postings, total GROUP BY w, total.n),
items AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS ws FROM benchmark),
asked AS (SELECT q, w, count(*) AS times FROM (SELECT q, unnest(ws) AS w FROM items) GROUP BY ALL),
scores AS (
  SELECT q, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * sizes.n * total.n) // total.l))))::BIGINT AS score
  FROM asked JOIN postings USING (w) JOIN df USING (w) JOIN sizes USING (r), total GROUP BY q, r),
best AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank FROM scores JOIN sizes USING (r) JOIN items USING (q) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 10
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

"""A training corpus from ``documents``: known language, one of each group of near copies, no benchmark text, no personal data, encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank.llm import bpe, decontamination, language_id, ngram_jaccard, pii
from lorebank.llm.queries import held_out
from lorebank.sources import domain
from lorebank.sources.scratch import folder, written

#: SQL cannot express the stages; tests hold them against brute-force versions. The driver's contract reads this name.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A name for the key of a row, which no column of documents has.
ROW = "__row"


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The columns of documents with a key for each row: doc_id where it is one; else a number, in a written copy, so that it stays."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if not odd.limit(1).count():
        return docs.select(*COLUMNS, F.col("doc_id").cast("long").alias(ROW))
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)), name)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the nearest centroid knows; noise and texts of other languages go, as far as their length tells.

    Null, empty and letterless texts go. Each row is judged by its text alone, so rows with the same text stay or go
    alike, whatever their id. Centroids that are equally near give the first language in order. Very long texts are read
    whole. Without labelled texts no language is known and all go; an empty table stays empty.
    """
    model = language_id.train(docs, ~held_out())
    return language_id.predict(docs, model, COLUMNS).where("not rejected").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8 or more: that with the least id.

    Rows are judged one by one: rows that share an id need not be copies, and copies without an id go if one with an id
    stays. Of copies with equal ids, or with none, one stays. A row without words has no copies and stays. Very long
    texts are compared whole; an empty table stays empty.
    """
    keyed = _keyed(docs, "keyed")
    groups = ngram_jaccard.jaccard_components(keyed, ROW, width=5, percent=80).select(F.col("doc_id").alias(ROW), "component_id")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    kept = keyed.select("doc_id", ROW).join(groups, ROW).groupBy("component_id").agg(F.min(rank).alias("x")).select(f"x.{ROW}")
    return keyed.join(kept, ROW, "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten benchmark words.

    Rows are judged one by one, with or without an id, and rows that share one by their own texts. A null or empty text
    has no window and stays, and so does every row if no test text has words. Very long texts are read whole; an empty
    table stays empty.
    """
    keyed = _keyed(docs, "rows")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontamination.find(keyed.select(F.col(ROW).alias("doc_id"), "text"), items, width=10).where("n_hit > 0")
    return keyed.join(hit.select(F.col("doc_id").alias(ROW)), ROW, "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and n_chars counted anew.

    Rows stay as they are, repeated or not, with or without an id. A null text stays null, with no characters; overlapping
    spans are replaced as one. Very long texts are read whole; an empty table stays empty.
    """
    found = pii.find(docs, ("doc_id", "lang", "source"), pii.train(docs))
    text = F.col("redacted")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text that they decode to, for each row.

    A null or empty text has no ids. Repeated rows, and rows without an id, come out as often. Of merges of the same rank
    the first in the word is made first. Very long texts are read whole; an empty table stays empty.
    """
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), texts=False)


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each but the last gives is written in the shared folder and read again."""
    folder(spark)
    docs = domain.spread(domain.table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

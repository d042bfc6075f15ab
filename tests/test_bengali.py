"""The queries over facts and turns, against their oracles, on Bengali and mixed texts, which the driver's tables do not have."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lorebank.functions import text as T
from lorebank.functions import wordlists as L
from lorebank.operators import metrics
from lorebank.plans import registry
from lorebank.sources import domain as D

from .test_oracles import DIR, TABLES, plain

TEXTS = (
    "১৯৭১ সালে বাংলাদেশ স্বাধীন হয় এবং ঢাকা দেশের রাজধানী হয়। পদ্মা নদী বাংলাদেশের একটি প্রধান নদী ছিল বলে জানা যায়।",
    "আচ্ছা ভাই, বঙ্গবন্ধু শেখ মুজিবুর রহমান কে ছিলেন এবং তিনি কবে জন্মগ্রহণ করেন? বাংলাদেশের প্রথম প্রধানমন্ত্রী কে ছিলেন তা বলুন।",
    "The Padma Bridge বাংলাদেশের দীর্ঘতম সেতু and it was opened in 2022 for all traffic. সুন্দরবন পৃথিবীর বৃহত্তম ম্যানগ্রোভ বন হিসেবে অবস্থিত ও পরিচিত।",
    "রাষ্ট্রপতি ও প্রধানমন্ত্রী সংসদে নতুন আইন নিয়ে আলোচনা করেছেন, যা গুরুত্বপূর্ণ। ভাষা আন্দোলন ১৯৫২ সালের ফেব্রুয়ারি মাসে ঢাকা শহরে সংগঠিত হয়েছে।",
    "জাতিসংঘ ও বিশ্ব ব্যাংক বাংলাদেশের অর্থনীতি নিয়ে একটি চুক্তি করেছে! বাজেট ৫০০ কোটি টাকা, ৩০ শতাংশ বৃদ্ধি পেয়েছে এবং আমদানি কমেছে।",
    "Who was কাজী নজরুল ইসলাম and when was he born in the district? রবীন্দ্রনাথ ঠাকুর সাহিত্যে নোবেল পুরস্কার পান ১৯১৩ সালে প্রথম এশীয় হিসেবে।",
    "ঢাকা কোথায় অবস্থিত এবং এর জনসংখ্যা কত তা কি জানেন? কেন ও কীভাবে মেট্রো রেল চালু হয়েছে এবং কত কিলোমিটার দীর্ঘ সেটি।",
    "এটি ছোট। “উদ্ধৃতি” – চিহ্ন ও ‘একক’ চিহ্ন সহ একটি বাক্য এখানে আছে॥ আর কিছু নেই এখানে বলার মতো সত্যিই।\nনতুন লাইনে আরও একটি সম্পূর্ণ বাক্য লেখা হয়েছে এখানে।",
)


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("bengali")
    for t in TABLES:
        if t not in ("documents", "conversations"):
            os.symlink(f"{DIR}/{t}.parquet", at / f"{t}.parquet")
    docs = [(i, t, "bn" if i % 3 else "en", f"src{i * 3}", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(at / "documents.parquet"))
    turns = [(i, k, ("user", "assistant", "system")[k % 3], t) for i, t in enumerate(TEXTS) for k in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(at / "conversations.parquet"))
    return str(at)


@pytest.fixture(scope="module")
def duck(place):
    con = duckdb.connect()
    for t in TABLES:
        files = f"{place}/{t}.parquet/*.parquet" if os.path.isdir(f"{place}/{t}.parquet") else f"{place}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, sql in registry.ORACLES.items() if "documents" in sql or "conversations" in sql))
def test_oracle_on_bengali(spark, duck, place, name):
    df = registry.QUERIES[name](spark, place)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = duck.execute(registry.ORACLES[name])
    order = [c[0] for c in cur.description]
    assert sorted(order) == names
    assert got == sorted(tuple(plain(r[order.index(c)]) for c in names) for r in cur.fetchall())


def test_whole_words_are_those_of_python(spark):
    texts = [*TEXTS, "কেন কে", "কীসের কী", "prime minister", "Prime  Minister", "x_who", "who?", "কোন জায়গায় যাবে", "MAY", "may"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    lists = [L.WHO_TAGS, L.WHEN_TAGS, L.WHERE_TAGS, L.NUMERIC_TAGS, L.ASSERTION_VERBS, *(ws for _, ws in L.QUESTION_TYPES)]
    got = rows.select("t", *[T.has_word(F.col("t"), ws).alias(str(i)) for i, ws in enumerate(lists)]).collect()
    for r in got:
        assert [r[str(i)] for i in range(len(lists))] == [re.search(r"\b(?:" + "|".join(ws) + r")\b", r.t.lower()) is not None for ws in lists], r.t


def test_structure_of_bengali_is_not_flat(spark, place):
    assert D.scored_facts(spark, place).select("structure").distinct().count() >= 3


def test_historical_patterns_of_bengali(spark):
    def share(*texts):
        return metrics.historical_patterns(spark.createDataFrame([(t,) for t in texts], "text string")).first().value

    seventh = round(1 / 7, 4)
    assert share("কখন") == share("এটা কখন?") == share("কেন") == share("কীসের") == seventh  # a word end after a vowel sign stands before a letter alone
    assert share("কে?") == share("এ কী") == share("লেখক") == share() == 0.0
    assert share("১৯৭১ সালে", "কোথায়") == round(2 / 7, 4) and share("in ১৯৭১ .") == seventh


def test_every_sentence_is_a_fact(spark, tmp_path):
    long = " ".join(f"This is the sentence with the number {i} of them." for i in range(150))
    docs = spark.createDataFrame([(1, long, "en", "src1", 1), (2, long, "en", "src2", 1), (None, long, "en", "src3", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = [r.fact_id for r in D.facts(spark, str(tmp_path)).where(F.col("fact_id").isNotNull()).collect()]
    assert len(ids) == len(set(ids)) == 300 and {i.split("-")[0] for i in ids} == {"1", "2"}
    assert D.facts(spark, str(tmp_path)).count() == 450

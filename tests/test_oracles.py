"""Every registered query of the library against its oracle, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lorebank.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = duck.execute(registry.ORACLES[name])
    order = [c[0] for c in cur.description]
    assert sorted(order) == names
    assert got == sorted(tuple(plain(r[order.index(c)]) for c in names) for r in cur.fetchall())


def test_greedy_merge_equals_the_walk(spark):
    import random

    from lorebank.operators.similarity import greedy_merge

    r = random.Random(5)
    pairs = sorted({tuple(sorted(r.sample(range(14), 2))) for _ in range(30)})
    score = {i: float(r.randint(0, 3)) for i in range(14)}
    gone, want = set(), set()
    for i, j in pairs:
        if i not in gone and j not in gone:
            x = i if score[j] > score[i] else j
            gone.add(x)
            want.add((i + j - x, x))
    out = greedy_merge(spark.createDataFrame(pairs, "i long, j long"), spark.createDataFrame(list(score.items()), "id long, score double"))
    assert {(x.kept, x.removed) for x in out.collect()} == want


def test_merge_of_many_copies(spark):
    """More copies than the walk once had rounds, with equal and with other scores, beside near ones."""
    import random

    from lorebank.operators import similarity as S

    r = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(r.sample(words, 40)) for _ in range(240)] + [" ".join(words[k:] + [f"x{k}"]) for k in range(8)] + ["", None, "alone"]
    r.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = sorted((x.i, x.j) for x in S.near_pairs(rows).collect())
    members, near = S.near_classes(rows)
    assert S.count_pairs(members, near).first().f == len(pairs) > 240 * 239 // 2
    for score in ({i: 1.0 for i in range(len(texts))}, {i: float(r.randint(0, 3)) for i in range(len(texts))}):
        gone, want = set(), set()
        for i, j in pairs:
            if i not in gone and j not in gone:
                x = i if score[j] > score[i] else j
                gone.add(x)
                want.add((i + j - x, x))
        scores = spark.createDataFrame(list(score.items()), "id long, score double")
        assert {(x.kept, x.removed) for x in S.merge_classes(members, near, scores).collect()} == want
    assert S.greedy_merge(spark.createDataFrame(pairs, "i long, j long"), scores).count() == len(want)


def test_bank(spark, tmp_path):
    from lorebank.sources.bank import scan_json_bank

    (tmp_path / "a.json").write_text('{"metadata": {}, "questions": [{"id": "1", "question_bn": "ক?", "topic": ""}, {"id": "2"}]}')
    (tmp_path / "b.json").write_text('[{"text": "x", "topic": "History"}]')
    (tmp_path / "c.json").write_text("not json")
    assert {(r.text, r.topic) for r in scan_json_bank(spark, str(tmp_path)).collect()} == {("ক?", "General"), ("x", "History")}


def test_streams(spark, tmp_path):
    from lorebank.sources import domain as D
    from lorebank.streaming.limits import latency_stream, ratings_stream

    for name, df, make in (("ratings", D.feedback(spark, DIR), ratings_stream), ("latency", D.run_log(spark, DIR), latency_stream)):
        df.write.parquet(str(tmp_path / name))
        schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
        q = make(spark, str(tmp_path / name), schema).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).agg({"n": "sum"}).first()[0] == df.count()


def test_the_questions_decide_something(spark, duck):
    """Each code, and scores below, on and above each bound, occur; and a bound that moves changes what the queries give."""
    from pyspark.sql import functions as F

    from lorebank.plans.mcq_queries import graded
    from lorebank.sources import domain as D

    rows = graded(spark, DIR.replace("sf0.001", "sf0.01")).select("*", F.round("quality", 9).alias("q")).collect()
    assert {c for r in rows for c in r.codes} == {"FORMAT_ERROR", "DUPLICATE_OPTIONS", "WRONG_GROUNDING", "WEAK_DISTRACTORS"}
    for name, bound in (("q", 0.70), ("grounding", 0.80), ("distractor", 0.55), ("format", 0.50)):
        assert {(r[name] > bound) - (r[name] < bound) for r in rows} == {-1, 0, 1}, name
    assert {r.passed for r in rows} == {True, False} and any(r.passed and r.q == 0.70 for r in rows)
    for name, a, b in (
        ("mcq_pass", "0.70", "0.701"), ("mcq_pass", "grounding >= 0.80", "grounding > 0.80"), ("failed_fact_ids", "0.70", "0.72"), ("batch_quality_report", "0.70", "0.72"), ("topic_pass_rate", "0.70", "0.75"),
        ("difficulty_pass_rate", "0.70", "0.75"), ("m_ga", "0.80", "0.801"), ("m_msv", "0.5", "0.501"), ("failure_codes", "< 0.55", "<= 0.55"), ("generation_result", "0.7", "0.72"), ("pending_facts", "0.70", "0.75"),
    ):
        body = registry.ORACLES[name].removeprefix("WITH ")
        tables = [D.CTE[t] for t in ("episodes", "mcqs") if D.CTE[t] in body]
        rest = body[len(",\n".join(tables)) :]
        moved = "WITH " + ",\n".join(tables) + rest.replace(a, b)
        assert rest.replace(a, b) != rest and sorted(map(repr, duck.execute(moved).fetchall())) != sorted(map(repr, duck.execute(registry.ORACLES[name]).fetchall())), name


def test_facts_of_documents_with_64_bit_ids(spark, tmp_path):
    """Every query over facts runs over documents whose ids are hashes, and gives as many rows as over small ids."""
    from pyspark.sql import functions as F

    from lorebank.sources import domain as D

    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(30)
    for t in TABLES:
        spark.read.parquet(f"{DIR}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs.withColumn("doc_id", F.xxhash64("doc_id")).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/small/documents.parquet")
    ids = D.facts(spark, str(tmp_path)).select("fact_id", D.document_of(F.col("fact_id")).alias("d"), D.place_of(F.col("fact_id")).alias("p"))
    assert {r.d for r in ids.collect()} <= {r.x for r in docs.select(F.xxhash64("doc_id").alias("x")).collect()} and ids.agg(F.min("p")).first()[0] == 1
    assert min(r.d for r in ids.collect()) < -(2**60) and ids.count() == D.facts(spark, f"{tmp_path}/small").count()
    for name in ("facts_quality_topk", "graph_build", "add_questions", "merge_nodes", "deduplication_report", "m_fus", "m_jas", "topk_facts", "dedup_exact", "crj_round"):
        assert registry.QUERIES[name](spark, str(tmp_path)).collect(), name

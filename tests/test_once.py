"""What a step computes once, and letters whose capital Java writes with several."""

from pyspark.sql import functions as F

from lorebank.functions import text as T
from lorebank.plans import registry

DIR = "/root/testdata/sf0.001"


def test_capitals(spark):
    texts = ["ßau der da.", "ῃ so da.", "ŉ so da.", "été ici.", "ﬁ da."]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.refine_text(F.col("t"))).collect()]
    assert got == ["ẞau der da.", "ῌ so da.", "ŉ so da.", "Été ici.", "ﬁ da."]


def test_boundaries(spark):
    """Words that end in a vowel sign are bounded by a word character after it, others by none."""
    texts = ["the first.", "thefirst", "first_", "1first", "কে", "কেক", "ককেক", "কে ক", "x সনে", "সন", "x সন", "সনক", "prime minister!", "prime ministers"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.has_word(F.col("t"), ("first", "কে", "সন", "prime minister"))).collect()]
    assert got == [True, False, False, False, False, True, False, False, True, True, True, False, True, False]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_scored_once(spark):
    assert plan(registry.QUERIES["detect_language"](spark, DIR)).count("[^A-Za-z]") == 1
    assert plan(registry.QUERIES["intent_classify"](spark, DIR)).count("(?:why|") <= 1
    for name in ("fact_verdict", "fact_action", "topk_facts", "mcq_readiness", "facts_by_topic_ready", "quality_report_groups", "quality_pipeline_summary"):
        p = plan(registry.QUERIES[name](spark, DIR))
        again = 2 if name in ("fact_action", "facts_by_topic_ready", "quality_pipeline_summary") else 1  # as it is and as refined
        assert p.count("established") <= again and p.count("prime minister|") <= 1, name


def test_best_facts_are_found_once(spark):
    """A count of the facts that are read for all levels: each of them once."""
    from lorebank.operators import loop
    from lorebank.operators.model import Caller, Throttle

    read = spark.sparkContext.accumulator(0)

    def seen_row(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    facts = spark.createDataFrame([(f"1-{i}", f"fact {i} is long enough.", i / 100) for i in range(40)], "fact_id string, text string, composite double").coalesce(1)
    counted = facts.mapInArrow(seen_row, facts.schema)
    out = loop.all_difficulties(counted, spark.createDataFrame([], "h string"), Caller(loop.by_rule, throttle=Throttle(calls=1 << 30)))
    assert out.count() and read.value == 40


def test_a_shared_token_alone_makes_no_candidate(spark):
    """60 sets with a rare token in common and nothing else, beside near ones of many sizes: only these leave the join."""
    import random

    from lorebank.operators import similarity as S

    rng = random.Random(5)
    rows = [[f"r{k}x{i}" for i in range(30)] + ["rare"] + [f"often{i}" for i in range(10)] for k in range(60)]
    for size in (6, 7, 20, 80, 900, 3000):
        one = [f"w{size}x{i}" for i in range(size)]
        for cut in (0, 1, size // 13, size // 7, size // 5):
            rows.append(rng.sample(one, size - cut) + [f"new{size}y{cut}"] * (cut == 1))
    rows = [sorted(set(r)) for r in rows]
    sets = spark.createDataFrame(list(enumerate(rows)), "id long, s array<string>")
    want = {(i, j) for i in range(len(rows)) for j in range(i) if len(set(rows[i]) & set(rows[j])) >= 0.85 * len(set(rows[i]) | set(rows[j]))}
    found = {(r.j, r.i) for r in S._candidates(sets, 0.85).collect()}
    assert want <= found and not any(i < 60 for i, _ in found)
    assert {(r.j, r.i) for r in S._near_sets(sets, 0.85).collect()} == want


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    from lorebank.plans import memory_queries as M

    monkeypatch.setattr(M, "ROWS", 1000)
    memory = M.remembered(spark, DIR)
    assert memory.buckets == -(-M.D.table(spark, DIR, "lineitem").count() // 1000) > 4


def test_graph_splits_texts_once(spark):
    from lorebank.plans import curation

    assert "posexplode" not in plan(curation.graph(spark, DIR)[1])

"""Search and fetching, settings, rendering, first writers of the graph, and the streams against their batches."""

import json

import pytest
from pyspark.sql import functions as F

from lorebank.operators import graph, render
from lorebank.operators.model import Limited
from lorebank.plans import registry
from lorebank.sources import config, web
from lorebank.sources import domain as D
from lorebank.streaming import limits

DIR = "/root/testdata/sf0.001"
PAGE = "<article><p>One two three four five six seven. {} and so on to the end of it.</p></article>"


def quiet(seconds):
    pass


def engine(query, lang):
    if query == "broken":
        raise OSError("no answer")
    return [f"http://{query}.org/{i}" for i in range(8)] + ["http://www.facebook.com/x"]


def fetcher(url):
    if url.endswith("3"):
        raise OSError("gone")
    return PAGE.format(url.rsplit("/", 1)[1])


def test_search_and_fetch(spark):
    queries = spark.createDataFrame([("a", "en"), ("a", "en"), ("b", "bn"), ("broken", "en")], "q string, lang string")
    found = web.search(queries, engine, sleep=quiet).collect()
    assert sorted((r.query, r.rank) for r in found if r.error is None) == [(q, i) for q in "ab" for i in range(5)]
    assert [(r.query, r.error) for r in found if r.error] == [("broken", "no answer")]
    urls = spark.createDataFrame([(f"http://a.org/{i}",) for i in range(4)] + [("http://m.youtube.com/x",), (None,)], "url string")
    assert {(r.url[-1], r.error) for r in web.fetch(urls, fetcher).collect()} == {("0", None), ("1", None), ("2", None), ("3", "gone")}
    facts = web.facts_of(queries, fetcher, engine, sleep=quiet).collect()
    assert len({r.hash for r in facts}) == len(facts) == 5 and {r.url[:12] for r in facts} == {"http://a.org"}


def test_engines_are_tried_again_and_then_the_next_one():
    slept, asked = [], []

    def refuses(q, lang):
        asked.append(1)
        if len(asked) < 3:
            raise Limited(9)
        return []

    def fails(q, lang):
        raise OSError("down")

    assert web.found("q", "en", (refuses, lambda q, lang: ["u"] * 9), slept.append) == ["u"] * 5 and slept == [3, 6]
    assert web.found("q", "en", (fails, refuses), slept.append) == [] and slept == [3, 6, 2, 4]
    with pytest.raises(OSError):
        web.found("q", "en", (fails,), slept.append)


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"model": {"name": "x", "none": None}}))
    s = config.load(str(tmp_path / "a.json"))
    assert config.lookup(s, "model.name") == "x" and config.lookup(s, "model.none", 3) == 3 and config.lookup(s, "model.name.more", 4) == 4
    assert config.lookup(s, "other", "d") == "d" and config.lookup(s) == s and config.load(str(tmp_path / "none.yaml")) == {}


def test_rendering(spark):
    q = spark.createDataFrame([("What?", {"B": "two", "A": "one"}, "B"), ("Why?", None, None)], "t string, o map<string,string>, c string")
    assert [r[0] for r in q.select(render.question(F.col("t"), F.col("o"), F.col("c"))).collect()] == ["What?\n  A) one\n* B) two", "Why?"]
    assert spark.range(1).select(render.report(F.lit(4), F.lit(3), F.lit(0.75))).first()[0] == "3 of 4 passed (75.0 %)"
    rows = spark.createDataFrame([("m_b", None), ("m_a", 0.5)], "metric string, value double")
    assert [r.line for r in render.metrics(rows).collect()] == ["m_a         0.5000", "m_b         n/a"]


def test_first_writer_wins(spark):
    facts = spark.createDataFrame([(2, "Old Dhaka stands.", "a b", "", ""), (1, "Old Dhaka fell.", "A B", "", ""), (1, "Again.", "A B", "", "")], "fact_id long, text string, topic string, publisher string, source_url string")
    nodes = {r.node_id: (r.type, r.seq) for r in graph.build(facts)[0].collect()}
    assert nodes["FACT_1"] == ("FACT", 1) and nodes["TOPIC_A_B"] == ("TOPIC", 1) and nodes["ENTITY_Old_Dhaka"] == ("ENTITY", 1) and len(nodes) == 6


def test_streams_equal_their_batches(spark, tmp_path):
    for name, df, make, keys in (("ratings", D.feedback(spark, DIR), limits.ratings_stream, ["rating"]), ("latency", D.run_log(spark, DIR), limits.latency_stream, ["window", "stage"])):
        df.repartition(4).write.parquet(str(tmp_path / name))
        schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
        got = limits.finished(make(spark, str(tmp_path / name), schema), name)
        whole = df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("window", F.window("ts", "1 hour")) if name == "latency" else df
        want = whole.groupBy(*keys).agg(F.count("*").alias("n"))
        assert sorted(map(repr, got.select(*keys, "n").collect())) == sorted(map(repr, want.collect()))


def test_rate_limit_as_a_stream(spark, tmp_path):
    from lorebank.plans.mcq_queries import calls

    rows = calls(spark, DIR)
    rows.coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "calls"))
    limits.rate_limit_stream(stream, 5 * 86400.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, registry.QUERIES["api_rate_limit"](spark, DIR).collect()))


def test_long_logs_stream_through_small_batches(spark):
    """One key with far more calls than a batch, and another in between: the state goes on over batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        times = [(i, "k" if i % 3 else "other", "generate", float(i)) for i in range(900)]
        got = {r.call_id: (r.allowed, r.retry_after) for r in limits.rate_limit(spark.createDataFrame(times, "call_id long, key string, zone string, at double")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in ("k", "other"):
        mine = [t for t in times if t[1] == key]
        ok, retry, _ = limits.decide([t[3] for t in mine], [], 5, 60.0)
        assert [got[t[0]] for t in mine] == list(zip(ok, retry, strict=True))

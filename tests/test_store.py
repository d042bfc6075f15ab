"""The event memory on disk, and the stores, logs and exports beside it."""

import json

import pytest
from pyspark.sql import functions as F

from lorebank.sources import bank, store



def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


@pytest.fixture
def memory(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/memory")
    s.create()
    rows = [("a", "q1", "T", "2025-12-31", 0.9, 1), ("b", "q2", "T", "2025-12-31", 0.2, 0), ("c", "q3", None, "2025-06-01", 0.95, 1), ("d", "q4", "U", "2025-06-01", 0.6, 0), ("e", "q5", "U", "2025-06-01", None, None)]
    made = spark.createDataFrame(rows, "episode_id string, input_question string, topic string, timestamp string, overall_score double, accepted int").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    facts = spark.createDataFrame([("a", 1), ("a", 2), ("d", 1)], "episode_id string, fact_id long")
    mcqs = spark.createDataFrame([("m1", "a", {"k": "v"}, 0.9), ("m2", "d", None, None)], "mcq_id string, episode_id string, options map<string,string>, quality_score double")
    s.write_episodes(made, facts, mcqs)
    return s


def ids(df):
    return sorted(r.episode_id for r in df.select("episode_id").collect())


def test_create_keeps_what_is_there(memory):
    memory.create()
    assert [memory.read(n).count() for n in store.TABLES] == [5, 3, 2, 0, 0]


def test_defaults(memory):
    e = {r.episode_id: r for r in memory.read("episodes").collect()}
    assert (e["e"].overall_score, e["e"].accepted, e["e"].generation_config) == (0.0, 0, "{}")
    assert e["a"].decay_score == 1.0 and e["b"].decay_score == pytest.approx(0.6 * 0.7)
    m = {r.mcq_id: r for r in memory.read("episode_mcqs").collect()}
    assert json.loads(m["m1"].options) == {"k": "v"} and (m["m2"].options, m["m2"].quality_score, m["m2"].difficulty) == ("[]", 0.0, "medium")


def test_update(spark, memory):
    changes = [("b", 1, 0.8, 2, None, None), ("d", None, None, 3, "WRONG", "no"), ("none", 1, 1.0, 1, "X", None)]
    memory.update_episodes(spark.createDataFrame(changes, "episode_id string, accepted int, overall_score double, regeneration_round int, rejection_reason string, judge_feedback string"), now())
    e = {r.episode_id: r for r in memory.read("episodes").collect()}
    assert len(e) == 5 and (e["b"].accepted, e["b"].overall_score) == (1, 0.8) and e["b"].decay_score == pytest.approx(0.951229, abs=1e-6)
    assert (e["d"].accepted, e["d"].overall_score) == (0, 0.6) and e["d"].decay_score < 0.01 and e["a"].decay_score == 1.0
    assert {r.mcq_id: r.regeneration_round for r in memory.read("episode_mcqs").collect()} == {"m1": 0, "m2": 3}
    assert [(r.episode_id, r.reason, r.judge_feedback) for r in memory.read("rejection_logs").collect()] == [("d", "WRONG", "no")]


def test_forget(memory):
    assert memory.forget(now(), dry_run=True) == 2 and memory.read("episodes").count() == 5
    assert memory.forget(now()) == 2 and ids(memory.read("episodes")) == ["a", "b", "c"]
    assert ids(memory.read("episode_facts")) == ["a", "a"] and ids(memory.read("episode_mcqs")) == ["a"]
    assert memory.forget(now()) == 0


def files(memory, tmp_path, name):
    return {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "memory" / name).rglob("*.parquet")}


def changes(spark, *ids):
    rows = [(i, 1, 0.9, 1, None, None) for i in ids]
    return spark.createDataFrame(rows, "episode_id string, accepted int, overall_score double, regeneration_round int, rejection_reason string, judge_feedback string")


def test_an_update_writes_the_months_it_touches(spark, memory, tmp_path):
    before = {n: files(memory, tmp_path, n) for n in store.TABLES}
    memory.update_episodes(changes(spark, "a"), now())
    for n in store.TABLES:
        after = files(memory, tmp_path, n)
        touched = {str(p) for p in before[n].items() ^ after.items() for p in [p[0]]}
        assert all("period=2025-12" in p for p in touched) and bool(touched) == (n in ("episodes", "episode_mcqs")), n
    assert memory.read("episodes").count() == 5


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_plans_of_lookups(spark, memory):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = memory.read("episodes").join(memory.read("episode_facts").drop("period"), "episode_id").join(memory.read("episode_mcqs").drop("period"), "episode_id", "left")
        assert joined.count() == 3 and "Exchange" not in plan(joined) and "Join" in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    some = memory.between("2025-06-01", "2025-07-01")
    assert ids(some) == ["c", "d", "e"] and "PartitionFilters: [isnotnull(period" in plan(some)
    fact = memory.read("episode_facts").where("fact_id = '2'")
    assert fact.count() == 1 and "EqualTo(fact_id,2)" in plan(fact)


def test_another_session_reads_the_same_files(spark, memory):
    want = {n: sorted(map(str, memory.read(n).collect())) for n in store.TABLES}
    for n in store.TABLES:
        spark.sql(f"DROP TABLE {memory.table(n)}")  # the catalog of a new application knows none
    again = store.Store(spark, memory.path)
    again.create()
    assert {n: sorted(map(str, again.read(n).collect())) for n in store.TABLES} == want
    assert again.forget(now()) == 2 and ids(again.read("episodes")) == ["a", "b", "c"]
    for n in store.TABLES:
        spark.sql(f"DROP TABLE {memory.table(n)}")
    memory.create()
    assert ids(memory.read("episodes")) == ["a", "b", "c"]  # a month that lost all its rows does not come back


def test_forgetting_that_breaks_off_leaves_nothing_dangling(memory, monkeypatch):
    def breaks(self, name, *more, keep=store.Store._keep):
        if name != "episodes":
            raise OSError("lost")
        keep(self, name, *more)

    with monkeypatch.context() as m:
        m.setattr(store.Store, "_keep", breaks)
        with pytest.raises(OSError):
            memory.forget(now())
    assert ids(memory.read("episodes")) == ["a", "b", "c"] and ids(memory.read("episode_facts")) == ["a", "a", "d"]
    memory.sweep()
    assert ids(memory.read("episode_facts")) == ["a", "a"] and ids(memory.read("episode_mcqs")) == ["a"]


def test_of_several_changes_the_greatest_counts(spark, memory):
    memory.update_episodes(changes(spark, "a").unionByName(changes(spark, "a").withColumn("accepted", F.lit(0))), now())
    memory.update_episodes(changes(spark, "nobody"), now())
    e = {r.episode_id: r for r in memory.read("episodes").collect()}
    assert len(e) == 5 and (e["a"].accepted, e["a"].overall_score) == (1, 0.9)


def test_older_tables_get_the_columns_they_lack(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/old")
    with monkeypatch.context() as m:
        m.setitem(store.TABLES, "episode_mcqs", "mcq_id string, episode_id string, quality_score double")
        s.create()
        s.append("episode_mcqs", spark.createDataFrame([("m1", "a", 0.5, "2025-01")], "mcq_id string, episode_id string, quality_score double, period string"))
    s.create()
    one = s.read("episode_mcqs").first()
    assert (one.quality_score, one.format_score, one.grounding_score, one.regeneration_round) == (0.5, 0.0, 0.0, 0)
    s.append("episode_mcqs", spark.createDataFrame([("m2", "b", 0.7, "2025-02")], "mcq_id string, episode_id string, format_score double, period string"))
    assert {r.mcq_id: (r.quality_score, r.format_score) for r in s.read("episode_mcqs").collect()} == {"m1": (0.5, 0.0), "m2": (0.0, 0.7)}


def test_feedback(spark, memory):
    rows = spark.createDataFrame([("a", "m1", 5, ["1"]), ("a", "m1", 3, None), ("a", "m1", 6, None), ("b", "m2", None, None)], "episode_id string, mcq_id string, rating int, fact_ids array<string>")
    assert memory.write_feedback(rows) == 1
    got = memory.read("feedback")
    assert sorted(r.rating for r in got.collect()) == [3, 3, 5] and {r.fact_ids for r in got.collect()} == {'["1"]', "[]"}
    assert got.where("episode_id = 'a'").agg(F.avg("rating")).first()[0] == 4.0


def test_seen_questions(spark, tmp_path):
    assert store.load_seen(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "seen.json").write_text(json.dumps({"fingerprints": ["x", "y", "x"]}, indent=2))
    seen = store.load_seen(spark, f"{tmp_path}/seen.json")
    assert sorted(r.h for r in seen.collect()) == ["x", "y"]
    store.save_seen(seen.unionByName(spark.range(30_000).select(F.col("id").cast("string").alias("h"))), f"{tmp_path}/saved")
    assert store.load_seen(spark, f"{tmp_path}/saved").count() == 30_002
    store.save_seen(seen.limit(0), f"{tmp_path}/empty")
    assert store.load_seen(spark, f"{tmp_path}/empty").count() == 0


def test_improvement_log(spark, tmp_path):
    rows = spark.createDataFrame([("m1", True), ("m2", False), ("m3", True)], "mcq_id string, passed boolean")
    store.save_improvement_log(rows, f"{tmp_path}/log", "2026-01-01T00:00:00")
    one = spark.read.json(f"{tmp_path}/log/summary").first()
    assert (one.total_evaluated, one.pass_rate) == (3, 0.667) and spark.read.json(f"{tmp_path}/log/evaluations").count() == 3
    store.save_improvement_log(rows.limit(0), f"{tmp_path}/none", "t")
    assert spark.read.json(f"{tmp_path}/none/summary").first().pass_rate == 0.0


def test_run_log(spark, tmp_path):
    at = f"{tmp_path}/runs"
    runs = spark.createDataFrame([("r1", "2026-01-01 00:00:00", {"topic": "x"}), ("r2", "2026-01-01 00:00:10", None)], "pipeline_run_id string, timestamp string, input map<string,string>").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    later = runs.select("pipeline_run_id", F.expr("timestamp + interval 1500 milliseconds").alias("timestamp"), F.when(F.col("pipeline_run_id") == "r2", "no_facts").alias("failure_mode"))
    bank.append_run_log(bank.run_lines(runs, "start").unionByName(bank.run_lines(later, "complete")), at)
    got = {(r.pipeline_run_id, r.stage): (r.execution_time_ms, r.failure_mode) for r in bank.scan_run_log(spark, at).collect()}
    assert got == {("r1", "start"): (0, "none"), ("r2", "start"): (0, "none"), ("r1", "complete"): (1500, "none"), ("r2", "complete"): (1500, "no_facts")}
    bank.clear_run_log(spark, at)
    assert bank.scan_run_log(spark, at).count() == 0


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "T", "easy", 0.8, {"a": "x"}), ("m2", "T", None, 0.9, None)], "mcq_id string, topic string, difficulty string, quality double, options map<string,string>")
    bank.export_json(rows, f"{tmp_path}/json")
    bank.export_csv(rows, f"{tmp_path}/csv")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").where("mcq_id = 'm1'").first().options == '{"a":"x"}'
    stats = {(r.kind, r.key): (r.n, r.avg_quality) for r in store.export_stats(rows).collect()}
    assert stats == {("total", "all"): (2, 0.85), ("topic", "T"): (2, None), ("difficulty", "easy"): (1, None), ("difficulty", "unknown"): (1, None)}

"""Queries over the event memory: episodes, their questions and facts, ratings and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import counters
from ..operators import memory as M
from ..sources import domain as D
from ..sources import scratch
from ..sources.store import Store
from ..streaming import limits, runs
from .registry import query

E, EF, Q, FB, RL = D.episodes, D.episode_facts, D.episode_mcqs, D.feedback, D.run_log
DEC = """, now AS (SELECT max(ts) AS now FROM episodes),
dec AS (SELECT e.*, now, floor(date_diff('microsecond', ts, now) / 86400000000::DOUBLE) AS age FROM episodes e, now),
decayed AS (SELECT *, round(least(1::DOUBLE, greatest(0::DOUBLE, exp(-0.05::DOUBLE * age) * CASE WHEN accepted = 0 THEN 0.6::DOUBLE ELSE 1::DOUBLE END * CASE WHEN score < 0.5 THEN 0.7::DOUBLE ELSE 1::DOUBLE END)) * 1e6) / 1e6 AS decay FROM dec),
doomed AS (SELECT * FROM decayed WHERE NOT (accepted = 1 AND score > 0.85) AND (decay < 0.1 OR (ts < now - INTERVAL 90 DAY AND accepted = 0)))
"""


def q(name: str, tables: tuple[str, ...], oracle: str):
    return query(name, D.sql(oracle, *tables))


@q("topic_performance", ("episodes",), "SELECT topic, round(avg(score) * 1e4) / 1e4 AS avg_score, round(avg(accepted) * 1e4) / 1e4 AS acceptance, count(*) AS n FROM episodes GROUP BY topic")
def topic_performance(s, d):
    return E(s, d).groupBy("topic").agg(T.rnd(F.avg("score"), 4).alias("avg_score"), T.rnd(F.avg("accepted"), 4).alias("acceptance"), F.count("*").alias("n")).orderBy(F.desc("avg_score"))


@q("scan_tables", ("episodes", "episode_facts"), "SELECT 'episodes' AS name, count(*) AS n FROM episodes UNION ALL SELECT 'episode_facts', count(*) FROM episode_facts")
def scan_tables(s, d):
    return E(s, d).agg(F.count("*").alias("n")).select(F.lit("episodes").alias("name"), "n").unionByName(EF(s, d).agg(F.count("*").alias("n")).select(F.lit("episode_facts").alias("name"), "n"))


@q("scan_log_tail", ("run_log",), "SELECT seq, run_id, stage FROM (SELECT * FROM run_log ORDER BY seq DESC LIMIT 50) ORDER BY seq")
def scan_log_tail(s, d):
    return RL(s, d).orderBy(F.desc("seq")).limit(50).orderBy("seq").select("seq", "run_id", "stage")


@q("scan_run_log", ("run_log",), "SELECT seq, run_id, stage FROM (SELECT * FROM run_log ORDER BY seq DESC LIMIT 10000) WHERE run_id = 7")
def scan_run_log(s, d):
    return RL(s, d).orderBy(F.desc("seq")).limit(10000).where("run_id = 7").select("seq", "run_id", "stage")


@q("write_episode", ("episodes", "episode_facts", "mcqs"), "SELECT e.episode_id, (SELECT count(*) FROM episode_facts f WHERE f.episode_id = e.episode_id) AS n_facts, (SELECT count(*) FROM mcqs m WHERE m.episode_id = e.episode_id) AS n_mcqs FROM episodes e")
def write_episode(s, d):
    """The episodes of a memory that all of them are written to, with what hangs on each."""
    memory = remembered(s, d)
    f = memory.read("episode_facts").groupBy("episode_id").agg(F.count("*").alias("n_facts"))
    m = memory.read("episode_mcqs").groupBy("episode_id").agg(F.count("*").alias("n_mcqs"))
    none = F.lit(0).cast("long")
    rows = memory.read("episodes").select("episode_id").join(f, "episode_id", "left").join(m, "episode_id", "left")
    return rows.select(F.col("episode_id").cast("long").alias("episode_id"), F.coalesce("n_facts", none).alias("n_facts"), F.coalesce("n_mcqs", none).alias("n_mcqs"))


#: Lines that one bucket of a memory holds.
ROWS = 200_000


def remembered(s, d) -> Store:
    """A new memory on disk with all episodes, their facts and their questions."""
    # a task writes one bucket, so buckets grow with the rows; months of these tables are small
    buckets = max(4, -(-D.table(s, d, "lineitem").count() // ROWS))
    memory = Store(s, scratch.place(s, "memory"), buckets=buckets, period="yyyy")
    memory.create()
    asked = E(s, d).select("episode_id", F.col("topic").alias("input_question"), "topic", F.col("ts").alias("timestamp"), F.col("score").alias("overall_score"), "accepted")
    made = Q(s, d).select("mcq_id", "episode_id", "difficulty", F.col("quality").alias("quality_score"), F.col("format").alias("format_score"), F.col("grounding").alias("grounding_score"), F.col("clarity").alias("clarity_score"), F.col("distractor").alias("distractor_score"))
    memory.write_episodes(asked, EF(s, d), made)
    return memory


def last(s, d):
    """The time of the latest episode, by which all are aged; it goes through text, which no time zone of the driver can shift."""
    e = E(s, d)
    kind = dict(e.dtypes)["ts"]
    return F.lit(e.agg(F.max("ts").cast("string")).first()[0]).cast(kind).cast("timestamp")


@q("update_episode", ("episodes", "feedback"), """, u AS (SELECT episode_id, min(rating) / 5::DOUBLE AS score FROM feedback GROUP BY 1), e AS (SELECT episode_id, topic, ts, accepted, coalesce(u.score, e.score) AS score FROM episodes e LEFT JOIN u USING (episode_id)),
 n AS (SELECT *, floor(date_diff('microsecond', ts, (SELECT max(ts) FROM e)) / 86400000000::DOUBLE) AS age FROM e)
SELECT episode_id, round(score * 1e6) / 1e6 AS score, round(least(1::DOUBLE, greatest(0::DOUBLE, exp(-0.05::DOUBLE * age) * CASE WHEN accepted = 0 THEN 0.6::DOUBLE ELSE 1::DOUBLE END * CASE WHEN score < 0.5 THEN 0.7::DOUBLE ELSE 1::DOUBLE END)) * 1e6) / 1e6 AS decay FROM n""")
def update_episode(s, d):
    """Every episode changed to the lowest rating it got, if any, and aged anew."""
    memory = remembered(s, d)
    rated = FB(s, d).groupBy("episode_id").agg((F.min("rating") / 5.0).alias("overall_score"))
    none = {"accepted": F.lit(None).cast("int"), "regeneration_round": F.lit(None).cast("int"), "rejection_reason": F.lit(None).cast("string"), "judge_feedback": F.lit(None).cast("string")}
    changes = E(s, d).select("episode_id").join(rated, "episode_id", "left").withColumn("episode_id", F.col("episode_id").cast("string")).withColumns(none)
    memory.update_episodes(changes, last(s, d))
    return memory.read("episodes").select(F.col("episode_id").cast("long").alias("episode_id"), T.rnd(F.col("overall_score"), 6).alias("score"), F.col("decay_score").alias("decay"))


@q("decay_score", ("episodes",), DEC + "SELECT episode_id, CAST(age AS BIGINT) AS age_days, decay FROM decayed")
def decay_score(s, d):
    return M.with_decay(E(s, d)).select("episode_id", F.col("age_days").cast("bigint").alias("age_days"), "decay")


@q("forget_old_episodes", ("episodes", "episode_facts", "mcqs"), DEC + "SELECT 'episodes' AS part, count(*) AS n FROM episodes WHERE episode_id NOT IN (SELECT episode_id FROM doomed) UNION ALL SELECT 'episode_facts', count(*) FROM episode_facts WHERE episode_id NOT IN (SELECT episode_id FROM doomed) UNION ALL SELECT 'mcqs', count(*) FROM mcqs WHERE episode_id NOT IN (SELECT episode_id FROM doomed)")
def forget_old_episodes(s, d):
    """What is left of a memory that is aged and then forgets."""
    memory = remembered(s, d)
    as_they_are = {c: F.lit(None).cast(kind) for c, kind in (("accepted", "int"), ("overall_score", "double"), ("regeneration_round", "int"), ("rejection_reason", "string"), ("judge_feedback", "string"))}
    memory.update_episodes(memory.read("episodes").select("episode_id").withColumns(as_they_are), last(s, d))
    memory.forget(last(s, d))
    count = lambda name, part: memory.read(name).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count("episodes", "episodes").unionByName(count("episode_facts", "episode_facts")).unionByName(count("episode_mcqs", "mcqs"))


@q("write_feedback", ("feedback",), "SELECT id, episode_id, rating, category FROM feedback WHERE rating BETWEEN 1 AND 5")
def write_feedback(s, d):
    """The ratings that a memory takes; the row's number stands for the question's id."""
    memory = Store(s, scratch.place(s, "memory"))
    memory.create()
    memory.write_feedback(FB(s, d).select("episode_id", F.col("id").alias("mcq_id"), "rating", "category", "created_at"))
    return memory.read("feedback").select(F.col("mcq_id").cast("long").alias("id"), F.col("episode_id").cast("long").alias("episode_id"), "rating", "category")


PENALTY = """, own AS (SELECT fact_id, round(avg(quality) * 1e6) / 1e6 AS c FROM mcqs GROUP BY fact_id),
low AS (SELECT id // 4 AS fact_id, sum(3 - rating) AS points, arg_max(rating, (created_at, id)) AS last FROM feedback WHERE rating <= 2 GROUP BY ALL)
SELECT fact_id, round(greatest(0::DOUBLE, coalesce(c, 0.5::DOUBLE) - 0.1::DOUBLE * points) * 1e6) / 1e6 AS composite, last AS user_feedback_low FROM low LEFT JOIN own USING (fact_id)"""


def own_composites(s, d):
    """The composite of each fact, here the mean quality of its questions."""
    return Q(s, d).groupBy("fact_id").agg(T.rnd(F.avg("quality"), 6).alias("composite"))


def rated(s, d):
    """The ratings, here four for each fact."""
    return FB(s, d).select("id", F.expr("id div 4").alias("fact_id"), "rating", "created_at")


@q("feedback_penalty", ("feedback", "mcqs"), PENALTY)
def feedback_penalty(s, d):
    return M.penalties(rated(s, d), own_composites(s, d))


@q("penalty_stream", ("feedback", "mcqs"), PENALTY)
def penalty_stream(s, d):
    """The same from a stream over files of ratings."""
    path, rows = scratch.place(s, "ratings"), rated(s, d)
    rows.repartition(3).write.parquet(path)
    ratings = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    kept = scratch.place(s, "penalties")
    runs.penalty_stream(ratings, kept, scratch.place(s, "penalties-checkpoint")).awaitTermination()
    return runs.penalised(s, kept, own_composites(s, d))


@q("time_range", ("episodes",), "SELECT episode_id, topic FROM episodes WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def time_range(s, d):
    return E(s, d).where("ts between timestamp_ntz '1996-01-01' and timestamp_ntz '1996-06-30'").orderBy("ts", "episode_id").select("episode_id", "topic")


@q("topic_trend", ("episodes",), "SELECT episode_id, score FROM episodes WHERE topic = '1-URGENT' AND ts >= (SELECT max(ts) FROM episodes) - INTERVAL 30 DAY")
def topic_trend(s, d):
    return M.with_now(E(s, d)).where((F.col("topic") == "1-URGENT") & (F.col("ts") >= F.expr("now - interval 30 days"))).orderBy("ts", "episode_id").select("episode_id", "score")


@q("feedback_for_fact", ("feedback",), "SELECT id, rating FROM feedback WHERE contains('[\"' || fact_id || '\"]', '12')")
def feedback_for_fact(s, d):
    return FB(s, d).where(F.concat(F.lit('["'), F.col("fact_id").cast("string"), F.lit('"]')).contains("12")).orderBy(F.desc("created_at"), "id").select("id", "rating")


@q("feedback_for_facts", ("feedback",), "SELECT p_partkey::VARCHAR AS needle, id, rating FROM feedback JOIN part ON contains('[\"' || fact_id || '\"]', p_partkey::VARCHAR)")
def feedback_for_facts(s, d):
    """The ratings whose list of facts contains an id, for a whole table of ids."""
    f = FB(s, d)
    listed = F.concat(F.lit('["'), F.col("fact_id").cast("string"), F.lit('"]'))
    ids = D.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("needle"))
    return M.containing(f.select("id", listed.alias("text")), ids).join(f.select("id", "rating"), "id").select("needle", "id", "rating")


@query("user_lookup", "SELECT c_custkey AS user_id, c_name AS display_name FROM customer WHERE c_custkey = 42")
def user_lookup(s, d):
    return D.table(s, d, "customer").where("c_custkey = 42").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("display_name"))


@q("join_facts_episodes", ("episodes", "episode_facts"), "SELECT e.episode_id, f.fact_id, e.score FROM episode_facts f JOIN episodes e USING (episode_id) WHERE f.fact_id IN (1, 2, 3, 5, 8) AND e.score >= 0.3")
def join_facts_episodes(s, d):
    return EF(s, d).where(F.col("fact_id").isin(1, 2, 3, 5, 8)).join(E(s, d).where("score >= 0.3"), "episode_id").select("episode_id", "fact_id", "score").orderBy(F.desc("score"))


@q("failed_facts", ("episodes", "episode_facts"), "SELECT fact_id, count(*) AS n FROM episode_facts JOIN episodes USING (episode_id) WHERE accepted = 0 GROUP BY fact_id ORDER BY n DESC, fact_id LIMIT 20")
def failed_facts(s, d):
    return EF(s, d).join(E(s, d).where("accepted = 0"), "episode_id").groupBy("fact_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fact_id").limit(20)


@q("feedback_with_episode", ("episodes", "feedback"), "SELECT f.id, f.rating, e.topic FROM feedback f JOIN episodes e USING (episode_id) WHERE rating <= 2 ORDER BY created_at DESC, id LIMIT 100")
def feedback_with_episode(s, d):
    return FB(s, d).where("rating <= 2").join(E(s, d), "episode_id").orderBy(F.desc("created_at"), "id").limit(100).select("id", "rating", "topic")


@q("export_dataset", ("episodes", "mcqs", "feedback"), """, top AS (SELECT m.*, e.topic, e.ts FROM mcqs m JOIN episodes e USING (episode_id) WHERE quality >= 0.7 ORDER BY ts DESC, mcq_id LIMIT 1000),
r AS (SELECT episode_id, round(avg(rating) * 100) / 100 AS avg_rating, count(*) AS n_ratings FROM feedback GROUP BY 1)
SELECT mcq_id, episode_id, topic, difficulty, round(quality * 1e6) / 1e6 AS quality, avg_rating, coalesce(n_ratings, 0) AS n_ratings FROM top LEFT JOIN r USING (episode_id)""")
def export_dataset(s, d):
    return M.export(Q(s, d), E(s, d), FB(s, d), 0.7, 1000)


@q("episode_detail", ("episodes", "episode_facts", "mcqs"), """SELECT e.episode_id, e.topic, coalesce((SELECT string_agg(fact_id, ',' ORDER BY fact_id) FROM episode_facts f WHERE f.episode_id = e.episode_id), '') AS fact_ids,
 coalesce((SELECT string_agg(mcq_id, ',' ORDER BY mcq_id) FROM mcqs m WHERE m.episode_id = e.episode_id), '') AS mcq_ids FROM episodes e""")
def episode_detail(s, d):
    f = EF(s, d).groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("fact_id")), lambda x: x.cast("string")), ",").alias("fact_ids"))
    m = Q(s, d).groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_list("mcq_id")), ",").alias("mcq_ids"))
    return E(s, d).join(f, "episode_id", "left").join(m, "episode_id", "left").select("episode_id", "topic", F.coalesce("fact_ids", F.lit("")).alias("fact_ids"), F.coalesce("mcq_ids", F.lit("")).alias("mcq_ids"))


@q("feedback_stats", ("feedback",), "SELECT 'total' AS kind, 'all' AS key, count(*) AS n, coalesce(round(avg(rating) * 100) / 100, 0) AS avg_rating FROM feedback UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), count(*), NULL FROM feedback GROUP BY rating UNION ALL SELECT 'category', category, count(*), NULL FROM feedback WHERE category IS NOT NULL GROUP BY category")
def feedback_stats(s, d):
    f = FB(s, d)
    none = F.lit(None).cast("double").alias("avg_rating")
    total = f.agg(F.count("*").alias("n"), F.coalesce(T.rnd(F.avg("rating"), 2), F.lit(0.0)).alias("avg_rating")).select(F.lit("total").alias("kind"), F.lit("all").alias("key"), "n", "avg_rating")
    by = lambda kind, c: f.where(c.isNotNull()).groupBy(c.alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n", none)
    return total.unionByName(by("rating", F.col("rating").cast("string"))).unionByName(by("category", F.col("category")))


@q("feedback_stream", ("feedback",), "SELECT rating, count(*) AS n FROM feedback GROUP BY rating")
def feedback_stream(s, d):
    """Counts of ratings as a stream over files of them."""
    path, rows = scratch.place(s, "ratings"), FB(s, d).select("id", "rating")
    rows.repartition(3).write.parquet(path)
    counts = limits.ratings_stream(s, path, "id long, rating int")
    return limits.finished(counts, "ratings_" + path.rpartition("/")[2].partition("-")[0])


@q("memory_summary", ("episodes", "episode_facts", "mcqs", "feedback"), "SELECT (SELECT count(*) FROM episodes) AS episodes, (SELECT count(*) FROM episode_facts) AS facts, (SELECT count(*) FROM mcqs) AS mcqs, (SELECT count(*) FROM feedback) AS feedback, (SELECT CAST(sum(accepted) AS BIGINT) FROM episodes) AS accepted, (SELECT round(avg(score) * 1e4) / 1e4 FROM episodes) AS avg_score")
def memory_summary(s, d):
    e = E(s, d).agg(F.count("*").alias("episodes"), F.sum("accepted").alias("accepted"), T.rnd(F.avg("score"), 4).alias("avg_score"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return e.crossJoin(n(EF(s, d), "facts")).crossJoin(n(Q(s, d), "mcqs")).crossJoin(n(FB(s, d), "feedback"))


@q("dataset_stats", ("episodes", "mcqs"), "SELECT topic, difficulty, count(*) AS n, round(avg(quality) * 1e4) / 1e4 AS avg_quality FROM mcqs JOIN episodes USING (episode_id) GROUP BY GROUPING SETS ((), (topic), (difficulty))")
def dataset_stats(s, d):
    x = Q(s, d).join(E(s, d), "episode_id")
    return x.groupingSets([[], ["topic"], ["difficulty"]], "topic", "difficulty").agg(F.count("*").alias("n"), T.rnd(F.avg("quality"), 4).alias("avg_quality"))


@q("generation_result", ("mcqs",), "SELECT episode_id, coalesce(round(avg(quality) FILTER (quality >= 0.7) * 1e9) / 1e9, 0) AS mean_quality, count(*) FILTER (quality >= 0.7) AS n_accepted, coalesce(avg(quality) FILTER (quality >= 0.7), 0) >= 0.7 AS accepted, round(round(avg(grounding) * 1e9) / 1e9 * 1e4) / 1e4 AS mean_grounding, round(round(avg(distractor) * 1e9) / 1e9 * 1e4) / 1e4 AS mean_distractor, round(round(avg(clarity) * 1e9) / 1e9 * 1e4) / 1e4 AS mean_clarity, count(DISTINCT difficulty) AS n_levels FROM mcqs GROUP BY episode_id")
def generation_result(s, d):
    good = F.when(F.col("quality") >= 0.7, F.col("quality"))
    return Q(s, d).groupBy("episode_id").agg(
        F.coalesce(T.rnd(F.avg(good), 9), F.lit(0.0)).alias("mean_quality"), F.count(good).alias("n_accepted"), (F.coalesce(F.avg(good), F.lit(0.0)) >= 0.7).alias("accepted"),
        T.rnd(T.rnd(F.avg("grounding"), 9), 4).alias("mean_grounding"), T.rnd(T.rnd(F.avg("distractor"), 9), 4).alias("mean_distractor"), T.rnd(T.rnd(F.avg("clarity"), 9), 4).alias("mean_clarity"), F.size(F.collect_set("difficulty")).cast("bigint").alias("n_levels"),
    )


@q("run_rollup", ("run_log",), "SELECT run_id, count(*) AS n_stages, count(DISTINCT stage) AS n_kinds, round(avg(seconds) * 1e4) / 1e4 AS avg_seconds, bool_or(stage = 'error') AS partial_output FROM run_log GROUP BY run_id")
def run_rollup(s, d):
    return RL(s, d).groupBy("run_id").agg(F.count("*").alias("n_stages"), F.size(F.collect_set("stage")).cast("bigint").alias("n_kinds"), T.rnd(F.avg("seconds"), 4).alias("avg_seconds"), F.bool_or(F.col("stage") == "error").alias("partial_output"))


@q("prom_histogram", ("run_log",), "SELECT unnest(['1', '5', '10', '30', '60', '120', '300', '+Inf']) AS le, unnest([count(*) FILTER (seconds <= 1), count(*) FILTER (seconds <= 5), count(*) FILTER (seconds <= 10), count(*) FILTER (seconds <= 30), count(*) FILTER (seconds <= 60), count(*) FILTER (seconds <= 120), count(*) FILTER (seconds <= 300), count(*)]) AS n FROM run_log")
def prom_histogram(s, d):
    state = counters.histogram(RL(s, d), "pipeline_duration_seconds", F.col("seconds")).where("name like '%bucket'")
    return state.select(F.regexp_extract("label", '"(.*)"', 1).alias("le"), F.col("value").cast("long").alias("n"))


@q("prom_metrics", ("run_log", "mcqs", "feedback"), """, h AS (SELECT unnest(['1', '5', '10', '30', '60', '120', '300', '+Inf']) AS le, unnest([1, 5, 10, 30, 60, 120, 300, 1e300]) AS b)
SELECT 'mcq_generated_total' AS name, '' AS label, count(*)::DOUBLE AS value FROM mcqs UNION ALL SELECT 'mcq_accepted_total', '', count(*) FILTER (quality >= 0.7) FROM mcqs
UNION ALL SELECT 'feedback_received_total', 'rating="' || rating || '"', count(*) FROM feedback GROUP BY rating
UNION ALL SELECT 'pipeline_duration_seconds_bucket', 'le="' || le || '"', count(*) FILTER (seconds <= b) FROM run_log, h GROUP BY le
UNION ALL SELECT 'pipeline_duration_seconds_count', '', count(seconds) FROM run_log UNION ALL SELECT 'pipeline_duration_seconds_sum', '', round(sum(seconds) * 1e4) / 1e4 FROM run_log""")
def prom_metrics(s, d):
    """The counters and the histogram of the metrics page, merged from the states of three parts of each table."""
    part = lambda rows, key, k: rows.where(F.pmod(F.xxhash64(key), F.lit(3)) == k)
    states = []
    for k in range(3):
        asked, runs_, ratings = part(Q(s, d), "mcq_id", k), part(RL(s, d), "seq", k), part(FB(s, d), "id", k)
        states += [
            counters.counter(asked, "mcq_generated_total"),
            counters.counter(asked, "mcq_accepted_total", (F.col("quality") >= 0.7).cast("int")),
            counters.labelled(ratings, "feedback_received_total", "rating", F.col("rating")),
            counters.histogram(runs_, "pipeline_duration_seconds", F.col("seconds")),
        ]
    return counters.merged(*states).select("name", "label", T.rnd(F.col("value"), 4).alias("value"))


@q("cache_stats", ("run_log",), ", a AS (SELECT *, row_number() OVER (PARTITION BY run_id, stage, CAST(ts AS DATE) ORDER BY ts, seq) > 1 AS hit FROM run_log) SELECT stage, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(CAST(hit AS INT)) * 1e4) / 1e4 AS hit_rate FROM a GROUP BY stage")
def cache_stats(s, d):
    """Accesses of a key (run, stage) on one day: the first is a miss."""
    w = Window.partitionBy("run_id", "stage", F.to_date("ts")).orderBy("ts", "seq")
    a = RL(s, d).withColumn("hit", F.row_number().over(w) > 1)
    return a.groupBy("stage").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), T.rnd(F.avg(F.col("hit").cast("int")), 4).alias("hit_rate"))


@q("retrieve_similar", ("episodes", "episode_facts"), """, good AS (SELECT * FROM episodes WHERE score >= 0.4), a AS (SELECT episode_id, score, 0 AS rank, NULL::BIGINT AS fact_id FROM good WHERE topic = '2-HIGH' ORDER BY score DESC, episode_id LIMIT 20),
b AS (SELECT episode_id, score, 1 AS rank, fact_id FROM good JOIN episode_facts USING (episode_id) WHERE fact_id IN (10, 20, 30))
SELECT episode_id, max(score) AS score, min(rank) AS rank, coalesce(string_agg(DISTINCT fact_id, ',' ORDER BY fact_id), '') AS matched_facts FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY episode_id ORDER BY rank, score DESC, episode_id LIMIT 20""")
def retrieve_similar(s, d):
    return M.similar(E(s, d), EF(s, d), "2-HIGH", [10, 20, 30], 0.4, 20)


@q("retrieve_newest", ("episodes",), "SELECT episode_id, score, 0 AS rank, '' AS matched_facts FROM episodes WHERE score >= 0.4 ORDER BY ts DESC, episode_id LIMIT 20")
def retrieve_newest(s, d):
    """The same without a topic and facts."""
    return M.similar(E(s, d), EF(s, d), None, [], 0.4, 20)


@q("recent_episodes", ("episodes",), "SELECT episode_id, topic FROM episodes ORDER BY ts DESC, episode_id LIMIT 25")
def recent_episodes(s, d):
    return E(s, d).orderBy(F.desc("ts"), "episode_id").limit(25).select("episode_id", "topic")


@q("chunking", ("episode_facts",), ", x AS (SELECT episode_id, fact_id, row_number() OVER (PARTITION BY episode_id ORDER BY fact_id) AS n FROM (SELECT DISTINCT episode_id, fact_id FROM episode_facts)) SELECT episode_id, fact_id, CAST((n - 1) // 3 AS INT) AS chunk FROM x")
def chunking(s, d):
    return M.chunks(EF(s, d).distinct(), 3, "fact_id", by="episode_id")


@q("stage_latency", ("run_log",), ", x AS (SELECT stage, date_diff('millisecond', lag(ts) OVER (PARTITION BY run_id ORDER BY ts, seq), ts) AS ms FROM run_log) SELECT stage, count(ms) AS n, CAST(sum(ms) AS BIGINT) AS total_ms FROM x GROUP BY stage")
def stage_latency(s, d):
    before = F.lag("ts").over(Window.partitionBy("run_id").orderBy("ts", "seq"))
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(before.cast("timestamp"))
    return RL(s, d).select("stage", ms.alias("ms")).groupBy("stage").agg(F.count("ms").alias("n"), F.sum("ms").alias("total_ms"))


ELAPSED = ", r AS (SELECT run_id, seq, epoch_us(ts) // 1000 AS ms FROM run_log) SELECT run_id::VARCHAR AS run_id, seq, ms - min(ms) OVER (PARTITION BY run_id) AS elapsed_ms FROM r"


@q("run_elapsed", ("run_log",), ELAPSED)
def run_elapsed(s, d):
    """The time of each line since the start of its run."""
    return runs.elapsed(RL(s, d))


@q("run_elapsed_stream", ("run_log",), ELAPSED)
def run_elapsed_stream(s, d):
    """The same from a stream over files that hold the lines in order of their time."""
    path, out, rows = scratch.place(s, "lines"), scratch.place(s, "elapsed"), RL(s, d).select("run_id", "seq", "ts")
    bounds = rows.agg(F.percentile_approx(F.col("ts").cast("timestamp"), F.array(F.lit(0.33), F.lit(0.67))).alias("x")).first().x or []
    number = sum(((F.col("ts").cast("timestamp") > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    for k in range(len(bounds) + 1):
        rows.where(number == k).coalesce(1).write.mode("append").parquet(path)
    key, before = "spark.sql.streaming.stateStore.providerClass", s.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    s.conf.set(key, runs.ROCKSDB)
    try:
        lines = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        writer = runs.elapsed_stream(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.place(s, "elapsed-checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(key, before) if before else s.conf.unset(key)
    return s.read.schema("run_id string, seq long, elapsed_ms long").parquet(out)


@query("zone_routing", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'generate' WHEN 'click' THEN 'feedback' ELSE 'default' END AS zone FROM events")
def zone_routing(s, d):
    e = D.table(s, d, "events")
    path = F.when(F.col("event_type") == "purchase", "/api/v1/generate").when(F.col("event_type") == "click", "/api/v1/feedback").otherwise("/api/v1/topics")
    zone = F.when(F.startswith(path, F.lit("/api/v1/generate")), "generate").when(F.startswith(path, F.lit("/api/v1/feedback")), "feedback").when(F.startswith(path, F.lit("/api/v1/")), "default")
    return e.select("event_id", zone.alias("zone"))

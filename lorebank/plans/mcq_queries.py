"""Queries over questions: screening, batch reports, the metric family, keyed state and the loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.wordlists import HISTORICAL
from ..operators import loop, mcq, metrics, model
from ..operators import similarity as S
from ..operators.model import Caller, Throttle
from ..sources import domain as D
from ..sources.scratch import written
from ..streaming import limits
from .registry import query
from .text_queries import SCORED, lit

Q, FB, RL = D.episode_mcqs, D.feedback, D.run_log


def q(name: str, body: str, *tables: str):
    return query(name, D.sql(body, *(tables or ("mcqs",))))


def agg(name: str, oracle: str, of) -> None:
    """A metric of all questions."""

    @q(name, oracle)
    def run(s, d):
        return of(Q(s, d))


OPTIONS = r""", o AS (SELECT mcq_id, fact_id, 'option ' || (fact_id % 7) AS a, 'option ' || (fact_id % 5) AS b, 'quite another ' || difficulty AS c, 'something else ' || fact_id AS d FROM mcqs)
"""


@q("format_score", OPTIONS + r""", f AS (SELECT *, 'Question about ' || fact_id AS question, len(list_distinct([a, b, c, d])) < 4 AS dup FROM o),
 w AS (SELECT *, (SELECT count(*) FROM (SELECT unnest([b, c, d]) AS x) WHERE len(list_filter(range(1, greatest(length(x), length(a)) + 1), lambda i: rpad(x, greatest(length(x), length(a))::INT, ' ')[i] <> rpad(a, greatest(length(x), length(a))::INT, ' ')[i])) > 3) < 2 AS weak FROM f)
SELECT mcq_id, round((1::DOUBLE - 0.2::DOUBLE - CASE WHEN dup THEN 0.25::DOUBLE ELSE 0::DOUBLE END - CASE WHEN weak THEN 0.2::DOUBLE ELSE 0::DOUBLE END) * 1000) / 1000 AS score, CASE WHEN dup THEN 'DUPLICATE_OPTIONS,' ELSE '' END || 'FORMAT_ERROR' || CASE WHEN weak THEN ',WEAK_DISTRACTORS' ELSE '' END AS codes FROM w""")
def format_score(s, d):
    n = F.col("fact_id")
    options = F.create_map(F.lit("ক"), F.concat(F.lit("option "), n % 7), F.lit("খ"), F.concat(F.lit("option "), n % 5), F.lit("গ"), F.concat(F.lit("quite another "), "difficulty"), F.lit("ঘ"), F.concat(F.lit("something else "), n))
    x = Q(s, d).select("mcq_id", mcq.format_score(F.concat(F.lit("Question about "), n), options, F.lit("ক")).alias("x"))
    return x.select("mcq_id", "x.score", F.array_join("x.codes", ",").alias("codes"))


@q("mcq_composite", "SELECT mcq_id, round(quality * 1e6) / 1e6 AS quality FROM mcqs")
def mcq_composite(s, d):
    x = mcq.composite(F.col("format"), F.col("grounding"), F.col("clarity"), F.col("distractor"))
    return Q(s, d).select("mcq_id", T.rnd(x, 6).alias("quality"))


GRADED = ", g AS (SELECT *, round(quality * 1e9) / 1e9 >= 0.70 AND grounding >= 0.80 AND rules <> 'FORMAT_ERROR' AS passed FROM mcqs)\n"


def graded(s, d):
    """Questions with their failure codes and whether they pass."""
    rules = F.filter(F.array("rules"), lambda x: x != "")
    x = Q(s, d).withColumn("codes", mcq.codes(F.col("grounding"), F.col("distractor"), rules))
    return x.withColumn("passed", mcq.passed(T.rnd(F.col("quality"), 9), F.col("grounding"), F.col("codes")))


@q("mcq_pass", GRADED + "SELECT mcq_id, passed FROM g")
def mcq_pass(s, d):
    return graded(s, d).select("mcq_id", "passed")


@q("failure_codes", GRADED + """, c AS (SELECT unnest([nullif(rules, ''), CASE WHEN grounding < 0.80 THEN 'WRONG_GROUNDING' END, CASE WHEN distractor < 0.55 THEN 'WEAK_DISTRACTORS' END]) AS code, passed FROM g)
SELECT code, count(*) AS n, count(*) FILTER (passed) AS passed FROM c WHERE code IS NOT NULL GROUP BY code""")
def failure_codes(s, d):
    """How many questions have each code, and how many of these pass all the same."""
    each = graded(s, d).select("passed", F.explode("codes").alias("code"))
    return each.groupBy("code").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@q("batch_quality_report", GRADED + "SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(avg(quality) * 1e3) / 1e3 AS avg_composite, round(avg(grounding) * 1e3) / 1e3 AS avg_grounding, round(avg(distractor) * 1e3) / 1e3 AS avg_distractor, round(avg(CAST(passed AS INT)) * 1e3) / 1e3 AS pass_rate FROM g")
def batch_quality_report(s, d):
    a = lambda c: T.rnd(F.avg(c), 3).alias(f"avg_{'composite' if c == 'quality' else c}")
    return graded(s, d).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), a("quality"), a("grounding"), a("distractor"), T.rnd(F.avg(F.col("passed").cast("int")), 3).alias("pass_rate"))


@q("difficulty_pass_rate", GRADED + "SELECT difficulty, round(avg(CAST(passed AS INT)) * 1e3) / 1e3 AS pass_rate FROM g GROUP BY difficulty")
def difficulty_pass_rate(s, d):
    return graded(s, d).groupBy("difficulty").agg(T.rnd(F.avg(F.col("passed").cast("int")), 3).alias("pass_rate"))


@q("topic_pass_rate", GRADED + "SELECT topic, round(avg(CAST(passed AS INT)) * 1e3) / 1e3 AS pass_rate FROM g JOIN episodes USING (episode_id) GROUP BY topic", "episodes", "mcqs")
def topic_pass_rate(s, d):
    return graded(s, d).join(D.episodes(s, d), "episode_id").groupBy("topic").agg(T.rnd(F.avg(F.col("passed").cast("int")), 3).alias("pass_rate"))


@q("failed_fact_ids", GRADED + "SELECT fact_id, count(*) AS n FROM g WHERE NOT passed GROUP BY fact_id")
def failed_fact_ids(s, d):
    return graded(s, d).where("not passed").groupBy("fact_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fact_id")


@q("reasoner_judge_join", ", a AS (SELECT mcq_id, max(difficulty) AS answer, max(clarity) AS confidence FROM mcqs WHERE difficulty <> 'easy' GROUP BY mcq_id) SELECT mcq_id, coalesce(answer, 'N/A') AS answer, coalesce(confidence, 0) AS confidence FROM (SELECT DISTINCT mcq_id FROM mcqs) LEFT JOIN a USING (mcq_id)")
def reasoner_judge_join(s, d):
    a = Q(s, d)
    answers = a.where("difficulty <> 'easy'").groupBy("mcq_id").agg(F.max("difficulty").alias("answer"), F.max("clarity").alias("confidence"))
    return a.select("mcq_id").distinct().join(answers, "mcq_id", "left").select("mcq_id", F.coalesce("answer", F.lit("N/A")).alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


BATCHED = GRADED + ", b AS (SELECT strftime(ts, '%Y-%m') AS batch, fact_id, passed AND accepted = 1 AS passed FROM g JOIN episodes USING (episode_id))\n"


def batched(s, d):
    """Graded questions with their batch, here the month of their episode, which has to be accepted as well."""
    month = D.episodes(s, d).select("episode_id", F.date_format("ts", "yyyy-MM").alias("batch"), "accepted")
    return graded(s, d).join(month, "episode_id").select("batch", "fact_id", (F.col("passed") & (F.col("accepted") == 1)).alias("passed"))


@q("facts_for_batch", BATCHED + "SELECT DISTINCT batch, fact_id FROM b WHERE fact_id IN (SELECT p_partkey FROM part)", "episodes", "mcqs")
def facts_for_batch(s, d):
    """The facts that each batch asks for, as far as they exist."""
    asked = batched(s, d).select("batch", "fact_id").distinct()
    return asked.join(D.table(s, d, "part").select(F.col("p_partkey").alias("fact_id")), "fact_id", "left_semi").select("batch", "fact_id")


@q("pending_facts", BATCHED + "SELECT DISTINCT batch, fact_id FROM b ANTI JOIN (SELECT batch, fact_id FROM b WHERE passed) USING (batch, fact_id)", "episodes", "mcqs")
def pending_facts(s, d):
    """The facts of each batch that no accepted question of the batch covers."""
    covered = batched(s, d).groupBy("batch", "fact_id").agg(F.bool_or("passed").alias("done"))
    return covered.where("not done").select("batch", "fact_id")


# metrics
agg("m_msv", "SELECT round(coalesce(avg(CAST(format >= 0.5 AS INT)), 0) * 1e4) / 1e4 AS value FROM mcqs", metrics.structural_validity)
agg("m_ga", "SELECT round(coalesce(avg(CAST(grounding >= 0.80 AS INT)), 0) * 1e4) / 1e4 AS value FROM mcqs", metrics.grounding_accuracy)
agg("m_dqs", "SELECT round(avg(distractor) * 1e4) / 1e4 AS value FROM mcqs", lambda x: metrics.mean(x, "distractor"))
agg("m_cs", "SELECT round(avg(clarity) * 1e4) / 1e4 AS value FROM mcqs", lambda x: metrics.mean(x, "clarity"))


def levels(name: str, target: dict[str, float]) -> None:
    want = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in target.items())

    @q(name, f", w(difficulty, t) AS (VALUES {want}), o AS (SELECT difficulty, count(*) / (SELECT count(*) FROM mcqs)::DOUBLE AS share FROM mcqs GROUP BY difficulty) SELECT round(avg(abs(coalesce(t, 0) - coalesce(share, 0))) * 1e4) / 1e4 AS value FROM w FULL JOIN o USING (difficulty)")
    def run(s, d):
        w = s.createDataFrame(list(target.items()), "difficulty string, t double")
        o = Q(s, d).groupBy("difficulty").agg(F.count("*").alias("n"))
        total = o.agg(F.sum("n").alias("total"))
        share = o.crossJoin(F.broadcast(total)).select("difficulty", (F.col("n") / F.col("total")).alias("share"))
        return w.join(share, "difficulty", "full").agg(T.rnd(F.avg(F.abs(F.coalesce("t", F.lit(0.0)) - F.coalesce("share", F.lit(0.0)))), 4).alias("value"))


#: The shares of the levels that are aimed at.
LEVELS = {"m_dce": {"easy": 0.33, "medium": 0.34, "hard": 0.33}, "m_ddms": {"easy": 0.25, "medium": 0.50, "hard": 0.25}}
for _metric, _target in LEVELS.items():
    levels(_metric, _target)

for _name, (_over, _under, _n) in metrics.RATIOS.items():

    @q(_name, f"SELECT round(sum({_over}) / nullif(sum({_under}), 0)::DOUBLE * 1e{_n}) / 1e{_n} AS value FROM telemetry", "telemetry")
    def _ratio(s, d, name=_name):
        return metrics.ratio(D.telemetry(s, d), name)


@q("m_as", "SELECT CAST(nullif(max(iterations_to_target), 0) AS BIGINT) AS value FROM telemetry", "telemetry")
def m_as(s, d):
    return metrics.adaptation_speed(D.telemetry(s, d))


@q("m_ggle", """, g AS (SELECT round(avg(CAST(grounding >= 0.80 AS INT)) * 1e4) / 1e4 AS ga FROM mcqs), t AS (SELECT sum(accepted_mcqs) AS k, sum(cost_usd) AS cost, greatest(max(iterations_to_target), 1) AS rounds FROM telemetry)
SELECT CASE WHEN cost > 0 THEN round(k * ga / (cost * rounds) * 1e6) / 1e6 END AS value FROM g, t""", "mcqs", "telemetry")
def m_ggle(s, d):
    return metrics.graph_grounded_efficiency(Q(s, d), D.telemetry(s, d))


@query("m_jas", D.sql(SCORED + """, machine AS (SELECT CAST(regexp_extract(fact_id, '^(.*)-[0-9]+$', 1) AS BIGINT) AS doc_id, round(avg(composite) * 1e6) / 1e6 >= 0.55 AS yes FROM scored GROUP BY 1)
SELECT round(avg(CAST((quality = 1) = yes AS INT)) * 1e4) / 1e4 AS value FROM labels JOIN machine USING (doc_id)""", "parts"))
def m_jas(s, d):
    """The labels of documents against the mean composite of their sentences, which accepts or refines from .55 on."""
    human = D.table(s, d, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("yes"))
    return metrics.judge_agreement(human, machine_verdicts(D.scored_facts(s, d)))


def machine_verdicts(scored):
    mean = scored.groupBy(D.document_of(F.col("fact_id")).alias("case_id")).agg(T.rnd(F.avg("composite"), 6).alias("x"))
    return mean.select("case_id", T.fact_verdict(F.col("x")).isin("ACCEPT", "REFINE").alias("yes"))


@q("m_tas", ", b AS (SELECT unnest(['1-urgent', '2-high', 'other']) AS t) SELECT round(avg(CAST(t IN (SELECT lower(topic) FROM episodes) AS INT)) * 1e4) / 1e4 AS value FROM b", "episodes")
def m_tas(s, d):
    b = s.createDataFrame([("1-urgent",), ("2-high",), ("other",)], "t string")
    have = D.episodes(s, d).select(F.lower("topic").alias("t")).distinct().withColumn("have", F.lit(1))
    return b.join(have, "t", "left").agg(T.rnd(F.avg(F.coalesce("have", F.lit(0))), 4).alias("value"))


@query("m_chp", "SELECT round((" + " + ".join(f"CAST(bool_or(regexp_matches(lower(text), {lit(rx)})) AS INT)" for _, rx in HISTORICAL) + ") / 7::DOUBLE * 1e4) / 1e4 AS value FROM conversations")
def m_chp(s, d):
    return metrics.historical_patterns(D.table(s, d, "conversations"))


def rows_of(one, values):
    """(metric, value) of one row of aggregates."""
    cells = [F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in values.items()]
    return one.select(F.inline(F.array(*cells)))


def share(over, under, n):
    return T.rnd(over / F.nullif(under, F.lit(0)), n)


@query("full_report")
def full_report(s, d):
    """(metric, value) of the whole family; each table is read once, and its metrics come from one row of aggregates.

    Documents are written once, as facts, near duplicates and matches all read them; facts are added up by document.
    """
    from . import curation as C

    docs = written(D.spread(D.table(s, d, "documents").select("doc_id", "lang", "source", "text")), "documents")
    scored = D.scored(D.facts_of(docs))
    n, c = F.count("*"), F.col
    usable, linked = c("verdict") != "REJECT", F.size(T.extract_entities(c("text"))) > 0
    by_document = written(
        scored.groupBy(D.document_of(c("fact_id")).alias("case_id"), "topic").agg(
            n.alias("n"), F.sum("composite").alias("composite"), F.count_if(usable).alias("usable"),
            F.count_if(usable & (D.place_of(c("fact_id")) <= 2)).alias("used"), F.count_if(linked).alias("linked"),
        ), "by-document",
    )
    by_topic = by_document.groupBy("topic").agg(*[F.sum(x).alias(x) for x in ("n", "composite", "usable", "used", "linked")])
    covered = F.size(F.array_intersect(F.collect_list(F.when(c("usable") >= 3, c("topic"))), F.array(*map(F.lit, C.TARGETS))))
    facts = by_topic.agg(covered.alias("covered"), *[F.sum(x).alias(x) for x in ("n", "composite", "usable", "used", "linked")])
    out = [
        rows_of(facts, {
            "m_fqs": share(c("composite"), c("n"), 4), "m_gcs": F.coalesce(share(c("linked"), c("n"), 4), F.lit(0.0)),
            "m_tcs": T.rnd(c("covered") / F.lit(float(len(C.TARGETS))), 4), "m_fus": F.coalesce(share(c("used"), c("usable"), 4), F.lit(0.0)),
        })
    ]
    human = D.table(s, d, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("yes"))
    machine = by_document.groupBy("case_id").agg(T.rnd(F.sum("composite") / F.sum("n"), 6).alias("x"))
    out.append(rows_of(metrics.judge_agreement(human, machine.select("case_id", T.fact_verdict(c("x")).isin("ACCEPT", "REFINE").alias("yes"))), {"m_jas": c("value")}))

    # questions by level, of which there are few
    levels_ = written(
        Q(s, d).groupBy("difficulty").agg(
            n.alias("n"), F.count_if(c("format") >= metrics.VALID).alias("valid"), F.count_if(c("grounding") >= metrics.GROUNDED).alias("grounded"),
            F.sum("distractor").alias("distractor"), F.sum("clarity").alias("clarity"),
        ), "levels",
    )
    counted = F.map_from_entries(F.collect_list(F.struct("difficulty", "n")))
    asked = levels_.agg(counted.alias("level"), *[F.sum(x).alias(x) for x in ("n", "valid", "grounded", "distractor", "clarity")])
    each = lambda target: F.aggregate(
        F.array_union(F.map_keys("level"), F.array(*map(F.lit, target))), F.lit(0.0),
        lambda a, k: a + F.abs(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in target.items() for x in kv]), k), F.lit(0.0)) - F.coalesce(F.try_element_at("level", k) / c("n"), F.lit(0.0))),
    ) / F.size(F.array_union(F.map_keys("level"), F.array(*map(F.lit, target))))
    grounded = F.coalesce(share(c("grounded"), c("n"), 4), F.lit(0.0))
    out.append(rows_of(asked, {
        "m_msv": F.coalesce(share(c("valid"), c("n"), 4), F.lit(0.0)), "m_ga": grounded, "m_dqs": share(c("distractor"), c("n"), 4), "m_cs": share(c("clarity"), c("n"), 4),
        **{name: T.rnd(each(target), 4) for name, target in LEVELS.items()},
    }))
    columns = sorted({x for over, under, _ in metrics.RATIOS.values() for x in (over, under)})
    told = written(D.telemetry(s, d).agg(*[F.sum(x).alias(x) for x in columns], F.max("iterations_to_target").alias("most")), "told")
    out.append(rows_of(told, {
        "m_as": F.nullif(c("most"), F.lit(0)), **{name: share(c(over), c(under), k) for name, (over, under, k) in metrics.RATIOS.items()},
    }))
    both = asked.select(grounded.alias("ga")).crossJoin(told)  # one row each
    spent = c("cost_usd") * F.greatest(c("most"), F.lit(1))
    out.append(rows_of(both, {"m_ggle": F.when(c("cost_usd") > 0, T.rnd(c("accepted_mcqs") * c("ga") / spent, 6))}))

    out.append(rows_of(m_tas(s, d), {"m_tas": c("value")}))
    out.append(rows_of(m_chp(s, d), {"m_chp": c("value")}))
    rows = docs.select(c("doc_id").alias("id"), "text")
    out.append(rows_of(C.merged_share(rows), {"m_rrr": c("value")}))
    out.append(rows_of(metrics.mean(S.best_match(rows, D.table(s, d, "benchmark")), "best"), {"m_qss": c("value")}))
    return reduce(DataFrame.unionByName, out)


# keyed state
def calls(s, d):
    e = D.table(s, d, "events")
    zone = F.when(F.col("event_type") == "purchase", "generate").when(F.col("event_type") == "click", "feedback").otherwise("default")
    return e.select(F.col("event_id").alias("call_id"), F.col("user_id").cast("string").alias("key"), zone.alias("zone"), F.col("ts").cast("timestamp").cast("double").alias("at"))


@query("api_rate_limit")
def api_rate_limit(s, d):
    return limits.rate_limit(calls(s, d), 5 * 86400.0)


@query("rate_range_count", "SELECT event_id AS call_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_range_count(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("us").rangeBetween(-86_400_000_000, 0)
    e = D.table(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select(F.col("event_id").alias("call_id"), F.count("*").over(w).alias("n"))


@query("ttl_cache")
def ttl_cache(s, d):
    log = RL(s, d).select(F.col("stage").alias("cache"), "seq", F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("run_id").cast("string").alias("key"))
    return limits.replay_cache(log, 64, 86400.0)


@query("json_repair")
def json_repair(s, d):
    e = D.table(s, d, "events")
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.regexp_replace("props", r"\}$", "")).otherwise(F.col("props"))
    return e.select("event_id", loop.json_repair(broken).alias("json"))


# the loop, with a stand-in for the model
def topk(s, d):
    """Facts that are ready for questions, of all topics."""
    from . import curation as C

    return C.usable(s, d).where("readiness >= 0.5").select("fact_id", "text", "composite")


def no_seen(s):
    return s.createDataFrame([], "h string")


def caller():
    return Caller(loop.by_rule, throttle=Throttle(calls=1 << 30))


@query("crj_round")
def crj_round(s, d):
    facts = loop.chunked(topk(s, d))
    return loop.one_round(facts, no_seen(s), loop.Round(), caller()).select("mcq_id", "fact_id", "question", "quality", "passed")


@query("crj_loop")
def crj_loop(s, d):
    return loop.in_batches(topk(s, d), no_seen(s), caller()).select("mcq_id", "fact_id", "round", "quality")


@query("all_difficulties")
def all_difficulties(s, d):
    """The five best facts of all, for each level."""
    return loop.all_difficulties(topk(s, d), no_seen(s), caller()).select("mcq_id", "fact_id", "difficulty", "round", "quality")


@query("model_scores")
def model_scores(s, d):
    """Scores of turns as questions; the stand-in answers only even ones, the others fail as a broken reply does."""
    c = D.table(s, d, "conversations")
    asked = c.select(F.concat_ws("-", "conv_id", "turn").alias("mcq_id"), F.col("text").alias("question"), F.create_map(F.lit("A"), F.lit("x")).alias("options"), F.lit("A").alias("correct_answer"), F.col("turn").cast("string").alias("fact"))
    return model.score_questions(asked, Caller(graded_by_rule, throttle=Throttle(calls=1 << 30), tries=1))


def graded_by_rule(system: str, user: str, temperature: float) -> str:
    even = int(user.rsplit("Fact: ", 1)[1].split("\n")[0]) % 2 == 0
    return '{"grounding_score": 0.9, "clarity_score": "0.8", "distractor_score": 0.7, "failure_codes": []}' if even else "no JSON"

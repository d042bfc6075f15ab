"""The metric family: each metric is one aggregate over its own input and gives one row (value).

Telemetry is a table with a row for each run and the columns of ``TELEMETRY``; a metric over it divides sums. An empty
denominator gives null unless the metric says 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.wordlists import HISTORICAL

#: Columns of a run: counts of the run, its cost in dollars and its time in seconds.
TELEMETRY = (
    "pipeline_runs", "successful_runs", "cost_usd", "processing_seconds", "agent_interactions", "episodes_assisted", "generations", "accepted_mcqs", "regenerated_mcqs",
    "improved_after_regen", "initial_failures", "corrected_failures", "regen_with_feedback", "regen_improved_with_feedback", "low_quality_identified", "low_quality_removed", "iterations_to_target",
)
#: Numerator, denominator and decimals of the ratios over telemetry.
RATIOS = {
    "m_mus": ("episodes_assisted", "generations", 4),
    "m_les": ("accepted_mcqs", "generations", 4),
    "m_rir": ("improved_after_regen", "regenerated_mcqs", 4),
    "m_fe": ("low_quality_removed", "low_quality_identified", 4),
    "m_sce": ("corrected_failures", "initial_failures", 4),
    "m_aes": ("accepted_mcqs", "agent_interactions", 4),
    "m_feu": ("regen_improved_with_feedback", "regen_with_feedback", 4),
    "m_eesr": ("successful_runs", "pipeline_runs", 4),
    "m_cam": ("cost_usd", "accepted_mcqs", 6),
    "m_lso": ("processing_seconds", "accepted_mcqs", 2),
}
#: Grounding from which a question counts as grounded, and format from which it is valid.
GROUNDED, VALID = 0.80, 0.5


def ratio(telemetry: DataFrame, metric: str) -> DataFrame:
    over, under, n = RATIOS[metric]
    return telemetry.agg(T.rnd(F.sum(over) / F.nullif(F.sum(under), F.lit(0)), n).alias("value"))


def adaptation_speed(telemetry: DataFrame) -> DataFrame:
    """Iterations until the target was reached, in the run that took longest; null if none was counted."""
    return telemetry.agg(F.nullif(F.max("iterations_to_target"), F.lit(0)).cast("long").alias("value"))


def grounded_share(evaluations: DataFrame) -> Column:
    return F.coalesce(F.avg((F.col("grounding") >= GROUNDED).cast("int")), F.lit(0.0))


def grounding_accuracy(evaluations: DataFrame) -> DataFrame:
    return evaluations.agg(T.rnd(grounded_share(evaluations), 4).alias("value"))


def structural_validity(evaluations: DataFrame) -> DataFrame:
    return evaluations.agg(T.rnd(F.coalesce(F.avg((F.col("format") >= VALID).cast("int")), F.lit(0.0)), 4).alias("value"))


def graph_grounded_efficiency(evaluations: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Accepted questions times grounding accuracy, per dollar and iteration (at least one); null without a cost."""
    ga = evaluations.agg(T.rnd(grounded_share(evaluations), 4).alias("ga"))
    spent = telemetry.agg(F.sum("accepted_mcqs").alias("k"), F.sum("cost_usd").alias("cost"), F.greatest(F.max("iterations_to_target"), F.lit(1)).alias("rounds"))
    return ga.crossJoin(spent).select(F.when(F.col("cost") > 0, T.rnd(F.col("k") * F.col("ga") / (F.col("cost") * F.col("rounds")), 6)).alias("value"))  # one row each


def mean(rows: DataFrame, column: str, n: int = 4) -> DataFrame:
    return rows.agg(T.rnd(F.avg(column), n).alias("value"))


def judge_agreement(human: DataFrame, machine: DataFrame) -> DataFrame:
    """Share of cases (case_id, yes) that both judges decide alike; cases that one of them left out do not count."""
    both = human.select("case_id", F.col("yes").alias("h")).join(machine.select("case_id", F.col("yes").alias("m")), "case_id")
    return both.agg(T.rnd(F.avg((F.col("h") == F.col("m")).cast("int")), 4).alias("value"))


def historical_patterns(questions: DataFrame, column: str = "text") -> DataFrame:
    """Share of the families of historical question patterns that some question fits; 0 without questions."""
    low = F.lower(column)
    found = sum((F.coalesce(F.bool_or(low.rlike(rx)), F.lit(False)).cast("int") for _, rx in HISTORICAL), F.lit(0))
    return questions.agg(T.rnd(found / float(len(HISTORICAL)), 4).alias("value"))


def topic_coverage(facts: DataFrame, targets: DataFrame, least: int = 3) -> DataFrame:
    """Share of target topics with ``least`` facts that are not rejected; 0 without targets."""
    n = facts.where("verdict <> 'REJECT'").groupBy("topic").agg(F.count("*").alias("n"))
    return targets.join(n, "topic", "left").agg(F.coalesce(T.rnd(F.avg((F.coalesce("n", F.lit(0)) >= least).cast("int")), 4), F.lit(0.0)).alias("value"))


def fact_utilisation(facts: DataFrame, used: DataFrame) -> DataFrame:
    """Share of usable facts (fact_id, verdict) that ``used`` (fact_id) names; 0 without usable ones."""
    usable = facts.where("verdict not in ('REJECT', 'REJECT_AFTER_REFINE')").select("fact_id")
    hit = usable.join(used.select("fact_id").distinct().withColumn("hit", F.lit(1)), "fact_id", "left")
    return hit.agg(F.coalesce(T.rnd(F.avg(F.coalesce("hit", F.lit(0))), 4), F.lit(0.0)).alias("value"))

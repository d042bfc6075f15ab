"""Event memory: retrieval, decay, pruning, ratings and export over the episode tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written

DAY = 86400.0


def seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def with_now(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds ``now``, the latest ``ts``: one row of one aggregate, so broadcasting it is bounded."""
    return df.crossJoin(F.broadcast(df.agg(F.max(ts).alias("now"))))


def with_decay(episodes: DataFrame) -> DataFrame:
    age = F.floor((seconds(F.col("now")) - seconds(F.col("ts"))) / DAY)
    return with_now(episodes).withColumn("age_days", age).withColumn("decay", T.decay(F.col("age_days"), F.col("accepted"), F.col("score")))


def doomed(episodes: DataFrame, threshold: float = 0.1, max_age: int = 90) -> DataFrame:
    """Episodes to forget: not (accepted and above .85), and decayed below the threshold or old and rejected."""
    safe = (F.col("accepted") == 1) & (F.col("score") > 0.85)
    old = seconds(F.col("ts")) < seconds(F.col("now")) - max_age * DAY
    return with_decay(episodes).where(~safe & ((F.col("decay") < threshold) | (old & (F.col("accepted") == 0))))


def similar(episodes: DataFrame, links: DataFrame, topic: str | None, fact_ids: list[int], min_score: float, limit: int) -> DataFrame:
    """Episodes of a topic by score, then those that share facts; each with the facts it shares, at most ``limit``.

    Without a topic and facts they are the newest of enough score, none of which shares a fact.
    """
    good = episodes.where(F.col("score") >= min_score)
    if not topic and not fact_ids:
        newest = good.orderBy(F.desc("ts"), "episode_id").limit(limit)
        return newest.select("episode_id", "score", F.lit(0).alias("rank"), F.lit("").alias("matched_facts"))
    a = good.where(F.col("topic") == topic).orderBy(F.desc("score"), "episode_id").limit(limit).select("episode_id", "score", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("fact_id"))
    b = good.join(links.where(F.col("fact_id").isin(*fact_ids)), "episode_id").select("episode_id", "score", F.lit(1).alias("rank"), "fact_id")
    both = a.unionByName(b).groupBy("episode_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.array_sort(F.collect_set("fact_id")).alias("matched"))
    return both.orderBy("rank", F.desc("score"), "episode_id").limit(limit).select("episode_id", "score", "rank", F.array_join("matched", ",").alias("matched_facts"))


def containing(texts: DataFrame, needles: DataFrame, longest: int = 3) -> DataFrame:
    """(id, needle) of texts (id, text) that contain a needle (needle), each pair once.

    A substring join: texts are cut into all runs of 1 to ``longest`` characters, as far as some needle is as short as
    that; each needle is looked up by the one of its runs that the fewest texts have, and what that finds is compared in
    full. Null and empty needles, and null texts, are in no pair.
    """
    needles = written(needles.select(F.col("needle").cast("string")).where("needle <> ''").distinct(), "needles")
    texts = texts.select("id", F.col("text").cast("string").alias("text")).where("text <> ''")
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substr(c, i, F.lit(n))))
    sizes = [r.n for r in needles.select(F.least(F.length("needle"), F.lit(longest)).alias("n")).distinct().collect()]  # at most ``longest``
    out = None
    for n in sizes:
        mine = needles.where(F.length("needle") == n if n < longest else F.length("needle") >= n)
        cut = written(texts.where(F.length("text") >= n).select("id", "text", F.explode(runs(F.col("text"), n)).alias("run")), "runs")
        often = cut.groupBy("run").agg(F.count("*").alias("k"))
        asked = mine.select("needle", F.explode(runs(F.col("needle"), n)).alias("run")).join(often, "run")
        # a needle with a run that no text has is in none; its other runs find what the comparison then drops
        rarest = asked.groupBy("needle").agg(F.min_by("run", F.struct("k", "run")).alias("run"))
        found = cut.join(rarest, "run").where(F.contains("text", "needle")).select("id", "needle")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else texts.select("id", F.lit("").alias("needle")).limit(0)


def export(mcqs: DataFrame, episodes: DataFrame, feedback: DataFrame, min_quality: float, limit: int) -> DataFrame:
    """Questions of enough quality, newest first, the limit before their ratings are joined."""
    top = mcqs.where(F.col("quality") >= min_quality).join(episodes, "episode_id").orderBy(F.desc("ts"), "mcq_id").limit(limit)
    rated = feedback.groupBy("episode_id").agg(T.rnd(F.avg("rating"), 2).alias("avg_rating"), F.count("*").alias("n_ratings"))
    return top.join(rated, "episode_id", "left").select("mcq_id", "episode_id", "topic", "difficulty", T.rnd(F.col("quality"), 6).alias("quality"), "avg_rating", F.coalesce("n_ratings", F.lit(0)).alias("n_ratings"))


def low_points(feedback: DataFrame) -> DataFrame:
    """(fact_id, points, last) of ratings below 3 (fact_id, rating, created_at, id): the points below 3, added up, and the latest of them."""
    low = feedback.where("rating <= 2 and fact_id is not null").groupBy("fact_id")
    return low.agg(F.sum(3 - F.col("rating")).alias("points"), F.max(F.struct("created_at", "id", "rating")).alias("last"))


def merged_points(points: DataFrame) -> DataFrame:
    """Points of several parts of the ratings as those of the whole."""
    return points.groupBy("fact_id").agg(F.sum("points").alias("points"), F.max("last").alias("last"))


def from_points(points: DataFrame, composites: DataFrame | None = None) -> DataFrame:
    """(fact_id, composite, user_feedback_low): the fact's composite, .5 if it has none, less .1 for each point, never below 0; and its latest low rating."""
    rows = points if composites is None else points.join(composites.select("fact_id", "composite"), "fact_id", "left")
    start = F.lit(0.5) if composites is None else F.coalesce("composite", F.lit(0.5))
    left = F.greatest(F.lit(0.0), start - 0.1 * F.col("points"))
    return rows.select("fact_id", T.rnd(left, 6).alias("composite"), F.col("last.rating").cast("int").alias("user_feedback_low"))


def penalties(feedback: DataFrame, composites: DataFrame | None = None) -> DataFrame:
    """Facts after low ratings, each of which takes .1 per point below 3 from the fact's composite (fact_id, composite; .5 if it has none)."""
    return from_points(low_points(feedback), composites)


def chunks(df: DataFrame, size: int, *order: str, by: str) -> DataFrame:
    """Numbers consecutive chunks of ``size`` rows within each ``by``."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("chunk", F.floor((n - 1) / size).cast("int"))

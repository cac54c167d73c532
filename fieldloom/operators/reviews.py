"""What reviews tell of reviewers, days and costs. Reviews: object, reviewer, action, before, after (classes), ms, t (microseconds).

Machine reviewers are left out throughout, as are reviews without a reviewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which machines review, which actions correct or confirm, costs of labour and of a label by hand.
MACHINES = ("system", "relabel", "gate", "autolabel", "error-detect", "vlm-qa", "inspector_health")
CORRECTIONS = ("reclassify", "reclassify_track", "reject", "adjust_geometry", "error_fix", "split_track", "merge_track")
CONFIRMATIONS = ("accept", "confirm")
USD_PER_HOUR, SECONDS_BY_HAND = 8.0, 20.0
DAY = 86_400_000_000


def by_people(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("reviewer").isNotNull() & ~F.col("reviewer").isin(*MACHINES))


def classed() -> tuple[Column, Column]:
    """How many reviews know both classes, and in how many of those they are one."""
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    return F.count(F.when(both, 1)), F.count(F.when(both & (F.col("before") == F.col("after")), 1))


def reviewer_metrics(reviews: DataFrame) -> DataFrame:
    """(reviewer, reviews, correction_rate, avg_ms, per_hour, agreement); rates without a case, and speeds of hardly any time, are null."""
    ms = F.sum(F.coalesce("ms", F.lit(0)))
    n, fixed, kept = F.count(F.lit(1)), F.count(F.when(F.col("action").isin(*CORRECTIONS), 1)), F.count(F.when(F.col("action").isin(*CONFIRMATIONS), 1))
    both, same = classed()
    hours = ms / 3.6e6
    return by_people(reviews).groupBy("reviewer").agg(
        n.alias("reviews"), F.when(fixed + kept > 0, fixed / (fixed + kept)).alias("correction_rate"), (ms / n).alias("avg_ms"),
        F.when(hours > 0.01, n / hours).alias("per_hour"), F.when(both > 0, same / both).alias("agreement"),
    )


def shared_agreement(reviews: DataFrame, unique: str = "review_id") -> DataFrame:
    """One row (shared, agreed, rate): of the objects that several people classed, on how many their last words are one."""
    last = by_people(reviews).where(F.col("after").isNotNull()).groupBy("object", "reviewer").agg(F.max_by("after", F.struct("t", unique)).alias("last"))
    objects = last.groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.min("last").alias("a"), F.max("last").alias("b")).where("n >= 2")
    n, same = F.count(F.lit(1)), F.count(F.when(F.col("a") == F.col("b"), 1))
    return objects.agg(n.alias("shared"), same.alias("agreed"), F.when(n > 0, same / n).alias("rate"))


def throughput(reviews: DataFrame, days: int = 30) -> DataFrame:
    """(day, reviews, agreement) of the last `days` days that have reviews; days are whole ones since 1970."""
    both, same = classed()
    per = by_people(reviews).where(F.col("t") > 0).groupBy(F.floor(F.col("t") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("reviews"), F.when(both > 0, same / both).alias("agreement"))
    return per.orderBy(F.desc("day")).limit(days)


def costs(reviews: DataFrame, objects: DataFrame, frame: str, state: str) -> DataFrame:
    """One row: hours and dollars of review, objects, frames, what each cost, and what labels accepted by machine saved."""
    work = reviews.agg((F.sum(F.coalesce("ms", F.lit(0))) / 3.6e6).alias("human_hours"))
    made = objects.agg(F.count(F.lit(1)).alias("n_objects"), F.count_distinct(frame).alias("n_frames"), F.count(F.when(F.col(state) == "auto_accept", 1)).alias("n_auto"))
    out = work.crossJoin(made).withColumn("human_hours", F.coalesce("human_hours", F.lit(0.0))).withColumn("human_usd", F.col("human_hours") * USD_PER_HOUR)
    each = lambda n: F.when(F.col(n) > 0, F.col("human_usd") / F.col(n))
    saved = F.col("n_auto") * SECONDS_BY_HAND / 3600
    return out.select("human_hours", "human_usd", "n_objects", "n_frames", "n_auto", each("n_objects").alias("usd_per_object"), each("n_frames").alias("usd_per_frame"), saved.alias("saved_hours"), (saved * USD_PER_HOUR).alias("saved_usd"))

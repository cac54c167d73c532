"""Counts for exploring a selection: facets that leave their own clause out, histograms, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .predicate import all_of

# The bounds of the confidence histogram.
CONF_BOUNDS = (0.0, 0.3, 0.5, 0.7, 0.9, 1.01)


def leave_one_out(df: DataFrame, facets: dict[str, tuple[str, Column]], limit: int = 200) -> DataFrame:
    """(facet, value, n) with each facet counted under all conditions but its own; nulls are left out.

    One scan: every row is tagged with the facets it counts for, exploded, and counted once.
    """
    tags = []
    for name, (column, _) in facets.items():
        others = all_of([c for other, (_, c) in facets.items() if other != name])
        tags.append(F.when(others, F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value"))))
    found = df.select(F.explode(F.array_compact(F.array(*tags))).alias("x")).select("x.*").where(F.col("value").isNotNull())
    counts = found.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def histogram(df: DataFrame, column: str, bounds=CONF_BOUNDS) -> DataFrame:
    """(low, high, n) of half-open buckets, empty ones included."""
    buckets = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.count(F.when((F.col(column) >= a) & (F.col(column) < b), 1)).alias("n")) for a, b in zip(bounds, bounds[1:], strict=False)))
    return df.agg(buckets.alias("all")).select(F.explode("all").alias("x")).select("x.*")


def tag_counts(df: DataFrame, tags: str | Column, limit: int = 100) -> DataFrame:
    counts = df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "tag").limit(limit)


def zero_filled(domain: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Counts for every value of a domain."""
    return domain.select(key).distinct().join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").fillna(0, ["n"])


def mix_percent(df: DataFrame, *keys: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def idf(df: DataFrame, key: str, document: str, n_documents: int) -> DataFrame:
    """Normalised inverse document frequency of each key, six places."""
    counts = df.groupBy(key).agg(F.count_distinct(document).alias("n"))
    return counts.withColumn("idf", F.round(F.log((n_documents + 1.0) / (F.col("n") + 1)) / F.log(F.lit(n_documents + 1.0)), 6))


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """The element n // 2 of the sorted values (not interpolated)."""
    order = Window.orderBy(column)
    ranked = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_times"))
    ranked = ranked.withColumns({"upto": F.sum("_times").over(order), "all": F.sum("_times").over(Window.partitionBy())})
    return ranked.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min(column).alias("median"))

"""What tracks do over time: approach, rest, dwelling in zones, lane crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import islands


def growth(df: DataFrame, key: str, order: list[str], size: str) -> DataFrame:
    """(key, n, growth): the median of the last third of a track over that of its first third."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumns({"_r": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    first, last = F.median(F.when(F.col("_r") <= k, F.col(size))), F.median(F.when(F.col("_r") > F.col("_n") - k, F.col(size)))
    return ranked.groupBy(key).agg(F.max("_n").alias("n"), F.when(first > 0, last / first).alias("growth"))


def motion(df: DataFrame, key: str, still: Column) -> DataFrame:
    """(key, motion): static if it never moved, dynamic if it always did, else mixed."""
    always, never = F.min(still.cast("int")) == 1, F.max(still.cast("int")) == 0
    return df.groupBy(key).agg(F.when(always, "static").when(never, "dynamic").otherwise("mixed").alias("motion"))


def dwells(df: DataFrame, key: str, time: str, order: list[str], inside: Column, least: int) -> DataFrame:
    """(key, start, end): stays in a zone of at least `least`, from entering to the last sample inside."""
    runs = islands(df, key, order, F.coalesce(inside, F.lit(False))).where("_state")
    stays = runs.groupBy(key, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"))
    return stays.where(F.col("end") - F.col("start") >= least).select(key, "start", "end")


def crossings(df: DataFrame, key: str, order: list[str], offset: str, after: int = 3, least: float = 0.0) -> DataFrame:
    """Rows at which a signed offset changes side and stays there for the next rows, far enough from the line."""
    w = Window.partitionBy(key).orderBy(*order)
    side = F.signum(offset)
    stays, far = F.lit(True), F.abs(offset)
    for k in range(1, after + 1):
        stays = stays & (F.lead(side, k).over(w) == side)
        far = F.greatest(far, F.abs(F.lead(offset, k).over(w)))
    flips = (F.lag(side).over(w) * side) < 0
    found = df.withColumns({"_ok": flips & stays, "_far": far})
    return found.where(F.col("_ok") & (F.col("_far") >= least)).drop("_ok", "_far")

"""Ordered analytics on windows: runs, moving neighbourhoods, gaps, joins in time.

Every window is partitioned by a key (session, track, camera); orders end in a unique column, so ties are settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, order: list[str], state: Column, out: str = "island") -> DataFrame:
    """Numbers runs of equal state; a null state is a run of its own kind and separates its neighbours."""
    w = Window.partitionBy(key).orderBy(*order)
    previous = F.lag("_state").over(w)
    change = F.when(F.row_number().over(w) == 1, 1).when(F.col("_state").eqNullSafe(previous), 0).otherwise(1)
    return df.withColumn("_state", state).withColumn("_change", change).withColumn(out, F.sum("_change").over(w)).drop("_change")


def state_segments(df: DataFrame, key: str, time: str, order: list[str], state: Column) -> DataFrame:
    """(key, island, state, start, end, n) for runs of non-null state."""
    runs = islands(df, key, order, state).where(F.col("_state").isNotNull())
    return runs.groupBy(key, "island", F.col("_state").alias("state")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))


def threshold_runs(df: DataFrame, key: str, time: str, order: list[str], value: str, over: Column) -> DataFrame:
    """Runs in which `over` holds, with the value largest in size (the earlier of equals)."""
    runs = islands(df, key, order, F.coalesce(over, F.lit(False))).where("_state")
    peak = F.max_by(value, F.struct(F.abs(value), *(-F.col(c) for c in order)))
    return runs.groupBy(key, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"), peak.alias("peak"))


def invalid_transitions(segments: DataFrame, key: str, allowed: DataFrame) -> DataFrame:
    """Segments followed by one that (state, next) of `allowed` does not list; states it does not know are skipped."""
    w = Window.partitionBy(key).orderBy("island")
    steps = segments.withColumn("next", F.lead("state").over(w)).where(F.col("next").isNotNull())
    known = steps.join(F.broadcast(allowed.select("state").distinct()), "state", "left_semi")
    return known.join(F.broadcast(allowed), ["state", "next"], "left_anti")


def flicker(segments: DataFrame, key: str, shortest: int) -> DataFrame:
    """Short segments between two of one other state."""
    w = Window.partitionBy(key).orderBy("island")
    around = segments.withColumns({"before": F.lag("state").over(w), "after": F.lead("state").over(w)})
    return around.where((F.col("before") == F.col("after")) & (F.col("before") != F.col("state")) & (F.col("end") - F.col("start") < shortest))


def moving_deficit(df: DataFrame, key: str, order: str, n: str, around: int = 3, ratio: float = 0.4, least: float = 5) -> DataFrame:
    """Rows that hold far less than their neighbourhood's mean (the row itself included)."""
    mean = F.avg(n).over(Window.partitionBy(key).orderBy(order).rowsBetween(-around, around))
    found = df.withColumn("near", mean).where((F.col("near") >= least) & (F.col(n) < ratio * F.col("near")))
    return found.withColumn("deficit", 1 - F.col(n) / F.col("near"))


def sparsity(df: DataFrame, key: str, order: str, n: str, around: int = 8) -> DataFrame:
    """How far each row falls below the median of its neighbours, the row itself left out; 0 where that is below 1."""
    w = Window.partitionBy(key).orderBy(order)
    near = F.array_sort(F.concat(F.collect_list(n).over(w.rowsBetween(-around, -1)), F.collect_list(n).over(w.rowsBetween(1, around))))
    half = F.floor(F.size("near") / 2).cast("int")
    median = F.when(F.size("near") == 0, None).when(F.size("near") % 2 == 1, F.get("near", half)).otherwise((F.get("near", half - 1) + F.get("near", half)) / 2)
    found = df.withColumn("near", near).withColumn("median", median).drop("near")
    return found.withColumn("sparsity", F.when(F.col("median") >= 1, F.greatest(F.lit(0.0), (F.col("median") - F.col(n)) / F.col("median"))).otherwise(0.0))


def robust_z(df: DataFrame, key: str, value: str, least: int = 8) -> DataFrame:
    """Distance from the median in scaled median deviations, for keys with enough values."""
    medians = df.groupBy(key).agg(F.median(value).alias("median"), F.count(value).alias("n")).where(F.col("n") >= least)
    off = df.join(medians, key).withColumn("off", F.abs(F.col(value) - F.col("median")))
    mad = off.groupBy(key).agg(F.median("off").alias("mad"))
    return off.join(mad, key).withColumn("z", F.col("off") / (1.4826 * F.when(F.col("mad") > 0, F.col("mad")).otherwise(1e-6)))


def ego_state(df: DataFrame, key: str, order: list[str], t: str, speed: str, heading: str) -> DataFrame:
    """Acceleration, yaw rate and jerk between samples, from the last known values; seconds are t's units / 1e6."""
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def last(c):
        return F.last(c, ignorenulls=True).over(before)

    dt = (F.col(t) - F.lag(t).over(w)) / 1e6
    df = df.withColumn("dt", F.when(dt > 0, dt)).withColumn("accel", (F.col(speed) - last(speed)) / F.col("dt"))
    turn = F.pmod(F.col(heading) - last(heading) + 180.0, F.lit(360.0)) - 180.0
    df = df.withColumn("yaw_rate", turn / F.col("dt")).withColumn("lateral", F.col(speed) * F.radians("yaw_rate"))
    return df.withColumn("jerk", (F.col("accel") - last("accel")) / F.col("dt"))


def interpolated(df: DataFrame, key: str, order: str, value: str, most: int = 5, decay: float = 0.9) -> DataFrame:
    """Fills runs of at most `most` nulls between two values in a straight line, with a confidence that decays."""
    w = Window.partitionBy(key).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v"), F.col("_row").alias("row")))
    df = df.withColumn("_row", F.row_number().over(w)).withColumn("_known", known)
    df = df.withColumns({"_a": F.last("_known", ignorenulls=True).over(back), "_b": F.first("_known", ignorenulls=True).over(ahead)})
    gap = F.col("_b.row") - F.col("_a.row") - 1
    part = (F.col(order) - F.col("_a.at")) / (F.col("_b.at") - F.col("_a.at"))
    fits = F.col(value).isNull() & (gap <= most)
    filled = F.when(fits, F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * part)
    conf = F.when(F.col(value).isNotNull(), 1.0).when(fits, F.pow(F.lit(decay), F.col("_row") - F.col("_a.row")))
    return df.withColumns({"filled": F.coalesce(value, filled), "fill_conf": conf}).drop("_row", "_known", "_a", "_b")


def majority_filter(df: DataFrame, key: str, order: str, label: str, around: int = 2) -> DataFrame:
    """The most common label among neighbours; a row keeps its own if that ties for the top."""
    near = F.collect_list(label).over(Window.partitionBy(key).orderBy(order).rowsBetween(-around, around))
    times = F.transform(F.array_distinct("_near"), lambda x: F.struct(F.size(F.filter("_near", lambda y: y == x)).alias("n"), x.alias("label")))
    top = F.array_max(F.transform("_times", lambda x: x["n"]))
    own = F.exists("_times", lambda x: (x["label"] == F.col(label)) & (x["n"] == top))
    best = F.array_min(F.transform(F.filter("_times", lambda x: x["n"] == top), lambda x: x["label"]))
    df = df.withColumn("_near", near).withColumn("_times", times)
    return df.withColumn("smooth", F.when(own, F.col(label)).otherwise(best)).drop("_near", "_times")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, t: str, carry: str, most: int | None = None) -> DataFrame:
    """For each left row the right row of its key nearest in time, the earlier of two as near: both sides are merged
    in order and each row looks back and ahead, so no pair is tried that is not kept."""
    rows = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(f"struct<t: bigint, v: {right.schema[carry].dataType.simpleString()}>")})
    other = right.groupBy(key, t).agg(F.min(carry).alias(carry)).select(key, t, F.lit(0).alias("_side"), F.struct(F.col(t).alias("t"), F.col(carry).alias("v")).alias("_r"))
    both = rows.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(t, "_side")
    back = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_back": back, "_ahead": ahead}).where("_side = 1")
    use_back = F.col("_ahead").isNull() | (F.col(t) - F.col("_back.t") <= F.col("_ahead.t") - F.col(t))
    found = found.withColumn("_hit", F.when(F.col("_back").isNotNull() & use_back, F.col("_back")).otherwise(F.col("_ahead")))
    found = found.withColumns({"nearest_t": F.col("_hit.t"), f"nearest_{carry}": F.col("_hit.v")})
    if most is not None:
        ok = F.abs(F.col(t) - F.col("nearest_t")) <= most
        found = found.withColumns({c: F.when(ok, F.col(c)) for c in ("nearest_t", f"nearest_{carry}")})
    return found.drop("_side", "_r", "_back", "_ahead", "_hit")


def overlapping(left: DataFrame, right: DataFrame, key: str, unique: str, within: int, bucket: int) -> DataFrame:
    """Left rows that meet another row of the right side in time (inclusive, widened by `within`).

    Intervals are dealt into buckets of time, so that a key with many rows is split; a null end is a point.
    """

    def dealt(df, wide):
        end = F.coalesce("end", "start")
        return df.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("start") - wide) / bucket), F.floor((end + wide) / bucket))))

    a = dealt(left, within).alias("a")
    b = dealt(right.select(key, unique, "start", "end"), 0).alias("b")
    meets = (F.col("a.start") <= F.coalesce("b.end", "b.start") + within) & (F.col("b.start") - within <= F.coalesce("a.end", "a.start"))
    hit = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._bucket") == F.col("b._bucket")) & (F.col(f"a.{unique}") != F.col(f"b.{unique}")) & meets, "left_semi")
    return left.join(hit.select(unique).distinct(), unique, "left_semi")


def sync_groups(df: DataFrame, key: str, t: str, tolerance: int) -> DataFrame:
    """Groups samples of a key: one opens a group, all within `tolerance` of it belong to it, the next opens another."""
    import pandas as pd

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([t, *sorted(c for c in rows.columns if c != t)], kind="stable")
        out, start, n = [], None, -1
        for x in rows[t]:
            if start is None or x - start > tolerance:
                start, n = x, n + 1
            out.append(n)
        return rows.assign(sync_group=out)

    return df.groupBy(key).applyInPandas(group, df.withColumn("sync_group", F.lit(0).cast("long")).schema)


def trend(df: DataFrame, key: str, x: str, y: str, floor: float, warn: float = -0.03, least: int = 4) -> DataFrame:
    """Least-squares slope for each key and how many steps are left until `floor`."""
    fit = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.max_by(y, x).alias("latest")).where(F.col("n") >= least)
    left = F.when(F.col("slope") < 0, (floor - F.col("latest")) / F.col("slope"))
    level = F.when(~(F.col("slope") < warn), None).when(F.col("remaining") < 0, "critical").when(F.col("remaining") <= 3, "warn").otherwise("watch")
    return fit.withColumn("remaining", left).withColumn("level", level)

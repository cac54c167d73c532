"""Tracks from boxes, and what they do: an IoU tracker, trajectories, dynamics, zones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def iou_tracker(df: DataFrame, key: str, frame: str, least: float = 0.3, max_age: int = 5, min_length: int = 2) -> DataFrame:
    """Adds track_id within each key (camera): boxes join, frame by frame, the open track they overlap most.

    Pairs are taken by falling IoU; a track ends after `max_age` of the camera's frames without a box of its own
    (frames count as they come, whatever their values); short ones are dropped. The state is sequential in time, so each camera is one group, ordered by frame.
    """

    def overlap(a, b) -> float:
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
        return both / union if union > 0 else 0.0

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([frame, "id"]).reset_index(drop=True)
        open_, tracks, n = {}, [0] * len(rows), 0
        corners = list(zip(*(rows[c].tolist() for c in ("x1", "y1", "x2", "y2")), strict=True))
        for t, (_, part) in enumerate(rows.groupby(frame, sort=True)):
            open_ = {k: v for k, v in open_.items() if t - v[0] <= max_age}
            boxes = {i: corners[i] for i in part.index}
            pairs = sorted(((-overlap(v[1], b), k, i) for k, v in open_.items() for i, b in boxes.items()))
            used = set()
            for score, k, i in pairs:
                if -score < least:
                    break
                if k not in used and i in boxes:
                    open_[k] = (t, boxes.pop(i))
                    used.add(k)
                    tracks[i] = k
            for i, b in boxes.items():
                n += 1
                open_[n] = (t, b)
                tracks[i] = n
        rows["track_id"] = tracks
        sizes = rows.groupby("track_id")["track_id"].transform("size")
        return rows[sizes >= min_length]

    schema = df.withColumn("track_id", F.lit(0).cast("long")).schema
    return df.groupBy(key).applyInPandas(run, schema)


# Growth of the area from which a track counts as coming nearer, and of the dynamics: plausible steps in
# time (s), fastest closing (km/h), least closing (m/s), longest time to collision (s), times and distances of the risks.
NEARER = 1.15
STEPS_S, FASTEST_KMH, CLOSING_MPS, LONGEST_S = (0.05, 2), 150, 0.5, 60
HIGH_S, MEDIUM_S, HIGH_VRU_M, MEDIUM_VRU_M, MEDIUM_M = 1.5, 4, 5, 12, 10


def trajectories(df: DataFrame, key: str, t: str, width: float) -> DataFrame:
    """(key, n, x_drift, area_growth, mean_speed, net_displacement, duration, approaching) of each track.

    A box stands where the middle of its lower edge is, which is about where it meets the ground. Speeds are pixels a second
    (0 at the first box, and where time does not go on), drift is a share of the image's width, times are seconds.
    """
    w = Window.partitionBy(key).orderBy(t, "x1", "y1", "x2", "y2")
    df = df.withColumns({"_x": (F.col("x1") + F.col("x2")) / 2, "_y": F.col("y2").cast("double"), "_area": F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))})
    dt = F.col(t) - F.lag(t).over(w)
    away = F.sqrt(F.pow(F.col("_x") - F.lag("_x").over(w), 2) + F.pow(F.col("_y") - F.lag("_y").over(w), 2))
    df = df.withColumns({"_speed": F.coalesce(F.when(dt > 0, away / dt), F.lit(0.0)), "_n": F.row_number().over(w)})
    first, last = (lambda c: F.min_by(c, "_n")), (lambda c: F.max_by(c, "_n"))
    moved = F.sqrt(F.pow(last("_x") - first("_x"), 2) + F.pow(last("_y") - first("_y"), 2))
    out = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), ((last("_x") - first("_x")) / width).alias("x_drift"), (last("_area") / first("_area")).alias("area_growth"),
        F.avg("_speed").alias("mean_speed"), moved.alias("net_displacement"), (last(t) - first(t)).alias("duration"),
    )
    return out.withColumn("approaching", F.col("area_growth") > NEARER)


def dynamics(df: DataFrame, key: str, t: str, distance: str) -> DataFrame:
    """Closing speed, time to collision and risk from distances (m) over time (s); implausible steps give nulls."""
    w = Window.partitionBy(key).orderBy(t)
    dt = F.col(t) - F.lag(t).over(w)
    closing = F.when(dt.between(*STEPS_S), (F.lag(distance).over(w) - F.col(distance)) / dt)
    df = df.withColumn("closing", closing).withColumn("closing", F.when(F.abs("closing") <= FASTEST_KMH / 3.6, F.col("closing")))
    ttc = F.when(F.col("closing") >= CLOSING_MPS, F.col(distance) / F.col("closing"))
    df = df.withColumn("ttc", F.when(ttc <= LONGEST_S, ttc))
    near = F.col(distance)
    high = (F.col("ttc") < HIGH_S) | (F.col("vru") & (near < HIGH_VRU_M))
    medium = (F.col("ttc") < MEDIUM_S) | (near < F.when(F.col("vru"), MEDIUM_VRU_M).otherwise(MEDIUM_M))
    return df.withColumn("risk", F.when(high, "high").when(medium, "medium").otherwise("low"))


def line_crossings(df: DataFrame, key: str, t: str, x: str, y: str, line: tuple[float, float, float, float]) -> DataFrame:
    """Rows at which a track changed the side of a line through the line's own stretch."""
    w = Window.partitionBy(key).orderBy(t)
    ends = [F.lit(float(v)) for v in line]
    df = df.withColumn("side", G.side_of_line(F.col(x), F.col(y), *ends))
    df = df.withColumns({"_side": F.lag("side").over(w), "_x": F.lag(x).over(w), "_y": F.lag(y).over(w)})
    step = (F.col("_x"), F.col("_y"), F.col(x), F.col(y))
    between = G.side_of_line(ends[0], ends[1], *step) * G.side_of_line(ends[2], ends[3], *step) <= 0
    return df.where((F.col("side") * F.col("_side") < 0) & between).drop("_side", "_x", "_y")

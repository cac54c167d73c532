"""Geometry of clouds and rigs: ground planes, rigid alignment and its drift, consensus of calibrations.

Rows with a null or odd coordinate take no part. Groups may be of any size: what is per cloud or rig is aggregated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Distance of ground points (m), how upright a ground's normal must be, and limits of drift.
GROUND_M = 0.2
UPRIGHT = 0.8
FLAG, BLOCK = (0.5, 0.05), (2.0, 0.20)  # degrees, metres
LEAST_PAIRS = 8


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf"))
    return out


def ground_planes(points: DataFrame, cloud: str = "cloud", tries: int = 64, within: float = GROUND_M, seed: int = 0) -> DataFrame:
    """(cloud, a, b, c, d, n, n_ground, upright): the plane a x + b y + c z + d = 0 near most points, its normal of length 1 with c >= 0.

    Random sample consensus with a fixed seed: the points of a cloud with the least hashes make `tries` triples, each a
    plane, and one aggregation counts for all of them the points within reach. Of equal counts the first try wins.
    Hashes are of the coordinates, so neither partitions nor the order of points matter. `upright` is whether it may be
    ground; n_ground is 0 if not. Clouds of fewer than three different points, or all in a line, have no plane."""
    points = points.where(finite("x", "y", "z") & F.col(cloud).isNotNull()).select(cloud, *(F.col(c).cast("double") for c in "xyz"))
    by_hash = Window.partitionBy(cloud).orderBy(F.xxhash64("x", "y", "z", F.lit(seed)), "x", "y", "z")
    some = points.withColumn("r", F.dense_rank().over(by_hash)).where(F.col("r") <= 3 * tries).dropDuplicates([cloud, "r"])
    # each place is in three triples, so clouds of few points make as many planes as points
    r, n = F.col("r") - 1, F.max("r").over(Window.partitionBy(cloud))
    some = some.withColumn("n", n).where("n >= 3")
    ends = F.array(*(F.struct(F.pmod(r - k * s, F.col("n")).alias("t"), F.lit(k).alias("k")) for k, s in ((0, 0), (1, 1), (2, 2))))
    triples = some.select(cloud, F.explode(ends).alias("e"), F.struct("x", "y", "z").alias("p")).where(F.col("e.t") < tries)
    triples = triples.groupBy(cloud, F.col("e.t").alias("t")).agg(*(F.max(F.when(F.col("e.k") == k, F.col("p"))).alias(f"p{k}") for k in range(3)))
    u, v = ({c: F.col(f"p{k}.{c}") - F.col(f"p0.{c}") for c in "xyz"} for k in (1, 2))
    normal = {"a": u["y"] * v["z"] - u["z"] * v["y"], "b": u["z"] * v["x"] - u["x"] * v["z"], "c": u["x"] * v["y"] - u["y"] * v["x"]}
    planes = triples.withColumns(normal).withColumn("size", F.sqrt(sum(F.col(c) * F.col(c) for c in "abc"))).where("size > 1e-9")
    sign = F.when(F.col("c") < 0, -1.0).otherwise(1.0)
    planes = planes.withColumns({c: sign * F.col(c) / F.col("size") for c in "abc"})
    planes = planes.withColumn("d", -(F.col("a") * F.col("p0.x") + F.col("b") * F.col("p0.y") + F.col("c") * F.col("p0.z"))).select(cloud, "t", *"abcd")
    away = lambda p: F.abs(p["a"] * F.col("x") + p["b"] * F.col("y") + p["c"] * F.col("z") + p["d"])
    listed = planes.groupBy(cloud).agg(F.collect_list(F.struct("t", *"abcd")).alias("planes"))  # `tries` at most
    near = points.join(listed, cloud).select(cloud, F.explode("planes").alias("p"), "x", "y", "z")
    counts = near.groupBy(cloud, "p").agg(F.count(F.when(away(F.col("p")) <= within, 1)).alias("hits"), F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(cloud).agg(F.max_by(F.struct("p", "hits", "n"), F.struct("hits", -F.col("p.t"))).alias("b"))
    upright = F.col("c") >= UPRIGHT
    return best.select(cloud, *(F.col(f"b.p.{c}").alias(c) for c in "abcd"), "b.n", "b.hits").select(cloud, *"abcd", "n", F.when(upright, F.col("hits")).otherwise(0).alias("n_ground"), upright.alias("upright"))


def with_ground(points: DataFrame, planes: DataFrame, cloud: str = "cloud", within: float = GROUND_M) -> DataFrame:
    """Adds `ground` and `height` over the plane to each point; false and null without an upright plane."""
    found = points.join(planes.where("upright").select(cloud, *"abcd"), cloud, "left")
    height = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")
    return found.withColumn("height", height).withColumn("ground", F.coalesce(F.abs("height") <= within, F.lit(False))).drop(*"abcd")


def rigid_drift(pairs: DataFrame, rig: str = "rig", least: int = LEAST_PAIRS) -> DataFrame:
    """(rig, n, rotation, shift, rotation_deg, translation_m, residual, severity, confidence) of the rigid motion that best
    takes points (sx, sy, sz) to their partners (dx, dy, dz).

    Means and the moments about them are one aggregate, so points are read once and only partial sums are shuffled; a rig's
    row of 17 numbers is decomposed alone. With fewer than
    `least` pairs nothing is estimated: severity ok, confidence low. Points in a line, or all in one spot, leave a
    rotation open, which is then the one found first."""
    ends = [f"{e}{c}" for e in "sd" for c in "xyz"]
    pairs = pairs.where(finite(*ends) & F.col(rig).isNotNull()).select(rig, *(F.col(c).cast("double") for c in ends))
    n = F.count(F.lit(1))
    cross = [n * F.covar_pop(f"s{i}", f"d{j}") for i in "xyz" for j in "xyz"]
    spread = [n * sum(F.var_pop(f"{e}{c}") for c in "xyz") for e in "sd"]
    moments = pairs.groupBy(rig).agg(n.alias("n"), *(F.avg(c).alias(f"m_{c}") for c in ends), F.array(*cross).alias("h"), F.array(*spread).alias("e"))

    def solve(batches):
        for rows in batches:
            out = []
            for _, r in rows.iterrows():
                n = int(r["n"])
                if n < least:
                    out.append((r[rig], n, np.eye(3).ravel().tolist(), [0.0, 0.0, 0.0], 0.0, 0.0, None, "ok", "low"))
                    continue
                u, s, vt = np.linalg.svd(np.array(r["h"], float).reshape(3, 3))
                turn = np.array([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
                rotation = vt.T @ np.diag(turn) @ u.T
                shift = np.array([r[f"m_d{c}"] for c in "xyz"]) - rotation @ np.array([r[f"m_s{c}"] for c in "xyz"])
                sine = np.linalg.norm([rotation[2, 1] - rotation[1, 2], rotation[0, 2] - rotation[2, 0], rotation[1, 0] - rotation[0, 1]]) / 2
                angle, far = float(np.degrees(np.arctan2(sine, (np.trace(rotation) - 1) / 2))), float(np.linalg.norm(shift))
                residual = float(np.sqrt(max(0.0, sum(r["e"]) - 2 * (s * turn).sum()) / n))
                worst = "block" if angle >= BLOCK[0] or far >= BLOCK[1] else "drift_detected" if angle >= FLAG[0] or far >= FLAG[1] else "ok"
                out.append((r[rig], n, rotation.ravel().tolist(), shift.tolist(), angle, far, residual, worst, "ok"))
            yield pd.DataFrame(out, columns=[rig, "n", "rotation", "shift", "rotation_deg", "translation_m", "residual", "severity", "confidence"])

    kind = pairs.schema[rig].dataType.simpleString()
    return moments.mapInPandas(solve, f"{rig} {kind}, n long, rotation array<double>, shift array<double>, rotation_deg double, translation_m double, residual double, severity string, confidence string")


AXES = ("roll", "pitch", "yaw", "x", "y", "z")


def calibration_consensus(rows: DataFrame, rig: str = "rig", confidence: str = "confidence") -> DataFrame:
    """(rig, n, n_eff, the six axes, rpy_spread, xyz_spread, conf): means weighed by confidence over a rig's sessions.

    n_eff is how many equal weights they are worth; trust grows with it and falls with disagreement in the angles.
    Sessions of no confidence or with an unknown axis take no part."""
    rows = rows.where(finite(*AXES, confidence) & (F.col(confidence) > 0) & F.col(rig).isNotNull())
    w = F.col(confidence).cast("double")
    means = rows.groupBy(rig).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), *((F.sum(w * F.col(c)) / F.sum(w)).alias(f"m_{c}") for c in AXES))
    away = lambda part: F.sqrt(sum(F.sum(w * F.pow(F.col(c) - F.col(f"m_{c}"), 2)) for c in part) / F.sum(w))
    spread = rows.join(means, rig).groupBy(rig).agg(away(AXES[:3]).alias("rpy_spread"), away(AXES[3:]).alias("xyz_spread"))
    found = means.join(spread, rig).withColumn("n_eff", F.col("_w") * F.col("_w") / F.col("_w2"))
    conf = F.least(F.lit(1.0), F.col("n_eff") / (F.col("n_eff") + 3)) * F.exp(-F.col("rpy_spread") / 2)
    return found.select(rig, "n", "n_eff", *(F.col(f"m_{c}").alias(c) for c in AXES), "rpy_spread", "xyz_spread", conf.alias("conf"))


def axis_deviation(rows: DataFrame, rig: str = "rig") -> DataFrame:
    """Adds to each session and axis how far it is from its rig's median in robust standard deviations (1.4826 times the
    median distance from it; null where that is 0): z_roll to z_z. Medians are exact over a rig's sessions."""
    medians = rows.groupBy(rig).agg(*(F.median(c).alias(f"m_{c}") for c in AXES))
    both = rows.join(medians, rig)
    scales = both.groupBy(rig).agg(*(F.median(F.abs(F.col(c) - F.col(f"m_{c}"))).alias(f"s_{c}") for c in AXES))
    z = {f"z_{c}": F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / (1.4826 * F.col(f"s_{c}"))) for c in AXES}
    return both.join(scales, rig).withColumns(z).drop(*(f"{k}_{c}" for k in "ms" for c in AXES))

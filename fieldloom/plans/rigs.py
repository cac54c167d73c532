"""Queries on clouds, rigs and budgets. Lines of an order are points of their supplier's cloud; nations are rigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bandit, rigs
from ..tables import events, table


def cloud_points(spark: SparkSession, d: str) -> DataFrame:
    """Open lines lie near a sloping plane, thickened by their tax; the others anywhere above."""
    x, y = F.col("l_quantity") - 25, F.pmod(F.col("l_extendedprice"), F.lit(50.0)) - 25
    plane = 0.04 * x - 0.02 * y - 1.7 + F.col("l_tax")
    z = F.when(F.col("l_linestatus") == "O", plane).otherwise(plane + F.pmod(F.col("l_extendedprice") * 7, F.lit(9.0)))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cloud"), x.alias("x"), y.alias("y"), z.alias("z"))


def ground_planes(spark: SparkSession, d: str) -> DataFrame:
    found = rigs.ground_planes(cloud_points(spark, d))
    return found.select("cloud", *(F.round(c, 6).alias(c) for c in "abcd"), "n", "n_ground", "upright")


def rigid_drift(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's points against themselves, turned about the vertical by a tenth of its number in degrees, and shifted."""
    p = cloud_points(spark, d)
    turn, noise = F.radians(F.pmod(F.col("cloud"), F.lit(40)) / 10), (F.pmod(F.col("x") * 31 + F.col("y") * 17, F.lit(7.0)) - 3.5) / 1000
    dx, dy = F.col("x") * F.cos(turn) - F.col("y") * F.sin(turn) + noise, F.col("x") * F.sin(turn) + F.col("y") * F.cos(turn) - noise
    pairs = p.select(F.col("cloud").alias("rig"), *(F.col(c).alias(f"s{c}") for c in "xyz"), dx.alias("dx"), dy.alias("dy"), (F.col("z") + F.pmod(F.col("cloud"), F.lit(3)) / 50).alias("dz"))
    found = rigs.rigid_drift(pairs)
    return found.select("rig", "n", *(F.round(c, 5).alias(c) for c in ("rotation_deg", "translation_m", "residual")), "severity", "confidence")


def sessions_of_rigs(spark: SparkSession, d: str) -> DataFrame:
    """Customers are sessions of their nation's rig: their balance moves the angles, their number the place."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, d, "customer").select(
        F.col("c_nationkey").alias("rig"), "c_custkey", (b / 10_000).alias("roll"), (b / 5_000 - 1).alias("pitch"), (k % 100 / 50).alias("yaw"),
        (1 + k % 10 / 100).alias("x"), (k % 7 / 100).alias("y"), (1.5 + k % 3 / 100).alias("z"), (k % 11 / 10).alias("confidence"),
    )


def calibration_consensus(spark: SparkSession, d: str) -> DataFrame:
    found = rigs.calibration_consensus(sessions_of_rigs(spark, d))
    return found.select("rig", "n", *(F.round(c, 6).alias(c) for c in found.columns[2:]))


def axis_deviation(spark: SparkSession, d: str) -> DataFrame:
    found = rigs.axis_deviation(sessions_of_rigs(spark, d))
    return found.select("c_custkey", *(F.round(f"z_{c}", 5).alias(f"z_{c}") for c in rigs.AXES))


def rewards(spark: SparkSession, d: str) -> DataFrame:
    """A user's days of one kind of event are cycles: did the mean value rise from the user's first half to the second?"""
    e = events(spark, d)
    half = F.col("t") < 1_705_320_000_000_000
    return e.groupBy(F.col("kind").alias("slice"), "session_id").agg(F.avg(F.when(half, F.col("value"))).alias("before"), F.avg(F.when(~half, F.col("value"))).alias("after"))


def bandit_state(spark: SparkSession, d: str) -> DataFrame:
    return bandit.folded(spark.createDataFrame([("view", 2.0, 1.0, 1)], bandit.STATE), rewards(spark, d))


def bandit_selection(spark: SparkSession, d: str) -> DataFrame:
    shares = bandit.allocated(bandit_state(spark, d), 200, seed=11)
    candidates = events(spark, d).select(F.col("event_id").alias("id"), F.col("kind").alias("slice"), F.col("value").alias("score"))
    return bandit.selected(candidates, shares, 200)


QUERIES = {
    "ground_planes": ground_planes,
    "rigid_drift": rigid_drift,
    "calibration_consensus": calibration_consensus,
    "axis_deviation": axis_deviation,
    "bandit_state": bandit_state,
    "bandit_selection": bandit_selection,
}
SESSIONS_SQL = """SELECT c_nationkey AS rig, c_custkey, c_acctbal / 10000 AS roll, c_acctbal / 5000 - 1 AS pitch, c_custkey % 100 / 50 AS yaw, 1 + c_custkey % 10 / 100 AS x,
    c_custkey % 7 / 100 AS y, 1.5::DOUBLE + c_custkey % 3 / 100 AS z, c_custkey % 11 / 10 AS w FROM customer"""
ORACLES = {
    "calibration_consensus": f"""
        WITH s AS (SELECT * FROM ({SESSIONS_SQL}) WHERE w > 0),
        m AS (SELECT rig, count(*) AS n, sum(w) AS sw, sum(w * w) AS sw2, {", ".join(f"sum(w * {c}) / sum(w) AS m_{c}" for c in rigs.AXES)} FROM s GROUP BY rig),
        v AS (SELECT s.rig, sqrt(sum(w * ((roll - m_roll) ** 2 + (pitch - m_pitch) ** 2 + (yaw - m_yaw) ** 2)) / sum(w)) AS a,
                     sqrt(sum(w * ((x - m_x) ** 2 + (y - m_y) ** 2 + (z - m_z) ** 2)) / sum(w)) AS b FROM s JOIN m USING (rig) GROUP BY s.rig)
        SELECT rig, n, round(sw * sw / sw2, 6) AS n_eff, {", ".join(f"round(m_{c}, 6) AS {c}" for c in rigs.AXES)}, round(a, 6) AS rpy_spread, round(b, 6) AS xyz_spread,
               round(least(1, sw * sw / sw2 / (sw * sw / sw2 + 3)) * exp(-a / 2), 6) AS conf FROM m JOIN v USING (rig)
    """,
    "axis_deviation": f"""
        WITH s AS ({SESSIONS_SQL}), m AS (SELECT rig, {", ".join(f"median({c}) AS m_{c}" for c in rigs.AXES)} FROM s GROUP BY rig),
        d AS (SELECT rig, {", ".join(f"median(abs({c} - m_{c})) AS s_{c}" for c in rigs.AXES)} FROM s JOIN m USING (rig) GROUP BY rig)
        SELECT c_custkey, {", ".join(f"CASE WHEN s_{c} > 0 THEN round(({c} - m_{c}) / (1.4826 * s_{c}), 5) END AS z_{c}" for c in rigs.AXES)} FROM s JOIN m USING (rig) JOIN d USING (rig)
    """,
    "bandit_state": """
        WITH e AS (SELECT event_type AS slice, user_id, avg(value) FILTER (epoch_us(ts) < 1705320000000000) AS b, avg(value) FILTER (epoch_us(ts) >= 1705320000000000) AS a FROM events GROUP BY 1, 2),
        r AS (SELECT slice, count(*) FILTER (a > b) AS up, count(*) AS n FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
        SELECT slice, CASE WHEN slice = 'view' THEN 2 ELSE 1 END::DOUBLE + up AS alpha, 1.0::DOUBLE + n - up AS beta, CASE WHEN slice = 'view' THEN 1 ELSE 0 END + n AS pulls FROM r
    """,
}

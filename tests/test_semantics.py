"""Statistics and policies against literal versions: intervals, resampling, drift, trajectories, health, the selector."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import stats as S
from fieldloom.operators import labels as L
from fieldloom.operators import tracking as TR
from fieldloom.streaming import selector


def rate(p, lo, hi):
    return F.struct(F.lit(p).alias("p"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))


def test_corrected_rates_carry_the_judges_uncertainty_alone(spark):
    def corrected(p, se, sp):
        r = spark.range(1).select(S.rogan_gladen_interval(F.lit(p), rate(*se), rate(*sp)).alias("x")).first()["x"]
        return tuple(None if v is None else round(v, 6) if not isinstance(v, bool) else v for v in r)

    at = lambda p, se, sp: round((p + sp - 1) / (se + sp - 1), 6)
    assert corrected(0.5, (0.76, 0.65, 0.84), (0.80, 0.65, 0.90)) == (at(0.5, 0.76, 0.80), at(0.5, 0.76, 0.80), at(0.5, 0.84, 0.90), False) or corrected(0.5, (0.76, 0.65, 0.84), (0.80, 0.65, 0.90))[1:3] == (min(at(0.5, 0.65, 0.65), at(0.5, 0.76, 0.8), at(0.5, 0.84, 0.9)), max(at(0.5, 0.65, 0.65), at(0.5, 0.76, 0.8), at(0.5, 0.84, 0.9)))
    assert corrected(0.95, (0.76, 0.65, 0.84), (0.80, 0.65, 0.90))[3] is True
    assert corrected(0.5, (0.5, 0.4, 0.5), (0.5, 0.4, 0.5)) == (None, None, None, False)


def test_resampling_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), float(v + rng.normal(0.3, 1.0))) for k, v in enumerate(rng.normal(size=400))] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    found = [L.bootstrap(x.where("a IS NOT NULL AND NOT isnan(a)"), "a", "id", rounds=500).first() for x in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("id")))]
    assert all(tuple(f) == pytest.approx(tuple(found[0]), rel=1e-12) for f in found)
    se = np.std([r[1] for r in rows[:400]]) / 20
    assert found[0]["hi"] - found[0]["lo"] == pytest.approx(2 * 1.96 * se, rel=0.15) and found[0]["lo"] < found[0]["mean"] < found[0]["hi"]
    assert tuple(L.bootstrap(df.limit(0), "a", "id").first()) == (None, None, None)
    tests = [L.paired_test(x, "a", "b", "id", rounds=999).first() for x in (df.coalesce(1), df.repartition(7))]
    assert tests[0]["n"] == 400 and tests[0]["p_value"] == tests[1]["p_value"] and tests[0]["significant"] and tests[0]["direction"] == "better"
    worse = L.paired_test(df, "b", "a", "id", rounds=999).first()
    assert worse["direction"] == "worse" and worse["p_value"] < 0.05 and not worse["significant"]
    same = L.paired_test(df, "a", "a", "id", rounds=99).first()
    assert (same["delta"], same["p_value"], same["direction"], same["significant"]) == (0.0, 1.0, "same", False)
    none = L.paired_test(df.limit(0), "a", "b", "id").first()
    assert none["n"] == 0 and none["p_value"] is None and none["significant"] is False


def test_draws_are_uniform():
    u = L.drawn(np.arange(2000), 50, 3)
    assert u.shape == (50, 2000) and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    assert abs(np.corrcoef(u[0], u[1])[0, 1]) < 0.1


def test_drift_is_seen_in_any_direction(spark):
    """A shift of one late component, which fixed first axes would not see; none without a shift."""
    rng = np.random.default_rng(2)
    base, other, broad = rng.normal(size=(600, 48)), rng.normal(size=(600, 48)), rng.normal(size=(600, 48)) + 0.4
    moved = other.copy()
    moved[:, 40] += 6

    def worst(now):
        rows = [(0, v.tolist()) for v in base] + [(1, v.tolist()) for v in now] + [(1, None), (0, [float("nan")] * 48)]
        df = spark.createDataFrame(rows, "side int, embedding array<double>")
        found = L.projection_drift(df, F.col("side") == 1).collect()
        assert len(found) == 32
        return max(r["psi"] for r in found)

    assert worst(moved) > 0.25 and worst(broad) > 0.25 and worst(other) < 0.15


def test_trajectories_stand_on_the_ground_and_count_seconds(spark):
    rows = [("a", 0.0, 0.0, 0.0, 10.0, 20.0), ("a", 0.5, 3.0, 0.0, 13.0, 24.0), ("a", 0.5, 4.0, 0.0, 14.0, 24.0), ("a", 2.5, 4.0, 0.0, 24.0, 24.0), ("b", 1.0, 5.0, 5.0, 5.0, 5.0)]
    found = {r["k"]: r for r in TR.trajectories(spark.createDataFrame(rows, "k string, t double, x1 double, y1 double, x2 double, y2 double"), "k", "t", 100.0).collect()}
    a = found["a"]
    assert (a["n"], a["x_drift"], a["duration"], a["approaching"]) == (4, pytest.approx(0.09), 2.5, True)
    assert a["mean_speed"] == pytest.approx((0 + 10.0 + 0 + 2.5) / 4) and a["net_displacement"] == pytest.approx((9**2 + 4**2) ** 0.5)
    assert (found["b"]["mean_speed"], found["b"]["area_growth"], found["b"]["approaching"]) == (0.0, 1.0, False)


def test_health_decides_by_score_and_by_failed_checks(spark):
    rows = [("pass", 1.0, 0.9), ("pass", 3.0, 0.84), ("worn", 1.0, 0.8), ("low", 1.0, 0.54), ("failed", 9.0, 1.0), ("failed", 1.0, 0.0), ("none", 0.0, 1.0)]
    found = {r["k"]: (r["score"], r["decision"], r["n_failed"]) for r in L.health(spark.createDataFrame(rows, "k string, weight double, level double"), "k").collect()}
    assert found == {"pass": (85.5, "pass", 0), "worn": (80.0, "degraded", 0), "low": (54.0, "quarantine", 0), "failed": (90.0, "quarantine", 1), "none": (0.0, "quarantine", 0)}


def test_health_adds_levels_in_their_order(spark):
    """The exact score is 97.95: the order of the sum of doubles tells whether it is 97.9 or 98."""
    levels = list(enumerate([0.986069, 0.935771, 0.984961, 0.993269, 0.99743]))
    for n in (1, 3):
        for sign, score in ((1, 97.9), (-1, 98.0)):
            rows = [("k", sign * i, 1.0, x) for i, x in levels]
            for given in (rows, rows[::-1]):
                found = L.health(spark.createDataFrame(given, "k string, first long, weight double, level double").repartition(n), "k", "first").first()
                assert found["score"] == score


@pytest.mark.parametrize("target", [0.05, 0.10, 0.25])
def test_the_selector_keeps_about_its_target(target):
    """A drive of small and large changes keeps its share; a static camera keeps next to nothing."""
    rng = np.random.default_rng(3)
    policy = selector.Policy(target=target, min_gap=1)
    state, kept, base = selector.State(), 0, rng.normal(size=32) * 3
    for _ in range(1500):
        v = base + rng.normal(size=32) * rng.gamma(1.0, 0.5)  # the road stays as it is, changes differ
        kept += selector.decide(state, v, False, 0, policy) is not None
    assert abs(kept / 1500 - target) < 0.03
    state, still = selector.State(), np.ones(32)
    assert sum(selector.decide(state, still, False, 0, policy) is not None for _ in range(1500)) < 30


def test_the_step_itself_is_in_the_window():
    """The largest step of all is at its own percentile, whatever the window held before."""
    policy = selector.Policy(warm_up=2, min_gap=1)
    state = selector.State()
    for k, angle in enumerate((0.0, 0.1, 0.2, 0.3, 1.3)):
        why = selector.decide(state, np.array([np.cos(angle), np.sin(angle)]), False, 0, policy)
        assert len(state.steps) == k
    assert why == "novel" and state.steps == [round(x, 6) for x in state.steps]


def test_consensus_of_equal_boxes(spark):
    """Copies count as each box does, and don't make pairs of their own: 3 paths of 4000 copies each would be 32 million."""
    box = "frame long, id long, path long, cls string, x1 double, y1 double, x2 double, y2 double, conf double"
    boxes = spark.range(12_000).selectExpr("1L AS frame", "id", "id % 3 AS path", "'a' AS cls", "0D AS x1", "0D AS y1", "10D AS x2", "10D AS y2", "0.25D AS conf")
    more = spark.createDataFrame([(2, 1, 0, "a", 0.0, 0.0, 10.0, 10.0, 0.5), (2, 2, 1, "a", 0.0, 0.0, 10.0, 9.0, 0.5), (2, 3, 2, "b", 0.0, 0.0, 10.0, 10.0, 1.0), (2, 4, 1, None, 0.0, 0.0, 10.0, 10.0, 1.0)], box)
    found = L.consensus(boxes.unionByName(more), "frame", "path")
    groups = {tuple(r) for r in found.where("frame = 1").selectExpr("n_agree", "score", "accepted").distinct().collect()}
    assert groups == {(3, (0.25 + 8000 * 0.25) / 3000, True)} and found.where("frame = 1").count() == 12_000
    assert sorted(tuple(r) for r in found.where("frame = 2").collect()) == [(2, 1, 2, 1 / 3, False), (2, 2, 2, 1 / 3, False), (2, 3, 1, 1 / 3, False)]

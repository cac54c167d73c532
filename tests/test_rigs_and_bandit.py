"""Clouds, planes, rigid motions, consensus and budgets: planted values come back, at any partitioning."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bandit, rigs
from fieldloom.sources import clouds


def test_clouds_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 4)).astype("<f4"), rng.uniform(0, 255, size=(30, 5)).astype("<f4")
    (tmp_path / "k").mkdir()
    (tmp_path / "n").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "k/one.bin").write_bytes(a.tobytes() + b"\x01\x02")
    (tmp_path / "k/none.bin").write_bytes(b"")
    (tmp_path / "n/two.pcd.bin").write_bytes(b.tobytes())
    head = "# .PCD v.7\nVERSION .7\nFIELDS x y z ring\nSIZE 4 4 4 2\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA "
    (tmp_path / "p/asc.pcd").write_text(head + "ascii\n1 2 3 4\n5 6 7 8\n")
    rows = np.array([(1, 2, 3, 9), (4, 5, 6, 7)], [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("ring", "<u2")])
    (tmp_path / "p/bin.pcd").write_bytes((head + "binary\n").encode() + rows.tobytes())
    k = clouds.read_clouds(spark, str(tmp_path / "k"), "kitti").orderBy("place").collect()
    assert len(k) == 50 and {r["cloud"] for r in k} == {"one"} and [r["z"] for r in k] == a[:, 2].astype(float).tolist()
    n = clouds.read_clouds(spark, str(tmp_path / "n"), "nuscenes").orderBy("place").collect()
    assert [r["ring"] for r in n] == b[:, 4].astype(int).tolist() and n[3]["intensity"] == pytest.approx(float(b[3, 3]) / 255)
    p = sorted(tuple(r) for r in clouds.read_clouds(spark, str(tmp_path / "p"), "pcd").select("cloud", "x", "z", "ring").collect())
    assert p == [("asc", 1.0, 3.0, 4), ("asc", 5.0, 7.0, 8), ("bin", 1.0, 3.0, 9), ("bin", 4.0, 6.0, 7)]
    with pytest.raises(ValueError, match="layout"):
        clouds.read_clouds(spark, str(tmp_path), "las")


def planted(seed):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-20, 20, size=(400, 2))
    ground = np.column_stack([xy, 0.05 * xy[:, 0] - 0.02 * xy[:, 1] - 1.7 + rng.normal(size=400) * 0.03])
    wall = np.column_stack([np.full(150, 5.0), rng.uniform(-20, 20, 150), rng.uniform(0, 6, 150)])
    return [("a", *map(float, p)) for p in (*ground, *wall, *rng.uniform(-20, 20, size=(50, 3)))] + [("w", *map(float, p)) for p in wall]


def test_planted_planes_are_found_at_any_partitioning(spark):
    rows = planted(1) + [("few", 0.0, 0.0, 0.0), ("few", 1.0, 0.0, 0.0), ("line", 0.0, 0.0, 0.0), ("line", 1.0, 0.0, 0.0), ("line", 2.0, 0.0, 0.0), ("a", None, 0.0, 0.0), (None, 0.0, 0.0, 0.0), ("a", float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cloud string, x double, y double, z double")
    found = [sorted(map(tuple, rigs.ground_planes(x).collect())) for x in (df.coalesce(1), df.repartition(7), df.orderBy(F.rand(3)))]
    assert found[0] == found[1] == found[2]
    plane = {r[0]: r for r in found[0]}
    assert set(plane) == {"a", "w"}
    _, a, b, c, d, n, ground, upright = plane["a"]
    assert upright and (-a / c, -b / c, -d / c) == pytest.approx((0.05, -0.02, -1.7), abs=0.06) and 395 <= ground <= 415 and n == 600
    assert not plane["w"][7] and plane["w"][6] == 0
    marked = rigs.with_ground(df, rigs.ground_planes(df))
    assert marked.where("ground").count() == ground and marked.count() == df.where("cloud is not null").count() + 1


def turned(rng, angle, shift, n, noise=0.0):
    axis = rng.normal(size=3)
    axis /= np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    r = np.eye(3) + np.sin(np.radians(angle)) * k + (1 - np.cos(np.radians(angle))) * k @ k
    s = rng.normal(size=(n, 3)) * 5 + 1000
    return r, s, s @ r.T + np.array(shift) + rng.normal(size=(n, 3)) * noise


def test_planted_rotations_come_back(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    for name, angle, n in (("big", 30.0, 60), ("tiny", 0.01, 40), ("half", 179.9, 40), ("few", 10.0, 5)):
        r, s, d = turned(rng, angle, (0.5, -1.0, 2.0), n)
        want[name] = r
        rows += [(name, *map(float, (*p, *q))) for p, q in zip(s, d, strict=True)]
    s = rng.normal(size=(20, 3))
    rows += [("same", *map(float, (*p, *p))) for p in s] + [("same", None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    mirrored = s * [1, 1, -1]
    rows += [("mirror", *map(float, (*p, *q))) for p, q in zip(s, mirrored, strict=True)]
    df = spark.createDataFrame(rows, "rig string, sx double, sy double, sz double, dx double, dy double, dz double").repartition(5)
    found = {r["rig"]: r for r in rigs.rigid_drift(df).collect()}
    for name, angle in (("big", 30.0), ("tiny", 0.01), ("half", 179.9)):
        assert np.array(found[name]["rotation"]).reshape(3, 3) == pytest.approx(want[name], abs=1e-6)
        assert found[name]["rotation_deg"] == pytest.approx(angle, abs=1e-4) and found[name]["residual"] == pytest.approx(0, abs=1e-5)
        assert found[name]["severity"] == "block"
    assert (found["few"]["severity"], found["few"]["confidence"], found["few"]["n"]) == ("ok", "low", 5)
    assert found["same"]["severity"] == "ok" and found["same"]["rotation_deg"] == pytest.approx(0, abs=1e-5) and found["same"]["n"] == 20
    assert np.linalg.det(np.array(found["mirror"]["rotation"]).reshape(3, 3)) == pytest.approx(1.0) and found["mirror"]["residual"] > 0.1


def test_points_are_read_once_and_only_sums_are_shuffled(spark, capsys):
    df = spark.range(100).selectExpr("id % 3 AS rig", *(f"double(id * {k}) AS {c}" for k, c in enumerate(("sx", "sy", "sz", "dx", "dy", "dz"), 1)))
    rigs.rigid_drift(df).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.count("Range") == 1


def test_consensus_weighs_sessions(spark):
    rows = [("r", 1.0, 2.0, 3.0, 0.1, 0.2, 0.3, 0.5), ("r", 3.0, 2.0, 3.0, 0.1, 0.2, 0.3, 1.5), ("r", 99.0, 2.0, 3.0, 0.1, 0.2, 0.3, 0.0), ("r", None, 2.0, 3.0, 0.1, 0.2, 0.3, 1.0), ("s", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0)]
    found = {r["rig"]: r for r in rigs.calibration_consensus(spark.createDataFrame(rows, "rig string, roll double, pitch double, yaw double, x double, y double, z double, confidence double")).collect()}
    r = found["r"]
    spread = (0.25 * 1.5**2 + 0.75 * 0.5**2) ** 0.5
    assert (r["n"], r["roll"], r["n_eff"], r["rpy_spread"]) == (2, pytest.approx(2.5), pytest.approx(1.6), pytest.approx(spread))
    assert r["conf"] == pytest.approx(1.6 / 4.6 * np.exp(-spread / 2)) and found["s"]["conf"] == pytest.approx(0.25)
    z = rigs.axis_deviation(spark.createDataFrame([("r", float(v), 0.0, 0.0, 0.0, 0.0, 0.0) for v in (1, 2, 3, 4, 50)], "rig string, roll double, pitch double, yaw double, x double, y double, z double")).orderBy("roll").collect()
    assert z[4]["z_roll"] == pytest.approx(47 / 1.4826) and z[0]["z_pitch"] is None


def state(spark, *rows):
    return spark.createDataFrame(list(rows), bandit.STATE)


def test_rewards_fold_into_the_state(spark):
    rewards = spark.createDataFrame([("a", 0.1, 0.2), ("a", 0.2, 0.2), ("a", None, 0.9), ("new", 0.1, 0.3), (None, 0.1, 0.3)], "slice string, before double, after double")
    now = bandit.folded(state(spark, ("a", 3.0, 1.0, 2), ("b", 1.0, 1.0, 0)), rewards)
    assert sorted(map(tuple, now.collect())) == [("a", 4.0, 2.0, 4), ("b", 1.0, 1.0, 0), ("new", 2.0, 1.0, 1)]
    halves = rewards.where("after > 0.25"), rewards.where("NOT after > 0.25")
    twice = bandit.folded(bandit.folded(state(spark, ("a", 3.0, 1.0, 2), ("b", 1.0, 1.0, 0)), halves[0]), halves[1])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, now.collect()))


def test_budgets_are_repeatable_and_learn(spark):
    s = state(spark, ("good", 80.0, 5.0, 83), ("bad", 5.0, 80.0, 83), ("new", 1.0, 1.0, 0))
    first, again = (sorted(map(tuple, bandit.allocated(x, 100, 7).collect())) for x in (s, s.repartition(3)))
    assert first == again and sum(r[5] for r in first) == 100
    other = sorted(map(tuple, bandit.allocated(s, 100, 8).collect()))
    assert other != first
    share = {r[0]: r[5] for r in first}
    assert share["good"] > 5 * share["bad"]
    assert bandit.allocated(s.limit(0), 100, 7).count() == 0


def test_candidates_are_taken_once_and_the_rest_redistributed(spark):
    rows = [(k, "a", float(k)) for k in range(10)] + [(k, "b", 100.0 - k) for k in range(8, 12)] + [(50, "c", None), (51, None, 1.0), (9, "a", 0.5)]
    shares = spark.createDataFrame([("a", 3), ("b", 2), ("c", 5)], "slice string, share long")
    got = bandit.selected(spark.createDataFrame(rows, "id long, slice string, score double"), shares, 10).collect()
    by = {r["id"]: (r["slice"], r["redistributed"]) for r in got}
    assert len(got) == len(by) == 10
    assert {i for i, v in by.items() if v == ("a", False)} == {9, 8, 7} and {i for i, v in by.items() if v == ("b", False)} == {10, 11}
    assert {i for i, v in by.items() if v[1]} == {6, 5, 4, 3, 2}

"""Smoothed tracks against a filter in matrices, and planted label errors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import confident
from fieldloom.operators import smoothing as S


def line(n=20, step=6.0, off=None, half=20.0):
    x = 100.0 + step * np.arange(n) + np.array([(off or {}).get(k, 0.0) for k in range(n)])
    return np.stack([x - half, np.full(n, 180.0), x + half, np.full(n, 220.0)], axis=1)


def by_matrices(boxes, seconds):
    """The textbook filter and smoother with eight states in one matrix."""
    z, n = S.centre_size(boxes), len(boxes)
    dt = np.maximum(np.diff(seconds), S.LEAST_STEP_S)
    q = S.accelerations(z, dt) ** 2
    h = np.hstack([np.eye(4), np.zeros((4, 4))])
    r = np.diag(np.repeat(np.array(S.MEASURED) ** 2, 2))
    x, p = np.concatenate([z[0], (z[1] - z[0]) / dt[0]]), np.eye(8) * 1e3
    steps, fx, fp, ax, ap, gated = [], [], [], [], [], []
    for k in range(n):
        t = dt[k - 1] if k else 0.0
        f = np.eye(8) + t * np.eye(8, k=4)
        if k:
            g = np.vstack([np.eye(4) * t * t / 2, np.eye(4) * t])
            x, p = f @ x, f @ p @ f.T + g @ np.diag(np.repeat(q, 2)) @ g.T
        steps.append(f)
        ax.append(x)
        ap.append(p)
        y = z[k] - h @ x
        gated.append(bool(k and y @ np.linalg.inv(h @ p @ h.T + r) @ y > S.GATE))
        gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r * (S.INFLATE if gated[-1] else 1))
        x, p = x + gain @ y, p - gain @ h @ p
        fx.append(x)
        fp.append(p)
    out = [(x, p)]
    for k in range(n - 2, -1, -1):
        c = fp[k] @ steps[k + 1].T @ np.linalg.inv(ap[k + 1])
        out.append((fx[k] + c @ (out[-1][0] - ax[k + 1]), fp[k] + c @ (out[-1][1] - ap[k + 1]) @ c.T))
    out = out[::-1]
    return np.array([x[:4] for x, _ in out]), np.sqrt(np.array([(p[0, 0] + p[1, 1]) / 2 for _, p in out])), gated


def test_channels_equal_matrices():
    rng = np.random.default_rng(0)
    boxes = line(30, off={7: 55.0, 20: -40.0}) + rng.normal(size=(30, 4)) * 2
    seconds = np.cumsum(rng.choice([0.033, 0.1, 0.333], 30))
    got, want = S.smoothed(boxes, seconds), by_matrices(boxes, seconds)
    assert got[0] == pytest.approx(want[0], abs=1e-6)
    assert got[1] == pytest.approx(want[1], abs=1e-6)
    assert got[2].tolist() == want[2]


FRAME = "track string, t double, x1 double, y1 double, x2 double, y2 double, std int"


def test_a_bad_detection_is_pulled_back_and_marked(spark):
    rows = [("a", 0.1 * k, *b) for k, b in enumerate(line(off={10: 40.0}).tolist())] + [("b", 0.1 * k, *b) for k, b in enumerate(line().tolist())]
    df = spark.createDataFrame(rows, "track string, t double, x1 double, y1 double, x2 double, y2 double").repartition(3)
    found = S.smooth_tracks(df).toPandas().sort_values("t")
    a, b = found[found.track == "a"], found[found.track == "b"]
    bad = a.iloc[10]
    assert abs((bad.sx1 + bad.sx2) / 2 - 160.0) < 2.0 and bad.gated and bad.smoothed
    assert np.abs(b.sx1 - b.x1).mean() < 3.0 and not b.gated.any() and (found["std"] >= 0).all()


def test_several_objects_under_one_id_are_refused(spark):
    flip = [("flip", 0.1 * k, *(x + (600.0 if k % 2 else 0.0) for x in b)) for k, b in enumerate(line().tolist())]
    fast = [("fast", 0.1 * k, *b) for k, b in enumerate(line(step=90.0).tolist())]
    odd = [("two", 0.0, 1.0, 1.0, 2.0, 2.0), ("two", 0.1, 1.0, 1.0, 2.0, 2.0), (None, 0.0, 1.0, 1.0, 2.0, 2.0), ("fast", None, 1.0, 1.0, 2.0, 2.0), ("fast", 0.5, None, 1.0, 2.0, 2.0)]
    same = [("same", 1.0, 5.0, 5.0, 9.0, 9.0)] * 4
    df = spark.createDataFrame(flip + fast + odd + same, "track string, t double, x1 double, y1 double, x2 double, y2 double")
    found = S.smooth_tracks(df).toPandas()
    assert len(found) == df.count()
    assert not found[found.track == "flip"].smoothed.any() and (found[found.track == "flip"].sx1 == found[found.track == "flip"].x1).all()
    assert found[found.track == "fast"].smoothed.sum() == 20 and not found[found.track == "two"].smoothed.any()
    assert found[found.track == "same"].sx1.tolist() == pytest.approx([5.0] * 4)
    assert S.smooth_tracks(df.limit(0)).count() == 0


def test_tracks_side_by_side_equal_each_alone(spark, monkeypatch):
    """Tracks of many lengths, more than a block holds, in few passes: steps grow with the longest tracks, not with all."""
    rng, rows, want, calls = np.random.default_rng(3), [], {}, []
    for k, n in enumerate([3, 3, 4, 5, 8, 9, 17, 20, 40, 90, 1, 2] * 3):
        boxes, seconds = line(n, off={n // 2: 50.0}) + rng.normal(size=(n, 4)) * 2, np.cumsum(rng.choice([0.033, 0.1, 0.333], n))
        rows += [(k, float(t), *map(float, b)) for t, b in zip(seconds, boxes, strict=True)]
        want[k] = S.smoothed(boxes, seconds) if n >= 3 and not S.incoherent(boxes) else None
    together = S.smoothed_together
    monkeypatch.setattr(S, "smoothed_together", lambda z, *more: calls.append(z.shape[1]) or together(z, *more))
    boxes = np.array([r[2:] for r in rows])
    sizes = np.array([sum(r[0] == k for r in rows) for k in want])
    some = np.flatnonzero(sizes >= 3)
    S.smoothed_block(boxes, np.array([r[1] for r in rows]), (np.cumsum(sizes) - sizes)[some], sizes[some])
    assert sum(calls) == len(some) and len(calls) <= 6
    monkeypatch.undo()
    monkeypatch.setattr(S, "BLOCK", 50)
    found = S.smooth_tracks(spark.createDataFrame(rows, "track long, t double, x1 double, y1 double, x2 double, y2 double").repartition(3)).toPandas().sort_values(["track", "t"])
    assert len(found) == len(rows)
    for k, (track, own) in zip(want, found.groupby("track"), strict=True):
        assert track == k and own.smoothed.all() == (want[k] is not None)
        if want[k] is not None:
            z, std, gated = want[k]
            assert ((own.sx1 + own.sx2) / 2).to_numpy() == pytest.approx(z[:, 0], abs=1e-12)
            assert own["std"].to_numpy() == pytest.approx(std, abs=1e-12) and own.gated.tolist() == gated.tolist()


def test_equal_boxes_at_one_time_follow_the_other_columns(spark):
    rows = [(k, "a", 0.1 * (k // 2), *b) for k, b in enumerate(np.repeat(line(10), 2, axis=0).tolist())]
    schema = "id long, track string, t double, x1 double, y1 double, x2 double, y2 double"
    one, other = ({r["id"]: tuple(r) for r in S.smooth_tracks(spark.createDataFrame(x, schema).coalesce(1)).collect()} for x in (rows, rows[::-1]))
    assert one == other


def planted(seed, n=300, wrong=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 8)) * 1.2
    truth = rng.integers(4, size=n)
    given = np.where(rng.random(n) < wrong, (truth + rng.integers(1, 4, size=n)) % 4, truth)
    return [(int(k), int(given[k]), (centres[truth[k]] + rng.normal(size=8) * 0.6).tolist()) for k in range(n)], {int(k): int(truth[k]) for k in range(n) if truth[k] != given[k]}


def test_planted_label_errors_are_found(spark):
    rows, wrong = planted(1)
    rows += [(9000, 99, [0.0] * 8), (9001, None, [0.0] * 8), (None, 1, [0.0] * 8), (9002, 1, None), (9003, 1, [float("nan")] * 8)]
    found = {r["id"]: r for r in confident.label_errors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("p", F.lit(1))).collect()}
    hit = set(found) & set(wrong)
    print("recall", len(hit) / len(wrong), "precision", len(hit) / len(found))
    assert len(hit) / len(wrong) >= 0.7 and len(hit) / len(found) >= 0.9
    assert sum(found[i]["proposed"] == wrong[i] for i in hit) >= 0.9 * len(hit)
    assert all(0 <= r["score"] <= 1 and r["proposed"] != r["given"] for r in found.values())


def test_thresholds_decide_what_a_row_counts_as(spark):
    """Class 0's mean self-confidence is 0.7, class 1's 0.6: only what reaches its own counts."""
    rows = [(1, 0.0, [0.9, 0.1]), (2, 0.0, [0.5, 0.5]), (3, 1.0, [0.4, 0.6]), (4, 1.0, [0.4, 0.6]), (5, 1.0, [0.75, 0.25]), (6, 1.0, [0.05, 0.95])]
    found = {r["id"]: r["at"] for r in confident.confident_joint(spark.createDataFrame(rows, "id long, y double, p array<double>"), 2).collect()}
    assert found == {1: 0, 2: None, 3: 1, 4: 1, 5: 0, 6: 1}


def test_too_few_classes(spark):
    df = spark.createDataFrame([(k, 1, [1.0, 2.0]) for k in range(8)], "vec_id long, label int, embedding array<double>")
    assert confident.label_errors(df).count() == confident.label_errors(df.limit(0)).count() == 0

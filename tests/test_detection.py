"""Boxes and tracks against ground truth: worked values, and a literal greedy loop."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import detection as D

BOX = "id long, key long, cls string, score double, track string, x1 double, y1 double, x2 double, y2 double"


def frame(spark, rows):
    return spark.createDataFrame(rows, BOX)


def literal_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def literal_match(pred, truth, least):
    taken, out = set(), set()
    for p in sorted(pred, key=lambda r: (-r[3], r[0])):
        near = [(-literal_iou(p[5:], g[5:]), g[0]) for g in truth if g[1] == p[1] and g[2] == p[2] and g[0] not in taken]
        near = sorted(x for x in near if -x[0] >= least)
        if near:
            taken.add(near[0][1])
            out.add((p[0], near[0][1]))
    return out


def crowd(seed, wide=400.0):
    rng = random.Random(seed)
    truth, pred = [], []
    for i in range(120):
        x, y = rng.uniform(-wide, wide), rng.uniform(-wide, wide)
        w, h = rng.choice([8, 60, 200, 700]) * rng.uniform(0.8, 1.2), rng.choice([8, 60, 300]) * rng.uniform(0.8, 1.2)
        truth.append((i, i % 3, "ab"[i % 2], 0.0, "t", x, y, x + w, y + h))
        for k in range(rng.choice([0, 1, 3])):
            j = lambda s: rng.gauss(0, 0.08) * s  # noqa: B023, E731
            pred.append((1000 + 10 * i + k, i % 3, rng.choice("ab"), rng.choice([0.2, 0.5, rng.random()]), "p", x + j(w), y + j(h), x + w + j(w), y + h + j(h)))
    return pred, truth


@pytest.mark.parametrize("seed", [0, 1])
def test_matching_equals_a_literal_greedy_pass(spark, seed):
    pred, truth = crowd(seed)
    for least in (0.25, 0.5):
        pairs = D.overlaps(frame(spark, pred), frame(spark, truth), least, cell=16.0)
        want = sorted((p[0], g[0]) for p in pred for g in truth if p[1] == g[1] and literal_iou(p[5:], g[5:]) >= least)
        assert sorted(tuple(r) for r in pairs.select("p_id", "g_id").collect()) == want  # each pair once
    found = D.matches(pairs)
    for t in (0.5, 0.75, 0.9):
        got = {tuple(r) for r in found.where(F.abs(F.col("threshold") - t) < 1e-9).select("p_id", "g_id").collect()}
        assert got == literal_match(pred, truth, t)


def literal_ap(scored, n):
    scored = sorted(scored, key=lambda r: (-r[0], r[1]))
    hits = np.cumsum([r[2] for r in scored]) if scored else np.array([])
    precision, recall = hits / np.arange(1, len(scored) + 1), hits / n
    return sum(max((p for p, r in zip(precision, recall, strict=True) if r >= k / 100 - 1e-9), default=0) for k in range(101)) / 101


@pytest.mark.parametrize("parts", [1, 7, 1024])
def test_average_precision_equals_the_definition(spark, parts):
    pred, truth = crowd(3)
    p, g = frame(spark, pred), frame(spark, truth)
    found = D.matches(D.overlaps(p, g, 0.5))
    hit = {(r["p_id"], round(r["threshold"], 2)) for r in found.collect()}
    for r in D.average_precisions(p, g, found, parts=parts).collect():
        scored = [(x[3], x[0], (x[0], round(r["threshold"], 2)) in hit) for x in pred if x[2] == r["cls"]]
        assert r["ap"] == pytest.approx(literal_ap(scored, sum(x[2] == r["cls"] for x in truth)))


def test_average_precision_worked_values(spark):
    """Two boxes, predictions hit, miss, hit: 253/303; none hit: 0; no prediction: 0; a class without truth is left out."""
    truth = frame(spark, [(1, 1, "a", 0.0, "", 0.0, 0.0, 10.0, 10.0), (2, 1, "a", 0.0, "", 50.0, 50.0, 60.0, 60.0), (3, 1, "b", 0.0, "", 0.0, 0.0, 10.0, 10.0)])
    pred = frame(spark, [(1, 1, "a", 0.9, "", 0.0, 0.0, 10.0, 10.0), (2, 1, "a", 0.8, "", 90.0, 90.0, 95.0, 95.0), (3, 1, "a", 0.7, "", 50.0, 50.0, 60.0, 60.0), (4, 1, "c", 0.7, "", 0.0, 0.0, 1.0, 1.0)])
    found = {r["cls"]: r["ap"] for r in D.average_precisions(pred, truth, D.matches(D.overlaps(pred, truth, 0.5))).where("threshold = 0.5").collect()}
    assert found == {"a": pytest.approx(253 / 303), "b": 0.0}


def test_outcomes_cross_classes_and_count_every_box(spark):
    truth = frame(spark, [(1, 1, "a", 0.0, "", 0.0, 0.0, 10.0, 10.0), (2, 1, "b", 0.0, "", 50.0, 50.0, 60.0, 60.0), (3, 1, "a", 0.0, "", 100.0, 100.0, 110.0, 110.0), (4, None, "a", 0.0, "", 0.0, 0.0, 1.0, 1.0)])
    pred = frame(spark, [(1, 1, "a", 0.9, "", 0.0, 0.0, 10.0, 10.0), (2, 1, "c", 0.8, "", 50.0, 50.0, 60.0, 60.0), (3, 1, "a", 0.7, "", 500.0, 500.0, 510.0, 510.0), (4, 1, "a", 0.6, "", 5.0, 5.0, 5.0, None), (5, 1, "a", None, "", 0.0, 0.0, 9.0, 10.0)])
    rows = D.outcomes(pred, truth, D.overlaps(pred, truth, 0.5)).collect()
    assert sorted((r["outcome"], r["p_id"] or 0, r["g_id"] or 0, r["g_cls"] or "") for r in rows) == [
        ("fn", 0, 3, "a"), ("fn", 0, 4, "a"), ("fp", 2, 2, "b"), ("fp", 3, 0, ""), ("fp", 4, 0, ""), ("fp", 5, 0, ""), ("tp", 1, 1, "a"),
    ]


def test_empty_sides(spark):
    some, none = frame(spark, [(1, 1, "a", 0.5, "t", 0.0, 0.0, 10.0, 10.0)]), frame(spark, [])
    for p, g, want in ((some, none, (0, 1, 0)), (none, some, (0, 0, 1)), (none, none, (0, 0, 0))):
        pairs = D.overlaps(p, g, 0.5)
        r = D.report(D.outcomes(p, g, pairs), D.average_precisions(p, g, D.matches(pairs))).first()
        assert (r["tp"], r["fp"], r["fn"]) == want
        assert r["ap50"] == (0.0 if want[2] else None)


def sequence(track, n, x=0.0, first=0):
    return [(hash((track, k, x)) % 10**9, first + k, "a", 0.5, track, x + k, 0.0, x + k + 10.0, 10.0) for k in range(n)]


def scores(spark, pred, truth):
    p, g = frame(spark, pred), frame(spark, truth)
    found = D.associated(p, g)
    return D.track_report(p, g, found).first(), {r["track"]: r for r in D.track_safety(g, found).collect()}


def test_track_scores_of_worked_sequences(spark):
    truth = sequence("g", 4)
    r, _ = scores(spark, sequence("p", 4), truth)
    assert (r["mota"], r["idf1"], r["hota"], r["id_switches"]) == (1.0, 1.0, 1.0, 0)
    switch = sequence("p", 4)[:2] + [(k[0] + 1, *k[1:4], "q", *k[5:]) for k in sequence("p", 4)[2:]]
    r, safe = scores(spark, switch, truth)
    assert r["id_switches"] == safe["g"]["id_switches"] == 1 and r["idf1"] < r["mota"] == 0.75
    assert r["idf1"] == 0.5 and r["ass_a"] == 0.5 and r["hota"] == pytest.approx(0.5**0.5)
    r, safe = scores(spark, sequence("p", 4)[2:], truth)
    assert (r["misses"], r["false_positives"], r["mota"], safe["g"]["wait"]) == (2, 0, 0.5, 2)
    noise = sequence("n", 4, 500.0) + sequence("m", 4, 900.0)
    r, _ = scores(spark, sequence("p", 2) + noise, truth)
    assert r["mota"] < 0 and r["false_positives"] == 8
    r, safe = scores(spark, [sequence("p", 4)[0], sequence("p", 4)[3]], truth)
    assert (safe["g"]["fragments"], safe["g"]["n_matched"], safe["g"]["wait"]) == (1, 2, 0)
    r, _ = scores(spark, [], [])
    assert r["mota"] is None and r["idf1"] is None and r["hota"] is None
    r, safe = scores(spark, [], truth)
    assert (r["mota"], r["idf1"], r["hota"]) == (0.0, 0.0, 0.0) and safe["g"]["wait"] is None


def test_identities_are_not_used_twice(spark):
    """One predicted track over two true ones counts for one of them."""
    truth = sequence("g1", 3) + sequence("g2", 3, 100.0)
    r, _ = scores(spark, sequence("p", 3) + [(k[0] + 7, *k[1:4], "p", *k[5:]) for k in sequence("p", 3, 100.0)], truth)
    assert r["idf1"] == 0.5 and r["det_a"] == 1.0


def test_frames_at_once_and_in_rounds_agree(spark, monkeypatch):
    pred, truth = crowd(7, wide=90.0)  # many share sides
    pred = [r[:3] + (None if r[0] % 11 == 0 else r[3],) + r[4:] for r in pred]
    p, g = frame(spark, pred), frame(spark, truth)

    def found():
        pairs = D.overlaps(p, g, 0.3)
        tracks = {tuple(r) for r in D.associated(p, g).collect()}
        one = {tuple(r) for r in D.matches(pairs, (0.5,), same_class=False).collect()}
        return {tuple(r) for r in pairs.collect()}, {tuple(r) for r in D.matches(pairs).collect()}, one, tracks

    whole = found()
    assert all(whole)
    for name in ("FRAME", "PAIRS"):
        monkeypatch.setattr(D, name, 20)  # some frames are larger, or all
        assert found() == whole

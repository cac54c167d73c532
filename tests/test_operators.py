"""Operators on frames made by hand, against values worked out by hand or a literal loop."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import stats as S
from fieldloom.operators import metrics, predicate, sets, temporal, tracking, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_wilson_without_observations_is_everything(spark):
    w = one(spark, S.wilson(F.lit(0), F.lit(0)))
    assert (w["p"], w["lo"], w["hi"]) == (None, 0.0, 1.0)


def test_chapman_worked_value(spark):
    x = one(spark, S.chapman(F.lit(20), F.lit(80), F.lit(80)))
    assert round(x["n"], 4) == 484.7619
    assert round(x["var"], 3) == 6729.169
    assert one(spark, S.chapman(F.lit(0), F.lit(5), F.lit(5))) is None


def test_rogan_gladen_of_a_blind_judge_is_null(spark):
    assert one(spark, S.rogan_gladen(F.lit(0.5), F.lit(0.5), F.lit(0.5))) is None
    assert one(spark, S.rogan_gladen(F.lit(0.1), F.lit(0.9), F.lit(0.8))) == 0.0


def test_entropy_and_margin(spark):
    p = F.array(F.lit(0.5), F.lit(0.5))
    assert one(spark, S.entropy(p)) == pytest.approx(1.0)
    assert one(spark, S.margin(F.array(F.lit(0.7), F.lit(0.2)))) == pytest.approx(0.5)


def test_boxes(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)))
    assert one(spark, G.iou(box(0, 0, 2, 2), box(1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert one(spark, G.iom(box(0, 0, 4, 4), box(1, 1, 2, 2))) == 1.0
    assert one(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0


def test_polygon_and_polyline(spark):
    pts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    assert one(spark, G.in_polygon(F.lit(1.0), F.lit(1.0), pts))
    assert not one(spark, G.in_polygon(F.lit(5.0), F.lit(1.0), pts))
    assert one(spark, G.polyline_length(pts)) == 12.0
    assert one(spark, G.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111194.9, abs=1)
    assert one(spark, G.wrap_deg(F.lit(190.0))) == -170.0


def test_terms_widen_in_an_axis_and_narrow_across():
    words = {"night": ("time_of_day", ["night"]), "dusk": ("time_of_day", ["dusk"]), "vru": ("l1", ["vru"])}
    assert predicate.compile_terms("night AND dusk, vru", words) == ({"time_of_day": ["night", "dusk"], "l1": ["vru"]}, ["night", "dusk", "vru"])
    with pytest.raises(ValueError, match="unknown"):
        predicate.compile_terms("noon", words)
    with pytest.raises(ValueError, match="empty"):
        predicate.compile_terms(" ", words)
    with pytest.raises(predicate.UnknownClause):
        predicate.object_condition({"colour": ["red"]})


def test_null_state_separates_segments(spark):
    df = spark.createDataFrame([(1, t, s) for t, s in enumerate(["R", "R", None, "R", "G"])], "k int, t long, s string")
    found = temporal.state_segments(df, "k", "t", ["t"], F.col("s")).orderBy("start").collect()
    assert [(r["state"], r["start"], r["end"]) for r in found] == [("R", 0, 1), ("R", 3, 3), ("G", 4, 4)]


def test_nearest_takes_the_earlier_of_equals(spark):
    left = spark.createDataFrame([(1, 140, "a"), (1, 150, "b"), (1, 160, "c"), (1, -50, "d"), (1, 9999, "e"), (2, 5, "f")], "k int, t long, id string")
    right = spark.createDataFrame([(1, t, t) for t in (0, 100, 200, 300)], "k int, t long, v long")
    found = {r["id"]: r["nearest_t"] for r in temporal.nearest_in_time(left, right, "k", "t", "v").collect()}
    assert found == {"a": 100, "b": 100, "c": 200, "d": 0, "e": 300, "f": None}


@pytest.mark.parametrize("parts", [1, 8])
def test_sync_groups_open_at_the_first_sample(spark, parts):
    df = spark.createDataFrame([(1, t) for t in (0, 4, 9, 11, 21, 40)], "k int, t long").repartition(parts)
    found = {r["t"]: r["sync_group"] for r in temporal.sync_groups(df, "k", "t", 10).collect()}
    assert found == {0: 0, 4: 0, 9: 0, 11: 1, 21: 1, 40: 2}


def test_average_precision_worked_values(spark):
    df = spark.createDataFrame([("a", 1, 0.9, True), ("a", 2, 0.8, False), ("a", 3, 0.7, True), ("b", 4, 0.5, False)], "c string, id int, score double, tp boolean")
    truths = spark.createDataFrame([("a", 2), ("b", 3), ("c", 0), ("d", 4)], "c string, n_truth long")
    found = {r["c"]: r["ap"] for r in metrics.average_precision(df, "c", "score", "tp", truths, "id").collect()}
    assert found["a"] == pytest.approx(253 / 303)
    assert (found["b"], found["c"], found["d"]) == (0.0, None, 0.0)


def test_matching_equals_a_loop(spark):
    r = random.Random(5)

    def boxes(n, f):
        return [(f, i, *(lambda x, y: (x, y, x + 10.0, y + 10.0))(r.random() * 40, r.random() * 40), r.randrange(2), r.random()) for i in range(n)]

    p, g = boxes(12, 1), boxes(9, 1)
    cols = "f int, id long, x1 double, y1 double, x2 double, y2 double, cls int, score double"
    found = metrics.match_boxes(spark.createDataFrame(p, cols), spark.createDataFrame(g, cols), "f", 0.3).collect()

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        both = max(w, 0) * max(h, 0)
        return both / (200 - both)

    free, want = {x[1]: x for x in g}, set()
    for x in sorted(p, key=lambda x: -x[7]):
        best = max(sorted(free), key=lambda j: iou(x, free[j]) if free[j][6] == x[6] else -1, default=None)
        if best is not None and free[best][6] == x[6] and iou(x, free[best]) >= 0.3:
            want.add((x[1], best))
            del free[best]
    assert {(m["p_id"], m["g_id"]) for m in found if m["p_id"] is not None and m["g_id"] is not None} == want
    assert len(found) == len(p) + len(g) - len(want)


def test_reconcile_twice_changes_nothing(spark):
    cols = "k int, e string, ruled boolean"
    old = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", False), (4, "d", True)], cols)
    new = spark.createDataFrame([(1, "x", False), (2, "y", False), (5, "z", False)], cols)
    found = {r["k"]: r["action"] for r in sets.reconcile(old, new, ["k"], "e", "ruled").collect()}
    assert found == {1: "update", 2: "evidence", 3: "prune", 4: "skip", 5: "insert"}
    again = sets.reconcile(new, new, ["k"], "e", "ruled").select("action").distinct().collect()
    assert [r["action"] for r in again] == ["unchanged"]


def test_splits_keep_groups_whole_and_fill_each(spark):
    df = spark.createDataFrame([(g, i) for g in range(40) for i in range(g % 5 + 1)], "g int, i int")
    found = sets.assign_splits(df, "g", 0.1, 0.1).collect()
    assert len(found) == 40
    assert {r["split"] for r in found} == {"train", "val", "test"}
    tiny = sets.assign_splits(df.where("g < 3"), "g", 0.01, 0.01).collect()
    assert {r["split"] for r in tiny} == {"train", "val", "test"}


def test_seal_ignores_order(spark):
    df = spark.range(200).withColumn("v", F.col("id") * 2)
    a = sets.fingerprint(df, ["id", "v"]).first()
    b = sets.fingerprint(df.orderBy(F.desc("id")).repartition(7), ["id", "v"]).first()
    assert a == b
    assert a != sets.fingerprint(df.where("id > 0"), ["id", "v"]).first()


def test_neighbours_equal_a_loop(spark):
    r = random.Random(1)
    data = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in data if v}
    sim = lambda a, b: sum(x * y for x, y in zip(unit[a], unit[b], strict=True))
    got = {r["a"]: r["b"] for r in vectors.neighbour_blocks(df, None, rows=7).collect()}
    assert got == {a: max((b for b in unit if b != a), key=lambda b: sim(a, b)) for a in unit}
    pairs = {(r["a"], r["b"]) for r in vectors.neighbour_blocks(df, 0.5, rows=7).collect()}
    assert pairs == {(a, b) for a in unit for b in unit if a < b and sim(a, b) >= 0.5}


def test_tracker_follows_a_box_and_drops_short_ones(spark):
    rows = [("c", t, t, 10.0 * t, 0.0, 10.0 * t + 50, 50.0) for t in range(6)] + [("c", 9, 100, 900.0, 0.0, 950.0, 50.0)]
    df = spark.createDataFrame(rows, "cam string, frame long, id long, x1 double, y1 double, x2 double, y2 double")
    found = tracking.iou_tracker(df, "cam", "frame").collect()
    assert {r["id"] for r in found} == set(range(6))
    assert len({r["track_id"] for r in found}) == 1


@pytest.mark.parametrize("parts", [1, 3, 64, 4096])
def test_splits_equal_a_literal_pass(spark, parts):
    """Whatever the number of ranges, the outcome is that of walking all groups in order."""
    rng = random.Random(parts)
    for val, test, most in ((0.1, 0.1, 5), (0.2, 0.0, 40), (0.3, 0.4, 2)):
        counts = {f"g{g}": rng.randint(1, most) for g in range(120)}
        df = spark.createDataFrame([(g,) for g, n in counts.items() for _ in range(n)], "g string")
        shares = {r["g"]: r["s"] for r in df.select("g").distinct().select("g", sets.hash_share("0", "g").alias("s")).collect()}
        room = {k: v * sum(counts.values()) for k, v in (("val", val), ("test", test)) if v}
        want = {}
        for g in sorted(counts, key=lambda g: (shares[g], g)):
            want[g] = next((k for k, left in room.items() if left > 0 and counts[g] <= left * 1.25), "train")
            if want[g] in room:
                room[want[g]] -= counts[g]
        assert {r["g"]: r["split"] for r in sets.assign_splits(df, "g", val, test, parts=parts).collect()} == want


def test_diverse_equals_a_literal_pass(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([0.1, 0.5, None, rng.random()]), [rng.gauss(0, 1) for _ in range(3)] if rng.random() > 0.1 else None) for k in range(60)] + [(100, "z", 1.0, [0.0, 0.0, 0.0]), (101, "z", 1.0, [0.0, 0.0, 0.0])]
    got = vectors.diverse(spark.createDataFrame(rows, "vec_id long, grp string, s double, embedding array<double>"), "grp", F.col("s"), 4, 0.5).collect()
    want = []
    for g in ("a", "b", "z"):
        kept = []
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-(-1.0 if r[2] is None else r[2]), r[0])):
            size = lambda v: sum(x * x for x in v) ** 0.5
            near = [u for u in kept if u and r[3] and size(u) * size(r[3]) > 0 and sum(x * y for x, y in zip(u, r[3], strict=True)) / size(u) / size(r[3]) > 0.5]
            if not near and len(kept) < 4:
                kept.append(r[3])
                want.append((g, r[0], len(kept)))
    assert sorted((r["grp"], r["vec_id"], r["pick"]) for r in got) == sorted(want)


def test_similar_pairs_skip_blocks_far_apart(spark):
    rng = random.Random(10)
    rows = [(k, [rng.gauss(c, 0.3) for c in rng.choice([(5, 0, 0), (0, 5, 0), (0, 0, 5)])]) for k in range(90)] + [(200, None), (201, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(df, 0.99, rows=8).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    assert got == {(i, j) for i, a in rows[:90] for j, b in rows[:90] if i < j and cos(a, b) >= 0.99}


def test_nearest_of_many_blocks_equal_a_sort(spark, monkeypatch):
    """Copies tie; blocks are few to a task, so a row's nearest come from several tasks."""
    monkeypatch.setattr(vectors, "HELD", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)]
    rows += [(60, [0.0, 0.0, 0.0]), (61, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if v is not None}
    for k in (1, 3):
        got = {}
        for r in vectors.neighbour_blocks(df, None, rows=8, k=k).collect():
            got.setdefault(r["a"], []).append((-r["similarity"], r["b"]))
        assert got.keys() == unit.keys()
        for i, near in got.items():
            want = sorted(float(-(unit[i] @ v)) for j, v in unit.items() if j != i)[:k]
            assert np.allclose(sorted(s for s, _ in near), want) and len({b for _, b in near}) == k and i not in {b for _, b in near}

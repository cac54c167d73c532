"""Joins on the globe against all pairs, across the date line and at the poles."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import places


def metres(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


def world(seed, n, where):
    rng = random.Random(seed)
    lat, lon, wide = where
    out = []
    for k in range(n):
        x = lon + rng.uniform(-wide, wide)
        out.append((k, max(-90.0, min(90.0, lat + rng.uniform(-wide, wide))), (x + 180) % 360 - 180))
    return out


HERE = [(12.0, 180.0, 0.05), (89.99, 0.0, 180.0), (-89.9, 50.0, 0.2), (0.0, 0.0, 0.03), (60.0, -179.99, 0.1)]


@pytest.mark.parametrize("where", HERE)
@pytest.mark.parametrize("reach", [900.0, 20_000.0])
def test_pairs_in_reach_are_all_pairs(spark, where, reach):
    a, b = world(1, 60, where), world(2, 60, where)
    frames = [spark.createDataFrame(x, "id long, lat double, lon double") for x in (a, b)]
    got = sorted((r["id"], r["other"]) for r in places.within(*frames, reach).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if metres(p, q) <= reach)
    near = {r["id"]: r["other"] for r in places.nearest(*frames, reach).collect()}
    for p in a:
        best = min((metres(p, q), q[0]) for q in b)
        assert near[p[0]] == (best[1] if best[0] <= reach else None)


def test_odd_rows_and_ties(spark):
    points = [(1, 0.0, 0.0), (2, None, 0.0), (3, 0.0, None), (4, 95.0, 0.0), (5, 0.0, float("nan")), (6, 0.0, 0.0), (7, 50.0, 50.0), (None, 0.0, 0.0)]
    spots = [(9, 0.0, 0.0), (8, 0.0, 0.0), (7, 0.0, 0.001), (None, 0.0, 0.0), (3, None, None)]
    frames = [spark.createDataFrame(x, "id long, lat double, lon double") for x in (points, spots)]
    got = {(r["id"], r["other"]) for r in places.nearest(*frames, 1000.0).collect()}
    assert got == {(1, 8), (2, None), (3, None), (4, None), (5, None), (6, 8), (7, None), (None, 8)}
    assert places.nearest(frames[0].limit(0), frames[1], 10.0).count() == 0
    assert places.nearest(frames[0], frames[1].limit(0), 10.0).where("other IS NOT NULL").count() == 0


def test_nearest_stretch_of_a_line(spark):
    """A long road is met at its middle too, and one across the date line from both sides."""
    lines = spark.createDataFrame([(1, 0.0, -1.0, 0.0, 1.0), (2, 10.0, 179.9, 10.0, -179.9), (3, 0.002, 0.5, 0.002, 0.5)], "id long, lat1 double, lon1 double, lat2 double, lon2 double")
    points = spark.createDataFrame([(1, 0.0005, 0.33), (2, 10.0005, 179.95), (3, 10.0005, -179.95), (4, 5.0, 5.0), (5, 0.0019, 0.5)], "id long, lat double, lon double")
    got = {r["id"]: (r["line"], r["metres"] and round(r["metres"], 2)) for r in places.nearest_line(points, lines, 100.0).collect()}
    assert got == {1: (1, 55.66), 2: (2, 55.66), 3: (2, 55.66), 4: (None, None), 5: (3, 11.13)}


def test_consensus_equals_a_literal_pass(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), *p[1:], rng.choice([None, 0.4, 0.9])) for k, p in enumerate(world(5, 150, (12.0, 180.0, 0.02)))]
    got = sorted((r["seed"], r["n"], r["best"], round(r["conf"], 9)) for r in places.consensus(spark.createDataFrame(rows, "id long, kind string, lat double, lon double, conf double"), 700.0).collect())
    used, want = set(), []
    for r in rows:
        if r[0] in used:
            continue
        cluster = [f for f in rows if f[0] not in used and f[1] == r[1] and (f[0] == r[0] or metres((0, *r[2:4]), (0, *f[2:4])) <= 700.0)]
        used |= {f[0] for f in cluster}
        conf = [0.5 if f[4] is None else f[4] for f in cluster]
        best = max(cluster, key=lambda f: (0.5 if f[4] is None else f[4], -f[0]))
        want.append((r[0], len(cluster), best[0], round(min(0.99, sum(conf) / len(conf) * (1 + 0.1 * (len(conf) - 1))), 9)))
    assert got == sorted(want)


def test_well_known_text(spark):
    rows = ["POINT(1 2)", "point z (1.5 -2 7)", "SRID=4326;LINESTRING(0 0, 4 0, 4 4)", "POLYGON((0 0, 6 0, 0 6, 0 0))", "POLYGON((0 0, 1 0, 0 0))", "CIRCLE(1)", "", None, "LINESTRING(1 1, 1 1)"]
    found = spark.createDataFrame([(t,) for t in rows], "t string").select(places.wkt_centroid(F.col("t")).alias("c")).collect()
    assert [r["c"] and tuple(r["c"]) for r in found] == [(1.0, 2.0), (1.5, -2.0), (3.0, 1.0), (2.0, 2.0), (0.5, 0.0), None, None, None, (1.0, 1.0)]


def test_nearest_line_measures_whole_stretches(spark):
    """Points on roads that lie on one another: the last bits tell which is nearest, and those are of whole stretches.
    Copies of roads and of spots give what one gives."""
    rng = random.Random(8)
    roads, spots = [], []
    for k in range(40):
        lat, lon, up, east = 12.0 + rng.randrange(200) / 1e4, 179.9 + rng.randrange(2000) / 1e4, rng.randrange(-24, 25) / 5000, rng.randrange(-20, 20) / 5000
        far = [(lat + up * m, lon + east * m) for m in (1, 2, 3)]
        roads += [(200 - 3 * k - m, lat, lon - 360 * (lon > 180), *at) for m, at in enumerate(far)]
        roads[-3:] = [(i, a, b, c, d - 360 * (lon > 180)) for i, a, b, c, d in roads[-3:]]
        spots += [(lat + up * m, lon + east * m) for m in (0.25, 0.3, 1.3, 2.9)]
    points = [(k, a, b - 360 * (b > 180)) for k, (a, b) in enumerate(spots)]

    def metres(p, r):
        c = math.cos(math.radians(p[1])) * 111_320.0
        d = r[2] - p[2]
        d = d - 360 if d > 180 else d + 360 if d < -180 else d
        x1, x2, y1, y2 = d * c, (d + (r[4] - r[2])) * c, (r[1] - p[1]) * 111_320.0, (r[3] - p[1]) * 111_320.0
        size = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = min(max(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / size, 0.0), 1.0) if size > 0 else 0.0
        return math.sqrt((x1 + t * (x2 - x1)) ** 2 + (y1 + t * (y2 - y1)) ** 2)

    want = {p[0]: min((metres(p, r), r[0]) for r in roads)[1] for p in points}
    frames = [spark.createDataFrame(points + [(1000 + i, a, b) for i, a, b in points], "id long, lat double, lon double"), spark.createDataFrame(roads + [(1000 + r[0], *r[1:]) for r in roads], "id long, lat1 double, lon1 double, lat2 double, lon2 double")]
    got = {r["id"]: r["line"] for r in places.nearest_line(*frames, 150.0).collect()}
    assert got == want | {1000 + i: line for i, line in want.items()}


def literal_consensus(rows, radius):
    used, want = set(), []
    for r in rows:
        if r[0] in used:
            continue
        cluster = [f for f in rows if f[0] not in used and f[1] == r[1] and (f[0] == r[0] or metres((0, *r[2:4]), (0, *f[2:4])) <= radius)]
        used |= {f[0] for f in cluster}
        best = max(cluster, key=lambda f: (f[4], -f[0]))
        want.append((r[0], len(cluster), best[0]))
    return sorted(want)


def test_consensus_of_crowds_does_not_make_their_pairs(spark, monkeypatch):
    """Many at one spot, many within the radius, and cells of more than one round; no join makes the pairs of a crowd."""
    rng = random.Random(6)
    where = [(12.0, 180.0)] * 200 + [(12.0 + rng.uniform(0, 0.02), -180.0 + rng.uniform(0, 0.02)) for _ in range(500)]
    rng.shuffle(where)
    rows = [(k, rng.choice("ab"), *p, rng.choice([0.2, 0.4, 0.9])) for k, p in enumerate(where)]
    made, within = [], places.within

    def counted(*of):
        made.append(within(*of).count())
        return within(*of)

    monkeypatch.setattr(places, "within", counted)
    found = places.consensus(spark.createDataFrame(rows, "id long, kind string, lat double, lon double, conf double"), 700.0).collect()
    assert sorted((r["seed"], r["n"], r["best"]) for r in found) == literal_consensus(rows, 700.0)
    assert max(made) < 10 * len(rows)


def test_consensus_adds_digits(spark):
    """The mean of 16 is a half of the sixth digit: the order of a sum of doubles would tell which way it is rounded."""
    conf, rng, rows = [0.1, 0.2, 0.3, 0.7, 0.35, 0.37, 0.41, 0.29, 0.33, 0.39, 0.17, 0.43, 0.51, 0.07, 0.61, 0.32], random.Random(1), []
    for k in range(30):
        rows += [(100 * k + i, f"kind {k}", 1.0, 1.0, x) for i, x in enumerate(rng.sample(conf, 16))]
    found = places.consensus(spark.createDataFrame(rows, "id long, kind string, lat double, lon double, conf double"), 10.0).collect()
    assert [(r["n"], r["conf"]) for r in found] == [(16, 0.8671875)] * 30

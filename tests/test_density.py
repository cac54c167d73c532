"""Density clusters against a literal version on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import density as D


def literal(points, radius, least, levels):
    """Labels by plain loops over all pairs, with the same levels."""
    ids, v = [i for i, _ in points], np.array([x for _, x in points], float)
    n = len(ids)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    core = {}
    for k in range(n):
        near = sorted(d[k][j] for j in range(n) if j != k and d[k][j] <= radius)
        if len(near) >= least:
            core[k] = near[least - 1]
    edges = sorted((max(d[i][j], core[i], core[j]), ids[i], ids[j], i, j) for i in core for j in core if ids[i] < ids[j] and max(d[i][j], core[i], core[j]) <= radius)
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    tree = []
    for w, _, _, i, j in edges:
        if root(i) != root(j):
            up[root(i)] = root(j)
            tree.append((w, i, j))
    weights = sorted(w for w, _, _ in tree)
    if not weights:
        return core, {i: None for i in ids}
    cuts = sorted({weights[max(0, -(-k * len(weights) // levels) - 1)] for k in range(1, levels + 1)} | {weights[-1]})
    cuts = [c for c in cuts if c > 0] or [radius]

    def parts(level):
        label = {k: {k} for k in core}
        for w, i, j in tree:
            if w <= cuts[level]:
                both = label[i] | label[j]
                for k in both:
                    label[k] = both
        return [s for s in {frozenset(s) for s in label.values()} if len(s) >= least]

    def grow(part, level, birth):
        """(best stability, clusters chosen) of the cluster that begins as `part` at `level`."""
        own, born = 0.0, part
        while True:
            below = [s for s in parts(level - 1) if s <= part] if level else []
            leaves = len(part) - len(below[0]) if len(below) == 1 else len(part)
            own += leaves * (1 / cuts[level] - birth)
            if len(below) != 1:
                break
            part, level = below[0], level - 1
        rest = [grow(s, level - 1, 1 / cuts[level]) for s in below]
        if own >= sum(r[0] for r in rest) - 1e-12:
            return own, [born], rest
        return sum(r[0] for r in rest), [c for r in rest for c in r[1]], rest

    top = parts(len(cuts) - 1)
    whole = [grow(s, len(cuts) - 1, 1 / radius) for s in top]
    chosen = [c for r in whole for c in r[1]] if len(top) != 1 else [c for r in whole[0][2] for c in r[1]]
    out = {i: None for i in ids}
    for c in chosen:
        for k in c:
            out[ids[k]] = min(ids[m] for m in c)
    return core, out


def blobs(seed, sizes, spread=0.3, wide=2, noise=10):
    rng = np.random.default_rng(seed)
    rows = []
    for s in sizes:
        rows += (rng.normal(size=wide) * 5 + rng.normal(size=(s, wide)) * spread * rng.uniform(0.5, 2)).tolist()
    rows += rng.uniform(-12, 12, size=(noise, wide)).tolist()
    order = rng.permutation(len(rows))
    return [(int(i) * 3 + 1, rows[i]) for i in order]


@pytest.mark.parametrize(("seed", "sizes", "radius", "least"), [(1, [30, 25, 12], 50.0, 5), (2, [40, 8, 20, 20], 1.5, 4)])
def test_clusters_equal_a_literal_version(spark, seed, sizes, radius, least):
    points = blobs(seed, sizes)
    points += [(5000 + k, points[0][1]) for k in range(6)]  # copies
    frame = spark.createDataFrame([(*p, 1) for p in points], "vec_id long, embedding array<double>, core int")
    core, want = literal(points, radius, least, 8)
    got = {r["id"]: r for r in D.density_clusters(frame, radius, least, 8).collect()}
    assert {i: r["core"] is not None for i, r in got.items()} == {points[k][0]: k in core for k in range(len(points))}
    assert {i: r["cluster"] for i, r in got.items()} == want
    assert len({c for c in want.values() if c is not None}) >= 2


def test_forest_equals_kruskal_at_any_blocking(spark, monkeypatch):
    points = blobs(3, [40, 30], noise=20)
    frame = spark.createDataFrame([(i, x, 0.4) for i, x in points], "id long, v array<double>, core double")
    meet = D.meetings
    monkeypatch.setattr(D, "meetings", lambda p, r: meet(p, r, rows=7, pivots=5))
    got = sorted((r["a"], r["b"], round(r["w"], 9)) for r in D.spanning_forest(D.forest_edges(frame, 3.0)).collect())
    v = dict(points)
    edges = sorted((max(float(np.linalg.norm(np.subtract(v[a], v[b]))), 0.4), a, b) for a in v for b in v if a < b)
    up = {i: i for i in v}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    want = []
    for w, a, b in edges:
        if w <= 3.0 and root(a) != root(b):
            up[root(a)] = root(b)
            want.append((a, b, round(w, 9)))
    assert got == sorted(want)


def test_odd_rows_are_noise(spark):
    rows = [(1, None), (2, [float("nan"), 0.0]), (None, [0.0, 0.0]), (3, [9.0, 9.0]), (4, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r["id"], r["cluster"]) for r in D.density_clusters(frame, 1.0, 2).collect()) == [(1, None), (2, None), (3, None), (4, None)]
    assert D.density_clusters(frame.limit(0), 1.0, 2).count() == 0


def test_rare_rows(spark):
    frame = spark.createDataFrame([(k, [1.0, 0.01 * k]) for k in range(8)] + [(20, [-1.0, 0.2])], "vec_id long, embedding array<double>")
    clusters = spark.createDataFrame([(k, 0 if k < 6 else 6) for k in range(8)] + [(20, None)], "id long, cluster long")
    got = {r["id"]: (r["kind"], r["score"]) for r in D.rare_rows(frame, clusters, 0.99).collect()}
    assert got[20][0] == "embedding_outlier" and set(got) == {20}
    small = clusters.withColumn("cluster", F.when(F.col("id") == 7, 7).otherwise(F.col("cluster")))
    assert D.rare_rows(frame, small.where("id <> 6"), 0.99).where("kind = 'sparse_cluster'").collect() == [(7, "sparse_cluster", 1.0)]


def test_meetings_are_flat_and_no_table_of_rows_goes_through_the_driver(spark):
    """Blocks travel as flat arrays, and the plan that meets them has no broadcast of rows."""
    points = spark.range(4000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    met = D.meetings(points, 0.1, rows=100)
    assert {t for c, t in met.dtypes if c.endswith(("ids", "values"))} == {"array<bigint>", "array<double>"}
    assert "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()
    rows = met.select("x_block", "y_block", F.size("x_ids").alias("n"), F.size("x_values").alias("m")).collect()
    assert all(r["m"] == 2 * r["n"] for r in rows)
    assert len({frozenset((r["x_block"], r["y_block"])) for r in rows}) == len(rows)


def test_edges_of_a_task_are_one_forest(spark, monkeypatch):
    """A task keeps the forest of all its meetings, so edges grow with points and tasks, not with pairs of blocks."""
    points = blobs(7, [60, 40], noise=20)
    frame = spark.createDataFrame([(i, x, 0.4) for i, x in points], "id long, v array<double>, core double")
    meet = D.meetings
    monkeypatch.setattr(D, "meetings", lambda p, r: meet(p, r, rows=5, pivots=5))
    edges = D.forest_edges(frame, 30.0)
    tasks = edges.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert tasks and all(r["count"] < len(points) for r in tasks)


@pytest.mark.parametrize("few", [0, 40])
def test_rounds_give_what_one_task_gives(spark, monkeypatch, few):
    points = blobs(5, [30, 12], noise=6)
    frame = spark.createDataFrame([(*p, 1) for p in points], "vec_id long, embedding array<double>, core int")
    want = sorted((r["id"], r["core"], r["cluster"]) for r in D.density_clusters(frame, 4.0, 4, 6).collect())
    monkeypatch.setattr(D, "FEW", few)
    assert sorted((r["id"], r["core"], r["cluster"]) for r in D.density_clusters(frame, 4.0, 4, 6).collect()) == want
    assert len({c for _, _, c in want if c is not None}) >= 2


def test_forest_and_components_of_places():
    """The same forest as one edge at a time gives, with many equal distances; each component goes by its least place."""
    rng = np.random.default_rng(2)
    n, near = 400, 600
    v = rng.normal(size=(n, 3))
    v[50:90] = v[0]
    a, b = (x.astype(np.int64) for x in np.triu_indices(n, 1))
    w = np.round(np.sqrt(((v[a] - v[b]) ** 2).sum(axis=1)), 2)
    label = np.arange(n)
    want = []
    for k in np.lexsort((b, a, w)):
        p, q = label[a[k]], label[b[k]]
        if p != q:
            label[label == q] = p
            want.append(k)
    assert sorted(D.forest_of(n, a, b, np.lexsort((b, a, w)))) == sorted(want)
    few = rng.choice(len(a), near, replace=False)
    parts = D.joined(n, a[few], b[few])
    for k in few:
        assert parts[a[k]] == parts[b[k]]
    assert (parts <= np.arange(n)).all() and (parts[parts] == parts).all()


def test_rare_rows_work_out_the_clusters_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    frame = spark.createDataFrame([(k, [1.0, 0.01 * k]) for k in range(8)], "vec_id long, embedding array<double>")
    clusters = spark.createDataFrame([(k, 0 if k < 6 else None) for k in range(8)], "id long, cluster long").mapInPandas(counted, "id long, cluster long")
    assert {6, 7} <= {r["id"] for r in D.rare_rows(frame, clusters, 0.99).collect()}
    assert seen.value == 8

"""Density clusters of vectors: mutual reachability, minimum spanning forest, condensed hierarchy, stable clusters.

1. Vectors go to the nearest of some pivots and are packed into blocks; blocks meet only where balls around their pivots
   are within `radius`. Each meeting gives every vector's few least distances, of which the `least`th is its core distance.
2. The distance between two is the greatest of theirs and both core distances. A task gives the edges of the spanning
   forest of its meetings only: no other edge can be in the whole one, and copies never make all their pairs. Squared
   distances come from products; what those can't rule out is measured by differences.
3. The forest of what is left takes one task up to `FEW` edges, rounds of joins beyond: each component takes its first
   edge by (distance, ids) out of it. So does the hierarchy, with one task up to `FEW` points.
4. The hierarchy is cut at `levels` quantiles of the forest's distances, each taken up to the next. Clusters are
   components of at least `least` members, born where one splits into several or from the start; a cluster's stability
   is the sum of 1 / distance from its birth until each member leaves it; of a cluster and those below it the more
   stable side stays. If all are one component at the last level, that one is no cluster.

Distances are Euclidean. Vectors farther than `radius` from all others, null ones and those with an odd component are
noise. Ids are unique; vectors of one table have one length. Labels are the smallest id of the cluster at its birth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, cut

EDGE = "a long, b long, w double"
HELD = 128  # blocks that a task meets its own with
FEW = 2_000_000  # edges of a spanning forest that one task may have; more go by rounds of joins


def usable(df: DataFrame, unique: str, vector: str) -> DataFrame:
    df = df.where(F.col(unique).isNotNull() & F.col(vector).isNotNull()).select(F.col(unique).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & (F.size("v") > 0))


def meetings(points: DataFrame, radius: float, rows: int = 512, pivots: int = 64) -> DataFrame:
    """Two blocks that may hold pairs within `radius`, each two once, and each with itself (`same`): of each block x and y its
    name, ids, values (the vectors one after another) and the other columns, as arrays in the order of ids.

    `points`: id, v and what else to carry. At most `pivots` vectors and a row for each pivot are on the driver. Blocks are
    dealt into decks, of about `HELD` blocks at most, and two decks are a task: up to 8 * HELD blocks each is sent nine
    times, and only the meetings grow with the square."""
    pivots = max(1, min(pivots, points.count() // rows))  # small tables are few blocks
    some = points.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    centres = np.unique(np.array([r["v"] for r in some], float), axis=0) if some else np.zeros((1, 1))

    def nearest(batches):
        for b in batches:
            v = np.stack(b["v"].to_numpy()).astype(float) if len(b) else np.zeros((0, centres.shape[1]))
            away = np.sqrt(np.maximum(((v[:, None, :] - centres) ** 2).sum(axis=2), 0)) if len(b) < 64 else np.sqrt(np.maximum((v**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * v @ centres.T, 0))
            yield b.assign(pivot=away.argmin(axis=1), away=away.min(axis=1))

    dealt = points.mapInPandas(nearest, points.withColumns({"pivot": F.lit(0), "away": F.lit(0.0)}).schema)
    dealt = cut(dealt)
    cells = {r["pivot"]: (r["n"], r["reach"]) for r in dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("reach")).collect()}
    chunks = {p: -(-n // rows) for p, (n, _) in cells.items()}
    slack = 1e-6 * (np.abs(centres).max() + 1)
    near = {(int(p), int(q)) for p in cells for q in cells if p <= q and np.linalg.norm(centres[p] - centres[q]) <= radius + cells[p][1] + cells[q][1] + slack}
    spark = points.sparkSession
    beside = spark.createDataFrame([(p, [q for q in cells if (min(p, q), max(p, q)) in near]) for p in cells], "pivot int, near array<int>")
    n_chunks = spark.createDataFrame(list(chunks.items()), "pivot int, chunks int")
    more = [c for c in points.columns if c not in ("id", "v")]
    packed = dealt.join(F.broadcast(n_chunks), "pivot").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    packed = packed.groupBy("pivot", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "v", *more))).alias("rows"))
    packed = cut(packed.select((F.col("pivot") * F.lit(1 << 32) + F.col("chunk")).alias("block"), "pivot", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("values"), *(F.col(f"rows.{c}").alias(c) for c in more)))
    names = packed.columns
    n = sum(chunks.values())
    decks = min(max(1, n), max(8, -(-n // HELD)))
    packed = packed.withColumn("deck", F.pmod(F.xxhash64("block"), F.lit(decks)).cast("int"))
    own, every = F.col("deck"), F.sequence(F.lit(0), F.lit(decks - 1))  # a task has two decks, the lesser one as x
    left = packed.join(F.broadcast(beside), "pivot").select("near", F.explode(F.filter(every, lambda d: d >= own)).alias("_y"), own.alias("_x"), *(F.col(c).alias(f"x_{c}") for c in names))
    right = packed.select(F.explode(F.filter(every, lambda d: d <= own)).alias("_x"), own.alias("_y"), *(F.col(c).alias(f"y_{c}") for c in names))
    meet = F.array_contains("near", F.col("y_pivot")) & ((F.col("_x") < F.col("_y")) | (F.col("x_block") <= F.col("y_block")))
    met = left.join(right.hint("merge"), ["_x", "_y"]).where(meet)
    sides = [f"{side}_{c}" for side in "xy" for c in ("block", "ids", "values", *more)]
    return met.select(*sides, (F.col("x_block") == F.col("y_block")).alias("same"))


def met(batches, *more: str):
    """(x, y, same) of each meeting in Arrow batches; a side is (block, ids, vectors, *more)."""
    for batch in batches:
        for at, same in enumerate(batch.column("same").to_pylist()):
            sides = []
            for side in "xy":
                ids, values, *rest = (batch.column(f"{side}_{c}").slice(at, 1).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "values", *more))
                sides.append((batch.column(f"{side}_block")[at].as_py(), ids, values.reshape(len(ids), -1), *rest))
            yield *sides, same


def squares(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one product, and how far they may be off: only what they cannot rule out is measured."""
    x, y = (v * v).sum(axis=1), (u * u).sum(axis=1)
    return (x[:, None] + y) - 2 * (v @ u.T), 1e-12 * v.shape[1] * float(x.max(initial=0) + y.max(initial=0))


def exact(v: np.ndarray, u: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of v to rows j of u: differences, not products, so copies are exactly 0 apart."""
    away = np.empty(len(i))
    for k in range(0, len(i), 1 << 14):
        at = slice(k, k + (1 << 14))
        away[at] = np.sqrt(((v[i[at]] - u[j[at]]) ** 2).sum(axis=1))
    return away


def core_distances(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(id, core): the distance to the `least`th nearest other, of points that have as many within `radius`."""

    def run(batches):
        nearest: dict[int, tuple] = {}  # of the task's blocks, `least` a row, ascending
        for x, y, same in met(batches):
            square, off = squares(x[2], y[2])
            if same:
                np.fill_diagonal(square, np.inf)
            for (block, ids, v), u, axis in ((x, y[2], 1), (y, x[2], 0))[: 1 if same else 2]:
                few = nearest.setdefault(block, (ids, np.full((len(ids), least), np.inf)))[1]
                if not few[:, -1].any():  # all have as many copies
                    continue
                bar = np.minimum(few[:, -1], radius)
                bar = np.where(few[:, -1] > 0, bar * bar * (1 + 1e-12) + off, -np.inf)
                hit = square <= (bar[:, None] if axis else bar)
                if np.count_nonzero(hit) > 4 * least * len(ids) and len(u) > least:
                    kth = np.partition(square, least - 1, axis=axis).take(least - 1, axis=axis)
                    bar = np.minimum(bar, kth + 2 * off)
                    hit = square <= (bar[:, None] if axis else bar)
                i, j = np.nonzero(hit)
                away = exact(x[2], y[2], i, j)
                i = i if axis else j
                rows = np.unique(i)
                r, d = np.concatenate([np.repeat(rows, least), i]), np.concatenate([few[rows].ravel(), away])
                by = np.lexsort((d, r))
                r, d = r[by], d[by]
                few[rows] = d[np.arange(len(r)) - np.searchsorted(r, r) < least].reshape(len(rows), least)
        for ids, few in nearest.values():
            few = [r[r <= radius].tolist() for r in few]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(few, pa.list_(pa.float64()))], names=["id", "near"])

    near = meetings(points, radius).mapInArrow(run, "id long, near array<double>").where(F.size("near") > 0)
    every = F.array_sort(F.flatten(F.collect_list("near")))  # `least` for each task
    return near.groupBy("id").agg(F.get(every, F.lit(least - 1)).alias("core")).where(F.col("core").isNotNull())


def roots(up: np.ndarray) -> np.ndarray:
    while (up != (further := up[up])).any():
        up = further
    return up


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the n places the least one it is connected with."""
    label = np.arange(n)
    while True:
        p, q = label[a], label[b]
        if (p == q).all():
            return label
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        label = roots(label)


def forest_of(n: int, a: np.ndarray, b: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which of the edges between n places, in the order `by`, are in the least spanning forest: Borůvka rounds."""
    a, b, rank, label, taken = a[by], b[by], np.arange(len(by)), np.arange(n), [np.empty(0, np.int64)]
    while True:
        p, q = label[a[rank]], label[b[rank]]
        out = p != q
        rank, p, q = rank[out], p[out], q[out]
        if not len(rank):
            return by[np.sort(np.concatenate(taken))]
        first = np.full(n, -1)
        first[np.stack([p, q], axis=1).ravel()[::-1]] = np.repeat(rank, 2)[::-1]  # the last one written is the first edge
        parts = np.flatnonzero(first >= 0)
        edge = first[parts]
        taken.append(np.unique(edge))
        up = np.arange(n)
        up[parts] = label[a[edge]] + label[b[edge]] - parts
        both = (up[up] == np.arange(n)) & (np.arange(n) < up)  # two that took one edge
        up[both] = np.flatnonzero(both)
        label = roots(up)[label]


def forest_edges(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, w) with a < b: edges within `radius` that may be in the spanning forest. `points`: id, v, core.

    A task keeps the forest of what it has seen, and passes over pairs that shorter edges of it connect."""

    def run(batches):
        first: dict[int, int] = {}  # place of a block's first row among the task's rows
        ids, a, b, w, pending = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), []
        known: list[tuple] = []  # what edges up to a distance connect
        held, most = 0, 1 << 17

        def pruned():
            p, q, x = (np.concatenate(z) for z in zip((a, b, w), *pending, strict=True))
            lesser, greater = np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])
            kept = forest_of(len(ids), p, q, np.lexsort((greater, lesser, x)))
            return p[kept], q[kept], x[kept]

        for (left, i_ids, v, one), (right, j_ids, u, other), same in met(batches, "core"):
            for block, more in ((left, i_ids), (right, j_ids)):
                if block not in first:
                    first[block] = len(ids)
                    known = [(at, np.concatenate([label, np.arange(len(ids), len(ids) + len(more))])) for at, label in known]
                    ids = np.concatenate([ids, more])
            square, off = squares(v, u)
            i, j = np.nonzero(square <= radius * radius * (1 + 1e-12) + off)
            if same:
                i, j = i[i < j], j[i < j]
            p, q = first[left] + i, first[right] + j
            under = np.maximum(np.maximum(square[i, j] - off, one[i] ** 2 * (1 - 1e-12)), other[j] ** 2 * (1 - 1e-12))
            for at, label in known:
                open_ = (under <= at * at * (1 + 1e-12)) | (label[p] != label[q])
                i, j, p, q, under = i[open_], j[open_], p[open_], q[open_], under[open_]
            x = np.maximum(np.maximum(exact(v, u, i, j), one[i]), other[j])
            near = x <= radius
            pending.append((p[near], q[near], x[near]))
            held += np.count_nonzero(near)
            if held > most:
                a, b, w = pruned()
                pending, held, most = [], 0, max(1 << 17, len(w))
                steps = np.unique(np.quantile(w, [0.25, 0.5, 0.75, 0.9, 0.97, 1.0], method="higher"))[::-1]
                known = [(at, joined(len(ids), a[w <= at], b[w <= at])) for at in steps]
        a, b, w = pruned()
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b])), pa.array(w)], names=["a", "b", "w"])

    return meetings(points, radius).mapInArrow(run, EDGE)


def whole_forest(batches):
    """The spanning forest of one task's edges."""
    columns = [(*(x.to_numpy() for x in batch.columns),) for batch in batches]
    a, b, w = (np.concatenate(z) for z in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *columns, strict=True))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    kept = forest_of(len(ids), at[: len(a)], at[len(a) :], np.lexsort((b, a, w)))
    yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (a, b, w)], names=["a", "b", "w"])


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w) of the minimum spanning forest; equal distances go by (a, b). Tasks of up to `FEW` edges keep their own
    forests while that makes them fewer, up to one task; what is more than that goes by Borůvka rounds."""
    edges = cut(edges.select("a", "b", "w"))
    n, before = edges.count(), None
    while before is None or (n > FEW and 4 * n < 3 * before):
        parts = max(1, -(-n // max(1, FEW)))
        if parts > n:
            break
        edges = cut(edges.repartition(parts).mapInArrow(whole_forest, EDGE))
        if parts == 1:
            return edges
        n, before = edges.count(), n
    open_ = cut(edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")))
    out = None
    while not open_.isEmpty():
        edge = F.struct("w", "a", "b", "x", "y")
        ends = open_.select(F.col("x").alias("part"), edge.alias("e")).union(open_.select("y", edge))
        taken = cut(ends.groupBy("part").agg(F.min("e").alias("e")).select("e.*").distinct())
        out = taken.select("a", "b", "w") if out is None else out.union(taken.select("a", "b", "w"))
        label = components(taken, "x", "y")
        for c in ("x", "y"):
            now = label.select(F.col("id").alias(c), F.col("label").alias("_l"))
            open_ = open_.join(now.hint("merge"), c).withColumn(c, F.col("_l")).drop("_l")  # each component took an edge, so has a label
        open_ = cut(open_.where("x <> y"))
    return edges.select("a", "b", "w").limit(0) if out is None else cut(out)


def whole_clusters(batches, radius: float, least: int, levels: int):
    """(id, cluster) of the stable clusters of a forest that one task has."""
    columns = [(*(x.to_numpy() for x in batch.columns),) for batch in batches]
    a, b, w = (np.concatenate(z) for z in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *columns, strict=True))
    if not len(w):
        return
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, a, b = len(ids), at[: len(w)], at[len(w) :]
    steps = np.unique(np.sort(w)[[max(0, -(-k * len(w) // levels) - 1) for k in range(1, levels + 1)]])
    steps = steps[steps > 0] if (steps > 0).any() else np.array([radius])
    top = len(steps) - 1
    part, size = [], []  # of each level: the place of the least id of a row's component, -1 without an edge, and its rows
    for distance in steps:
        p, q = a[w <= distance], b[w <= distance]
        label, alone = joined(n, p, q), np.ones(n, bool)
        alone[p] = alone[q] = False
        label[alone] = -1
        part.append(label)
        size.append(np.bincount(label[~alone], minlength=n))
    named = np.full(n, -1)  # cluster of each part of the level above
    split = np.zeros(n, bool)
    level, place, parent, own = (np.empty(0, t) for t in (int, int, int, float))
    for k in range(top, -1, -1):
        rows = np.flatnonzero((size[k] >= least) & (part[k] == np.arange(n)))
        above = part[k + 1][rows] if k < top else np.full(len(rows), -1)
        born = split[above] if k < top else np.ones(len(rows), bool)
        cluster = named[above] if k < top else np.full(len(rows), -1)
        new = rows[born]
        level, place, parent, own = np.append(level, np.full(len(new), k)), np.append(place, new), np.append(parent, cluster[born]), np.append(own, np.zeros(len(new)))
        cluster[born] = np.arange(len(level) - len(new), len(level))
        below = np.flatnonzero((size[k - 1] >= least) & (part[k - 1] == np.arange(n))) if k else np.empty(0, int)
        n_below = np.bincount(part[k][below], minlength=n)
        size_below = np.bincount(part[k][below], weights=size[k - 1][below] if k else None, minlength=n)
        leaves = size[k][rows] - np.where(n_below[rows] == 1, size_below[rows], 0)
        birth = np.where(level[cluster] == top, 1 / radius, 1 / steps[np.minimum(level[cluster] + 1, top)])
        own += np.bincount(cluster, weights=leaves * (1 / steps[k] - birth), minlength=len(own))
        named, split = np.full(n, -1), n_below > 1
        named[rows] = cluster
    roots_ = np.flatnonzero(parent < 0)
    if len(roots_) == 1:
        own[roots_] = -1.0
    under, best = np.zeros(len(own)), np.zeros(len(own))
    for k in range(top + 1):  # from the bottom: the best of a cluster and of what is below it
        here = np.flatnonzero(level == k)
        best[here] = np.maximum(own[here], under[here])
        inner = here[parent[here] >= 0]
        np.add.at(under, parent[inner], best[inner])
    wins = own >= under
    open_, cluster = np.zeros(len(own), bool), np.full(n, -1)
    for k in range(top, -1, -1):  # from the top: the first that wins on each way down
        here = np.flatnonzero(level == k)
        open_[here] = (parent[here] < 0) | (open_[parent[here]] & ~wins[parent[here]])
        chosen = np.zeros(n + 1, bool)
        chosen[place[here[open_[here] & wins[here]]]] = True
        rows = chosen[part[k]]  # -1 is none
        cluster[rows] = part[k][rows]
    found = cluster >= 0
    yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(ids[cluster[found]])], names=["id", "cluster"])


def stable_clusters(points: DataFrame, forest: DataFrame, radius: float, least: int, levels: int) -> DataFrame:
    """(id, cluster): the stable cluster of each point of the forest, null for noise."""
    spark = points.sparkSession
    if forest.count() <= FEW:
        found = cut(forest.select("a", "b", "w").repartition(1).mapInArrow(lambda batches: whole_clusters(batches, radius, least, levels), "id long, cluster long"))
        return points.select("id").join(found.hint("merge"), "id", "left")
    cuts = forest.agg(F.percentile_approx("w", [k / levels for k in range(1, levels + 1)], 10_000).alias("cuts"), F.max("w").alias("most")).first()
    if not cuts["cuts"]:
        return points.select("id", F.lit(None).cast("long").alias("cluster"))
    steps = sorted({*cuts["cuts"], cuts["most"]})
    steps = [x for x in steps if x > 0] or [radius]
    table = spark.createDataFrame(list(enumerate(steps)), "level int, distance double")
    # every level is a graph of its own: one run labels all
    edges = forest.crossJoin(F.broadcast(table)).where("w <= distance")  # a row for each level
    named = components(edges.select(F.struct("level", F.col("a").alias("id")).alias("a"), F.struct("level", F.col("b").alias("id")).alias("b")))
    member = cut(named.select("id.level", "id.id", F.col("label.id").alias("part")))
    parts = member.groupBy("level", "part").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    above = member.select((F.col("level") - 1).alias("level"), F.col("id").alias("part"), F.col("part").alias("above"))
    parts = cut(parts.join(above.hint("merge"), ["level", "part"], "left"))
    below = parts.where("above IS NOT NULL").groupBy((F.col("level") + 1).alias("level"), F.col("above").alias("part")).agg(F.count(F.lit(1)).alias("n_below"), F.sum("size").alias("size_below"))
    parts = parts.join(below, ["level", "part"], "left").fillna(0, ["n_below", "size_below"])
    splits = parts.select((F.col("level") - 1).alias("level"), F.col("part").alias("above"), (F.col("n_below") > 1).alias("split"))
    parts = parts.join(splits, ["level", "above"], "left").withColumn("born", F.col("above").isNull() | F.col("split"))
    # from each part up to where its cluster was born
    up = F.when(F.col("born"), F.struct("level", "part")).otherwise(F.struct((F.col("level") + 1).alias("level"), F.col("above").alias("part")))
    parts = cut(parts.withColumn("to", up))
    for _ in range(max(1, len(steps)).bit_length()):
        hop = parts.select(F.struct("level", "part").alias("to"), F.col("to").alias("next"))
        parts = cut(parts.join(hop.hint("merge"), "to").withColumn("to", F.col("next")).drop("next"))
    rate = F.create_map(*(F.lit(x) for k, d in enumerate(steps) for x in (k, 1.0 / d)))
    leaves = F.when(F.col("n_below") == 1, F.col("size") - F.col("size_below")).otherwise(F.col("size"))
    birth = F.when(F.col("to.level") == len(steps) - 1, F.lit(1.0 / radius)).otherwise(rate[F.col("to.level") + 1])
    stability = F.sum(leaves * (rate[F.col("level")] - birth))
    clusters = parts.groupBy("to").agg(stability.alias("own")).select("to.level", "to.part", "own")
    roots = parts.where("born").select("level", "part", "above")
    from_above = parts.select((F.col("level") - 1).alias("level"), F.col("part").alias("above"), F.col("to").alias("parent"))
    clusters = cut(clusters.join(roots, ["level", "part"]).join(from_above, ["level", "above"], "left").select(F.struct("level", "part").alias("name"), "parent", "own"))
    single = clusters.where("parent IS NULL").limit(2).count() == 1
    if single:
        clusters = clusters.withColumn("own", F.when(F.col("parent").isNull(), F.lit(-1.0)).otherwise(F.col("own")))
    births = sorted(r[0] for r in clusters.select("name.level").distinct().collect())  # of `levels`
    best = None
    for level in births:  # from the bottom: what a cluster's best is, and whether that is itself
        here = clusters.where(F.col("name.level") == level)
        if best is None:
            here = here.withColumn("below", F.lit(0.0))
        else:
            here = here.join(best.groupBy(F.col("parent").alias("name")).agg(F.sum("best").alias("below")), "name", "left").fillna(0.0, ["below"])
        here = here.select("name", "parent", F.greatest("own", "below").alias("best"), (F.col("own") >= F.col("below")).alias("wins"))
        best = cut(here if best is None else best.unionByName(here))
    chosen, lost = None, best.where("parent IS NULL")
    while not lost.isEmpty():  # from the top: the first that wins on each way down
        now = lost.where("wins").select("name")
        chosen = now if chosen is None else chosen.unionByName(now)
        lost = cut(best.join(lost.where("NOT wins").select(F.col("name").alias("parent")), "parent").select(*best.columns))
    if single:
        chosen = chosen.join(clusters.where("parent IS NULL").select("name"), "name", "left_anti")
    found = member.join(chosen.select("name.*").hint("merge"), ["level", "part"]).select("id", F.col("part").alias("cluster"))
    return points.select("id").join(found.hint("merge"), "id", "left")


def density_clusters(df: DataFrame, radius: float, least: int = 5, levels: int = 16, unique: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, core, cluster) of every row with an id: core is null where fewer than `least` others are within `radius`,
    cluster is null for noise."""
    points = cut(usable(df, unique, vector))
    cores = cut(core_distances(points, radius, least))
    dense = points.join(cores.hint("merge"), "id")
    found = stable_clusters(cores, spanning_forest(forest_edges(dense, radius)), radius, least, levels)
    ids = df.where(F.col(unique).isNotNull()).select(F.col(unique).cast("long").alias("id"))
    return ids.join(cores.hint("merge"), "id", "left").join(found.hint("merge"), "id", "left").select("id", "core", "cluster")


def rare_rows(df: DataFrame, clusters: DataFrame, quantile: float = 0.95, unique: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, kind, score): noise and what is far from the mean direction (embedding_outlier: 1 - cosine), and members of
    clusters of at most half the median size (sparse_cluster: 1 / size)."""
    from .vectors import centroids, cosine

    clusters = cut(clusters.select("id", "cluster"))
    mean = centroids(df.withColumn("_all", F.lit(1)), "_all").select("centroid")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(unique).alias("id"), vector).crossJoin(mean)  # one row
    rows = rows.select("id", (1 - cosine(vector, "centroid")).alias("far")).join(clusters, "id")
    sizes = clusters.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    limits = rows.agg(F.percentile_approx("far", quantile, 10_000).alias("limit")).crossJoin(sizes.agg((F.median("size") / 2).alias("small")))
    rows = rows.join(sizes, "cluster", "left").crossJoin(limits)  # one row
    outlier = F.col("cluster").isNull() | (F.col("far") >= F.col("limit"))
    rows = rows.withColumn("kind", F.when(outlier, "embedding_outlier").when(F.col("size") <= F.col("small"), "sparse_cluster"))
    return rows.where("kind IS NOT NULL").select("id", "kind", F.when(outlier, F.col("far")).otherwise(1.0 / F.col("size")).alias("score"))

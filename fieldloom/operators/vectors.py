"""Exact vector work in columns: top-k, neighbours, pairs, centroids; reranking in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import density
from .graph import cut


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def top_k(df: DataFrame, query: list[float], k: int, where: Column | None = None, vector: str = "embedding", unique: str = "vec_id") -> DataFrame:
    """The k most similar; filters come before the ranking, so that they cannot empty it."""
    df = df.where(F.col(vector).isNotNull())
    df = df if where is None else df.where(where)
    found = df.withColumn("similarity", cosine(vector, F.array(*(F.lit(float(x)) for x in query)))).where(F.col("similarity").isNotNull())
    return found.orderBy(F.desc("similarity"), unique).limit(k)


def fused_top_k(df: DataFrame, first: tuple[str, list[float]], second: tuple[str, list[float]], weight: float, k: int, unique: str) -> DataFrame:
    """The k least by weight * d1 + (1 - weight) * d2 over two spaces; both vectors are needed."""
    d = [1 - cosine(c, F.array(*(F.lit(float(x)) for x in q))) for c, q in (first, second)]
    found = df.where(F.col(first[0]).isNotNull() & F.col(second[0]).isNotNull())
    return found.withColumn("distance", weight * d[0] + (1 - weight) * d[1]).orderBy("distance", unique).limit(k)


def similar_pairs(df: DataFrame, least: float, unique: str = "vec_id", vector: str = "embedding", rows: int = 1024) -> DataFrame:
    """(a, b, similarity): all pairs a < b of a cosine of at least `least`. As a cosine bounds the distance of unit
    vectors, only blocks whose balls come that near to each other meet."""
    ready = density.usable(df, unique, vector)
    ready = ready.select("id", F.transform("v", lambda x: x / F.when(norm("v") > 0, norm("v")).otherwise(1.0)).alias("v"))

    def run(batches):
        for (_, a, p), (_, b, q), same in density.met(batches):
            sims = p @ q.T
            r, c = np.nonzero((sims >= least) & ((a[:, None] < b[None, :]) if same else True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[r], b[c])), pa.array(np.maximum(a[r], b[c])), pa.array(sims[r, c])], names=["a", "b", "similarity"])

    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    return density.meetings(ready, radius, rows).mapInArrow(run, "a long, b long, similarity double")


def neighbour_blocks(df: DataFrame, least: float | None, unique: str = "vec_id", vector: str = "embedding", rows: int = 1024, k: int = 1) -> DataFrame:
    """(a, b, similarity): every vector's `k` most similar others (`least` None; equal ones by the smaller id), or all
    pairs a < b of at least `least`.

    For the most similar, a task has some blocks of rows and `density.HELD` blocks at most, and keeps k a row of what meets: what
    is sent grows with the rows, and only the products with their square."""
    if least is not None:
        return similar_pairs(df, least, unique, vector, rows)
    ready = df.where(F.col(vector).isNotNull()).select(unique, F.col(vector).cast("array<double>").alias("v"))
    n = max(1, -(-ready.count() // rows))
    packed = ready.groupBy(F.pmod(F.xxhash64(unique), F.lit(n)).alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col(unique).alias("id"), "v"))).alias("rows"))
    packed = cut(packed.select("block", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("values")))
    sides = [packed.select(*(F.col(c).alias(f"{side}_{c}") for c in packed.columns)) for side in "xy"]
    left, right = sides[0].repartition(min(n, 64), "x_block"), sides[1].repartition(-(-n // density.HELD), "y_block")

    def units(batch, side: str, at: int):
        ids, values = (batch.column(f"{side}_{c}").slice(at, 1).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "values"))
        m = values.astype(float).reshape(len(ids), len(values) // len(ids))
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return ids, m / np.where(size > 0, size, 1)

    def run(batches):
        mine, names = None, ["a", "b", "similarity"]

        def table():
            return pa.RecordBatch.from_arrays([pa.array(a[near[0]]), pa.array(near[1]), pa.array(near[2])], names=names)

        for batch in batches:
            for at, block in enumerate(batch.column("x_block").to_pylist()):
                if block != mine:
                    if mine is not None:
                        yield table()
                    mine, (a, x) = block, units(batch, "x", at)
                    near, bar = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), np.full(len(a), -np.inf)
                b, y = units(batch, "y", at)
                sims = x @ y.T
                sims[a[:, None] == b[None, :]] = -np.inf
                if len(b) > k:  # what is less than k others of this block
                    kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
                    bar = np.fmax(bar, kth)
                r, c = np.nonzero((sims >= bar[:, None]) & np.isfinite(sims))
                r, c, s = (np.concatenate(z) for z in zip(near, (r, b[c], sims[r, c]), strict=True))
                by = np.lexsort((c, -s, r))
                r, c, s = r[by], c[by], s[by]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                near = r[first], c[first], s[first]
        if mine is not None:
            yield table()

    found = left.crossJoin(right).mapInArrow(run, "a long, b long, similarity double")  # of packed blocks
    first = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return found.withColumn("_n", first).where(F.col("_n") <= k).drop("_n")


def centroids(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, centroid, n): the mean vector of each key."""
    at = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("k", "x"))
    means = at.groupBy(key, "k").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"])
    return means.groupBy(key).agg(ordered.alias("centroid"), F.max("n").alias("n"))


def class_outliers(df: DataFrame, key: str, percentile: float = 0.97, floor: float = 0.35, least: int = 5, unique: str = "vec_id") -> DataFrame:
    """Rows farther from their class's centroid than most of it, and than `floor`."""
    far = df.join(centroids(df, key).where(F.col("n") >= least), key).withColumn("distance", 1 - cosine("embedding", "centroid"))
    cut = far.groupBy(key).agg(F.percentile("distance", percentile).alias("cut"))
    return far.join(cut, key).where((F.col("distance") > F.col("cut")) & (F.col("distance") > floor)).select(unique, key, "distance")


def novelty(df: DataFrame, k: int = 5, unique: str = "vec_id") -> DataFrame:
    """1 - the mean of the k highest similarities to others; 0.5 where there is no vector."""
    near = neighbour_blocks(df, None, unique, k=k).groupBy(F.col("a").alias(unique)).agg((1 - F.avg("similarity")).alias("novelty"))
    return df.select(unique).join(near, unique, "left").fillna(0.5, ["novelty"])


def diverse(ranked: DataFrame, group: str, score: Column, k: int, above: float, unique: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(group, unique, pick): in each group, from the highest score down (equal ones by the smaller id), rows that are not
    too similar to one already taken; k at most. Rows without a vector are like no other; unknown scores come last.

    Each of the k steps is one aggregate: of the rows that no pick is too near, the best. A group's picks, k vectors at
    most, go to its rows by a join, so a group of any size stays spread out."""
    rows = ranked.where(F.col(group).isNotNull() & F.col(unique).isNotNull())
    rows = cut(rows.select(F.col(group).alias("_g"), F.col(unique).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), score.cast("double").alias("_s")))
    picks = None
    for step in range(1, k + 1):
        free = rows
        if picks is not None:
            own = picks.groupBy("_g").agg(F.collect_list(F.struct("_id", "_v")).alias("taken"))  # k at most
            near = F.exists("taken", lambda t: (t["_id"] == F.col("_id")) | F.coalesce(cosine(t["_v"], F.col("_v")) > above, F.lit(False)))
            free = rows.join(own, "_g").where(~near).drop("taken")
        best = free.groupBy("_g").agg(F.max_by(F.struct("_id", "_v"), F.struct("_s", -F.col("_id"))).alias("x"))
        now = cut(best.select("_g", "x._id", "x._v", F.lit(step).cast("long").alias("pick")))
        if now.isEmpty():
            break
        picks = now if picks is None else picks.unionByName(now)
    out = picks if picks is not None else rows.select("_g", "_id", "_v", F.lit(0).cast("long").alias("pick")).limit(0)
    return out.select(F.col("_g").alias(group), F.col("_id").alias(unique), "pick")


def farthest_points(df: DataFrame, k: int, unique: str = "vec_id", start: str = "central") -> list[int]:
    """k ids, each the farthest from those before: from the most central by cosine, or the farthest from the mean.

    Each step is one pass over all vectors, with their distances to all chosen so far; only the chosen vectors move.
    """
    from pyspark import StorageLevel

    mean = centroids(df.withColumn("_all", F.lit(1)), "_all").select("centroid").first()
    if mean is None:
        return []
    mean = F.array(*map(F.lit, mean[0]))

    def step(v: Column, u: Column) -> Column:
        return 1 - cosine(v, u) if start == "central" else F.sqrt(F.aggregate(F.zip_with(v, u, lambda x, y: F.pow(x - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))

    first = F.max_by(F.struct(unique, "embedding"), F.struct((dot("embedding", mean) if start == "central" else step(F.col("embedding"), mean)), -F.col(unique)))
    rows = df.where(F.col("embedding").isNotNull()).select(unique, F.col("embedding").cast("array<double>").alias("embedding")).persist(StorageLevel.DISK_ONLY)
    chosen = [rows.agg(first.alias("x")).first()["x"]]
    while len(chosen) < k:
        nearest = F.least(*(step(F.col("embedding"), F.array(*map(F.lit, c["embedding"]))) for c in chosen)) if len(chosen) > 1 else step(F.col("embedding"), F.array(*map(F.lit, chosen[0]["embedding"])))
        found = rows.where(~F.col(unique).isin([c[unique] for c in chosen])).agg(F.max_by(F.struct(unique, "embedding"), F.struct(nearest, -F.col(unique))).alias("x")).first()["x"]
        if found is None:
            break
        chosen.append(found)
    rows.unpersist()
    return [c[unique] for c in chosen]

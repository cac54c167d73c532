"""Searching and curating: reranked neighbours, hybrid search, groups of near copies, suspect labels.

A search over one query ranks a pool of bounded size (a multiple of what is asked for), so what follows the top-k runs on
few rows. Groups of near copies and suspect labels run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, vectors
from .labels import hamming_pairs

# How far above k a pool is fetched, its bound, similarity of copies, weight of rarity and its pool.
OVER_FETCH, MOST, COPIES = 6, 600, 0.96
RARITY, RARITY_POOL = 0.25, 6
#: Bits and cosine of near copies, similarity of frames that should hold the same classes.
COPY_BITS, COPY_COSINE = 6, 0.95


def reranked(df: DataFrame, query: list[float], k: int, least: float = 0.0, where: Column | None = None, not_track: Column | None = None, copies: float | None = COPIES, unique: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(unique, similarity, rank): of the nearest `k` times OVER_FETCH, those of at least `least` that are not of the
    query's own track (`not_track` is true for it), from the nearest down, none too near to one already taken."""
    pool = vectors.top_k(df, query, min(MOST, k * OVER_FETCH), where, vector, unique).where(F.col("similarity") >= least)
    pool = pool if not_track is None else pool.where(~F.coalesce(not_track, F.lit(False)))
    pool = graph.cut(pool.withColumn("_one", F.lit(0)))
    if copies is None:
        order = Window.partitionBy("_one").orderBy(F.desc("similarity"), unique)  # the pool, MOST at most
        return pool.select(unique, "similarity", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= k)
    picked = vectors.diverse(pool, "_one", F.col("similarity"), k, copies, unique, vector)
    return pool.join(picked, unique).select(unique, "similarity", F.col("pick").alias("rank"))


def rarities(objects: DataFrame, frame: str, cls: str) -> DataFrame:
    """(frame, rarity): that of the rarest class on it, ln(frames / frames with the class) as a share of ln(frames)."""
    n = objects.select(frame).distinct().agg(F.count(F.lit(1)).alias("_n"))
    held = objects.where(F.col(cls).isNotNull()).select(frame, cls).distinct()
    idf = held.groupBy(cls).agg(F.count(F.lit(1)).alias("_df")).crossJoin(n)  # one row
    idf = idf.select(cls, F.when(F.col("_n") > 1, F.log(F.col("_n") / F.col("_df")) / F.log("_n")).otherwise(0.0).alias("_idf"))
    return held.join(idf, cls).groupBy(frame).agg(F.max("_idf").alias("rarity"))


def hybrid(df: DataFrame, query: list[float], k: int, parsed: Column | None, rare: DataFrame | None = None, weight: float = RARITY, unique: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, bool]:
    """((unique, semantic, rarity, score, rank), whether it was filtered): the nearest under a parsed condition, blended with rarity.

    A condition that leaves fewer than `k` rows ranks nothing away: the search then runs over all. Rarity reorders a pool of
    RARITY_POOL times k; rows without one have 0."""
    ready = df.where(F.col(vector).isNotNull())
    filtered = parsed is not None and ready.where(parsed).limit(k).count() == k
    pool = vectors.top_k(ready, query, min(MOST, k * RARITY_POOL) if rare is not None and weight > 0 else k, parsed if filtered else None, vector, unique)
    pool = pool.select(unique, F.col("similarity").alias("semantic"))
    pool = pool.join(rare, unique, "left").fillna(0.0, ["rarity"]) if rare is not None else pool.withColumn("rarity", F.lit(0.0))
    score = (1 - weight) * F.col("semantic") + weight * F.col("rarity") if rare is not None and weight > 0 else F.col("semantic")
    best = pool.withColumn("score", score).orderBy(F.desc("score"), unique).limit(k)
    order = Window.orderBy(F.desc("score"), unique)  # k rows
    return best.withColumn("rank", F.row_number().over(order)), filtered


def copy_groups(df: DataFrame, unique: str, bits: str, vector: str, quality: str, most: int = COPY_BITS, cosine: float = COPY_COSINE) -> DataFrame:
    """(unique, group, canonical, score) of rows in groups of near copies: hashes differ in few bits and vectors confirm it.

    Groups are connected; each is named by its smallest id, its best row by quality (then the smaller id) stands for it,
    and the others' scores are their cosines with that one. Rows without a hash or a vector are in no group."""
    rows = df.where(F.col(bits).isNotNull() & F.col(vector).isNotNull() & F.col(unique).isNotNull()).select(unique, bits, vector, F.coalesce(quality, F.lit(0.0)).alias("_q"))
    pairs = hamming_pairs(rows, unique, bits, most)
    side = lambda n: rows.select(F.col(unique).alias(n), F.col(vector).alias(f"_{n}"))
    sure = pairs.join(side("a"), "a").join(side("b"), "b").where(vectors.cosine("_a", "_b") >= cosine).select("a", "b")
    groups = graph.components(sure).select(F.col("id").alias(unique), F.col("label").alias("group"))
    members = graph.cut(rows.join(groups, unique))
    best = members.groupBy("group").agg(F.max_by(F.struct(F.col(unique).alias("_best"), F.col(vector).alias("_v")), F.struct("_q", -F.col(unique))).alias("x")).select("group", "x.*")
    own = F.col(unique) == F.col("_best")
    return members.join(best, "group").select(unique, "group", own.alias("canonical"), F.when(own, 1.0).otherwise(vectors.cosine(vector, "_v")).alias("score"))


def suspicion(value: Column) -> Column:
    """On [0, 1], to six places; unknown is 0."""
    v = F.when(F.isnan(value), None).otherwise(value)
    return F.round(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), F.lit(0.0)), 6)


def group_conflicts(objects: DataFrame, unique: str, group: str, cls: str, least: int = 3) -> DataFrame:
    """(unique, group, given, proposed, score, n): members of a track or rig identity whose class is not its majority's.

    Of equally frequent classes the smaller is the majority. Groups of fewer than `least` members tell nothing."""
    known = objects.where(F.col(group).isNotNull() & F.col(cls).isNotNull())
    counts = known.groupBy(group, cls).agg(F.count(F.lit(1)).alias("_k"))
    major = counts.groupBy(group).agg(F.sum("_k").alias("n"), F.max("_k").alias("top")).where((F.col("n") >= least) & (F.col("top") < F.col("n")))
    first = counts.join(major, group).where("_k = top").groupBy(group).agg(F.min(cls).alias("proposed"), F.max("n").alias("n"), F.max("top").alias("top"))
    found = known.join(first, group).where(F.col(cls) != F.col("proposed"))
    return found.select(unique, group, F.col(cls).alias("given"), "proposed", suspicion(F.col("top") / F.col("n")).alias("score"), "n")


def frame_conflicts(objects: DataFrame, near: DataFrame, unique: str, frame: str, cls: str, conf: str, least: float = COPIES) -> DataFrame:
    """(unique, frame, other, class, score): objects of a class that the frame's nearest other frame, if it is that near,
    does not have at all. `near`: a, b, similarity, one row for each frame. Frames whose neighbour has no object tell nothing.
    What is doubted more the less confident the object is (unknown: not at all), and the more alike the frames are above
    the bound."""
    pairs = near.where(F.col("similarity") >= least).select(F.col("a").alias(frame), F.col("b").alias("other"), ((F.col("similarity") - least) / max(1e-6, 1 - least)).alias("margin"))
    held = objects.where(F.col(cls).isNotNull()).select(F.col(frame).alias("other"), F.col(cls).alias("_c")).distinct()
    pairs = pairs.join(held.select("other").distinct(), "other", "left_semi")
    mine = objects.where(F.col(cls).isNotNull()).select(unique, frame, F.col(cls).alias("class"), F.coalesce(conf, F.lit(0.0)).alias("_conf")).join(pairs, frame)
    found = mine.join(held, (mine["other"] == held["other"]) & (mine["class"] == held["_c"]), "left_anti")
    return found.select(unique, frame, "other", "class", suspicion((1 - F.least(F.greatest("_conf", F.lit(0.0)), F.lit(1.0))) * (0.5 + 0.5 * F.col("margin"))).alias("score"))

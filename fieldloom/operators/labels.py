"""Working with labels: candidate scores, budgets, consensus, suppression, recovery, quality."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def label_quality(conf: Column, geometry_ok: Column, rig_ok: Column, agreed: Column, state: Column, human: Column) -> Column:
    """Confidence, lowered by each doubt; rejected labels at most .20, labels a person accepted at least .75."""
    score = conf * F.when(geometry_ok, 1.0).otherwise(0.7) * F.when(rig_ok, 1.0).otherwise(0.6) * F.when(agreed, 1.0).otherwise(0.92)
    score = F.when(state == "rejected", F.least(score, F.lit(0.20))).when((state == "accepted") & human, F.greatest(score, F.lit(0.75))).otherwise(score)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def soft_target(uncertainty: Column, floor: float = 0.5) -> Column:
    return F.greatest(F.lit(floor), 1 - uncertainty)


def consensus(boxes: DataFrame, frame: str, path: str, least: float = 0.5, agree: int = 3) -> DataFrame:
    """(frame, id, n_agree, score, accepted): boxes of one class that overlap across paths, itself counted.

    Boxes meet within their frame only. Score: the confidence of those that agree over that of the frame. Ids are unique
    in a frame; boxes with a null frame, id or class don't agree with any. Equal boxes of a path meet others once, with
    their summed confidence, so a frame's pairs are of its different boxes.
    """
    spot = [frame, "cls", path, "x1", "y1", "x2", "y2"]
    own = boxes.where(F.col(frame).isNotNull() & F.col("id").isNotNull() & F.col("cls").isNotNull())
    spots = own.groupBy(*spot).agg(F.sum("conf").alias("conf"))
    a, b = spots.alias("a"), spots.alias("b")
    box = lambda s: F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
    near = (F.col(f"a.{path}") != F.col(f"b.{path}")) & (G.iou(box("a"), box("b")) >= least)
    pairs = a.join(b, (F.col(f"a.{frame}") == F.col(f"b.{frame}")) & (F.col("a.cls") == F.col("b.cls")) & near)
    others = pairs.groupBy(*(F.col(f"a.{c}").alias(f"_{c}") for c in spot)).agg(F.count_distinct(F.col(f"b.{path}")).alias("paths"), F.sum("b.conf").alias("others"))
    found = own.join(others, [own[c] == F.col(f"_{c}") for c in spot], "left")  # a spot with a null has no others
    total = boxes.groupBy(frame).agg(F.sum("conf").alias("total"))
    mine = F.when(F.col("conf").isNull(), F.col("others")).otherwise(F.col("conf") + F.coalesce("others", F.lit(0.0)))
    n_agree = F.when(F.col(path).isNull(), 0).otherwise(1) + F.coalesce("paths", F.lit(0).cast("long"))
    found = found.select(frame, "id", n_agree.cast("long").alias("n_agree"), mine.alias("mine")).join(total, frame)
    return found.select(frame, "id", "n_agree", F.when(F.col("total") > 0, F.col("mine") / F.col("total")).alias("score"), (F.col("n_agree") >= agree).alias("accepted"))


def suppress(boxes: DataFrame, frame: str, least: float = 0.5, by_class: bool = True) -> DataFrame:
    """Greedy non-maximum suppression within each frame, from the most confident down; of equals the smaller id."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["conf", "id"], ascending=[False, True])
        box, cls = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["cls"].to_numpy()
        size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        left, kept = np.ones(len(rows), bool), []
        for i in range(len(rows)):
            if not left[i]:
                continue
            kept.append(i)
            w = np.minimum(box[:, 2], box[i, 2]) - np.maximum(box[:, 0], box[i, 0])
            h = np.minimum(box[:, 3], box[i, 3]) - np.maximum(box[:, 1], box[i, 1])
            both = np.clip(w, 0, None) * np.clip(h, 0, None)
            union = size + size[i] - both
            over = np.where(union > 0, both / np.where(union > 0, union, 1), 0) > least
            left &= ~(over & ((cls == cls[i]) | (not by_class)))
        return rows.iloc[kept]

    return boxes.groupBy(frame).applyInPandas(run, boxes.schema)


def unmatched(proposals: DataFrame, existing: DataFrame, frame: str, most: float = 0.45) -> DataFrame:
    """Proposals that overlap no existing box of their frame that much."""
    p, e = proposals.alias("p"), existing.alias("e")
    box = lambda s: F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
    return p.join(e, (F.col(f"p.{frame}") == F.col(f"e.{frame}")) & (G.iou(box("p"), box("e")) >= most), "left_anti")


def missed_frames(df: DataFrame, accept: float = 0.7) -> DataFrame:
    """(…, score) from sparsity, conf, gap (frames an object was lost for, or null) and novelty in [0, 1]."""
    residue = F.when(F.col("conf") < accept, 1 - (accept - F.col("conf")) / accept).otherwise(0.0)
    lost = F.when(F.col("gap").between(1, 5), F.least(F.lit(1.0), 1 / F.col("gap"))).otherwise(0.0)
    return df.withColumn("score", 0.30 * F.col("sparsity") + 0.20 * residue + 0.35 * lost + 0.15 * F.col("novelty"))


def repair_plan(df: DataFrame, track: str, label: str, order: str, share: float = 0.8, least: int = 3) -> DataFrame:
    """(track, majority, share, n): tracks long and sure enough whose other members could take the majority's label."""
    counts = df.groupBy(track, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max_by(label, F.struct("n", -F.col("first")))
    plan = counts.groupBy(track).agg(best.alias("majority"), (F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    return plan.where((F.col("share") >= share) & (F.col("n") >= least) & (F.col("labels") > 1)).drop("labels")


def confusion_pairs(df: DataFrame, before: str, after: str, least: int) -> DataFrame:
    """Unordered pairs of labels that reviews changed into each other: (a, b, forward, reverse, n)."""
    changed = df.where(F.col(before) != F.col(after)).select(F.least(before, after).alias("a"), F.greatest(before, after).alias("b"), (F.col(before) < F.col(after)).alias("up"))
    found = changed.groupBy("a", "b").agg(F.count(F.when(F.col("up"), 1)).alias("forward"), F.count(F.when(~F.col("up"), 1)).alias("reverse"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least)


def blocked_queue(items: DataFrame, blocked: DataFrame, key: str, score: str, unique: str, limit: int) -> DataFrame:
    return items.join(blocked, key, "left_anti").orderBy(F.desc(score), unique).limit(limit)


def drop_rate(df: DataFrame, key: str, number: str) -> DataFrame:
    """(key, expected, received, rate, longest): how much of a numbered stream is missing."""
    seen = df.select(key, number).distinct()
    gap = F.lead(number).over(Window.partitionBy(key).orderBy(number)) - F.col(number) - 1
    out = seen.withColumn("gap", gap).groupBy(key).agg((F.max(number) - F.min(number) + 1).alias("expected"), F.count(F.lit(1)).alias("received"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest"))
    return out.withColumn("rate", 1 - F.col("received") / F.col("expected"))


# Scores of a session from which it passes, and below which it is set aside.
PASS_MIN, QUARANTINE_BELOW = 85.0, 55.0


def health(checks: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(key, score, decision, n_failed) from (key, check, weight, level): 100 times the weighed mean of levels, to a tenth.

    A check at level 0 has failed and sets the session aside, whatever the score; so does no weight at all. Levels are
    added by `order` (or from the least weighed one up): a sum of doubles depends on that, and near half a tenth so does
    the score. A key has few checks."""
    total = F.sum("weight")
    term = (F.col("weight") * F.col("level")).alias("term")
    terms = F.transform(F.array_sort(F.collect_list(F.struct(*([order] if order else []), term))), lambda x: F.coalesce(x["term"], F.lit(0.0)))
    score = F.when(total > 0, F.round(100 * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / total, 1)).otherwise(0.0)
    out = checks.groupBy(key).agg(score.alias("score"), F.count(F.when(F.col("level") <= 0, 1)).alias("n_failed"))
    decision = F.when((F.col("n_failed") > 0) | (F.col("score") < QUARANTINE_BELOW), "quarantine").when(F.col("score") >= PASS_MIN, "pass").otherwise("degraded")
    return out.select(key, "score", decision.alias("decision"), "n_failed")


def voxels(points: DataFrame, size: float) -> DataFrame:
    """(vx, vy, vz, n, x, y, z): points averaged in cubes."""
    cell = [F.floor(F.col(c) / size).alias(f"v{c}") for c in "xyz"]
    return points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in "xyz"))


def drawn(h: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """A uniform number in [0, 1) for each round and row, from the row's 64-bit hash alone."""
    k = (np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[:, None]
    x = h.astype(np.int64).view(np.uint64)[None, :] + k
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def resampled(df: DataFrame, value: str, unique: str, rounds: int, seed: int, times) -> DataFrame:
    """(round, total, n): sums over the rows that have a value, each counted as often as `times` says of its draw."""

    def run(batches):
        total, n = np.zeros(rounds), np.zeros(rounds)
        for b in batches:
            x, h = b["v"].to_numpy(float), b["h"].to_numpy()
            for a in range(0, len(x), 4096):
                w = times(drawn(h[a : a + 4096], rounds, seed))
                total += w @ x[a : a + 4096]
                n += w.sum(axis=1)
        yield pd.DataFrame({"round": np.arange(rounds), "total": total, "n": n})

    rows = df.select(F.col(value).cast("double").alias("v"), F.xxhash64(unique).alias("h")).where("v IS NOT NULL AND NOT isnan(v)")
    return rows.mapInPandas(run, "round int, total double, n double").groupBy("round").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def bootstrap(df: DataFrame, value: str, unique: str, rounds: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """One row (mean, lo, hi): a row counts a Poisson(1) number of times in each round, drawn from the hash of its id, so
    the rounds are one pass over the data and the same at any partitioning. Nulls without values."""
    steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(20)])
    sums = resampled(df, value, unique, rounds, seed, lambda u: np.searchsorted(steps, u).astype(float))
    means = sums.select((F.col("total") / F.nullif("n", F.lit(0.0))).alias("m"))
    ends = means.agg(F.percentile("m", alpha / 2).alias("lo"), F.percentile("m", 1 - alpha / 2).alias("hi"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(ends)  # a row each


def paired_test(df: DataFrame, champion: str, challenger: str, unique: str, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """One row (n, delta, p_value, direction, significant): whether the challenger is better on the same objects.

    Under chance alone the sign of each difference might as well be the other; `p_value` is how often rounds of random
    signs, drawn from hashes of the ids, part the means at least as far. Significant is only what is better at 0.05.
    Objects that one side has no score of take no part."""
    diffs = df.select(unique, (F.col(challenger) - F.col(champion)).cast("double").alias("_d")).where("_d IS NOT NULL AND NOT isnan(_d)")
    seen = diffs.agg(F.count(F.lit(1)).alias("n"), F.sum("_d").alias("total"))
    sums = resampled(diffs, "_d", unique, rounds, seed, lambda u: np.where(u < 0.5, 1.0, -1.0))
    far = F.abs(F.col("sums.total")) >= F.abs(F.col("seen.total")) - 1e-12 * F.abs(F.col("seen.total"))
    p = sums.alias("sums").crossJoin(F.broadcast(seen).alias("seen")).agg(F.count(F.when(far, 1)).alias("k"), F.coalesce(F.max("seen.n"), F.lit(0)).alias("n"), F.max("seen.total").alias("total"))
    delta = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    p_value = F.when(F.col("n") > 0, (F.col("k") + 1) / (rounds + 1))
    direction = F.when(delta > 0, "better").when(delta < 0, "worse").when(delta == 0, "same")
    return p.select(F.col("n"), delta.alias("delta"), p_value.alias("p_value"), direction.alias("direction"), F.coalesce((p_value < 0.05) & (delta > 0), F.lit(False)).alias("significant"))


def projection_drift(df: DataFrame, current: Column, vector: str = "embedding", axes: int = 32, bins: int = 10, seed: int = 0, eps: float = 1e-6) -> DataFrame:
    """(axis, psi): the stability index of the rows where `current` is true against the others, along random directions
    through all dimensions (each component with a sign, from a hash of seed, axis and place), in bins at the reference's
    quantiles.

    One fixed coordinate is blind to all others; of many random directions some see any shift. Rows with a null vector or
    an odd component take no part; vectors of one table have one length."""
    rows = df.where(F.col(vector).isNotNull()).select(F.coalesce(current, F.lit(False)).alias("now"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))

    def run(batches):
        ways = None
        for b in batches:
            if not len(b):
                continue
            v = np.stack(b["v"].to_numpy())
            if ways is None:
                ways = np.array([[1.0 if hashlib.md5(f"{seed}:{k}:{j}".encode()).hexdigest() < "8" else -1.0 for j in range(v.shape[1])] for k in range(axes)])
            at = v @ ways.T / np.sqrt(v.shape[1])
            yield pd.DataFrame({"now": b["now"], "at": list(at)})

    placed = rows.mapInPandas(run, "now boolean, at array<double>").select("now", F.posexplode("at").alias("axis", "x"))
    placed = placed.withColumn("x", F.round("x", 9))
    edges = placed.where("NOT now").groupBy("axis").agg(F.percentile_approx("x", [k / bins for k in range(1, bins)], 10_000).alias("edges"))
    binned = placed.join(F.broadcast(edges), "axis").withColumn("bin", F.size(F.array_distinct(F.filter("edges", lambda c: c < F.col("x")))))
    counts = binned.groupBy("axis", "bin").agg(F.count(F.when(~F.col("now"), 1)).alias("r"), F.count(F.when(F.col("now"), 1)).alias("c"))
    w = Window.partitionBy("axis")  # `bins` rows
    share = counts.select("axis", *((F.col(k) / F.nullif(F.sum(k).over(w), F.lit(0)) + eps).alias(k) for k in "rc"))
    return share.groupBy("axis").agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))


def hamming_pairs(df: DataFrame, unique: str, bits: str, most: int = 6) -> DataFrame:
    """(a, b, distance) of 64-bit hashes that differ in few bits: cut in most + 1 bands, a near pair has one in common."""
    n, out = most + 1, []
    for k in range(n):
        low, high = 64 * k // n, 64 * (k + 1) // n
        mask = ((1 << (high - low)) - 1) << low
        out.append(F.struct(F.lit(k).alias("k"), F.col(bits).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("part")))
    dealt = df.select(unique, bits, F.explode(F.array(*out)).alias("band")).select(unique, bits, "band.*")
    a, b = dealt.alias("a"), dealt.alias("b")
    far = F.bit_count(F.col(f"a.{bits}").bitwiseXOR(F.col(f"b.{bits}")))
    found = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.part") == F.col("b.part")) & (F.col(f"a.{unique}") < F.col(f"b.{unique}")) & (far <= most))
    return found.select(F.col(f"a.{unique}").alias("a"), F.col(f"b.{unique}").alias("b"), far.alias("distance")).distinct()


def grid(space: dict[str, list], spark) -> DataFrame:
    """All combinations of a parameter grid, numbered."""
    df = spark.range(1).drop("id")
    for name, values in space.items():
        df = df.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return df.withColumn("trial", F.row_number().over(Window.orderBy(*space)))


def varied(runs: DataFrame, key: str, params: str) -> DataFrame:
    """(name, values): parameters (a map column) that differ between runs."""
    flat = runs.select(key, F.explode(params).alias("name", "value"))
    return flat.groupBy("name").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)

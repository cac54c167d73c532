"""Detections and tracks against ground truth, from boxes.

Boxes are rows id, key (their frame), x1, y1, x2, y2, cls; predictions have a score. Frames of up to `FRAME` boxes a side
are joined as they are. In others, pairs come from an equi join on cells of a grid: a box lies in at most four cells of
the level its longer side calls for, and as boxes of an IoU of at least `least` have sides within that ratio, truth is
dealt to the levels near its own. A pair is kept in the one cell that holds the corner where its intersection begins.

Matching is greedy in a total order of the pairs. Frames of up to `PAIRS` pairs are matched one by one as a task reads
them. Those of others run in rounds: a pair that is first for both its sides is what the greedy would take, whatever
else happens. No larger frame is ever one group.

Boxes without an extent, with a null id, key or corner overlap nothing; they count as false positives or misses. Ids are
unique within a side. What can't be measured is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graph import cut

#: The IoU thresholds of AP@[.5:.95].
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
#: Boxes of a side, and pairs, up to which a frame is one piece of work.
FRAME, PAIRS = 256, 50_000


def overlaps(predicted: DataFrame, truth: DataFrame, least: float, cell: float = 64.0) -> DataFrame:
    """(key, p_id, g_id, score, p_cls, g_cls, iou) of all pairs of one key with at least that IoU (above 0)."""
    usable = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & F.col("id").isNotNull() & F.col("key").isNotNull()
    columns = ("key", "id", "cls", "x1", "y1", "x2", "y2")
    p, g = predicted.where(usable).select(*columns, "score"), truth.where(usable).select(*columns)
    crowded = [df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FRAME).select("key") for df in (p, g)]
    crowded = cut(crowded[0].union(crowded[1]).distinct())
    if crowded.isEmpty():
        return overlaps_of_frames(p, g, least)
    few = [df.join(crowded, "key", "left_anti") for df in (p, g)]
    return overlaps_of_frames(*few, least).unionByName(overlaps_by_cells(*(df.join(crowded, "key") for df in (p, g)), least, cell))


def overlaps_of_frames(p: DataFrame, g: DataFrame, least: float) -> DataFrame:
    """The pairs of frames of few boxes."""
    sides = [df.select("key", *(F.col(c).alias(f"{prefix}_{c}") for c in ("id", "cls", "x1", "y1", "x2", "y2")), *more) for df, prefix, more in ((p, "p", ["score"]), (g, "g", []))]
    meet = [(F.col(f"p_{c}1") < F.col(f"g_{c}2")) & (F.col(f"g_{c}1") < F.col(f"p_{c}2")) for c in "xy"]
    both = sides[0].join(sides[1], "key").where(meet[0] & meet[1])
    boxes = [F.struct(*(F.col(f"{prefix}_{c}").alias(c) for c in ("x1", "y1", "x2", "y2"))) for prefix in "pg"]
    both = both.withColumn("iou", G.iou(*boxes))
    return both.where((F.col("iou") >= least) & (F.col("iou") > 0)).select("key", "p_id", "g_id", "score", "p_cls", "g_cls", "iou")


def overlaps_by_cells(predicted: DataFrame, truth: DataFrame, least: float, cell: float) -> DataFrame:
    """The pairs of frames of any number of boxes, from the cells that these share."""
    box = F.struct("x1", "y1", "x2", "y2")
    longest = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    level = F.ceil(F.log2(F.greatest(longest / cell, F.lit(1.0)))).cast("int")
    size = lambda at: cell * F.pow(F.lit(2.0), at)
    place = lambda v, at: F.floor(v / size(at)).cast("long")

    def side(df: DataFrame, prefix: str, *more: str) -> DataFrame:
        return df.select("key", F.col("id").alias(f"{prefix}_id"), F.col("cls").alias(f"{prefix}_cls"), *more, box.alias(prefix), level.alias("level"))

    def dealt(df: DataFrame, prefix: str) -> DataFrame:
        at = F.col("level")
        df = df.withColumn("i", F.explode(F.sequence(place(F.col(f"{prefix}.x1"), at), place(F.col(f"{prefix}.x2"), at))))
        return df.withColumn("j", F.explode(F.sequence(place(F.col(f"{prefix}.y1"), at), place(F.col(f"{prefix}.y2"), at))))

    apart = math.ceil(math.log2(1 / least) - 1e-9)  # levels between boxes of that IoU
    p = dealt(side(predicted, "p", "score"), "p")
    near = F.sequence(F.greatest(F.col("level") - apart, F.lit(0)), F.col("level") + apart)
    g = dealt(side(truth, "g").withColumn("level", F.explode(near)), "g")
    both = p.join(g, ["key", "level", "i", "j"])
    at = F.col("level")
    first = (F.col("i") == place(F.greatest("p.x1", "g.x1"), at)) & (F.col("j") == place(F.greatest("p.y1", "g.y1"), at))
    both = both.where(first).withColumn("iou", G.iou(F.col("p"), F.col("g")))
    return both.where((F.col("iou") >= least) & (F.col("iou") > 0)).select("key", "p_id", "g_id", "score", "p_cls", "g_cls", "iou")


def assign(pairs: DataFrame, within: list[str], a: str, b: str, order: list[Column]) -> DataFrame:
    """The pairs that a greedy pass in that order takes, one for each `a` and `b` within each group at most.

    A pair taken in a round is first among all that are left of its `a` and of its `b`; those that share a side with it
    then go. `order` must be total. Rounds follow the longest chain of pairs each waiting for the one before."""
    left, taken = cut(pairs), None
    while not left.isEmpty():
        w = [Window.partitionBy(*within, c) for c in (a, b)]
        ranked = left.withColumn("_a", F.row_number().over(w[0].orderBy(*order))).withColumn("_b", F.row_number().over(w[1].orderBy(*order)))
        ranked = ranked.withColumn("_take", (F.col("_a") == 1) & (F.col("_b") == 1))
        gone = F.max("_take")
        ranked = cut(ranked.withColumn("_gone", gone.over(w[1])).withColumn("_gone", F.col("_gone") | gone.over(w[0])))
        now = ranked.where("_take").select(*pairs.columns)
        taken = now if taken is None else taken.unionByName(now)
        left = ranked.where(~F.col("_gone")).select(*pairs.columns)
    return pairs.limit(0) if taken is None else taken


def by_score() -> list[Column]:
    """Predictions by falling score, each with its best box first; equal ones by id."""
    return [F.desc("score"), F.asc("p_id"), F.desc("iou"), F.asc("g_id")]


def frames_matched(pairs: DataFrame, thresholds, same_class: bool, by_iou: bool) -> DataFrame:
    """`pairs` with `reached` (bit k: matched at the k-th threshold) and `open` (of a frame too large for this, not matched yet).

    Rows of a frame follow each other and know their number. A pair that shares no side with another is matched as far as
    its IoU goes; the rest are walked in order for each threshold."""
    most, limits = PAIRS, np.array(thresholds, float)

    def walk(table: pa.Table) -> np.ndarray:
        iou = table["iou"].to_numpy()
        reached = (1 << np.searchsorted(limits, iou, "right")) - 1
        if same_class:
            reached = np.where(pc.fill_null(pc.equal(table["p_cls"], table["g_cls"]), False).to_numpy(), reached, 0)
        rows = np.flatnonzero(reached)
        sides = [np.unique(table[c].to_numpy(zero_copy_only=False)[rows], return_inverse=True, return_counts=True)[1:] for c in ("p_id", "g_id")]
        (p, n_p), (g, n_g) = sides
        many = np.flatnonzero((n_p[p] > 1) | (n_g[g] > 1))
        order = [g[many], -iou[rows[many]], p[many]] if not by_iou else [g[many], p[many], -iou[rows[many]]]
        if not by_iou:  # not a number comes before all numbers, null after them
            score = pc.cast(table["score"], pa.float64())
            raw = -score.to_numpy()[rows[many]]
            order += [np.nan_to_num(raw, nan=0.0, posinf=np.inf, neginf=-np.inf), ~np.isnan(raw), pc.is_null(score).to_numpy()[rows[many]]]
        many = many[np.lexsort(order)]
        can, found = reached[rows[many]].tolist(), np.zeros(len(many), np.int64)
        for k in range(len(limits)):
            of_p, of_g = set(), set()
            for i, (x, y, c) in enumerate(zip(p[many].tolist(), g[many].tolist(), can, strict=True)):
                if c >> k & 1 and x not in of_p and y not in of_g:
                    of_p.add(x)
                    of_g.add(y)
                    found[i] |= 1 << k
        reached[rows[many]] = found
        return reached

    def out(table: pa.Table, reached: np.ndarray, open_: bool):
        table = table.drop_columns(["n"]).append_column("reached", pa.array(reached.astype(np.int64))).append_column("open", pa.array(np.full(len(reached), open_)))
        yield from table.filter(pa.array((reached > 0) | open_)).to_batches()

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            large = pc.greater(table["n"], most)
            crowd, table = table.filter(large), table.filter(pc.invert(large))
            yield from out(crowd, np.zeros(len(crowd), np.int64), True)
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            rest = None
            if len(table):
                keys = table["key"].to_numpy(zero_copy_only=False)
                changes = np.flatnonzero(keys[1:] != keys[:-1])
                last = int(changes[-1]) + 1 if len(changes) else 0
                if len(table) - last < table["n"][len(table) - 1].as_py():  # the last frame goes on in the next batch
                    rest, table = table.slice(last), table.slice(0, last)
                if len(table):
                    yield from out(table, walk(table), False)

    counted = pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return cut(counted.mapInArrow(run, f"{schema}, reached long, open boolean"))


def matched(pairs: DataFrame, thresholds=THRESHOLDS, same_class: bool = True, by_iou: bool = False) -> DataFrame:
    """The pairs matched at any threshold, with `reached`: bit k is set if it is at the k-th. Greedy by score (see
    `by_score`), or by falling IoU, then by p_id and g_id. Thresholds ascend."""
    found = frames_matched(pairs, thresholds, same_class, by_iou)
    done, left = found.where("NOT open").select(*pairs.columns, "reached"), found.where("open").select(*pairs.columns)
    if left.isEmpty():
        return done
    left = left.where("p_cls = g_cls") if same_class else left
    left = left.withColumn("k", F.explode(F.array(*(F.when(F.col("iou") >= t, k) for k, t in enumerate(thresholds))))).where("k IS NOT NULL")
    taken = assign(left, ["k"], "p_id", "g_id", [F.desc("iou"), F.asc("p_id"), F.asc("g_id")] if by_iou else by_score())
    bits = F.sum(F.expr("shiftleft(1L, k)")).alias("reached")
    return done.unionByName(taken.groupBy(*pairs.columns).agg(bits).select(*pairs.columns, "reached"))


def matches(pairs: DataFrame, thresholds=THRESHOLDS, same_class: bool = True) -> DataFrame:
    """`pairs` with the thresholds at which each is matched, a row for each."""
    at = F.array(*(F.when(F.expr(f"getbit(reached, {k})") == 1, F.lit(float(t))) for k, t in enumerate(thresholds)))
    return matched(pairs, thresholds, same_class).withColumn("threshold", F.explode(F.array_compact(at))).drop("reached")


def outcomes(predicted: DataFrame, truth: DataFrame, pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(key, p_id, g_id, p_cls, g_cls, score, iou, outcome): a row for each prediction, tp where it is matched to a box of
    its class, else fp, and one for each box that none is matched to, fn. Matches may cross classes."""
    found = matched(pairs, (threshold,), same_class=False).select("p_id", "g_id", "g_cls", "iou")
    rows = predicted.select("key", F.col("id").alias("p_id"), F.col("cls").alias("p_cls"), "score").join(found, "p_id", "left")
    rows = rows.withColumn("outcome", F.when(F.col("g_cls") == F.col("p_cls"), "tp").otherwise("fp"))
    missed = truth.join(found.select(F.col("g_id").alias("id")), "id", "left_anti")
    missed = missed.select("key", F.col("id").alias("g_id"), F.col("cls").alias("g_cls"), F.lit("fn").alias("outcome"))
    return rows.unionByName(missed, allowMissingColumns=True).select("key", "p_id", "g_id", "p_cls", "g_cls", "score", "iou", "outcome")


def average_precisions(predicted: DataFrame, truth: DataFrame, found: DataFrame, thresholds=THRESHOLDS, parts: int = 1024) -> DataFrame:
    """(cls, threshold, n_truth, n_predicted, ap) of the classes with ground truth: 101-point interpolated, 0 without predictions.
    `found` is of `matched` or `matches`.

    A rank is the ranks of all better parts of the scores' range, by sums of a row for each part, and the rank within
    the part, so a class is never one window. The best precision at or beyond a recall point is a maximum by the
    point that a prediction reaches, then over the points after it."""
    part = F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * parts).cast("int")
    if "reached" not in found.columns:
        found = found.withColumn("reached", sum((F.when(F.col("threshold") == t, 1 << k).otherwise(0) for k, t in enumerate(thresholds)), F.lit(0)))
    hits = found.groupBy(F.col("p_id").alias("id")).agg(F.bit_or("reached").cast("long").alias("hits"))
    rows = predicted.select("id", "cls", "score", part.alias("part")).join(hits, "id", "left")
    rows = rows.withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    hit = [F.expr(f"getbit(hits, {k})").cast("long") for k in range(len(thresholds))]
    sums = [F.sum(x).alias(f"h{k}") for k, x in enumerate(hit)]
    before = Window.partitionBy("cls").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n"), *sums)
    totals = totals.select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.array(*(F.coalesce(F.sum(f"h{k}").over(before), F.lit(0)) for k in range(len(thresholds)))).alias("hits_before"))
    w = Window.partitionBy("cls", "part").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.array(*(F.sum(x).over(w) for x in hit))
    rows = rows.withColumns({"rank": F.count(F.lit(1)).over(w), "inside": inside}).join(totals, ["cls", "part"])
    boxes = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("n_truth"))
    rows = rows.join(boxes, "cls").select("cls", "n_truth", (F.col("rank") + F.col("n_before")).alias("rank"), F.posexplode(F.zip_with("inside", "hits_before", lambda x, y: x + y)).alias("k", "hits"))
    point = F.floor(100 * F.col("hits") / F.col("n_truth") + 1e-9).cast("int")
    best = rows.groupBy("cls", "k", point.alias("point")).agg(F.max(F.col("hits") / F.col("rank")).alias("precision"))
    curve = F.aggregate(
        F.sequence(F.lit(0), F.lit(100)), F.lit(0.0), lambda s, r: s + F.coalesce(F.array_max(F.transform(F.filter("points", lambda p: p["point"] >= r), lambda p: p["precision"])), F.lit(0.0))
    )
    found_ap = best.groupBy("cls", "k").agg(F.collect_list(F.struct("point", "precision")).alias("points")).select("cls", "k", (curve / 101).alias("ap"))
    n = predicted.groupBy("cls").agg(F.count(F.lit(1)).alias("n_predicted"))
    every = F.posexplode(F.array(*map(F.lit, thresholds))).alias("k", "threshold")
    out = boxes.join(n, "cls", "left").select("cls", "n_truth", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), every).join(found_ap, ["cls", "k"], "left")
    return out.select("cls", "threshold", "n_truth", "n_predicted", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def report(outcome_rows: DataFrame, aps: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, ap50, ap50_95 (means over the classes with ground truth)."""
    n = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("tp", "fp", "fn")]
    rates = [F.when(F.col("tp") + F.col(x) > 0, F.col("tp") / (F.col("tp") + F.col(x))).alias(name) for x, name in (("fp", "precision"), ("fn", "recall"))]
    mean = aps.agg(F.avg(F.when(F.abs(F.col("threshold") - 0.5) < 1e-9, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))
    return outcome_rows.agg(*n).select("*", *rates).crossJoin(mean)  # a row each


# Tracks: boxes with a column track


def associated(predicted: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(key, g_track, p_track, p_id, g_id) frame by frame, by falling IoU; equal ones by id. Classes are not looked at."""
    of = lambda df: df.withColumn("cls", F.col("track"))
    pairs = overlaps(of(predicted).withColumn("score", F.lit(0.0)), of(truth), least)
    found = matched(pairs, (least,), same_class=False, by_iou=True)
    return found.select("key", F.col("g_cls").alias("g_track"), F.col("p_cls").alias("p_track"), "p_id", "g_id")


def track_report(predicted: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: mota, idf1, hota, det_a, ass_a and their counts.

    Tracks that were ever matched make a sparse table of how often; identities are paired one to one from its largest
    counts down (then the smaller truth, then predicted track). mota may be negative. Null without any box."""
    n_g, n_p = (df.groupBy("track").agg(F.count(F.lit(1)).alias("n")) for df in (truth, predicted))
    cells = cut(found.groupBy("g_track", "p_track").agg(F.count(F.lit(1)).alias("n")))
    paired = assign(cells, [], "g_track", "p_track", [F.desc("n"), F.asc("g_track"), F.asc("p_track")]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("id_tp"))
    whole = cells.join(n_g.select(F.col("track").alias("g_track"), F.col("n").alias("n_g")), "g_track").join(n_p.select(F.col("track").alias("p_track"), F.col("n").alias("n_p")), "p_track")
    joined = whole.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.coalesce(F.sum(F.col("n") * F.col("n") / (F.col("n_g") + F.col("n_p") - F.col("n"))), F.lit(0.0)).alias("likeness"))
    w = Window.partitionBy("g_track").orderBy("key", "g_id")
    switched = found.withColumn("before", F.lag("p_track").over(w)).agg(F.count(F.when(F.col("before") != F.col("p_track"), 1)).alias("id_switches"))
    out = truth.agg(F.count(F.lit(1)).alias("n_truth")).crossJoin(predicted.agg(F.count(F.lit(1)).alias("n_predicted"))).crossJoin(paired).crossJoin(joined).crossJoin(switched)  # a row each
    out = out.withColumns({"misses": F.col("n_truth") - F.col("matches"), "false_positives": F.col("n_predicted") - F.col("matches")})
    boxes = F.col("matches") + F.col("misses") + F.col("false_positives")
    share = lambda x, of: F.when(of > 0, x / of)
    out = out.withColumns({
        "mota": F.when(F.col("n_truth") > 0, 1 - (F.col("misses") + F.col("false_positives") + F.col("id_switches")) / F.col("n_truth")),
        "idf1": share(2 * F.col("id_tp"), F.col("n_truth") + F.col("n_predicted")),
        "det_a": share(F.col("matches"), boxes),
        "ass_a": F.when(boxes > 0, F.coalesce(share(F.col("likeness"), F.col("matches")), F.lit(0.0))),
    })
    out = out.withColumn("hota", F.sqrt(F.col("det_a") * F.col("ass_a")))
    return out.select("mota", "idf1", "hota", "det_a", "ass_a", "matches", "misses", "false_positives", "id_switches", "n_truth", "n_predicted")


def track_safety(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(track, n, n_matched, wait, fragments, id_switches) of each true track: frames before it is first matched (null if it
    never is), how often matching starts anew after a miss, how often the matched track changes."""
    rows = truth.select("key", "track", F.col("id").alias("g_id")).join(found.select("g_id", "p_track"), "g_id", "left")
    w = Window.partitionBy("track").orderBy("key", "g_id")
    hit = F.col("p_track").isNotNull()
    rows = rows.withColumns({"at": F.row_number().over(w), "missed": F.lag("p_track").over(w).isNull(), "before": F.last("p_track", True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    starts = F.count(F.when(hit & F.col("missed"), 1))
    return rows.groupBy("track").agg(
        F.count(F.lit(1)).alias("n"), F.count("p_track").alias("n_matched"), (F.min(F.when(hit, F.col("at"))) - 1).alias("wait"),
        F.greatest(starts - 1, F.lit(0)).alias("fragments"), F.count(F.when(hit & (F.col("before") != F.col("p_track")), 1)).alias("id_switches"),
    )

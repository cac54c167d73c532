"""Queries on boxes and tracks. Lines of an order are boxes in the frame of their part, placed by their price; predictions
are shifted by discount and tax, some missed, some of another class, some where there is nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import confident
from ..operators import detection as D
from ..operators import smoothing
from ..operators.graph import cut
from ..tables import events, table


def true_boxes(spark: SparkSession, d: str) -> DataFrame:
    """id, key, cls, track, corners, and the whole percents `shift` and `drop` (discount, tax); of rows with one number the least of each column counts."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("key"), F.min("l_suppkey").alias("track"), F.min("l_returnflag").alias("cls"), F.min("l_quantity").cast("long").alias("q"),
        F.min(F.round(F.col("l_extendedprice") * 100)).cast("long").alias("cents"), F.min(F.round(F.col("l_discount") * 100)).cast("long").alias("shift"), F.min(F.round(F.col("l_tax") * 100)).cast("long").alias("drop"),
    )
    x, y = F.col("cents") % 900, F.floor(F.col("cents") / 900) % 500
    return lines.select(
        (F.col("l_orderkey") * 20 + F.col("l_linenumber")).alias("id"), "key", "cls", "track", "shift", "drop", (F.col("cents") % 9973 / 9973).alias("score"),
        x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 20 + 2 * F.col("q")).cast("double").alias("x2"), (y + 20 + F.col("q")).cast("double").alias("y2"),
    )


def predicted_boxes(truth: DataFrame) -> DataFrame:
    dx, dy = (F.col("shift") - 5) * 2.0, (F.col("drop") - 4) * 2.0
    seen = truth.where("shift < 10").select(
        "id", "key", F.when(F.col("drop") == 8, "N").otherwise(F.col("cls")).alias("cls"), (F.col("track") + F.when(F.col("drop") == 7, 1).otherwise(0)).alias("track"), "score",
        *((F.col(c) + s).alias(c) for c, s in (("x1", dx), ("y1", dy), ("x2", dx), ("y2", dy))),
    )
    ghosts = truth.where("drop = 0").select((F.col("id") + 10).alias("id"), "key", "cls", (-F.col("track")).alias("track"), (F.col("score") / 2).alias("score"), *((F.col(c) + 200).alias(c) for c in ("x1", "x2")), "y1", "y2")
    return seen.unionByName(ghosts)


def boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    truth = cut(true_boxes(spark, d))  # read by both sides
    return predicted_boxes(truth), truth.select("id", "key", "cls", "track", "x1", "y1", "x2", "y2")


def detection_outcomes(spark: SparkSession, d: str) -> DataFrame:
    p, g = boxes(spark, d)
    rows = D.outcomes(p, g, D.overlaps(p, g, 0.5))
    return rows.groupBy("outcome", "g_cls", "p_cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.sum(F.coalesce("p_id", "g_id")).alias("ids"))


def detection_ap(spark: SparkSession, d: str) -> DataFrame:
    p, g = boxes(spark, d)
    found = D.average_precisions(p, g, D.matched(D.overlaps(p, g, 0.5)))
    return found.select("cls", "threshold", "n_truth", "n_predicted", F.round("ap", 6).alias("ap"))


def detection_report(spark: SparkSession, d: str) -> DataFrame:
    p, g = boxes(spark, d)
    pairs = cut(D.overlaps(p, g, 0.5))  # matched twice
    found = D.report(D.outcomes(p, g, pairs), D.average_precisions(p, g, D.matched(pairs)))
    return found.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "ap50", "ap50_95")))


def tracking_report(spark: SparkSession, d: str) -> DataFrame:
    p, g = boxes(spark, d)
    found = D.track_report(p, g, D.associated(p, g))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns[:5]), *found.columns[5:])


def track_safety(spark: SparkSession, d: str) -> DataFrame:
    p, g = boxes(spark, d)
    return D.track_safety(g, D.associated(p, g))


def smooth_tracks(spark: SparkSession, d: str) -> DataFrame:
    """A user's events are sightings of one box that moves right, shaken by their values; every third user's box jumps."""
    e = events(spark, d).select("event_id", F.col("session_id").alias("track"), (F.col("t") / 1e6).alias("t"), F.col("value"))
    x = (F.col("t") - 1_704_067_200) / 1000 + F.least("value", F.lit(60.0)) / 10 + F.when((F.col("track") % 3 == 0) & (F.col("event_id") % 2 == 0), 900).otherwise(0)
    boxes = e.select("event_id", "track", "t", x.alias("x1"), (F.col("value") / 50).alias("y1"), (x + 40).alias("x2"), (F.col("value") / 50 + 30).alias("y2"))
    found = smoothing.smooth_tracks(boxes)
    return found.select("event_id", "track", *(F.round(c, 4).alias(c) for c in ("sx1", "sy1", "sx2", "sy2", "std")), "gated", "smoothed")


def label_errors(spark: SparkSession, d: str) -> DataFrame:
    return confident.label_errors(table(spark, d, "embeddings")).select("id", "given", "proposed", *(F.round(c, 4).alias(c) for c in ("score", "given_p", "proposed_p")))


QUERIES = {
    "detection_outcomes": detection_outcomes,
    "detection_ap": detection_ap,
    "detection_report": detection_report,
    "tracking_report": tracking_report,
    "track_safety": track_safety,
    "smooth_tracks": smooth_tracks,
    "label_errors": label_errors,
}

#: Truth and predictions, pairs, and the greedy pass as a recursion: each step takes a frame's next prediction (or pair).
BOXES_SQL = """
    l AS (SELECT l_orderkey * 20 + l_linenumber AS id, min(l_partkey) AS key, min(l_suppkey) AS track, min(l_returnflag) AS cls, min(l_quantity)::BIGINT AS q,
                 min(round(l_extendedprice * 100))::BIGINT AS cents, min(round(l_discount * 100))::BIGINT AS shift, min(round(l_tax * 100))::BIGINT AS dr
          FROM lineitem GROUP BY l_orderkey, l_linenumber),
    g AS (SELECT id, key, cls, track, shift, dr, (cents % 9973) / 9973 AS score, (cents % 900)::DOUBLE AS x1, (cents // 900 % 500)::DOUBLE AS y1,
                 (cents % 900 + 20 + 2 * q)::DOUBLE AS x2, (cents // 900 % 500 + 20 + q)::DOUBLE AS y2 FROM l),
    p AS (SELECT id, key, CASE WHEN dr = 8 THEN 'N' ELSE cls END AS cls, track + (dr = 7)::INT AS track, score, x1 + (shift - 5) * 2 AS x1,
                 y1 + (dr - 4) * 2 AS y1, x2 + (shift - 5) * 2 AS x2, y2 + (dr - 4) * 2 AS y2 FROM g WHERE shift < 10
          UNION ALL SELECT id + 10, key, cls, -track, score / 2, x1 + 200, y1, x2 + 200, y2 FROM g WHERE dr = 0),
    i AS (SELECT p.key, p.id AS p_id, g.id AS g_id, p.cls AS p_cls, g.cls AS g_cls, p.track AS p_track, g.track AS g_track, p.score,
                 greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS a,
                 (p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS b FROM p JOIN g USING (key)),
    pairs AS (SELECT * EXCLUDE (a, b), a / (b - a) AS iou FROM i WHERE a / (b - a) >= 0.5)
"""
GREEDY_SQL = """
    todo AS (SELECT *, dense_rank() OVER (PARTITION BY key, thr ORDER BY score DESC, p_id) AS step FROM candidates),
    walk AS (SELECT DISTINCT key, thr, 0::BIGINT AS step, []::BIGINT[] AS taken, NULL::BIGINT AS p_id, NULL::BIGINT AS g_id FROM candidates
             UNION ALL
             SELECT key, thr, step, CASE WHEN g_id IS NULL THEN taken ELSE list_append(taken, g_id) END, p_id, g_id FROM (
                 SELECT w.key, w.thr, w.step + 1 AS step, w.taken, any_value(t.p_id) AS p_id,
                        arg_max(t.g_id, [t.iou, -t.g_id]) FILTER (NOT list_contains(w.taken, t.g_id)) AS g_id
                 FROM walk w JOIN todo t ON t.key = w.key AND t.thr = w.thr AND t.step = w.step + 1 GROUP BY w.key, w.thr, w.step, w.taken)),
    m AS (SELECT walk.key, thr, walk.p_id, walk.g_id, p_cls, g_cls, p_track, g_track, iou FROM walk JOIN pairs ON pairs.p_id = walk.p_id AND pairs.g_id = walk.g_id)
"""
THRESHOLDS_SQL = "SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS thr"
AP_SQL = f"""
    candidates AS (SELECT pairs.*, thr FROM pairs, ({THRESHOLDS_SQL}) WHERE p_cls = g_cls AND iou >= thr), {GREEDY_SQL},
    r AS (SELECT p.cls, t.thr, count(m.g_id) OVER w AS hits, row_number() OVER w AS rank
          FROM p CROSS JOIN ({THRESHOLDS_SQL}) t LEFT JOIN m ON m.p_id = p.id AND m.thr = t.thr
          WINDOW w AS (PARTITION BY p.cls, t.thr ORDER BY p.score DESC, p.id ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT cls, count(*) AS n_truth FROM g GROUP BY cls),
    v AS (SELECT cls, thr, n_truth, hits / n_truth AS recall, max(hits / rank) OVER (PARTITION BY cls, thr ORDER BY rank DESC) AS best FROM r JOIN n USING (cls)),
    c AS (SELECT cls, thr, n_truth, k, coalesce(max(best) FILTER (recall >= k / 100 - 1e-9), 0) AS precision FROM v, range(101) x(k) GROUP BY ALL),
    ap AS (SELECT cls, thr AS threshold, n_truth, sum(precision) / 101 AS ap FROM c GROUP BY ALL)
"""
OUTCOMES_SQL = f"""
    candidates AS (SELECT *, 0.5::DOUBLE AS thr FROM pairs), {GREEDY_SQL},
    o AS (SELECT p.id AS p_id, m.g_id, p.cls AS p_cls, m.g_cls, m.iou, CASE WHEN m.g_cls = p.cls THEN 'tp' ELSE 'fp' END AS outcome FROM p LEFT JOIN m ON m.p_id = p.id
          UNION ALL SELECT NULL, id, NULL, cls, NULL, 'fn' FROM g WHERE id NOT IN (SELECT g_id FROM m))
"""
#: By falling IoU: the pairs of a frame in order, each taken if both its sides are free.
TRACKED_SQL = f"""WITH RECURSIVE {BOXES_SQL},
    todo AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY iou DESC, p_id, g_id) AS step FROM pairs),
    walk AS (SELECT DISTINCT key, 0::BIGINT AS step, []::BIGINT[] AS ps, []::BIGINT[] AS gs, NULL::BIGINT AS p_id, NULL::BIGINT AS g_id FROM pairs
             UNION ALL
             SELECT key, step, CASE WHEN free THEN list_append(ps, p) ELSE ps END, CASE WHEN free THEN list_append(gs, g) ELSE gs END, CASE WHEN free THEN p END, CASE WHEN free THEN g END FROM (
                 SELECT w.key, w.step + 1 AS step, w.ps, w.gs, t.p_id AS p, t.g_id AS g, NOT list_contains(w.ps, t.p_id) AND NOT list_contains(w.gs, t.g_id) AS free
                 FROM walk w JOIN todo t ON t.key = w.key AND t.step = w.step + 1)),
    m AS (SELECT pairs.* FROM walk JOIN pairs ON pairs.p_id = walk.p_id AND pairs.g_id = walk.g_id)
"""
ORACLES = {
    "detection_outcomes": f"""WITH RECURSIVE {BOXES_SQL}, {OUTCOMES_SQL}
        SELECT outcome, g_cls, p_cls, count(*) AS n, round(avg(iou), 6) AS mean_iou, sum(coalesce(p_id, g_id))::BIGINT AS ids FROM o GROUP BY ALL""",
    "detection_ap": f"""WITH RECURSIVE {BOXES_SQL}, {AP_SQL}
        SELECT cls, threshold, n_truth, (SELECT count(*) FROM p WHERE p.cls = ap.cls) AS n_predicted, round(ap, 6) AS ap FROM ap""",
    "detection_report": f"""WITH RECURSIVE {BOXES_SQL}, {AP_SQL},
        {OUTCOMES_SQL.replace("candidates", "any_class").replace("todo", "todo2").replace("walk", "walk2").replace("m AS", "m2 AS").replace(" m ", " m2 ").replace("m.", "m2.").replace("FROM m)", "FROM m2)")},
        t AS (SELECT count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM o)
        SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
               (SELECT round(avg(ap), 6) FROM ap WHERE threshold = 0.5) AS ap50, (SELECT round(avg(ap), 6) FROM ap) AS ap50_95 FROM t""",
    "tracking_report": f"""{TRACKED_SQL},
        c AS (SELECT g_track, p_track, count(*) AS n FROM m GROUP BY ALL),
        q AS (SELECT *, row_number() OVER (ORDER BY n DESC, g_track, p_track) AS step FROM c),
        ids AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS gs, []::BIGINT[] AS ps, 0::BIGINT AS tp
                UNION ALL
                SELECT step, CASE WHEN free THEN list_append(gs, g) ELSE gs END, CASE WHEN free THEN list_append(ps, p) ELSE ps END, tp + CASE WHEN free THEN n ELSE 0 END FROM (
                    SELECT q.step, gs, ps, tp, q.n, g_track AS g, p_track AS p, NOT list_contains(gs, g_track) AND NOT list_contains(ps, p_track) AS free
                    FROM ids JOIN q ON q.step = ids.step + 1)),
        s AS (SELECT count(*) FILTER (b <> p_track) AS id_switches FROM (SELECT p_track, lag(p_track) OVER (PARTITION BY g_track ORDER BY key, g_id) AS b FROM m)),
        a AS (SELECT sum(n * n / ((SELECT count(*) FROM g WHERE track = g_track) + (SELECT count(*) FROM p WHERE track = p_track) - n)) AS likeness, sum(n)::BIGINT AS matches FROM c),
        z AS (SELECT matches, likeness, id_switches, (SELECT count(*) FROM g) AS n_truth, (SELECT count(*) FROM p) AS n_predicted, (SELECT max(tp) FROM ids) AS tp FROM a, s),
        y AS (SELECT *, n_truth - matches AS misses, n_predicted - matches AS false_positives, matches / (n_truth + n_predicted - matches) AS d, likeness / matches AS e FROM z)
        SELECT round(1 - (misses + false_positives + id_switches) / n_truth, 6) AS mota, round(2 * tp / (n_truth + n_predicted), 6) AS idf1, round(sqrt(d * e), 6) AS hota,
               round(d, 6) AS det_a, round(e, 6) AS ass_a, matches, misses, false_positives, id_switches, n_truth, n_predicted FROM y""",
    "track_safety": f"""{TRACKED_SQL},
        r AS (SELECT g.track, g.key, g.id, m.p_track, row_number() OVER w AS place, lag(m.p_track) OVER w AS last,
                     last_value(m.p_track IGNORE NULLS) OVER (PARTITION BY g.track ORDER BY g.key, g.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
              FROM g LEFT JOIN m ON m.g_id = g.id WINDOW w AS (PARTITION BY g.track ORDER BY g.key, g.id))
        SELECT track, count(*) AS n, count(p_track) AS n_matched, min(place) FILTER (p_track IS NOT NULL) - 1 AS wait,
               greatest(count(*) FILTER (p_track IS NOT NULL AND last IS NULL) - 1, 0) AS fragments, count(*) FILTER (p_track <> before) AS id_switches FROM r GROUP BY track""",
}

"""Queries that score, test and calibrate. Predictions are nearest centroids of the embeddings' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import metrics as M
from ..operators import sets
from ..operators import vectors as V
from ..tables import events, objects, table


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, predicted, score: the centroid with the largest cosine; equal ones go to the smaller label."""
    e = table(spark, d, "embeddings")
    marks = F.broadcast(V.centroids(e, "label").select(F.col("label").alias("predicted"), "centroid"))
    scored = e.crossJoin(marks).select("vec_id", "label", "predicted", F.round(V.cosine("embedding", "centroid"), 6).alias("score"))
    best = F.max(F.struct("score", (-F.col("predicted")).alias("p"))).alias("best")
    return scored.groupBy("vec_id", "label").agg(best).select("vec_id", "label", (-F.col("best.p")).alias("predicted"), "best.score")


def confusion_cells(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(predictions(spark, d), "label", "predicted")


def ap_101(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    truths = p.groupBy(F.col("label").alias("predicted")).agg(F.count(F.lit(1)).alias("n_truth"))
    found = M.average_precision(p.withColumn("tp", F.col("label") == F.col("predicted")), "predicted", "score", "tp", truths, "vec_id")
    return found.select("predicted", F.round("ap", 6).alias("ap"))


def mean_ap(spark: SparkSession, d: str) -> DataFrame:
    return ap_101(spark, d).agg(F.round(F.avg("ap"), 4).alias("map"), F.count("ap").alias("classes"))


def np_threshold(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("ok", F.col("label") == F.col("predicted"))
    found = M.np_threshold(p.withColumn("score", F.round("score", 2)), "predicted", "score", "ok", 0.2)
    return found.select("predicted", "threshold", "n_accepted", F.round("far", 6).alias("far"))


def slice_recall(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    return p.groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    found = M.cohen_kappa(table(spark, d, "labels").withColumn("other", 1 - F.col("toxic")), "quality", "other")
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("agreement", "expected", "kappa")))


def review_agreement(spark: SparkSession, d: str) -> DataFrame:
    same = F.count(F.when(F.col("quality") == 1 - F.col("toxic"), 1))
    return table(spark, d, "labels").rollup("quality").agg(F.count(F.lit(1)).alias("n"), same.alias("confirmed"), F.round(100 * same / F.count(F.lit(1)), 4).alias("pct"))


def capture_recapture(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("conf") >= 0.3
    other = F.col("state") != "R"
    counts = objects(spark, d).groupBy("l1").agg(F.count(F.when(hit & other, 1)).alias("b"), F.count(F.when(hit & ~other, 1)).alias("m"), F.count(F.when(~hit & other, 1)).alias("h"))
    found = counts.withColumn("x", S.chapman(F.col("b"), F.col("m"), F.col("h")))
    return found.select("l1", F.round("x.n", 4).alias("n"), F.round("x.var", 4).alias("var"))


def rogan_gladen(spark: SparkSession, d: str) -> DataFrame:
    rate = objects(spark, d).groupBy("l1").agg(F.avg((F.col("state") == "R").cast("int")).alias("p"))
    return rate.select("l1", F.round(S.rogan_gladen(F.col("p"), F.lit(0.76), F.lit(0.80)), 6).alias("corrected"))


def acceptance_sampling(spark: SparkSession, d: str) -> DataFrame:
    bad = F.count(F.when(F.col("state") == "R", 1))
    cards = objects(spark, d).groupBy("class_name").agg(bad.alias("bad"), F.count(F.lit(1)).alias("n"))
    return cards.select("class_name", "bad", "n", S.acceptance(S.wilson(F.col("bad"), F.col("n")), 0.335).alias("decision"))


def psi_label_drift(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return sets.psi(o.where(early), o.where(~early), "p_type").select(F.round("psi", 8).alias("psi"))


def error_queue(spark: SparkSession, d: str) -> DataFrame:
    """Detectors as named frames of (frame_id, kind, score), united and ranked within each kind."""
    o = objects(spark, d)
    small = o.where("width < 3").select("frame_id", "number", F.lit("tiny").alias("kind"), F.lit(0.6).alias("score"))
    odd = o.where("height / width > 2090").select("frame_id", "number", F.lit("aspect").alias("kind"), F.lit(0.65).alias("score"))
    unsure = o.where("conf < 0.1").select("frame_id", "number", F.lit("unsure").alias("kind"), F.round(1 - F.col("conf"), 6).alias("score"))
    return small.unionByName(odd).unionByName(unsure).groupBy("frame_id").agg(F.count_distinct("kind").alias("kinds"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))


def detector_precision(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("status", F.when(F.col("value") > 40, "confirmed").when(F.col("value") > 5, "dismissed").otherwise("open"))
    cells = e.groupBy("kind").pivot("status", ["confirmed", "dismissed", "open"]).count().fillna(0)
    cells = cells.withColumn("w", S.wilson(F.col("confirmed"), F.col("confirmed") + F.col("dismissed")))
    return cells.select("kind", "confirmed", "dismissed", "open", "w.p", "w.lo", "w.hi")


def value_score(spark: SparkSession, d: str) -> DataFrame:
    """A candidate's value: uncertainty and rarity, each scaled over the pool, weighed and summed."""
    o = objects(spark, d).where("state <> 'A'")
    rare = o.groupBy("class_name").agg(F.count(F.lit(1)).alias("n_class"))
    o = o.join(F.broadcast(rare), "class_name")
    o = o.withColumn("u", S.band_uncertainty(F.col("conf"), 0.55, 0.92))
    limits = o.agg(F.min("u").alias("u_lo"), F.max("u").alias("u_hi"), F.min("n_class").alias("n_lo"), F.max("n_class").alias("n_hi"))
    rarity = {c: 1 - F.col(n) / F.col("n_hi") for c, n in (("r", "n_class"), ("r_lo", "n_hi"), ("r_hi", "n_lo"))}
    o = o.crossJoin(F.broadcast(limits)).withColumns(rarity)  # one row

    def scaled(c: str):
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)

    score = 0.40 * scaled("u") + 0.20 * scaled("r")
    return o.withColumn("score", F.round(score, 5)).groupBy("class_name").agg(F.max("score").alias("best"), F.round(F.avg("score"), 4).alias("mean"))


def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame([("A", 0.5, 0.1), ("N", 0.7, 0.2), ("R", 0.8, 0.3)], "state string, accept double, low double")
    o = objects(spark, d).join(F.broadcast(limits), "state")
    gate = F.when(F.col("conf") < F.col("low"), "annotate").when(F.col("conf") < F.col("accept"), "review").otherwise("auto_accept")
    return o.groupBy("state", gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def ttc_recall(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select((F.col("value") > 20).alias("hit"), F.when(F.col("kind") != "error", F.col("value") / 20).alias("ttc"))
    return M.weighted_recall(e, "hit", "ttc").select(F.round("recall", 6).alias("recall"))


def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("bin", F.least(F.floor(F.col("score") * 10), F.lit(9)))
    return p.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean_score"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 6).alias("accuracy"))


def isotonic_calibration(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.regression import IsotonicRegression

    p = predictions(spark, d).select("vec_id", "score", (F.col("label") == F.col("predicted")).cast("double").alias("hit"))
    fit = IsotonicRegression(featuresCol="score", labelCol="hit").fit(p)
    return fit.transform(p).select("vec_id", "score", F.round("prediction", 6).alias("calibrated"))


QUERIES = {f.__name__: f for f in (
    confusion_cells, ap_101, mean_ap, np_threshold, slice_recall, cohen_kappa, review_agreement, capture_recapture, rogan_gladen, acceptance_sampling,
    psi_label_drift, error_queue, detector_precision, value_score, confidence_gate, ttc_recall, calibration_error, isotonic_calibration,
)}

from .selection import OBJECTS_SQL  # noqa: E402

PREDICTED_SQL = """
    WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
    c AS (SELECT label AS predicted, k, avg(x) AS m FROM e GROUP BY 1, 2),
    s AS (SELECT vec_id, label, predicted, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS score FROM e JOIN c ON e.k = c.k GROUP BY 1, 2, 3)
    SELECT vec_id, label, predicted, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, predicted) AS r FROM s) WHERE r = 1
"""
AP_SQL = f"""WITH p AS ({PREDICTED_SQL}), t AS (SELECT label, count(*) AS n FROM p GROUP BY 1),
    r AS (SELECT predicted, n, row_number() OVER w AS rank, sum((label = predicted)::INT) OVER w AS hits
          FROM (SELECT p.*, t.n FROM p JOIN t ON t.label = p.predicted) WINDOW w AS (PARTITION BY predicted ORDER BY score DESC, vec_id)),
    q AS (SELECT predicted, i, coalesce(max(hits / rank) FILTER (100 * hits >= i * n), 0) AS p FROM r, range(101) g(i) GROUP BY 1, 2),
    a AS (SELECT predicted, avg(p) AS ap FROM q GROUP BY 1) SELECT label AS predicted, round(coalesce(ap, 0), 6) AS ap FROM t LEFT JOIN a ON a.predicted = t.label"""
WILSON = "(({k} / {n}::DOUBLE + 3.841458881296 / (2 * {n})) {sign} 1.959964::DOUBLE * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + 3.841458881296::DOUBLE / (4.0::DOUBLE * {n} * {n}))) / (1 + 3.841458881296 / {n})"


def wilson_sql(k: str, n: str, sign: str) -> str:
    return WILSON.format(k=k, n=n, sign=sign)


ORACLES = {
    "confusion_cells": f"SELECT label, predicted, count(*) AS n FROM ({PREDICTED_SQL}) GROUP BY 1, 2",
    "ap_101": AP_SQL,
    "mean_ap": f"SELECT round(avg(ap), 4) AS map, count(ap) AS classes FROM ({AP_SQL})",
    "np_threshold": f"""WITH p AS (SELECT predicted, round(score, 2) AS score, (label = predicted)::INT AS ok FROM ({PREDICTED_SQL})),
        c AS (SELECT predicted, score, count(*) OVER w AS n, sum(ok) OVER w AS hits FROM p WINDOW w AS (PARTITION BY predicted ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
        f AS (SELECT DISTINCT predicted, score, n, 1 - hits / n AS far FROM c), k AS (SELECT DISTINCT predicted FROM p),
        b AS (SELECT *, row_number() OVER (PARTITION BY predicted ORDER BY n DESC) AS r FROM f WHERE far <= 0.2)
        SELECT k.predicted, score AS threshold, n AS n_accepted, round(far, 6) AS far FROM k LEFT JOIN b ON b.predicted = k.predicted AND r = 1""",
    "slice_recall": f"SELECT label, round(avg((label = predicted)::INT), 6) AS recall, count(*) AS n FROM ({PREDICTED_SQL}) GROUP BY 1",
    "cohen_kappa": """WITH l AS (SELECT quality AS a, 1 - toxic AS b FROM labels), n AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS agreement FROM l),
        e AS (SELECT sum(x.k * y.k) AS e FROM (SELECT a, count(*)::DOUBLE AS k FROM l GROUP BY 1) x JOIN (SELECT b, count(*)::DOUBLE AS k FROM l GROUP BY 1) y ON a = b)
        SELECT n::BIGINT AS n, round(agreement, 6) AS agreement, round(e / n / n, 6) AS expected, round((agreement - e / n / n) / (1 - e / n / n), 6) AS kappa FROM n, e""",
    "review_agreement": """SELECT quality, count(*) AS n, count(*) FILTER (quality = 1 - toxic) AS confirmed, round(100 * count(*) FILTER (quality = 1 - toxic) / count(*), 4) AS pct FROM labels GROUP BY ROLLUP (quality)""",
    "capture_recapture": f"""WITH c AS (SELECT l1, count(*) FILTER (conf >= 0.3 AND state <> 'R')::DOUBLE AS m, count(*) FILTER (conf >= 0.3)::DOUBLE AS n1, count(*) FILTER (state <> 'R')::DOUBLE AS n2 FROM ({OBJECTS_SQL}) GROUP BY 1)
        SELECT l1, round(greatest((n1 + 1) * (n2 + 1) / (m + 1) - 1, n1 + n2 - m), 4) AS n, round((n1 + 1) * (n2 + 1) * (n1 - m) * (n2 - m) / ((m + 1) * (m + 1) * (m + 2)), 4) AS var FROM c""",
    "rogan_gladen": f"""SELECT l1, round(least(1, greatest(0, (avg((state = 'R')::INT) + 0.80::DOUBLE - 1) / (0.76::DOUBLE + 0.80::DOUBLE - 1))), 6) AS corrected FROM ({OBJECTS_SQL}) GROUP BY 1""",
    "acceptance_sampling": f"""WITH c AS (SELECT class_name, count(*) FILTER (state = 'R') AS bad, count(*) AS n FROM ({OBJECTS_SQL}) GROUP BY 1)
        SELECT *, CASE WHEN round({wilson_sql('bad', 'n', '+')}, 4) <= 0.335 THEN 'accept' WHEN round({wilson_sql('bad', 'n', '-')}, 4) > 0.335 THEN 'reject' ELSE 'inconclusive' END AS decision FROM c""",
    "psi_label_drift": """WITH o AS (SELECT p_type, l_shipdate < TIMESTAMP '1998-01-01' AS early FROM lineitem JOIN part ON l_partkey = p_partkey),
        h AS (SELECT p_type, count(*) FILTER (early) AS a, count(*) FILTER (NOT early) AS b FROM o GROUP BY 1),
        s AS (SELECT a / sum(a) OVER () + 1e-6 AS r, b / sum(b) OVER () + 1e-6 AS c FROM h), n AS (SELECT r / sum(r) OVER () AS r, c / sum(c) OVER () AS c FROM s)
        SELECT round(sum((c - r) * ln(c / r)), 8) AS psi FROM n""",
    "error_queue": f"""WITH o AS ({OBJECTS_SQL}), q AS (SELECT frame_id, 'tiny' AS kind, 0.6::DOUBLE AS score FROM o WHERE width < 3
        UNION ALL SELECT frame_id, 'aspect', 0.65 FROM o WHERE height / width > 2090 UNION ALL SELECT frame_id, 'unsure', round(1 - conf, 6) FROM o WHERE conf < 0.1)
        SELECT frame_id, count(DISTINCT kind) AS kinds, max(score) AS score, count(*) AS n FROM q GROUP BY 1""",
    "detector_precision": f"""WITH c AS (SELECT event_type AS kind, count(*) FILTER (value > 40) AS confirmed, count(*) FILTER (value > 5 AND value <= 40) AS dismissed, count(*) FILTER (value <= 5) AS open FROM events GROUP BY 1),
        n AS (SELECT *, confirmed + dismissed AS n FROM c) SELECT kind, confirmed, dismissed, open, round(confirmed / n, 4) AS p,
        round(greatest(0, {wilson_sql('confirmed', 'n', '-')}), 4) AS lo, round(least(1, {wilson_sql('confirmed', 'n', '+')}), 4) AS hi FROM n""",
    "value_score": f"""WITH o AS (SELECT * FROM ({OBJECTS_SQL}) WHERE state <> 'A'), c AS (SELECT class_name, count(*) AS nc FROM o GROUP BY 1),
        x AS (SELECT o.class_name, least(1, exp(-pow((conf - (0.55::DOUBLE + 0.92::DOUBLE) / 2) / ((0.92::DOUBLE - 0.55::DOUBLE) / 2), 2))) AS u, 1 - nc / (SELECT max(nc) FROM c) AS r FROM o JOIN c ON o.class_name = c.class_name),
        s AS (SELECT class_name, round(0.40::DOUBLE * (u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ()) + 0.20::DOUBLE * (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()), 5) AS score FROM x)
        SELECT class_name, max(score) AS best, round(avg(score), 4) AS mean FROM s GROUP BY 1""",
    "confidence_gate": f"""SELECT x.state, CASE WHEN conf < low THEN 'annotate' WHEN conf < accept THEN 'review' ELSE 'auto_accept' END AS gate, count(*) AS n FROM ({OBJECTS_SQL}) x
        JOIN (VALUES ('A', 0.5, 0.1), ('N', 0.7, 0.2), ('R', 0.8, 0.3)) l(state, accept, low) ON l.state = x.state GROUP BY 1, 2""",
    "ttc_recall": """WITH w AS (SELECT value > 20 AS hit, CASE WHEN event_type = 'error' THEN 1 ELSE greatest(0, (6 - value / 20) / 6) END AS w FROM events) SELECT round(sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w), 6) AS recall FROM w""",
    "calibration_error": f"""SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(score), 5) AS mean_score, round(avg((label = predicted)::INT), 6) AS accuracy FROM ({PREDICTED_SQL}) GROUP BY 1""",
}

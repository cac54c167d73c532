"""Queries for work with labels: consensus, suppression, recovery, quality, repair, sensors' health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import labels as L
from ..tables import events, objects, table
from .selection import OBJECTS_SQL
from .timelines import EVENTS_SQL


def frame_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of three labelling paths: events of a user on a day share a frame, the event type stands for the class."""
    e = events(spark, d)
    x, y = F.pmod(F.col("event_id") * 7, F.lit(40)) * 1.0, F.pmod(F.col("event_id") * 13, F.lit(30)) * 1.0
    return e.select(
        F.floor(F.col("t") / 14_400_000_000).alias("frame"), F.col("event_id").alias("id"), F.pmod("session_id", F.lit(3)).alias("path"),
        F.when(F.col("kind").isin("view", "click"), "a").otherwise("b").alias("cls"), x.alias("x1"), y.alias("y1"), (x + 50).alias("x2"), (y + 50).alias("y2"),
        F.round(F.pmod("event_id", F.lit(97)) / 97, 6).alias("conf"),
    )


def consensus_vote(spark: SparkSession, d: str) -> DataFrame:
    return L.consensus(frame_boxes(spark, d), "frame", "path").select("frame", "id", "n_agree", F.round("score", 4).alias("score"), "accepted")


def nms(spark: SparkSession, d: str) -> DataFrame:
    return L.suppress(frame_boxes(spark, d), "frame", 0.5).select("frame", "id")


def recall_recovery(spark: SparkSession, d: str) -> DataFrame:
    b = frame_boxes(spark, d)
    return L.unmatched(b.where("path = 0"), b.where("path = 1"), "frame", 0.9).select("frame", "id")


def label_quality(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    state = F.when(F.col("state") == "R", "rejected").when(F.col("state") == "A", "accepted").otherwise("review")
    score = L.label_quality(F.col("conf"), F.col("width") > 5, F.col("number") < 6, F.col("source") == "O", state, F.col("number") == 1)
    return o.withColumn("q", score).groupBy("class_name", "state").agg(F.round(F.avg("q"), 4).alias("quality"), F.round(F.max("q"), 6).alias("best"))


def missed_frame_score(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", (F.pmod("event_id", F.lit(10)) / 10).alias("sparsity"), F.least(F.col("value") / 100, F.lit(1.0)).alias("conf"), F.when(F.col("kind") == "error", F.pmod("event_id", F.lit(7))).alias("gap"), F.lit(0.5).alias("novelty"))
    return L.missed_frames(e).select("event_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "event_id").limit(200)


def temporal_repair(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("label", F.when(F.col("kind").isin("view", "click", "purchase", "signup"), "usual").otherwise(F.col("kind")))
    return L.repair_plan(e, "session_id", "label", "t").select("session_id", "majority", F.round("share", 6).alias("share"), "n")


def review_confusions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    e = events(spark, d).withColumn("before", F.lag("kind").over(w)).where("before IS NOT NULL")
    return L.confusion_pairs(e, "before", "kind", 10)


def gated_queue(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    blocked = e.groupBy("session_id").agg(F.avg("value").alias("m")).where("m < 19").select("session_id")
    return L.blocked_queue(e, blocked, "session_id", "value", "event_id", 100).select("event_id", "session_id")


def frame_drops(spark: SparkSession, d: str) -> DataFrame:
    found = L.drop_rate(events(spark, d), "session_id", "event_id")
    return found.select("session_id", "expected", "received", "longest", F.round("rate", 6).alias("rate"))


def session_health(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("value") > 1, F.least(F.lit(1.0), F.col("value") / 10)).otherwise(0.0)
    checks = events(spark, d).select("session_id", F.col("kind").alias("check"), F.when(F.col("kind") == "error", 2.0).otherwise(1.0).alias("weight"), level.alias("level"), "event_id")
    means = checks.groupBy("session_id", "check").agg(F.avg("weight").alias("weight"), F.round(F.avg("level"), 6).alias("level"), F.min("event_id").alias("first"))
    return L.health(means, "session_id", "first").select("session_id", "score", "decision", "n_failed")


def voxel_grid(spark: SparkSession, d: str) -> DataFrame:
    points = objects(spark, d).select((F.col("width") / 3).alias("x"), (F.col("height") / 9000).alias("y"), F.col("conf").alias("z"))
    return L.voxels(points, 2.0).select("vx", "vy", "vz", "n", *(F.round(c, 4).alias(c) for c in "xyz"))


def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    found = L.bootstrap(events(spark, d), "value", "event_id")
    return found.select(*(F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")))


def paired_test(spark: SparkSession, d: str) -> DataFrame:
    """Two scores of each object: its discount against its tax."""
    lines = table(spark, d, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    found = L.paired_test(lines.where("l_quantity > 45"), "l_tax", "l_discount", "id")
    return found.select("n", F.round("delta", 6).alias("delta"), F.round("p_value", 6).alias("p_value"), "direction", "significant")


def phash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sign bits of the vectors' 64 components as a hash."""
    bit = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), lambda s, k: s * 2 + (F.get("embedding", k) > 0).cast("long"))
    return L.hamming_pairs(table(spark, d, "embeddings").select("vec_id", bit.alias("h")), "vec_id", "h", 14)


def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    return L.grid({"lr": [0.1, 0.01], "depth": [3, 5, 7], "kind": ["a", "b"]}, spark).select("lr", "depth", "kind", F.col("trial").cast("long").alias("trial"))


def experiment_differences(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "supplier").where("s_suppkey <= 5").select("s_suppkey", F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("fixed"), F.lit("1")).alias("params"))
    return L.varied(runs, "s_suppkey", "params").select("name", F.array_join("values", ",").alias("values"))


def embedding_drift(spark: SparkSession, d: str) -> DataFrame:
    """Stability index along 32 random directions of all components, odd ids against even ones."""
    found = L.projection_drift(table(spark, d, "embeddings"), F.col("vec_id") % 2 == 1)
    return found.select("axis", F.round("psi", 6).alias("psi"))


QUERIES = {f.__name__: f for f in (
    consensus_vote, nms, recall_recovery, label_quality, missed_frame_score, temporal_repair, review_confusions, gated_queue, frame_drops,
    session_health, voxel_grid, bootstrap_mean, paired_test, phash_pairs, parameter_grid, experiment_differences, embedding_drift,
)}

BOX_SQL = f"""SELECT floor(t / 14400000000)::BIGINT AS frame, event_id AS id, session_id % 3 AS path, CASE WHEN kind IN ('view', 'click') THEN 'a' ELSE 'b' END AS cls,
    (event_id * 7 % 40)::DOUBLE AS x1, (event_id * 13 % 30)::DOUBLE AS y1, round((event_id % 97) / 97, 6) AS conf FROM ({EVENTS_SQL})"""
IOU_SQL = """(CASE WHEN abs(a.x1 - b.x1) < 50 AND abs(a.y1 - b.y1) < 50 THEN (50 - abs(a.x1 - b.x1)) * (50 - abs(a.y1 - b.y1)) / (5000 - (50 - abs(a.x1 - b.x1)) * (50 - abs(a.y1 - b.y1))) ELSE 0 END)"""

ORACLES = {
    "consensus_vote": f"""WITH x AS ({BOX_SQL}), t AS (SELECT frame, sum(conf) AS total FROM x GROUP BY 1),
        p AS (SELECT a.frame, a.id, count(DISTINCT b.path) AS n_agree, sum(b.conf) AS mine FROM x a JOIN x b ON a.frame = b.frame AND a.cls = b.cls
              AND (a.id = b.id OR (a.path <> b.path AND {IOU_SQL} >= 0.5)) GROUP BY 1, 2)
        SELECT p.frame, id, n_agree, round(CASE WHEN total > 0 THEN mine / total END, 4) AS score, n_agree >= 3 AS accepted FROM p JOIN t ON p.frame = t.frame""",
    "recall_recovery": f"""WITH x AS ({BOX_SQL}) SELECT frame, id FROM x a WHERE path = 0 AND NOT EXISTS (SELECT 1 FROM x b WHERE b.path = 1 AND a.frame = b.frame AND {IOU_SQL} >= 0.9)""",
    "label_quality": f"""WITH s AS (SELECT *, conf * CASE WHEN width > 5 THEN 1 ELSE 0.7::DOUBLE END * CASE WHEN number < 6 THEN 1 ELSE 0.6::DOUBLE END * CASE WHEN source = 'O' THEN 1 ELSE 0.92::DOUBLE END AS q FROM ({OBJECTS_SQL})),
        c AS (SELECT class_name, state, CASE WHEN state = 'R' THEN least(q, 0.20) WHEN state = 'A' AND number = 1 THEN greatest(q, 0.75) ELSE q END AS q FROM s)
        SELECT class_name, state, round(avg(least(1, greatest(0, q))), 4) AS quality, round(max(least(1, greatest(0, q))), 6) AS best FROM c GROUP BY 1, 2""",
    "missed_frame_score": f"""WITH e AS (SELECT event_id, (event_id % 10) / 10 AS s, least(value / 100, 1) AS c, CASE WHEN kind = 'error' THEN event_id % 7 END AS g FROM ({EVENTS_SQL})),
        f AS (SELECT event_id, round(0.30::DOUBLE * s + 0.20::DOUBLE * CASE WHEN c < 0.7 THEN 1 - (0.7::DOUBLE - c) / 0.7::DOUBLE ELSE 0 END + 0.35::DOUBLE * CASE WHEN g BETWEEN 1 AND 5 THEN least(1, 1 / g) ELSE 0 END + 0.15::DOUBLE * 0.5, 6) AS score FROM e)
        SELECT event_id, score FROM f ORDER BY score DESC, event_id LIMIT 200""",
    "temporal_repair": f"""WITH c AS (SELECT session_id, CASE WHEN kind = 'error' THEN kind ELSE 'usual' END AS label, count(*) AS n, min(t) AS first FROM ({EVENTS_SQL}) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS r, sum(n) OVER (PARTITION BY session_id) AS total, count(*) OVER (PARTITION BY session_id) AS k FROM c)
        SELECT session_id, label AS majority, round(n / total, 6) AS share, total::BIGINT AS n FROM r WHERE r = 1 AND n / total >= 0.8 AND total >= 3 AND k > 1""",
    "review_confusions": f"""WITH e AS (SELECT kind, lag(kind) OVER (PARTITION BY session_id ORDER BY t, event_id) AS before FROM ({EVENTS_SQL}))
        SELECT least(before, kind) AS a, greatest(before, kind) AS b, count(*) FILTER (before < kind) AS forward, count(*) FILTER (before > kind) AS reverse, count(*) AS n
        FROM e WHERE before <> kind GROUP BY 1, 2 HAVING count(*) >= 10""",
    "gated_queue": """SELECT event_id, user_id AS session_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING avg(value) < 19) ORDER BY value DESC, event_id LIMIT 100""",
    "frame_drops": """WITH g AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id - 1 AS gap FROM events)
        SELECT user_id AS session_id, max(event_id) - min(event_id) + 1 AS expected, count(*) AS received, coalesce(max(gap), 0) AS longest, round(1 - count(*) / (max(event_id) - min(event_id) + 1), 6) AS rate FROM g GROUP BY 1""",
    "session_health": f"""WITH m AS (SELECT session_id, kind, CASE WHEN kind = 'error' THEN 2 ELSE 1 END AS w, round(avg(CASE WHEN value > 1 THEN least(1, value / 10) ELSE 0 END), 6) AS level FROM ({EVENTS_SQL}) GROUP BY 1, 2),
        s AS (SELECT session_id, round(100 * sum(w * level) / sum(w), 1) AS score, count(*) FILTER (level <= 0) AS n_failed FROM m GROUP BY 1)
        SELECT session_id, score, CASE WHEN n_failed > 0 OR score < 55 THEN 'quarantine' WHEN score >= 85 THEN 'pass' ELSE 'degraded' END AS decision, n_failed FROM s""",
    "voxel_grid": f"""WITH p AS (SELECT width / 3 AS x, height / 9000 AS y, conf AS z FROM ({OBJECTS_SQL}))
        SELECT floor(x / 2)::BIGINT AS vx, floor(y / 2)::BIGINT AS vy, floor(z / 2)::BIGINT AS vz, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM p GROUP BY 1, 2, 3""",
    "phash_pairs": """WITH b AS (SELECT vec_id, list_transform(embedding[1:63], lambda x: (x > 0)::INT) AS h FROM embeddings),
        p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.h, y.h), lambda z: (z[1] <> z[2])::INT))::INT AS distance FROM b x JOIN b y ON x.vec_id < y.vec_id)
        SELECT a, b, distance FROM p WHERE distance <= 14""",
    "embedding_drift": """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
        w AS (SELECT k AS axis, j, CASE WHEN md5('0:' || k || ':' || j) < '8' THEN 1.0 ELSE -1.0 END::DOUBLE AS sign FROM range(32) a(k), range(64) b(j)),
        e AS (SELECT axis, vec_id, vec_id % 2 AS side, round(sum(x * sign) / 8, 9) AS x FROM v JOIN w USING (j) GROUP BY 1, 2),
        q AS (SELECT axis, unnest(quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM e WHERE side = 0 GROUP BY 1),
        b AS (SELECT e.axis, e.side, e.vec_id, count(q.edge) AS bin FROM e LEFT JOIN q ON q.axis = e.axis AND q.edge < e.x GROUP BY 1, 2, 3),
        c AS (SELECT axis, bin, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM b GROUP BY 1, 2),
        s AS (SELECT axis, r / sum(r) OVER (PARTITION BY axis) + 1e-6 AS r, c / sum(c) OVER (PARTITION BY axis) + 1e-6 AS c FROM c)
        SELECT axis::INT AS axis, round(sum((c - r) * ln(c / r)), 6) AS psi FROM s GROUP BY 1""",
    "parameter_grid": """SELECT lr::DOUBLE AS lr, depth::INT AS depth, kind, row_number() OVER (ORDER BY lr, depth, kind) AS trial FROM (VALUES (0.1), (0.01)) a(lr), (VALUES (3), (5), (7)) b(depth), (VALUES ('a'), ('b')) c(kind)""",
    "experiment_differences": """SELECT 'nation' AS name, string_agg(DISTINCT s_nationkey::VARCHAR, ',' ORDER BY s_nationkey::VARCHAR) AS values FROM supplier WHERE s_suppkey <= 5 HAVING count(DISTINCT s_nationkey) > 1""",
}

"""Queries that search, curate and count reviews. Documents are frames, lines of an order are objects and their reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation as C
from ..operators import reviews as R
from ..operators import vectors as V
from ..tables import micros, table
from .vector_search import query_vector


def similar_reranked(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    found = C.reranked(e, query_vector(spark, d), 12, 0.1, F.col("vec_id") != 0, F.col("label") == 3, copies=0.3)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def frame_rarity(spark: SparkSession, d: str) -> DataFrame:
    """Vectors are frames, their ids' parts the classes: a class is on the frames of the orders that have it."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("vec_id"), F.col("l_partkey").alias("cls"))
    return C.rarities(lines, "vec_id", "cls").select("vec_id", F.round("rarity", 6).alias("rarity"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    found, filtered = C.hybrid(table(spark, d, "embeddings"), query_vector(spark, d, 1), 15, F.col("label").isin(2, 4), frame_rarity(spark, d))
    return found.select("vec_id", *(F.round(c, 6).alias(c) for c in ("semantic", "rarity", "score")), F.col("rank").cast("long").alias("rank"), F.lit(filtered).alias("filtered"))


def copy_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sign bits of the components are the hash, the label stands for the quality."""
    bit = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), lambda s, k: s * 2 + (F.get("embedding", k) > 0).cast("long"))
    e = table(spark, d, "embeddings").withColumns({"bits": bit, "quality": F.col("label").cast("double")})
    return C.copy_groups(e, "vec_id", "bits", "embedding", "quality", 17, 0.4).select("vec_id", "group", "canonical", F.round("score", 6).alias("score"))


def line_objects(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("object_id"), F.col("l_orderkey").alias("frame"), F.concat_ws("-", "l_suppkey", "l_linenumber").alias("track"), F.col("l_returnflag").alias("cls"), "l_partkey", (F.col("l_discount") * 10).alias("conf"))


def track_conflicts(spark: SparkSession, d: str) -> DataFrame:
    found = C.group_conflicts(line_objects(spark, d), "object_id", "track", "cls")
    return found.groupBy("track", "given", "proposed", "score", "n").agg(F.count(F.lit(1)).alias("objects"))


def frame_conflicts(spark: SparkSession, d: str) -> DataFrame:
    near = V.neighbour_blocks(table(spark, d, "embeddings"), None)
    objects = line_objects(spark, d).withColumn("cls", F.col("l_partkey") % 40)
    found = C.frame_conflicts(objects, near, "object_id", "frame", "cls", "conf", 0.35)
    return found.groupBy("frame", "other").agg(F.count(F.lit(1)).alias("n"), F.sum("class").alias("classes"), F.max("score").alias("score"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """A line is a review of its part by its supplier: the flag before, the status's class after."""
    kind = F.when(F.col("l_linenumber") <= 2, "accept").when(F.col("l_linenumber") <= 4, "reclassify").when(F.col("l_linenumber") == 5, "reject").otherwise("note")
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("review_id"), F.col("l_orderkey").alias("object"),
        F.when(F.col("l_suppkey") % 20 == 0, "system").otherwise(F.concat(F.lit("r"), F.col("l_suppkey") % 50)).alias("reviewer"), kind.alias("action"),
        F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).alias("before"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise("N").alias("after"),
        (F.col("l_quantity") * 1000).cast("long").alias("ms"), micros("l_shipdate").alias("t"),
    )


def reviewer_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = R.reviewer_metrics(reviews(spark, d))
    return found.select("reviewer", "reviews", *(F.round(c, 4).alias(c) for c in ("correction_rate", "avg_ms", "per_hour", "agreement")))


def shared_agreement(spark: SparkSession, d: str) -> DataFrame:
    return R.shared_agreement(reviews(spark, d)).select("shared", "agreed", F.round("rate", 6).alias("rate"))


def review_throughput(spark: SparkSession, d: str) -> DataFrame:
    return R.throughput(reviews(spark, d)).select("day", "reviews", F.round("agreement", 6).alias("agreement"))


def review_costs(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "auto_accept").otherwise("review").alias("state"))
    found = R.costs(reviews(spark, d), objects, "l_orderkey", "state")
    whole = ("n_objects", "n_frames", "n_auto")
    return found.select(*(c if c in whole else F.round(c, 6).alias(c) for c in found.columns))


QUERIES = {f.__name__: f for f in (
    similar_reranked, frame_rarity, hybrid_search, copy_groups, track_conflicts, frame_conflicts, reviewer_metrics, shared_agreement, review_throughput, review_costs,
)}

REVIEWS_SQL = """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice AS review_id, l_orderkey AS object, 'r' || (l_suppkey % 50) AS reviewer,
    CASE WHEN l_linenumber <= 2 THEN 'accept' WHEN l_linenumber <= 4 THEN 'reclassify' WHEN l_linenumber = 5 THEN 'reject' ELSE 'note' END AS action,
    CASE WHEN l_tax > 0.01 THEN l_returnflag END AS before, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE 'N' END AS after, (l_quantity * 1000)::BIGINT AS ms, epoch_us(l_shipdate) AS t
    FROM lineitem WHERE l_suppkey % 20 <> 0"""
RARITY_SQL = """n AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem), df AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS df FROM lineitem GROUP BY 1),
    rare AS (SELECT l_suppkey AS vec_id, round(max(ln(n / df) / ln(n)), 6) AS rarity FROM lineitem JOIN df USING (l_partkey), n GROUP BY 1)"""
ORACLES = {
    "similar_reranked": """WITH RECURSIVE q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
        p AS (SELECT vec_id, label, embedding, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS s FROM embeddings, q WHERE vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 72),
        o AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS step FROM p WHERE s >= 0.1 AND label <> 3),
        walk AS (SELECT 0::BIGINT AS step, 0::BIGINT AS n, []::FLOAT[][] AS taken, NULL::BIGINT AS vec_id, NULL::DOUBLE AS s
                 UNION ALL
                 SELECT step, n + ok::INT, CASE WHEN ok THEN list_append(taken, v) ELSE taken END, CASE WHEN ok THEN id END, s FROM (
                     SELECT o.step, w.n, w.taken, o.vec_id AS id, o.embedding AS v, o.s, w.n < 12 AND len(list_filter(w.taken, lambda t: list_cosine_similarity(t::DOUBLE[], o.embedding::DOUBLE[]) > 0.3)) = 0 AS ok
                     FROM walk w JOIN o ON o.step = w.step + 1))
        SELECT vec_id, round(s, 6) AS similarity, n AS rank FROM walk WHERE vec_id IS NOT NULL""",
    "frame_rarity": f"WITH {RARITY_SQL} SELECT * FROM rare",
    "hybrid_search": f"""WITH {RARITY_SQL}, q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 1),
        p AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS s FROM embeddings, q WHERE label IN (2, 4) ORDER BY s DESC, vec_id LIMIT 90),
        b AS (SELECT vec_id, s, coalesce(rarity, 0) AS rarity, 0.75 * s + 0.25 * coalesce(rarity, 0) AS score FROM p LEFT JOIN rare USING (vec_id))
        SELECT vec_id, round(s, 6) AS semantic, round(rarity, 6) AS rarity, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank, true AS filtered
        FROM b QUALIFY row_number() OVER (ORDER BY score DESC, vec_id) <= 15""",
    "copy_groups": """WITH RECURSIVE b AS (SELECT vec_id, label, embedding, list_transform(embedding[1:63], lambda x: (x > 0)::INT) AS h FROM embeddings),
        e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM b x JOIN b y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.4
              AND list_sum(list_transform(list_zip(x.h, y.h), lambda z: (z[1] <> z[2])::INT)) <= 17),
        w AS (SELECT DISTINCT a AS id, a AS r FROM e UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.r),
        g AS (SELECT id AS vec_id, min(r) AS g FROM w GROUP BY 1),
        m AS (SELECT g.vec_id, g, embedding, first_value(g.vec_id) OVER o AS best, first_value(embedding) OVER o AS v FROM g JOIN b USING (vec_id) WINDOW o AS (PARTITION BY g ORDER BY label DESC, g.vec_id))
        SELECT vec_id, g AS "group", vec_id = best AS canonical, CASE WHEN vec_id = best THEN 1 ELSE round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) END AS score FROM m""",
    "track_conflicts": """WITH o AS (SELECT l_suppkey || '-' || l_linenumber AS track, l_returnflag AS cls FROM lineitem), c AS (SELECT track, cls, count(*) AS k FROM o GROUP BY 1, 2),
        m AS (SELECT track, arg_max(cls, [k, -ascii(cls)]) AS proposed, max(k) AS top, sum(k)::BIGINT AS n FROM c GROUP BY 1)
        SELECT track, cls AS given, proposed, round(top / n, 6) AS score, n, k AS objects FROM c JOIN m USING (track) WHERE cls <> proposed AND n >= 3""",
    "frame_conflicts": """WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
        n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) = 1), o AS (SELECT l_orderkey AS frame, l_partkey % 40 AS cls, l_discount * 10 AS conf FROM lineitem),
        p AS (SELECT a AS frame, b AS other, (s - 0.35) / 0.65 AS margin FROM n WHERE s >= 0.35 AND b IN (SELECT frame FROM o))
        SELECT p.frame, p.other, count(*) AS n, sum(o.cls)::BIGINT AS classes, round(max((1 - conf) * (0.5 + 0.5 * margin)), 6) AS score FROM p JOIN o ON o.frame = p.frame
        WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.frame = p.other AND x.cls = o.cls) GROUP BY 1, 2""",
    "reviewer_metrics": f"""WITH r AS ({REVIEWS_SQL}), a AS (SELECT reviewer, count(*) AS n, count(*) FILTER (action IN ('reclassify', 'reject')) AS f, count(*) FILTER (action = 'accept') AS k, sum(ms) AS ms,
            count(*) FILTER (before IS NOT NULL AND after IS NOT NULL) AS known, count(*) FILTER (before = after) AS same FROM r GROUP BY 1)
        SELECT reviewer, n AS reviews, CASE WHEN f + k > 0 THEN round(f / (f + k), 4) END AS correction_rate, round(ms / n, 4) AS avg_ms, CASE WHEN ms / 3.6e6 > 0.01 THEN round(n / (ms / 3.6e6), 4) END AS per_hour,
               CASE WHEN known > 0 THEN round(same / known, 4) END AS agreement FROM a""",
    "shared_agreement": f"""WITH l AS (SELECT object, reviewer, arg_max(after, (t, review_id)) AS last FROM ({REVIEWS_SQL}) GROUP BY 1, 2),
        o AS (SELECT object, count(DISTINCT last) AS d FROM l GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS shared, count(*) FILTER (d = 1) AS agreed, round(count(*) FILTER (d = 1) / count(*), 6) AS rate FROM o""",
    "review_throughput": f"""SELECT t // 86400000000 AS day, count(*) AS reviews, round(count(*) FILTER (before = after) / nullif(count(*) FILTER (before IS NOT NULL), 0), 6) AS agreement
        FROM ({REVIEWS_SQL}) GROUP BY 1 ORDER BY 1 DESC LIMIT 30""",
    "review_costs": """WITH h AS (SELECT sum((l_quantity * 1000)::BIGINT) / 3.6e6 AS h, count(*) AS n, count(DISTINCT l_orderkey) AS f, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem)
        SELECT round(h, 6) AS human_hours, round(h * 8, 6) AS human_usd, n AS n_objects, f AS n_frames, a AS n_auto, round(h * 8 / n, 6) AS usd_per_object, round(h * 8 / f, 6) AS usd_per_frame,
               round(a / 180, 6) AS saved_hours, round(a / 180 * 8, 6) AS saved_usd FROM h""",
}

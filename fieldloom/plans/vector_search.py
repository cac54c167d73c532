"""Queries over vectors, copies and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as GR
from ..operators import vectors as V
from ..tables import table

LINK = 0.4


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return vectors(spark, d).where(F.col("vec_id") == vec_id).first()["embedding"]


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    found = V.top_k(vectors(spark, d), query_vector(spark, d), 20, F.col("vec_id") != 0)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = V.top_k(vectors(spark, d), query_vector(spark, d), 10, F.col("label").isin(1, 2) & (F.col("vec_id") != 0))
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def fused_topk(spark: SparkSession, d: str) -> DataFrame:
    two = vectors(spark, d).withColumn("first", F.slice("embedding", 1, 32)).withColumn("second", F.slice("embedding", 33, 32))
    q = query_vector(spark, d)
    found = V.fused_top_k(two, ("first", q[:32]), ("second", q[32:]), 0.6, 10, "vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.neighbour_blocks(vectors(spark, d), LINK).select("a", "b", F.round("similarity", 6).alias("similarity"))


def near_dup_components(spark: SparkSession, d: str) -> DataFrame:
    return GR.components(V.neighbour_blocks(vectors(spark, d), LINK)).select("id", "label")


def nn_novelty(spark: SparkSession, d: str) -> DataFrame:
    found = V.neighbour_blocks(vectors(spark, d), None)
    return found.select(F.col("a").alias("vec_id"), F.round(1 - F.col("similarity"), 6).alias("novelty"))


def curation_summary(spark: SparkSession, d: str) -> DataFrame:
    near = V.neighbour_blocks(vectors(spark, d), None).where(F.col("similarity") >= LINK)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("similarity", 6).alias("similarity")).distinct()


def pool_novelty(spark: SparkSession, d: str) -> DataFrame:
    return V.novelty(vectors(spark, d)).select("vec_id", F.round("novelty", 6).alias("novelty"))


def class_centroid_outliers(spark: SparkSession, d: str) -> DataFrame:
    return V.class_outliers(vectors(spark, d), "label").select("vec_id", "label", F.round("distance", 6).alias("distance"))


def diverse_batch(spark: SparkSession, d: str) -> DataFrame:
    return V.diverse(vectors(spark, d), "label", -F.col("vec_id"), 8, 0.25).select("label", "vec_id", "pick")


def kcenter_sample(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in enumerate(V.farthest_points(vectors(spark, d), 8, start="outer"))], "step long, vec_id long")


def farthest_point_sample(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in enumerate(V.farthest_points(vectors(spark, d), 8))], "step long, vec_id long")


def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    """Two coordinates of each vector, a stand-in for neighbour embeddings; each component's largest
    loading counts as positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors(spark, d).select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    sign = [1.0 if max(column, key=abs) > 0 else -1.0 for column in model.pc.toArray().T.tolist()]
    out = model.transform(rows).withColumn("p", vector_to_array("p"))
    return out.select("vec_id", "label", *(F.round(F.col("p")[k] * sign[k], 4).alias(c) for k, c in enumerate("xy")))


def exact_dup_documents(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one text, by its hash; the smallest id stands for each."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("hash"))
    groups = docs.groupBy("hash").agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(groups, "hash").select("doc_id", "canonical", "n")


def dedup_rate(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("redundant"), F.count(F.when(F.col("n") > 1, 1)).alias("groups"))


QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_filtered, fused_topk, near_dup_pairs, near_dup_components, nn_novelty, curation_summary, pool_novelty,
    class_centroid_outliers, diverse_batch, kcenter_sample, farthest_point_sample, pca_projection, exact_dup_documents, dedup_rate,
)}

UNIT_SQL = """SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v,
    sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) AS s FROM embeddings"""
PAIRS_SQL = f"""SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) / (x.s * y.s) AS similarity FROM ({UNIT_SQL}) x JOIN ({UNIT_SQL}) y ON x.vec_id < y.vec_id"""
BOTH_SQL = f"SELECT a, b, similarity FROM ({PAIRS_SQL}) UNION ALL SELECT b, a, similarity FROM ({PAIRS_SQL})"

#: A recursion over a label's rows in order: a row is taken if it is like none of those taken, up to eight.
DIVERSE_SQL = """WITH RECURSIVE e AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS step FROM embeddings),
    walk AS (SELECT DISTINCT label, 0::BIGINT AS step, []::BIGINT[] AS ids, []::FLOAT[][] AS taken, NULL::BIGINT AS vec_id FROM e
             UNION ALL
             SELECT label, step, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(taken, v) ELSE taken END, CASE WHEN ok THEN id END FROM (
                 SELECT w.label, e.step, w.ids, w.taken, e.vec_id AS id, e.embedding AS v,
                        len(w.ids) < 8 AND len(list_filter(w.taken, lambda t: list_cosine_similarity(t, e.embedding) > 0.25)) = 0 AS ok
                 FROM walk w JOIN e ON e.label = w.label AND e.step = w.step + 1))
    SELECT label, vec_id, len(ids)::BIGINT AS pick FROM walk WHERE vec_id IS NOT NULL"""
ORACLES = {
    "diverse_batch": DIVERSE_SQL,
    "vector_topk": f"""WITH u AS ({UNIT_SQL}) SELECT x.vec_id, round(list_dot_product(x.v, q.v) / (x.s * q.s), 6) AS similarity FROM u x, u q
        WHERE q.vec_id = 0 AND x.vec_id <> 0 ORDER BY list_dot_product(x.v, q.v) / (x.s * q.s) DESC, x.vec_id LIMIT 20""",
    "vector_topk_filtered": f"""WITH u AS ({UNIT_SQL}) SELECT x.vec_id, x.label, round(list_dot_product(x.v, q.v) / (x.s * q.s), 6) AS similarity FROM u x, u q
        WHERE q.vec_id = 0 AND x.vec_id <> 0 AND x.label IN (1, 2) ORDER BY list_dot_product(x.v, q.v) / (x.s * q.s) DESC, x.vec_id LIMIT 10""",
    "fused_topk": """WITH u AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS p, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS q FROM embeddings),
        f AS (SELECT x.vec_id, 0.6::DOUBLE * (1 - list_dot_product(x.p, y.p) / sqrt(list_dot_product(x.p, x.p) * list_dot_product(y.p, y.p)))
            + 0.4::DOUBLE * (1 - list_dot_product(x.q, y.q) / sqrt(list_dot_product(x.q, x.q) * list_dot_product(y.q, y.q))) AS distance FROM u x, u y WHERE y.vec_id = 0)
        SELECT vec_id, round(distance, 6) AS distance FROM f ORDER BY f.distance, vec_id LIMIT 10""",
    "near_dup_pairs": f"SELECT a, b, round(similarity, 6) AS similarity FROM ({PAIRS_SQL}) WHERE similarity >= {LINK}",
    "near_dup_components": f"""WITH RECURSIVE e AS (SELECT a, b FROM ({PAIRS_SQL}) WHERE similarity >= {LINK}), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT a AS id, a AS seen FROM g UNION SELECT r.id, g.b FROM r JOIN g ON g.a = r.seen) SELECT id, min(seen) AS label FROM r GROUP BY id""",
    "nn_novelty": f"SELECT a AS vec_id, round(1 - max(similarity), 6) AS novelty FROM ({BOTH_SQL}) GROUP BY a",
    "curation_summary": f"""WITH n AS (SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS r FROM ({BOTH_SQL}))
        SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, round(similarity, 6) AS similarity FROM n WHERE r = 1 AND similarity >= {LINK}""",
    "pool_novelty": f"""WITH n AS (SELECT a, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC) AS r FROM ({BOTH_SQL}))
        SELECT a AS vec_id, round(1 - avg(similarity), 6) AS novelty FROM n WHERE r <= 5 GROUP BY a""",
    "class_centroid_outliers": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
        c AS (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2),
        d AS (SELECT vec_id, e.label, 1 - sum(x * m) / sqrt(sum(x * x) * sum(m * m)) AS distance FROM e JOIN c ON e.label = c.label AND e.k = c.k GROUP BY 1, 2),
        p AS (SELECT label, quantile_cont(distance, 0.97) AS cut FROM d GROUP BY 1)
        SELECT vec_id, d.label, round(distance, 6) AS distance FROM d JOIN p ON d.label = p.label WHERE distance > cut AND distance > 0.35""",
    "exact_dup_documents": """SELECT doc_id, canonical, n FROM (SELECT doc_id, min(doc_id) OVER w AS canonical, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY sha256(text))) WHERE n > 1""",
    "dedup_rate": """SELECT sum(n)::BIGINT AS total, sum(n - 1)::BIGINT AS redundant, count(*) FILTER (n > 1) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY text)""",
}

"""Queries on places: orders, suppliers, parts and customers stand at spots worked out from their amounts, in cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density, places
from ..tables import table


def spot(amount: str) -> tuple[Column, Column]:
    """Some 22 km around 12.1 north, 179.99 east: half of the spots lie across the date line."""
    cents = F.round(F.col(amount) * 100).cast("long") + 200_000
    lat = 12.0 + F.pmod(cents, F.lit(2003)) / 10_000.0
    lon = 179.89 + F.pmod(F.floor(cents / 7), F.lit(2011)) / 10_000.0
    return lat, F.when(lon > 180, lon - 360).otherwise(lon)


def spots(spark: SparkSession, d: str, name: str, key: str, amount: str, *more: Column) -> DataFrame:
    lat, lon = spot(amount)
    return table(spark, d, name).select(F.col(key).alias("id"), lat.alias("lat"), lon.alias("lon"), *more)


def nearest_place(spark: SparkSession, d: str) -> DataFrame:
    found = places.nearest(spots(spark, d, "orders", "o_orderkey", "o_totalprice"), spots(spark, d, "supplier", "s_suppkey", "s_acctbal"), 1500.0)
    return found.select("id", "other", F.round("metres", 3).alias("metres"))


def nearest_road(spark: SparkSession, d: str) -> DataFrame:
    """Each part is a straight road of its own length and direction."""
    lat, lon = spot("p_retailprice")
    roads = table(spark, d, "part").select(F.col("p_partkey").alias("id"), lat.alias("lat1"), lon.alias("lon1"), F.col("p_size"))
    roads = roads.select("id", "lat1", "lon1", (F.col("lat1") + (F.col("p_size") - 25) / 5000).alias("lat2"), (F.col("lon1") + (F.col("id") % 40 - 20) / 5000).alias("lon2"))
    found = places.nearest_line(spots(spark, d, "customer", "c_custkey", "c_acctbal"), roads, 150.0)
    return found.select("id", "line", F.round("metres", 3).alias("metres"))


def map_consensus(spark: SparkSession, d: str) -> DataFrame:
    seen = spots(spark, d, "customer", "c_custkey", "c_acctbal", F.col("c_mktsegment").alias("kind"), (F.col("c_custkey") % 89 / 100).alias("conf"))
    return places.consensus(seen, 600.0).select("seed", "kind", "n", "best", F.round("conf", 6).alias("conf"))


def wkt_centroids(spark: SparkSession, d: str) -> DataFrame:
    """A point, a line and a triangle for each supplier, written as text and read back."""
    s = spots(spark, d, "supplier", "s_suppkey", "s_acctbal")
    x, y = F.round(F.col("lon"), 4), F.round(F.col("lat"), 4)
    at = lambda dx, dy: F.concat_ws(" ", F.round(x + dx, 4).cast("string"), F.round(y + dy, 4).cast("string"))
    text = F.when(F.col("id") % 3 == 0, F.format_string("POINT(%s)", at(0, 0))).when(F.col("id") % 3 == 1, F.format_string("LINESTRING(%s, %s)", at(0, 0), at(1, 2)))
    text = text.otherwise(F.format_string("POLYGON((%s, %s, %s, %s))", at(0, 0), at(3, 0), at(0, 3), at(0, 0)))
    c = places.wkt_centroid(text)
    return s.select("id", F.round(c["x"], 4).alias("x"), F.round(c["y"], 4).alias("y"))


def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return density.density_clusters(table(spark, d, "embeddings"), radius=1.2, least=3, levels=8).select("id", F.round("core", 6).alias("core"), "cluster")


def rare_discovery(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return density.rare_rows(e, density.density_clusters(e, radius=1.2, least=3, levels=8)).select("id", "kind", F.round("score", 6).alias("score"))


QUERIES = {
    "nearest_place": nearest_place,
    "nearest_road": nearest_road,
    "map_consensus": map_consensus,
    "wkt_centroids": wkt_centroids,
    "density_clusters": density_clusters,
    "rare_discovery": rare_discovery,
}


def spot_sql(name: str, key: str, amount: str, more: str = "") -> str:
    cents = f"(round({amount} * 100)::BIGINT + 200000)"
    lon = f"(179.89::DOUBLE + (floor({cents} / 7)::BIGINT % 2011) / 10000.0::DOUBLE)"
    return f"SELECT {key} AS id, 12.0::DOUBLE + ({cents} % 2003) / 10000.0::DOUBLE AS lat, CASE WHEN {lon} > 180 THEN {lon} - 360 ELSE {lon} END AS lon {more} FROM {name}"


METRES_SQL = "2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
ORACLES = {
    "nearest_place": f"""
        WITH a AS ({spot_sql("orders", "o_orderkey", "o_totalprice")}), b AS ({spot_sql("supplier", "s_suppkey", "s_acctbal")}),
        p AS (SELECT a.id, b.id AS other, {METRES_SQL} AS metres FROM a, b),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, other) AS r FROM p WHERE metres <= 1500)
        SELECT a.id, r.other, round(r.metres, 3) AS metres FROM a LEFT JOIN r ON r.id = a.id AND r.r = 1
    """,
    "nearest_road": f"""
        WITH a AS ({spot_sql("customer", "c_custkey", "c_acctbal")}), q AS ({spot_sql("part", "p_partkey", "p_retailprice", ", p_size")}),
        b AS (SELECT id AS line, lat AS la, lon AS oa, lat + (p_size - 25) / 5000 AS lb, lon + (id % 40 - 20) / 5000 AS ob FROM q),
        f AS (SELECT a.id, line, (la - lat) * 111320 AS y1, (lb - lat) * 111320 AS y2, cos(radians(lat)) * 111320 AS c,
                     oa - lon + CASE WHEN oa - lon > 180 THEN -360 WHEN oa - lon < -180 THEN 360 ELSE 0 END AS d, ob - oa AS e FROM a, b),
        g AS (SELECT *, d * c AS x1, (d + e) * c AS x2 FROM f),
        h AS (SELECT *, CASE WHEN pow(x2 - x1, 2) + pow(y2 - y1, 2) > 0 THEN least(greatest(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1) ELSE 0 END AS t FROM g),
        m AS (SELECT id, line, sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) AS metres FROM h),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, line) AS r FROM m WHERE metres <= 150)
        SELECT a.id, r.line, round(r.metres, 3) AS metres FROM a LEFT JOIN r ON r.id = a.id AND r.r = 1
    """,
    "map_consensus": f"""
        WITH RECURSIVE e AS ({spot_sql("customer", "c_custkey", "c_acctbal", ", c_mktsegment AS kind, c_custkey % 89 / 100 AS conf")}),
        p AS (SELECT a.id, b.id AS other FROM e a, e b WHERE a.kind = b.kind AND b.id < a.id AND {METRES_SQL} <= 600),
        n AS (SELECT e.kind, e.id, coalesce(list(other ORDER BY other) FILTER (other IS NOT NULL), []) AS before, row_number() OVER (PARTITION BY e.kind ORDER BY e.id) AS step
              FROM e LEFT JOIN p ON p.id = e.id GROUP BY e.kind, e.id),
        walk AS (SELECT DISTINCT kind, 0::BIGINT AS step, []::BIGINT[] AS seeds, NULL::BIGINT AS id, NULL::BIGINT AS seed FROM e
                 UNION ALL
                 SELECT w.kind, n.step, CASE WHEN list_has_any(n.before, w.seeds) THEN w.seeds ELSE list_append(w.seeds, n.id) END, n.id,
                        coalesce(list_min(list_intersect(n.before, w.seeds)), n.id)
                 FROM walk w JOIN n ON n.kind = w.kind AND n.step = w.step + 1)
        SELECT seed, e.kind, count(*) AS n, arg_max(e.id, [conf, -e.id]) AS best, round(least(0.99, avg(conf) * (1 + 0.1 * (count(*) - 1))), 6) AS conf
        FROM walk JOIN e ON e.id = walk.id GROUP BY ALL
    """,
    "wkt_centroids": f"""
        WITH s AS ({spot_sql("supplier", "s_suppkey", "s_acctbal")})
        SELECT id, round(round(lon, 4) + CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE 1 END, 4) AS x, round(round(lat, 4) + CASE id % 3 WHEN 0 THEN 0 ELSE 1 END, 4) AS y FROM s
    """,
}

"""Queries that select, facet, count and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import facets as FA
from ..operators import predicate as P
from ..operators import sets
from ..tables import events, frames, objects, sessions, table

PREDICATE = {"states": ["A", "R"], "sources": ["F"], "min_conf": 0.2, "max_conf": 0.7}
FRAME_PREDICATE = {"weather": ["1-URGENT", "2-HIGH"], "states": ["R"], "min_conf": 0.9}
VOCABULARY = {
    "english": ("lang", ["en"]), "german": ("lang", ["de"]), "french": ("lang", ["fr"]), "first_sources": ("source", ["src0", "src1", "src2"]),
}

OBJECTS_SQL = """
    SELECT l_orderkey AS frame_id, l_partkey AS class_id, l_linenumber AS number, l_returnflag AS state,
           l_linestatus AS source, round(l_discount * 10, 6) AS conf, p_type AS l1, p_brand AS class_name,
           l_suppkey AS track_id, l_quantity AS width, l_extendedprice AS height
    FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def predicate_objects(spark: SparkSession, d: str) -> DataFrame:
    found = P.select_objects(objects(spark, d), frames(spark, d), sessions(spark, d), PREDICATE)
    return found.groupBy("l1", "state").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("conf"), 4).alias("sum_conf"))


def predicate_frames_exists(spark: SparkSession, d: str) -> DataFrame:
    found = P.select_frames(objects(spark, d), frames(spark, d), sessions(spark, d), FRAME_PREDICATE)
    return found.select("frame_id", "session_id")


def predicate_city_objects(spark: SparkSession, d: str) -> DataFrame:
    found = P.select_objects(objects(spark, d), frames(spark, d), sessions(spark, d), {"cities": ["NATION_3", "NATION_7"], "states": ["N"]})
    return found.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


def dsl_load(spark: SparkSession, d: str) -> DataFrame:
    predicate, _ = P.compile_terms("english, german AND first sources", VOCABULARY)
    docs = table(spark, d, "documents")
    for column, values in predicate.items():
        docs = docs.where(F.col(column).isin(values))
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic")


def facets_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    facets = {
        "class": ("class_name", F.col("class_name").isin("Brand#11", "Brand#12", "Brand#21", "Brand#33")),
        "state": ("state", F.col("state").isin("A", "N")),
        "source": ("source", F.col("source") == "O"),
        "l1": ("l1", F.lit(True)),
    }
    return FA.leave_one_out(objects(spark, d), facets)


def conf_histogram(spark: SparkSession, d: str) -> DataFrame:
    return FA.histogram(objects(spark, d), "conf")


def tag_facet(spark: SparkSession, d: str) -> DataFrame:
    return FA.tag_counts(table(spark, d, "part"), F.split("p_type", " "))


def class_distribution_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("class_id"))
    return FA.zero_filled(parts, objects(spark, d).where("conf >= 0.9 AND state = 'R'"), "class_id")


def state_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return FA.mix_percent(objects(spark, d), "state", "source")


def rollup_overview(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def cube_scene(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def grouping_sets_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("hot", F.col("value") > 50)
    return e.groupingSets([["kind"], ["hot"], []], "kind", "hot").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"))


def pivot_board(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("session_id").pivot("kind", ["view", "click", "purchase", "signup", "error"]).count().fillna(0)


def frames_without_objects(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).join(table(spark, d, "lineitem"), F.col("frame_id") == F.col("l_orderkey"), "left_anti").select("frame_id", "session_id")


def frame_stats_outer(spark: SparkSession, d: str) -> DataFrame:
    kept = objects(spark, d).where("state <> 'R'").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("max_conf"))
    return frames(spark, d).select("frame_id").join(kept, "frame_id", "left").fillna(0, ["n"])


def relational_division(spark: SparkSession, d: str) -> DataFrame:
    wanted = ["A", "N", "R"]
    found = objects(spark, d).where(F.col("state").isin(wanted)).groupBy("frame_id").agg(F.count_distinct("state").alias("k"))
    return found.where(F.col("k") == len(wanted)).select("frame_id")


def growth_cumulative(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("total", F.sum("n").over(Window.orderBy("month")))


def median_scorecard(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.groupBy("c_mktsegment").agg(F.round(F.median("c_acctbal"), 4).alias("median"), F.round(F.percentile("c_acctbal", 0.9), 4).alias("p90"), F.count(F.lit(1)).alias("n"))


def upper_median_frames(spark: SparkSession, d: str) -> DataFrame:
    return FA.upper_median(objects(spark, d).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")), "n")


def idf_rarity(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").count()
    return FA.idf(objects(spark, d), "l1", "frame_id", n)


def frame_rarity_rank(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    rare = FA.idf(o, "class_name", "frame_id", table(spark, d, "orders").count())
    best = o.join(F.broadcast(rare), "class_name").groupBy("frame_id").agg(F.max("idf").alias("rarity"))
    return best.orderBy(F.desc("rarity"), "frame_id").limit(50)


def odd_gaps(spark: SparkSession, d: str) -> DataFrame:
    cells = frames(spark, d).groupBy(F.concat_ws("_", "scene.weather", "scene.time_of_day").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    target = cells.select("cell").withColumn("target", F.when(F.col("cell").endswith("P"), 2.0).otherwise(1.0))
    target = target.withColumn("target", F.col("target") / F.sum("target").over(Window.partitionBy()))
    return target.join(cells, "cell").withColumn("gap", F.round(F.col("target") - F.col("share"), 6)).where("gap > 0.02").select("cell", "n", "gap")


def starvation_demands(spark: SparkSession, d: str) -> DataFrame:
    total = objects(spark, d).count()
    counts = FA.zero_filled(table(spark, d, "part").select(F.col("p_brand").alias("class_name")), objects(spark, d), "class_name")
    return counts.withColumn("short", F.round(F.lit(0.04) - F.col("n") / total, 6)).where("short > 0")


def topk_per_kind(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("kind").orderBy(F.col("value").desc_nulls_last(), "event_id")
    return events(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("kind", "rank", "event_id", "value")


def topk_page(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).orderBy(F.col("value").desc_nulls_last(), "t", "event_id").offset(20).limit(20).select("event_id", "value")


def stratified_sample_hash(spark: SparkSession, d: str) -> DataFrame:
    return sets.hash_sample(events(spark, d), "kind", "event_id", 10).select("kind", "event_id")


def largest_remainder_budget(spark: SparkSession, d: str) -> DataFrame:
    weights = events(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("w"))
    return sets.largest_remainder(weights, "w", 997, "kind").select("kind", "share")


def text_contains_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = ["licensed", "token", "password"]
    hits = sum(F.lower("text").contains(w).cast("int") for w in words)
    return docs.withColumn("hits", hits).where("hits > 0").select("doc_id", F.col("hits").cast("long").alias("hits"))


def html_title_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("n"))


def turn_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return events(spark, d).groupBy("kind").agg(F.sum(k).alias("sum_k"), F.max(k).cast("long").alias("max_k"))


def scorecard_wilson(spark: SparkSession, d: str) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count(F.when(F.col("state") == "N", 1))
    cards = objects(spark, d).groupBy("track_id").agg(n.alias("n"), ok.alias("ok")).withColumn("w", S.wilson(F.col("ok"), F.col("n")))
    return cards.select("track_id", "n", "ok", "w.p", "w.lo", "w.hi", (F.col("n") >= 25).alias("proven"))


def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    pairs = objects(spark, d).where("conf >= 0.8").select("frame_id", "l1").distinct()
    other = pairs.withColumnRenamed("l1", "b")
    return pairs.withColumnRenamed("l1", "a").join(other, "frame_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def coverage_join(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("audited"), F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("coverage"))


QUERIES = {f.__name__: f for f in (
    predicate_objects, predicate_frames_exists, predicate_city_objects, dsl_load, facets_leave_one_out, conf_histogram, tag_facet,
    class_distribution_zero_filled, state_source_mix, rollup_overview, cube_scene, grouping_sets_kinds, pivot_board, frames_without_objects,
    frame_stats_outer, relational_division, growth_cumulative, median_scorecard, upper_median_frames, idf_rarity, frame_rarity_rank, odd_gaps,
    starvation_demands, topk_per_kind, topk_page, stratified_sample_hash, largest_remainder_budget, text_contains_rank, html_title_extract,
    turn_stats, json_props, scorecard_wilson, co_occurrence, coverage_join,
)}

ORACLES = {
    "predicate_objects": f"""SELECT l1, state, count(*) AS n, round(sum(conf), 4) AS sum_conf FROM ({OBJECTS_SQL})
        WHERE state IN ('A', 'R') AND source = 'F' AND conf >= 0.2 AND conf <= 0.7 GROUP BY l1, state""",
    "predicate_frames_exists": f"""SELECT o_orderkey AS frame_id, o_custkey AS session_id FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND EXISTS (
            SELECT 1 FROM ({OBJECTS_SQL}) x WHERE x.frame_id = o_orderkey AND state = 'R' AND conf >= 0.9)""",
    "predicate_city_objects": f"""SELECT class_name, count(*) AS n FROM ({OBJECTS_SQL}) x JOIN orders ON o_orderkey = frame_id
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
        WHERE n_name IN ('NATION_3', 'NATION_7') AND state = 'N' GROUP BY class_name""",
    "dsl_load": """SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        WHERE lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2')""",
    "facets_leave_one_out": f"""WITH o AS ({OBJECTS_SQL}),
        c AS (SELECT *, class_name IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#33') AS k, state IN ('A', 'N') AS s, source = 'O' AS u FROM o),
        f AS (SELECT 'class' AS facet, class_name AS value FROM c WHERE s AND u
              UNION ALL SELECT 'state', state FROM c WHERE k AND u UNION ALL SELECT 'source', source FROM c WHERE k AND s
              UNION ALL SELECT 'l1', l1 FROM c WHERE k AND s AND u)
        SELECT facet, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY facet, value""",
    "conf_histogram": f"""SELECT low, high, count(conf) AS n FROM (VALUES (0.0::DOUBLE, 0.3::DOUBLE), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.01)) b(low, high)
        LEFT JOIN ({OBJECTS_SQL}) x ON conf >= low AND conf < high GROUP BY low, high""",
    "tag_facet": """SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY tag ORDER BY n DESC, tag LIMIT 100""",
    "class_distribution_zero_filled": f"""SELECT p_partkey AS class_id, count(x.class_id) AS n FROM part
        LEFT JOIN (SELECT * FROM ({OBJECTS_SQL}) WHERE conf >= 0.9 AND state = 'R') x ON x.class_id = p_partkey GROUP BY p_partkey""",
    "state_source_mix": f"""SELECT state, source, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM ({OBJECTS_SQL}) GROUP BY state, source""",
    "rollup_overview": """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""",
    "cube_scene": """SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping_id(o_orderpriority, o_orderstatus)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""",
    "grouping_sets_kinds": """SELECT kind, hot, count(*) AS n, count(DISTINCT user_id) AS sessions FROM (SELECT event_type AS kind, value > 50 AS hot, user_id FROM events)
        GROUP BY GROUPING SETS ((kind), (hot), ())""",
    "pivot_board": """SELECT user_id AS session_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click,
        count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error
        FROM events GROUP BY user_id""",
    "frames_without_objects": """SELECT o_orderkey AS frame_id, o_custkey AS session_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "frame_stats_outer": f"""SELECT o_orderkey AS frame_id, count(x.frame_id) AS n, max(conf) AS max_conf FROM orders
        LEFT JOIN ({OBJECTS_SQL}) x ON x.frame_id = o_orderkey AND state <> 'R' GROUP BY o_orderkey""",
    "relational_division": """SELECT l_orderkey AS frame_id FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3""",
    "growth_cumulative": """SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, (sum(count(*)) OVER (ORDER BY date_trunc('month', o_orderdate)))::BIGINT AS total
        FROM orders GROUP BY date_trunc('month', o_orderdate)""",
    "median_scorecard": """SELECT c_mktsegment, round(median(c_acctbal), 4) AS median, round(quantile_cont(c_acctbal, 0.9), 4) AS p90, count(*) AS n FROM customer GROUP BY c_mktsegment""",
    "upper_median_frames": """WITH c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey),
        r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS total FROM c) SELECT n AS median FROM r WHERE k = total // 2""",
    "idf_rarity": f"""SELECT l1, count(DISTINCT frame_id) AS n, round(ln(((SELECT count(*) FROM orders) + 1.0) / (count(DISTINCT frame_id) + 1)) / ln((SELECT count(*) FROM orders) + 1.0), 6) AS idf
        FROM ({OBJECTS_SQL}) GROUP BY l1""",
    "frame_rarity_rank": f"""WITH o AS ({OBJECTS_SQL}), i AS (SELECT class_name, round(ln(((SELECT count(*) FROM orders) + 1.0) / (count(DISTINCT frame_id) + 1)) / ln((SELECT count(*) FROM orders) + 1.0), 6) AS idf
        FROM o GROUP BY class_name) SELECT frame_id, max(idf) AS rarity FROM o JOIN i USING (class_name) GROUP BY frame_id ORDER BY rarity DESC, frame_id LIMIT 50""",
    "odd_gaps": """WITH c AS (SELECT o_orderpriority || '_' || o_orderstatus AS cell, count(*) AS n FROM orders GROUP BY 1),
        t AS (SELECT cell, n, n / sum(n) OVER () AS share, CASE WHEN cell LIKE '%P' THEN 2.0 ELSE 1.0 END AS w FROM c),
        g AS (SELECT cell, n, round((w::DOUBLE / sum(w::DOUBLE) OVER ()) - share, 6) AS gap FROM t) SELECT * FROM g WHERE gap > 0.02""",
    "starvation_demands": """WITH c AS (SELECT p_brand AS class_name, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand)
        SELECT class_name, n, short FROM (SELECT *, round(0.04::DOUBLE - n / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS short FROM c) WHERE short > 0""",
    "topk_per_kind": """SELECT kind, rank, event_id, value FROM (SELECT event_type AS kind, event_id, value,
        row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id)::INTEGER AS rank FROM events) WHERE rank <= 5""",
    "topk_page": """SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, ts, event_id LIMIT 20 OFFSET 20""",
    "stratified_sample_hash": """SELECT kind, event_id FROM (SELECT event_type AS kind, event_id,
        row_number() OVER (PARTITION BY event_type ORDER BY sha256('s' || event_id::VARCHAR)) AS r FROM events) WHERE r <= 10""",
    "largest_remainder_budget": """WITH w AS (SELECT event_type AS kind, count(*)::DOUBLE AS w FROM events GROUP BY 1), e AS (SELECT kind, 997 * w / sum(w) OVER () AS x FROM w),
        f AS (SELECT kind, floor(x)::BIGINT AS share, row_number() OVER (ORDER BY x - floor(x) DESC, kind) AS r, 997 - sum(floor(x)) OVER () AS spare FROM e)
        SELECT kind, (share + CASE WHEN r <= spare THEN 1 ELSE 0 END)::BIGINT AS share FROM f""",
    "text_contains_rank": """SELECT doc_id, hits FROM (SELECT doc_id, (contains(lower(text), 'licensed')::INT + contains(lower(text), 'token')::INT + contains(lower(text), 'password')::INT)::BIGINT AS hits
        FROM documents) WHERE hits > 0""",
    "html_title_extract": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages""",
    "turn_stats": """SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, arg_max(role, turn) AS last_role, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""",
    "json_props": """SELECT event_type AS kind, sum((props->>'$.k')::INT)::BIGINT AS sum_k, max((props->>'$.k')::INT)::BIGINT AS max_k FROM events GROUP BY 1""",
    "scorecard_wilson": """WITH c AS (SELECT l_suppkey AS track_id, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS ok FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
        w AS (SELECT *, ok / n::DOUBLE AS p0, (ok / n::DOUBLE + 3.841458881296 / (2 * n)) / (1 + 3.841458881296 / n) AS centre FROM c),
        h AS (SELECT *, 1.959964::DOUBLE * sqrt(p0 * (1 - p0) / n + 3.841458881296::DOUBLE / (4.0::DOUBLE * n * n)) / (1 + 3.841458881296 / n) AS half FROM w)
        SELECT track_id, n, ok, round(p0, 4) AS p, round(greatest(0, centre - half), 4) AS lo, round(least(1, centre + half), 4) AS hi, n >= 25 AS proven FROM h""",
    "co_occurrence": f"""WITH p AS (SELECT DISTINCT frame_id, l1 FROM ({OBJECTS_SQL}) WHERE conf >= 0.8)
        SELECT x.l1 AS a, y.l1 AS b, count(*) AS n FROM p x JOIN p y ON x.frame_id = y.frame_id AND x.l1 < y.l1 GROUP BY 1, 2""",
    "coverage_join": """SELECT source, count(*) AS n, count(quality) AS audited, round(count(quality) / count(*), 6) AS coverage
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""",
}

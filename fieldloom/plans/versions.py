"""Queries over versions, splits, seals, lineage and published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as GR
from ..operators import history as H
from ..operators import predicate as P
from ..operators import sets
from ..sources import export, lake
from ..tables import events, frames, objects, sessions, table
from .selection import OBJECTS_SQL
from .timelines import EVENTS_SQL


def commit_diff(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    a, b = o.where("conf >= 0.8 AND state <> 'R'"), o.where("conf >= 0.85")
    return sets.commit_diff(a, b, "frame_id").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def class_delta(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    return sets.histogram_delta(o.where("conf >= 0.8"), o.where("conf >= 0.5 AND state = 'A'"), "class_name")


def union_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where("lang = 'fr'").select("doc_id").union(docs.where(F.col("text").contains("token")).select("doc_id")).distinct()


def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    a, n, r = (o.where(F.col("state") == s).select("frame_id").distinct() for s in "ANR")
    return a.intersect(n).subtract(r)


def reconcile_actions(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("evidence", F.round("value", 2))
    keys = ["kind", "session_id", "t"]
    old = e.where(F.col("event_id") % 3 != 0).select(*keys, "evidence", (F.col("event_id") % 7 == 0).alias("ruled"))
    new = e.where(F.col("event_id") % 4 != 0).select(*keys, F.when(F.col("event_id") % 5 == 0, F.col("evidence") + 1).otherwise(F.col("evidence")).alias("evidence"))
    return sets.reconcile(old, new, keys, "evidence", "ruled").groupBy("kind", "action").agg(F.count(F.lit(1)).alias("n"))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("session_id", "kind", "t", "value")
    return sets.upsert(e.where("value < 50"), e.where("value >= 50"), ["session_id", "kind"], "t").select("session_id", "kind", "t")


def bulk_tags(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("tags", F.array(F.col("p_type"), F.col("p_brand")))
    return parts.select("p_partkey", F.array_join(sets.retag("tags", ["checked", "new"], ["Brand#11", "Brand#12"]), ",").alias("tags"))


def split_assign(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d).join(frames(spark, d).select("frame_id", "session_id"), "frame_id")
    return sets.assign_splits(o, "session_id", 0.1, 0.1)


def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    o = frames(spark, d).withColumn("split", F.when(F.col("frame_id") % 10 < 8, "train").otherwise("val"))
    return sets.leaking(o, "session_id", "split")


def split_shares(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("session_id").distinct().select("session_id", F.round(sets.hash_share("0", "session_id"), 9).alias("share"))


def seal_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sets.fingerprint(docs, ["doc_id", "lang", "text"], "lang")


def lineage_walk(spark: SparkSession, d: str) -> DataFrame:
    """Regions to nations to sessions to frames: all that stands above some frames, with the distance."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = [
        table(spark, d, "nation").select(tag("n", "n_nationkey").alias("child"), tag("r", "n_regionkey").alias("parent")),
        table(spark, d, "customer").select(tag("c", "c_custkey").alias("child"), tag("n", "c_nationkey").alias("parent")),
        table(spark, d, "orders").select(tag("o", "o_orderkey").alias("child"), tag("c", "o_custkey").alias("parent")),
    ]
    start = [f"o{r['o_orderkey']}" for r in table(spark, d, "orders").orderBy("o_orderkey").limit(5).collect()]
    return GR.ancestors(edges[0].union(edges[1]).union(edges[2]), start).select("id", F.col("depth").cast("long").alias("depth"))


def lineage_recursive(spark: SparkSession, d: str) -> DataFrame:
    """The same walk as a recursive query, downward from one region."""
    for name in ("nation", "customer"):
        table(spark, d, name).createOrReplaceTempView(f"lineage_{name}")
    return spark.sql("""
        WITH RECURSIVE edges AS (
            SELECT concat('r', n_regionkey) AS parent, concat('n', n_nationkey) AS child FROM lineage_nation
            UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM lineage_customer),
        walk AS (SELECT 'r1' AS id, 0 AS depth UNION ALL SELECT child, depth + 1 FROM walk JOIN edges ON parent = id)
        SELECT depth, count(*) AS n FROM walk GROUP BY depth
    """)


def lake_labels(spark: SparkSession, d: str) -> DataFrame:
    o = lake.labels(objects(spark, d), frames(spark, d))
    return o.groupBy("class_name", "state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


def shard_index(spark: SparkSession, d: str) -> DataFrame:
    return lake.shard_index(objects(spark, d).where("conf >= 0.5"), "frame_id")


def export_records(spark: SparkSession, d: str) -> DataFrame:
    found = objects(spark, d).join(frames(spark, d), "frame_id").join(sessions(spark, d), "session_id").where("conf >= 0.9 AND state = 'A'")
    return found.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.min("frame_id").alias("first"), F.round(F.avg("quality"), 0).alias("quality"))


def training_set(spark: SparkSession, d: str) -> DataFrame:
    """No gold frames, and at most 50 objects a class, by hash."""
    o = objects(spark, d)
    gold = o.where("conf >= 0.95").select("frame_id").distinct()
    free = o.join(gold, "frame_id", "left_anti").withColumn("key", F.concat_ws("-", "frame_id", "number", "class_id", "track_id", "width", "height"))
    return sets.hash_sample(free, "class_name", "key", 50).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frame_id").alias("frames"))


def latest_per_session(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("session_id").agg(F.max_by(F.struct("event_id", "kind"), F.struct("t", "event_id")).alias("x")).select("session_id", "x.event_id", "x.kind")


def retention_erase(spark: SparkSession, d: str) -> DataFrame:
    gone = sessions(spark, d).where("session_id % 50 = 0").select("session_id")
    kept = frames(spark, d).join(gone, "session_id", "left_anti")
    left = objects(spark, d).join(kept, "frame_id", "left_semi")
    return left.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def unsupported_terms(spark: SparkSession, d: str) -> DataFrame:
    """What a predicate asks that objects alone can't answer."""
    asked = {"states": ["A"], "cities": ["x"], "weather": ["y"]}
    return spark.createDataFrame([(k, k in P.OBJECT_CLAUSES) for k in sorted(asked)], "clause string, supported boolean")


def incident_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events of one kind and session within a gap of each other are one incident, with all their evidence."""
    w = Window.partitionBy("session_id", "kind").orderBy("t", "event_id")
    e = events(spark, d).withColumn("fresh", F.when(F.col("t") - F.lag("t").over(w) <= 86_400_000_000, 0).otherwise(1))
    e = e.withColumn("incident", F.sum("fresh").over(w))
    return e.groupBy("session_id", "kind", "incident").agg(F.min("t").alias("first"), F.count(F.lit(1)).alias("evidence")).drop("incident")


def three_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A base of parts, and two branches: one reprices and drops small ones, the other renames, drops cheap ones and adds."""
    base = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    ours = base.where("p_size > 3").withColumn("p_retailprice", F.when(F.col("p_size") > 30, F.col("p_retailprice") + 10).otherwise(F.col("p_retailprice")))
    theirs = base.where("p_retailprice > 950").withColumn("p_brand", F.when(F.col("p_size") > 40, "Brand#0").otherwise(F.col("p_brand")))
    added = base.where("p_size = 1").withColumn("p_partkey", -F.col("p_partkey") - 1)
    return base, ours, theirs.unionByName(added)


def merge_outcomes(spark: SparkSession, d: str) -> DataFrame:
    found = H.merged(*three_states(spark, d), "p_partkey")
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"), F.count("result").alias("left"), F.round(F.sum("result.p_retailprice"), 2).alias("price"))


def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    found = H.merged(*three_states(spark, d), "p_partkey").where("outcome = 'conflict'")
    return found.select("p_partkey", F.col("ours.p_retailprice").alias("our_price"), F.col("theirs.p_brand").alias("their_brand"))


def revert_merge(spark: SparkSession, d: str) -> DataFrame:
    """A merge is applied, some rows are edited after it, and the merge is taken back: edited rows stay."""
    base, ours, theirs = three_states(spark, d)
    merge = H.restored(H.merged(base, ours, theirs, "p_partkey"), "p_partkey", "result", ours.columns)
    log = H.changes(ours, merge, "p_partkey")
    edited = merge.withColumn("p_size", F.when((F.col("p_size") == 1) & (F.col("p_partkey") % 2 == 0), 2).otherwise(F.col("p_size")))
    back, outcomes = H.reverted(edited, log, "p_partkey")
    seal = sets.fingerprint(back.withColumn("p_retailprice", F.round(F.col("p_retailprice") * 100).cast("long")), ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]).select("seal", F.col("n").alias("rows"))
    return outcomes.groupBy("op", "outcome").agg(F.count(F.lit(1)).alias("n")).crossJoin(seal)  # one row


def vocabulary_log(spark: SparkSession, d: str) -> DataFrame:
    """Brands merged, renamed and retired, as a log of what changed."""
    base = three_states(spark, d)[0]
    _, log = H.recoded(base, "p_partkey", "p_brand", {"Brand#11": "Brand#12", "Brand#21": "Brand#99", "Brand#33": None})
    return log.select("p_partkey", "op", F.col("before.p_brand").alias("was"), F.col("after.p_brand").alias("now"))


def lake_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows, ids and nulls of the three published tables, each under its declared schema. Labels and quality share one
    pass over the objects, dealt once by their frames and once by their ids."""
    o = objects(spark, d).join(frames(spark, d).join(sessions(spark, d), "session_id"), "frame_id")
    keyed = o.withColumn("object_id", F.concat_ws("-", "frame_id", "number", "class_id", "track_id"))
    e = events(spark, d)
    reviews = e.where("kind IN ('click', 'purchase')").select(F.col("event_id").alias("review_id"), F.col("session_id").alias("reviewer"), F.col("kind").alias("action"), (F.col("t") * 1000).alias("ts_ns"), F.col("value").alias("time_spent_ms"), F.lit("review").alias("before_state"), F.when(F.col("kind") == "click", "accepted").alias("after_state"))

    def nulls(df: DataFrame) -> Column:
        return sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))

    labels = lake.conform(keyed.withColumns({"vehicle_id": F.col("vehicle"), "bbox_x1": F.lit(0.0), "bbox_x2": F.col("width"), "bbox_y1": F.lit(0.0), "bbox_y2": F.col("height")}), lake.TABLES["labels"])
    each = labels.select("object_id", "conf", "state", nulls(labels).alias("_nulls")).groupBy("object_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_nulls").alias("_nulls"), F.avg("conf").alias("quality"), F.collect_set(F.when(F.col("state") == "R", "returned")).alias("flags"),
    )
    quality = lake.conform(each, lake.TABLES["quality"])
    both = each.select("object_id", "_n", "_nulls", *(F.col(c).cast(quality.schema[c].dataType) if c in each.columns else F.lit(None).alias(c) for c in quality.columns if c != "object_id"))
    both = both.agg(F.sum("_n").alias("n"), F.count("object_id").alias("ids"), F.sum("_nulls").alias("nulls"), F.count(F.lit(1)).alias("n_quality"), F.sum(nulls(both.select(*quality.columns))).alias("nulls_quality"))
    row = lambda name, n, ids, missing: F.struct(F.lit(name).alias("name"), F.lit(len(lake.TABLES[name].names)).alias("columns"), F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.col(ids).alias("ids"), F.col(missing).alias("nulls"))
    out = both.select(F.inline(F.array(row("labels", "n", "ids", "nulls"), row("quality", "n_quality", "ids", "nulls_quality"))))
    table_of = lake.conform(reviews, lake.TABLES["provenance"])
    found = table_of.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(table_of.columns[0]).alias("ids"), F.sum(nulls(table_of)).alias("nulls"))
    return out.unionByName(found.select(F.lit("provenance").alias("name"), F.lit(len(table_of.columns)).alias("columns"), "*"))


def export_digests(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the full records of accepted objects: how many each holds, and how many record columns are set."""
    o = objects(spark, d).where("state = 'A'").join(frames(spark, d), "frame_id").join(sessions(spark, d), "session_id")
    rows = export.records(o.select(
        F.concat_ws("-", "frame_id", "number", "class_id", "track_id").alias("object_id"), "frame_id", "session_id", "track_id", "class_id", "class_name", "conf", "state", "source", "city",
        F.col("vehicle").alias("vehicle_id"), F.col("quality").alias("quality_score"), F.struct("scene").alias("attrs"), F.col("height").alias("bbox_y2"), F.col("width").alias("bbox_x2"),
    ))
    chunk = F.pmod(F.col("frame_id").cast("long"), F.lit(16))
    some = sets.fingerprint(rows.withColumn("chunk", chunk), ["object_id", "frame_id", "session_id", "class_id", "class_name", "state", "split"], "chunk")
    return some.select("chunk", "n", F.col("seal").alias("digest"))


QUERIES = {f.__name__: f for f in (
    merge_outcomes, merge_conflicts, revert_merge, vocabulary_log, lake_tables, export_digests, commit_diff, class_delta, union_candidates, intersect_except, reconcile_actions, upsert_latest, bulk_tags, split_assign, split_leakage, split_shares,
    seal_fingerprint, lineage_walk, lineage_recursive, lake_labels, shard_index, export_records, training_set, latest_per_session, retention_erase,
    unsupported_terms, incident_dedup,
)}

STATES_SQL = """b AS (SELECT p_partkey AS k, p_brand, p_type, p_size, p_retailprice FROM part),
    o AS (SELECT k, p_brand, p_type, p_size, p_retailprice + CASE WHEN p_size > 30 THEN 10 ELSE 0 END AS p_retailprice FROM b WHERE p_size > 3),
    t AS (SELECT k, CASE WHEN p_size > 40 THEN 'Brand#0' ELSE p_brand END AS p_brand, p_type, p_size, p_retailprice FROM b WHERE p_retailprice > 950
          UNION ALL SELECT -k - 1, p_brand, p_type, p_size, p_retailprice FROM b WHERE p_size = 1),
    m AS (SELECT coalesce(b.k, o.k, t.k) AS k, CASE WHEN b.k IS NOT NULL THEN b END AS b, CASE WHEN o.k IS NOT NULL THEN o END AS o, CASE WHEN t.k IS NOT NULL THEN t END AS t
          FROM b FULL JOIN o ON b.k = o.k FULL JOIN t ON t.k = coalesce(b.k, o.k)),
    x AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM b AND t IS NOT DISTINCT FROM b THEN 'kept' WHEN t IS NOT DISTINCT FROM b THEN 'ours' WHEN o IS NOT DISTINCT FROM b THEN 'theirs'
                         WHEN o IS NOT DISTINCT FROM t THEN 'both' ELSE 'conflict' END AS outcome FROM m),
    r AS (SELECT *, CASE WHEN outcome = 'theirs' THEN t ELSE o END AS r FROM x)"""
ORACLES = {
    "merge_outcomes": f"WITH {STATES_SQL} SELECT outcome, count(*) AS n, sum(k)::BIGINT AS keys, count(r) AS \"left\", round(sum(r.p_retailprice), 2) AS price FROM r GROUP BY 1",
    "merge_conflicts": f"WITH {STATES_SQL} SELECT k AS p_partkey, o.p_retailprice AS our_price, t.p_brand AS their_brand FROM r WHERE outcome = 'conflict'",
    "revert_merge": f"""WITH {STATES_SQL}, l AS (SELECT k, o, r, CASE WHEN o IS NULL THEN 'insert' WHEN r IS NULL THEN 'delete' ELSE 'update' END AS op FROM r WHERE o IS DISTINCT FROM r),
        c AS (SELECT op, CASE WHEN r.p_size = 1 AND k % 2 = 0 THEN 'skipped' ELSE 'reverted' END AS outcome, count(*) AS n FROM l GROUP BY 1, 2),
        s AS (SELECT k, CASE WHEN r.p_size = 1 AND k % 2 = 0 THEN r ELSE o END AS v, CASE WHEN r.p_size = 1 AND k % 2 = 0 THEN 2 ELSE o.p_size END::VARCHAR AS size FROM r),
        z AS (SELECT k::VARCHAR AS k, v.p_brand AS a, v.p_type AS b, size, round(v.p_retailprice * 100)::BIGINT::VARCHAR AS p FROM s WHERE v IS NOT NULL),
        h AS (SELECT sha256(length(k) || ':' || k || length(a) || ':' || a || length(b) || ':' || b || length(size) || ':' || size || length(p) || ':' || p) AS h FROM z),
        g AS (SELECT h[1:3] AS bucket, h || 'x' || count(*) AS h, count(*) AS n FROM h GROUP BY h.h),
        f AS (SELECT bucket, sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n) AS n FROM g GROUP BY 1)
        SELECT c.*, sha256((SELECT string_agg(h, '' ORDER BY h) FROM f))[1:16] AS seal, (SELECT sum(n)::BIGINT FROM f) AS rows FROM c""",
    "vocabulary_log": """SELECT p_partkey, 'update' AS op, p_brand AS was, CASE p_brand WHEN 'Brand#11' THEN 'Brand#12' WHEN 'Brand#21' THEN 'Brand#99' END AS now
        FROM part WHERE p_brand IN ('Brand#11', 'Brand#21', 'Brand#33')""",
    "lake_tables": f"""WITH o AS (SELECT *, frame_id || '-' || number || '-' || class_id || '-' || track_id AS object_id FROM ({OBJECTS_SQL})),
        e AS (SELECT * FROM ({EVENTS_SQL}) WHERE kind IN ('click', 'purchase'))
        SELECT 'labels' AS name, 18 AS columns, count(*) AS n, count(DISTINCT object_id) AS ids, 3 * count(*) AS nulls FROM o
        UNION ALL SELECT 'provenance', 11, count(*), count(DISTINCT event_id), 4 * count(*) + count(*) FILTER (kind = 'purchase') FROM e
        UNION ALL SELECT 'quality', 5, count(DISTINCT object_id), count(DISTINCT object_id), 2 * count(DISTINCT object_id) FROM o""",
    "export_digests": f"""WITH r AS (SELECT frame_id % 16 AS chunk, [frame_id || '-' || number || '-' || class_id || '-' || track_id, frame_id::VARCHAR, o_custkey::VARCHAR, class_id::VARCHAR, class_name, state, 'train'] AS v
              FROM ({OBJECTS_SQL}) x JOIN orders ON o_orderkey = frame_id WHERE state = 'A'),
        h AS (SELECT chunk, sha256(array_to_string(list_transform(v, lambda x: length(x) || ':' || x), '')) AS h FROM r),
        g AS (SELECT chunk, h[1:3] AS bucket, h || 'x' || count(*) AS h, count(*) AS n FROM h GROUP BY chunk, h.h),
        f AS (SELECT chunk, bucket, sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n) AS n FROM g GROUP BY 1, 2)
        SELECT chunk, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY h))[1:16] AS digest FROM f GROUP BY 1""",
    "commit_diff": f"""WITH o AS ({OBJECTS_SQL}), a AS (SELECT DISTINCT frame_id FROM o WHERE conf >= 0.8 AND state <> 'R'), b AS (SELECT DISTINCT frame_id FROM o WHERE conf >= 0.85)
        SELECT CASE WHEN a.frame_id IS NULL THEN 'added' WHEN b.frame_id IS NULL THEN 'removed' ELSE 'kept' END AS change, count(*) AS n FROM a FULL JOIN b ON a.frame_id = b.frame_id GROUP BY 1""",
    "class_delta": f"""WITH c AS (SELECT class_name, count(*) FILTER (conf >= 0.8) AS n_a, count(*) FILTER (conf >= 0.5 AND state = 'A') AS n_b FROM ({OBJECTS_SQL}) GROUP BY 1)
        SELECT *, n_b - n_a AS delta FROM c WHERE n_a + n_b > 0""",
    "union_candidates": "SELECT doc_id FROM documents WHERE lang = 'fr' UNION SELECT doc_id FROM documents WHERE contains(text, 'token')",
    "intersect_except": """SELECT l_orderkey AS frame_id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N'
        EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""",
    "reconcile_actions": f"""WITH e AS (SELECT *, round(value, 2) AS v FROM ({EVENTS_SQL})), o AS (SELECT kind, session_id, t, v, event_id % 7 = 0 AS ruled FROM e WHERE event_id % 3 <> 0),
        n AS (SELECT kind, session_id, t, CASE WHEN event_id % 5 = 0 THEN v + 1 ELSE v END AS w FROM e WHERE event_id % 4 <> 0)
        SELECT kind, CASE WHEN v IS NULL THEN 'insert' WHEN w IS NULL THEN CASE WHEN ruled THEN 'skip' ELSE 'prune' END
            WHEN ruled THEN CASE WHEN v = w THEN 'skip' ELSE 'evidence' END WHEN v = w THEN 'unchanged' ELSE 'update' END AS action, count(*) AS n
        FROM o FULL JOIN n USING (kind, session_id, t) GROUP BY 1, 2""",
    "upsert_latest": "SELECT user_id AS session_id, event_type AS kind, max(epoch_us(ts)) AS t FROM events GROUP BY 1, 2",
    "bulk_tags": """SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct([p_type, p_brand, 'checked', 'new']), lambda x: x NOT IN ('Brand#11', 'Brand#12'))), ',') AS tags FROM part""",
    "split_assign": f"""WITH RECURSIVE s AS (SELECT o_custkey AS session_id, count(*) AS n FROM ({OBJECTS_SQL}) x JOIN orders ON o_orderkey = frame_id GROUP BY 1),
        t AS (SELECT 0.1 * sum(n)::DOUBLE AS room FROM s),
        g AS (SELECT *, row_number() OVER (ORDER BY sha256('0:' || session_id)[1:16], session_id) AS step FROM s),
        walk AS (SELECT 0::BIGINT AS step, NULL::BIGINT AS session_id, 0::BIGINT AS n, 'none' AS split, room AS val, room AS test FROM t
                 UNION ALL
                 SELECT step, session_id, n, split, val - CASE WHEN split = 'val' THEN n ELSE 0 END, test - CASE WHEN split = 'test' THEN n ELSE 0 END FROM (
                     SELECT g.step, g.session_id, g.n, val, test, CASE WHEN val > 0 AND g.n <= val * 1.25 THEN 'val' WHEN test > 0 AND g.n <= test * 1.25 THEN 'test' ELSE 'train' END AS split
                     FROM walk w JOIN g ON g.step = w.step + 1))
        SELECT session_id, n, split FROM walk WHERE step > 0""",
    "split_leakage": """SELECT o_custkey AS session_id, count(DISTINCT CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END) AS splits FROM orders GROUP BY 1 HAVING splits > 1""",
    "split_shares": """SELECT DISTINCT o_custkey AS session_id, round(('0x' || sha256('0:' || o_custkey::VARCHAR)[1:16])::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE, 9) AS share FROM orders""",
    "seal_fingerprint": """WITH h AS (SELECT lang, sha256(length(doc_id::VARCHAR) || ':' || doc_id || coalesce(length(lang) || ':' || lang, '-') || coalesce(length(text) || ':' || text, '-')) AS h FROM documents),
        c AS (SELECT lang, h[1:3] AS bucket, h || 'x' || count(*) AS h, count(*) AS n FROM h GROUP BY lang, h.h),
        b AS (SELECT lang, bucket, sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n) AS n FROM c GROUP BY 1, 2)
        SELECT lang, sha256(string_agg(h, '' ORDER BY h))[1:16] AS seal, sum(n)::BIGINT AS n FROM b GROUP BY 1""",
    "lineage_walk": """WITH o AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)
        SELECT DISTINCT 'c' || o_custkey AS id, 1::BIGINT AS depth FROM o UNION SELECT 'n' || c_nationkey, 2 FROM o JOIN customer ON c_custkey = o_custkey
        UNION SELECT 'r' || n_regionkey, 3 FROM o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "lineage_recursive": """SELECT 0 AS depth, 1::BIGINT AS n UNION ALL SELECT 1, count(*) FROM nation WHERE n_regionkey = 1
        UNION ALL SELECT 2, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""",
    "lake_labels": f"""SELECT class_name, state, count(*) AS n, count(DISTINCT o_custkey) AS sessions FROM ({OBJECTS_SQL}) x JOIN orders ON o_orderkey = frame_id GROUP BY 1, 2""",
    "shard_index": f"""SELECT frame_id, count(*) AS n_objects, string_agg(DISTINCT class_name, ',' ORDER BY class_name) AS classes, string_agg(DISTINCT state, ',' ORDER BY state) AS states
        FROM ({OBJECTS_SQL}) WHERE conf >= 0.5 GROUP BY 1""",
    "export_records": f"""SELECT n_name AS city, count(*) AS n, min(frame_id) AS first, round(avg(o_totalprice), 0) AS quality FROM ({OBJECTS_SQL}) x JOIN orders ON o_orderkey = frame_id
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE conf >= 0.9 AND state = 'A' GROUP BY 1""",
    "latest_per_session": "SELECT user_id AS session_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1",
    "retention_erase": f"""SELECT state, count(*) AS n FROM ({OBJECTS_SQL}) x JOIN orders ON o_orderkey = frame_id WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0) GROUP BY 1""",
    "unsupported_terms": "SELECT * FROM (VALUES ('cities', false), ('states', true), ('weather', false)) v(clause, supported)",
    "incident_dedup": f"""WITH g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 86400000000 THEN 0 ELSE 1 END AS fresh FROM ({EVENTS_SQL}) WINDOW w AS (PARTITION BY session_id, kind ORDER BY t, event_id)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, kind ORDER BY t, event_id) AS k FROM g) SELECT session_id, kind, min(t) AS first, count(*) AS evidence FROM i GROUP BY session_id, kind, k""",
}

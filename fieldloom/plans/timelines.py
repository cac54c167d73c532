"""Queries over ordered events: runs, neighbourhoods, joins in time, tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import behaviour as B
from ..operators import temporal as T
from ..operators import tracking as TR
from ..tables import events, table

ORDER = ["t", "event_id"]
HOUR = 3_600_000_000

EVENTS_SQL = "SELECT event_id, user_id AS session_id, event_type AS kind, epoch_us(ts) AS t, value, props FROM events"
#: Spark's and DuckDB's islands: a running count of changes.
SEGMENTS_SQL = f"""
    SELECT session_id, island, kind AS state, min(t) AS "start", max(t) AS "end", count(*) AS n FROM (
        SELECT *, sum(change) OVER (PARTITION BY session_id ORDER BY t, event_id) AS island FROM (
            SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY session_id ORDER BY t, event_id) THEN 0 ELSE 1 END AS change FROM ({EVENTS_SQL})))
    GROUP BY session_id, island, kind
"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    return T.state_segments(events(spark, d), "session_id", "t", ORDER, F.col("kind"))


def state_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("session_id", F.col("island").cast("long").alias("island"), "state", "start", "end", "n")


def phase_transitions_invalid(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("signup", "view")], "state string, next string")
    return T.invalid_transitions(segments(spark, d), "session_id", allowed).groupBy("state", "next").agg(F.count(F.lit(1)).alias("n"))


def flicker_aba(spark: SparkSession, d: str) -> DataFrame:
    return T.flicker(segments(spark, d), "session_id", HOUR).select("session_id", "state", "start", "before")


def threshold_runs(spark: SparkSession, d: str) -> DataFrame:
    return T.threshold_runs(events(spark, d), "session_id", "t", ORDER, "value", F.col("value") >= 30).select("session_id", "start", "end", "n", "peak")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("session_id", F.floor(F.col("t") / (24 * HOUR)).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def moving_average_deficit(spark: SparkSession, d: str) -> DataFrame:
    found = T.moving_deficit(daily(spark, d), "session_id", "day", "n", ratio=0.5, least=2)
    return found.select("session_id", "day", "n", F.round("near", 6).alias("near"), F.round("deficit", 6).alias("deficit"))


def neighbour_median_sparsity(spark: SparkSession, d: str) -> DataFrame:
    return T.sparsity(daily(spark, d), "session_id", "day", "n").select("session_id", "day", F.round("sparsity", 6).alias("sparsity"))


def robust_z_anomalies(spark: SparkSession, d: str) -> DataFrame:
    found = T.robust_z(events(spark, d), "kind", "value").where("z >= 3.5")
    return found.select("event_id", "kind", F.round("z", 6).alias("z"))


def ego_lag_features(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("heading", F.pmod(F.col("value") * 7, F.lit(360.0)))
    found = T.ego_state(e, "session_id", ORDER, "t", "value", "heading")
    return found.select("event_id", *(F.round(F.col(c) * 1000, 4).alias(c) for c in ("accel", "yaw_rate", "jerk")))


def gap_interpolation(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("seen", F.when(F.col("kind") != "error", F.col("value")))
    e = e.withColumn("at", F.row_number().over(Window.partitionBy("session_id").orderBy(*ORDER)))
    found = T.interpolated(e, "session_id", "at", "seen", most=3)
    return found.where("seen IS NULL").select("event_id", F.round("filled", 6).alias("filled"), F.round("fill_conf", 6).alias("fill_conf"))


def majority_smoothing(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("session_id").orderBy(*ORDER)))
    return T.majority_filter(e, "session_id", "at", "kind").where("smooth <> kind").select("event_id", "smooth")


def nearest_event_asof(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    left, right = e.where("kind = 'error'").select("session_id", "event_id", "t"), e.where("kind = 'click'").select("session_id", "t", F.col("event_id").alias("click"))
    return T.nearest_in_time(left, right, "session_id", "t", "click", 24 * HOUR).select("event_id", "nearest_t", "nearest_click")


def events_cooccur_overlap(spark: SparkSession, d: str) -> DataFrame:
    spans = events(spark, d).select("session_id", "event_id", "kind", F.col("t").alias("start"), F.when(F.col("kind") == "view", F.col("t") + 600_000_000).alias("end"))
    found = T.overlapping(spans.where("kind = 'view'"), spans.where("kind = 'purchase'"), "session_id", "event_id", 2 * HOUR, 8 * HOUR)
    return found.select("event_id", "session_id")


def sync_groups(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("session_id", "t", "event_id")
    return T.sync_groups(e, "session_id", "t", 12 * HOUR).groupBy("session_id", "sync_group").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))


def health_trend(spark: SparkSession, d: str) -> DataFrame:
    days = events(spark, d).groupBy("session_id", F.floor(F.col("t") / (24 * HOUR)).cast("double").alias("day")).agg(F.avg("value").alias("health"))
    found = T.trend(days, "session_id", "day", "health", floor=20.0)
    return found.select("session_id", "n", F.round("slope", 6).alias("slope"), F.round("latest", 6).alias("latest"), "level")


def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def previous_next(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(*ORDER)
    return events(spark, d).select("event_id", F.lag("event_id").over(w).alias("previous"), F.lead("event_id").over(w).alias("next"))


def topic_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("kind").orderBy(*ORDER)
    e = events(spark, d).select("kind", "t", (F.lead("t").over(w) - F.col("t")).alias("gap"))
    rate = e.groupBy("kind").agg(((F.max("t") - F.min("t")) / (F.count(F.lit(1)) - 1)).alias("period"))
    return e.join(rate, "kind").where(F.col("gap") > 5 * F.col("period")).select("kind", "t", "gap")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that drift with time: one frame for each event of a session, by order."""
    e = events(spark, d).withColumn("frame", F.row_number().over(Window.partitionBy("session_id").orderBy(*ORDER)).cast("long"))
    x = F.col("frame") * 4.0 + F.col("value") / 10
    return e.select("session_id", "frame", (F.col("t") / 1e6).alias("t"), F.col("event_id").alias("id"), x.alias("x1"), F.lit(10.0).alias("y1"), (x + 60).alias("x2"), (50 + F.col("value") / 5).alias("y2"))


def iou_tracks(spark: SparkSession, d: str) -> DataFrame:
    return TR.iou_tracker(boxes(spark, d), "session_id", "frame").groupBy("session_id", "track_id").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"))


def track_trajectories(spark: SparkSession, d: str) -> DataFrame:
    found = TR.trajectories(boxes(spark, d), "session_id", "t", 1920.0)
    rounded = (F.round(c, 4).alias(c) for c in ("x_drift", "area_growth", "mean_speed", "net_displacement", "duration"))
    return found.select("session_id", "n", *rounded, "approaching")


def object_dynamics(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("session_id").orderBy(*ORDER)) * 1.0)
    found = TR.dynamics(e.withColumn("vru", F.col("kind") == "view"), "session_id", "at", "value")
    return found.select("event_id", F.round("ttc", 4).alias("ttc"), "risk")


def signal_growth(spark: SparkSession, d: str) -> DataFrame:
    found = B.growth(events(spark, d), "session_id", ORDER, "value")
    return found.select("session_id", "n", F.round("growth", 6).alias("growth"))


def static_dynamic(spark: SparkSession, d: str) -> DataFrame:
    days = events(spark, d).withColumn("key", F.concat_ws("-", "session_id", F.floor(F.col("t") / (24 * HOUR))))
    return B.motion(days, "key", F.col("value") < 15).groupBy("motion").agg(F.count(F.lit(1)).alias("n"))


def zone_dwell(spark: SparkSession, d: str) -> DataFrame:
    return B.dwells(events(spark, d), "session_id", "t", ORDER, F.col("value") < 25, 48 * HOUR)


def lane_crossings(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("offset", F.col("value") - 14)
    return B.crossings(e, "session_id", ORDER, "offset", least=20.0).select("event_id", "session_id")


QUERIES = {f.__name__: f for f in (
    signal_growth, static_dynamic, zone_dwell, lane_crossings, state_segments, phase_transitions_invalid, flicker_aba, threshold_runs, moving_average_deficit, neighbour_median_sparsity, robust_z_anomalies,
    ego_lag_features, gap_interpolation, majority_smoothing, nearest_event_asof, events_cooccur_overlap, sync_groups, health_trend,
    tumbling_windows, sliding_windows, session_windows, previous_next, topic_gaps, iou_tracks, track_trajectories, object_dynamics,
)}

DAILY_SQL = f"SELECT session_id, floor(t / 86400000000)::BIGINT AS day, count(*) AS n FROM ({EVENTS_SQL}) GROUP BY 1, 2"
BOXES_SQL = f"""SELECT session_id, frame, t / 1e6::DOUBLE AS s, 4.0::DOUBLE * frame + value / 10 AS x1, 10.0::DOUBLE AS y1, 4.0::DOUBLE * frame + value / 10 + 60 AS x2, 50 + value / 5 AS y2
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS frame FROM ({EVENTS_SQL}))"""

ORACLES = {
    "signal_growth": f"""WITH r AS (SELECT session_id, value, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM ({EVENTS_SQL})),
        m AS (SELECT session_id, max(n) AS n, median(value) FILTER (r <= greatest(1, n // 3)) AS a, median(value) FILTER (r > n - greatest(1, n // 3)) AS b FROM r GROUP BY 1)
        SELECT session_id, n, round(CASE WHEN a > 0 THEN b / a END, 6) AS growth FROM m""",
    "static_dynamic": f"""WITH k AS (SELECT session_id, t // 86400000000 AS day, min((value < 15)::INT) AS a, max((value < 15)::INT) AS b FROM ({EVENTS_SQL}) GROUP BY 1, 2)
        SELECT CASE WHEN a = 1 THEN 'static' WHEN b = 0 THEN 'dynamic' ELSE 'mixed' END AS motion, count(*) AS n FROM k GROUP BY 1""",
    "zone_dwell": f"""SELECT session_id, min(t) AS "start", max(t) AS "end" FROM (
        SELECT *, sum(change) OVER (PARTITION BY session_id ORDER BY t, event_id) AS island FROM (
            SELECT *, value < 25 AS hot, CASE WHEN (value < 25) = lag(value < 25) OVER (PARTITION BY session_id ORDER BY t, event_id) THEN 0 ELSE 1 END AS change FROM ({EVENTS_SQL})))
        WHERE hot GROUP BY session_id, island HAVING max(t) - min(t) >= {48 * HOUR}""",
    "lane_crossings": f"""WITH e AS (SELECT event_id, session_id, t, value - 14 AS o FROM ({EVENTS_SQL})),
        w AS (SELECT *, sign(o) AS s, sign(lag(o) OVER w) AS p, lead(o, 1) OVER w AS a, lead(o, 2) OVER w AS b, lead(o, 3) OVER w AS c FROM e WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))
        SELECT event_id, session_id FROM w WHERE p * s < 0 AND sign(a) = s AND sign(b) = s AND sign(c) = s AND greatest(abs(o), abs(a), abs(b), abs(c)) >= 20""",
    "state_segments": f"""SELECT session_id, island::BIGINT AS island, state, "start", "end", n FROM ({SEGMENTS_SQL})""",
    "phase_transitions_invalid": f"""SELECT state, next, count(*) AS n FROM (SELECT *, lead(state) OVER (PARTITION BY session_id ORDER BY island) AS next FROM ({SEGMENTS_SQL}))
        WHERE next IS NOT NULL AND state IN ('view', 'click', 'purchase', 'signup')
        AND (state, next) NOT IN (('view', 'click'), ('click', 'purchase'), ('click', 'view'), ('purchase', 'view'), ('signup', 'view')) GROUP BY 1, 2""",
    "flicker_aba": f"""SELECT session_id, state, "start", before FROM (SELECT *, lag(state) OVER w AS before, lead(state) OVER w AS after FROM ({SEGMENTS_SQL}) WINDOW w AS (PARTITION BY session_id ORDER BY island))
        WHERE before = after AND before <> state AND "end" - "start" < {HOUR}""",
    "threshold_runs": f"""SELECT session_id, min(t) AS "start", max(t) AS "end", count(*) AS n, max(value) AS peak FROM (
        SELECT *, sum(change) OVER (PARTITION BY session_id ORDER BY t, event_id) AS island FROM (
            SELECT *, value >= 30 AS hot, CASE WHEN (value >= 30) = lag(value >= 30) OVER (PARTITION BY session_id ORDER BY t, event_id) THEN 0 ELSE 1 END AS change FROM ({EVENTS_SQL})))
        WHERE hot GROUP BY session_id, island""",
    "moving_average_deficit": f"""SELECT session_id, day, n, round(near, 6) AS near, round(1 - n / near, 6) AS deficit FROM (
        SELECT *, avg(n) OVER (PARTITION BY session_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM ({DAILY_SQL})) WHERE near >= 2 AND n < 0.5 * near""",
    "neighbour_median_sparsity": f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY day) AS k FROM ({DAILY_SQL})),
        m AS (SELECT a.session_id, a.day, a.n, median(b.n) AS med FROM d a LEFT JOIN d b ON a.session_id = b.session_id AND a.k <> b.k AND abs(a.k - b.k) <= 8 GROUP BY 1, 2, 3)
        SELECT session_id, day, round(CASE WHEN med >= 1 THEN greatest(0, (med - n) / med) ELSE 0 END, 6) AS sparsity FROM m""",
    "robust_z_anomalies": f"""WITH e AS ({EVENTS_SQL}), m AS (SELECT kind, median(value) AS med FROM e GROUP BY 1 HAVING count(value) >= 8),
        o AS (SELECT event_id, e.kind, abs(value - med) AS off FROM e JOIN m ON e.kind = m.kind), a AS (SELECT kind, median(off) AS mad FROM o GROUP BY 1)
        SELECT event_id, o.kind, round(off / (1.4826::DOUBLE * CASE WHEN mad > 0 THEN mad ELSE 1e-6 END), 6) AS z FROM o JOIN a ON o.kind = a.kind WHERE off / (1.4826::DOUBLE * CASE WHEN mad > 0 THEN mad ELSE 1e-6 END) >= 3.5""",
    "gap_interpolation": f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS pos, CASE WHEN kind <> 'error' THEN value END AS seen FROM ({EVENTS_SQL})),
        w AS (SELECT *, max(CASE WHEN seen IS NOT NULL THEN pos END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
              min(CASE WHEN seen IS NOT NULL THEN pos END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM e)
        SELECT w.event_id, round(CASE WHEN w.b - w.a - 1 <= 3 THEN x.seen + (y.seen - x.seen) * ((w.pos - w.a)::DOUBLE / (w.b - w.a)) END, 6) AS filled,
               round(CASE WHEN w.b - w.a - 1 <= 3 THEN pow(0.9::DOUBLE, w.pos - w.a) END, 6) AS fill_conf
        FROM w LEFT JOIN e x ON x.session_id = w.session_id AND x.pos = w.a LEFT JOIN e y ON y.session_id = w.session_id AND y.pos = w.b WHERE w.seen IS NULL""",
    "majority_smoothing": f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS at FROM ({EVENTS_SQL})),
        c AS (SELECT a.event_id, a.kind, b.kind AS k, count(*) AS n FROM e a JOIN e b ON a.session_id = b.session_id AND abs(a.at - b.at) <= 2 GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, (k = kind) DESC, k) AS r FROM c) SELECT event_id, k AS smooth FROM r WHERE r = 1 AND k <> kind""",
    "nearest_event_asof": f"""WITH e AS ({EVENTS_SQL}), p AS (SELECT a.event_id, b.t AS bt, b.event_id AS bid,
        row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t, b.event_id) AS r, abs(a.t - b.t) AS gap
        FROM e a LEFT JOIN e b ON a.session_id = b.session_id AND b.kind = 'click' WHERE a.kind = 'error')
        SELECT event_id, CASE WHEN gap <= {24 * HOUR} THEN bt END AS nearest_t, CASE WHEN gap <= {24 * HOUR} THEN bid END AS nearest_click FROM p WHERE r = 1""",
    "events_cooccur_overlap": f"""WITH e AS ({EVENTS_SQL}) SELECT a.event_id, a.session_id FROM e a WHERE a.kind = 'view' AND EXISTS (SELECT 1 FROM e b
        WHERE b.kind = 'purchase' AND b.session_id = a.session_id AND a.t <= b.t + {2 * HOUR} AND b.t - {2 * HOUR} <= a.t + 600000000)""",
    "health_trend": f"""WITH d AS (SELECT session_id, floor(t / 86400000000)::DOUBLE AS day, avg(value) AS health FROM ({EVENTS_SQL}) GROUP BY 1, 2),
        f AS (SELECT session_id, count(*) AS n, regr_slope(health, day) AS slope, arg_max(health, day) AS latest FROM d GROUP BY 1 HAVING count(*) >= 4)
        SELECT session_id, n, round(slope, 6) AS slope, round(latest, 6) AS latest, CASE WHEN NOT slope < -0.03 THEN NULL WHEN (20 - latest) / slope < 0 THEN 'critical'
        WHEN (20 - latest) / slope <= 3 THEN 'warn' ELSE 'watch' END AS level FROM f""",
    "tumbling_windows": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS "start", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
    "sliding_windows": """SELECT strftime(date_trunc('day', ts) - k * INTERVAL 1 DAY, '%Y-%m-%d %H:%M') AS "start", count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1""",
    "session_windows": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "start", count(*) AS n FROM s GROUP BY user_id, k""",
    "previous_next": """SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "topic_gaps": f"""WITH e AS (SELECT kind, t, lead(t) OVER (PARTITION BY kind ORDER BY t, event_id) - t AS gap FROM ({EVENTS_SQL})),
        r AS (SELECT kind, (max(t) - min(t)) / (count(*) - 1)::DOUBLE AS period FROM e GROUP BY 1) SELECT e.kind, t, gap FROM e JOIN r ON e.kind = r.kind WHERE gap > 5 * period""",
    "track_trajectories": f"""WITH b AS (SELECT *, (x1 + x2) / 2 AS cx, greatest(1, (x2 - x1) * (y2 - y1)) AS area FROM ({BOXES_SQL})),
        s AS (SELECT *, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(y2 - lag(y2) OVER w, 2)) / (s - lag(s) OVER w) AS speed FROM b WINDOW w AS (PARTITION BY session_id ORDER BY frame))
        SELECT session_id, count(*) AS n, round((arg_max(cx, frame) - arg_min(cx, frame)) / 1920, 4) AS x_drift, round(arg_max(area, frame) / arg_min(area, frame), 4) AS area_growth,
               round(sum(coalesce(speed, 0)) / count(*), 4) AS mean_speed, round(sqrt(pow(arg_max(cx, frame) - arg_min(cx, frame), 2) + pow(arg_max(y2, frame) - arg_min(y2, frame), 2)), 4) AS net_displacement,
               round(max(s) - min(s), 4) AS duration, arg_max(area, frame) / arg_min(area, frame) > 1.15 AS approaching FROM s GROUP BY session_id""",
    "object_dynamics": f"""WITH c AS (SELECT event_id, kind, value, lag(value) OVER (PARTITION BY session_id ORDER BY t, event_id) - value AS closing FROM ({EVENTS_SQL})),
        p AS (SELECT *, CASE WHEN abs(closing) <= 150 / 3.6::DOUBLE THEN closing END AS v FROM c), q AS (SELECT *, CASE WHEN v >= 0.5 THEN value / v END AS x FROM p),
        z AS (SELECT *, CASE WHEN x <= 60 THEN x END AS ttc FROM q)
        SELECT event_id, round(ttc, 4) AS ttc, CASE WHEN ttc < 1.5 OR (kind = 'view' AND value < 5) THEN 'high'
        WHEN ttc < 4 OR value < CASE WHEN kind = 'view' THEN 12 ELSE 10 END THEN 'medium' ELSE 'low' END AS risk FROM z""",
}

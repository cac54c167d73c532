"""Event-time windows over streams of events (ts, user_id, event_type, value), with watermarks for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; ts as a timestamp, which watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Incidents: events of one user within a gap of each other."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def joined(left: DataFrame, right: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pairs of one user's events from two streams, close in time; both watermarks bound the state."""
    a = left.withWatermark("ts", late).select(F.col("user_id").alias("a_user"), F.col("ts").alias("a_ts"), F.col("event_id").alias("a_id"))
    b = right.withWatermark("ts", late).select(F.col("user_id").alias("b_user"), F.col("ts").alias("b_ts"), F.col("event_id").alias("b_id"))
    close = (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("a_user") == F.col("b_user")) & close)


def latched_health(events: DataFrame, limit: float = 5.0, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Windows of each user whose mean falls below a limit; the earliest is when the flag was set."""
    means = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", size).alias("w")).agg(F.avg("value").alias("health"))
    return means.where(F.col("health") < limit).select("user_id", "w.start", "health")


def drained(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends; results are Parquet, written once each thanks to the checkpoint."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()

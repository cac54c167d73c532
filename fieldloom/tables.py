"""The tables under a folder, and their reading as sessions, frames and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    """Microseconds of a zoneless timestamp, read as UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("session_id"), F.col("n_name").alias("city"), F.col("c_mktsegment").alias("vehicle")
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("ts"),
        F.struct(F.col("o_orderpriority").alias("weather"), F.col("o_orderstatus").alias("time_of_day")).alias("scene"),
        F.col("o_totalprice").alias("quality"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with their class (the ontology's l1 and name): the ontology is as small as a vocabulary, Spark broadcasts it."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    onto = parts.select(F.col("p_partkey").alias("class_id"), F.col("p_type").alias("l1"), F.col("p_brand").alias("class_name"))
    found = lines.select(
        F.col("l_orderkey").alias("frame_id"), F.col("l_partkey").alias("class_id"), F.col("l_linenumber").alias("number"),
        F.col("l_returnflag").alias("state"), F.col("l_linestatus").alias("source"), F.round(F.col("l_discount") * 10, 6).alias("conf"),
        F.col("l_quantity").alias("width"), F.col("l_extendedprice").alias("height"), F.col("l_suppkey").alias("track_id"),
    )
    return found.join(onto, "class_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), micros("ts").alias("t"), "value", "props")

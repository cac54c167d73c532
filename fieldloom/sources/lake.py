"""Published tables with declared schemas, and the index of sample shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}


def declared(columns: str) -> T.StructType:
    """A schema from `name type, ...`, without a session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


# The published tables. Declared, never inferred: a column that is null throughout keeps its type.
TABLES = {
    "labels": declared("""object_id string, frame_id string, session_id string, track_id string, class_id int, class_name string,
        state string, source string, conf double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double,
        city string, vehicle_id string, cam_id string, ts_ns bigint, version int"""),
    "provenance": declared("""review_id string, object_id string, reviewer string, user_id string, action string,
        before_state string, after_state string, before_class_id int, after_class_id int, time_spent_ms int, ts_ns bigint"""),
    "quality": declared("object_id string, quality double, agreement double, audit_verdict string, flags array<string>"),
}
LABELS = TABLES["labels"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; those the frame lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def labels(objects: DataFrame, frames: DataFrame) -> DataFrame:
    """`objects` with their frames' sessions and what else the frames have of the published columns."""
    known = [c for c in LABELS.names if c in frames.columns and c not in objects.columns and c != "frame_id"]
    return conform(objects.join(frames.select("frame_id", *known), "frame_id"), LABELS)


def publish_all(tables: dict[str, DataFrame], root: str) -> None:
    """A snapshot of the annotation plane: each table under its declared schema; an unknown name is refused first."""
    if unknown := sorted(set(tables) - set(TABLES)):
        raise ValueError(f"no such tables: {', '.join(unknown)}")
    for name, df in tables.items():
        publish(df, f"{root}/{name}", TABLES[name])


def publish(df: DataFrame, path: str, schema: T.StructType, partition: str | None = None) -> None:
    """Replaces the table at a path by this snapshot."""
    out = conform(df, schema).write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).parquet(path)


def scan(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    found = spark.read.schema(schema).parquet(path)
    return found if limit is None else found.limit(limit)


def shard_index(objects: DataFrame, frame: str) -> DataFrame:
    """What each sample holds: number of objects, its classes and states as sorted lists."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return objects.groupBy(frame).agg(F.count(F.lit(1)).alias("n_objects"), listed("class_name").alias("classes"), listed("state").alias("states"))

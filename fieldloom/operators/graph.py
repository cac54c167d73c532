"""Connected components and walks over edges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """`df` as a written table in the folder that driver and executors share: cuts the lineage, is computed once, and its
    size is known to the plans that read it (a checkpoint keeps the estimate of the plan before, which grows without
    bound over rounds). Where no folder is set, a local master gets a temporary one; on a cluster that is an error, as
    each machine would write to its own disks."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/fieldloom-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """(id, label): for each end of an edge the smallest id it is connected with. Labels spread to neighbours and jump
    to their label's label, so the rounds grow with the logarithm of the longest path. `most` bounds the partitions of
    what the rounds keep, for edges that are few. Labels, a row for each id, never go through the driver."""

    def kept(df: DataFrame) -> DataFrame:
        return cut(df if most is None else df.coalesce(most))

    both = kept(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct())
    labels = kept(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("x")).alias("label")))
    while True:
        near = both.join(labels.hint("merge"), F.col("y") == F.col("id")).groupBy("x").agg(F.min("label").alias("near"))
        spread = labels.join(near.hint("merge"), F.col("id") == F.col("x")).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = kept(spread.join(jump.hint("merge"), "label").select("id", "old", F.least("label", "next").alias("label")))
        labels = moved.select("id", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def ancestors(edges: DataFrame, start, most: int = 50) -> DataFrame:
    """(id, depth) of all parents above the starting ids, along (child, parent); cycles end the walk."""
    front = edges.where(F.col("child").isin(start)).select(F.col("parent").alias("id"), F.lit(1).alias("depth")).distinct()
    found = cut(front)
    for depth in range(2, most + 1):
        front = edges.join(front, F.col("child") == F.col("id")).select(F.col("parent").alias("id"), F.lit(depth).alias("depth")).distinct()
        front = cut(front.join(found, "id", "left_anti"))
        if front.isEmpty():
            break
        found = cut(found.union(front))
    return found

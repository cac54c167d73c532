"""Readers of annotation platforms' exports into the object table of `formats`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .formats import objects

LABEL_STUDIO = """data struct<image: string>, annotations array<struct<result: array<struct<original_width: int, original_height: int, score: double,
    value: struct<x: double, y: double, width: double, height: double, rectanglelabels: array<string>>>>>>,
    predictions array<struct<result: array<struct<original_width: int, original_height: int, score: double,
    value: struct<x: double, y: double, width: double, height: double, rectanglelabels: array<string>>>>>>"""


def read_label_studio(spark: SparkSession, path: str, predictions: bool = False) -> DataFrame:
    """Rectangles are in percent of the image; predictions are read only where asked for."""
    tasks = spark.read.schema(LABEL_STUDIO).json(path, multiLine=True)
    sources = F.concat(F.coalesce("annotations", F.array()), F.coalesce("predictions", F.array())) if predictions else F.col("annotations")
    rows = tasks.select(F.col("data.image").alias("image_ref"), F.explode(sources).alias("a")).select("image_ref", F.explode("a.result").alias("r"))
    v, w, h = "r.value", F.col("r.original_width"), F.col("r.original_height")
    x, y = F.col(f"{v}.x") * w / 100, F.col(f"{v}.y") * h / 100
    return objects(rows.where(F.size(f"{v}.rectanglelabels") > 0).select(
        "image_ref", w.alias("width"), h.alias("height"), F.get(f"{v}.rectanglelabels", F.lit(0)).alias("class_name"),
        x.alias("x1"), y.alias("y1"), (x + F.col(f"{v}.width") * w / 100).alias("x2"), (y + F.col(f"{v}.height") * h / 100).alias("y2"), F.col("r.score").alias("conf"),
    ))


BDD = """name string, attributes struct<weather: string, scene: string, timeofday: string>,
    labels array<struct<category: string, box2d: struct<x1: double, y1: double, x2: double, y2: double>>>"""


def read_bdd(spark: SparkSession, path: str, width: int = 1280, height: int = 720) -> DataFrame:
    """Labels with a box; those with other shapes only are passed over."""
    rows = spark.read.schema(BDD).json(path, multiLine=True).select(F.col("name").alias("image_ref"), F.explode("labels").alias("l")).where("l.box2d IS NOT NULL")
    return objects(rows.select("image_ref", F.lit(width).alias("width"), F.lit(height).alias("height"), F.col("l.category").alias("class_name"), "l.box2d.*"))


MAPILLARY = "width int, height int, objects array<struct<label: string, polygon: array<array<double>>>>"


def read_mapillary(spark: SparkSession, path: str) -> DataFrame:
    """Polygons become the boxes around them; a file is an image."""
    files = spark.read.schema(MAPILLARY).json(path, multiLine=True).withColumn("image_ref", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    rows = files.select("image_ref", "width", "height", F.explode("objects").alias("o")).where(F.size("o.polygon") > 0)
    side = lambda k: F.transform("o.polygon", lambda p: F.get(p, F.lit(k)))
    return objects(rows.select("image_ref", "width", "height", F.col("o.label").alias("class_name"), F.array_min(side(0)).alias("x1"), F.array_min(side(1)).alias("y1"), F.array_max(side(0)).alias("x2"), F.array_max(side(1)).alias("y2")))


CVAT = """_name string, _width int, _height int, box array<struct<_label: string, _xtl: double, _ytl: double, _xbr: double, _ybr: double>>"""


def read_cvat(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "image").schema(CVAT).load(path)
    rows = rows.select(F.col("_name").alias("image_ref"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.explode("box").alias("b"))
    return objects(rows.select("image_ref", "width", "height", F.col("b._label").alias("class_name"), *(F.col(f"b.{a}").alias(b) for a, b in (("_xtl", "x1"), ("_ytl", "y1"), ("_xbr", "x2"), ("_ybr", "y2")))))


def read_nuscenes(spark: SparkSession, root: str) -> DataFrame:
    """Annotations with their sample and category: sample_token, timestamp, category, translation, size."""
    read = lambda name, schema: spark.read.schema(schema).json(f"{root}/{name}.json", multiLine=True)
    samples = read("sample", "token string, timestamp bigint, scene_token string").withColumnRenamed("token", "sample_token")
    instances = read("instance", "token string, category_token string").withColumnRenamed("token", "instance_token")
    categories = read("category", "token string, name string").select(F.col("token").alias("category_token"), F.col("name").alias("category"))
    found = read("sample_annotation", "token string, sample_token string, instance_token string, translation array<double>, size array<double>")
    found = found.join(samples, "sample_token").join(instances, "instance_token").join(F.broadcast(categories), "category_token")
    return found.select("token", "sample_token", "instance_token", "scene_token", "timestamp", "category", "translation", "size")


def with_links(annotations: DataFrame) -> DataFrame:
    """Previous and next annotation of each instance, as the relational export stores them."""
    w = Window.partitionBy("instance_token").orderBy("timestamp", "token")
    return annotations.withColumns({"prev": F.coalesce(F.lag("token").over(w), F.lit("")), "next": F.coalesce(F.lead("token").over(w), F.lit(""))})


def image_folder(spark: SparkSession, path: str, fps: float, start_ns: int = 0) -> DataFrame:
    """(path, ts_ns) of a folder's files in order of their names, as many a second as said. The rows are paths only;
    ranks come from ranges of names, so no task holds the whole folder."""
    files = spark.read.format("binaryFile").load(path).select("path")
    dealt = files.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("low"), F.max("path").alias("high"))
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("low", "high", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = files.join(F.broadcast(counts), (F.col("path") >= F.col("low")) & (F.col("path") <= F.col("high")))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("low").orderBy("path")) - 1
    return placed.select("path", (F.lit(start_ns) + F.round(rank * 1e9 / fps)).cast("long").alias("ts_ns"))

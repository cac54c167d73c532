"""Interchange formats of boxes: readers and writers over one object table.

Objects: image_ref string, width int, height int, class_name string, x1, y1, x2, y2 double, conf double (or null).
Readers give these columns; writers take them. Unknown formats are refused. Files are written by Spark's own writers
into a folder, one part for each task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("image_ref", "width", "height", "class_name", "x1", "y1", "x2", "y2", "conf")

COCO = """images array<struct<id: bigint, file_name: string, width: int, height: int>>,
    annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, bbox: array<double>, score: double>>,
    categories array<struct<id: bigint, name: string>>"""


def objects(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*((F.col(c) if c in have else F.lit(None).cast("double")).alias(c) for c in COLUMNS))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """One or more COCO files: annotations joined with the images and categories of their own file."""
    files = spark.read.schema(COCO).json(path, multiLine=True).withColumn("file", F.input_file_name())
    images = files.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("image_ref"), "i.width", "i.height")
    names = files.select("file", F.explode("categories").alias("c")).select("file", F.col("c.id").alias("category_id"), F.col("c.name").alias("class_name"))
    found = files.select("file", F.explode("annotations").alias("a")).select("file", "a.image_id", "a.category_id", "a.bbox", F.col("a.score").alias("conf"))
    found = found.join(images, ["file", "image_id"]).join(names, ["file", "category_id"])
    x, y, w, h = (F.get("bbox", F.lit(k)) for k in range(4))
    return objects(found.withColumns({"x1": x, "y1": y, "x2": x + w, "y2": y + h}))


def write_coco(df: DataFrame, path: str) -> None:
    """COCO files in a folder, one for each bucket of images, each complete in itself."""
    buckets = F.pmod(F.xxhash64("image_ref"), F.lit(64))
    df = df.withColumn("bucket", buckets)
    df = df.withColumns({"image_id": F.dense_rank().over(Window.partitionBy("bucket").orderBy("image_ref")), "category_id": F.pmod(F.crc32(F.col("class_name").cast("binary")), F.lit(1 << 31))})
    box = F.array(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("image_id", "x1", "y1", "x2", "y2", "class_name"))
    df = df.withColumn("id", number).withColumn("box", box)
    whole = df.groupBy("bucket").agg(
        F.collect_set(F.struct(F.col("image_id").alias("id"), F.col("image_ref").alias("file_name"), "width", "height")).alias("images"),
        F.collect_list(F.struct("id", "image_id", "category_id", F.col("box").alias("bbox"), F.col("conf").alias("score"))).alias("annotations"),
        F.collect_set(F.struct(F.col("category_id").alias("id"), F.col("class_name").alias("name"))).alias("categories"),
    )
    whole.select("bucket", F.to_json(F.struct("images", "annotations", "categories")).alias("value")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").text(path)


def read_yolo(spark: SparkSession, path: str, classes: list[str], width: int, height: int) -> DataFrame:
    """Label files `class cx cy w h [conf]`, one for each image, in shares of the image."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("image_ref"), F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 5)
    return yolo_objects(lines, classes, width, height)


def yolo_objects(lines: DataFrame, classes: list[str], width: int, height: int) -> DataFrame:
    n = lambda k: F.get("p", F.lit(k)).cast("double")
    names = F.array(*map(F.lit, classes))
    out = lines.select(
        "image_ref", F.lit(width).alias("width"), F.lit(height).alias("height"), F.get(names, n(0).cast("int")).alias("class_name"),
        *((c.alias(name)) for name, c in (("x1", (n(1) - n(3) / 2) * width), ("y1", (n(2) - n(4) / 2) * height), ("x2", (n(1) + n(3) / 2) * width), ("y2", (n(2) + n(4) / 2) * height))),
        n(5).alias("conf"),
    )
    return objects(out)


def yolo_line(classes: list[str]) -> Column:
    shares = [(F.col("x1") + F.col("x2")) / 2 / F.col("width"), (F.col("y1") + F.col("y2")) / 2 / F.col("height"), (F.col("x2") - F.col("x1")) / F.col("width"), (F.col("y2") - F.col("y1")) / F.col("height")]
    index = F.array_position(F.array(*map(F.lit, classes)), F.col("class_name")) - 1
    return F.concat_ws(" ", index, *(F.round(s, 9) for s in shares), "conf")


def write_yolo(df: DataFrame, path: str, classes: list[str]) -> None:
    """Lines of a folder's label files, in a sub-folder for each image; classes that are not listed are an error."""
    line = F.when(F.col("class_name").isin(classes), yolo_line(classes)).otherwise(F.raise_error(F.concat(F.lit("class not listed: "), "class_name")))
    df.select("image_ref", line.alias("value")).write.mode("overwrite").partitionBy("image_ref").text(path)


def read_yolo_folder(spark: SparkSession, path: str, classes: list[str], width: int, height: int) -> DataFrame:
    """What write_yolo wrote."""
    lines = spark.read.schema("value string, image_ref string").text(path).select("image_ref", F.split(F.trim("value"), r"\s+").alias("p"))
    return yolo_objects(lines, classes, width, height)


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """KITTI label lines: type truncated occluded alpha x1 y1 x2 y2 ... [score]; DontCare lines are skipped."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("image_ref"), F.split(F.trim("value"), r"\s+").alias("p"))
    n = lambda k: F.get("p", F.lit(k)).cast("double")
    found = lines.where((F.size("p") >= 8) & (F.get("p", F.lit(0)) != "DontCare"))
    return objects(found.select("image_ref", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.get("p", F.lit(0)).alias("class_name"), n(4).alias("x1"), n(5).alias("y1"), n(6).alias("x2"), n(7).alias("y2"), n(15).alias("conf")))


def write_kitti(df: DataFrame, path: str) -> None:
    number = lambda c: F.format_string("%.2f", F.col(c))
    line = F.concat_ws(" ", "class_name", F.lit("0.00 0 -10"), *map(number, ("x1", "y1", "x2", "y2")), F.lit("-1 -1 -1 -1000 -1000 -1000 -10"), F.when(F.col("conf").isNotNull(), number("conf")))
    df.select("image_ref", line.alias("value")).write.mode("overwrite").partitionBy("image_ref").text(path)


VOC = """filename string, size struct<width: int, height: int, depth: int>,
    object array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"""


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    found = files.select(F.col("filename").alias("image_ref"), "size.width", "size.height", F.explode("object").alias("o"))
    return objects(found.select("image_ref", "width", "height", F.col("o.name").alias("class_name"), *(F.col(f"o.bndbox.{a}").alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2")))))


def write_voc(df: DataFrame, path: str) -> None:
    box = F.struct(F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    size = F.struct(F.col("width"), F.col("height"), F.lit(3).alias("depth"))
    whole = df.groupBy(F.col("image_ref").alias("filename")).agg(F.first(size).alias("size"), F.collect_list(F.struct(F.col("class_name").alias("name"), box.alias("bndbox"))).alias("object"))
    whole.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "annotation").save(path)


OPENLABEL = """openlabel struct<frames: map<string, struct<frame_properties: struct<uri: string, width: int, height: int>,
    objects: map<string, struct<type: string, bbox: array<double>, conf: double>>>>>"""


def read_openlabel(spark: SparkSession, path: str) -> DataFrame:
    """Boxes are centre x, centre y, width, height."""
    frames = spark.read.schema(OPENLABEL).json(path).select(F.explode("openlabel.frames").alias("key", "f"))
    found = frames.select(F.col("f.frame_properties.uri").alias("image_ref"), "f.frame_properties.width", "f.frame_properties.height", F.explode("f.objects").alias("id", "o"))
    x, y, w, h = (F.get("o.bbox", F.lit(k)) for k in range(4))
    return objects(found.select("image_ref", "width", "height", F.col("o.type").alias("class_name"), (x - w / 2).alias("x1"), (y - h / 2).alias("y1"), (x + w / 2).alias("x2"), (y + h / 2).alias("y2"), F.col("o.conf").alias("conf")))


def write_openlabel(df: DataFrame, path: str) -> None:
    """One document a line, each with one frame and its objects."""
    order = Window.partitionBy("image_ref").orderBy("x1", "y1", "x2", "y2", "class_name")
    box = F.array((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    entry = F.struct(F.row_number().over(order).cast("string").alias("key"), F.struct(F.col("class_name").alias("type"), box.alias("bbox"), "conf").alias("value"))
    df = df.withColumn("entry", entry)
    whole = df.groupBy("image_ref").agg(F.first(F.struct(F.col("image_ref").alias("uri"), "width", "height")).alias("p"), F.map_from_entries(F.collect_list("entry")).alias("o"))
    frame = F.create_map(F.lit("0"), F.struct(F.col("p").alias("frame_properties"), F.col("o").alias("objects")))
    whole.select(F.struct(frame.alias("frames")).alias("openlabel")).write.mode("overwrite").json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return objects(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str) -> None:
    objects(df).write.mode("overwrite").parquet(path)


READERS: dict[str, Callable] = {"coco": read_coco, "yolo": read_yolo, "kitti": read_kitti, "voc": read_voc, "openlabel": read_openlabel, "parquet": read_parquet}
WRITERS: dict[str, Callable] = {"coco": write_coco, "yolo": write_yolo, "kitti": write_kitti, "voc": write_voc, "openlabel": write_openlabel, "parquet": write_parquet}


def writer(fmt: str) -> Callable:
    if fmt not in WRITERS:
        raise ValueError(f"no such format: {fmt}")
    return WRITERS[fmt]


def remapped(df: DataFrame, mapping: DataFrame, fallback: str) -> DataFrame:
    """Class names by a map (source_class, class_name); those it lacks become the fallback."""
    known = mapping.select(F.col("source_class").alias("class_name"), F.col("class_name").alias("_to"))
    return df.join(F.broadcast(known), "class_name", "left").withColumn("class_name", F.coalesce("_to", F.lit(fallback))).select(*df.columns)


def taxonomy_report(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source_class, class_name, n): what an import would map, null where it would fall back."""
    counts = df.groupBy(F.col("class_name").alias("source_class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(mapping), "source_class", "left").select("source_class", "class_name", "n")

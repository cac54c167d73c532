from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import formats, lake
from fieldloom.streaming import selector, windows

CLASSES = ["car", "bus", "cow"]


@pytest.fixture(scope="module")
def boxes(spark):
    rows = [(f"img{i % 3}", 640, 480, CLASSES[i % 3], 8.0 * i, 4.0 * i, 8.0 * i + 64, 4.0 * i + 32, 0.5) for i in range(7)]
    return spark.createDataFrame(rows, "image_ref string, width int, height int, class_name string, x1 double, y1 double, x2 double, y2 double, conf double")


def rows(df, *columns):
    return sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("fmt", ["coco", "voc", "openlabel", "parquet"])
def test_round_trip(spark, boxes, tmp_path, fmt):
    formats.writer(fmt)(boxes, str(tmp_path / fmt))
    got = formats.READERS[fmt](spark, str(tmp_path / fmt))
    columns = ["image_ref", "width", "class_name", "x1", "y1", "x2", "y2"] + (["conf"] if fmt != "voc" else [])
    assert rows(got, *columns) == rows(boxes, *columns)


def test_yolo_round_trip(spark, boxes, tmp_path):
    formats.write_yolo(boxes, str(tmp_path / "y"), CLASSES)
    got = formats.read_yolo_folder(spark, str(tmp_path / "y"), CLASSES, 640, 480)
    assert rows(got, "image_ref", "class_name", "x1", "y2", "conf") == rows(boxes, "image_ref", "class_name", "x1", "y2", "conf")


def test_kitti_lines(spark, tmp_path):
    (tmp_path / "000001.txt").write_text("Car 0.00 0 -10 1.00 2.00 3.00 4.00 -1 -1 -1 -1000 -1000 -1000 -10 0.90\nDontCare -1 -1 -10 1 2 3 4 -1 -1 -1 -1000 -1000 -1000 -10\n")
    got = formats.read_kitti(spark, str(tmp_path)).collect()
    assert [(r["image_ref"], r["class_name"], r["x1"], r["y2"], r["conf"]) for r in got] == [("000001", "Car", 1.0, 4.0, 0.9)]


def test_unknown_format_is_refused():
    with pytest.raises(ValueError, match="no such format"):
        formats.writer("xyz")


def test_remap_and_report(spark, boxes):
    mapping = spark.createDataFrame([("car", "vehicle"), ("bus", "vehicle")], "source_class string, class_name string")
    assert {r["class_name"] for r in formats.remapped(boxes, mapping, "other").collect()} == {"vehicle", "other"}
    assert {(r["source_class"], r["class_name"]) for r in formats.taxonomy_report(boxes, mapping).collect()} == {("car", "vehicle"), ("bus", "vehicle"), ("cow", None)}


def test_published_schema_is_declared(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "frame_id long, flags array<string>")
    lake.publish(df, str(tmp_path / "t"), lake.LABELS)
    got = lake.scan(spark, str(tmp_path / "t"), lake.LABELS)
    assert got.schema.fieldNames() == lake.LABELS.fieldNames()
    assert got.first()["conf"] is None


def events(spark, n=400):
    t = F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(mins=F.col("id").cast("int") * 7)
    kind = F.when(F.col("id") % 50 == 49, "error").otherwise("view")
    return spark.range(n).select(F.col("id").alias("event_id"), t.cast("timestamp_ntz").alias("ts"), (F.col("id") % 10).alias("user_id"), kind.alias("event_type"), F.pmod(F.col("id") * 37, F.lit(101)).cast("double").alias("value"), F.lit("{}").alias("props"))


def test_stream_selects_what_the_batch_does(spark, tmp_path):
    events(spark).orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    policy = selector.Policy(warm_up=10, target=0.3)
    want = selector.select_batch(selector.from_events(spark.read.parquet(str(tmp_path / "in"))), policy)
    stream = selector.select_stream(selector.from_events(windows.read_events(spark, str(tmp_path / "in"))), policy)
    windows.drained(stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "camera", "ts", "why") == rows(want, "camera", "ts", "why")
    assert want.count() > 10


def test_selector_rules():
    import numpy as np

    s, p = selector.State(), selector.Policy()
    still = np.array([1.0, 0.0])
    assert selector.decide(s, still, False, 0, p) == "first"
    assert [selector.decide(s, still, False, 0, p) for _ in range(5)] == [None] * 5
    assert selector.decide(s, still, True, 0, p) == "rare"
    assert selector.decide(s, still, False, 9, p) is None
    selector.decide(s, still, False, 0, p)
    assert selector.decide(s, still, False, 9, p) == "dense"


def test_tumbling_windows_over_a_stream(spark, tmp_path):
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    windows.drained(windows.tumbling(windows.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    closed = events(spark).groupBy(F.to_date("ts").alias("d"), "event_type").count()
    assert 0 < got.count() <= closed.count()
    full = {(r["d"], r["event_type"]): r["count"] for r in closed.collect()}
    assert all(full[(r["start"].date(), r["event_type"])] == r["n"] for r in got.collect())

from __future__ import annotations

import json

from fieldloom import api
from fieldloom.sources import imports


def test_label_studio_percent(spark, tmp_path):
    result = {"original_width": 200, "original_height": 100, "value": {"x": 10, "y": 20, "width": 50, "height": 30, "rectanglelabels": ["car"]}}
    (tmp_path / "a.json").write_text(json.dumps([{"data": {"image": "i1"}, "annotations": [{"result": [result]}], "predictions": [{"result": [result | {"score": 0.5}]}]}]))
    got = imports.read_label_studio(spark, str(tmp_path)).collect()
    assert [(r["image_ref"], r["class_name"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in got] == [("i1", "car", 20.0, 20.0, 120.0, 50.0)]
    assert imports.read_label_studio(spark, str(tmp_path), True).count() == 2


def test_bdd_mapillary_cvat(spark, tmp_path):
    for name in ("bdd", "map", "cvat"):
        (tmp_path / name).mkdir()
    (tmp_path / "bdd" / "a.json").write_text(json.dumps([{"name": "i", "labels": [{"category": "bus", "box2d": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}}, {"category": "lane"}]}]))
    (tmp_path / "map" / "pic.json").write_text(json.dumps({"width": 9, "height": 8, "objects": [{"label": "cow", "polygon": [[1, 5], [4, 2], [3, 7]]}, {"label": "x", "polygon": []}]}))
    (tmp_path / "cvat" / "a.xml").write_text('<annotations><image name="p" width="5" height="6"><box label="dog" xtl="1" ytl="2" xbr="3" ybr="4"/></image><image name="q" width="5" height="6"/></annotations>')
    assert [(r["class_name"], r["x2"]) for r in imports.read_bdd(spark, str(tmp_path / "bdd")).collect()] == [("bus", 3.0)]
    got = imports.read_mapillary(spark, str(tmp_path / "map")).first()
    assert (got["image_ref"], got["x1"], got["y1"], got["x2"], got["y2"]) == ("pic", 1.0, 2.0, 4.0, 7.0)
    got = imports.read_cvat(spark, str(tmp_path / "cvat")).collect()
    assert [(r["image_ref"], r["class_name"], r["y2"]) for r in got] == [("p", "dog", 4.0)]


def test_nuscenes_links(spark, tmp_path):
    tables = {
        "sample": [{"token": f"s{i}", "timestamp": i, "scene_token": "c"} for i in range(3)],
        "instance": [{"token": "n", "category_token": "k"}],
        "category": [{"token": "k", "name": "car"}],
        "sample_annotation": [{"token": f"a{i}", "sample_token": f"s{i}", "instance_token": "n", "translation": [0, 0, 0], "size": [1, 1, 1]} for i in range(3)],
    }
    for name, rows in tables.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    got = imports.with_links(imports.read_nuscenes(spark, str(tmp_path))).orderBy("timestamp").collect()
    assert [(r["prev"], r["token"], r["next"]) for r in got] == [("", "a0", "a1"), ("a0", "a1", "a2"), ("a1", "a2", "")]


def test_image_folder_is_timed_by_name(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i:03}.jpg").write_bytes(b"x")
    got = imports.image_folder(spark, str(tmp_path), 10).orderBy("path").collect()
    assert [r["ts_ns"] for r in got] == [i * 100_000_000 for i in range(20)]


def test_load_by_terms(spark):
    frames = spark.createDataFrame([(1, 7, ("rain", "night")), (2, 7, ("clear", "day"))], "frame_id int, session_id int, scene struct<weather: string, time_of_day: string>")
    objects = spark.createDataFrame([(1, "bus", "A", 0.9), (1, "car", "R", 0.4), (2, "bus", "A", 0.8)], "frame_id int, class_name string, state string, conf double")
    sessions = spark.createDataFrame([(7, "BLR")], "session_id int, city string")
    words = {"night": ("time_of_day", ["night"]), "accepted": ("states", ["A"])}
    got = api.load("night AND accepted", objects, frames, sessions, words)
    assert [(r["frame_id"], r["class_name"]) for r in got.objects.collect()] == [(1, "bus")]
    assert [r["frame_id"] for r in got.frames.collect()] == [1]
    assert got.terms == ["night", "accepted"]
    assert api.load("accepted", objects, frames, sessions, words, sealed=frames.where("frame_id = 2").select("frame_id")).objects.count() == 1

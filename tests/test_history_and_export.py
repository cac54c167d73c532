"""Versions, merges and their reverting; exports that are killed and resumed; seals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import history as H
from fieldloom.operators import sets
from fieldloom.sources import export, formats, lake

STATE = "k long, cls string, conf double"


def rows(df):
    return sorted(map(tuple, df.select("k", "cls", "conf").collect()))


def state(spark, *values):
    return spark.createDataFrame(list(values), STATE)


def test_seals_tell_different_rows_apart(spark):
    def seal(*values):
        return sets.fingerprint(spark.createDataFrame(list(values), "a string, b string").repartition(3), ["a", "b"]).first()["seal"]

    many = [[("a|b", "c")], [("a", "b|c")], [(None, "x")], [("", "x")], [("x", None)], [("1:x", "")], [("x", ""), ("x", "")], [("x", "")], [("-", "-")], [(None, None)], [("a", "b"), ("c", "d")], [("a", "d"), ("c", "b")]]
    assert len({seal(*v) for v in many}) == len(many)
    assert seal(("a", "b"), ("c", "d")) == seal(("c", "d"), ("a", "b"))


def test_changes_apply_and_revert(spark):
    old = state(spark, (1, "a", 0.5), (2, "b", None), (3, "c", 0.1))
    new = state(spark, (1, "a", 0.5), (2, "b", 0.2), (4, None, 0.9))
    log = H.changes(old, new, "k")
    assert sorted(tuple(r) for r in log.select("k", "op").collect()) == [(2, "update"), (3, "delete"), (4, "insert")]
    assert rows(H.applied(old, log, "k")) == rows(new)
    back, outcomes = H.reverted(new, log, "k")
    assert rows(back) == rows(old) and {r["outcome"] for r in outcomes.collect()} == {"reverted"}
    edited = state(spark, (1, "z", 0.5), (2, "b", 0.3), (3, "new", 1.0), (4, None, 0.9))
    back, outcomes = H.reverted(edited, log, "k")
    assert rows(back) == [(1, "z", 0.5), (2, "b", 0.3), (3, "new", 1.0)]
    assert sorted(tuple(r) for r in outcomes.select("k", "outcome").collect()) == [(2, "skipped"), (3, "skipped"), (4, "reverted")]
    assert H.changes(old, old, "k").count() == 0 and rows(H.applied(old, log.limit(0), "k")) == rows(old)


def test_three_way_merge(spark):
    base = state(spark, (1, "a", 0.1), (2, "a", 0.2), (3, "a", 0.3), (4, "a", 0.4), (5, "a", 0.5), (6, "a", 0.6), (7, "a", None))
    ours = state(spark, (1, "b", 0.1), (2, "a", 0.2), (3, "o", 0.3), (4, "a", 0.4), (6, "o", 0.6), (7, "a", None), (8, "n", 1.0), (9, "n", 1.0))
    theirs = state(spark, (1, "a", 0.1), (2, "t", 0.2), (3, "t", 0.3), (5, "a", 0.5), (7, "a", None), (8, "n", 1.0), (9, "m", 1.0))
    merge = H.merged(base, ours, theirs, "k")
    assert {r["k"]: r["outcome"] for r in merge.collect()} == {1: "ours", 2: "theirs", 3: "conflict", 4: "theirs", 5: "ours", 6: "conflict", 7: "kept", 8: "both", 9: "conflict"}
    want = [(1, "b", 0.1), (2, "t", 0.2), (3, "o", 0.3), (6, "o", 0.6), (7, "a", None), (8, "n", 1.0), (9, "n", 1.0)]
    assert rows(H.restored(merge, "k", "result", base.columns)) == want
    chosen = H.settled(merge, "k", F.col("k") == 3)
    assert (3, "t", 0.3) in rows(H.restored(chosen, "k", "result", base.columns)) and chosen.where("outcome = 'settled'").count() == 3


def test_a_reverted_merge_gives_the_sealed_state_back(spark):
    base = state(spark, *((k, "a", k / 10) for k in range(20)))
    left = H.applied(base, H.changes(base, base.withColumn("cls", F.when(F.col("k") < 5, "l").otherwise(F.col("cls"))), "k"), "k")
    right = base.where("k <> 11").withColumn("conf", F.when(F.col("k") > 15, 9.0).otherwise(F.col("conf")))
    steps = {"c1": (base, base), "c2": (base, left), "c3": (base, right), "c4": (left, H.restored(H.merged(base, left, right, "k"), "k", "result", base.columns))}
    logs = None
    for name, (old, new) in steps.items():
        log = H.changes(old, new, "k").select(F.lit(name).alias("commit"), "k", "before", "after")
        logs = log if logs is None else logs.unionByName(log)
    commits = spark.createDataFrame([("c1", None, None), ("c2", "c1", None), ("c3", "c1", None), ("c4", "c2", "c3"), ("x", None, None)], "id string, parent string, other string")
    seal = lambda df: sets.fingerprint(df, ["k", "cls", "conf"]).first()["seal"]
    assert H.merge_base(commits, "c2", "c3") == "c1" and H.merge_base(commits, "c4", "c3") == "c3" and H.merge_base(commits, "c4", "x") is None
    assert rows(H.state_at(base, commits, logs, "c4", "k")) == rows(steps["c4"][1])
    assert rows(H.state_at(base, commits, logs, "c3", "k")) == rows(right)
    back, _ = H.reverted(H.state_at(base, commits, logs, "c4", "k"), H.changes(left, steps["c4"][1], "k"), "k")
    assert seal(back) == seal(left) != seal(steps["c4"][1])


def test_vocabulary_is_merged_renamed_and_retired(spark):
    now, log = H.recoded(state(spark, (1, "car", 0.1), (2, "auto", 0.2), (3, "old", 0.3), (4, None, 0.4)), "k", "cls", {"auto": "car", "old": None})
    assert rows(now) == [(1, "car", 0.1), (2, "car", 0.2), (3, None, 0.3), (4, None, 0.4)]
    assert sorted(r["k"] for r in log.collect()) == [2, 3]


def sample(spark, n=200, changed=()):
    made = [(f"o{k}", f"f{k // 4}", "s1", 0.5 + (k in changed), "car", "accepted", 1.0, 2.0, 30.0, 40.0, {"a": str(k)}, [k, 2]) for k in range(n)]
    return spark.createDataFrame(made, "object_id string, frame_id string, session_id string, conf double, class_name string, state string, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, attrs map<string,string>, polyline array<int>")


def content(spark, path):
    return sorted(map(str, export.read_export(spark, path).collect()))


def test_records_have_thirty_columns_and_come_back_whole(spark, tmp_path):
    path = str(tmp_path / "e")
    commit = export.export(sample(spark), path, "spec", "v1", chunk_rows=30, others=("coco",)).first()
    found = export.read_export(spark, path)
    assert len(found.columns) == 30 and found.columns[:3] == ["object_id", "frame_id", "session_id"] and found.columns[-1] == "split"
    assert content(spark, path) == sorted(map(str, export.records(sample(spark)).collect()))
    assert found.where("object_id = 'o7'").first()["attrs_json"] == '{"a":"7"}' and found.where("track_id IS NOT NULL").count() == 0
    assert commit["n"] == 200 and commit["formats"] == ["parquet", "coco"] and formats.read_coco(spark, f"{path}/coco").count() == 200
    assert {r["same"] for r in export.round_trip(spark, path).collect()} == {True}
    with pytest.raises(ValueError):
        export.export(sample(spark), str(tmp_path / "x"), "spec", "v1", others=("nope",))
    assert not (tmp_path / "x").exists()


def test_a_killed_export_resumes_to_the_same(spark, tmp_path, monkeypatch):
    whole, path = str(tmp_path / "whole"), str(tmp_path / "killed")
    want = export.export(sample(spark), whole, "spec", "v1", chunk_rows=25, at_once=2).first()
    repartition, runs = type(sample(spark)).repartition, []

    def dies(self, *a):
        if a == ("chunk",):
            runs.append(1)
            if len(runs) == 3:
                raise OSError("disk is gone")
        return repartition(self, *a)

    monkeypatch.setattr(type(sample(spark)), "repartition", dies)
    with pytest.raises(OSError, match="gone"):
        export.export(sample(spark), path, "spec", "v1", chunk_rows=25, at_once=2)
    monkeypatch.undo()
    assert 0 < len(export.manifest(spark, path)) < want["chunks"]
    again = export.export(sample(spark), path, "spec", "v1", chunk_rows=25, at_once=2).first()
    assert again["commit_id"] == want["commit_id"] and again["written"] == want["written"] - 4
    assert content(spark, path) == content(spark, whole)
    assert export.export(sample(spark), path, "spec", "v1", chunk_rows=25).first()["written"] == 0


def test_only_chunks_that_differ_are_written_again(spark, tmp_path):
    path = str(tmp_path / "e")
    first = export.export(sample(spark), path, "spec", "v1", chunk_rows=25).first()
    now = export.export(sample(spark, changed={17}), path, "spec", "v1", chunk_rows=25).first()
    assert now["written"] == 1 and now["commit_id"] != first["commit_id"]
    assert content(spark, path) == sorted(map(str, export.records(sample(spark, changed={17})).collect()))
    less = export.export(sample(spark).where("frame_id = 'f3'"), path, "spec", "v1", chunk_rows=25).first()
    assert less["n"] == 4 and content(spark, path) == sorted(map(str, export.records(sample(spark).where("frame_id = 'f3'")).collect()))
    none = export.export(sample(spark).limit(0), str(tmp_path / "none"), "spec", "v1").first()
    assert none["n"] == 0 and export.read_export(spark, str(tmp_path / "none")).count() == 0


def test_published_tables_keep_their_schemas(spark, tmp_path):
    quality = spark.createDataFrame([("o1", 0.5, None)], "object_id string, quality double, flags array<string>")
    reviews = spark.createDataFrame([(1, "o1", "confirm", 5)], "review_id long, object_id string, action string, time_spent_ms long")
    lake.publish_all({"quality": quality, "provenance": reviews}, str(tmp_path))
    for name in ("quality", "provenance"):
        found = lake.scan(spark, str(tmp_path / name), lake.TABLES[name])
        assert found.count() == 1 and found.schema.names == lake.TABLES[name].names
    assert len(lake.TABLES["labels"]) == 18 and len(lake.TABLES["provenance"]) == 11
    with pytest.raises(ValueError, match="other"):
        lake.publish_all({"other": quality}, str(tmp_path))

"""Reranking, hybrid search, near copies, suspect labels and reviews on tables made by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import curation as C
from fieldloom.operators import reviews as R


def frames(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, track string, embedding array<double>")


def test_reranking_drops_the_own_track_and_copies(spark):
    rows = [(1, "own", [1.0, 0.0]), (2, "x", [1.0, 0.01]), (3, "x", [1.0, 0.011]), (4, None, [1.0, 0.5]), (5, "y", [0.0, 1.0]), (6, "y", None), (7, "z", [-1.0, 0.0])]
    df = frames(spark, rows)
    got = C.reranked(df, [1.0, 0.0], 3, 0.0, not_track=F.col("track") == "own").orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in got] == [(2, 1), (4, 2), (5, 3)]
    plain = C.reranked(df, [1.0, 0.0], 3, 0.0, copies=None).orderBy("rank").collect()
    assert [r["vec_id"] for r in plain] == [1, 2, 3]
    assert C.reranked(df.limit(0), [1.0, 0.0], 3).count() == 0


def test_a_condition_that_leaves_too_few_does_not_filter(spark):
    df = frames(spark, [(k, "a" if k < 2 else "b", [1.0, k / 10]) for k in range(6)])
    rare = spark.createDataFrame([(5, 1.0)], "vec_id long, rarity double")
    few, filtered = C.hybrid(df, [1.0, 0.0], 3, F.col("track") == "a")
    assert not filtered and [r["vec_id"] for r in few.orderBy("rank").collect()] == [0, 1, 2]
    some, filtered = C.hybrid(df, [1.0, 0.0], 2, F.col("track") == "b", rare, 0.5)
    assert filtered and [r["vec_id"] for r in some.orderBy("rank").collect()] == [5, 2]
    same, _ = C.hybrid(df, [1.0, 0.0], 2, None, rare, 0.0)
    assert [r["vec_id"] for r in same.orderBy("rank").collect()] == [0, 1]


def test_rarity_is_that_of_the_rarest_class(spark):
    objects = spark.createDataFrame([("f1", 1), ("f1", 1), ("f1", 2), ("f2", 1), ("f3", 1), ("f4", None)], "frame string, cls int")
    got = {r["frame"]: r["rarity"] for r in C.rarities(objects, "frame", "cls").collect()}
    assert got["f1"] == pytest.approx(1.0) and 0 < got["f2"] == got["f3"] < 0.3 and "f4" not in got


def test_copies_need_both_hash_and_vector(spark):
    rows = [(1, 0b0000, 0.2, [1.0, 0.0]), (2, 0b0001, 0.9, [1.0, 0.05]), (3, 0b0011, None, [1.0, 0.1]), (4, 0b0001, 0.5, [0.0, 1.0]), (5, -1, 0.5, [1.0, 0.0]), (6, None, 0.5, [1.0, 0.0]), (7, 0, 0.5, None)]
    df = spark.createDataFrame(rows, "id long, bits long, q double, v array<double>")
    got = {r["id"]: (r["group"], r["canonical"], round(r["score"], 3)) for r in C.copy_groups(df, "id", "bits", "v", "q", most=1).collect()}
    assert got == {1: (1, False, 0.999), 2: (1, True, 1.0), 3: (1, False, 0.999)}


def test_conflicts_within_tracks_and_between_near_frames(spark):
    rows = [("o1", "t", "a"), ("o2", "t", "a"), ("o3", "t", "b"), ("o4", "u", "a"), ("o5", "u", "b"), ("o6", "w", "b"), ("o7", "w", "a"), ("o8", "w", "a"), ("o9", "w", "b"), ("n", None, "a"), ("m", "t", None)]
    got = sorted((r["object_id"], r["given"], r["proposed"], r["score"]) for r in C.group_conflicts(spark.createDataFrame(rows, "object_id string, track string, cls string"), "object_id", "track", "cls").collect())
    assert got == [("o3", "b", "a", 0.666667), ("o6", "b", "a", 0.5), ("o9", "b", "a", 0.5)]
    objects = spark.createDataFrame([("o1", 1, "a", 0.2), ("o2", 1, "b", 0.9), ("o3", 2, "a", 0.5), ("o4", 3, "c", None), ("o5", 4, "d", 0.1)], "object_id string, frame int, cls string, conf double")
    near = spark.createDataFrame([(1, 2, 0.98), (2, 1, 0.98), (3, 1, 1.0), (4, 9, 1.0)], "a int, b int, similarity double")
    got = {r["object_id"]: (r["other"], r["score"]) for r in C.frame_conflicts(objects, near, "object_id", "frame", "cls", "conf").collect()}
    assert got == {"o2": (2, pytest.approx(0.1 * 0.75, abs=1e-5)), "o4": (1, 1.0)}


REVIEW = "review_id int, object int, reviewer string, action string, before string, after string, ms long, t long"


def test_reviews_of_people_are_counted(spark):
    rows = [
        (1, 1, "ann", "accept", "a", "a", 60_000, R.DAY), (2, 1, "bob", "reclassify", "a", "b", 60_000, R.DAY), (3, 2, "ann", "reject", None, None, None, 2 * R.DAY),
        (4, 1, "ann", "reclassify", "a", "b", 0, 2 * R.DAY), (5, 1, "system", "accept", "a", "z", 9, R.DAY), (6, 3, None, "accept", "a", "a", 9, R.DAY), (7, 2, "cy", "note", None, "q", 1, 0),
    ]
    df = spark.createDataFrame(rows, REVIEW)
    got = {r["reviewer"]: tuple(r)[1:] for r in R.reviewer_metrics(df).collect()}
    assert got["ann"] == (3, pytest.approx(2 / 3), 20_000.0, pytest.approx(180.0), 0.5) and got["cy"] == (1, None, 1.0, None, None) and set(got) == {"ann", "bob", "cy"}
    assert tuple(R.shared_agreement(df).first()) == (1, 1, 1.0)  # ann's last word is bob's
    assert sorted(map(tuple, R.throughput(df).collect())) == [(1, 2, 0.5), (2, 2, 0.0)] and R.throughput(df, 1).first()["day"] == 2
    cost = R.costs(df, spark.createDataFrame([(1, "auto_accept"), (1, "x")], "frame int, state string"), "frame", "state").first()
    assert (cost["n_objects"], cost["n_frames"], cost["n_auto"]) == (2, 1, 1) and cost["saved_hours"] == pytest.approx(20 / 3600)
    none = df.limit(0)
    assert tuple(R.shared_agreement(none).first()) == (0, 0, None) and R.reviewer_metrics(none).count() == 0
    assert R.costs(none, spark.createDataFrame([], "frame int, state string"), "frame", "state").first()["usd_per_object"] is None

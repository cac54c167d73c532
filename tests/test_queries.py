"""Every query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from fieldloom import plans

SF = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = SF / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if path.is_file() else path / '*.parquet'}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return round(float(v), 4)
    return str(v)[:10] if hasattr(v, "year") else str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, str(SF))
    want = duck.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, str(SF)).count() > 0


def test_enough_queries():
    assert len(plans.ORACLES) >= 95


@pytest.mark.parametrize("name", ["frames_without_objects", "predicate_frames_exists", "events_cooccur_overlap", "nearest_event_asof", "near_dup_pairs", "reconcile_actions"])
def test_plan_has_no_nested_loop(spark, name):
    plan = plans.QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_value_score_keeps_its_rows_partitioned(spark):
    from fieldloom.plans import evaluation

    plan = evaluation.value_score(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_lake_tables_reads_its_objects_once(spark):
    plan = plans.QUERIES["lake_tables"](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linestatus") and len([line for line in plan.splitlines() if "Relation" in line and "l_orderkey" in line]) == 1

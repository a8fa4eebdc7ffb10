"""Every registered query runs; a few are checked against their SQL; plans keep their shape."""

import glob
import os
import re

import pandas as pd
import pytest

import __spark_entry__ as entry
from ripplemark.catalog.oracles import ORACLES
from ripplemark.catalog.queries import QUERIES

CHECKED = ["daily_rv", "last_tick_bins_anchored", "kernel_own_bandwidth", "wf_models", "dm_lag_grid", "results_table", "tick_sanity"]


@pytest.fixture(scope="module")
def duck(small_dir):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{small_dir}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def comparable(frame):
    columns = sorted(frame.columns)
    text = frame[columns].map(lambda v: "~" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) else str(v))
    return text.sort_values(columns).reset_index(drop=True)


def test_every_sql_has_a_query():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, small_dir, name):
    mine = comparable(QUERIES[name](spark, small_dir).toPandas())
    pd.testing.assert_frame_equal(mine, comparable(duck.execute(ORACLES[name]).df()))
    assert len(mine)


def test_entry_runs(spark, small_dir):
    assert entry.entry(spark).count() > 0


def test_no_plan_gathers_everything_or_multiplies_rows(spark, small_dir):
    """No cross join, and no exchange that sends all rows to one task (bar whole-table counts)."""
    whole_table = {"ridge_uses_no_evaluation_data"}
    for name in ("daily_rv", "wf_models", "results_table", "dm_lags", "tick_sanity", "autocorrelation", "expected_hours_missing",
                 "variance_by_frequency", "ridge_verdict", "known_totals", "head_to_head"):
        plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), name
        assert name in whole_table or "SinglePartition" not in plan, name

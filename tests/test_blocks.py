"""Walk-forward in blocks: any cut gives the fits of whole pasts."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import daily_values, ols, prepared_frame, slow_walk, smoothing
from ripplemark.operators.blocks import Moments, Running, damped_fit, runs, smoothed
from ripplemark.operators.forecasts import walk_forward, walk_forward_models
from ripplemark.operators.models import regression, smoothing as smoothing_model

HAR = ("log_rv_mean_1", "log_rv_mean_5", "log_rv_mean_22")
MODELS = {
    "mean": (regression("mean"), ols()), "naive": (smoothing_model("naive", 0.0), smoothing(0.0)),
    "ewma": (smoothing_model("ewma", 0.94), smoothing(0.94)), "short": (smoothing_model("short", 1e-9), smoothing(1e-9)),
    "har": (regression("har", HAR), ols()), "ridge": (regression("ridge", HAR, penalty=2.5), ols(2.5)),
}


def same_products(a, b):
    size = np.sqrt(np.diag(b.T @ b)) + 1e-300
    np.testing.assert_allclose((a.T @ a) / np.outer(size, size), (b.T @ b) / np.outer(size, size), atol=1e-9)


def test_merged_moments_are_those_of_all_rows():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(40, 3)) @ np.diag([1.0, 1e-2, 1e3]) + [0.0, 1e3, -1e5]
    whole = Moments.of(rows)
    for cuts in ([20], [1, 2, 3], [0, 0, 39, 40]):
        parts = np.split(rows, cuts)
        merged = Moments.none(3)
        for part in parts:
            merged = merged.merged(Moments.unpacked(Moments.of(part).packed(), 3))
        assert merged.n == 40
        np.testing.assert_allclose(merged.mean, whole.mean, rtol=1e-13)
        same_products(merged.factor, whole.factor)
        for k in (0, 1, 17):
            n, mean, held = Moments.of(rows[:20]).stacked(rows[20 : 20 + k])
            same_products(held, Moments.of(rows[: 20 + k]).factor)
            assert n == 20 + k
    running = Running(Moments.of(rows[:7]), rows[7:])
    n, mean, products, _ = running.at(np.array([0, 5, 33]))
    assert n.tolist() == [7, 12, 40]
    np.testing.assert_allclose(running.shift + mean[2], whole.mean, rtol=1e-13)


def test_damped_fits_equal_least_squares_and_smoothing_continues():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 2))
    y = 2 + x @ [1.0, -3.0] + rng.normal(size=30)
    held = Moments.of(np.column_stack((x, y)))
    intercept, slopes = damped_fit(30, held.mean, held.factor, 0.0)
    expected = np.linalg.lstsq(np.column_stack((np.ones(30), x)), y, rcond=None)[0]
    np.testing.assert_allclose([intercept, *slopes], expected, rtol=1e-12)
    for decay in (0.0, 0.5, 0.99):
        whole = smoothed(y, decay, None)
        np.testing.assert_allclose(smoothed(y[11:], decay, whole[11]), whole[11:], rtol=1e-12)
    assert np.isnan(smoothed(y[:0], 0.5, None)[0]) and smoothed(y[:0], 0.5, 7.0).tolist() == [7.0]


def test_runs_join_over_batches():
    import pyarrow as pa

    frame = pd.DataFrame({"k": [1, 1, 1, 2, 3, 3], "v": range(6)})
    for size in (1, 2, 4, 6):
        batches = [pa.RecordBatch.from_pandas(frame.iloc[k : k + size], preserve_index=False) for k in range(0, 6, size)]
        assert [r.v.tolist() for r in runs(iter([batches[0].slice(0, 0), *batches]), ["k"])] == [[0, 1, 2], [3], [4, 5]]


@pytest.mark.parametrize("days", [1, 9, 40])
def test_forecasts_of_any_blocks_equal_refits(spark, days):
    table = prepared_frame(daily_values(85))
    doubled = table.assign(twin=table[HAR[0]] * 2, **{c: table[c] + 1e6 for c in HAR[1:]})
    models = {**MODELS, "twin": (regression("twin", (HAR[0], "twin")), ols())}
    data = spark.createDataFrame(doubled.assign(series="A")).union(spark.createDataFrame(doubled.assign(series="B")))
    result = walk_forward_models(data, [m for m, _ in models.values()], min_train_size=20, block=lambda at: F.floor(at / days))
    rows = result.orderBy("series", "target_date").collect()
    for name, (model, fit) in models.items():
        expected = slow_walk(table.assign(twin=doubled.twin), model.regressors, fit, 20)  # levels change no forecast
        for series in "AB":
            got = [r for r in rows if r.model == name and r.series == series]
            assert [(r.target_date, r.n_train) for r in got] == [(d, n) for d, _, n in expected]
            np.testing.assert_allclose([r.predicted for r in got], [p for _, p, _ in expected], rtol=1e-7)


def test_plain_columns_agree_to_the_last_digits(spark):
    table = prepared_frame(daily_values(85))
    data = spark.createDataFrame(table.assign(series="A"))
    for name in ("har", "ridge", "ewma"):
        model, fit = MODELS[name]
        got = walk_forward(data, model, min_train_size=20, block=lambda at: F.floor(at / 13)).orderBy("target_date").collect()
        np.testing.assert_allclose([r.predicted for r in got], [p for _, p, _ in slow_walk(table, model.regressors, fit, 20)], rtol=1e-12)


def test_times_as_dates_are_cut_by_day_and_no_group_holds_a_series(spark):
    rng = np.random.default_rng(8)
    n = 400
    start = datetime(2024, 1, 1)
    x = rng.normal(size=n)
    rows = [("S", start + timedelta(hours=k), start + timedelta(hours=k + 1), float(x[k]), float(2 * x[k] + rng.normal())) for k in range(n)]
    data = spark.createDataFrame(rows, "series string, origin_date timestamp, target_date timestamp, x double, target double")
    models = [regression("line", ("x",)), smoothing_model("ewma", 0.9)]
    result = walk_forward_models(data, models, min_train_size=30)
    assert "FlatMapGroups" not in result._jdf.queryExecution().executedPlan().toString()
    table = data.toPandas()
    for model, fit in zip(models, (ols(), smoothing(0.9)), strict=True):
        got = result.where(F.col("model") == model.name).orderBy("target_date").collect()
        expected = slow_walk(table, model.regressors, fit, 30)
        np.testing.assert_allclose([r.predicted for r in got], [p for _, p, _ in expected], rtol=1e-12)
        assert [r.n_train for r in got] == [k for _, _, k in expected]

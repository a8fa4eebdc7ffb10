import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import newey_west_test
from ripplemark.checks import DataError
from ripplemark.functions.losses import absolute_error, qlike, squared_error
from ripplemark.operators import comparison as C

DAY = date(2024, 1, 1)


def losses(spark, table, series="S"):
    """A loss table from lists of losses by model."""
    rows = [
        (m, DAY + timedelta(days=k - 1), DAY + timedelta(days=k), series, float(v))
        for m, values in table.items() for k, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "model string, origin_date date, target_date date, series string, loss double")


def forecast_frame(spark, errors, series="S"):
    rows = [
        (m, series, DAY + timedelta(days=k), DAY + timedelta(days=k + 1), 1.0 + k, 1.0 + k + e)
        for m, e in errors.items() for k in range(20)
    ]
    return spark.createDataFrame(rows, "model string, series string, origin_date date, target_date date, actual double, predicted double")


def one_test(spark, baseline, candidate, lags=None):
    table = losses(spark, {"base": baseline, "cand": candidate})
    return C.diebold_mariano(C.paired_losses(table, "cand"), lags=lags).first()


@pytest.mark.parametrize("n, lags", [(3, 1), (20, 0), (20, 2), (60, 7), (120, 40)])
def test_statistic_equals_the_definition(spark, n, lags):
    rng = np.random.default_rng(n + lags)
    base, cand = rng.gamma(2, 1, n) + 0.2, rng.gamma(2, 1, n)
    row = one_test(spark, base, cand, lags)
    z, p = newey_west_test(base - cand, lags)
    if math.isfinite(z):
        assert row.statistic == pytest.approx(z, rel=1e-9)
        assert row.p_value == pytest.approx(p, rel=1e-9)
    assert row.n_obs == n and row.hac_lags == lags


def test_default_lags(spark):
    rng = np.random.default_rng(1)
    row = one_test(spark, rng.gamma(2, 1, 100), rng.gamma(2, 1, 100))
    assert row.hac_lags == 4


def test_degenerate_differences(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    row = one_test(spark, same, same)
    assert (row.statistic, row.p_value) == (0.0, 0.5)
    row = one_test(spark, [v + 1 for v in same], same)
    assert (row.statistic, row.p_value) == (math.inf, 0.0)
    row = one_test(spark, same, [v + 1 for v in same])
    assert (row.statistic, row.p_value) == (-math.inf, 1.0)


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e9])
def test_scaling_every_loss_changes_nothing(spark, scale):
    rng = np.random.default_rng(9)
    base, cand = rng.gamma(2, 1, 50), rng.gamma(2, 1, 50)
    a, b = one_test(spark, base, cand), one_test(spark, base * scale, cand * scale)
    assert b.statistic == pytest.approx(a.statistic, rel=1e-9)
    flat = one_test(spark, (np.ones(10) * 3) * scale, np.ones(10) * scale)
    assert flat.statistic == math.inf


def test_too_few_dates_or_too_many_lags_give_null(spark):
    assert one_test(spark, [1.0, 2.0], [2.0, 1.0]).statistic is None
    assert one_test(spark, [1.0, 2.0, 4.0], [2.0, 1.0, 1.0], 2).statistic is None
    assert one_test(spark, [1.0, 2.0, 4.0], [2.0, 1.0, 1.0], 1).statistic is not None


def test_all_lags_from_one_pass(spark):
    rng = np.random.default_rng(2)
    table = {"base": rng.gamma(2, 1, 80), "other": rng.gamma(2, 1, 80), "cand": rng.gamma(2, 1, 80)}
    rows = C.hac_sensitivity(losses(spark, table), "cand", "grid").collect()
    assert sorted(r.hac_lags for r in rows if r.baseline_model == "base") == [0, 1, 2, 3, 6, 12, 18]
    for r in rows:
        z, p = newey_west_test(table[r.baseline_model] - table["cand"], r.hac_lags)
        assert r.statistic == pytest.approx(z, rel=1e-9) and r.p_value == pytest.approx(p, rel=1e-9)
    short = C.hac_sensitivity(losses(spark, table), "cand").where("baseline_model = 'base'").collect()
    assert sorted(r.hac_lags for r in short) == [0, 1, 2, 3]


@pytest.mark.parametrize("bad", [[], [1, 1], [-1], [True], [1.5]])
def test_bad_lags(spark, bad):
    with pytest.raises(ValueError):
        C.hac_sensitivity(losses(spark, {"a": [1, 2, 3], "b": [1, 2, 3]}), "a", bad)


def test_win_rates_with_ties(spark):
    table = losses(spark, {"cand": [1.0, 1.0, 2.0, 1.0], "base": [2.0, 1.0 + 5e-6, 1.0, 1.0 + 2e-5], "zero": [0.0] * 4})
    got = {r.baseline_model: r for r in C.win_rates(table, "cand").collect()}
    assert (got["base"].candidate_wins, got["base"].ties, got["base"].n_obs) == (2, 1, 4)
    assert got["base"].candidate_win_rate == 0.5 and got["zero"].candidate_wins == 0
    strict = C.win_rates(table, "cand", tie_rtol=0.0).where("baseline_model = 'base'").first()
    assert (strict.candidate_wins, strict.ties) == (3, 0)
    wide = C.win_rates(table, "cand", tie_rtol=0.0, tie_atol=1.5).where("baseline_model = 'base'").first()
    assert wide.ties == 4
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            C.win_rates(table, "cand", tie_rtol=bad)


def test_mean_losses_and_results(spark):
    frame = forecast_frame(spark, {"base": 0.5, "cand": 0.2}).union(forecast_frame(spark, {"base": 0.1, "cand": 0.4}, "T"))
    table = C.forecast_losses(frame, squared_error, check=True)
    got = {(r.series, r.model): r for r in C.compare_models(table, "cand").collect()}
    assert got["S", "base"].mean_loss == pytest.approx(0.25) and got["S", "cand"].mean_loss == pytest.approx(0.04)
    assert got["S", "cand"].p_value is None and got["S", "cand"].dm_statistic is None
    rows = C.results_table(table, "cand").collect()
    assert [(r.series, r.model) for r in rows] == [("S", "cand"), ("S", "base"), ("T", "base"), ("T", "cand")]
    assert rows[1].lower_by == pytest.approx(1 - 0.04 / 0.25) and rows[1].candidate_win_rate == 1.0
    assert rows[0].lower_by == pytest.approx(0) and rows[0].candidate_win_rate is None


def test_losses_plug_in(spark):
    @F.pandas_udf(T.DoubleType())
    def cubed(actual: pd.Series, predicted: pd.Series) -> pd.Series:
        return (actual - predicted).abs() ** 3

    frame = forecast_frame(spark, {"m": 0.5})
    for loss, value in ((absolute_error, 0.5), (squared_error, 0.25), (cubed, 0.125)):
        assert C.forecast_losses(frame, loss).first().loss == pytest.approx(value)


def test_losses_must_be_sound(spark):
    frame = forecast_frame(spark, {"a": 0.5, "b": 0.2})
    for loss in (lambda a, p: a - a - 1, lambda a, p: a * float("nan"), lambda a, p: F.lit(None).cast("double")):
        with pytest.raises(DataError, match="loss"):
            C.forecast_losses(frame, loss, check=True)
    with pytest.raises(DataError, match="loss"):
        C.forecast_losses(frame.withColumn("predicted", -F.col("predicted")), qlike, check=True)


def test_models_must_cover_the_same_cases(spark):
    frame = forecast_frame(spark, {"a": 0.5, "b": 0.2})
    last = F.lit(DAY + timedelta(days=20))
    other = F.when((F.col("model") == "b") & (F.col("target_date") == last), F.col("actual") + 1)
    for uneven in (frame.where(~((F.col("model") == "b") & (F.col("target_date") == last))), frame.withColumn("actual", other.otherwise(F.col("actual")))):
        with pytest.raises(DataError, match="identical dates"):
            C.forecast_losses(uneven, squared_error, check=True)
    # Series are compared on their own, so their dates may differ.
    C.forecast_losses(frame.union(forecast_frame(spark, {"a": 0.1}, "T").limit(5)), squared_error, check=True)


def test_a_single_unnamed_series_is_called_default(spark):
    table = C.forecast_losses(forecast_frame(spark, {"a": 0.5}).drop("series"), squared_error, check=True)
    assert table.first().series == "default"


def test_pairing_needs_no_join(spark):
    plan = C.paired_losses(losses(spark, {"a": [1, 2], "b": [2, 1]}), "a")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_loss_matrix(spark):
    rows = C.loss_matrix(losses(spark, {"a": [1, 2], "b": [3, 4]}), ["b", "a"]).orderBy("target_date").collect()
    assert [tuple(r)[2:] for r in rows] == [(3.0, 1.0), (4.0, 2.0)]


def test_an_unknown_candidate_and_a_lone_one_are_refused(spark):
    losses = spark.createDataFrame([("S", "a", date(2024, 1, 1), 1.0), ("S", "b", date(2024, 1, 1), 2.0)],
                                   "series string, model string, target_date date, loss double")
    for run in (C.compare_models, C.win_rates):
        with pytest.raises(DataError, match="no candidate 'NOPE'"):
            run(losses, "NOPE", check=True)
        with pytest.raises(DataError, match="no model to compare"):
            run(losses.where("model = 'a'"), "a", check=True)
        with pytest.raises(DataError, match="no candidate"):
            run(losses.limit(0), "a", check=True)

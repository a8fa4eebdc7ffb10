"""Reports that count faults, lagged products by blocks, histograms without a window, rules that learn step by step."""

import sys
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from helpers import daily_values, prepared_frame
from ripplemark.checks import DataError
from ripplemark.operators import features as X
from ripplemark.operators.comparison import diebold_mariano, paired_losses, untestable_pairs
from ripplemark.operators.forecasts import walk_forward
from ripplemark.operators.models import own_rule
from ripplemark.operators.sampling import last_tick_sample
from ripplemark.operators.variance import realized_variance, summarize_paths
from ripplemark.plans.daily import label_sessions
from ripplemark.plans.descriptive import autocorrelation, histogram

cloudpickle.register_pickle_by_value(sys.modules[__name__])
DAYS = [date(2024, 1, 1) + timedelta(days=k) for k in range(12)]


def parts(spark):
    features = spark.createDataFrame([("S", d, 1.0, 2.0) for d in DAYS], "series string, origin_date date, a double, b double")
    rows = [("S", d, n, 1.0 if n else None) for d, n in zip(DAYS, [*DAYS[1:], None], strict=True)]
    return features, spark.createDataFrame(rows, "series string, origin_date date, target_date date, target double")


def report(features, targets):
    return {r.series: {c: r[c] for c in (*X.PREPARATION_FAULTS, "first_unmatched") if r[c]} for r in X.preparation_violations(features, targets).collect()}


def test_every_preparation_fault_is_counted_where_it_is(spark):
    features, targets = parts(spark)
    at, nothing = F.col("origin_date"), F.lit(None)
    assert report(features, targets) == {"S": {}}
    wide = features.withColumn("b", F.when(at.isin(DAYS[2], DAYS[4]), float("inf")).otherwise(F.col("b")))
    assert report(wide, targets) == {"S": {"feature_not_finite": 2}}
    lost = features.withColumn("origin_date", F.when(at == F.lit(DAYS[3]), nothing).otherwise(at))
    assert report(lost, targets) == {"S": {"feature_keyless": 1}}
    nameless = features.withColumn("series", F.when(at == F.lit(DAYS[3]), nothing).otherwise(F.col("series")))
    assert report(nameless, targets) == {"S": {}, None: {"feature_keyless": 1}}
    assert report(features.union(features.where(at < F.lit(DAYS[3]))), targets) == {"S": {"feature_repeated": 3}}
    short = targets.where(at != F.lit(DAYS[5]))
    assert report(features, short) == {"S": {"unmatched": 1, "first_unmatched": DAYS[5], "target_not_next": 1}}
    assert report(features.limit(0), targets.union(targets.where(at == F.lit(DAYS[1])))) == {"S": {"target_repeated": 1}}
    half = targets.withColumn("target", F.when(at == F.lit(DAYS[0]), nothing).otherwise(F.col("target")))
    assert report(features, half) == {"S": {"target_half": 1}}
    late = targets.withColumn("target_date", F.when(at == F.lit(DAYS[6]), at).otherwise(F.col("target_date")))
    assert report(features, late) == {"S": {"target_not_after": 1, "target_not_next": 1}}
    with pytest.raises(DataError, match="2 rows: features are not finite.*1 rows: targets have a date"):
        X.enforce_forecast_inputs(wide, half)
    times = [x.withColumn("origin_date", at.cast("timestamp")) for x in (features, targets)]
    assert report(times[0], times[1].withColumn("target_date", F.col("target_date").cast("timestamp"))) == {"S": {}}


def test_pairs_that_cannot_be_tested_say_why(spark):
    rows = [("S", "own", d, 1.0) for d in DAYS if d != DAYS[4]] + [("S", "long", d, float("nan") if d == DAYS[2] else 2.0) for d in DAYS]
    rows += [("S", "short", d, 2.0) for d in DAYS[:2]] + [("T", "own", DAYS[0], 1.0)]
    losses = spark.createDataFrame(rows, "series string, model string, target_date date, loss double")
    got = {r.baseline_model: tuple(r)[2:] for r in untestable_pairs(losses, "own", lags=[0, 9, 10]).collect()}
    assert got == {"long": (11, 1, 0, 1, False, 1), "short": (2, 0, 9, 0, True, 2)}
    assert all(r.lags_too_long == 0 for r in untestable_pairs(losses, "own").collect())
    with pytest.raises(ValueError):
        untestable_pairs(losses, "own", lags=-1)


def test_a_price_that_is_none_voids_its_path_and_is_counted(spark):
    start = datetime(2024, 1, 16, 12)
    rows = [("A", start + timedelta(minutes=5 * k), 0.0 if k == 3 else 1.0 + k) for k in range(6)]
    rows += [("B", start + timedelta(minutes=5 * k), 1.0 + k) for k in range(6)]
    ticks = label_sessions(spark.createDataFrame(rows, "asset string, ts timestamp, mid double"))
    got = {r.asset: r for r in summarize_paths(last_tick_sample(ticks, "5min"), [realized_variance()]).collect()}
    assert (got["A"].n_prices, got["A"].n_invalid, got["A"].rv) == (6, 1, None)
    assert got["B"].n_invalid == 0 and got["B"].rv > 0


@pytest.mark.parametrize("block", [1, 7, 100])
def test_autocorrelation_of_any_blocks_is_that_of_the_series(spark, block):
    rng = np.random.default_rng(2)
    x = 1e6 + np.cumsum(rng.normal(size=60))
    x[10] = np.nan
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), None if np.isnan(v) else float(v)) for k in (1, 2) for i, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, (3, DAYS[0], 1.0)], "asset int, date date, v double")
    result = autocorrelation(frame, "v", max_lag=5, block=block)
    assert "Generate" not in result._jdf.queryExecution().executedPlan().toString()
    got = {(r.asset, r.lag): r for r in result.collect()}
    assert set(got) == {(k, lag) for k in (1, 2) for lag in range(1, 6)}
    s = pd.Series(x)
    for (_, lag), r in got.items():
        assert r.autocorrelation == pytest.approx(s.corr(s.shift(lag)), rel=1e-7)
        assert r.pairs == s.shift(lag).notna().sum()
    flat = spark.createDataFrame([(1, d, 2.0) for d in DAYS], "asset int, date date, v double")
    assert all(r.autocorrelation is None for r in autocorrelation(flat, "v", max_lag=3).collect())


def test_histogram_needs_no_window(spark):
    rows = [("A", float(k % 10)) for k in range(100)] + [("B", 1.0), (None, 3.0)]
    result = histogram(spark.createDataFrame(rows, "asset string, v double"), "v", bins=3)
    assert "Window" not in result._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.asset or "", r.bin, r.rows) for r in result.collect())
    assert got == [("", 1, 1), ("A", 1, 30), ("A", 2, 30), ("A", 3, 40), ("B", 1, 1)]


class Mean:
    calls = 0

    def fit(self, features, target):
        self.n, self.total = len(target), float(target.sum())
        return self

    def predict(self, features):
        return np.full(len(features), self.total / self.n)


class Learning(Mean):
    def update(self, features, target):
        assert len(features) == len(target) > 0
        self.n, self.total = self.n + len(target), self.total + float(target.sum())
        return self


def test_rules_that_learn_give_the_forecasts_of_rules_that_refit(spark):
    table = prepared_frame(daily_values(85))
    data = spark.createDataFrame(table.assign(series="A")).union(spark.createDataFrame(table.assign(series="B", target=table.target + 1)))
    refit = walk_forward(data, own_rule("m", Mean()), min_train_size=20).orderBy("series", "target_date").collect()
    learnt = walk_forward(data, own_rule("m", Learning()), min_train_size=20).orderBy("series", "target_date").collect()
    assert [(r.series, r.target_date, r.n_train) for r in refit] == [(r.series, r.target_date, r.n_train) for r in learnt]
    np.testing.assert_allclose([r.predicted for r in learnt], [r.predicted for r in refit], rtol=1e-12)


def test_autocovariances_of_tests_equal_a_slow_sum(spark):
    rng = np.random.default_rng(5)
    gains = rng.normal(size=12) + 0.3
    rows = [("S", m, d, float(v)) for d, g in zip(DAYS, gains, strict=True) for m, v in (("own", 1.0), ("base", 1.0 + g))]
    losses = spark.createDataFrame(rows, "series string, model string, target_date date, loss double")
    c = gains - gains.mean()
    for r in diebold_mariano(paired_losses(losses, "own"), lags=[0, 2, 10]).collect():
        gamma = [sum(c[t] * c[t - h] for t in range(h, 12)) / 12 for h in range(r.hac_lags + 1)]
        variance = gamma[0] + 2 * sum((1 - h / (r.hac_lags + 1)) * gamma[h] for h in range(1, r.hac_lags + 1))
        assert r.statistic == pytest.approx(gains.mean() / np.sqrt(max(variance, 0) / 12), rel=1e-9)

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import helpers
from helpers import daily_values, ols, prepared_frame, slow_walk, smoothing
from ripplemark.checks import DataError
from ripplemark.operators.forecasts import (
    FORECAST_COLUMNS,
    fit_known,
    walk_forward,
    walk_forward_models,
)
from ripplemark.operators.models import own_rule, regression, smoothing as smoothing_model
from ripplemark.operators.smearing import smeared_forecasts
from ripplemark.operators.timeline import accumulate_known

HAR = ("log_rv_mean_1", "log_rv_mean_5", "log_rv_mean_22")
SHAR = ("log_rs_pos_mean_1", "log_rs_neg_mean_1", *HAR[1:])
MODELS = {
    "mean": (regression("mean"), ols()),
    "naive": (smoothing_model("naive", 0.0), smoothing(0.0)),
    "ewma": (smoothing_model("ewma", 0.94), smoothing(0.94)),
    "ar": (regression("ar", HAR[:1]), ols()),
    "har": (regression("har", HAR), ols()),
    "shar": (regression("shar", SHAR), ols()),
    "ridge": (regression("ridge", HAR, penalty=2.5), ols(2.5)),
}


def frame(spark, table, series="S"):
    return spark.createDataFrame(table.assign(series=series))


@pytest.fixture(scope="module")
def table():
    return prepared_frame(daily_values(85))


def by_date(result):
    return result.orderBy("target_date").collect()


@pytest.mark.parametrize("name", MODELS)
def test_equals_a_refit_at_every_origin(spark, table, name):
    model, fit = MODELS[name]
    got = by_date(walk_forward(frame(spark, table), model, min_train_size=20, check=True))
    expected = slow_walk(table, model.regressors, fit, 20)
    assert [(r.target_date, r.n_train) for r in got] == [(d, n) for d, _, n in expected]
    np.testing.assert_allclose([r.predicted for r in got], [p for _, p, _ in expected], rtol=1e-11)
    assert all(r.model == name and r.series == "S" for r in got)


def test_models_together_equal_models_alone(spark, table):
    data = frame(spark, table).union(frame(spark, table.assign(target=table.target + 1), "T"))
    models = [m for m, _ in MODELS.values()]
    together = walk_forward_models(data, models, min_train_size=25)
    assert together.columns == list(FORECAST_COLUMNS)
    for name, (model, _) in MODELS.items():
        alone = {(r.series, r.target_date): r.predicted for r in walk_forward(data, model, min_train_size=25).collect()}
        rows = together.where(F.col("model") == name).collect()
        assert len(rows) == len(alone)
        for r in rows:
            assert r.predicted == pytest.approx(alone[r.series, r.target_date], rel=1e-12)


def test_date_range_selects_without_changing_forecasts(spark, table):
    data, models = frame(spark, table), [MODELS["har"][0], MODELS["naive"][0]]
    whole = walk_forward_models(data, models, min_train_size=20)
    start, end = table.target_date.iloc[30], table.target_date.iloc[40]
    part = walk_forward_models(data, models, min_train_size=20, start=start, end=end)
    expected = whole.where((F.col("target_date") >= F.lit(start)) & (F.col("target_date") <= F.lit(end)))
    assert part.count() == 22
    a = {(r.model, r.target_date): r.predicted for r in part.collect()}
    b = {(r.model, r.target_date): r.predicted for r in expected.collect()}
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], rel=1e-12)


def test_no_forecast_sees_the_future(spark, table):
    """Outcomes after a date are replaced; forecasts made by then stay as they were."""
    cut = table.origin_date.iloc[40]
    later = table.target_date > cut
    changed = table.assign(target=table.target.where(~later, 50.0))
    for column in HAR:
        changed[column] = changed[column].where(changed.origin_date <= cut, -50.0)
    models = [m for m, _ in MODELS.values()]
    early = F.col("origin_date") <= F.lit(cut)
    a = walk_forward_models(frame(spark, table), models, min_train_size=20).where(early).drop("actual")
    b = walk_forward_models(frame(spark, changed), models, min_train_size=20).where(early).drop("actual")
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_outcomes_known_late_train_late(spark, table):
    """Targets three rows ahead: a fit has three outcomes fewer than rows before it."""
    late = table.iloc[:-2].assign(target_date=table.target_date.shift(-2), target=table.target.shift(-2)).iloc[:-2]
    late = late.dropna().reset_index(drop=True)
    model, fit = MODELS["har"]
    got = by_date(walk_forward(frame(spark, late), model, min_train_size=20))
    expected = slow_walk(late, model.regressors, fit, 20)
    assert [r.n_train for r in got] == [n for _, _, n in expected]
    np.testing.assert_allclose([r.predicted for r in got], [p for _, p, _ in expected], rtol=1e-11)


def test_collinear_regressors_give_the_smallest_solution(spark, table):
    doubled = table.assign(twin=table[HAR[0]] * 2, flat=3.0)
    model = regression("twin", (HAR[0], "twin", "flat"))
    got = by_date(walk_forward(frame(spark, doubled), model, min_train_size=20))
    expected = slow_walk(doubled, model.regressors, ols(), 20)
    np.testing.assert_allclose([r.predicted for r in got], [p for _, p, _ in expected], rtol=1e-9)


def test_large_levels_lose_no_digits(spark, table):
    shifted = table.assign(**{c: table[c] + 1e7 for c in HAR})
    model, fit = MODELS["har"]
    got = by_date(walk_forward(frame(spark, shifted), model, min_train_size=20))
    plain = slow_walk(table, model.regressors, fit, 20)
    np.testing.assert_allclose([r.predicted for r in got], [p for _, p, _ in plain], rtol=1e-6)


def test_too_little_data_gives_an_empty_table(spark, table):
    for name in ("har", "naive"):
        result = walk_forward(frame(spark, table), MODELS[name][0], min_train_size=500)
        assert result.count() == 0 and result.columns == list(FORECAST_COLUMNS)


def test_regression_needs_more_rows_than_regressors(spark, table):
    with pytest.raises(Exception, match="need more observations"):
        walk_forward(frame(spark, table), MODELS["har"][0], min_train_size=1).collect()


class MedianRule:
    """Refits on copies: breaking its inputs must not leak into other fits."""

    def fit(self, features, target):
        self.value = float(np.median(target)) + 0 * features.shape[1]
        features[:] = np.nan
        target[:] = np.nan
        return self

    def predict(self, features):
        return np.full(len(features), self.value)


class BrokenRule(MedianRule):
    def predict(self, features):
        return np.full(len(features), np.nan)


cloudpickle.register_pickle_by_value(__import__(__name__))
cloudpickle.register_pickle_by_value(helpers)


def test_rules_of_the_users_own(spark, table):
    models = [own_rule("median", MedianRule(), HAR[:2]), MODELS["har"][0], MODELS["mean"][0]]
    result = walk_forward_models(frame(spark, table), models, min_train_size=20)
    got = by_date(result.where("model = 'median'"))
    expected = slow_walk(table, HAR[:2], lambda x, y: lambda row: float(np.median(y)), 20)
    assert [(r.target_date, r.n_train, r.predicted) for r in got] == [(d, n, p) for d, p, n in expected]
    assert {r.model for r in result.select("model").distinct().collect()} == {"median", "har", "mean"}
    with pytest.raises(Exception, match="non-finite"):
        walk_forward(frame(spark, table), own_rule("broken", BrokenRule()), min_train_size=20).collect()


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda t: t.assign(target=np.where(np.arange(len(t)) == 3, np.nan, t.target)), "finite"),
        (lambda t: t.assign(log_rv_mean_5=np.inf), "finite"),
        (lambda t: t.assign(target_date=t.origin_date), "not before"),
        (lambda t: pd.concat([t, t.iloc[:1]]), "one row per"),
        (lambda t: t.assign(target_date=list(t.target_date[:-1]) + [t.target_date.iloc[3]], origin_date=list(t.origin_date[:-1]) + [t.origin_date.iloc[0] + timedelta(days=1000)]), "not before"),
    ],
)
def test_broken_tables_are_refused(spark, table, change, message):
    with pytest.raises(DataError, match=message):
        walk_forward(frame(spark, change(table)), MODELS["har"][0], min_train_size=20, check=True)


def test_bad_arguments(spark, table):
    data = frame(spark, table)
    for size in (0, -1, True, 2.0):
        with pytest.raises(ValueError):
            walk_forward(data, MODELS["har"][0], min_train_size=size)
    with pytest.raises(ValueError, match="missing"):
        walk_forward(data.drop(HAR[0]), MODELS["har"][0], min_train_size=20)
    with pytest.raises(ValueError):
        walk_forward_models(data, [], min_train_size=20)
    for make in (
        lambda: regression("m", penalty=-1.0), lambda: regression("m", penalty=float("nan")), lambda: smoothing_model("m", 1.0),
        lambda: smoothing_model("m", -0.1), lambda: regression(" "),
        lambda: regression("m", ("a", "a")), lambda: regression("m", "a"),
    ):
        with pytest.raises(ValueError):
            make()


def test_smoothing_by_hand(spark):
    for decay, targets, expected in ((0.5, (-3.0, 0.0, 9.0), 3.75), (0.94, (1.0, 9.0), 1.42 + 0.06), (0.0, (4.0, -2.0, 7.5), 7.5)):
        value = targets[0]
        for t in targets[1:]:
            value = decay * value + (1 - decay) * t
        days = [date(2024, 1, 1) + timedelta(days=k) for k in range(len(targets) + 2)]
        rows = [("S", days[k], days[k + 1], t) for k, t in enumerate((*targets, 0.0))]
        data = spark.createDataFrame(rows, "series string, origin_date date, target_date date, target double")
        got = by_date(walk_forward(data, smoothing_model("m", decay), min_train_size=len(targets)))
        assert got[-1].predicted == pytest.approx(value)
        assert value == pytest.approx(expected)


# --- one-off fits ---------------------------------------------------------------------------------


def test_fits_use_outcomes_strictly_before_the_date(spark, table):
    cut = table.target_date.iloc[50]
    known = table[table.target_date < cut]
    rows = fit_known(frame(spark, table), [MODELS["har"][0], MODELS["ridge"][0], MODELS["mean"][0]], before=[cut]).collect()
    assert {r.n_train for r in rows} == {len(known)} == {50}
    for name in ("har", "ridge", "mean"):
        model, fit = MODELS[name]
        got = {r.term: r.coefficient for r in rows if r.model == name}
        predict = fit(known[list(model.regressors)].to_numpy(float), known.target.to_numpy(float))
        x = table[list(model.regressors)].iloc[60].to_numpy(float)
        mine = got["intercept"] + sum(got[c] * v for c, v in zip(model.regressors, x))
        assert mine == pytest.approx(predict(x), rel=1e-12)
    assert fit_known(frame(spark, table), [MODELS["har"][0]], before=[date(1990, 1, 1)]).count() == 0
    with pytest.raises(ValueError):
        fit_known(frame(spark, table), [MODELS["naive"][0]], before=[cut])


def test_an_exact_relation_is_recovered(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(41)]
    table = pd.DataFrame(x, columns=["a", "b", "c"]).assign(
        origin_date=days[:-1], target_date=days[1:], target=2 + x @ np.array([0.5, -1, 3]), series="S"
    )
    model = regression("m", ("a", "b", "c"))
    rows = fit_known(spark.createDataFrame(table), [model], before=[date(2030, 1, 1)]).collect()
    got = [next(r.coefficient for r in rows if r.term == t) for t in ("intercept", "a", "b", "c")]
    np.testing.assert_allclose(got, [2, 0.5, -1, 3], atol=1e-12)


# --- smearing -------------------------------------------------------------------------------------


def forecasts(spark, errors, model="M", lead=1):
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(len(errors) + lead)]
    rows = [(model, "S", days[k], days[k + lead], -9.0 + e, -9.0, 10) for k, e in enumerate(errors)]
    schema = "model string, series string, origin_date date, target_date date, actual double, predicted double, n_train bigint"
    return spark.createDataFrame(rows, schema)


def test_a_constant_error_is_corrected_in_full(spark):
    rows = smeared_forecasts(forecasts(spark, [0.3] * 10), min_errors=4, check=True).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.smearing_factor == pytest.approx(np.exp(0.3))
        assert r.predicted == pytest.approx(r.actual)


@pytest.mark.parametrize("lead", [1, 3])
def test_only_errors_known_at_the_origin_count(spark, lead):
    errors = np.random.default_rng(6).normal(0, 0.4, 40).tolist()
    rows = smeared_forecasts(forecasts(spark, errors, lead=lead), min_errors=5).orderBy("target_date").collect()
    first = 5 + lead - 1
    assert len(rows) == 40 - first
    for k, r in enumerate(rows, start=first):
        assert r.smearing_factor == pytest.approx(np.mean(np.exp(errors[: k - lead + 1])), rel=1e-12)


def test_models_are_corrected_by_their_own_errors(spark):
    both = forecasts(spark, [0.3] * 10).union(forecasts(spark, [-0.2] * 10, "N"))
    got = smeared_forecasts(both, min_errors=3).groupBy("model").agg(F.max("smearing_factor").alias("f")).collect()
    assert {r.model: round(r.f, 9) for r in got} == {"M": round(np.exp(0.3), 9), "N": round(np.exp(-0.2), 9)}


def test_smearing_refuses_bad_input(spark):
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            smeared_forecasts(forecasts(spark, [0.1]), min_errors=bad)
    good = forecasts(spark, [0.1] * 5)
    for broken in (
        good.limit(0), good.withColumn("model", F.lit(" ")), good.union(good.limit(1)),
        good.withColumn("actual", F.lit(float("nan"))), good.withColumn("target_date", F.col("origin_date")),
        good.withColumn("series", F.lit(None).cast("string")), good.drop("actual"),
    ):
        with pytest.raises(ValueError):
            smeared_forecasts(broken, check=True)


def test_known_totals_with_ties(spark):
    events = spark.createDataFrame([("A", 1, 1.0), ("A", 3, 2.0), ("A", 3, 4.0), ("B", 1, 9.0)], "k string, at bigint, v double")
    queries = spark.createDataFrame([("A", 0), ("A", 1), ("A", 3), ("A", 9), ("C", 5)], "k string, t bigint")
    def run(inclusive):
        out = accumulate_known(events, queries, keys=["k"], event_at="at", query_at="t", totals={"s": F.col("v")}, inclusive=inclusive)
        return [(r.k, r.t, r.n_known, r.s) for r in out.orderBy("k", "t").collect()]

    assert run(True) == [("A", 0, 0, 0.0), ("A", 1, 1, 1.0), ("A", 3, 3, 7.0), ("A", 9, 3, 7.0), ("C", 5, 0, 0.0)]
    assert run(False) == [("A", 0, 0, 0.0), ("A", 1, 0, 0.0), ("A", 3, 1, 1.0), ("A", 9, 3, 7.0), ("C", 5, 0, 0.0)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_blocks_change_no_total(spark, inclusive):
    rng = np.random.default_rng(12)
    rows = [(k, int(t), float(v), n) for n, (k, t, v) in enumerate(zip(rng.choice(["A", "B"], 300, p=[0.9, 0.1]), rng.integers(0, 60, 300), rng.normal(size=300)))]
    events = spark.createDataFrame([(str(k), t, v, n) for k, t, v, n in rows], "k string, at bigint, v double, n bigint")
    queries = spark.createDataFrame([(k, t) for k in "ABC" for t in range(-5, 70, 3)], "k string, t bigint")
    options = dict(keys=["k"], event_at="at", query_at="t", totals={"s": F.col("v")}, latest={"last": F.col("v")}, tie=["n"], inclusive=inclusive)
    for size in (None, 1, 7, 100):
        block = None if size is None else lambda at, size=size: F.floor(at / size)
        for r in accumulate_known(events, queries, block=block, **options).collect():
            known = sorted((t, n, v) for k, t, v, n in rows if k == r.k and (t <= r.t if inclusive else t < r.t))
            assert r.n_known == len(known)
            assert r.s == pytest.approx(sum(v for _, _, v in known), abs=1e-9)
            assert r["last"] == (known[-1][2] if known else None)


def test_nothing_to_fit_or_to_smear_is_refused(spark, table):
    data = frame(spark, table)
    with pytest.raises(DataError, match="no outcome before 1990-01-01 in series"):
        fit_known(data, [MODELS["har"][0]], before=[date(1990, 1, 1), date(2090, 1, 1)], check=True)
    assert fit_known(data, [MODELS["har"][0]], before=[date(2090, 1, 1)], check=True).count() == 4
    with pytest.raises(DataError, match="no forecast has 50 errors"):
        smeared_forecasts(forecasts(spark, [0.3] * 10), min_errors=50, check=True)

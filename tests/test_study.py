import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import daily_values, newey_west_test, ols, prepared_frame, series_frame, slow_walk, smoothing
from ripplemark.checks import DataError
from ripplemark.functions.losses import qlike, squared_error
from ripplemark.operators.comparison import forecast_losses, loss_matrix, results_table
from ripplemark.operators.features import build_forecast_data
from ripplemark.operators.models import regression
from ripplemark.plans import calibration as K
from ripplemark.plans import descriptive as D
from ripplemark.plans import diagnostics as G
from ripplemark.plans.study import (
    DESIGN,
    benchmark_models,
    har_features,
    har_model,
    log_forecasts,
    ridge_model,
    run_study,
    score,
    shar_features,
    shar_model,
    study_plan,
)

FEATURES = har_features()
RISES, FALLS = shar_features(FEATURES)
MODELS = [har_model(FEATURES), *benchmark_models(FEATURES)]
NAMES = [m.name for m in MODELS]
PLAN = study_plan(date(2018, 8, 1), date(2018, 12, 3), date(2019, 12, 31), least_known=100, candidate="HAR")
RULES = {
    "HAR": ([*FEATURES.names.values()], ols()), "historical_mean": ((), ols()), "naive": ((), smoothing(0.0)),
    "EWMA": ((), smoothing(0.94)), "AR1": ([FEATURES.names[1]], ols()),
}


@pytest.fixture(scope="module")
def values():
    return daily_values(420)


@pytest.fixture(scope="module")
def data(spark, values):
    both = series_frame(spark, values, "S").union(series_frame(spark, daily_values(420, 5), "T"))
    return build_forecast_data(both, [FEATURES, RISES, FALLS], value_col="log_rv").persist()


@pytest.fixture(scope="module")
def run(data):
    return run_study(data, MODELS, PLAN)


@pytest.fixture(scope="module")
def losses(run):
    return run["losses"].persist()


@pytest.fixture(scope="module")
def slow_losses(values):
    """The study of series S from its definition: refit, smear, score."""
    table = prepared_frame(values)
    out = {}
    for name, (regressors, fit) in RULES.items():
        rows = [r for r in slow_walk(table, regressors, fit, 100) if PLAN.first <= r[0] <= PLAN.last]
        actual = table.set_index("target_date").target
        origin = table.set_index("target_date").origin_date
        errors = [(d, math.exp(actual[d] - p)) for d, p, _ in rows]
        for d, p, _ in rows:
            known = [e for day, e in errors if day <= origin[d]]
            if len(known) >= 20 and d >= PLAN.scored_from:
                ratio = math.exp(actual[d]) / (math.exp(p) * np.mean(known))
                out[name, d] = ratio - math.log(ratio) - 1
    return pd.Series(out).unstack(0).sort_index()


def test_losses_equal_the_definition(losses, slow_losses):
    got = {(r.model, r.target_date): r.loss for r in losses.where("series = 'S'").collect()}
    assert len(got) == slow_losses.size
    for (model, day), loss in got.items():
        assert loss == pytest.approx(slow_losses.loc[day, model], rel=1e-7, abs=1e-12)


def test_results_equal_the_definition(run, slow_losses):
    rows = {r.model: r for r in results_table(run["losses"], "HAR").where("series = 'S'").collect()}
    for name in NAMES:
        assert rows[name].mean_loss == pytest.approx(slow_losses[name].mean(), rel=1e-9)
        if name == "HAR":
            continue
        n = len(slow_losses)
        lags = min(int(4 * (n / 100) ** (2 / 9)), n - 2)
        assert rows[name].p_value == pytest.approx(newey_west_test(slow_losses[name] - slow_losses.HAR, lags)[1], rel=1e-6)
        assert rows[name].candidate_win_rate == pytest.approx((slow_losses.HAR < slow_losses[name]).mean(), abs=1e-9)
        assert rows[name].lower_by == pytest.approx(1 - slow_losses.HAR.mean() / slow_losses[name].mean(), rel=1e-6)


def test_evaluation_start_only_selects(data, run, losses):
    later = score(run["log"], PLAN._replace(scored_from=date(2019, 3, 1)))
    expected = losses.where("target_date >= date'2019-03-01'")
    a = {(r.series, r.model, r.target_date): r.loss for r in later["losses"].collect()}
    b = {(r.series, r.model, r.target_date): r.loss for r in expected.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)


def test_adding_a_series_changes_no_other(data, run):
    alone = run_study(data.where("series = 'S'"), MODELS, PLAN)
    alone = results_table(alone["losses"], "HAR").collect()
    together = results_table(run["losses"], "HAR").where("series = 'S'").collect()
    for a, b in zip(alone, together):
        assert a.model == b.model and a.mean_loss == pytest.approx(b.mean_loss, rel=1e-12)


def test_checks_pass_on_sound_data(data):
    result = run_study(data.where("series = 'S'"), MODELS[:2], PLAN, check=True)
    wide = loss_matrix(result["losses"], NAMES[:2])
    assert wide.columns == ["series", "target_date", "HAR", "historical_mean"]


def test_bad_designs(data, run):
    with pytest.raises(ValueError, match="dates"):
        study_plan(date(2020, 1, 1), date(2019, 1, 1), date(2021, 1, 1), least_known=10, candidate="HAR")
    for size in (0, True):
        with pytest.raises(ValueError):
            study_plan(date(2018, 1, 1), date(2019, 1, 1), date(2021, 1, 1), least_known=size, candidate="HAR")
    with pytest.raises(ValueError, match="candidate"):
        run_study(data, MODELS[1:], PLAN)
    with pytest.raises(ValueError, match="forecasts nothing"):
        score(run["log"], PLAN._replace(candidate="X"), check=True)
    with pytest.raises(DataError, match="2030-01-01"):
        score(run["log"], PLAN._replace(scored_from=date(2030, 1, 1)), check=True)
    other = score(run["log"], PLAN._replace(loss=squared_error))["losses"]
    assert other.agg(F.avg("loss")).first()[0] != run["losses"].agg(F.avg("loss")).first()[0]


def test_published_design():
    assert (DESIGN.least_known, DESIGN.candidate, DESIGN.loss) == (252, "HAR", qlike)
    assert shar_model(FEATURES, RISES, FALLS).regressors == (
        "log_rs_pos_mean_1", "log_rs_neg_mean_1", "log_rv_mean_5", "log_rv_mean_22"
    )


# --- diagnostics ----------------------------------------------------------------------------------


def only(frame):
    return frame.where("series = 'S'").collect()


def test_month_tables(losses, slow_losses):
    months = pd.to_datetime(pd.Series(slow_losses.index, index=slow_losses.index)).dt.strftime("%Y-%m")
    expected = slow_losses.groupby(months).mean()
    rows = {r.month: r for r in only(G.monthly_losses(losses, NAMES))}
    assert sorted(rows) == list(expected.index)
    for month in expected.index:
        for name in NAMES:
            assert rows[month][name] == pytest.approx(expected.loc[month, name], rel=1e-7)
    led = expected[NAMES].idxmin(axis=1).value_counts()
    assert {r.model: r.months_led for r in only(G.month_leaders(losses, NAMES))} == {n: led.get(n, 0) for n in NAMES}


def test_gains_over_time_and_their_concentration(losses, slow_losses):
    gain = slow_losses.naive - slow_losses.HAR
    rows = sorted((r for r in only(G.cumulative_advantage(losses, "HAR")) if r.baseline_model == "naive"), key=lambda r: r.target_date)
    np.testing.assert_allclose([r.cumulative_gain for r in rows], gain.cumsum(), rtol=1e-7)
    row = next(r for r in only(G.concentration(losses, "HAR")) if r.baseline_model == "naive")
    months = pd.to_datetime(pd.Series(gain.index, index=gain.index)).dt.strftime("%Y-%m")
    assert row.final_advantage == pytest.approx(gain.sum(), rel=1e-7)
    assert row.best_share == pytest.approx(gain.nlargest(10).sum() / gain.sum(), rel=1e-7)
    assert row.best_month == gain.groupby(months).sum().idxmax()


def test_worst_days(losses, slow_losses):
    worst = slow_losses.HAR.nlargest(5)
    rows = sorted(only(G.worst_days(losses, "HAR")), key=lambda r: r["rank"])
    assert [r.target_date for r in rows] == list(worst.index)
    assert sum(r.loss_share for r in rows) == pytest.approx(worst.sum() / slow_losses.HAR.sum(), rel=1e-7)
    assert rows[0].sample_share == pytest.approx(5 / len(slow_losses))


def test_head_to_head(losses, slow_losses):
    gain = slow_losses.HAR - slow_losses.AR1
    months = pd.to_datetime(pd.Series(gain.index, index=gain.index)).dt.strftime("%Y-%m")
    row = only(G.head_to_head(losses, "HAR", "AR1"))[0]
    assert row.sessions_won == pytest.approx((gain > 0).mean())
    assert (row.months_won, row.months) == ((gain.groupby(months).mean() > 0).sum(), months.nunique())
    assert (row.best_share is None) == (gain.sum() <= 0)
    reverse = {r.hac_lags: r.p_value for r in only(G.reverse_tests(losses, "HAR", "AR1"))}
    for lag, p in reverse.items():
        assert p == pytest.approx(newey_west_test(gain, lag)[1], rel=1e-5)


def test_verdicts(losses):
    results = results_table(losses, "HAR")
    sensitivity = G.hac_table(losses, "HAR")
    row = only(G.candidate_verdict(losses, "HAR"))[0]
    table = {r.model: r for r in only(results)}
    assert row.beats_all == all(table[n].lower_by > 0 for n in NAMES[1:])
    assert row.largest_p == max(r.p_value for r in only(sensitivity))
    assert row.win_rate == table["naive"].candidate_win_rate
    wide = G.hac_table(losses, "HAR", [0, 2])
    assert wide.columns == ["series", "baseline_model", "0", "2"]


def test_slopes_by_quarter(data, values):
    model = shar_model(FEATURES, RISES, FALLS)
    terms = [RISES.names[1], FALLS.names[1]]
    slopes = G.quarterly_slopes(data, model, terms, start=date(2019, 1, 1), end=date(2019, 7, 31))
    rows = {r.refit_at: r for r in only(slopes)}
    assert sorted(rows) == [date(2019, 1, 1), date(2019, 4, 1), date(2019, 7, 1)]
    table = prepared_frame(values)
    for day, r in rows.items():
        known = table[table.target_date <= day]
        x = np.column_stack([np.ones(len(known)), known[list(model.regressors)]])
        b = np.linalg.lstsq(x, known.target, rcond=None)[0]
        assert (r[terms[0]], r[terms[1]]) == (pytest.approx(b[1], rel=1e-9), pytest.approx(b[2], rel=1e-9))
    tests = G.reverse_tests(run_study(data, [MODELS[0], model], PLAN)["losses"], "HAR", "SHAR")
    verdict = only(G.slope_verdict(slopes, tests, *terms))[0]
    assert verdict.slope_order in ("rising above falling", "falling above rising", "changes")
    assert verdict.significant_at in ("every lag", "some lags", "no lag")


def test_coefficients_side_by_side(data):
    table = {r.term: r for r in only(G.coefficient_table(data, [MODELS[0], shar_model(FEATURES, RISES, FALLS)], date(2019, 1, 1)))}
    assert len(table) == 6 and table["log_rs_pos_mean_1"].HAR is None and table["log_rv_mean_5"].SHAR is not None
    row = only(G.slope_summary(data, MODELS[0], date(2019, 1, 1)))[0]
    assert row.total == pytest.approx(row.shortest + row.longer) and row.shortest == pytest.approx(table["log_rv_mean_1"].HAR)


def test_smearing_factors(run):
    rows = only(G.smearing_factors(run["forecasts"]))
    assert sum(r.largest_mean for r in rows) == 1
    for r in rows:
        assert r.min_factor <= r.mean_factor <= r.max_factor and r.bias_without == pytest.approx(1 - 1 / r.mean_factor)


def test_recent_paths(run):
    frame = run["forecasts"].withColumn("sessions_per_year", F.lit(250.0))
    rows = sorted(only(G.recent_paths(frame, ["HAR", "naive"], months=2)), key=lambda r: r.target_date)
    last = rows[-1].target_date
    assert rows[0].target_date >= (pd.Timestamp(last) - pd.DateOffset(months=2)).date()
    har = {r.target_date: r for r in frame.where("series = 'S' and model = 'HAR'").collect()}
    for r in rows:
        assert r.realized == pytest.approx(100 * math.sqrt(250 * har[r.target_date].actual))
        assert r.HAR == pytest.approx(100 * math.sqrt(250 * har[r.target_date].predicted))


# --- penalties ------------------------------------------------------------------------------------


def test_penalties_in_one_pass_equal_single_runs(data):
    scores = {r.penalty: r.calibration_loss for r in only(K.calibration(data, FEATURES, PLAN, (0.5, 20.0)))}
    for penalty, score in scores.items():
        early = study_plan(PLAN.first, PLAN.first, date(2018, 12, 2), least_known=100, candidate="HAR-ridge")
        alone = run_study(data.where("series = 'S'"), [ridge_model(FEATURES, penalty)], early)
        assert score == pytest.approx(alone["losses"].agg(F.avg("loss")).first()[0], rel=1e-10)


def test_the_choice_uses_no_evaluation_data(data):
    assert K.uses_no_evaluation_data(data, FEATURES, PLAN).count() == 0
    choice = {r.series: r for r in K.best_penalty(K.calibration(data, FEATURES, PLAN)).collect()}
    tuned = K.tuned_losses(data, FEATURES, PLAN).persist()
    assert {r.model for r in tuned.select("model").distinct().collect()} == {"HAR", "HAR-ridge"}
    verdict = {r.series: r for r in K.ridge_verdict(tuned, "HAR").collect()}
    for series, row in choice.items():
        one = data.where(F.col("series") == series)
        direct = run_study(one, [MODELS[0], ridge_model(FEATURES, row.penalty)], PLAN)
        mine = tuned.where(F.col("series") == series)
        gap = mine.join(direct["losses"].withColumnRenamed("loss", "l"), ["series", "model", "target_date"]).agg(
            F.count("*").alias("n"), F.max(F.abs(F.col("loss") - F.col("l"))).alias("gap")
        ).first()
        assert gap.n == direct["losses"].count() == mine.count() > 0 and gap.gap < 1e-10
        assert row.at_grid_edge == verdict[series].at_grid_edge == (row.penalty in (0.1, 100.0))
        assert verdict[series].penalty == row.penalty
        board = {r.model: r for r in results_table(direct["losses"], "HAR").collect()}["HAR-ridge"]
        assert verdict[series].outcome == ("loses to" if board.lower_by > 0 else "beats")
        assert verdict[series].p_value == pytest.approx(board.p_value, rel=1e-6)


def test_hindsight_scores_the_evaluation_period(data):
    scores = {r.penalty: r.evaluation_loss for r in only(K.hindsight(data, FEATURES, PLAN))}
    direct = log_forecasts(data.where("series = 'S'"), [ridge_model(FEATURES, 10.0, "HAR")], PLAN)
    assert scores[10.0] == pytest.approx(score(direct, PLAN)["losses"].agg(F.avg("loss")).first()[0], rel=1e-10)
    for bad in ((), (1.0, 1.0), (-1.0,)):
        with pytest.raises(ValueError):
            K.hindsight(data, FEATURES, PLAN, bad)


def test_the_engine_knows_no_finance(spark):
    """Any dated numbers will do: weekly sales, two regressors, absolute loss."""
    days = pd.date_range("2020-01-06", periods=120, freq="7D")
    rng = np.random.default_rng(0)
    price = rng.uniform(1, 2, 120)
    frame = pd.DataFrame({"series": "shop", "origin_date": days[:-1].date, "target_date": days[1:].date,
                          "price": price[:-1], "trend": np.arange(119.0), "target": 50 - 5 * price[:-1] + 0.1 * np.arange(119)})
    plan = study_plan(date(2020, 9, 1), date(2021, 3, 1), date(2022, 6, 1), least_known=20, candidate="both", loss=squared_error)
    log = log_forecasts(spark.createDataFrame(frame), [regression("both", ("price", "trend")), regression("mean")], plan)
    board = {r.model: r for r in results_table(forecast_losses(log, squared_error, check=True), "both").collect()}
    assert board["both"].mean_loss < 1e-15 < board["mean"].mean_loss and board["mean"].candidate_win_rate == 1.0


# --- description ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(8)
    rows = []
    for asset, n in (("AAA", 90), ("BBB", 40)):
        days = [d.date() for d in pd.bdate_range("2024-01-01", periods=n)]
        up, down = rng.gamma(2, 1e-5, n), rng.gamma(2, 1e-5, n)
        for d, a, b in zip(days, up.tolist(), down.tolist()):
            if d.day != 15:
                rows.append((asset, d, a + b, a, b, math.log(a + b), math.log(a), math.log(b), 288 - d.day % 3))
    schema = "asset string, date date, rv double, rs_pos double, rs_neg double, log_rv double, log_rs_pos double, log_rs_neg double, observation_count bigint"
    return spark.createDataFrame(rows, schema).persist()


def test_data_checks(daily):
    table = daily.where("asset = 'AAA'").orderBy("date").toPandas()
    row = D.data_checks(daily).where("asset = 'AAA'").first()
    gaps = pd.to_datetime(table.date).diff().dt.days
    assert row.sessions == len(table) and row.duplicate_dates == 0
    assert row.longest_gap_days == gaps.max() and row.longest_gap_ends == table.date[gaps.idxmax()]
    assert row.full_sessions == (table.observation_count == 288).sum() and row.fewest_prices == 286
    assert row.sessions_per_year == pytest.approx((len(table) - 1) / ((table.date.iloc[-1] - table.date.iloc[0]).days / 365.25))


def test_distributions(daily):
    table = daily.where("asset = 'AAA'").toPandas()
    share = {r.level: r.rising_share for r in D.rising_share(daily).where("asset = 'AAA'").collect()}
    for level, value in share.items():
        assert value == pytest.approx((table.rs_pos / table.rv).quantile(level), rel=1e-12)
    per_year = D.data_checks(daily).where("asset = 'AAA'").first().sessions_per_year
    for r in D.volatility_percentiles(daily).where("asset = 'AAA'").collect():
        assert r.vol == pytest.approx(np.quantile(100 * np.sqrt(per_year * table.rv), r.level), rel=1e-12)
    skew = D.skewness(daily).where("asset = 'AAA'").first()
    assert skew.skew_rv == pytest.approx(table.rv.skew(), rel=1e-9) and skew.skew_log_rv == pytest.approx(table.log_rv.skew(), rel=1e-9)
    counts = {r.bin: r.rows for r in D.histogram(daily, "rv", bins=7).where("asset = 'AAA'").collect()}
    expected, _ = np.histogram(table.rv, bins=7)
    assert [counts.get(k + 1, 0) for k in range(7)] == expected.tolist()


def test_persistence_and_history(daily):
    table = daily.where("asset = 'AAA'").orderBy("date").toPandas()
    for r in D.autocorrelation(daily, "log_rv", max_lag=10).where("asset = 'AAA'").collect():
        x = table.log_rv.to_numpy()
        assert r.autocorrelation == pytest.approx(np.corrcoef(x[: -r.lag], x[r.lag :])[0, 1], rel=1e-9)
    history = D.volatility_history(daily, 22).where("asset = 'AAA'").orderBy("date").toPandas()
    expected = history.vol.rolling(22).mean()
    np.testing.assert_allclose(history.vol_mean.astype(float), expected, rtol=1e-12)

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import minute_ticks, ticks_frame, to_path_frame
from ripplemark.operators import variance as V
from ripplemark.operators.percentiles import exact_percentiles
from ripplemark.operators.sampling import last_tick_sample
from ripplemark.plans.daily import label_sessions

STEPS = np.cumsum([0, 1, -2, 0, 3]).tolist()


def measured(spark, path, *measures):
    return V.summarize_paths(to_path_frame(spark, [path]), measures).first()


def test_hand_values(spark):
    row = measured(spark, [0, 1, 2, 3, 4, 5], V.realized_variance())
    assert row.rv == pytest.approx(5)
    row = measured(spark, STEPS, *V.realized_semivariances(), V.bipower_variation(), V.realized_variance())
    assert (row.rs_pos, row.rs_neg) == (pytest.approx(10), pytest.approx(4))
    assert row.rs_pos + row.rs_neg == pytest.approx(row.rv)
    assert row.bipower == pytest.approx(math.pi / 2 * 4 / 3 * 2)
    row = measured(spark, [0, 1, 3, 6, 10], V.subsampled_realized_variance(2))
    assert row.subsampled_rv == pytest.approx(41.5)


def test_special_cases_give_realized_variance(spark):
    path = np.random.default_rng(3).normal(0, 1e-3, 60).cumsum()
    row = measured(
        spark, path.tolist(), V.realized_variance(), V.subsampled_realized_variance(1), V.realized_kernel(0)
    )
    assert row.subsampled_rv == pytest.approx(row.rv, rel=1e-12)
    assert row.realized_kernel == pytest.approx(row.rv, rel=1e-12)


@pytest.mark.parametrize("step", [2, 3, 7])
def test_subsampling_is_the_mean_of_the_offset_grids(spark, step):
    path = np.random.default_rng(step).normal(0, 1e-3, 50).cumsum()
    slow = np.mean([np.sum(np.diff(path[k::step]) ** 2) for k in range(step)])
    row = measured(spark, path.tolist(), V.subsampled_realized_variance(step))
    assert row.subsampled_rv == pytest.approx(slow, rel=1e-9)


@pytest.mark.parametrize("lags", [7, 45])
def test_kernel_is_the_quadratic_form(spark, lags):
    returns = np.random.default_rng(5).normal(0, 1e-3, 60)
    weights = [[V.parzen_weight((i - j) / (lags + 1)) for j in range(60)] for i in range(60)]
    path = np.concatenate([[0], returns.cumsum()]).tolist()
    row = measured(spark, path, V.realized_kernel(lags), V.realized_kernel(F.lit(lags), "by_array"))
    assert row.realized_kernel == pytest.approx(returns @ np.array(weights) @ returns, rel=1e-8)
    assert row.by_array == pytest.approx(row.realized_kernel, rel=1e-8)


@pytest.mark.parametrize("lags", [1, 2, 5, 20])
def test_kernel_is_never_negative(spark, lags):
    path = np.cumsum([0] + [1e-3, -1e-3] * 20).tolist()
    assert measured(spark, path, V.realized_kernel(lags)).realized_kernel >= -1e-18


def test_too_few_or_bad_prices_give_null(spark):
    short = measured(spark, [0, 1], V.realized_variance(), V.bipower_variation(), V.realized_kernel(1), V.realized_kernel(F.lit(1), "k"))
    assert short.rv == pytest.approx(1)
    assert short.bipower is None and short.realized_kernel is None and short.k is None
    assert measured(spark, [0], V.realized_variance()).rv is None
    frame = to_path_frame(spark, [STEPS]).withColumn("mid", F.when(F.minute("bin") == 2, float("nan")).otherwise(F.col("mid")))
    row = V.summarize_paths(frame, [V.realized_variance()]).first()
    assert row.n_invalid == 1 and row.rv is None


@pytest.mark.parametrize("bad", [0, -1, True, 1.5])
def test_bad_steps_and_bandwidths(bad):
    with pytest.raises(ValueError):
        V.subsampled_realized_variance(bad)
    if bad != 0:
        with pytest.raises(ValueError):
            V.realized_kernel(bad)


def test_noise_robust_measures_recover_the_variance(spark):
    """Diffusion plus noise: plain variance of the fine grid explodes, the robust ones do not."""
    n, iv, noise = 23400, 1e-4, 5e-5
    rng = np.random.default_rng(11)
    paths = [
        (rng.normal(0, math.sqrt(iv / n), n + 1).cumsum() + rng.normal(0, noise, n + 1)).tolist() for _ in range(3)
    ]
    frame = to_path_frame(spark, paths, timedelta(seconds=1))
    lags = math.ceil(V.parzen_weight(0.0) * (144 / 0.269) ** 0.2 * (noise**2 / iv) ** 0.4 * n**0.6)
    rows = V.summarize_paths(
        frame, [V.realized_variance(), V.subsampled_realized_variance(300), V.realized_kernel(F.lit(lags))]
    ).collect()
    assert np.mean([r.rv for r in rows]) > 1.5 * iv
    assert np.mean([r.subsampled_rv for r in rows]) == pytest.approx(iv, rel=0.25)
    assert np.mean([r.realized_kernel for r in rows]) == pytest.approx(iv, rel=0.25)


def test_last_tick_wins_and_repeated_times_keep_the_later_row(spark):
    start = datetime(2024, 1, 15, 12, 0)
    rows = [("A", start, 1.0, 1), ("A", start + timedelta(minutes=4), 2.0, 3), ("A", start + timedelta(minutes=4), 9.0, 2),
            ("A", start + timedelta(minutes=5), 3.0, 4)]
    frame = label_sessions(spark.createDataFrame(rows, "asset string, ts timestamp, mid double, n bigint"))
    got = last_tick_sample(frame, "5min", ordinal=["n"]).orderBy("bin").collect()
    assert [r.mid for r in got] == [2.0, 3.0]
    assert [r.bin for r in got] == [start, start + timedelta(minutes=5)]


def test_odd_steps_are_anchored_at_the_midnight_of_the_path(spark):
    rows = minute_ticks(minutes=600)
    frame = label_sessions(ticks_frame(spark, rows))
    got = [r.bin for r in last_tick_sample(frame, "7min").orderBy("bin").collect()]
    anchor = datetime(2024, 1, 15)
    expected = sorted({anchor + ((ts - anchor) // timedelta(minutes=7)) * timedelta(minutes=7) for _, ts, _ in rows})
    assert got == expected


def test_variance_by_frequency_matches_single_grids(spark):
    frame = label_sessions(ticks_frame(spark, minute_ticks(minutes=600)))
    table = {r.frequency: r.rv for r in V.realized_variance_by_frequency(frame, ["5min", "15min", "1h", "7min"]).collect()}
    for frequency, rv in table.items():
        alone = V.summarize_paths(last_tick_sample(frame, frequency), [V.realized_variance()]).first()
        assert rv == pytest.approx(alone.rv, rel=1e-12)
    assert set(table) == {"5min", "15min", "1h", "7min"}
    with pytest.raises(ValueError):
        V.realized_variance_by_frequency(frame, [])


def test_percentiles_are_exact_under_ties_and_heavy_tails(spark):
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(size=999), "ties": rng.integers(0, 4, 500).astype(float),
        "tail": np.exp(rng.normal(0, 8, 700)), "one": np.array([3.0]), "flat": np.full(50, 2.5),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("one", float("nan")), ("one", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    levels = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = exact_percentiles(frame, ["k"], F.col("v"), levels).collect()
    assert len(got) == len(groups) * len(levels)
    for row in got:
        assert row.value == pytest.approx(np.quantile(groups[row.k], row.level), rel=1e-12)

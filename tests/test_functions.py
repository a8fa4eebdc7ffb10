import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ripplemark.functions.losses import qlike
from ripplemark.functions.numeric import (
    annualized_volatility_pct,
    is_finite,
    is_positive,
    normal_sf_sql,
    parzen_bandwidth,
    parzen_weight,
    with_normal_sf,
)
from ripplemark.functions.sessions import (
    pair_name,
    prices_per_session,
    session_close,
    session_date,
    session_open,
    step_micros,
)
from ripplemark.operators.comparison import default_hac_lags, hac_lag_grid


def test_normal_survival_matches_erfc(spark):
    points = [-40.0, -6.0, -2.5, -0.7, -0.6, -0.1, 0.0, 0.1, 0.5, 0.66, 0.67, 1.0, 2.0, 3.3, 5.6, 5.7, 8.0, 20.0, 37.0, 40.0]
    points += [float("inf"), float("-inf")]
    frame = spark.createDataFrame([(z,) for z in points], "z double").withColumn("q", F.expr(normal_sf_sql("z")))
    for row in with_normal_sf(frame, "z", "p").collect():
        assert row.q == row.p
        assert row.p == pytest.approx(0.5 * math.erfc(row.z / math.sqrt(2)), rel=1e-12, abs=1e-300)


def test_finite_and_positive_reject_nan_null_and_infinity(spark):
    rows = spark.createDataFrame(
        [(1.0,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "x double"
    ).select(is_finite("x").alias("f"), is_positive("x").alias("p")).collect()
    assert [r.f for r in rows] == [True, True, True, False, False, False]
    assert [r.p for r in rows] == [True, False, False, False, False, False]


@pytest.mark.parametrize("x, expected", [(0, 1), (0.5, 0.25), (1, 0), (1.5, 0), (-0.5, 0.25)])
def test_parzen_weight(spark, x, expected):
    assert parzen_weight(float(x)) == pytest.approx(expected)
    column = spark.range(1).select(parzen_weight(F.lit(float(x))).alias("w")).first().w
    assert column == pytest.approx(expected)


def test_parzen_bandwidth(spark):
    rows = spark.createDataFrame([(0.001, 86400), (0.01, 287), (-1.0, 10), (0.1, 0)], "q double, n bigint")
    got = [r.h for r in rows.select(parzen_bandwidth("q", "n").alias("h")).collect()]
    rule = lambda q, n: math.ceil((144 / 0.269) ** 0.2 * math.sqrt(q) ** 0.8 * n**0.6)
    assert got == [rule(0.001, 86400), rule(0.01, 287), None, None]


@pytest.mark.parametrize(
    "utc, label",
    [
        (datetime(2023, 7, 4, 20, 59, 59), date(2023, 7, 4)),  # a summer evening, before and after 17:00
        (datetime(2023, 7, 4, 21, 0), date(2023, 7, 5)),
        (datetime(2023, 11, 3, 20, 30), date(2023, 11, 3)),  # the last summer session before the autumn change
        (datetime(2023, 11, 5, 21, 15), date(2023, 11, 5)),  # the evening after it
        (datetime(2023, 11, 6, 22, 0), date(2023, 11, 7)),
        (datetime(2022, 12, 31, 22, 1), date(2023, 1, 1)),
    ],
)
def test_session_label_follows_new_york_time(spark, utc, label):
    frame = spark.createDataFrame([(utc,)], "ts timestamp_ntz").select(session_date(F.col("ts").cast("timestamp")).alias("d"))
    assert frame.first().d == label


@pytest.mark.parametrize(
    "day, opens, closes",
    [
        (date(2023, 11, 4), "2023-11-03 21:00:00", "2023-11-04 21:00:00"),
        (date(2023, 11, 5), "2023-11-04 21:00:00", "2023-11-05 22:00:00"),  # 25 hours
        (date(2025, 3, 9), "2025-03-08 22:00:00", "2025-03-09 21:00:00"),  # 23 hours
    ],
)
def test_session_bounds_across_the_clock_change(spark, day, opens, closes):
    row = spark.createDataFrame([(day,)], "d date").select(
        F.date_format(session_open("d"), "yyyy-MM-dd HH:mm:ss").alias("o"),
        F.date_format(session_close("d"), "yyyy-MM-dd HH:mm:ss").alias("c"),
    ).first()
    assert (row.o, row.c) == (opens, closes)


def test_every_instant_lies_within_its_session(spark):
    hours = spark.range(0, 366 * 24 * 2).select(F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 1800000000).alias("ts"))
    labelled = hours.withColumn("d", session_date("ts"))
    wrong = labelled.where((F.col("ts") < session_open("d")) | (F.col("ts") >= session_close("d")))
    assert wrong.count() == 0


@pytest.mark.parametrize("frequency, count", [("15min", 96), ("4h", 6), ("90s", 960), ("2min", 720)])
def test_prices_per_session(frequency, count):
    assert prices_per_session(frequency) == count


@pytest.mark.parametrize("frequency", ["0min", "-5min", "7min", "soon", "", None, 5])
def test_bad_frequencies_are_rejected(frequency):
    with pytest.raises(ValueError):
        prices_per_session(frequency)


def test_step_micros():
    assert step_micros("7min") == 420_000_000 and step_micros("h") == 3_600_000_000


def test_pair_names(spark):
    rows = spark.createDataFrame([("EURUSD",), ("USA500IDXUSD",)], "a string").select(pair_name("a").alias("p")).collect()
    assert [r.p for r in rows] == ["EUR/USD", "USA500IDXUSD"]


def test_qlike_values(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (0.0, 1.0), (1.0, -1.0)], "a double, p double")
    got = [r.x for r in rows.select(qlike(F.col("a"), F.col("p")).alias("x")).collect()]
    assert got[0] == pytest.approx(0.5 - math.log(0.5) - 1) and got[1] == 0.0
    assert got[2] is None and got[3] is None


def test_annualized_volatility(spark):
    row = spark.range(1).select(annualized_volatility_pct(F.lit(2e-5), 250).alias("v")).first()
    assert row.v == pytest.approx(100 * math.sqrt(250 * 2e-5))
    for bad in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            annualized_volatility_pct(F.lit(1.0), bad)


def test_hac_lag_rules(spark):
    rows = spark.createDataFrame([(3,), (20,), (100,), (453,)], "n bigint")
    got = rows.select("n", default_hac_lags(F.col("n")).alias("d"), hac_lag_grid(F.col("n")).alias("g")).collect()
    assert [r.d for r in got] == [1, 2, 4, 5]
    assert got[3].g == [0, 1, 2, 3, 4, 5, 10, 20, 30]
    assert got[0].g == [0, 1]

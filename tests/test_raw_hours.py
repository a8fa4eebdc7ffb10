import lzma
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplemark.checks import DataError
from ripplemark.sources import raw_hours as R

HOUR = [(0, 109123, 109118, 1.5, 2.0), (1500, 109125, 109120, 0.7, 0.9), (3599999, 109130, 109124, 3.0, 1.1)]


def body(records=HOUR):
    return lzma.compress(np.array(records, dtype=R.RECORD).tobytes(), format=lzma.FORMAT_ALONE)


def land(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_hours_become_ticks(spark, tmp_path):
    land(tmp_path, "EURUSD/2024/01/15/14h_ticks.bi5", body())
    land(tmp_path, "EURUSD/2024/01/15/15h_ticks.bi5", b"")
    land(tmp_path, "USDJPY/2024/01/15/14h_ticks.bi5", body([(10, 131816, 131810, 1.0, 1.0)]))
    rows = R.decode_hours(R.landed_hours(spark, str(tmp_path))).orderBy("asset", "ts").collect()
    assert len(rows) == 4
    assert (rows[0].ask, rows[0].bid) == (1.09123, 1.09118)
    assert rows[0].mid == pytest.approx(0.5 * (1.09123 + 1.09118))
    assert rows[2].ts == datetime(2024, 1, 15, 14, 59, 59, 999000)
    assert rows[1].ask_vol == pytest.approx(0.7, rel=1e-6)
    assert rows[3].ask == 131.816


def test_months_may_count_from_zero(spark, tmp_path):
    land(tmp_path, "EURUSD/2024/00/15/14h_ticks.bi5", body())
    landed = R.landed_hours(spark, str(tmp_path), month_base=0)
    assert landed.first().hour == datetime(2024, 1, 15, 14)
    with pytest.raises(ValueError):
        R.landed_hours(spark, str(tmp_path), month_base=2)


def test_a_cut_body_fails_the_job(spark, tmp_path):
    with pytest.raises(DataError):
        R.decode_body(lzma.compress(b"x" * 30))
    land(tmp_path, "EURUSD/2024/01/15/14h_ticks.bi5", lzma.compress(b"x" * 30))
    with pytest.raises(Exception, match="inside a record"):
        R.decode_hours(R.landed_hours(spark, str(tmp_path))).collect()


def test_an_unknown_symbol_fails_the_job(spark, tmp_path):
    land(tmp_path, "GBPUSD/2024/01/15/14h_ticks.bi5", body())
    with pytest.raises(Exception, match="no point divider"):
        R.decode_hours(R.landed_hours(spark, str(tmp_path))).collect()


def test_known_symbols_have_their_scale_and_others_none(spark):
    prices = {"EURUSD": (107524, 1.07524), "usdjpy": (131816, 131.816), "XAUUSD": (1879095, 1879.095), "USA500IDXUSD": (3940397, 3940.397)}
    frame = spark.createDataFrame([(s, raw) for s, (raw, _) in prices.items()], "symbol string, raw bigint")
    for row in frame.withColumn("divider", R.divider_of(frame["symbol"])).collect():
        assert row.raw / row.divider == pytest.approx(prices[row.symbol][1])


def test_trading_hours_skip_saturdays(spark):
    hours = [r.hour for r in R.trading_hours(spark, date(2024, 1, 12), date(2024, 1, 14)).collect()]
    assert len(hours) == 48 and {h.date() for h in hours} == {date(2024, 1, 12), date(2024, 1, 14)}
    assert R.trading_hours(spark, date(2024, 1, 14), date(2024, 1, 12)).count() == 0


def test_missing_hours_and_when_they_are_final(spark, tmp_path):
    land(tmp_path, "EURUSD/2024/01/15/14h_ticks.bi5", body())
    ranges = spark.createDataFrame([("EURUSD", date(2024, 1, 15), date(2024, 1, 15))], "asset string, start date, end date")
    missing = R.missing_hours(
        R.expected_hours(ranges), R.landed_hours(spark, str(tmp_path)), now=datetime(2024, 1, 16, 12, 0)
    )
    rows = {r.hour.hour: r.settled for r in missing.collect()}
    assert len(rows) == 23 and 14 not in rows
    assert rows[11] is True and rows[12] is False

"""The daily table follows changed tick files session by session, also from a stream."""

import os
import re
from datetime import date, datetime, timedelta
from glob import glob

import pytest
from pyspark.sql import functions as F

from ripplemark.operators.sampling import last_tick_sample
from ripplemark.plans.daily import build_daily
from ripplemark.sources.daily_table import (
    Extent,
    Layout,
    changed_files,
    read_daily,
    refresh_daily,
    ticks_around,
    touched_sessions,
    vacuum_daily,
)
from ripplemark.sources.numbers import claim_number
from ripplemark.sources.ticks import ARRIVAL, read_ticks, tick_ordinal, write_ticks
from ripplemark.streaming.daily import stream_into_table

FIRST = date(2024, 1, 15)


def month(spark, asset="EURUSD", days=8, seed=1.0):
    """Ticks every seven minutes from Monday on, with a price that goes up and down."""
    start = datetime(FIRST.year, FIRST.month, FIRST.day)
    n = days * 24 * 60 // 7
    rows = [(asset, start + timedelta(minutes=7 * k), 100.0 + seed + ((k * 37) % 11) / 10) for k in range(n)]
    return spark.createDataFrame(rows, "asset string, ts timestamp, mid double")


def built(spark, layout, **options):
    ticks = read_ticks(spark, layout.ticks)
    return [tuple(r) for r in rows_of(build_daily(ticks, ordinal=tick_ordinal(ticks), **options))]


def refreshed(spark, layout, **options):
    return [tuple(r) for r in rows_of(refresh_daily(spark, layout, **options))]


def rows_of(frame):
    return frame.orderBy("asset", "date").collect()


def day_of(ts):
    return F.to_date(ts)


def test_a_day_more_reads_three_days_and_equals_a_full_build(spark, tmp_path):
    layout, ticks = Layout(str(tmp_path)), month(spark).unionByName(month(spark, "USDJPY", seed=3.0))
    last = FIRST + timedelta(days=7)
    write_ticks(ticks.where(day_of("ts") < F.lit(last)), layout.ticks)
    assert refreshed(spark, layout) == built(spark, layout)
    write_ticks(ticks.where((day_of("ts") == F.lit(last)) & (F.col("asset") == "EURUSD")), layout.ticks)
    changed = changed_files(spark, layout.ticks, layout.daily())
    assert {(r.asset, r.date, r.there) for r in changed.collect()} == {("EURUSD", last, True)}
    near = ticks_around(spark, layout.ticks, Extent.of(changed))
    read = {re.search(r"asset=(\w+)/date=([\d-]+)", r[0]).groups() for r in near.select(F.input_file_name()).distinct().collect()}
    assert read == {("EURUSD", str(last - timedelta(days=k))) for k in (0, 1)}  # the day after isn't there
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert {r.session_date for r in touched_sessions(changed).collect()} == {last, last + timedelta(days=1)}
    before = len(glob(f"{layout.daily()}/sessions/asset=USDJPY/*"))
    assert refreshed(spark, layout) == built(spark, layout)
    assert len(glob(f"{layout.daily()}/sessions/asset=USDJPY/*")) == before
    assert changed_files(spark, layout.ticks, layout.daily()).isEmpty()


def test_corrections_far_back_deleted_and_replaced_files_change_the_table(spark, tmp_path):
    layout, ticks = Layout(str(tmp_path)), month(spark)
    write_ticks(ticks, layout.ticks)
    first = refreshed(spark, layout)
    write_ticks(ticks.where(day_of("ts") == F.lit(FIRST + timedelta(days=2))).withColumn("mid", F.col("mid") * 1.5), layout.ticks)
    second = refreshed(spark, layout)
    assert second == built(spark, layout) != first and len(second) == len(first)
    for gone in glob(f"{layout.ticks}/asset=EURUSD/date={FIRST + timedelta(days=7)}/*.parquet"):
        os.remove(gone)
    third = refreshed(spark, layout)
    assert third == built(spark, layout) and len(third) < len(second)
    kept = glob(f"{layout.ticks}/asset=EURUSD/date={FIRST + timedelta(days=4)}/*.parquet")
    fresh = spark.read.parquet(*kept).where("minute(ts) % 2 = 0").toPandas()
    for path in kept:
        os.remove(path)
        os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    fresh.astype({"ts": "datetime64[us]"}).to_parquet(kept[0], index=False)
    assert refreshed(spark, layout) == built(spark, layout) != third
    assert [tuple(r) for r in rows_of(read_daily(spark, layout.daily()))] == built(spark, layout)
    for gone in glob(f"{layout.ticks}/asset=EURUSD/date=*/*.parquet"):
        os.remove(gone)
    assert refreshed(spark, layout) == []


def test_the_edge_of_the_data_moves_with_the_appended_days(spark, tmp_path):
    layout, ticks = Layout(str(tmp_path)), month(spark)
    noon = datetime(2024, 1, 18, 12)
    write_ticks(ticks.where(F.col("ts") < F.lit(noon)), layout.ticks)
    assert date(2024, 1, 18) not in {r[1] for r in refreshed(spark, layout)}
    write_ticks(ticks.where(F.col("ts") >= F.lit(noon)), layout.ticks)
    assert date(2024, 1, 18) in {r[1] for r in refreshed(spark, layout)}
    assert refreshed(spark, layout) == built(spark, layout)


def test_files_without_a_date_rebuild_their_asset(spark, tmp_path):
    layout = Layout(str(tmp_path))
    month(spark).drop("asset").coalesce(1).write.parquet(f"{layout.ticks}/asset=EURUSD")
    assert refreshed(spark, layout) == [tuple(r) for r in rows_of(build_daily(month(spark)))]
    more = month(spark, days=10).where("ts > '2024-01-22 23:50:00'").drop("asset")
    more.coalesce(1).write.mode("append").parquet(f"{layout.ticks}/asset=EURUSD")
    assert refreshed(spark, layout) == [tuple(r) for r in rows_of(build_daily(month(spark, days=10)))]


def test_a_refused_build_leaves_no_trace_and_vacuum_takes_what_is_superseded(spark, tmp_path):
    layout, ticks = Layout(str(tmp_path)), month(spark)
    write_ticks(ticks, layout.ticks)
    first = refreshed(spark, layout)
    write_ticks(ticks.limit(1).withColumn("mid", F.lit(-1.0)), layout.ticks)
    with pytest.raises(Exception, match="1 invalid"):
        refresh_daily(spark, layout)
    assert [tuple(r) for r in rows_of(read_daily(spark, layout.daily()))] == first
    assert not changed_files(spark, layout.ticks, layout.daily()).isEmpty()
    refresh_daily(spark, layout, check=False)
    held = [tuple(r) for r in rows_of(read_daily(spark, layout.daily()))]
    # the refused build's sessions, files and, as it got no rows, the first build's rows
    assert vacuum_daily(spark, layout.daily()) == 3
    assert [tuple(r) for r in rows_of(read_daily(spark, layout.daily()))] == held
    assert vacuum_daily(spark, layout.daily()) == 0 and changed_files(spark, layout.ticks, layout.daily()).isEmpty()


def test_numbers_ascend_and_owners_keep_theirs(spark, tmp_path):
    folder = str(tmp_path / "numbers")
    assert [claim_number(spark, folder) for _ in range(3)] == [1, 2, 3]
    assert claim_number(spark, folder, "batch-0") == 4 == claim_number(spark, folder, "batch-0")
    (tmp_path / "numbers" / "000000000005").touch()  # another writer was quicker
    assert claim_number(spark, folder) == 6 and claim_number(spark, folder, "batch-0") == 4


def test_one_number_orders_ticks_of_the_sink_without_sorting(spark, tmp_path):
    start = datetime(2024, 1, 2, 12)
    for k in range(20):
        rows = [("A", start, 100.0 * k + n, n) for n in (2, 0, 1)]
        write_ticks(spark.createDataFrame(rows, "asset string, ts timestamp, mid double, n bigint"), str(tmp_path), ordinal=["n"])
        ticks = read_ticks(spark, str(tmp_path)).withColumn("session_date", F.to_date("ts"))
        assert tick_ordinal(ticks) == (ARRIVAL,)
        assert last_tick_sample(ticks, "1h", ordinal=tick_ordinal(ticks)).first().mid == 100.0 * k + 2
    plan = build_daily(read_ticks(spark, str(tmp_path)), ordinal=(ARRIVAL,))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("ordinals", [(-(2**63), None, 2**63 - 1, 5), (3, 2**63 - 1, None, -(2**63) + 1)])
def test_time_outweighs_any_ordinal_and_none_comes_first(spark, ordinals):
    start = datetime(2024, 1, 2, 12)
    rows = [("A", FIRST, start + timedelta(microseconds=k), float(k), n) for k, n in enumerate(ordinals)]
    kind = "asset string, session_date date, ts timestamp, mid double, n bigint"
    assert last_tick_sample(spark.createDataFrame(rows, kind), "1h", ordinal=["n"]).first().mid == 3.0
    same = [("A", FIRST, start, float(k), n) for k, n in enumerate(ordinals)]
    expected = max(range(4), key=lambda k: (ordinals[k] is not None, ordinals[k] or 0))
    assert last_tick_sample(spark.createDataFrame(same, kind), "1h", ordinal=["n"]).first().mid == expected


def test_a_stream_in_any_order_and_a_repeated_batch_give_the_batch_table(spark, tmp_path):
    layout, ticks = Layout(str(tmp_path / "tables")), month(spark, days=5)
    dealt = ticks.withColumn("part", F.pmod(F.hash("ts"), F.lit(3)))
    for part in range(3):  # every file has ticks of all days: two thirds of them are late
        dealt.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run():
        stream = stream_into_table(arriving, layout, name="ticks").option("checkpointLocation", f"{tmp_path}/state")
        stream.trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in rows_of(read_daily(spark, layout.daily()))]

    expected = [tuple(r) for r in rows_of(build_daily(ticks))]
    assert run() == expected
    os.remove(f"{tmp_path}/state/commits/2")  # as if the last batch had failed at its end
    os.path.exists(f"{tmp_path}/state/commits/.2.crc") and os.remove(f"{tmp_path}/state/commits/.2.crc")
    n = len(glob(f"{layout.ticks}/asset=*/date=*/*.parquet"))
    assert run() == expected
    assert len(glob(f"{layout.ticks}/asset=*/date=*/*.parquet")) > n
    assert read_ticks(spark, layout.ticks).select("delivery").distinct().count() == 3

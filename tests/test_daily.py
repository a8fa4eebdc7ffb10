import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import minute_ticks, ticks_frame
from ripplemark.checks import DataError
from ripplemark.operators.sampling import last_tick_sample
from ripplemark.plans.daily import (
    DAILY_COLUMNS,
    build_daily,
    full_sessions,
    merge_sessions,
    sessions_per_year,
    valid_ticks,
)
from ripplemark.sources.daily_table import Layout, read_daily, refresh_daily, stale_assets
from ripplemark.sources.ticks import (
    FILE_ORDINAL,
    enforce_file_order,
    enforce_ticks,
    file_order,
    file_summary,
    list_files,
    read_ticks,
    sanity_report,
    tick_violations,
    unsorted_ticks,
    write_ticks,
)
from ripplemark.streaming.daily import stream_daily

UNIT = (5e-6) ** 2


def rows_of(daily):
    return daily.orderBy("date").collect()


@pytest.fixture(scope="module")
def whole(spark):
    return ticks_frame(spark, minute_ticks()).persist()


def test_two_sessions_and_their_semivariances(whole):
    rows = rows_of(build_daily(whole))
    assert [r.date for r in rows] == [date(2024, 1, 16), date(2024, 1, 17)]
    for row in rows:
        assert row.observation_count == 288
        assert row.rv == pytest.approx(287 * UNIT, rel=1e-6)
        assert row.rs_pos == pytest.approx(143 * UNIT, rel=1e-6)
        assert row.rs_neg == pytest.approx(144 * UNIT, rel=1e-6)


def test_rising_prices_only_give_an_empty_table_with_all_columns(spark):
    daily = build_daily(ticks_frame(spark, minute_ticks(rising=True)))
    assert daily.columns == list(DAILY_COLUMNS) and daily.count() == 0


def test_files_and_overlaps_change_nothing(spark, whole, tmp_path):
    expected = rows_of(build_daily(whole))
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    late = F.lit("2024-01-15 23:00:00").cast("timestamp")
    for name, rule in (("a", F.col("ts") < cut), ("b", F.col("ts") >= late)):
        whole.where(rule).drop("asset").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    ticks = read_ticks(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], asset="eurusd")
    got = rows_of(build_daily(ticks, ordinal=FILE_ORDINAL))
    assert [tuple(r) for r in got] == [tuple(r) for r in expected]


def test_later_file_wins_where_a_time_occurs_twice(spark, tmp_path):
    rows = minute_ticks(minutes=1440)
    ticks_frame(spark, [(a, ts, mid * 2) for a, ts, mid in rows[4:5]]).write.parquet(f"{tmp_path}/t/part=1")
    ticks_frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/t/part=2")
    ticks = read_ticks(spark, f"{tmp_path}/t")
    assert ticks.count() == 1441
    assert ticks.where(F.col("ts") == F.lit(rows[4][1])).count() == 2
    kept = rows[4][2]  # of the file that was written later
    from ripplemark.operators.sampling import last_tick_sample
    from ripplemark.plans.daily import label_sessions

    first_bin = last_tick_sample(label_sessions(ticks), "5min", ordinal=FILE_ORDINAL).orderBy("bin").first()
    assert first_bin.mid == kept


@pytest.mark.parametrize(
    "rule, kept",
    [("ts < timestamp'2024-01-17 15:00:00'", date(2024, 1, 16)), ("ts >= timestamp'2024-01-16 03:00:00'", date(2024, 1, 17))],
)
def test_sessions_cut_by_the_edges_are_dropped(whole, rule, kept):
    part = whole.where(rule)
    assert [r.date for r in rows_of(build_daily(part))] == [kept]
    assert build_daily(part, edge_tolerance_hours=None).count() == 2


def test_a_short_first_session_still_moves_the_edge(spark, whole):
    """The data starts on time for a session that is itself dropped; the next one is whole."""
    early = [("EURUSD", datetime(2024, 1, 15, 20, 0), 1.1), ("EURUSD", datetime(2024, 1, 15, 21, 0), 1.2)]
    assert build_daily(whole.union(ticks_frame(spark, early))).count() == 2


def test_full_sessions_keep_long_spans(spark):
    start = datetime(2024, 1, 15, 22, 0)
    rows = [("A", start + timedelta(hours=h), 1.0) for h in range(24)]
    rows += [("A", start + timedelta(hours=24 + h), 1.0) for h in range(3)]
    assert full_sessions(ticks_frame(spark, rows)).count() == 24
    assert full_sessions(ticks_frame(spark, rows), 2.0).count() == 27


def test_merge_keeps_the_fuller_copy(whole):
    part = build_daily(whole.where("ts < timestamp'2024-01-17 12:00:00'"), edge_tolerance_hours=None)
    merged = merge_sessions(part.unionByName(build_daily(whole)))
    assert [r.observation_count for r in rows_of(merged)] == [288, 288]


def test_assets_do_not_mix(spark, whole):
    other = whole.withColumn("asset", F.lit("USDJPY")).withColumn("mid", F.col("mid") * 150)
    rows = build_daily(whole.union(other)).groupBy("asset").agg(F.count("*").alias("n"), F.max("rv").alias("rv")).collect()
    assert {r.asset: r.n for r in rows} == {"EURUSD": 2, "USDJPY": 2}
    assert rows[0].rv == pytest.approx(rows[1].rv, rel=1e-6)


@pytest.mark.parametrize("options", [{"frequency": "0min"}, {"frequency": "x"}, {"min_session_hours": 0}])
def test_bad_arguments(whole, options):
    with pytest.raises(ValueError):
        build_daily(whole, **options)


def test_sessions_per_year(spark):
    days = [(("A"), date(2024, 1, 1) + timedelta(days=k)) for k in range(0, 365, 5)] + [("B", date(2024, 1, 1))]
    got = {r.asset: r.sessions_per_year for r in sessions_per_year(spark.createDataFrame(days, "asset string, date date")).collect()}
    assert got["A"] == pytest.approx(72 / (360 / 365.25)) and got["B"] is None


# --- tick tables ----------------------------------------------------------------------------------


def test_bad_ticks_are_counted_and_refused(spark):
    rows = [("A", datetime(2024, 1, 1), 1.0), ("A", None, 1.0), ("A", datetime(2024, 1, 1), float("nan")),
            ("A", datetime(2024, 1, 1), 0.0), ("A", datetime(2024, 1, 1), float("inf")), ("A", datetime(2024, 1, 1), None)]
    frame = ticks_frame(spark, rows)
    row = tick_violations(frame).first()
    assert (row.ticks, row.invalid) == (6, 5)
    with pytest.raises(DataError, match="5 invalid"):
        enforce_ticks(frame)
    assert valid_ticks(frame).count() == 1


def test_file_order_is_checked(spark, tmp_path, whole):
    cut = F.lit("2024-01-16 12:00:00").cast("timestamp")
    whole.where(F.col("ts") >= cut).coalesce(1).write.parquet(f"{tmp_path}/x")
    whole.where(F.col("ts") < cut).coalesce(1).write.parquet(f"{tmp_path}/y")
    good, bad = {}, {}
    for label in "xy":
        part = next(n for n in os.listdir(f"{tmp_path}/{label}") if n.endswith(".parquet"))
        good[label] = part
    ticks = read_ticks(spark, [f"{tmp_path}/x", f"{tmp_path}/y"])
    named = ticks.withColumn("file_name", F.when(F.col("file_name") == good["x"], "a").otherwise("b"))
    with pytest.raises(DataError, match="b starts before"):
        enforce_file_order(named)
    fixed = ticks.withColumn("file_name", F.when(F.col("file_name") == good["x"], "b").otherwise("a"))
    enforce_file_order(fixed)
    assert file_order(fixed).where("out_of_order").count() == 0
    row = file_summary(list_files(spark, str(tmp_path))).first()
    sizes = [os.path.getsize(f"{tmp_path}/{label}/{good[label]}") for label in "xy"]
    assert row.tick_files == 2 and row.tick_gb == pytest.approx(sum(sizes) / 1e9)


def test_unsorted_ticks_are_found_inside_and_between_blocks(spark):
    start = datetime(2024, 1, 1)
    order = [0, 1, 5, 4, 2, 6, 7, 3]
    rows = [("A", start + timedelta(seconds=s), k) for k, s in enumerate(order)]
    frame = spark.createDataFrame(rows, "asset string, ts timestamp, n bigint")
    expected = sum(b < a for a, b in zip(order, order[1:]))
    for block in (1, 2, 3, 100):
        assert unsorted_ticks(frame, sequence="n", block=block).first().unsorted == expected


def test_daily_table_is_rebuilt_only_for_stale_assets(spark, whole, tmp_path):
    layout = Layout(str(tmp_path))
    write_ticks(whole, layout.ticks)
    first = rows_of(refresh_daily(spark, layout))
    assert len(first) == 2
    assert stale_assets(spark, layout.ticks, layout.daily()).count() == 0
    written = sorted(os.listdir(f"{layout.daily()}/rows/asset=EURUSD"))
    refresh_daily(spark, layout).count()
    assert sorted(os.listdir(f"{layout.daily()}/rows/asset=EURUSD")) == written
    write_ticks(whole.withColumn("asset", F.lit("USDJPY")), layout.ticks)
    assert [r.asset for r in stale_assets(spark, layout.ticks, layout.daily()).collect()] == ["USDJPY"]
    assert refresh_daily(spark, layout).count() == 4
    assert refresh_daily(spark, layout, assets=["usdjpy"]).count() == 2
    assert sorted(os.listdir(f"{layout.daily()}/rows/asset=EURUSD")) == written
    assert [tuple(r) for r in rows_of(read_daily(spark, layout.daily(), asset="eurusd"))] == [tuple(r) for r in first]


def test_daily_table_follows_its_options_and_emptied_assets(spark, whole, tmp_path):
    layout = Layout(str(tmp_path))
    write_ticks(whole, layout.ticks)
    assert refresh_daily(spark, layout).count() == 2
    assert refresh_daily(spark, layout, min_session_hours=1000.0).count() == 0
    write_ticks(whole.withColumn("mid", F.lit(1.0)), layout.ticks, mode="overwrite")  # no variance in any session
    assert refresh_daily(spark, layout).count() == 0
    assert stale_assets(spark, layout.ticks, layout.daily()).count() == 0
    with pytest.raises(DataError, match="no ticks of NOPE"):
        refresh_daily(spark, layout, assets=["nope"])
    write_ticks(whole.limit(1).withColumn("mid", F.lit(-1.0)), layout.ticks)
    with pytest.raises(DataError, match="1 invalid"):
        refresh_daily(spark, layout)
    assert read_daily(spark, layout.daily()).count() == 0


def test_later_delivery_and_later_row_win(spark, tmp_path):
    start = datetime(2024, 1, 2, 12)
    for k in range(6):
        rows = [("A", start, 100.0 * k + n, n) for n in (2, 0, 1)]
        write_ticks(spark.createDataFrame(rows, "asset string, ts timestamp, mid double, n bigint"), str(tmp_path), ordinal=["n"])
        ticks = read_ticks(spark, str(tmp_path)).withColumn("session_date", F.to_date("ts"))
        assert last_tick_sample(ticks, "1h", ordinal=FILE_ORDINAL).first().mid == 100.0 * k + 2


def test_sorted_files_have_no_unsorted_tick(spark, tmp_path):
    start = datetime(2024, 1, 1)
    for part in (0, 1):
        rows = [("A", start + timedelta(seconds=10 * part + k), 1.0) for k in range(5)]
        spark.createDataFrame(rows, "asset string, ts timestamp, mid double").coalesce(1).write.mode("append").parquet(str(tmp_path))
    assert unsorted_ticks(read_ticks(spark, str(tmp_path))).first().unsorted == 0


def test_sanity_report_counts_a_zero_price(spark):
    rows = [("A", datetime(2024, 1, 1, h), 1.0 * h, 1.0 * h, 1.0 * h) for h in range(3)]
    report = sanity_report(spark.createDataFrame(rows, "asset string, ts timestamp, bid double, ask double, mid double")).first()
    assert (report.ticks, report.non_positive_prices, report.spread_median) == (3, 1, 0.0)


def test_only_needed_columns_reach_the_scan(spark, tmp_path, whole):
    wide = whole.withColumns({"bid": F.col("mid"), "ask": F.col("mid"), "bid_vol": F.lit(1.0), "ask_vol": F.lit(1.0)})
    wide.write.parquet(f"{tmp_path}/wide")
    plan = build_daily(read_ticks(spark, f"{tmp_path}/wide", with_ordinal=False))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema:"):].split("\n")[0]
    assert "mid" in schema and "ts" in schema and "vol" not in schema and "bid" not in schema
    assert plan.count("Exchange hashpartitioning") == 3


# --- streaming --------------------------------------------------------------------------------------


def test_stream_equals_batch_for_closed_sessions(spark, whole, tmp_path):
    cuts = ["2024-01-15 00:00:00", "2024-01-16 07:00:00", "2024-01-17 01:00:00", "2024-01-19 00:00:00"]
    later = ticks_frame(spark, [("EURUSD", datetime(2024, 1, 18, 5, 0), 1.1)])
    everything = whole.union(later)
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        part = everything.where((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(z).cast("timestamp")))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    job = (
        stream_daily(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        .writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    got = rows_of(spark.read.parquet(f"{tmp_path}/out"))
    expected = rows_of(build_daily(whole))
    assert [r.date for r in got] == [r.date for r in expected]
    for a, b in zip(got, expected):
        assert a.rv == pytest.approx(b.rv, rel=1e-12) and a.observation_count == b.observation_count

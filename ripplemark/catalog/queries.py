"""One query per operator. Each reads whole tables; results are plain and comparable."""

from __future__ import annotations

import lzma
import os
import tempfile
from collections.abc import Callable, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ripplemark.catalog import inputs as I
from ripplemark.functions.losses import absolute_error, qlike, squared_error
from ripplemark.functions.numeric import annualized_volatility_pct, is_finite, parzen_bandwidth
from ripplemark.functions.sessions import pair_name, session_close, session_open
from ripplemark.operators import comparison as C
from ripplemark.operators import features as X
from ripplemark.operators import forecasts as W
from ripplemark.operators import smearing as SM
from ripplemark.operators import variance as V
from ripplemark.operators.models import own_rule, regression
from ripplemark.operators.sampling import last_tick_sample
from ripplemark.operators.timeline import accumulate_known
from ripplemark.plans import calibration as K
from ripplemark.plans import daily as D
from ripplemark.plans import descriptive as S
from ripplemark.plans import diagnostics as G
from ripplemark.plans.study import RIDGE_GRID, ridge_model, run_study
from ripplemark.session import configure
from ripplemark.sources import raw_hours, ticks as T
from ripplemark.sources.daily_table import Layout, read_daily, refresh_daily
from ripplemark.streaming.daily import stream_daily, stream_into_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: First date of the fits that use everything before it.
CUT = I.DESIGN.scored_from


def query(run: Query | None = None, *, digits: dict[str, int] | int = I.DIGITS, significant: Sequence[str] = ()):
    """Register a query under its function's name, with its result in comparable form."""
    if run is None:
        return lambda function: query(function, digits=digits, significant=significant)

    def presented(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return I.present(run(spark, sf_dir), digits, significant)

    QUERIES[run.__name__] = presented
    return run


# --- sessions and sampling ------------------------------------------------------------------------


@query
def session_labels(spark, sf_dir):
    return D.label_sessions(I.all_ticks(spark, sf_dir)).select("event_id", "asset", "session_date")


@query
def session_bounds(spark, sf_dir):
    days = D.label_sessions(I.all_ticks(spark, sf_dir)).select("session_date").distinct()
    return days.select(
        "session_date", session_open("session_date").alias("opens"), session_close("session_date").alias("closes")
    )


@query
def last_tick_bins(spark, sf_dir):
    return last_tick_sample(D.label_sessions(I.ticks(spark, sf_dir)), I.BAR, ordinal=I.ORDINAL)


@query
def last_tick_bins_anchored(spark, sf_dir):
    """A step that does not divide 24 hours: bins start at the session's own midnight."""
    return last_tick_sample(D.label_sessions(I.ticks(spark, sf_dir)), "35min", ordinal=I.ORDINAL)


@query
def full_sessions(spark, sf_dir):
    return D.full_sessions(I.ticks(spark, sf_dir), 23.0).groupBy("asset", "session_date").agg(
        F.count(F.lit(1)).alias("ticks")
    )


@query
def session_summary(spark, sf_dir):
    return D.summarize_sessions(I.ticks(spark, sf_dir), frequency=I.BAR, ordinal=I.ORDINAL)


@query
def daily_rv(spark, sf_dir):
    return I.daily(spark, sf_dir)


@query
def daily_rv_all_edges(spark, sf_dir):
    return D.build_daily(
        I.ticks(spark, sf_dir), frequency="30min", min_session_hours=5.0, edge_tolerance_hours=None, ordinal=I.ORDINAL
    )


@query
def merged_sessions(spark, sf_dir):
    """Two overlapping deliveries built on their own, then merged by price count."""
    whole = I.ticks(spark, sf_dir)
    early = whole.where(F.col("ts") < F.lit("2024-01-17 09:00:00").cast("timestamp"))
    late = whole.where(F.col("ts") >= F.lit("2024-01-15 03:00:00").cast("timestamp"))
    options = {"frequency": I.BAR, "ordinal": I.ORDINAL, "min_session_hours": 2.0, "edge_tolerance_hours": None}
    return D.merge_sessions(D.build_daily(early, **options).unionByName(D.build_daily(late, **options)))


@query
def sessions_per_year(spark, sf_dir):
    return D.sessions_per_year(I.daily(spark, sf_dir))


@query
def pair_names(spark, sf_dir):
    return I.all_ticks(spark, sf_dir).groupBy("asset").agg(F.count(F.lit(1)).alias("ticks")).withColumn(
        "pair", pair_name("asset")
    )


# --- tick tables ------------------------------------------------------------------------------------


@query
def tick_sanity(spark, sf_dir):
    return T.sanity_report(I.quotes(spark, sf_dir), sequence="event_id")


@query
def tick_violations(spark, sf_dir):
    return T.tick_violations(I.all_ticks(spark, sf_dir))


@query
def tick_file_order(spark, sf_dir):
    scan = I.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("_metadata.file_name").alias("file_name"),
    )
    return T.file_order(scan)


@query
def expected_hours_missing(spark, sf_dir):
    """Trading hours between an asset's first and last day in which it has no tick."""
    hours = I.all_ticks(spark, sf_dir).select("asset", F.date_trunc("hour", "ts").alias("hour"))
    ranges = hours.groupBy("asset").agg(F.to_date(F.min("hour")).alias("start"), F.to_date(F.max("hour")).alias("end"))
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    return raw_hours.missing_hours(raw_hours.expected_hours(ranges), hours, now=now)


@query(digits=9)
def assembled_ticks(spark, sf_dir):
    return raw_hours.assemble_ticks(I.quotes(spark, sf_dir).drop("mid")).select("event_id", "asset", "mid")


SYMBOLS = {"click": "EURUSD", "signup": "EURUSD", "error": "USDJPY", "purchase": "XAUUSD", "view": "USA500IDXUSD"}


def _bodies(spark, sf_dir):
    """The events as raw hourly bodies, one per symbol and hour, the way they would land."""
    symbol = F.lit(None).cast("string")
    for name, value in SYMBOLS.items():
        symbol = F.when(F.col("asset") == name, value).otherwise(symbol)
    us = F.unix_micros("ts")
    points = F.round(F.col("mid") * 100).cast("bigint")
    records = I.all_ticks(spark, sf_dir).select(
        symbol.alias("asset"), (us - F.pmod(us, F.lit(3_600_000_000))).alias("hour_us"),
        F.floor(F.pmod(us, F.lit(3_600_000_000)) / 1000).alias("ms"),
        (points * 10 + F.col("event_id") % 7).alias("ask"), (points * 10).alias("bid"),
        (F.col("event_id") % 16 / 4).alias("ask_vol"), (F.col("event_id") % 8 / 2).alias("bid_vol"),
    )

    hour = F.array_sort(F.collect_list(F.struct(*raw_hours.RECORD.names)))
    hours = records.groupBy("asset", "hour_us").agg(hour.alias("r"))
    fields = [F.col("r").getField(name) for name in raw_hours.RECORD.names]
    return hours.select("asset", "hour_us", F.concat_ws("/", "asset", "hour_us").alias("path"), _pack(*fields).alias("content"))


@F.pandas_udf(BinaryType())
def _pack(ms: pd.Series, ask: pd.Series, bid: pd.Series, ask_vol: pd.Series, bid_vol: pd.Series) -> pd.Series:
    """Compressed bodies of the given records, one per row."""
    bodies = []
    for values in zip(ms, ask, bid, ask_vol, bid_vol, strict=True):
        packed = np.zeros(len(values[0]), dtype=raw_hours.RECORD)
        for name, column in zip(raw_hours.RECORD.names, values, strict=True):
            packed[name] = column
        bodies.append(lzma.compress(packed.tobytes(), format=lzma.FORMAT_ALONE, preset=0))
    return pd.Series(bodies)


@query(digits=9)
def decoded_hours(spark, sf_dir):
    landed = _bodies(spark, sf_dir).withColumn("hour", F.timestamp_micros("hour_us"))
    return raw_hours.decode_hours(landed)


def _scratch(spark, name):
    """A new folder below the one that driver and executors share; on one machine, a temporary one will do."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="ripplemark-")
    return f"{shared}/{name}-{os.urandom(8).hex()}"


def _land(batches):
    """Writes each body to its path; the paths."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            where, inner = fs.FileSystem.from_uri(path)
            where.create_dir(inner.rpartition("/")[0], recursive=True)
            with where.open_output_stream(inner, compression=None) as out:
                out.write(content)
        yield pa.RecordBatch.from_arrays([batch.column("path")], names=["path"])


@query(digits=9)
def landed_ticks(spark, sf_dir):
    """The bodies as files in a landing directory, in two deliveries, found there and decoded."""
    root = _scratch(spark, "landed")
    root = root if "://" in root else f"file://{root}"
    bodies = _bodies(spark, sf_dir)
    place = F.date_format(F.timestamp_micros("hour_us"), "yyyy/MM/dd/HH")
    files = bodies.select(F.concat(F.lit(f"{root}/"), "asset", F.lit("/"), place, F.lit("h_ticks.bi5")).alias("path"), "content", "hour_us")
    late = F.col("hour_us") % 3 == 0
    for part in (files.where(~late), files.where(late)):
        part.select("path", "content").mapInArrow(_land, "path string").count()
    return raw_hours.decode_hours(raw_hours.landed_hours(spark, root))


@query
def daily_table(spark, sf_dir):
    """Ticks written by asset and date, the daily table refreshed from them, and read back."""
    layout = Layout(_scratch(spark, "daily-table"))
    T.write_ticks(I.ticks(spark, sf_dir), layout.ticks, ordinal=I.ORDINAL)
    return refresh_daily(spark, layout, frequency=I.BAR)


@query
def daily_table_appended(spark, sf_dir):
    """The same table from three deliveries, refreshed after each: most ticks of all days but the last, then wrong
    prices of a few, which the last delivery corrects and completes."""
    layout = Layout(_scratch(spark, "daily-appended"))
    whole = I.ticks(spark, sf_dir)
    early = F.col("ts") < F.lit("2024-01-29").cast("timestamp")
    late_ones = F.col("event_id") % 10 == 0
    for part in (whole.where(early & ~late_ones), whole.where(early & (F.col("event_id") % 100 == 1)).withColumn("mid", F.col("mid") + 1),
                 whole.where(~early | late_ones | (F.col("event_id") % 100 == 1))):
        T.write_ticks(part, layout.ticks, ordinal=I.ORDINAL)
        daily = refresh_daily(spark, layout, frequency=I.BAR)
    return daily


@query
def daily_table_of_one_asset(spark, sf_dir):
    layout = Layout(_scratch(spark, "daily-asset"))
    T.write_ticks(I.ticks(spark, sf_dir).withColumn("asset", F.upper("asset")), layout.ticks, ordinal=I.ORDINAL)
    return refresh_daily(spark, layout, frequency=I.BAR, assets=["purchase"])


# --- variance measures ------------------------------------------------------------------------------


def _half_hours(spark, sf_dir):
    return last_tick_sample(D.label_sessions(I.ticks(spark, sf_dir)), "30min", ordinal=I.ORDINAL)


def _measured(spark, sf_dir, *measures):
    return V.summarize_paths(_half_hours(spark, sf_dir), measures)


@query
def realized_variance(spark, sf_dir):
    return _measured(spark, sf_dir, V.realized_variance())


@query
def variance_of_raw_paths(spark, sf_dir):
    """Every tick counts: a price that is no price voids its path, and is counted there."""
    ticks = D.label_sessions(I.all_ticks(spark, sf_dir).where("ts is not null"))
    return V.summarize_paths(last_tick_sample(ticks, "5min", ordinal=I.ORDINAL), [V.realized_variance()])


@query
def semivariances(spark, sf_dir):
    return _measured(spark, sf_dir, *V.realized_semivariances())


@query
def bipower(spark, sf_dir):
    return _measured(spark, sf_dir, V.bipower_variation())


@query
def jump_rv_minus_bv(spark, sf_dir):
    both = _measured(spark, sf_dir, V.realized_variance(), V.bipower_variation())
    return both.withColumn("jump", F.col("rv") - F.col("bipower"))


@query
def subsampled_rv(spark, sf_dir):
    return _measured(spark, sf_dir, V.subsampled_realized_variance(3))


@query
def realized_kernel(spark, sf_dir):
    return _measured(spark, sf_dir, V.realized_kernel(4))


@query
def kernel_own_bandwidth(spark, sf_dir):
    """Each session's kernel at the bandwidth its own number of returns asks for."""
    paths = _half_hours(spark, sf_dir)
    returns = F.count(F.lit(1)).over(Window.partitionBy("asset", "session_date")) - 1
    sized = paths.withColumn("h", parzen_bandwidth(F.lit(0.01), returns))
    return V.summarize_paths(
        sized, [V.realized_kernel(F.first("h"))], extra=[F.first("h").alias("bandwidth")]
    )


@query
def parzen_bandwidths(spark, sf_dir):
    sizes = _half_hours(spark, sf_dir).groupBy("asset", "session_date").agg(
        (F.count(F.lit(1)) - 1).alias("n_returns"), F.min("mid").alias("low"), F.max("mid").alias("high")
    )
    ratio = F.col("low") / F.col("high")
    return sizes.select("asset", "session_date", "n_returns", parzen_bandwidth(ratio, "n_returns").alias("bandwidth"))


@query
def variance_by_frequency(spark, sf_dir):
    labelled = D.label_sessions(I.ticks(spark, sf_dir))
    return V.realized_variance_by_frequency(labelled, ["30min", "1h", "2h", "35min"], ordinal=I.ORDINAL)


@query
def signature(spark, sf_dir):
    labelled = D.label_sessions(I.ticks(spark, sf_dir))
    return V.signature(
        V.realized_variance_by_frequency(labelled, ["15min", "30min", "1h", "2h", "4h"], ordinal=I.ORDINAL)
    )


@query
def annualized_volatility(spark, sf_dir):
    return I.daily(spark, sf_dir).select("asset", "date", annualized_volatility_pct("rv", 365.25).alias("vol"))


# --- features and targets -----------------------------------------------------------------------------


@query
def trailing_means(spark, sf_dir):
    return X.mean_table(I.sales(spark, sf_dir), I.FEATURES)


@query
def full_timeline_features(spark, sf_dir):
    """No windows: every origin stays."""
    return X.mean_table(I.sales(spark, sf_dir), X.trailing_means("value", ()))


@query
def next_targets(spark, sf_dir):
    return X.next_observation_targets(I.sales(spark, sf_dir), value_col="value")


@query
def join_features(spark, sf_dir):
    sales = I.sales(spark, sf_dir)
    return X.join_features([X.mean_table(sales, m) for m in (I.FEATURES, I.RISES, I.FALLS)])


@query
def forecast_table(spark, sf_dir):
    return I.wide_forecast_data(spark, sf_dir)


@query
def forecast_table_custom(spark, sf_dir):
    """A builder of the user's own beside the trailing means: the tables are joined."""

    def weekday(data):
        return data.select("series", F.col("date").alias("origin_date"), F.dayofweek("date").cast("double").alias("weekday"))

    return X.build_forecast_data(I.sales(spark, sf_dir), [I.FEATURES, weekday], value_col="value")


@query
def prepared_with_missing_features(spark, sf_dir):
    """Origins without features drop out; labels stay with their own origin."""
    sales = I.sales(spark, sf_dir)
    features = X.mean_table(sales, I.FEATURES).where(F.dayofweek("origin_date") != 4)
    return X.prepare_forecast_data(features, X.next_observation_targets(sales, value_col="value"))


@query
def gaps(spark, sf_dir):
    return X.observation_gaps(I.sales(spark, sf_dir))


@query
def large_gaps(spark, sf_dir):
    return X.large_gaps(I.sales(spark, sf_dir), 1)


@query
def observation_violations(spark, sf_dir):
    """How many rows of the sales series break the rules of a target series."""
    sales = I.sales(spark, sf_dir)
    twice = sales.union(sales.where(F.dayofmonth("date") == 20))
    broken = twice.withColumn("value", F.when(F.dayofmonth("date") == 7, F.lit(float("nan"))).otherwise(F.col("value")))
    return X.observation_violations(broken, extra={"low": F.col("value") < 11})


@query
def unmatched_origins(spark, sf_dir):
    """Feature origins that a target timeline with missing days lacks."""
    sales = I.sales(spark, sf_dir)
    features = X.mean_table(sales, I.FEATURES)
    targets = X.next_observation_targets(sales.where(F.dayofmonth("date") != 11), value_col="value")
    return X.unmatched_origins(features, targets)


@query
def preparation_violations(spark, sf_dir):
    """Features and targets with rows of every fault: what is wrong, and how often, per series."""
    sales = I.sales(spark, sf_dir)
    day, gone = F.dayofmonth("origin_date"), F.lit(None)
    features = X.mean_table(sales, I.FEATURES)
    features = features.withColumns({
        "value_mean_5": F.when(day == 3, float("nan")).otherwise(F.col("value_mean_5")),
        "origin_date": F.when(day == 5, gone).otherwise(F.col("origin_date")),
    }).unionByName(features.where(day == 8))
    targets = X.next_observation_targets(sales, value_col="value")
    targets = targets.where(day != 11).withColumns({
        "target": F.when(day == 13, gone).when(day == 14, float("inf")).otherwise(F.col("target")),
        "target_date": F.when(day == 16, F.col("origin_date")).when(day == 18, F.date_add("target_date", 1)).otherwise(F.col("target_date")),
    }).unionByName(targets.where(day == 20))
    return X.preparation_violations(features, targets)


# --- forecasts ------------------------------------------------------------------------------------------


def _walk(spark, sf_dir, *models, wide=False):
    data = I.wide_forecast_data(spark, sf_dir) if wide else I.forecast_data(spark, sf_dir)
    return W.walk_forward_models(data, models, min_train_size=252)


@query
def known_totals(spark, sf_dir):
    """Orders known at each sales date, the date's own left out.

    A status holds up to half of all orders, so its running sums are cut at the months.
    """
    orders = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderkey"
    )
    # every date for every status there is: the few statuses are handed to each of 16 slots of dates
    slots = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("slot")
    dates = I.sales(spark, sf_dir).select("date").distinct().withColumn("slot", F.pmod(F.hash("date"), F.lit(16)))
    days = dates.join(orders.select("status").distinct().select("status", slots), "slot").select("date", "status")
    return accumulate_known(
        orders, days, keys=["status"], event_at="day", query_at="date", tie=["o_orderkey"], inclusive=False,
        totals={"price": F.col("o_totalprice")}, latest={"top": F.col("o_orderkey")},
        block=lambda at: F.trunc(at, "month"),
    ).withColumn("price", F.round(F.col("price"), 2))


@query
def wf_mean(spark, sf_dir):
    return _walk(spark, sf_dir, I.BENCHMARKS[0])


@query
def wf_naive(spark, sf_dir):
    return _walk(spark, sf_dir, I.BENCHMARKS[1])


@query
def wf_ewma(spark, sf_dir):
    return _walk(spark, sf_dir, I.BENCHMARKS[2])


@query
def wf_ar1(spark, sf_dir):
    return _walk(spark, sf_dir, I.BENCHMARKS[3])


@query
def wf_har(spark, sf_dir):
    return _walk(spark, sf_dir, I.HAR)


@query
def wf_shar(spark, sf_dir):
    return _walk(spark, sf_dir, I.SHAR, wide=True)


@query
def wf_ridge(spark, sf_dir):
    return _walk(spark, sf_dir, *[ridge_model(I.FEATURES, p, f"ridge-{p:g}") for p in RIDGE_GRID])


@query
def wf_models(spark, sf_dir):
    """All models of the study between two target dates, in one pass."""
    return I.study(spark, sf_dir)["log"]


class RecentMean:
    """A rule of the user's own: the mean of the last five targets."""

    def fit(self, features, target):
        self.value = float(np.mean(target[-5:]))
        return self

    def predict(self, features):
        return np.full(len(features), self.value)


@query
def wf_custom_rule(spark, sf_dir):
    return _walk(spark, sf_dir, own_rule("recent_mean", RecentMean()))


class LearntMean:
    """The mean of past targets but for the first 50, learnt as they come."""

    def fit(self, features, target):
        self.total, self.count, self.skipped = 0.0, 0, 0
        return self.update(features, target)

    def update(self, features, target):
        fresh = target[max(0, 50 - self.skipped):]
        self.skipped += len(target) - len(fresh)
        self.total, self.count = self.total + float(fresh.sum()), self.count + len(fresh)
        return self

    def predict(self, features):
        return np.full(len(features), self.total / self.count)


@query
def wf_learning_rule(spark, sf_dir):
    return _walk(spark, sf_dir, own_rule("learnt_mean", LearntMean()))


@query
def fit_known(spark, sf_dir):
    ridge = regression("ridge", I.HAR.regressors, penalty=10.0)
    models = [I.HAR, I.BENCHMARKS[3], I.BENCHMARKS[0], ridge]
    return W.fit_known(I.forecast_data(spark, sf_dir), models, before=[CUT])


@query
def coefficient_table(spark, sf_dir):
    return G.coefficient_table(I.wide_forecast_data(spark, sf_dir), [I.HAR, I.SHAR], CUT)


@query
def slope_summary(spark, sf_dir):
    return G.slope_summary(I.forecast_data(spark, sf_dir), I.HAR, CUT)


@query
def quarterly_slopes(spark, sf_dir):
    terms = [I.RISES.names[1], I.FALLS.names[1]]
    return G.quarterly_slopes(
        I.wide_forecast_data(spark, sf_dir), I.SHAR, terms, start=CUT, end=I.DESIGN.last
    )


@query(digits={"actual": 2, "predicted": 2})
def smeared(spark, sf_dir):
    return SM.smeared_forecasts(I.study(spark, sf_dir)["log"])


@query
def smearing_factors(spark, sf_dir):
    return G.smearing_factors(I.study(spark, sf_dir)["forecasts"])


@query
def ridge_calibration(spark, sf_dir):
    return K.calibration(I.forecast_data(spark, sf_dir), I.FEATURES, I.DESIGN)


@query
def ridge_choice(spark, sf_dir):
    return K.best_penalty(K.calibration(I.forecast_data(spark, sf_dir), I.FEATURES, I.DESIGN))


@query
def ridge_uses_no_evaluation_data(spark, sf_dir):
    changed = K.uses_no_evaluation_data(I.forecast_data(spark, sf_dir), I.FEATURES, I.DESIGN)
    return changed.agg(F.count(F.lit(1)).alias("changed_scores"))


@query
def ridge_hindsight(spark, sf_dir):
    return K.hindsight(I.forecast_data(spark, sf_dir), I.FEATURES, I.DESIGN)


@query
def ridge_verdict(spark, sf_dir):
    return K.ridge_verdict(K.tuned_losses(I.forecast_data(spark, sf_dir), I.FEATURES, I.DESIGN), "HAR")


@query
def walk_forward_violations(spark, sf_dir):
    """A forecasting table with broken rows: what is wrong, and how often."""
    data = I.forecast_data(spark, sf_dir)
    day = F.dayofmonth("origin_date")
    broken = data.withColumns(
        {
            "target": F.when(day == 3, float("nan")).otherwise(F.col("target")),
            "target_date": F.when(day == 7, F.col("origin_date")).when(day == 9, F.date_add("origin_date", 5))
            .when(day == 11, F.lit(None)).otherwise(F.col("target_date")),
        }
    )
    found = W.walk_forward_violations(broken.unionByName(data.where(day == 20)), I.HAR.regressors)
    return found.toDF("series", "missing", "not_before", "goes_back", "not_finite", "repeated")


@query
def forecast_violations(spark, sf_dir):
    """Forecast records with broken rows: what is wrong, and how often, per model."""
    runs = I.study(spark, sf_dir)["log"]
    day = F.dayofmonth("target_date")
    broken = runs.withColumns(
        {
            "predicted": F.when(day == 3, float("inf")).otherwise(F.col("predicted")),
            "origin_date": F.when(day == 7, F.col("target_date")).when(day == 9, F.lit(None)).otherwise(F.col("origin_date")),
            "series": F.when(day == 12, F.lit("  ")).otherwise(F.col("series")),
        }
    )
    return SM.forecast_violations(broken).toDF("model", "missing", "blank", "not_finite", "not_after", "repeated")


@query
def uneven_cases(spark, sf_dir):
    """Cases that not every model has, after some are taken from one model."""
    runs = I.study(spark, sf_dir)["log"]
    short = runs.where(~((F.col("model") == "EWMA") & (F.dayofmonth("target_date") == 5)))
    return C.uneven_cases(short).drop("actual")


# --- comparison -------------------------------------------------------------------------------------------


def _losses(spark, sf_dir):
    return I.study(spark, sf_dir)["losses"]


@query
def loss_violations(spark, sf_dir):
    """Losses of which some are made negative, infinite or missing."""
    day = F.dayofmonth("target_date")
    broken = F.when(day == 7, F.lit(-1.0)).when(day == 9, F.lit(float("inf"))).when(day != 11, F.col("loss"))
    return C.loss_violations(_losses(spark, sf_dir).withColumn("loss", broken))


@query(digits={"actual": 2, "predicted": 2})
def qlike_losses(spark, sf_dir):
    return _losses(spark, sf_dir)


@query(digits={"actual": 8})
def other_losses(spark, sf_dir):
    forecasts = I.study(spark, sf_dir)["forecasts"]
    scaled = forecasts.withColumns({"actual": F.col("actual") / 1e6, "predicted": F.col("predicted") / 1e6})
    squared = C.forecast_losses(scaled, squared_error).withColumnRenamed("loss", "squared")
    return squared.withColumn("absolute", absolute_error(F.col("actual"), F.col("predicted"))).withColumn(
        "qlike", qlike(F.col("actual"), F.col("predicted"))
    )


@query
def loss_matrix(spark, sf_dir):
    return C.loss_matrix(I.study(spark, sf_dir)["losses"], I.MODEL_NAMES)


@query
def paired_gains(spark, sf_dir):
    return C.paired_losses(_losses(spark, sf_dir), "HAR")


@query
def compare_models(spark, sf_dir):
    return C.compare_models(I.study(spark, sf_dir)["losses"], I.DESIGN.candidate)


@query
def dm_lags(spark, sf_dir):
    return C.hac_sensitivity(_losses(spark, sf_dir), "HAR")


@query
def dm_fixed_lags(spark, sf_dir):
    return C.hac_sensitivity(_losses(spark, sf_dir), "HAR", [0, 3, 12])


@query
def dm_lag_grid(spark, sf_dir):
    return G.hac_table(_losses(spark, sf_dir), "HAR")


@query(significant=("0", "3", "12"))
def dm_wide_table(spark, sf_dir):
    """p-values with one column per lag."""
    return G.hac_table(_losses(spark, sf_dir), "HAR", [0, 3, 12])


@query
def untestable_pairs(spark, sf_dir):
    """Losses with dates missing here and there, and two dates of one model: which pairs can't be tested, and why."""
    losses = _losses(spark, sf_dir)
    day, date = F.dayofmonth("target_date"), F.col("target_date")
    naive, mean, own = (F.col("model") == name for name in ("naive", "historical_mean", "HAR"))
    kept = (~naive | (date <= F.lit(I.DESIGN.scored_from + timedelta(days=20)))) & ~(mean & (day == 5)) & ~(own & (day == 9))
    broken = losses.where(kept).withColumn("loss", F.when(mean & (day == 7), float("nan")).otherwise(F.col("loss")))
    return C.untestable_pairs(broken, "HAR", lags=[0, 3, 12, 40])


@query
def win_rates(spark, sf_dir):
    return C.win_rates(_losses(spark, sf_dir), "HAR")


@query
def results_table(spark, sf_dir):
    return C.results_table(I.study(spark, sf_dir)["losses"], I.DESIGN.candidate)


@query
def candidate_verdict(spark, sf_dir):
    return G.candidate_verdict(_losses(spark, sf_dir), "HAR")


@query
def monthly_losses(spark, sf_dir):
    return G.monthly_losses(_losses(spark, sf_dir), I.MODEL_NAMES)


@query
def month_leaders(spark, sf_dir):
    return G.month_leaders(_losses(spark, sf_dir), I.MODEL_NAMES)


@query
def cumulative_advantage(spark, sf_dir):
    return G.cumulative_advantage(_losses(spark, sf_dir), "HAR")


@query
def concentration(spark, sf_dir):
    return G.concentration(_losses(spark, sf_dir), "HAR")


def _with_year(frame):
    return frame.withColumn("sessions_per_year", F.lit(365.25)).withColumns(
        {"actual": F.col("actual") / 1e10, "predicted": F.col("predicted") / 1e10}
    )


@query
def worst_days(spark, sf_dir):
    return G.worst_days(_with_year(_losses(spark, sf_dir)), "HAR")


@query
def recent_paths(spark, sf_dir):
    return G.recent_paths(_with_year(I.study(spark, sf_dir)["forecasts"]), ["HAR", "naive"])


@query
def reverse_tests(spark, sf_dir):
    return G.reverse_tests(I.shar_study(spark, sf_dir)["losses"], "HAR", "SHAR")


@query
def head_to_head(spark, sf_dir):
    return G.head_to_head(I.shar_study(spark, sf_dir)["losses"], "HAR", "SHAR")


@query
def slope_verdict(spark, sf_dir):
    data = I.wide_forecast_data(spark, sf_dir)
    rising, falling = I.RISES.names[1], I.FALLS.names[1]
    slopes = G.quarterly_slopes(data, I.SHAR, [rising, falling], start=CUT, end=I.DESIGN.last)
    reverse = G.reverse_tests(run_study(data, [I.HAR, I.SHAR], I.DESIGN)["losses"], "HAR", "SHAR")
    return G.slope_verdict(slopes, reverse, rising, falling)


# --- description --------------------------------------------------------------------------------------------


@query
def data_checks(spark, sf_dir):
    return S.data_checks(I.daily(spark, sf_dir), frequency=I.BAR)


@query
def vol_percentiles(spark, sf_dir):
    return S.volatility_percentiles(I.daily(spark, sf_dir))


@query
def rising_share(spark, sf_dir):
    return S.rising_share(I.daily(spark, sf_dir))


@query
def skewness(spark, sf_dir):
    return S.skewness(I.daily(spark, sf_dir))


@query
def autocorrelation(spark, sf_dir):
    return S.autocorrelation(I.sales(spark, sf_dir), "value", key="series")


@query
def histogram(spark, sf_dir):
    return S.histogram(I.sales(spark, sf_dir), "value", key="series")


@query
def volatility_history(spark, sf_dir):
    return S.volatility_history(I.daily(spark, sf_dir), 5)


# --- streaming ------------------------------------------------------------------------------------------------


@query
def stream_daily_rv(spark, sf_dir):
    """The event file as a stream: sessions the watermark has closed, written as files."""
    schema = I.table(spark, sf_dir, "events").schema
    base = _scratch(spark, "stream-daily")
    arriving = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("mid"),
                "event_id")
    )
    job = (
        stream_daily(arriving, frequency=I.BAR, ordinal=I.ORDINAL)
        .writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(I.daily(spark, sf_dir).schema).parquet(f"{base}/out")


@query
def stream_daily_table(spark, sf_dir):
    """The events in four files, each with ticks of all days, streamed into the daily table file by file."""
    base = _scratch(spark, "stream-table")
    events = I.all_ticks(spark, sf_dir)
    events.withColumn("part", F.col("event_id") % 4).repartition(4, "part").write.partitionBy("part").parquet(f"{base}/in")
    layout = Layout(f"{base}/tables")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/part=*")
    job = (
        stream_into_table(arriving, layout, name="events", ordinal=I.ORDINAL, frequency=I.BAR)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return read_daily(spark, layout.daily(I.BAR))

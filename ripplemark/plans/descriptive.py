"""What the daily table looks like: checks, percentiles, persistence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.checks import positive_int
from ripplemark.functions.numeric import annualized_volatility_pct, as_column
from ripplemark.functions.sessions import prices_per_session
from ripplemark.operators.blocks import runs

# Fixed values of the published tables and charts.
VOLATILITY_LEVELS = (0.01, 0.5, 0.99)
RISING_LEVELS = (0.05, 0.5, 0.95)
HISTOGRAM_BINS = 60
MAX_LAG = 60
#: Rows of a block of a series whose lagged products are summed in one task.
LAG_BLOCK = 16_384
VOLATILITY_MEAN_WINDOW = 22


def _asset_dates() -> Window:
    return Window.partitionBy("asset").orderBy("date")


def with_sessions_per_year(daily: DataFrame) -> DataFrame:
    """Every daily row with its asset's sessions per year."""
    asset = Window.partitionBy("asset")
    years = F.datediff(F.max("date").over(asset), F.min("date").over(asset)) / F.lit(365.25)
    return daily.withColumn(
        "sessions_per_year", F.try_divide(F.count(F.lit(1)).over(asset) - 1, years)
    )


def with_volatility(daily: DataFrame) -> DataFrame:
    """Every daily row with its annualized volatility in percent."""
    return with_sessions_per_year(daily).withColumn(
        "vol", annualized_volatility_pct("rv", F.col("sessions_per_year"))
    )


def data_checks(daily: DataFrame, *, frequency: str = "5min") -> DataFrame:
    """Per asset: sessions, dates, gaps and completeness of the daily table."""
    full = prices_per_session(frequency)
    days = F.datediff("date", F.lag("date").over(_asset_dates()))
    gaps = daily.withColumn("_gap", days)
    years = F.datediff(F.max("date"), F.min("date")) / F.lit(365.25)
    complete = F.count_if(F.col("observation_count") == full)
    return gaps.groupBy("asset").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.min("date").alias("first_session"),
        F.max("date").alias("last_session"),
        F.try_divide(F.count(F.lit(1)) - 1, years).alias("sessions_per_year"),
        (F.count(F.lit(1)) - F.countDistinct("date")).alias("duplicate_dates"),
        F.max("_gap").cast("bigint").alias("longest_gap_days"),
        F.max_by("date", F.struct("_gap", -F.unix_date("date"))).alias("longest_gap_ends"),
        complete.alias("full_sessions"),
        (complete / F.count(F.lit(1))).alias("full_share"),
        F.min("observation_count").alias("fewest_prices"),
    )


def percentiles(daily: DataFrame, value: Column | str, levels: Sequence[float], name: str) -> DataFrame:
    """Exact percentiles, with linear interpolation, of one daily value per asset."""
    listed = F.percentile(as_column(value), F.array(*[F.lit(float(p)) for p in levels]))
    points = F.arrays_zip(F.array(*[F.lit(float(p)) for p in levels]).alias("level"), listed.alias("value"))
    return daily.groupBy("asset").agg(points.alias("_points")).select(
        "asset", F.inline("_points").alias("level", name)
    )


def volatility_percentiles(daily: DataFrame, levels: Sequence[float] = VOLATILITY_LEVELS) -> DataFrame:
    return percentiles(with_volatility(daily), "vol", levels, "vol")


def rising_share(daily: DataFrame, levels: Sequence[float] = RISING_LEVELS) -> DataFrame:
    """Percentiles of the share of a session's variance that comes from rising returns."""
    return percentiles(daily, F.col("rs_pos") / F.col("rv"), levels, "rising_share")


def skewness(daily: DataFrame, columns: Sequence[str] = ("rv", "log_rv")) -> DataFrame:
    """Bias-corrected skewness per asset and column; null with under three rows."""
    def corrected(name: str) -> Column:
        n = F.count(name).cast("double")
        return F.when(F.count(name) >= 3, F.skewness(name) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))

    return daily.groupBy("asset").agg(*[corrected(c).alias(f"skew_{c}") for c in columns])


def _lag_sums(max_lag: int, block: int):
    """Sums of the pairs of each lag whose later row is one of the block's own, from its rows and those before it."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lags = np.arange(1, max_lag + 1)
        for rows in runs(batches, ["key", "block"]):
            own = int((rows["at"].to_numpy() < rows["block"].iloc[0] * block).sum())
            if own == len(rows):
                continue
            x = rows["x"].to_numpy("float64") - float(rows["base"].iloc[0])
            there = ~np.isnan(x)
            filled = np.where(there, x, 0.0)
            sums = np.zeros((max_lag, 7))
            for k in lags[: len(x) - 1]:
                later, earlier = slice(max(own, k), None), slice(max(own, k) - k, len(x) - k)
                both = there[later] & there[earlier]
                y, z = filled[later] * both, filled[earlier] * both
                sums[k - 1] = there[earlier].sum(), both.sum(), y.sum(), z.sum(), y @ y, z @ z, y @ z
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows["key"].iloc[0]] * max_lag), pa.array(lags), *(pa.array(c) for c in sums.T)],
                names=["key", "lag", "pairs", "n", "sy", "sz", "syy", "szz", "syz"])

    return summed


def autocorrelation(
    frame: DataFrame,
    value: str,
    *,
    max_lag: int = MAX_LAG,
    key: str = "asset",
    date_col: str = "date",
    block: int = LAG_BLOCK,
) -> DataFrame:
    """Correlation of a value with itself ``lag`` rows earlier, for lags 1 to ``max_lag``.

    A series is cut into blocks of ``block`` rows (``max_lag`` at least), each with the last ``max_lag`` rows before it, so
    a pair of rows lies in one block. All lags' sums of a block are made at once, about the series' first value, and
    merged. ``pairs`` counts the rows with an earlier value.
    """
    size = max(positive_int(block, "block"), positive_int(max_lag, "max_lag"))
    ordered = Window.partitionBy("key").orderBy("date")
    numbered = frame.select(F.col(key).alias("key"), F.col(date_col).alias("date"), F.col(value).cast("double").alias("x")).select(
        "key", "x", (F.row_number().over(ordered) - 1).cast("bigint").alias("at"),
        F.coalesce(F.first("x", ignorenulls=True).over(ordered), F.lit(0.0)).alias("base"))
    numbered = numbered.withColumn("block", F.floor(F.col("at") / size))
    before = numbered.where(F.col("at") % size >= size - max_lag).withColumn("block", F.col("block") + 1)
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.unionByName(before).repartition(tasks, "key", "block").sortWithinPartitions("key", "block", "at")
    kind = frame.schema[key].dataType.simpleString()
    sums = dealt.mapInArrow(_lag_sums(max_lag, size), (
        f"key {kind}, lag bigint, pairs double, n double, sy double, sz double, syy double, szz double, syz double"))
    merged = sums.groupBy("key", "lag").agg(*[F.sum(c).alias(c) for c in ("pairs", "n", "sy", "sz", "syy", "szz", "syz")])
    n, sy, sz = F.col("n"), F.col("sy"), F.col("sz")
    spread = F.sqrt(n * F.col("syy") - sy * sy) * F.sqrt(n * F.col("szz") - sz * sz)
    return merged.where("pairs > 0").select(
        F.col("key").alias(key), "lag", ((n * F.col("syz") - sy * sz) / F.nullif(spread, F.lit(0.0))).alias("autocorrelation"),
        F.col("pairs").cast("bigint").alias("pairs"))


def histogram(frame: DataFrame, value: Column | str, *, bins: int = HISTOGRAM_BINS, key: str = "asset") -> DataFrame:
    """Counts in equal-width bins from smallest to largest value; the last bin is closed.

    Empty bins are left out. ``bin`` counts from 1.
    """
    positive_int(bins, "bins")
    values = frame.select(key, as_column(value).alias("_v"))
    # smallest and largest values are merged ahead of the shuffle and come back as one row per key
    ranges = values.groupBy(F.col(key).alias("_key")).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    ranged = values.join(ranges, F.col(key).eqNullSafe(F.col("_key")))
    width = F.col("_high") - F.col("_low")
    place = F.when(width > 0, F.floor((F.col("_v") - F.col("_low")) / width * bins) + 1).otherwise(F.lit(1))
    return (
        ranged.withColumn("bin", F.least(place, F.lit(bins)).cast("bigint"))
        .groupBy(key, "bin", "_low", "_high")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            key, "bin",
            (F.col("_low") + (F.col("bin") - 1) * (F.col("_high") - F.col("_low")) / bins).alias("bin_start"),
            "rows",
        )
    )


def volatility_history(daily: DataFrame, window: int = VOLATILITY_MEAN_WINDOW) -> DataFrame:
    """Annualized volatility with its trailing mean, null until the window is filled."""
    positive_int(window, "window")
    rows = _asset_dates().rowsBetween(-(window - 1), Window.currentRow)
    return with_volatility(daily).select(
        "asset", "date", "vol",
        F.when(F.count("vol").over(rows) == window, F.avg("vol").over(rows)).alias("vol_mean"),
        "log_rv",
    )

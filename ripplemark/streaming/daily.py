"""Daily variances from tick files as they arrive: as a stream of closed sessions, or merged into the daily table.

Event time is the session wall clock (New York time moved so that a session is a calendar
day), so a session is one day window. Wall time repeats an hour when summer time ends, so
the watermark must be at least an hour behind.

State is one price per asset and bin until the watermark passes the session's end: bounded by
the sampling grid, not by the number of ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql import functions as F

from ripplemark.functions.numeric import is_positive
from ripplemark.functions.sessions import (
    DAY_MICROS,
    MIN_SESSION_HOURS,
    hours_between,
    session_wall_time,
    step_micros,
)
from ripplemark.operators.sampling import floor_to_step, last_price
from ripplemark.plans.daily import DAILY_COLUMNS, SAMPLING_FREQUENCY, VARIANCE_COLUMNS, valid_ticks
from ripplemark.sources.daily_table import Layout, refresh_daily
from ripplemark.sources.ticks import write_ticks

DELAY = "2 hours"


def _sum_of_squares(returns: Column, keep) -> Column:
    return F.aggregate(F.filter(returns, keep), F.lit(0.0), lambda total, r: total + r * r)


def stream_daily(
    ticks: DataFrame,
    *,
    frequency: str = SAMPLING_FREQUENCY,
    min_session_hours: float = MIN_SESSION_HOURS,
    delay: str = DELAY,
    ordinal: Sequence[str] = (),
) -> DataFrame:
    """The daily table of a stream of ticks, for append mode.

    A session is emitted once the watermark has passed its close; ticks that arrive later
    than the delay are left out. Where a time occurs twice, ``ordinal`` says which tick is the
    later one, as in the batch job; without it either may be kept. The edge filter of the batch job needs the end of the data, which a stream does not have.
    """
    step = step_micros(frequency)
    if DAY_MICROS % step:
        raise ValueError("a streamed frequency must divide the session length")
    bins = (
        ticks.where(F.col("ts").isNotNull() & is_positive("mid"))
        .withColumn("wall", session_wall_time("ts"))
        .withWatermark("wall", delay)
        .withColumn("bin", floor_to_step(F.col("ts"), step))
        .groupBy("asset", F.window("wall", "1 day").alias("session"), "bin")
        .agg(last_price(ticks, "ts", "mid", ordinal, step).alias("mid"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    sessions = bins.groupBy("asset", F.window(F.window_time("session"), "1 day").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("bin", F.ln("mid").alias("lp")))).alias("path"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    prices = F.transform("path", lambda point: point["lp"])
    returns = F.transform(
        F.slice("prices", F.lit(2), F.greatest(F.size("prices") - 1, F.lit(0))),
        lambda p, i: p - F.element_at("prices", i + 1),
    )
    measured = (
        sessions.withColumn("prices", prices)
        .withColumn("returns", returns)
        .select(
            "asset",
            F.to_date("day.start").alias("date"),
            _sum_of_squares(F.col("returns"), lambda r: r.isNotNull()).alias("rv"),
            _sum_of_squares(F.col("returns"), lambda r: r > 0).alias("rs_pos"),
            _sum_of_squares(F.col("returns"), lambda r: r < 0).alias("rs_neg"),
            F.size("prices").cast("bigint").alias("observation_count"),
            hours_between("first_ts", "last_ts").alias("_hours"),
        )
    )
    kept = measured.where(F.col("_hours") >= F.lit(float(min_session_hours)))
    for name in VARIANCE_COLUMNS:
        kept = kept.where(F.col(name) > 0)
    return kept.withColumns({f"log_{name}": F.ln(name) for name in VARIANCE_COLUMNS}).select(*DAILY_COLUMNS)


def stream_into_table(
    ticks: DataFrame, layout: Layout, *, name: str, ordinal: Sequence[str] = (), frequency: str = SAMPLING_FREQUENCY, **options
) -> DataStreamWriter:
    """A stream of ticks into the tick table and the daily table on disk; start it with a checkpoint location.

    Each batch is a delivery, and the sessions its files touch are recomputed whole: a late tick corrects its day, however
    late it is, sessions that the data's edges cut are left out until they are whole, and there is no state that grows.
    A batch that is repeated after a failure keeps its number, so it changes nothing. ``name`` tells streams into one
    table apart and stays the same when a stream is started again. Ticks without a time or a positive price are dropped.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        write_ticks(valid_ticks(batch), layout.ticks, ordinal=ordinal, owner=f"{name}-{number}")
        refresh_daily(batch.sparkSession, layout, frequency=frequency, **options)

    return ticks.writeStream.foreachBatch(deliver)

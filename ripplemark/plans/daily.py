"""From ticks to one row per asset and trading session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.checks import finite_number, require_columns
from ripplemark.functions.numeric import is_finite, is_positive
from ripplemark.functions.sessions import (
    EDGE_TOLERANCE_HOURS,
    MIN_SESSION_HOURS,
    hours_between,
    session_close,
    session_date,
    session_open,
    step_micros,
)
from ripplemark.operators.sampling import SESSION_KEYS, last_tick_sample
from ripplemark.operators.variance import (
    realized_semivariances,
    realized_variance,
    summarize_paths,
)

SAMPLING_FREQUENCY = "5min"
VARIANCE_COLUMNS = ("rv", "rs_pos", "rs_neg")
DAILY_COLUMNS = (
    "asset", "date", *VARIANCE_COLUMNS, *(f"log_{name}" for name in VARIANCE_COLUMNS), "observation_count",
)


def valid_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks with a time and a finite positive price; count the others with ``tick_violations``."""
    return ticks.where(F.col("ts").isNotNull() & is_positive("mid"))


def label_sessions(ticks: DataFrame) -> DataFrame:
    """Add the trading session of every tick."""
    return ticks.withColumn("session_date", session_date("ts"))


def full_sessions(ticks: DataFrame, min_hours: float = MIN_SESSION_HOURS) -> DataFrame:
    """Ticks of the sessions that last long enough from first to last tick.

    The spans are merged before the shuffle; the kept sessions come back as a semi-join.
    :func:`summarize_sessions` needs no such join: it carries the spans along.
    """
    labelled = ticks if "session_date" in ticks.columns else label_sessions(ticks)
    spans = labelled.groupBy(*SESSION_KEYS).agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    kept = spans.where(hours_between("a", "z") >= F.lit(float(min_hours))).select(*SESSION_KEYS)
    return labelled.join(kept, list(SESSION_KEYS), "left_semi")


def summarize_sessions(
    ticks: DataFrame,
    *,
    frequency: str = SAMPLING_FREQUENCY,
    ordinal: Sequence[str] = (),
) -> DataFrame:
    """Every session's variances, price count and first and last tick, before any filter."""
    sample = last_tick_sample(label_sessions(ticks), frequency, ordinal=ordinal)
    return summarize_paths(
        sample,
        [realized_variance(), *realized_semivariances()],
        extra=[F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")],
    ).withColumnRenamed("n_prices", "observation_count")


def keep_complete(
    sessions: DataFrame,
    *,
    min_session_hours: float = MIN_SESSION_HOURS,
    edge_tolerance_hours: float | None = EDGE_TOLERANCE_HOURS,
) -> DataFrame:
    """Sessions that are long enough, moved both ways, and are not cut by the data's edges.

    The first kept session goes if the asset's data starts more than the tolerance after
    that session opened; the last one if the data ends that long before it closed. Works on
    one row per session, which the calendar bounds for every asset.
    """
    asset = Window.partitionBy("asset")
    measured = sessions.withColumns(
        {"_starts": F.min("first_ts").over(asset), "_ends": F.max("last_ts").over(asset)}
    )
    rules = (hours_between("first_ts", "last_ts") >= F.lit(float(min_session_hours))) & (
        F.col("observation_count") >= 2
    )
    for name in VARIANCE_COLUMNS:
        rules = rules & is_finite(name) & (F.col(name) > 0)
    kept = measured.where(rules)
    if edge_tolerance_hours is not None:
        late_start = hours_between(session_open("session_date"), "_starts") > edge_tolerance_hours
        early_end = hours_between("_ends", session_close("session_date")) > edge_tolerance_hours
        kept = kept.withColumns(
            {
                "_first": F.col("session_date") == F.min("session_date").over(asset),
                "_last": F.col("session_date") == F.max("session_date").over(asset),
            }
        ).where(~(F.col("_first") & late_start) & ~(F.col("_last") & early_end))
    return kept


def daily_rows(sessions: DataFrame) -> DataFrame:
    """Kept sessions as rows of the daily table: ``DAILY_COLUMNS``."""
    logs = {f"log_{name}": F.ln(name) for name in VARIANCE_COLUMNS}
    return sessions.withColumnRenamed("session_date", "date").withColumns(logs).select(*DAILY_COLUMNS)


def build_daily(
    ticks: DataFrame,
    *,
    frequency: str = SAMPLING_FREQUENCY,
    min_session_hours: float = MIN_SESSION_HOURS,
    edge_tolerance_hours: float | None = EDGE_TOLERANCE_HOURS,
    ordinal: Sequence[str] = (),
) -> DataFrame:
    """The daily table of every asset: ``DAILY_COLUMNS``, one row per complete session.

    Only returns inside a session count. All files are one table here, so a session that
    crosses files or days is whole, and ticks delivered twice fall into the same bin.
    """
    if finite_number(min_session_hours, "min_session_hours") <= 0:
        raise ValueError("min_session_hours must be positive")
    step_micros(frequency)
    require_columns(ticks, ["asset", "ts", "mid", *ordinal], "ticks")
    sessions = summarize_sessions(ticks, frequency=frequency, ordinal=ordinal)
    kept = keep_complete(
        sessions, min_session_hours=min_session_hours, edge_tolerance_hours=edge_tolerance_hours
    )
    return daily_rows(kept)


def merge_sessions(tables: DataFrame) -> DataFrame:
    """Daily rows from runs over overlapping files: the copy with the most prices stays."""
    copies = Window.partitionBy("asset", "date").orderBy(F.desc("observation_count"), F.desc("rv"))
    return tables.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1").drop("_copy")


def sessions_per_year(daily: DataFrame, *, asset_col: str = "asset", date_col: str = "date") -> DataFrame:
    """Sessions per calendar year of each asset, counted; null with under two distinct dates."""
    years = F.datediff(F.max(date_col), F.min(date_col)) / F.lit(365.25)
    return daily.groupBy(asset_col).agg(
        F.try_divide(F.count(F.lit(1)) - 1, years).alias("sessions_per_year")
    )

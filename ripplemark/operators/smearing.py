"""Forecasts of log values as forecasts of the values themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.checks import (
    DataError,
    enforce,
    enforce_not_empty,
    enforce_unique,
    positive_int,
    require_columns,
    violations,
)
from ripplemark.functions.numeric import is_finite
from ripplemark.operators.timeline import EVENT, QUERY_AFTER, running, self_timeline

#: Columns that name a forecast.
CASE_COLUMNS = ("model", "origin_date", "target_date", "series")

#: Errors a model must have seen before its forecasts are converted.
MIN_ERRORS = 20


def forecast_rules() -> dict[str, Column]:
    """What makes a forecast record unusable."""
    return {
        "origin or target date missing": F.col("origin_date").isNull() | F.col("target_date").isNull(),
        "blank model or series": (F.trim("model") == "") | (F.trim("series") == ""),
        "forecast value not finite": ~is_finite("actual") | ~is_finite("predicted"),
        "target date not after its origin": F.col("origin_date") >= F.col("target_date"),
    }


def forecast_violations(forecasts: DataFrame) -> DataFrame:
    """How many records of each model break each rule, and how many repeat a target date."""
    copies = Window.partitionBy("series", "model", "target_date").orderBy("origin_date")
    numbered = forecasts.withColumn("_copy", F.row_number().over(copies))
    return violations(numbered, {**forecast_rules(), "repeated target date": F.col("_copy") > 1}, ["model"])


def enforce_forecasts(forecasts: DataFrame) -> None:
    """Run the data rules of a forecast table now."""
    require_columns(forecasts, [*CASE_COLUMNS, "actual", "predicted"], "forecast")
    enforce_not_empty(forecasts, "forecasts")
    enforce(forecasts, forecast_rules(), "forecasts")
    enforce_unique(forecasts, ["series", "model", "target_date"], "forecasts")


def with_series(forecasts: DataFrame) -> DataFrame:
    """Give forecasts of a single unnamed series the name ``default``."""
    return forecasts if "series" in forecasts.columns else forecasts.withColumn("series", F.lit("default"))


def smeared_forecasts(
    log_forecasts: DataFrame, *, min_errors: int = MIN_ERRORS, check: bool = False
) -> DataFrame:
    """Log forecasts on the original scale, corrected by each model's own past errors.

    exp of a log forecast is too low on average. Each forecast is multiplied by the mean of
    exp(actual - predicted) over the model's forecasts whose outcome was known at its origin
    (Duan smearing). Forecasts with fewer than ``min_errors`` such errors are dropped. Adds
    ``smearing_factor``.
    """
    positive_int(min_errors, "min_errors")
    frame = with_series(log_forecasts)
    require_columns(frame, [*CASE_COLUMNS, "actual", "predicted"], "forecast")
    if check:
        enforce_forecasts(frame)
    window = running(["series", "model"])
    error = F.when(F.col("_kind") == EVENT, F.exp(F.col("actual") - F.col("predicted")))
    line = self_timeline(frame, event_at="target_date", query_at="origin_date")
    known = line.withColumns(
        {"_errors": F.count(error).over(window), "smearing_factor": F.avg(error).over(window)}
    )
    result = known.where((F.col("_kind") == QUERY_AFTER) & (F.col("_errors") >= min_errors)).select(
        *[c for c in frame.columns if c not in ("actual", "predicted")],
        F.exp("actual").alias("actual"),
        (F.exp("predicted") * F.col("smearing_factor")).alias("predicted"),
        "smearing_factor",
    ).select(*frame.columns, "smearing_factor")
    if check and result.isEmpty():
        raise DataError(f"no forecast has {min_errors} errors known at its origin")
    return result

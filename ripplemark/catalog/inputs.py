"""The driver's tables in the shapes the operators take, and results in comparable form."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemark.operators.features import build_forecast_data
from ripplemark.plans.daily import build_daily, valid_ticks
from ripplemark.plans.study import (
    benchmark_models,
    har_features,
    har_model,
    run_study,
    shar_features,
    shar_model,
    study_plan,
)
from ripplemark.session import configure

DIGITS = 6
#: Columns that span many orders of magnitude: six digits from the first one that isn't zero.
SIGNIFICANT = ("p_value",)
BAR = "1h"
ORDINAL = ("event_id",)

DESIGN = study_plan(date(1998, 1, 1), date(1999, 1, 1), date(2001, 6, 30), least_known=252, candidate="HAR")
FEATURES = har_features("value")
RISES, FALLS = shar_features(FEATURES, "rise", "fall")
HAR = har_model(FEATURES)
BENCHMARKS = benchmark_models(FEATURES)
MODELS = [HAR, *BENCHMARKS]
MODEL_NAMES = [m.name for m in MODELS]
SHAR = shar_model(FEATURES, RISES, FALLS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def all_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ticks: the type is the asset, the value the mid price."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("mid"), "event_id",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_ticks(all_ticks(spark, sf_dir))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with a bid and an ask around the value; some are crossed on purpose."""
    wide = all_ticks(spark, sf_dir)
    return wide.withColumns(
        {
            "bid": F.col("mid") * (1 - F.lit(1e-4) * (F.col("event_id") % 7 - 1)),
            "ask": F.col("mid") * (1 - F.lit(1e-4) * (F.col("event_id") % 5 - 2)),
        }
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_daily(ticks(spark, sf_dir), frequency=BAR, ordinal=ORDINAL)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as three long daily series: log of the day's sales, in all and in two parts."""
    price = F.col("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("date"))
        .agg(
            F.ln(F.sum(price)).alias("value"),
            F.ln(F.sum(F.when(F.col("l_discount") > 0.05, price).otherwise(0.0)) + 1.0).alias("rise"),
            F.ln(F.sum(F.when(F.col("l_discount") > 0.05, 0.0).otherwise(price)) + 1.0).alias("fall"),
        )
    )


def forecast_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_forecast_data(sales(spark, sf_dir), [FEATURES], value_col="value")


def wide_forecast_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_forecast_data(sales(spark, sf_dir), [FEATURES, RISES, FALLS], value_col="value")


def study(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return run_study(forecast_data(spark, sf_dir), MODELS, DESIGN)


def shar_study(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return run_study(wide_forecast_data(spark, sf_dir), [HAR, SHAR], DESIGN)


def present(result: DataFrame, digits: dict[str, int] | int = DIGITS, significant: Sequence[str] = ()) -> DataFrame:
    """Dates and times as text, whole numbers as bigint, other numbers rounded.

    ``digits`` may name columns of another scale; the others get ``DIGITS``. ``significant`` columns and those of
    ``SIGNIFICANT`` are rounded to six significant digits.
    """
    columns = []
    for field in result.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, (T.IntegerType, T.LongType, T.BooleanType)):
            c = c.cast("bigint")
        elif field.name in (*SIGNIFICANT, *significant):
            c = F.format_string("%.5e", c.cast("double")).cast("double")
            c = F.when(F.col(f"`{field.name}`").isNotNull(), c)
        elif isinstance(kind, (T.DoubleType, T.DecimalType)):
            places = digits if isinstance(digits, int) else digits.get(field.name, DIGITS)
            near = F.round(c.cast("double"), places)
            c = F.when(near == 0, F.lit(0.0)).otherwise(near)
        columns.append(c.alias(field.name))
    return result.select(*columns)

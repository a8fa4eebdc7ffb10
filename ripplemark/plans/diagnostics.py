"""Where a model's advantage comes from: dates, months, single sessions, refits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.checks import positive_int
from ripplemark.functions.numeric import annualized_volatility_pct
from ripplemark.operators.comparison import (
    diebold_mariano,
    hac_sensitivity,
    paired_losses,
    scoreboard,
)
from ripplemark.operators.forecasts import fit_known
from ripplemark.operators.models import ModelSpec

# Fixed values of the published tables.
BEST_SESSIONS = 10
WORST_SESSIONS = 5
RECENT_MONTHS = 6
HAR_LEVEL = 0.01
SHAR_LEVEL = 0.05

PAIR = ("series", "baseline_model")


def _month(column: str = "target_date") -> Column:
    return F.date_format(column, "yyyy-MM")


def _model_order(models: Sequence[str], column: str = "model") -> Column:
    """Position of a model in the study's own order, for ties."""
    place = F.lit(len(models))
    for index, name in reversed(list(enumerate(models))):
        place = F.when(F.col(column) == name, F.lit(index)).otherwise(place)
    return place


def smearing_factors(forecasts: DataFrame) -> DataFrame:
    """Mean, smallest and largest smearing factor per model; how far forecasts would be too
    low without it; and whether the model has the series' largest mean factor."""
    table = forecasts.groupBy("series", "model").agg(
        F.avg("smearing_factor").alias("mean_factor"),
        F.min("smearing_factor").alias("min_factor"),
        F.max("smearing_factor").alias("max_factor"),
    )
    return table.withColumns(
        {
            "bias_without": F.lit(1.0) - F.lit(1.0) / F.col("mean_factor"),
            "largest_mean": F.col("mean_factor") == F.max("mean_factor").over(Window.partitionBy("series")),
        }
    )


def monthly_losses(losses: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean loss per calendar month, one column per model in study order."""
    return (
        losses.groupBy("series", _month().alias("month"))
        .pivot("model", list(models))
        .agg(F.avg("loss"))
    )


def month_leaders(losses: DataFrame, models: Sequence[str]) -> DataFrame:
    """In how many months each model has the lowest mean loss; models without one count 0."""
    monthly = losses.groupBy("series", _month().alias("month"), "model").agg(F.avg("loss").alias("loss"))
    leaders = monthly.groupBy("series", "month").agg(
        F.min_by("model", F.struct("loss", _model_order(models))).alias("leader")
    )
    counts = leaders.groupBy("series").agg(
        F.count(F.lit(1)).alias("months"),
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.count_if(F.col("leader") == m).alias("months_led"))
                for m in models
            ]
        ).alias("_led"),
    )
    return counts.select("series", "months", F.inline("_led"))


def cumulative_advantage(losses: DataFrame, candidate: str) -> DataFrame:
    """Running sum of baseline loss less candidate loss, by date."""
    so_far = Window.partitionBy(*PAIR).orderBy("target_date").rowsBetween(Window.unboundedPreceding, 0)
    return paired_losses(losses, candidate).select(
        *PAIR, "target_date", "gain", F.sum("gain").over(so_far).alias("cumulative_gain")
    )


def concentration(losses: DataFrame, candidate: str, best: int = BEST_SESSIONS) -> DataFrame:
    """Total gain, the share of it from the best sessions, and the month that gave the most."""
    positive_int(best, "best")
    ranked = Window.partitionBy(*PAIR).orderBy(F.desc("gain"), "target_date")
    month = Window.partitionBy(*PAIR, "month")
    gains = paired_losses(losses, candidate).withColumn("month", _month())
    marked = gains.withColumns({"_rank": F.row_number().over(ranked), "_month_gain": F.sum("gain").over(month)})
    top = F.sum(F.when(F.col("_rank") <= best, F.col("gain")))
    year_month = F.lit(12) * F.substring("month", 1, 4).cast("int") + F.substring("month", 6, 2).cast("int")
    return marked.groupBy(*PAIR).agg(
        F.sum("gain").alias("final_advantage"),
        F.try_divide(top, F.sum("gain")).alias("best_share"),
        F.max_by("month", F.struct("_month_gain", -year_month)).alias("best_month"),
    )


def worst_days(losses: DataFrame, model: str, worst: int = WORST_SESSIONS) -> DataFrame:
    """The model's largest losses with their rank, share of its total loss and size of the miss.

    ``vol_ratio`` is realized over forecast volatility. Give ``losses`` a column
    ``sessions_per_year`` to have both volatilities in percent as well.
    """
    positive_int(worst, "worst")
    series = Window.partitionBy("series")
    ranked = series.orderBy(F.desc("loss"), "target_date")
    own = losses.where(F.col("model") == model).withColumns(
        {"_total": F.sum("loss").over(series), "_n": F.count(F.lit(1)).over(series), "rank": F.row_number().over(ranked)}
    )
    volatility = []
    if "sessions_per_year" in losses.columns:
        volatility = [
            annualized_volatility_pct("actual", F.col("sessions_per_year")).alias("realized_vol"),
            annualized_volatility_pct("predicted", F.col("sessions_per_year")).alias("forecast_vol"),
        ]
    return own.where(F.col("rank") <= worst).select(
        "series", F.col("rank").cast("bigint").alias("rank"), "target_date", *volatility, "loss",
        F.try_divide("loss", "_total").alias("loss_share"),
        (F.lit(float(worst)) / F.col("_n")).alias("sample_share"),
        F.sqrt(F.try_divide("actual", "predicted")).alias("vol_ratio"),
    )


def recent_paths(
    forecasts: DataFrame, models: Sequence[str], *, months: int = RECENT_MONTHS
) -> DataFrame:
    """Realized and forecast volatility over the last months of each series.

    ``forecasts`` needs ``sessions_per_year``; the realized values are those of the first model.
    """
    positive_int(months, "months")
    last = F.max("target_date").over(Window.partitionBy("series"))
    recent = forecasts.withColumn("_last", last).where(
        (F.col("target_date") >= F.add_months("_last", -months)) & F.col("model").isin(list(models))
    )
    vol = [
        F.max(F.when(F.col("model") == m, annualized_volatility_pct("predicted", F.col("sessions_per_year")))).alias(m)
        for m in models
    ]
    realized = F.max(
        F.when(F.col("model") == models[0], annualized_volatility_pct("actual", F.col("sessions_per_year")))
    )
    return recent.groupBy("series", "target_date").agg(realized.alias("realized"), *vol).where("realized is not null")


def hac_table(losses: DataFrame, candidate: str, lags: Sequence[int] | None = None) -> DataFrame:
    """p-values of every baseline over the lag grid, one row per baseline and lag.

    The grid depends on each series' sample size; ``lags`` fixes it and gives one column per lag.
    """
    if lags is None:
        return hac_sensitivity(losses, candidate, "grid").select(*PAIR, "hac_lags", "p_value")
    table = hac_sensitivity(losses, candidate, list(lags))
    return table.groupBy(*PAIR).pivot("hac_lags", list(lags)).agg(F.first("p_value"))


def reverse_tests(losses: DataFrame, candidate: str, other: str) -> DataFrame:
    """Tests that ``other`` is better than ``candidate``, at every lag of the grid."""
    both = losses.where(F.col("model").isin([candidate, other]))
    return diebold_mariano(paired_losses(both, other), lags="grid").select(
        "series", "hac_lags", "statistic", "p_value"
    )


def head_to_head(losses: DataFrame, candidate: str, other: str, best: int = BEST_SESSIONS) -> DataFrame:
    """One challenger against the candidate: mean losses, sessions and months it wins.

    ``best_share`` is null when the challenger has no advantage at all.
    """
    positive_int(best, "best")
    pairs = paired_losses(losses.where(F.col("model").isin([candidate, other])), other)
    month = Window.partitionBy("series", "month")
    ranked = Window.partitionBy("series").orderBy(F.desc("gain"), "target_date")
    marked = pairs.withColumn("month", _month()).withColumns(
        {
            "_month_mean": F.avg("gain").over(month),
            "_in_month": F.row_number().over(month.orderBy("target_date")),
            "_rank": F.row_number().over(ranked),
        }
    )
    once = F.col("_in_month") == 1
    total = F.sum("gain")
    return marked.groupBy("series").agg(
        F.avg("baseline_loss").alias("candidate_mean"),
        F.avg("candidate_loss").alias("other_mean"),
        (F.lit(1.0) - F.try_divide(F.avg("candidate_loss"), F.avg("baseline_loss"))).alias("other_lower_by"),
        (F.count_if(F.col("gain") > 0) / F.count(F.lit(1))).alias("sessions_won"),
        F.count_if(once & (F.col("_month_mean") > 0)).alias("months_won"),
        F.count_if(once).alias("months"),
        F.when(total > 0, F.try_divide(F.sum(F.when(F.col("_rank") <= best, F.col("gain"))), total)).alias("best_share"),
    )


def candidate_verdict(losses: DataFrame, candidate: str, *, reference_model: str = "naive") -> DataFrame:
    """Per series: does the candidate beat every baseline, by how much, how surely.

    ``largest_p`` is over all baselines and the whole lag grid; ``win_rate`` is against
    ``reference_model``.
    """
    tests = scoreboard(losses, candidate, hac_lags="grid").where(F.col("model") != candidate)
    lower_by = F.lit(1.0) - F.try_divide("candidate_mean", "mean_loss")
    against = F.when(F.col("model") == reference_model, F.col("candidate_wins") / F.col("n_obs"))
    return tests.groupBy("series").agg(
        F.bool_and(lower_by > 0).alias("beats_all"),
        F.min(lower_by).alias("min_lower_by"),
        F.max(lower_by).alias("max_lower_by"),
        F.max(against).alias("win_rate"),
        F.max("p_value").alias("largest_p"),
    ).withColumn("below_level", F.col("largest_p") < HAR_LEVEL)


# --- coefficients ---------------------------------------------------------------------------------


def coefficient_table(data: DataFrame, models: Sequence[ModelSpec], before: date) -> DataFrame:
    """Coefficients fitted before a date, one column per model, one row per term."""
    fits = fit_known(data, models, before=[before])
    return fits.groupBy("series", "term").pivot("model", [m.name for m in models]).agg(F.first("coefficient"))


def slope_summary(data: DataFrame, model: ModelSpec, before: date) -> DataFrame:
    """Slope on the first regressor, sum of the others, sum of all, and the intercept."""
    fits = fit_known(data, [model], before=[before])
    slope = F.when(F.col("term") != "intercept", F.col("coefficient"))
    first = F.col("term") == model.regressors[0]
    return fits.groupBy("series", "model").agg(
        F.max(F.when(F.col("term") == "intercept", F.col("coefficient"))).alias("intercept"),
        F.sum(F.when(first, slope)).alias("shortest"),
        F.sum(F.when(~first, slope)).alias("longer"),
        F.sum(slope).alias("total"),
    )


def quarter_starts(start: date, end: date) -> list[date]:
    """First days of the quarters that begin within [start, end]."""
    quarters = [
        date(year, month, 1) for year in range(start.year, end.year + 1) for month in (1, 4, 7, 10)
    ]
    return [day for day in quarters if start <= day <= end]


def quarterly_slopes(
    data: DataFrame, model: ModelSpec, terms: Sequence[str], *, start: date, end: date
) -> DataFrame:
    """Chosen coefficients refitted at each quarter's start, outcomes of that day included."""
    cuts = [day + timedelta(days=1) for day in quarter_starts(start, end)]
    fits = fit_known(data, [model], before=cuts).where(F.col("term").isin(list(terms)))
    return (
        fits.groupBy("series", F.date_sub(F.to_date("before"), 1).alias("refit_at"))
        .pivot("term", list(terms))
        .agg(F.first("coefficient"))
    )


def slope_verdict(slopes: DataFrame, reverse: DataFrame, rising: str, falling: str) -> DataFrame:
    """Per series: which slope is larger at every refit, and at how many lags the test holds."""
    order = slopes.groupBy("series").agg(
        F.bool_and(F.col(rising) > F.col(falling)).alias("_up"),
        F.bool_and(F.col(falling) > F.col(rising)).alias("_down"),
    )
    tests = reverse.groupBy("series").agg(F.min("p_value").alias("min_p"), F.max("p_value").alias("max_p"))
    return order.join(tests, "series").select(
        "series",
        F.when(F.col("_up"), "rising above falling").when(F.col("_down"), "falling above rising")
        .otherwise("changes").alias("slope_order"),
        F.when(F.col("max_p") < SHAR_LEVEL, "every lag").when(F.col("min_p") < SHAR_LEVEL, "some lags")
        .otherwise("no lag").alias("significant_at"),
        "min_p", "max_p",
    )

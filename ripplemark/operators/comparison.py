"""Losses of forecasts, and tests of a candidate model against every other model.

A loss table has one row per series, model and target date. The candidate's loss is put
next to every model's loss of the same date by a window over the date's few models, so no
join is needed; everything that compares two models is then one aggregation per series and
baseline.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemark.checks import (
    DataError,
    enforce,
    finite_number,
    non_negative_int,
    require_columns,
)
from ripplemark.functions.losses import Loss
from ripplemark.functions.numeric import is_finite, with_normal_sf
from ripplemark.operators.smearing import CASE_COLUMNS, enforce_forecasts, with_series

# Fixed value: spacing of double precision numbers at 1.
EPSILON = 2.220446049250313e-16

# How close two losses must be to count as a tie.
TIE_RTOL = 1e-5
TIE_ATOL = 0.0

#: Multiples of the default lag count that a sensitivity grid adds.
GRID_MULTIPLES = (2, 4, 6)


# --- losses -----------------------------------------------------------------------------------


def _bad_loss() -> Column:
    return ~is_finite("loss") | (F.col("loss") < 0)


def loss_violations(losses: DataFrame) -> DataFrame:
    """Per series and model, the losses, and those that are not a finite number of zero or more."""
    return losses.groupBy("series", "model").agg(
        F.count(F.lit(1)).alias("losses"), F.count_if(F.coalesce(_bad_loss(), F.lit(True))).alias("invalid")
    )


def forecast_losses(forecasts: DataFrame, loss: Loss, *, check: bool = False) -> DataFrame:
    """One row per forecast with its ``loss``."""
    frame = with_series(forecasts)
    require_columns(frame, [*CASE_COLUMNS, "actual", "predicted"], "forecast")
    result = frame.select(
        *CASE_COLUMNS, "actual", "predicted",
        loss(F.col("actual"), F.col("predicted")).cast("double").alias("loss"),
    )
    if check:
        enforce_forecasts(frame)
        enforce_aligned(frame)
        enforce(
            result,
            {"loss is not a finite non-negative number": _bad_loss()},
            "losses",
        )
    return result


def uneven_cases(forecasts: DataFrame) -> DataFrame:
    """Cases (origin, target date, actual value) that not every model of the series has."""
    of_series = F.size(F.collect_set("model").over(Window.partitionBy("series")))
    return (
        forecasts.withColumn("_all", of_series.cast("bigint"))
        .groupBy("series", "origin_date", "target_date", "actual")
        .agg(F.size(F.collect_set("model")).cast("bigint").alias("models"), F.max("_all").alias("all_models"))
        .where(F.col("models") != F.col("all_models"))
    )


def enforce_aligned(forecasts: DataFrame) -> None:
    """Within a series, all models have the same origins, targets and actual values."""
    if not uneven_cases(forecasts).limit(1).isEmpty():
        raise DataError("all models of a series must have identical dates and actual values")


def loss_matrix(losses: DataFrame, models: Sequence[str]) -> DataFrame:
    """Losses with one column per model, one row per series and target date."""
    return losses.groupBy("series", "target_date").pivot("model", list(models)).agg(F.first("loss"))


def paired_losses(
    losses: DataFrame, candidate: str, *, keep_candidate: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """Every baseline's loss beside the candidate's of the same series and date.

    ``carry`` names further columns to keep.

    Columns ``series, target_date, baseline_model, baseline_loss, candidate_loss, gain``,
    where gain is the baseline's loss less the candidate's.
    """
    require_columns(losses, ["series", "model", "target_date", "loss"], "losses")
    date = Window.partitionBy("series", "target_date")
    proposed = F.max(F.when(F.col("model") == candidate, F.col("loss"))).over(date)
    pairs = losses.select("series", "target_date", "model", "loss", *carry).withColumn("candidate_loss", proposed)
    rule = F.col("candidate_loss").isNotNull()
    if not keep_candidate:
        rule = rule & (F.col("model") != candidate)
    return pairs.where(rule).select(
        "series", "target_date",
        F.col("model").alias("baseline_model"),
        F.col("loss").alias("baseline_loss"),
        "candidate_loss",
        (F.col("loss") - F.col("candidate_loss")).alias("gain"),
        *carry,
    )


# --- the Diebold-Mariano test -------------------------------------------------------------------


def default_hac_lags(n: Column) -> Column:
    """floor(4 (n/100)^(2/9)), at most n - 2."""
    rule = F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0)))
    return F.least(rule, n - 2).cast("int")


def hac_lag_grid(n: Column, multiples: Sequence[int] = GRID_MULTIPLES) -> Column:
    """Lags 0 to the default and then multiples of it, at most n - 2, in order."""
    usual = default_hac_lags(n)
    more = F.array(*[usual * F.lit(int(m)) for m in multiples]) if multiples else F.array().cast("array<int>")
    lags = F.array_distinct(F.concat(F.sequence(F.lit(0), usual), more))
    return F.array_sort(F.filter(lags, lambda lag: lag <= n - 2))


def _lag_choice(lags: str | int | Sequence[int] | None, n: Column) -> Column:
    if lags is None or lags == "default":
        return F.array(default_hac_lags(n))
    if lags == "to_default":
        return F.sequence(F.lit(0), default_hac_lags(n))
    if lags == "grid":
        return hac_lag_grid(n)
    chosen = [lags] if isinstance(lags, int) else list(lags)
    if not chosen or len(set(chosen)) != len(chosen):
        raise ValueError("lags must be non-empty and unique")
    for lag in chosen:
        non_negative_int(lag, "lag")
    return F.array(*[F.lit(lag) for lag in chosen])


def _zero() -> Column:
    return F.lit(0.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _autocovariances(centred: pd.Series, longest: pd.Series) -> pd.Series:
    """Sums of products at lags 0 to the longest, over the number of values."""
    return pd.Series([
        np.array([c[h:] @ c[: len(c) - h] for h in range(most + 1)]) / len(c) for c, most in zip(centred, longest, strict=True)])


def diebold_mariano(
    pairs: DataFrame,
    *,
    keys: Sequence[str] = ("series", "baseline_model"),
    lags: str | int | Sequence[int] | None = None,
    order: str = "target_date",
    gain: str = "gain",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One-sided Diebold-Mariano tests of the gains of each key being positive on average.

    The variance of the mean is the Bartlett (Newey-West) estimate. ``lags`` is the number of
    lags, a list of them, ``"default"``, ``"to_default"`` (0 up to the default) or ``"grid"``;
    each gives a row: keys, ``n_obs, hac_lags, mean_gain, statistic, p_value`` and ``extra``
    aggregates. Autocovariances are computed once per key for the largest lag and weighted for
    each. The test is null where it has under three dates or the lag is above n - 2.

    A key is one pair of models of one series and has one gain per date, so its array of
    gains is bounded by the calendar.
    """
    require_columns(pairs, [*keys, order, gain], "pairs")
    dated = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(gain).alias("g"))))
    grouped = pairs.groupBy(*keys).agg(
        F.count(gain).alias("n_obs"),
        F.avg(gain).alias("mean_gain"),
        F.avg(F.col(gain) * F.col(gain)).alias("_square"),
        F.transform(dated, lambda point: point["g"]).alias("_gains"),
        *extra,
    )
    n = F.col("n_obs")
    enough = n >= 3
    with_lags = grouped.withColumn(
        "_lags", F.when(enough, _lag_choice(lags, n)).otherwise(F.array(F.lit(None).cast("int")))
    ).withColumn("_c", F.transform("_gains", lambda g: g - F.col("mean_gain")))
    longest = F.least(F.coalesce(F.array_max("_lags"), F.lit(0)), F.greatest(n - 2, F.lit(0))).cast("int")

    tests = (
        with_lags.withColumn("_gamma", _autocovariances("_c", longest))
        .drop("_gains", "_c")
        .withColumn("hac_lags", F.explode("_lags"))
        .drop("_lags")
    )
    lag = F.col("hac_lags")
    usable = enough & lag.isNotNull() & (lag <= n - 2)
    weighted = F.transform(
        F.slice("_gamma", F.lit(2), F.when(usable, lag).otherwise(F.lit(0))),
        lambda g, i: (F.lit(1.0) - (i + 1) / (lag + F.lit(1.0))) * g,
    )
    variance = F.greatest(
        F.element_at("_gamma", 1) + 2.0 * F.aggregate(weighted, _zero(), lambda total, x: total + x),
        _zero(),
    )
    tests = tests.withColumn("_variance", F.when(usable, variance)).withColumn(
        "_tolerance", F.lit(EPSILON) * F.col("_square")
    )
    mean = F.col("mean_gain")
    flat = F.col("_variance") <= F.col("_tolerance")
    tests = tests.withColumn(
        "statistic",
        F.when(F.col("_variance").isNull(), F.lit(None).cast("double"))
        .when(flat & (F.abs(mean) <= F.sqrt("_tolerance")), _zero())
        .when(flat & (mean > 0), F.lit(float("inf")))
        .when(flat, F.lit(float("-inf")))
        .otherwise(mean / F.sqrt(F.col("_variance") / n)),
    )
    return with_normal_sf(tests.drop("_gamma", "_variance", "_tolerance", "_square"), "statistic", "p_value")


def untestable_pairs(losses: DataFrame, candidate: str, *, lags: int | Sequence[int] | None = None) -> DataFrame:
    """Per series and baseline, what keeps :func:`diebold_mariano` from testing it against the candidate.

    Columns ``series, baseline_model, n_obs`` (dates of both models), ``only_baseline, only_candidate`` (dates the other one
    lacks), ``not_finite`` (losses of either on common dates), ``too_few`` (under three dates) and ``lags_too_long`` (how
    many of the given lags are above n - 2). One row for each model but the candidate, faults or not.
    """
    require_columns(losses, ["series", "model", "target_date", "loss"], "losses")
    chosen = [] if lags is None else [lags] if isinstance(lags, int) else list(lags)
    for lag in chosen:
        non_negative_int(lag, "lag")
    date, series = Window.partitionBy("series", "target_date"), Window.partitionBy("series")
    own = F.col("model") == candidate
    proposed = losses.select("series", "target_date", "model", "loss").withColumns({
        "_there": F.count_if(own).over(date) > 0, "_theirs": F.max(F.when(own, F.col("loss"))).over(date)})
    proposed = proposed.withColumn("_all", F.count_if(own).over(series))
    bad = ~is_finite("loss") | ~is_finite("_theirs")
    counts = proposed.where(~own).groupBy("series", F.col("model").alias("baseline_model")).agg(
        F.count_if("_there").alias("n_obs"),
        F.count_if(~F.col("_there")).alias("only_baseline"),
        (F.first("_all") - F.count_if("_there")).alias("only_candidate"),
        F.count_if(F.col("_there") & bad).alias("not_finite"))
    too_long = [F.when(F.lit(lag) > F.col("n_obs") - 2, 1).otherwise(0) for lag in chosen]
    return counts.withColumns({"too_few": F.col("n_obs") < 3, "lags_too_long": sum(too_long, F.lit(0)).cast("bigint")})


def hac_sensitivity(
    losses: DataFrame, candidate: str, lags: str | Sequence[int] = "to_default"
) -> DataFrame:
    """The test of the candidate against every baseline at each lag."""
    tests = diebold_mariano(paired_losses(losses, candidate), lags=lags)
    return tests.select(
        "series", "baseline_model", F.lit(candidate).alias("candidate_model"),
        "hac_lags", "statistic", "p_value",
    )


# --- the scoreboard -----------------------------------------------------------------------------


def _is_tie(rtol: float, atol: float) -> Column:
    gap = F.abs(F.col("candidate_loss") - F.col("baseline_loss"))
    return gap <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("baseline_loss"))


def scoreboard(
    losses: DataFrame,
    candidate: str,
    *,
    hac_lags: str | int | Sequence[int] | None = None,
    tie_rtol: float = TIE_RTOL,
    tie_atol: float = TIE_ATOL,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every model against the candidate in one aggregation, the candidate's own row included.

    Columns ``series, model, n_obs, mean_loss, candidate_mean, dm_statistic, p_value,
    candidate_wins, ties``; test and wins are null in the candidate's row. ``carry`` names
    columns that are the same in all rows of a series, and are kept. Where ``hac_lags`` gives
    several lags, each has a row.
    """
    for name, value in (("tie_rtol", tie_rtol), ("tie_atol", tie_atol)):
        finite_number(value, name, minimum=0.0)
    tie = _is_tie(tie_rtol, tie_atol)
    pairs = paired_losses(losses, candidate, keep_candidate=True, carry=carry)
    tests = diebold_mariano(
        pairs,
        lags=hac_lags,
        extra=[
            F.avg("baseline_loss").alias("mean_loss"),
            F.avg("candidate_loss").alias("candidate_mean"),
            F.count_if((F.col("candidate_loss") < F.col("baseline_loss")) & ~tie).alias("_wins"),
            F.count_if(tie).alias("_ties"),
            *[F.max(name).alias(name) for name in carry],
        ],
    )
    other = F.col("baseline_model") != candidate
    return tests.select(
        "series",
        F.col("baseline_model").alias("model"),
        "n_obs", "mean_loss", "candidate_mean",
        F.when(other, F.col("statistic")).alias("dm_statistic"),
        F.when(other, F.col("p_value")).alias("p_value"),
        F.when(other, F.col("_wins")).alias("candidate_wins"),
        F.when(other, F.col("_ties")).alias("ties"),
        *carry,
    )


def enforce_comparable(losses: DataFrame, candidate: str) -> None:
    """The candidate and at least one other model must have losses, in every series."""
    sides = losses.groupBy("series").agg(
        F.count_if(F.col("model") == candidate).alias("own"), F.count_if(F.col("model") != candidate).alias("others")
    )
    row = sides.where("own = 0 OR others = 0").orderBy("series").first()
    if row is not None or sides.isEmpty():
        where = "" if row is None else f" in series {row['series']!r}"
        what = f"model to compare with {candidate!r}" if row is not None and row["own"] else f"candidate {candidate!r}"
        raise DataError(f"no {what}{where}")


def compare_models(
    losses: DataFrame, candidate: str, *, hac_lags: int | None = None, check: bool = False
) -> DataFrame:
    """Mean loss of every model, and the test of the candidate against it."""
    if check:
        enforce_comparable(losses, candidate)
    board = scoreboard(losses, candidate, hac_lags=hac_lags)
    return board.select("series", "model", "n_obs", "mean_loss", "dm_statistic", "p_value")


def win_rates(
    losses: DataFrame, candidate: str, *, tie_rtol: float = TIE_RTOL, tie_atol: float = TIE_ATOL, check: bool = False
) -> DataFrame:
    """On how many dates the candidate's loss is strictly lower, per baseline; ties apart."""
    if check:
        enforce_comparable(losses, candidate)
    for name, value in (("tie_rtol", tie_rtol), ("tie_atol", tie_atol)):
        finite_number(value, name, minimum=0.0)
    tie = _is_tie(tie_rtol, tie_atol)
    return (
        paired_losses(losses, candidate)
        .groupBy("series", "baseline_model")
        .agg(
            F.count(F.lit(1)).alias("n_obs"),
            F.count_if((F.col("candidate_loss") < F.col("baseline_loss")) & ~tie).alias("candidate_wins"),
            F.count_if(tie).alias("ties"),
        )
        .withColumn("candidate_model", F.lit(candidate))
        .withColumn("candidate_win_rate", F.col("candidate_wins") / F.col("n_obs"))
        .select("series", "baseline_model", "candidate_model", "n_obs", "candidate_wins", "ties", "candidate_win_rate")
    )


def results_table(losses: DataFrame, candidate: str) -> DataFrame:
    """One row per series and model, best first: mean loss, the candidate's advantage
    ``lower_by``, the test's p-value, and the candidate's win rate."""
    board = scoreboard(losses, candidate)
    table = board.select(
        "series", "model", "n_obs", "mean_loss",
        (F.lit(1.0) - F.try_divide("candidate_mean", "mean_loss")).alias("lower_by"),
        "p_value",
        (F.col("candidate_wins") / F.col("n_obs")).alias("candidate_win_rate"),
    )
    # Sorting samples its input first: the few finished rows are exchanged before it, so that
    # the tests behind them are computed once.
    return table.repartition("series").orderBy("series", "mean_loss", "model")

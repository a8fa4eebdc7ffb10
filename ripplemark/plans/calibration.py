"""Choosing a ridge penalty before the evaluation starts, and judging the choice."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.checks import finite_number
from ripplemark.operators.comparison import forecast_losses, scoreboard
from ripplemark.operators.features import Means
from ripplemark.operators.forecasts import walk_forward_models
from ripplemark.operators.models import ModelSpec, regression
from ripplemark.operators.smearing import smeared_forecasts
from ripplemark.plans.study import RIDGE_GRID, Plan, log_forecasts, ridge_model

_NAME = "ridge@"


def _penalty_models(features: Means, penalties: Sequence[float]) -> list[ModelSpec]:
    if not penalties or len(set(penalties)) != len(penalties):
        raise ValueError("penalties must be non-empty and unique")
    for penalty in penalties:
        finite_number(penalty, "penalty", minimum=0.0)
    return [ridge_model(features, penalty, f"{_NAME}{penalty!r}") for penalty in penalties]


def penalty_forecasts(
    data: DataFrame, features: Means, penalties: Sequence[float], *,
    min_train_size: int, start: date | None, end: date | None,
) -> DataFrame:
    """Walk-forward forecasts at every penalty, from one pass of running sums."""
    models = _penalty_models(features, penalties)
    return walk_forward_models(data, models, min_train_size=min_train_size, start=start, end=end)


def _scores(losses: DataFrame, column: str) -> DataFrame:
    return losses.groupBy("series", "model").agg(F.avg("loss").alias(column)).select(
        "series", F.substring_index("model", "@", -1).cast("double").alias("penalty"), column
    )


def calibration(
    data: DataFrame, features: Means, design: Plan,
    penalties: Sequence[float] = RIDGE_GRID,
) -> DataFrame:
    """Mean loss of each penalty on the targets before the evaluation starts."""
    tried = penalty_forecasts(
        data, features, penalties, min_train_size=design.least_known,
        start=design.first, end=design.scored_from - timedelta(days=1),
    )
    return _scores(forecast_losses(smeared_forecasts(tried), design.loss), "calibration_loss")


def hindsight(
    data: DataFrame, features: Means, design: Plan,
    penalties: Sequence[float] = RIDGE_GRID,
) -> DataFrame:
    """Mean loss of each penalty on the evaluation period: describes, chooses nothing."""
    tried = penalty_forecasts(
        data, features, penalties, min_train_size=design.least_known,
        start=design.first, end=design.last,
    )
    scored = smeared_forecasts(tried).where(F.col("target_date") >= F.lit(design.scored_from))
    return _scores(forecast_losses(scored, design.loss), "evaluation_loss")


def best_penalty(scores: DataFrame, column: str = "calibration_loss") -> DataFrame:
    """The penalty of each series with the lowest score (the smaller one if tied)."""
    return scores.groupBy("series").agg(
        F.min_by("penalty", F.struct(column, "penalty")).alias("penalty"),
        F.min(column).alias(column),
        F.min("penalty").alias("_low"),
        F.max("penalty").alias("_high"),
    ).select(
        "series", "penalty", column,
        ((F.col("penalty") == F.col("_low")) | (F.col("penalty") == F.col("_high"))).alias("at_grid_edge"),
    )


def uses_no_evaluation_data(
    data: DataFrame, features: Means, design: Plan,
    penalties: Sequence[float] = RIDGE_GRID,
) -> DataFrame:
    """Penalties whose score changes when the evaluation data is removed: none, if all is well."""
    known = data.where(F.col("target_date") < F.lit(design.scored_from))
    both = calibration(data, features, design, penalties).join(
        calibration(known, features, design, penalties).withColumnRenamed("calibration_loss", "known_loss"),
        ["series", "penalty"], "full_outer",
    )
    same = F.abs(F.col("calibration_loss") - F.col("known_loss")) <= 1e-12 * F.abs("known_loss")
    return both.where(~F.coalesce(same, F.lit(False)))


def tuned_losses(
    data: DataFrame, features: Means, design: Plan,
    penalties: Sequence[float] = RIDGE_GRID, *, name: str = "HAR-ridge",
) -> DataFrame:
    """Evaluation losses of the candidate and of the ridge model at each series' own penalty.

    The candidate and every penalty are forecast in one pass and smeared, each by its own past
    errors, before the choice is made; the choice reads only losses of targets before the
    evaluation starts. Adds ``penalty``, ``calibration_loss`` and ``at_grid_edge``.
    """
    grid = _penalty_models(features, penalties)
    candidate = regression(design.candidate, [*features.names.values()])
    losses = forecast_losses(smeared_forecasts(log_forecasts(data, [candidate, *grid], design)), design.loss)
    early = F.when(F.col("target_date") < F.lit(design.scored_from), F.col("loss"))
    tried = F.when(F.col("model") != design.candidate, F.substring_index("model", "@", -1).cast("double"))
    scored = losses.withColumns(
        {"_tried": tried, "_score": F.avg(early).over(Window.partitionBy("series", "model"))}
    )
    best = F.min(F.when(F.col("_tried").isNotNull(), F.struct("_score", "_tried")))
    chosen = scored.withColumn("_best", best.over(Window.partitionBy("series"))).where(
        (F.col("_tried").isNull() | (F.col("_tried") == F.col("_best._tried")))
        & (F.col("target_date") >= F.lit(design.scored_from))
    )
    penalty = F.col("_best._tried")
    return chosen.select(
        F.when(F.col("_tried").isNull(), F.lit(design.candidate)).otherwise(F.lit(name)).alias("model"),
        *[c for c in losses.columns if c != "model"],
        penalty.alias("penalty"),
        F.col("_best._score").alias("calibration_loss"),
        penalty.isin(min(penalties), max(penalties)).alias("at_grid_edge"),
    )


def ridge_verdict(tuned: DataFrame, candidate: str, *, name: str = "HAR-ridge") -> DataFrame:
    """Per series: chosen penalty, whether it lies at the grid's edge, and how it fared."""
    row = scoreboard(tuned, candidate, carry=["penalty", "at_grid_edge"]).where(F.col("model") == name)
    lower_by = F.lit(1.0) - F.try_divide("candidate_mean", "mean_loss")
    return row.select(
        "series", "penalty", "at_grid_edge",
        F.when(lower_by > 0, "loses to").otherwise("beats").alias("outcome"),
        F.abs(lower_by).alias("difference"),
        "p_value",
    )

"""Walk-forward forecasts: every origin uses only the outcomes observed by then.

Refitting at each origin would cost a pass over the past per forecast. A regression only
needs sums of products of its columns, so running sums over one timeline give the fits of
all origins, all regressions and all penalties at once. The timeline of a series is cut into
blocks of time: blocks are summed up on their own, their sums are chained in order, and each
block continues from the chain, so work is spread over series and blocks, and no task or
Python worker holds more than a block. What is left per forecast is one small linear solve,
done in batches. Models that need no solve (the mean of past targets, the last target) never
leave the JVM when run alone.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Sequence
from datetime import date, datetime
from itertools import combinations_with_replacement
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemark.checks import (
    DataError,
    enforce,
    enforce_unique,
    positive_int,
    require_columns,
    violations,
)
from ripplemark.functions.numeric import is_finite
from ripplemark.functions.sessions import DAY_MICROS
from ripplemark.operators.blocks import Moments, Running, damped_fit, runs, smoothed
from ripplemark.operators.features import ORIGIN, SERIES
from ripplemark.operators.models import ModelSpec
from ripplemark.operators.timeline import EVENT, QUERY_AFTER, running, self_timeline

FORECAST_COLUMNS = (
    "model", "series", "origin_date", "target_date", "actual", "predicted", "n_train",
)

#: Fits whose regressors are this close to collinear (smallest eigenvalue of their correlations), or whose spread
#: is this small against their distance from the mean before the block, are repeated on the block's rows and what the
#: blocks before it come to: sums of products have lost too many digits there.
COLLINEAR = 1e-7
CANCELLED = 1e-4

#: Length of a block: days where dates are days, microseconds where they are times.
BLOCK_DAYS, BLOCK_MICROS = 1024, DAY_MICROS

#: Kind of the row that brings a block's state, before all others.
_BEGIN = -2

#: Rows solved together.
SOLVE_BATCH = 8192


# --- dates as plain numbers while rows are in Python ---------------------------------------


def _to_number(name: str, kind: T.DataType) -> Column:
    return F.unix_date(name) if isinstance(kind, T.DateType) else F.unix_micros(F.col(name).cast("timestamp"))


def _from_number(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.col(name).cast("int"))
    return F.timestamp_micros(F.col(name)).cast(kind)


# --- the small solves -----------------------------------------------------------------------


def _pooled_fit(
    n: np.ndarray, mean: np.ndarray, spread: np.ndarray, penalty: float
) -> tuple[float, np.ndarray]:
    """The same from moments of parts of the rows; the last column is the target."""
    total = n.sum()
    middle = n @ mean / total
    apart = mean - middle
    products = spread.sum(axis=0) + (n[:, None] * apart).T @ apart
    width = len(middle) - 1
    if total <= width:
        raise DataError(f"{width} slopes and an intercept need more observations than {int(total)}")
    size = np.sqrt(np.diag(products)[:width])
    size = np.where(size > 0, size, 1.0)
    inner = products[:width, :width] / np.outer(size, size)
    values, directions = np.linalg.eigh(inner + np.diag(penalty / size**2))
    told = values > 1e-13 * max(values.max(initial=0.0), 1e-300)
    along = directions.T @ (products[:width, width] / size)
    slopes = directions @ np.divide(along, values, out=np.zeros_like(along), where=told) / size
    return float(middle[width] - middle[:width] @ slopes), slopes


def _solve(
    n: np.ndarray, cov_xx: np.ndarray, cov_xy: np.ndarray, plain: np.ndarray, ridge: float
) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of many fits from their centered sums, and which of them must be repeated.

    ``plain`` are the squares before centering.
    """
    width = cov_xx.shape[1]
    if (n <= width).any():
        raise DataError(f"{width} slopes and an intercept need more observations than {int(n.min())}")
    squares = np.clip(np.einsum("nii->ni", cov_xx), 0.0, None)
    weak = ((squares <= CANCELLED * plain) | (squares == 0)).any(axis=1)
    safe = np.where(squares > 0, np.sqrt(squares), 1.0)
    correlation = cov_xx / safe[:, :, None] / safe[:, None, :]
    if ridge > 0:
        # damping is on the columns as they are, so it differs by column once these are scaled
        correlation[:, range(width), range(width)] += ridge / safe**2
    correlation[weak] = np.identity(width)
    if ridge == 0:
        weak |= np.linalg.eigvalsh(correlation)[:, 0] < COLLINEAR
        correlation[weak] = np.identity(width)
    return np.linalg.solve(correlation, (cov_xy / safe)[..., None])[..., 0] / safe, weak


def _pair_names(width: int) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(width), 2))


_STATE = "series string, _block bigint, _state array<double>"
_FORECASTS = pa.schema([
    ("model", pa.string()), ("series", pa.string()), ("_origin", pa.int64()), ("_target", pa.int64()),
    ("actual", pa.float64()), ("predicted", pa.float64()), ("n_train", pa.int64())])


def _observed(rows: pd.DataFrame, width: int) -> np.ndarray:
    """Regressors and target of the outcomes among a block's rows, in order."""
    events = rows[rows["_kind"] == EVENT]
    return events[[*(f"x{i}" for i in range(width)), "y"]].to_numpy("float64")


def _summaries(width: int, decays: Sequence[float]):
    """Per block: its moments, its first outcome, and what smoothing makes of its outcomes alone."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["series", "_block"]):
            seen = _observed(rows, width)
            y = seen[:, width]
            ends = [float(smoothed(y, d, None)[-1]) if len(y) else 0.0 for d in decays]
            state = [*Moments.of(seen).packed(), float(y[0]) if len(y) else 0.0, *ends]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows["series"].iloc[0]], pa.string()), pa.array([rows["_block"].iloc[0]], pa.int64()),
                 pa.array([state], pa.list_(pa.float64()))], names=["series", "_block", "_state"])

    return summarize


def _chain(width: int, decays: Sequence[float]):
    """Per block: the moments of all blocks of its series before it, and the smoothed values at their end."""
    size = 1 + (width + 1) + (width + 1) ** 2

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, held, values = None, Moments.none(width + 1), [0.0] * len(decays)
        for batch in batches:
            states = []
            for name, state in zip(batch.column("series").to_pylist(), batch.column("_state").to_pylist(), strict=True):
                if name != series:
                    series, held, values = name, Moments.none(width + 1), [0.0] * len(decays)
                states.append([*held.packed(), *values])
                own = Moments.unpacked(state[:size], width + 1)
                if own.n:
                    first, ends = state[size], state[size + 1 :]
                    values = [end + (d ** own.n) * (value - first) if held.n else end
                              for d, end, value in zip(decays, ends, values, strict=True)]
                held = held.merged(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("series"), batch.column("_block"), pa.array(states, pa.list_(pa.float64()))],
                names=["series", "_block", "_state"])

    return chain


def _block_forecasts(models: Sequence[ModelSpec], columns: Sequence[str], decays: Sequence[float], min_train: int):
    """Forecasts of each block from its rows and the state before it, which comes as its first row."""
    width = len(columns)
    position = {name: i for i, name in enumerate(columns)}
    size = 1 + (width + 1) + (width + 1) ** 2

    def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["series", "_block"]):
            state = np.asarray(rows["_state"].iloc[0], dtype="float64")
            rows = rows.iloc[1:]
            kind = rows["_kind"].to_numpy()
            place = np.cumsum(kind == EVENT)
            before = Moments.unpacked(state[:size], width + 1)
            asked = (kind != EVENT) & (before.n + place >= min_train) & rows["_selected"].to_numpy(bool)
            if not asked.any():
                continue
            queries, place = rows[asked], place[asked]
            running = Running(before, _observed(rows, width))
            x_now = queries[[f"x{i}" for i in range(width)]].to_numpy("float64")
            for model in models:
                if model.kind == "smoothing":
                    value = float(state[size + decays.index(model.weight)]) if before.n else None
                    predicted = smoothed(running.rows[:, width], model.weight, value)[place]
                elif not model.regressors:
                    predicted = running.shift[width] + running.at(place)[1][:, width]
                else:
                    chosen = [position[name] for name in model.regressors]
                    predicted = np.concatenate([
                        regress(running, place[k : k + SOLVE_BATCH], x_now[k : k + SOLVE_BATCH], chosen, model.weight)
                        for k in range(0, len(place), SOLVE_BATCH)])
                if not np.isfinite(predicted).all():
                    raise DataError(f"{model.name} returned a non-finite prediction")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([model.name] * len(place), pa.string()), pa.array(queries["series"], pa.string()),
                     *(pa.array(queries[c].to_numpy("int64")) for c in ("_origin", "_target")),
                     pa.array(queries["y"].to_numpy("float64")), pa.array(predicted, pa.float64()),
                     pa.array(running.n[place], pa.int64())], schema=_FORECASTS)

    def regress(running: Running, place, x_now, chosen, ridge):
        n, mean, products, plain = running.at(place)
        inner = products[:, chosen][:, :, chosen]
        squares = np.einsum("nii->ni", plain)[:, chosen]
        slopes, weak = _solve(n, inner, products[:, chosen, width], squares, ridge)
        predicted = running.shift[width] + mean[:, width] + ((x_now[:, chosen] - running.shift[chosen] - mean[:, chosen]) * slopes).sum(axis=1)
        used = [*chosen, width]
        past = Moments(running.before.n, running.before.mean[used], running.before.factor[:, used])
        for row in np.flatnonzero(weak):
            intercept, b = damped_fit(*past.stacked(running.rows[: place[row], used]), ridge)
            predicted[row] = intercept + float(x_now[row, chosen] @ b)
        return predicted

    return forecast


def _custom_group(rules: dict, columns: Sequence[str], min_train: int):
    """Forecasts of one series by one rule of the user's own, refitted at every origin, or updated if it can be."""

    def forecast(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        series, name = key
        model = rules[name]
        rows = rows.sort_values("_origin", kind="stable")
        origins, targets = rows["_origin"].to_numpy("int64"), rows["_target"].to_numpy("int64")
        x = rows[[f"x{columns.index(c)}" for c in model.regressors]].to_numpy("float64")
        y = rows["y"].to_numpy("float64")
        known = np.searchsorted(targets, origins, side="right")
        asked = np.flatnonzero((known >= min_train) & rows["_selected"].to_numpy(bool))
        predicted = np.empty(len(asked))
        learning, seen = hasattr(model.rule, "update"), 0
        for out, at in enumerate(asked):
            if learning and seen:  # what is known never gets less, so only what is new has to be learnt
                if known[at] > seen:
                    fitted = fitted.update(x[seen : known[at]].copy(), y[seen : known[at]].copy())
            else:
                rule = copy.deepcopy(model.rule) if learning else model.rule
                fitted = rule.fit(x[: known[at]].copy(), y[: known[at]].copy())
            seen = known[at]
            predicted[out] = float(np.asarray(fitted.predict(x[at : at + 1].copy()))[0])
        if not np.isfinite(predicted).all():
            raise DataError(f"{name} returned a non-finite prediction")
        return pd.DataFrame(
            {
                "model": name, "series": series, "_origin": origins[asked], "_target": targets[asked],
                "actual": y[asked], "predicted": predicted, "n_train": known[asked],
            }
        )

    return forecast


# --- the operators ---------------------------------------------------------------------------

_FORECAST_SCHEMA = (
    "model string, series string, _origin bigint, _target bigint, "
    "actual double, predicted double, n_train bigint"
)


def walk_forward_rules(columns: Sequence[str]) -> dict[str, Column]:
    """What makes a row of a forecasting table unusable (``_before`` is the previous target date)."""
    not_finite = ~is_finite("target")
    for column in columns:
        not_finite = not_finite | ~is_finite(column)
    return {
        "missing series, origin or target date": F.col(SERIES).isNull()
        | F.col(ORIGIN).isNull() | F.col("target_date").isNull(),
        "origin is not before its target date": F.col(ORIGIN) >= F.col("target_date"),
        "target dates go back": F.coalesce(F.col("_before") > F.col("target_date"), F.lit(False)),
        "a feature or target is not finite": not_finite,
    }


def _with_previous_target(data: DataFrame) -> DataFrame:
    before = F.lag("target_date").over(Window.partitionBy(SERIES).orderBy(ORIGIN))
    return data.withColumn("_before", before)


def walk_forward_violations(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per series, how many rows break each rule, and how many repeat an origin."""
    place = F.row_number().over(Window.partitionBy(SERIES, ORIGIN).orderBy("target_date"))
    rules = {**walk_forward_rules(columns), "repeated origin": F.col("_copy") > 1}
    return violations(_with_previous_target(data).withColumn("_copy", place), rules, [SERIES])


def enforce_walk_forward_inputs(data: DataFrame, columns: Sequence[str]) -> None:
    """Run the data rules of :func:`walk_forward` now."""
    enforce(_with_previous_target(data), walk_forward_rules(columns), "forecasting table")
    enforce_unique(data, [SERIES, ORIGIN], "forecasting table")


def _in_range(start: date | None, end: date | None) -> Column:
    rule = F.lit(True)
    if start is not None:
        rule = rule & (F.to_date("target_date") >= F.lit(start))
    if end is not None:
        rule = rule & (F.to_date("target_date") <= F.lit(end))
    return rule


def _default_block(kind: T.DataType) -> Callable[[Column], Column]:
    length = BLOCK_DAYS if isinstance(kind, T.DateType) else BLOCK_MICROS
    return lambda at: F.floor(at / length)


def _is_closed(model: ModelSpec) -> bool:
    """Whether the model is a running aggregate, with nothing to solve."""
    return model.kind == "regression" and not model.regressors or model.kind == "smoothing" and model.weight == 0


def walk_forward_models(
    data: DataFrame,
    models: Sequence[ModelSpec],
    *,
    min_train_size: int,
    start: date | None = None,
    end: date | None = None,
    check: bool = False,
    block: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Forecast each target of each series by every model, fitted on what was known then.

    ``data`` has ``series, origin_date, target_date, target`` and the regressors. A fit uses
    the rows whose target date is on or before the origin; origins with fewer than
    ``min_train_size`` of them are skipped. ``start`` and ``end`` choose target dates, both
    included, and change no forecast: rows outside them still train.

    A series is worked on in blocks of time: 1,024 days, or one day where dates are times. ``block``, a function of the
    time (days, or microseconds, since 1970) that never decreases, cuts it otherwise; the results are the same to the
    last digits. A task holds one block.
    """
    if not models:
        raise ValueError("at least one model is required")
    names = [model.name for model in models]
    if len(set(names)) != len(names):
        raise ValueError("model names must be unique")
    positive_int(min_train_size, "min_train_size")
    columns = list(dict.fromkeys(c for m in models for c in m.regressors))
    require_columns(data, [SERIES, ORIGIN, "target_date", "target", *columns], "data")
    if check:
        enforce_walk_forward_inputs(data, columns)

    kind = data.schema["target_date"].dataType
    rows = data.select(
        SERIES,
        _to_number(ORIGIN, data.schema[ORIGIN].dataType).cast("bigint").alias("_origin"),
        _to_number("target_date", kind).cast("bigint").alias("_target"),
        F.col("target").cast("double").alias("y"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
        _in_range(start, end).alias("_selected"),
    )
    closed = [m for m in models if _is_closed(m)]
    custom = [m for m in models if m.kind == "own"]
    solved = [m for m in models if m not in closed and m not in custom]

    parts = []
    if closed or solved:
        line = self_timeline(rows, event_at="_target", query_at="_origin")
        # Queries add nothing to the sums, so the ones not asked for can go before the window.
        line = line.where(F.col("_selected") | (F.col("_kind") == EVENT))
        # Where some models are solved, the others ride along: the timeline is walked once.
        if solved:
            together = [m for m in models if m in closed or m in solved]
            cut = block or _default_block(kind)
            parts.append(_solved_forecasts(line.withColumn("_block", cut(F.col("_at")).cast("bigint")), together, columns, min_train_size))
        else:
            window = running([SERIES], "_origin")
            known = line.withColumn("_n", F.sum(F.when(F.col("_kind") == EVENT, 1).otherwise(0)).over(window))
            parts.append(_closed_forecasts(known, closed, window, min_train_size))
    if custom:
        # Refits cost time, not bytes: a fixed number of partitions keeps adaptive execution
        # from merging the small groups into a few tasks.
        tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = rows.select("*", F.explode(F.array(*[F.lit(m.name) for m in custom])).alias("model")).repartition(
            tasks, SERIES, "model"
        )
        run = _custom_group({m.name: m for m in custom}, columns, min_train_size)
        parts.append(spread.groupBy(SERIES, "model").applyInPandas(run, _FORECAST_SCHEMA))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.select(
        "model", "series",
        _from_number("_origin", data.schema[ORIGIN].dataType).alias("origin_date"),
        _from_number("_target", kind).alias("target_date"),
        "actual", "predicted", "n_train",
    )


def _closed_forecasts(known: DataFrame, models, window, min_train: int) -> DataFrame:
    """Mean and last value of past targets, straight from the timeline."""
    event = F.col("_kind") == EVENT
    past = F.when(event, F.col("y"))
    filled = known.withColumns(
        {"_mean": F.avg(past).over(window), "_last": F.last(past, ignorenulls=True).over(window)}
    )
    answers = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("model"),
                F.col("_mean" if m.kind == "regression" else "_last").alias("predicted"),
            )
            for m in models
        ]
    )
    return (
        filled.where((F.col("_kind") == QUERY_AFTER) & F.col("_selected") & (F.col("_n") >= min_train))
        .select(SERIES, "_origin", "_target", F.col("y").alias("actual"), F.inline(answers),
                F.col("_n").cast("bigint").alias("n_train"))
        .select("model", "series", "_origin", "_target", "actual", "predicted", "n_train")
    )


def _solved_forecasts(line: DataFrame, models, columns: Sequence[str], min_train: int) -> DataFrame:
    """Blocks of the timeline summed up, their sums chained by series, and forecasts made block by block."""
    decays = sorted({m.weight for m in models if m.kind == "smoothing"})
    tasks = int(line.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"x{i}" for i in range(len(columns))]
    order = ["series", "_block", "_at", "_kind", "_origin"]
    line = line.select(F.col(SERIES).cast("string").alias("series"), "_block", "_at", "_kind", "_origin", "_target", "y", *names, "_selected")
    dealt = line.repartition(tasks, "series", "_block").sortWithinPartitions(*order)
    summaries = dealt.mapInArrow(_summaries(len(columns), decays), _STATE)
    chained = summaries.repartition(tasks, "series").sortWithinPartitions("series", "_block")
    states = chained.mapInArrow(_chain(len(columns), decays), _STATE)
    begun = states.withColumns({"_kind": F.lit(_BEGIN)})
    rows = line.withColumn("_state", F.lit(None).cast("array<double>")).unionByName(begun, allowMissingColumns=True)
    rows = rows.repartition(tasks, "series", "_block").sortWithinPartitions("series", "_block", F.asc_nulls_first("_at"), "_kind", "_origin")
    return rows.mapInArrow(_block_forecasts(models, columns, decays, min_train), _FORECAST_SCHEMA)


def walk_forward(data: DataFrame, model: ModelSpec, **options) -> DataFrame:
    """:func:`walk_forward_models` for one model."""
    return walk_forward_models(data, [model], **options)


def fit_known(
    data: DataFrame, models: Sequence[ModelSpec], *, before: Sequence[date | datetime], check: bool = False
) -> DataFrame:
    """Coefficients of linear models fitted on the targets observed before each date.

    One row per series, model, date and term: ``series, model, before, term, coefficient,
    n_train``; the term of the intercept is ``intercept``. A series with no outcome before a
    date has no rows for it, and is an error with ``check``.
    """
    if not models or not before:
        raise ValueError("at least one model and one date are required")
    for model in models:
        if model.kind != "regression":
            raise ValueError(f"{model.name} has no coefficients")
    columns = list(dict.fromkeys(c for m in models for c in m.regressors))
    require_columns(data, [SERIES, "target_date", "target", *columns], "data")
    kind = data.schema["target_date"].dataType
    cuts = sorted({_day_number(day, kind) for day in before})
    specs = [(m.name, m.weight, m.regressors) for m in models]
    names = [*(f"x{i}" for i in range(len(columns))), "y"]
    pairs = _pair_names(len(names))

    def fit(parts: pd.DataFrame) -> pd.DataFrame:
        """Fits of one series from the moments between its dates, one row each."""
        parts = parts.sort_values("_cut")
        n, at = parts["n"].to_numpy("float64"), parts["_cut"].to_numpy("int64")
        mean = parts[[f"m{i}" for i in range(len(names))]].to_numpy("float64")
        spread = np.empty((len(parts), len(names), len(names)))
        for index, (i, j) in enumerate(pairs):
            spread[:, i, j] = spread[:, j, i] = parts[f"c{index}"].to_numpy("float64") * n
        out = []
        for cut in cuts:
            known = at <= cut
            for name, penalty, regressors in specs if known.any() else ():
                used = [*(columns.index(c) for c in regressors), len(columns)]
                intercept, slopes = _pooled_fit(
                    n[known], mean[known][:, used], spread[known][:, used][:, :, used], penalty)
                for term, value in zip(("intercept", *regressors), (intercept, *slopes), strict=True):
                    out.append((parts["series"].iloc[0], name, cut, term, float(value), int(n[known].sum())))
        return pd.DataFrame(out, columns=["series", "model", "_before", "term", "coefficient", "n_train"])

    rows = data.select(
        SERIES,
        _to_number("target_date", kind).cast("bigint").alias("_target"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
        F.col("target").cast("double").alias("y"),
    )
    if check:
        late = rows.groupBy(SERIES).agg(F.min("_target").alias("_first")).where(F.col("_first") >= cuts[0])
        row = late.orderBy(SERIES).first()
        if row is not None or rows.isEmpty():
            raise DataError(f"no outcome before {min(before)}" + (f" in series {row[SERIES]!r}" if row else ""))
    # each row counts for the first date after it; dates add up what lies before them
    first = F.get(F.filter(F.array(*[F.lit(cut).cast("bigint") for cut in cuts]), lambda cut: cut > F.col("_target")), F.lit(0))
    moments = rows.withColumn("_cut", first).where("_cut is not null").groupBy(SERIES, "_cut").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(name).alias(f"m{i}") for i, name in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"c{index}") for index, (i, j) in enumerate(pairs)],
    )
    schema = "series string, model string, _before bigint, term string, coefficient double, n_train bigint"
    return moments.groupBy(SERIES).applyInPandas(fit, schema).select(
        "series", "model", _from_number("_before", kind).alias("before"), "term", "coefficient", "n_train"
    )


def _day_number(day: date | datetime, kind: T.DataType) -> int:
    stamp = pd.Timestamp(day)
    days = (stamp.normalize() - pd.Timestamp(0)).days
    return days if isinstance(kind, T.DateType) else stamp.value // 1000

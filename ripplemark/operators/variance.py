"""Variance measures of price paths.

A path is the rows of one key (one asset and session), in time order. With n + 1 prices
there are n log returns. Every measure is on the scale of the path's own period.

All measures asked for together share one window: a path is shuffled and sorted once. The
rows of a path are bounded by the sampling grid (288 five-minute prices in a session), so
no key can grow into a hot partition once the ticks are sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ripplemark.checks import non_negative_int, positive_int, require_columns
from ripplemark.functions.numeric import is_positive, parzen_weight
from ripplemark.functions.sessions import DAY_MICROS, step_micros
from ripplemark.operators.sampling import SESSION_KEYS, last_tick_sample

@dataclass(frozen=True)
class Measure:
    """One variance measure: columns it needs along the path, and their aggregate."""

    name: str
    aggregate: Column
    minimum_prices: int = 2
    along_path: dict[str, Callable[[WindowSpec], Column]] = field(default_factory=dict)


def _log_price() -> Column:
    return F.col("_lp")


def _return(lag: int) -> Callable[[WindowSpec], Column]:
    """The return ``lag`` steps back, from log prices only, so that one window serves all."""
    if lag == 0:
        return lambda w: _log_price() - F.lag("_lp", 1).over(w)
    return lambda w: F.lag("_lp", lag).over(w) - F.lag("_lp", lag + 1).over(w)


_R = {"_r0": _return(0)}


def _positive_part(rule: Column) -> Column:
    return F.coalesce(F.sum(F.when(rule, F.col("_r0") * F.col("_r0"))), F.lit(0.0))


def realized_variance(name: str = "rv") -> Measure:
    """Sum of squared log returns."""
    return Measure(name, F.sum(F.col("_r0") * F.col("_r0")), 2, _R)


def realized_semivariances(positive: str = "rs_pos", negative: str = "rs_neg") -> tuple[Measure, Measure]:
    """The sum split by the sign of the return; a zero return is in neither part."""
    return (
        Measure(positive, _positive_part(F.col("_r0") > 0), 2, _R),
        Measure(negative, _positive_part(F.col("_r0") < 0), 2, _R),
    )


def bipower_variation(name: str = "bipower") -> Measure:
    """Jump-robust variance from products of neighbouring absolute returns."""
    n = F.count("_r0")
    scale = F.lit(math.pi / 2) * n / F.nullif(n - 1, F.lit(0))
    products = F.sum(F.abs(F.col("_r0")) * F.abs(F.col("_r1")))
    return Measure(name, scale * products, 3, {**_R, "_r1": _return(1)})


def subsampled_realized_variance(step: int, name: str = "subsampled_rv") -> Measure:
    """Mean over the ``step`` offset grids of the variance of every step-th price.

    Each difference over ``step`` prices belongs to exactly one offset grid, so the mean is
    the sum of all of them divided by ``step``: no grid has to be built.
    """
    positive_int(step, "step")
    column = f"_d{step}"
    return Measure(
        name,
        F.coalesce(F.sum(F.col(column) * F.col(column)), F.lit(0.0)) / F.lit(float(step)),
        max(2, 2 * step),
        {column: lambda w: _log_price() - F.lag("_lp", step).over(w)},
    )


def _kernel(path: Column, bandwidth: Column) -> Column:
    """Weighted autocovariances of one path's log prices, in the JVM; null with too few returns."""

    def products(r: Column, h: Column) -> Column:
        n = F.size(r) - h
        return F.aggregate(
            F.zip_with(F.slice(r, h + 1, n), F.slice(r, F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x
        )

    def of_returns(r: Column) -> Column:
        lags = F.least(bandwidth, F.size(r) - 1).cast("int")
        rest = F.aggregate(
            F.sequence(F.lit(1), F.greatest(lags, F.lit(1))), F.lit(0.0),
            lambda total, h: total + parzen_weight(h / (bandwidth + 1).cast("double")) * products(r, h),
        )
        rest = F.when(lags >= 1, rest).otherwise(F.lit(0.0))
        return F.when((bandwidth >= 0) & (bandwidth < F.size(r)), products(r, F.lit(0)) + 2.0 * rest)

    def of_prices(p: Column) -> Column:
        n = F.greatest(F.size(p) - 1, F.lit(0))
        returns = F.zip_with(F.slice(p, F.lit(2), n), F.slice(p, F.lit(1), n), lambda x, y: x - y)
        return F.get(F.transform(F.array(returns), of_returns), F.lit(0))

    # one-element arrays bind a value to a name, so that it is computed once
    return F.get(F.transform(F.array(path), of_prices), F.lit(0))


def realized_kernel(bandwidth: int | Column, name: str = "realized_kernel") -> Measure:
    """Autocovariances of the returns up to ``bandwidth`` lags under Parzen weights.

    The bandwidth is a number, or differs from path to path (an aggregate column such as
    ``F.first("h")``). The path is an array, which the sampling grid bounds. Null where it has
    too few returns.
    """
    if isinstance(bandwidth, Column):
        lags, least = bandwidth.cast("bigint"), 2
    elif isinstance(bandwidth, int) and not isinstance(bandwidth, bool):
        lags, least = F.lit(non_negative_int(bandwidth, "bandwidth")).cast("bigint"), bandwidth + 2
    else:
        raise ValueError("bandwidth must be a non-negative integer or a column")
    path = F.transform(
        F.array_sort(F.collect_list(F.struct("_order", "_lp"))), lambda point: point["_lp"]
    )
    return Measure(name, _kernel(path, lags), least)


def summarize_paths(
    paths: DataFrame,
    measures: Sequence[Measure],
    *,
    keys: Sequence[str] = SESSION_KEYS,
    order: str = "bin",
    price: str = "mid",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key with ``n_prices``, every measure and any ``extra`` aggregates.

    A measure is null where the path has fewer prices than it needs, or any price is not a
    positive number; ``n_invalid`` counts such prices.
    """
    if not measures:
        raise ValueError("at least one measure is required")
    require_columns(paths, [*keys, order, price], "paths")
    window = Window.partitionBy(*keys).orderBy(order)
    along: dict[str, Callable[[WindowSpec], Column]] = {}
    for measure in measures:
        along.update(measure.along_path)
    valid = is_positive(price)
    steps = (
        paths.withColumn("_valid", valid)
        .withColumn("_lp", F.when(F.col("_valid"), F.ln(F.col(price).cast("double"))))
        .withColumn("_order", F.col(order))
    )
    if along:
        steps = steps.withColumns({name: build(window) for name, build in along.items()})
    aggregated = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_prices"),
        F.count_if(~F.col("_valid")).alias("n_invalid"),
        *[measure.aggregate.alias(measure.name) for measure in measures],
        *extra,
    )
    usable = {
        measure.name: F.when(
            (F.col("n_invalid") == 0) & (F.col("n_prices") >= measure.minimum_prices),
            F.col(measure.name),
        )
        for measure in measures
    }
    return aggregated.withColumns(usable)


def realized_variance_by_frequency(
    ticks: DataFrame,
    frequencies: Sequence[str],
    *,
    keys: Sequence[str] = SESSION_KEYS,
    ts: str = "ts",
    price: str = "mid",
    ordinal: Sequence[str] = (),
) -> DataFrame:
    """Realized variance of every path at each sampling step: keys, frequency, rv.

    Ticks are merged once, on the grid of the greatest common divisor of all steps (and of
    24 hours, where a step does not divide it). A coarser grid keeps the fine bins that are
    the last of their coarse bin, so one sorted pass along each path serves every step: no
    row is copied per step and nothing is shuffled again.
    """
    if not frequencies:
        raise ValueError("frequencies must not be empty")
    if len(set(frequencies)) != len(frequencies):
        raise ValueError("frequencies must be unique")
    steps = [step_micros(frequency) for frequency in frequencies]
    finest = math.gcd(*steps, DAY_MICROS)
    fine = last_tick_sample(ticks, f"{finest}us", keys=keys, ts=ts, price=price, ordinal=ordinal)
    path = Window.partitionBy(*keys)
    along = path.orderBy("bin")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.lit(0)
    if any(DAY_MICROS % step for step in steps):
        anchor = F.unix_micros(F.date_trunc("day", F.min("first_ts").over(path)))
    us = F.unix_micros("bin")
    placed = fine.select(
        *keys, "bin",
        F.when(is_positive(price), F.ln(F.col(price).cast("double"))).alias("_lp"),
        (us - anchor).alias("_since"),
        (F.lead(us).over(along) - anchor).alias("_next"),
    )
    ends = {
        f"_end{k}": F.col("_next").isNull() | (F.floor(F.col("_next") / step) != F.floor(F.col("_since") / step))
        for k, step in enumerate(steps)
    }
    moves = {
        f"_r{k}": F.when(
            F.col(f"_end{k}"), F.col("_lp") - F.last(F.when(F.col(f"_end{k}"), F.col("_lp")), ignorenulls=True).over(before)
        )
        for k in range(len(steps))
    }
    sums = [
        F.when(
            F.count_if(F.col(f"_end{k}") & F.col("_lp").isNull()) == 0, F.sum(F.col(f"_r{k}") * F.col(f"_r{k}"))
        ).alias(f"_rv{k}")
        for k in range(len(steps))
    ]
    rows = F.array(
        *[F.struct(F.lit(name).alias("frequency"), F.col(f"_rv{k}").alias("rv")) for k, name in enumerate(frequencies)]
    )
    return placed.withColumns(ends).withColumns(moves).groupBy(*keys).agg(*sums).select(*keys, F.inline(rows))


def signature(by_frequency: DataFrame, *, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Mean realized variance per sampling step: the points of a signature plot."""
    return by_frequency.groupBy(*keys, "frequency").agg(
        F.avg("rv").alias("mean_rv"), F.count("rv").alias("paths")
    )

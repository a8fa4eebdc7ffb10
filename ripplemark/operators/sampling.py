"""Regular time grids for irregular ticks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemark.checks import require_columns
from ripplemark.functions.sessions import DAY_MICROS, step_micros

SESSION_KEYS = ("asset", "session_date")


def floor_to_step(ts: Column, step: int) -> Column:
    """Start of the bin of ``ts`` on a grid anchored at UTC midnight; step must divide 24 h."""
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(step)))


#: Digits of a whole-number ordinal that fit one key beside the time inside a bin of at most a day.
ORDINAL_DIGITS = 26


def last_price(ticks: DataFrame, ts: str, price: str, ordinal: Sequence[str], step: int) -> Column:
    """Price of the latest tick of a bin of ``step`` microseconds. Ticks with the same time are ordered by ``ordinal``.

    The time inside the bin and a whole-number ordinal (an integer or a decimal of up to 26 digits) fit one decimal, a
    fixed-width buffer that lets Spark hash. Several ordinal columns, or text, make it sort. A null ordinal comes first.
    """
    if not ordinal:
        return F.max_by(price, ts)
    kind = ticks.schema[ordinal[0]].dataType
    if isinstance(kind, T.IntegralType):
        kind = T.DecimalType(19, 0)
    if len(ordinal) == 1 and isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= ORDINAL_DIGITS:
        digits = kind.precision
        place = F.coalesce(F.col(ordinal[0]).cast(T.DecimalType(digits, 0)) + F.lit(Decimal(10**digits)), F.lit(Decimal(0)))
        since = F.pmod(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(step)).cast(T.DecimalType(11, 0))
        return F.max_by(price, (since * F.lit(Decimal(2 * 10**digits)) + place).cast(T.DecimalType(38, 0)))
    return F.max(F.struct(ts, *ordinal, price)).getField(price)


def last_tick_sample(
    ticks: DataFrame,
    frequency: str,
    *,
    keys: Sequence[str] = SESSION_KEYS,
    ts: str = "ts",
    price: str = "mid",
    ordinal: Sequence[str] = (),
) -> DataFrame:
    """The last price of every non-empty bin, per key: keys, bin, price, first_ts, last_ts.

    Bins are closed on the left and anchored at the UTC midnight before the path's first
    tick. Where the step divides 24 hours that is the epoch grid, known without looking at
    the data. Otherwise every possible bin edge lies on the grid of the greatest common
    divisor of the step and 24 hours: ticks are merged on that grid first, and the anchor is
    found from the few merged rows.

    Ticks are merged per bin before they are shuffled, so a liquid asset costs at most one
    row per bin and input partition.
    """
    step = step_micros(frequency)
    require_columns(ticks, [*keys, ts, price, *ordinal], "ticks")
    grid = math.gcd(step, DAY_MICROS)
    merged = (
        ticks.withColumn("bin", floor_to_step(F.col(ts), grid))
        .groupBy("bin", *keys)  # the time first: where Spark sorts, it sorts by a number
        .agg(
            last_price(ticks, ts, price, ordinal, grid).alias(price),
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
        )
        .select(*keys, "bin", price, "first_ts", "last_ts")
    )
    return merged if grid == step else coarsen(merged, F.lit(step), keys=keys, price=price)


def coarsen(sample: DataFrame, step: Column, *, keys: Sequence[str], price: str = "mid") -> DataFrame:
    """A sample merged into bins of ``step`` microseconds, anchored at each path's midnight.

    The last price of a coarse bin is the price of its last fine bin. ``step`` must be a
    multiple of the sample's own step.
    """
    midnight = F.unix_micros(F.date_trunc("day", F.min("first_ts").over(Window.partitionBy(*keys))))
    since = F.unix_micros("bin") - F.col("_anchor")
    return (
        sample.withColumn("_anchor", midnight)
        .withColumn("_coarse", F.timestamp_micros(F.col("_anchor") + since - F.pmod(since, step)))
        .groupBy("_coarse", *keys)
        .agg(
            F.max_by(price, "bin").alias(price),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
        .select(*keys, F.col("_coarse").alias("bin"), price, "first_ts", "last_ts")
    )

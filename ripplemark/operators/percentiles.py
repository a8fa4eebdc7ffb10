"""Exact percentiles of groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.numeric import is_finite

#: Buckets per factor of two of a value's size.
BUCKETS_PER_OCTAVE = 256


def _bucket(value: Column) -> Column:
    """A bucket number that never falls as ``value`` rises, known without looking at other values."""
    size = F.floor(F.log2(F.abs(value)) * BUCKETS_PER_OCTAVE) + F.lit(2048 * BUCKETS_PER_OCTAVE)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * size).cast("int")


def exact_percentiles(frame: DataFrame, keys: Sequence[str], value: Column, levels: Sequence[float]) -> DataFrame:
    """Percentiles with linear interpolation, exact at any group size: keys, level, value.

    A built-in exact percentile holds a group's distinct values in one task. Here equal values are counted
    before the shuffle, running counts are taken inside buckets of values, and each bucket starts from the
    merged counts of those below it. All levels come from the same counts, which both the buckets and the ranks read.

    ``value`` must be finite; other rows are left out, and a key without any has no rows.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("at least one key column is required")
    data = frame.select(*keys, value.cast("double").alias("_v")).where(is_finite("_v"))
    counts = data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", _bucket(F.col("_v")))
    whole = Window.partitionBy(*keys)
    below = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc")).select(
        *keys, "_b", F.coalesce(F.sum("_bc").over(below), F.lit(0)).alias("_base"), F.sum("_bc").over(whole).alias("_n")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"z.{k}")) for k in [*keys, "_b"]]
    joined = counts.alias("a").join(buckets.alias("z"), same).select("a.*", "z._base", "z._n")
    ranked = joined.withColumn("_to", F.col("_base") + F.sum("_c").over(inside)).withColumn(
        "_from", F.col("_to") - F.col("_c")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_v")))

    answers = []
    for number, level in enumerate(levels):
        position = F.lit(float(level)) * (F.col("_n") - 1)
        answers += [
            at(F.floor(position)).alias(f"_a{number}"), at(F.ceil(position)).alias(f"_z{number}"),
            F.max(position - F.floor(position)).alias(f"_s{number}"),
        ]
    found = ranked.groupBy(*keys).agg(*answers)
    rows = [
        F.struct(
            F.lit(float(level)).alias("level"),
            (F.col(f"_a{k}") + (F.col(f"_z{k}") - F.col(f"_a{k}")) * F.col(f"_s{k}")).alias("value"),
        )
        for k, level in enumerate(levels)
    ]
    return found.select(*keys, F.inline(F.array(*rows)))

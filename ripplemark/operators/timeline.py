"""What was known when: cumulative totals of events at or before a query's time.

Spark has no as-of join. A theta join of queries with all earlier events is quadratic, so
both are put on one timeline instead, and a running window carries the totals from the
events to the queries: one shuffle by key and one sort. Events come before queries at the
same time, so "known at" includes events of that very time unless ``inclusive=False``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EVENT, QUERY_BEFORE, QUERY_AFTER = 0, -1, 1


def running(keys: Sequence[str], *tie: str) -> WindowSpec:
    """Everything up to the current row of a timeline."""
    return (
        Window.partitionBy(*keys)
        .orderBy("_at", "_kind", *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def self_timeline(rows: DataFrame, *, event_at: str, query_at: str) -> DataFrame:
    """Rows that are events at one time and queries at another, twice on one timeline.

    The input is read once (a union of two selections would compute it twice). Adds
    ``_kind`` (0 event, 1 query) and ``_at``.
    """
    moments = F.array(
        F.struct(F.lit(EVENT).alias("_kind"), F.col(event_at).alias("_at")),
        F.struct(F.lit(QUERY_AFTER).alias("_kind"), F.col(query_at).alias("_at")),
    )
    return rows.select("*", F.inline(moments))


def accumulate_known(
    events: DataFrame,
    queries: DataFrame,
    *,
    keys: Sequence[str],
    event_at: str,
    query_at: str,
    totals: Mapping[str, Column],
    latest: Mapping[str, Column] | None = None,
    tie: Sequence[str] = (),
    inclusive: bool = True,
    block: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Every query with running ``totals`` and ``latest`` values of the events known by then.

    ``totals`` are sums of expressions over event columns; ``n_known`` counts the events;
    ``tie`` orders events of the same time.

    One key's events are one window. Where a key can hold more events than a task should,
    give ``block``, a function of time that never decreases (such as the month): windows then
    end at the block, and each block starts from the sums of the blocks before it, which are
    merged ahead of the shuffle. The results are the same.
    """
    latest = dict(latest or {})
    kind = QUERY_AFTER if inclusive else QUERY_BEFORE
    expressions = {**totals, **latest}
    left = events.select(
        *keys,
        F.col(event_at).alias("_at"),
        F.lit(EVENT).alias("_kind"),
        *[F.col(name).alias(f"_t_{name}") for name in tie],
        *[expression.alias(f"_e_{name}") for name, expression in expressions.items()],
    )
    right = queries.withColumns({"_at": F.col(query_at), "_kind": F.lit(kind)})
    line = left.unionByName(right, allowMissingColumns=True)
    order = [f"_t_{name}" for name in tie]
    is_event = F.when(F.col("_kind") == EVENT, 1).otherwise(0)
    if block is None:
        window, base = running(keys, *order), None
    else:
        line = line.withColumn("_block", block(F.col("_at")))
        base = _block_starts(line, keys, totals, latest, order)
        window = running([*keys, "_block"], *order)

    known = line.withColumns(
        {
            "n_known": F.sum(is_event).over(window),
            **{name: F.coalesce(F.sum(f"_e_{name}").over(window), F.lit(0.0)) for name in totals},
            **{name: F.last(f"_e_{name}", ignorenulls=True).over(window) for name in latest},
        }
    ).where(F.col("_kind") == kind)
    if base is not None:
        known = known.join(base, [*keys, "_block"]).withColumns(
            {
                "n_known": F.col("n_known") + F.col("_b_n_known"),
                **{name: F.col(name) + F.col(f"_b_{name}") for name in totals},
                **{name: F.coalesce(F.col(name), F.col(f"_b_{name}")) for name in latest},
            }
        )
    return known.select(*queries.columns, "n_known", *totals, *latest)


def _block_starts(
    line: DataFrame, keys: Sequence[str], totals: Mapping[str, Column], latest: Mapping[str, Column], order: Sequence[str]
) -> DataFrame:
    """Totals, count and latest values of each key's events before each of its blocks."""
    before = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    position = F.struct("_at", *order)
    blocks = line.groupBy(*keys, "_block").agg(
        F.count_if(F.col("_kind") == EVENT).alias("_s_n_known"),
        *[F.sum(f"_e_{name}").alias(f"_s_{name}") for name in totals],
        *[
            F.max_by(f"_e_{name}", F.when(F.col(f"_e_{name}").isNotNull(), position)).alias(f"_s_{name}")
            for name in latest
        ],
    )
    return blocks.select(
        *keys, "_block",
        F.coalesce(F.sum("_s_n_known").over(before), F.lit(0)).alias("_b_n_known"),
        *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0.0)).alias(f"_b_{name}") for name in totals],
        *[F.last(f"_s_{name}", ignorenulls=True).over(before).alias(f"_b_{name}") for name in latest],
    )

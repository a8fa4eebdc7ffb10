"""Forecast losses as column functions of (actual, predicted).

Any function of two columns that gives one finite non-negative number per row can be
used as a loss, a vectorised Python function included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplemark.functions.numeric import is_positive

Loss = Callable[[Column, Column], Column]


def qlike(actual: Column, predicted: Column) -> Column:
    """ratio - ln(ratio) - 1 with ratio = actual / predicted; null unless both are positive.

    Rounding can push the value a hair below zero near a perfect forecast; it is cut at 0.
    """
    ratio = actual / predicted
    return F.when(
        is_positive(actual) & is_positive(predicted),
        F.greatest(ratio - F.ln(ratio) - F.lit(1.0), F.lit(0.0)),
    )


def squared_error(actual: Column, predicted: Column) -> Column:
    return (actual - predicted) * (actual - predicted)


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)

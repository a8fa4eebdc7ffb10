"""Argument checks on the driver, and data checks as one aggregate of violation counts.

Arguments are checked when a function is called. Data is checked only on request,
because a check is a Spark action: each data check builds one aggregate whose columns
count the rows breaking each rule, and raises when a count is not zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """The data breaks a rule that the operator depends on."""


def positive_int(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    return value


def non_negative_int(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be a non-negative integer")
    return value


def finite_number(value: object, name: str, *, minimum: float = -math.inf) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{name} must be a number")
    if not math.isfinite(value) or value < minimum:
        raise ValueError(f"{name} must be finite and at least {minimum}")
    return float(value)


def column_name(value: object, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a non-empty column name")
    return value


def require_columns(frame: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    """Every column is there, and no name occurs twice."""
    if len(set(frame.columns)) != len(frame.columns):
        raise ValueError(f"{what} columns must be unique")
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")


def violations(frame: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """How many rows break each rule, per key. A rule is true for a broken row."""
    counts = [
        F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()
    ]
    return frame.groupBy(*keys).agg(*counts)


def enforce(frame: DataFrame, rules: Mapping[str, Column], what: str) -> None:
    """Run the rules now and raise when a row breaks one (the only row fetched is the counts)."""
    counts = violations(frame, rules).first()
    broken = {name: counts[name] for name in rules if counts[name]}
    if broken:
        listed = "; ".join(f"{count} rows: {name}" for name, count in broken.items())
        raise DataError(f"{what}: {listed}")


def enforce_unique(frame: DataFrame, keys: Sequence[str], what: str) -> None:
    """No key combination occurs twice."""
    repeated = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if not repeated.isEmpty():
        raise DataError(f"{what} must have one row per {', '.join(keys)}")


def enforce_not_empty(frame: DataFrame, what: str) -> None:
    if frame.isEmpty():
        raise DataError(f"{what} must not be empty")

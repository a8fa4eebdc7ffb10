"""Trading-session rules as column functions: a session closes at 17:00 New York time."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplemark.functions.numeric import as_column

# Fixed values of the session convention.
SESSION_CLOSE_HOUR = 17
SESSION_ZONE = "America/New_York"
SESSION_HOURS = 24
MIN_SESSION_HOURS = 12.0
EDGE_TOLERANCE_HOURS = 1.0

HOUR_MICROS = 3_600_000_000
DAY_MICROS = 24 * HOUR_MICROS

# Microseconds per frequency unit.
UNIT_MICROS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "min": 60_000_000,
    "h": HOUR_MICROS,
    "D": DAY_MICROS,
}


def step_micros(frequency: str) -> int:
    """Length of a sampling step such as ``"5min"``, ``"30s"`` or ``"1h"``, in microseconds."""
    match = re.fullmatch(r"\s*(\d+)?\s*([A-Za-z]+)\s*", frequency) if isinstance(frequency, str) else None
    if match is None or match.group(2) not in UNIT_MICROS:
        raise ValueError(f"{frequency!r} is not a positive sampling frequency")
    step = int(match.group(1) or 1) * UNIT_MICROS[match.group(2)]
    if step <= 0:
        raise ValueError(f"{frequency!r} is not a positive sampling frequency")
    return step


def prices_per_session(frequency: str) -> int:
    """Sampled prices in a full session; the step must divide 24 hours."""
    step = step_micros(frequency)
    if DAY_MICROS % step:
        raise ValueError("frequency must divide the session length")
    return DAY_MICROS // step


def session_wall_time(ts: Column | str) -> Column:
    """New York wall time moved so that midnight falls on the session close."""
    local = F.from_utc_timestamp(as_column(ts), SESSION_ZONE)
    return local + F.expr(f"INTERVAL {SESSION_HOURS - SESSION_CLOSE_HOUR} HOURS")


def session_date(ts: Column | str) -> Column:
    """The local date on which the session of a UTC instant closes."""
    return F.to_date(session_wall_time(ts))


def session_close(day: Column | str) -> Column:
    """UTC instant at which the session named ``day`` closes."""
    wall = as_column(day).cast("date").cast("timestamp") + F.expr(f"INTERVAL {SESSION_CLOSE_HOUR} HOURS")
    return F.to_utc_timestamp(wall, SESSION_ZONE)


def session_open(day: Column | str) -> Column:
    """UTC instant at which the session named ``day`` opens: the close of the day before."""
    return session_close(F.date_sub(as_column(day).cast("date"), 1))


def hours_between(first: Column | str, last: Column | str) -> Column:
    return (F.unix_micros(as_column(last)) - F.unix_micros(as_column(first))) / F.lit(float(HOUR_MICROS))


def pair_name(asset: Column | str) -> Column:
    """``EURUSD`` as ``EUR/USD``; names that are not six characters long stay as they are."""
    c = as_column(asset)
    return F.when(
        F.length(c) == 6, F.concat_ws("/", F.substring(c, 1, 3), F.substring(c, 4, 3))
    ).otherwise(c)

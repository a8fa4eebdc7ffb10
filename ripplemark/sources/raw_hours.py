"""Raw hourly tick bodies in a landing directory: decode, complete, report what is missing.

A body is an LZMA stream of fixed-size big-endian records. Files are found and spread over
tasks by Spark's binary file source; a task decodes the bodies it is given.
"""

from __future__ import annotations

import lzma
from collections.abc import Iterator
from datetime import date, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemark.checks import DataError

# Fixed values of the vendor's format: one record is 20 bytes.
RECORD = np.dtype(
    [("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_vol", ">f4"), ("bid_vol", ">f4")]
)

# What an integer price is divided by, per symbol.
POINT_DIVIDERS = {
    "EURUSD": 1e5,
    "USDJPY": 1e3,
    "XAUUSD": 1e3,
    "USA500IDXUSD": 1e3,
}

# Fixed value: an hour may still be empty only because it is not published yet.
PUBLICATION_DELAY_DAYS = 1

# Fixed value: SYMBOL/year/month/day/HHh_ticks.bi5
PATH_PATTERN = r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5$"

#: Decoded ticks handed back to Spark at a time.
TICKS_PER_BATCH = 500_000

TICK_SCHEMA = "asset string, ts timestamp, bid double, ask double, bid_vol double, ask_vol double"


def divider_of(symbol: Column) -> Column:
    """The divider as a column; fails the job on an unknown symbol."""
    table = F.create_map(*[F.lit(part) for item in POINT_DIVIDERS.items() for part in item])
    name = F.upper(symbol)
    unknown = F.raise_error(F.concat(F.lit("no point divider is known for "), F.coalesce(symbol, F.lit("null"))))
    return F.when(F.map_contains_key(table, name), F.element_at(table, name)).otherwise(unknown.cast("double"))


def decode_body(raw: bytes | None, label: str = "body") -> np.ndarray:
    """Records of one compressed body; none for an empty one."""
    body = lzma.decompress(raw) if raw else b""
    whole, rest = divmod(len(body), RECORD.itemsize)
    if rest:
        raise DataError(f"{label} ends inside a record: {rest} bytes behind the last of {whole} records")
    return np.frombuffer(body, dtype=RECORD)


def _ticks_of(files: list[tuple[str, int, float, np.ndarray]]) -> pd.DataFrame:
    """Typed ticks of several decoded bodies, as one table."""
    counts = [len(records) for *_, records in files]
    records = np.concatenate([records for *_, records in files])
    start = np.repeat([hour_us for _, hour_us, _, _ in files], counts)
    divider = np.repeat([divider for _, _, divider, _ in files], counts)
    ts = (start + records["ms"].astype("int64") * 1000).astype("datetime64[us]")
    return pd.DataFrame(
        {
            "asset": np.repeat([asset for asset, *_ in files], counts),
            "ts": pd.Series(ts).dt.tz_localize("UTC"),
            "bid": records["bid"] / divider,
            "ask": records["ask"] / divider,
            "bid_vol": records["bid_vol"].astype("float64"),
            "ask_vol": records["ask_vol"].astype("float64"),
        }
    )


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        waiting, size = [], 0
        for file in batch.itertuples(index=False):
            records = decode_body(file.content, file.path)
            if len(records):
                waiting.append((file.asset, file.hour_us, file.divider, records))
                size += len(records)
            if size >= TICKS_PER_BATCH:
                yield _ticks_of(waiting)
                waiting, size = [], 0
        if waiting:
            yield _ticks_of(waiting)


def landed_hours(spark: SparkSession, root: str, *, month_base: int = 1) -> DataFrame:
    """The hourly files below ``root``: path, asset, hour, length and content.

    ``month_base`` is 1 where January is directory 01, and 0 where it is directory 00.
    """
    if month_base not in (0, 1):
        raise ValueError("month_base must be 0 or 1")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.bi5")
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    part = [F.regexp_extract("path", PATH_PATTERN, i) for i in range(1, 6)]
    numbers = [p.cast("int") for p in part[1:]]
    return files.select(
        "path", "length", "content",
        F.upper(part[0]).alias("asset"),
        F.make_timestamp(numbers[0], numbers[1] + (1 - month_base), numbers[2], numbers[3], F.lit(0), F.lit(0.0)).alias("hour"),
    )


def decode_hours(landed: DataFrame) -> DataFrame:
    """Ticks of the landed hours, with ``mid``. One file is at most one hour of one symbol."""
    prepared = landed.select(
        "path", "asset", F.unix_micros("hour").alias("hour_us"),
        divider_of(F.col("asset")).alias("divider"), "content",
    )
    return assemble_ticks(prepared.mapInPandas(_decode_batches, TICK_SCHEMA))


def assemble_ticks(ticks: DataFrame) -> DataFrame:
    """Quotes with a time, and their mid price."""
    return ticks.where(F.col("ts").isNotNull()).withColumn("mid", F.lit(0.5) * (F.col("bid") + F.col("ask")))


def trading_hours(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every hour from ``start`` to ``end``, both days included, except on Saturdays."""
    if start > end:
        return spark.createDataFrame([], T.StructType([T.StructField("hour", T.TimestampType())]))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    return _hours_of(days.select("day")).select("hour")


def _hours_of(days: DataFrame) -> DataFrame:
    """The 24 hours of every day that is not a Saturday."""
    midnight = F.col("day").cast("timestamp")
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.timestamp_micros(F.unix_micros(midnight) + h * F.lit(3_600_000_000)))
    return days.where(F.dayofweek("day") != 7).select("*", F.explode(hours).alias("hour"))


def expected_hours(ranges: DataFrame) -> DataFrame:
    """Trading hours per asset from rows of ``asset, start, end`` (dates)."""
    days = ranges.select("asset", F.explode(F.sequence("start", "end")).alias("day"))
    return _hours_of(days).select("asset", "hour")


def missing_hours(expected: DataFrame, landed: DataFrame, *, now: datetime | Column | None = None) -> DataFrame:
    """Expected hours that have not landed, and whether their absence is final.

    An hour is settled once it has been over for the publication delay.
    """
    current = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    settled_at = F.col("hour") + F.expr(f"INTERVAL {1 + 24 * PUBLICATION_DELAY_DAYS} HOURS")
    present = landed.select("asset", "hour").distinct()
    return expected.join(present, ["asset", "hour"], "left_anti").withColumn("settled", settled_at <= current)

"""Tick tables: scan, checks, write."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.checks import DataError, require_columns
from ripplemark.functions.numeric import is_positive, spread_bps
from ripplemark.operators.percentiles import exact_percentiles
from ripplemark.sources.numbers import claim_number

#: Columns that order ticks of the same time: later delivery, then later file, then later row. The sink below
#: numbers its deliveries and their rows; of other files, the one that was written later is the later one.
FILE_ORDINAL = ("delivery", "file_name", "row_index")

#: The same order in one whole number, for ticks of the sink: 9 digits of the delivery, 17 of the place in it.
ARRIVAL = "arrival"

SPREAD_LEVELS = (0.5, 0.99)


def read_ticks(
    spark: SparkSession, paths: str | Sequence[str], *, asset: str | None = None, with_ordinal: bool = True,
    only: Column | None = None,
) -> DataFrame:
    """Ticks of Parquet files: ``asset, ts, mid`` and, for repeated times, ``FILE_ORDINAL``.

    Ticks of the sink also have ``ARRIVAL``; ``tick_ordinal`` names what orders them best. Only these columns are read. Ticks delivered by several files stay in the scan; the
    sampling keeps the last one of each time, so they need no shuffle of their own.
    ``asset`` names the files' asset, or picks one where the table has the column; ``only`` is a condition on the files'
    own columns, those in their paths included.
    """
    sources = [paths] if isinstance(paths, str) else sorted(set(paths))
    if not sources:
        raise ValueError("at least one tick file is required")
    scan = spark.read.option("mergeSchema", "false").parquet(*sources)
    require_columns(scan, ["ts", "mid"], "tick files")
    if only is not None:
        scan = scan.where(only)
    if "asset" in scan.columns:
        name = F.col("asset")
        if asset is not None:
            scan = scan.where(F.col("asset") == asset.upper())
    elif asset is not None:
        name = F.lit(asset.upper())
    else:
        raise ValueError("tick files have no asset column: name the asset")
    ordinal = []
    if with_ordinal and {"delivery", "position"} <= set(scan.columns):
        number = F.col("delivery").cast("decimal(9,0)") * F.lit(Decimal(10**17)) + F.col("position").cast("decimal(17,0)")
        ordinal = [F.col("delivery"), F.lit("").alias("file_name"), F.col("position").alias("row_index"),
                   number.cast("decimal(26,0)").alias(ARRIVAL)]
    elif with_ordinal:
        ordinal = [
            F.unix_micros("_metadata.file_modification_time").alias("delivery"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.row_index").alias("row_index"),
        ]
    return scan.select(
        name.alias("asset"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("mid").cast("double").alias("mid"), *ordinal,
    )


def tick_ordinal(ticks: DataFrame) -> tuple[str, ...]:
    """The columns that order ticks of one time: one number where there is one, which Spark hashes by instead of sorting."""
    return (ARRIVAL,) if ARRIVAL in ticks.columns else FILE_ORDINAL


def tick_violations(ticks: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Rows, and rows without a time or a finite positive mid price, per asset."""
    return ticks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ticks"),
        F.count_if(F.col("ts").isNull() | ~is_positive("mid")).alias("invalid"),
    )


def enforce_ticks(ticks: DataFrame) -> None:
    """Run the tick rules now."""
    invalid = ticks.agg(F.count_if(F.col("ts").isNull() | ~is_positive("mid"))).first()[0]
    if invalid:
        raise DataError(f"{invalid} invalid timestamps or mid prices")


def file_order(ticks: DataFrame) -> DataFrame:
    """First and last tick per file, and whether a file starts before the one named before it."""
    require_columns(ticks, ["asset", "file_name", "ts"], "ticks")
    files = ticks.groupBy("asset", "file_name").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("ticks")
    )
    before = F.lag("first_ts").over(Window.partitionBy("asset").orderBy("file_name"))
    return files.withColumn("out_of_order", F.coalesce(F.col("first_ts") < before, F.lit(False)))


def enforce_file_order(ticks: DataFrame) -> None:
    row = file_order(ticks).where("out_of_order").orderBy("file_name").first()
    if row is not None:
        raise DataError(f"{row['file_name']} starts before the previous file; name files in time order")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files below a path, from their directory entries: one row per file, none opened.

    ``asset`` and ``date`` come from the directory names and are null where files are not partitioned by them.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    name = F.regexp_extract("path", "/asset=([^/]+)/", 1)
    day = F.regexp_extract("path", r"/date=(\d{4}-\d\d-\d\d)/", 1)
    return files.select(
        F.when(name != "", F.url_decode(name)).alias("asset"), F.when(day != "", day).cast("date").alias("date"),
        "path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"),
    )


def file_summary(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of files and their size in GB."""
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tick_files"), (F.sum("bytes") / F.lit(1e9)).alias("tick_gb")
    )


def sanity_report(
    quotes: DataFrame, *, ts: str = "ts", sequence: str | Sequence[str] | None = None, spread: Column | None = None
) -> DataFrame:
    """Per asset: ticks, span, crossed quotes, non-positive prices, median and 99th spread (bps).

    With ``sequence``, what orders the arrivals of an asset (a number, or a file and a row number),
    ``unsorted`` counts the ticks earlier than the one before them. The spreads' percentiles are exact
    at any size; a quote whose mid price is zero has no spread.
    """
    require_columns(quotes, ["asset", ts, "bid", "ask", "mid"], "quotes")
    basis = spread if spread is not None else spread_bps("bid", "ask", "mid")
    counts = quotes.groupBy("asset").agg(
        F.count(F.lit(1)).alias("ticks"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count_if(F.col("ask") < F.col("bid")).alias("crossed_quotes"),
        F.count_if(F.col("mid") <= 0).alias("non_positive_prices"),
    )
    levels = exact_percentiles(quotes, ["asset"], basis, SPREAD_LEVELS)
    wide = levels.groupBy("asset").agg(
        F.max(F.when(F.col("level") == SPREAD_LEVELS[0], F.col("value"))).alias("spread_median"),
        F.max(F.when(F.col("level") == SPREAD_LEVELS[1], F.col("value"))).alias("spread_p99"),
    )
    report = counts.join(wide, "asset", "left")
    if sequence is not None:
        report = report.join(unsorted_ticks(quotes, ts=ts, sequence=sequence), "asset", "left")
    return report


def unsorted_ticks(
    quotes: DataFrame, *, ts: str = "ts", sequence: str | Sequence[str] = FILE_ORDINAL, block: int = 1_000_000
) -> DataFrame:
    """Ticks that are earlier than the previous one in arrival order, per asset.

    Arrivals are ordered by ``sequence``: a number, or columns of which the last one is a number that
    starts anew where those before it change. The order is checked inside blocks of that number and again
    between the blocks' ends, so an asset with most of the ticks is never sorted in one task.
    """
    *files, row = [sequence] if isinstance(sequence, str) else sequence
    files = [F.col(name).alias(f"f{k}") for k, name in enumerate(files)]
    blocks = quotes.select("asset", F.col(ts).alias("t"), *files, F.col(row).alias("s")).withColumn(
        "b", F.floor(F.col("s") / block)
    )
    place = [f"f{k}" for k in range(len(files))] + ["b"]
    inside = Window.partitionBy("asset", *place).orderBy("s")
    per_block = (
        blocks.withColumn("_back", F.col("t") < F.lag("t").over(inside))
        .groupBy("asset", *place)
        .agg(
            F.count_if("_back").alias("inside"),
            F.min_by("t", "s").alias("first_t"),
            F.max_by("t", "s").alias("last_t"),
        )
    )
    between = F.lag("last_t").over(Window.partitionBy("asset").orderBy(*place))
    return (
        per_block.withColumn("_jump", F.coalesce(F.col("first_t") < between, F.lit(False)))
        .groupBy("asset")
        .agg((F.sum("inside") + F.count_if("_jump")).cast("bigint").alias("unsorted"))
    )


def write_ticks(
    ticks: DataFrame, path: str, *, ordinal: Sequence[str] = (), mode: str = "append", files_per_day: int = 1,
    owner: str | None = None,
) -> None:
    """Write ticks partitioned by asset and UTC date, sorted by time within each file.

    Each call is a delivery with the next number of the table (a call for the same ``owner`` keeps its number, so
    that it may be repeated), and each row has its place in it: by
    ``ordinal`` among rows of one time, else as the rows come. Readers let the later delivery win, then the
    later place. A day of one asset goes to ``files_per_day`` tasks, split by time of day, so that a liquid
    asset does not end in one writer. Overwriting replaces only the partitions that are written.
    """
    slot = F.floor(F.pmod(F.unix_seconds("ts"), F.lit(86400)) * files_per_day / 86400)
    if ordinal:
        place = F.row_number().over(Window.partitionBy("asset", "ts").orderBy(*ordinal)).cast("bigint")
    else:
        place = F.monotonically_increasing_id()
    dated = ticks.withColumn("position", place).withColumns(
        {"delivery": F.lit(claim_number(ticks.sparkSession, f"{path}/_deliveries", owner)), "date": F.to_date("ts")}
    )
    (
        dated.repartition("asset", "date", slot)
        .sortWithinPartitions("asset", "date", "ts", "position")
        .write.partitionBy("asset", "date")
        .option("partitionOverwriteMode", "dynamic")
        .mode(mode)
        .parquet(path)
    )

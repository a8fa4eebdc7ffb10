"""The daily table on disk: sessions recomputed where their tick files changed, under the options that made them.

A table has four parts. ``files`` has the tick files each build saw for the first time, saw changed, or missed; ``sessions``
has the sessions that those files can touch, before any filter; ``rows`` has the daily rows of the assets they are of; and
``builds`` has an entry per asset and build, which is written last. Readers take entered builds only: for a session, and for
an asset's rows, the latest one. So a build counts from its entry on, whole, and an asset that came out empty is empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.checks import DataError
from ripplemark.functions.numeric import is_positive
from ripplemark.plans.daily import (
    DAILY_COLUMNS,
    EDGE_TOLERANCE_HOURS,
    MIN_SESSION_HOURS,
    SAMPLING_FREQUENCY,
    VARIANCE_COLUMNS,
    daily_rows,
    keep_complete,
    summarize_sessions,
)
from ripplemark.sources.numbers import claim_number
from ripplemark.sources.ticks import ARRIVAL, list_files, read_ticks, tick_ordinal

_DAILY = ", ".join(
    {"date": "date date", "observation_count": "observation_count bigint"}.get(name, f"{name} double")
    for name in DAILY_COLUMNS if name != "asset"
)
_SESSION = f"session_date date, {', '.join(f'{c} double' for c in VARIANCE_COLUMNS)}, observation_count bigint, first_ts timestamp, last_ts timestamp"
#: The parts of a table and their columns; sessions without a price are those whose ticks have gone.
_PARTS = {
    "rows": f"{_DAILY}, asset string, build bigint",
    "sessions": f"{_SESSION}, asset string, build bigint",
    "files": "path string, date date, modified_at timestamp, bytes bigint, there boolean, asset string, build bigint",
    "builds": "asset string, build bigint",
}


@dataclass(frozen=True)
class Layout:
    """Where tables live below one root."""

    root: str

    @property
    def ticks(self) -> str:
        return f"{self.root}/ticks"

    def raw(self, source: str) -> str:
        return f"{self.root}/raw/{source}"

    def daily(
        self, frequency: str = SAMPLING_FREQUENCY, *, min_session_hours: float = MIN_SESSION_HOURS,
        edge_tolerance_hours: float | None = EDGE_TOLERANCE_HOURS,
    ) -> str:
        """Each set of options that changes rows has its own table."""
        edge = "none" if edge_tolerance_hours is None else f"{float(edge_tolerance_hours):g}"
        return f"{self.root}/derived/daily_rv_{frequency}_{float(min_session_hours):g}h_{edge}"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _part(spark: SparkSession, path: str, part: str) -> DataFrame:
    if not _exists(spark, f"{path}/{part}"):  # nothing was written yet
        return spark.createDataFrame([], _PARTS[part])
    return spark.read.schema(_PARTS[part]).parquet(f"{path}/{part}")


def _entered(spark: SparkSession, path: str, part: str, also: int | None = None) -> DataFrame:
    """Rows of a part that belong to builds that count, and to build ``also``."""
    rows = _part(spark, path, part)
    builds = _part(spark, path, "builds").select("asset", "build").distinct()
    counted = rows.join(builds, ["asset", "build"], "left_semi")
    return counted if also is None else counted.unionByName(rows.where(F.col("build") == also))


def _latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the latest build for each key; a key has one row per build."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("build"))
    return rows.withColumn("_age", F.row_number().over(newest)).where("_age = 1").drop("_age")


def read_daily(spark: SparkSession, path: str, *, asset: str | None = None) -> DataFrame:
    rows, builds = _part(spark, path, "rows"), _part(spark, path, "builds")
    if asset is not None:
        rows, builds = (x.where(F.col("asset") == asset.upper()) for x in (rows, builds))
    builds = builds.groupBy("asset").agg(F.max("build").alias("build"))
    return rows.join(builds, ["asset", "build"], "left_semi").select(*DAILY_COLUMNS)


def changed_files(spark: SparkSession, tick_path: str, daily_path: str) -> DataFrame:
    """Tick files that the table's builds didn't see as they are now: new, replaced (another time or size), or gone.

    ``asset, path, date, modified_at, bytes, there``; ``there`` is false for files that have gone. Reads directory entries
    and the list of files the builds kept. A table whose parts have other columns than today's has seen none.
    """
    now = list_files(spark, tick_path).where("asset is not null")
    seen = _latest(_entered(spark, daily_path, "files"), "asset", "path").where("there").drop("there", "build")
    if _outdated(spark, daily_path):
        seen = seen.limit(0)
    same = [F.col(f"n.{c}") == F.col(f"s.{c}") for c in ("asset", "path")]
    both = now.alias("n").join(seen.alias("s"), same, "full")
    pick = [F.coalesce(f"n.{c}", f"s.{c}").alias(c) for c in ("asset", "path", "date", "modified_at", "bytes")]
    differs = ~F.col("n.modified_at").eqNullSafe(F.col("s.modified_at")) | ~F.col("n.bytes").eqNullSafe(F.col("s.bytes"))
    return both.where(differs).select(*pick, F.col("n.path").isNotNull().alias("there"))


def _outdated(spark: SparkSession, path: str) -> bool:
    """Whether rows or sessions have other columns than today's; a part without a file has none of its own."""
    for part in ("rows", "sessions"):
        files = _part(spark, path, part).inputFiles()
        if files and {*spark.read.parquet(files[0]).columns, "asset", "build"} != set(_part(spark, path, part).columns):
            return True
    return False


def stale_assets(spark: SparkSession, tick_path: str, daily_path: str) -> DataFrame:
    """Assets with tick files that no build has seen as they are now, how many, and the newest one's time."""
    return changed_files(spark, tick_path, daily_path).groupBy("asset").agg(
        F.count(F.lit(1)).alias("files"), F.max("modified_at").alias("ticks_at"))


def _days(day: Column, first: int, last: int) -> Column:
    return F.explode(F.sequence(F.date_add(day, first), F.date_add(day, last)))


@dataclass(frozen=True)
class Extent:
    """What changed files are about: their assets and dates, the assets with a file that names no date, and
    whether any of the files is there.

    Names of directories and days, which the driver's listing and the calendar bound.
    """

    assets: list[str]
    dates: list[date]
    undated: list[str]
    there: bool

    @classmethod
    def of(cls, changed: DataFrame) -> Extent:
        return cls(*changed.agg(
            F.collect_set("asset"), F.collect_set("date"), F.collect_set(F.when(F.col("date").isNull(), F.col("asset"))),
            F.bool_or("there")).first())


def touched_sessions(changed: DataFrame) -> DataFrame:
    """(asset, session_date) whose ticks changed files of one date can hold: that date's session and the next one's, as
    a session opens in the evening before its date, UTC."""
    return changed.where("date is not null").select("asset", _days(F.col("date"), 0, 1).alias("session_date")).distinct()


def ticks_around(spark: SparkSession, tick_path: str, extent: Extent) -> DataFrame:
    """The ticks that sessions touched by changed files are made of: those of their dates and of the days around them.

    Dates are a filter on partitions, so other days aren't read. An undated file's asset is read whole.
    """
    if not extent.there and list_files(spark, tick_path).isEmpty():
        return spark.createDataFrame([], f"asset string, ts timestamp, mid double, {ARRIVAL} decimal(26,0)")
    near = sorted({day + timedelta(days=k) for day in extent.dates for k in (-1, 0, 1)})
    source = F.col("asset").isin(extent.assets)
    if "date" in spark.read.parquet(tick_path).columns:
        source &= F.col("asset").isin(extent.undated) | F.col("date").isin(near)
    return read_ticks(spark, tick_path, only=source)


def refresh_daily(
    spark: SparkSession,
    layout: Layout,
    *,
    frequency: str = SAMPLING_FREQUENCY,
    assets: Sequence[str] | None = None,
    check: bool = True,
    **options,
) -> DataFrame:
    """Bring the daily table for these options up to date and read it.

    Only the sessions that changed files can touch are computed, from the days they lie on; what is kept of the others
    goes into the assets' rows with them. With ``check``, ticks without a time or a positive price are counted while the
    build reads them, and a build that met one is not entered. An asset that has no ticks is an error.
    """
    target = layout.daily(frequency, **options)
    wanted = None if assets is None else [a.upper() for a in assets]
    if wanted is not None:
        there = {r.asset for r in list_files(spark, layout.ticks).select("asset").distinct().collect()}
        if missing := sorted(set(wanted) - there):
            raise DataError(f"no ticks of {', '.join(missing)}")
    changed = changed_files(spark, layout.ticks, target)
    if wanted is not None:
        changed = changed.where(F.col("asset").isin(wanted))
    if not changed.isEmpty():
        build = claim_number(spark, f"{target}/_builds")

        def write(frame: DataFrame, part: str) -> None:
            (frame.withColumn("build", F.lit(build).cast("bigint")).write.partitionBy("asset", "build").mode("append")
             .parquet(f"{target}/{part}"))

        def mine(part: str) -> DataFrame:
            return _part(spark, target, part).where(F.col("build") == build)

        write(changed, "files")  # from here on the list is fixed, whatever happens to the ticks meanwhile
        met = Observation()
        extent = Extent.of(mine("files"))
        ticks = ticks_around(spark, layout.ticks, extent)
        if extent.there:  # else there may be nothing left to count
            ticks = ticks.observe(met, F.count_if(F.col("ts").isNull() | ~is_positive("mid")).alias("invalid"))
        summary = summarize_sessions(ticks, frequency=frequency, ordinal=tick_ordinal(ticks))
        touched = touched_sessions(mine("files"))
        if extent.undated:  # all their sessions, those that are there and those that were
            stored = _entered(spark, target, "sessions").select("asset", "session_date")
            every = summary.select("asset", "session_date").unionByName(stored).where(F.col("asset").isin(extent.undated))
            touched = touched.unionByName(every).distinct()
        names = [c for c in _part(spark, target, "sessions").columns if c != "build"]
        sessions = touched.join(summary, ["asset", "session_date"], "left").withColumn(
            "observation_count", F.coalesce("observation_count", F.lit(0)))
        write(sessions.select(*names), "sessions")
        if check and extent.there and met.get["invalid"]:
            raise DataError(f"{met.get['invalid']} invalid timestamps or mid prices")
        names_of = mine("files").select("asset").distinct()  # asset and build are entered, whatever came out
        current = _latest(_entered(spark, target, "sessions", also=build), "asset", "session_date")
        current = current.where("observation_count > 0").drop("build").join(names_of, "asset", "left_semi")
        write(daily_rows(keep_complete(current, **options)), "rows")
        (names_of.withColumn("build", F.lit(build).cast("bigint")).coalesce(1).write.mode("append").parquet(f"{target}/builds"))
    table = read_daily(spark, target)
    return table if wanted is None else table.where(F.col("asset").isin(wanted))


def vacuum_daily(spark: SparkSession, path: str) -> int:
    """Remove what no reader takes: daily rows of superseded builds, and all of builds that were never entered.

    Returns the number of directories removed. No build of this table may be running.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    builds = _part(spark, path, "builds").distinct()
    latest = builds.groupBy("asset").agg(F.max("build").alias("build"))
    removed = 0
    for part in ("rows", "sessions", "files"):
        rows = _part(spark, path, part).select("asset", "build", F.regexp_extract("_metadata.file_path", "^(.*)/", 1).alias("folder"))
        gone = rows.distinct().join(latest if part == "rows" else builds, ["asset", "build"], "left_anti")
        for row in gone.toLocalIterator():
            removed += bool(files.delete(hadoop(row.folder), True))
    return removed

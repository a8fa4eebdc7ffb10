"""Spark session settings that the jobs in this package rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results, so they are set on every session that runs our jobs.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

#: Settings that only change speed. A value the user or the cluster has set is kept.
PREFERRED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Recording the source line of every column expression makes plans slow to build.
QUIET_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Put the required settings on ``spark``; fill in the preferred ones that are unset."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in PREFERRED_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    for key, value in QUIET_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", *, shuffle_partitions: int = 8, app: str = "ripplemark"):
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.files.maxPartitionBytes", "32m")
    )
    for key, value in QUIET_CONF.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark

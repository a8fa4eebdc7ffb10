"""Ascending numbers that writers of one folder share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def claim_number(spark: SparkSession, folder: str, owner: str | None = None) -> int:
    """The next number of ``folder``: above all given before, and given once, whoever else asks meanwhile.

    A number is an empty file that only one writer can create, so the file system has to create files atomically. What an
    ``owner`` (the batch of a stream, say) has been given it gets again, so that repeating its work repeats its number.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    where = path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(where)] if files.exists(where) else []
    if owner is not None:
        given = [int(name.partition("-")[0]) for name in names if name.partition("-")[2] == owner]
        if given:
            return min(given)
    number = 1 + max((int(name.partition("-")[0]) for name in names), default=0)
    while not files.createNewFile(path(f"{folder}/{number:012d}")):
        number += 1
    if owner is not None:
        files.createNewFile(path(f"{folder}/{number:012d}-{owner}"))
    return number

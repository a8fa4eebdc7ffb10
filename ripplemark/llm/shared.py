"""What the operators of this subpackage share: words of Arrow batches, worker state, cut lineage."""

from __future__ import annotations

import sys
import tempfile
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch.
BATCH_ROWS = 2000
#: White space that separates words.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine without the setting, a temporary one."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where is None and context.getCheckpointDir():
        where = context.getCheckpointDir()
    if where is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ripplemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of documents that fit an executor's memory beside its heap.

    Rows here hold whole texts, so the default of 10,000 rows a batch is too many; a setting of the user's stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs a reread only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def worker_state(key: tuple, make: Callable):
    """An object of this Python process by key: tasks that follow on the same worker find it again."""
    holder = sys.modules.get("_ripplemark_worker_state")
    if holder is None:
        holder = sys.modules["_ripplemark_worker_state"] = types.ModuleType("_ripplemark_worker_state")
        holder.kept = {}
    if key not in holder.kept:
        holder.kept[key] = make()
    return holder.kept[key]


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of ``counts`` with the largest ``n``: as many size classes as hold ``most`` rows at most.

    ``counts`` should be stored, since it is read twice. Only the number of rows of each class (some hundred) meets.
    """
    size = F.floor(F.log2(F.col(n)) * 8)
    classes = counts.groupBy(size.alias("size")).count().collect()
    least, held = None, 0
    for row in sorted(classes, key=lambda r: -r["size"]):
        held += row["count"]
        if held > most:
            break
        least = row["size"]
    return counts.where(F.lit(False) if least is None else size >= least)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts, null as empty, in buffers of their own: some Arrow functions misread those of a slice."""
    held = batch.column(column)
    if held.offset:
        held = held.take(pa.array(np.arange(len(held))))
    return pc.fill_null(held.cast(pa.large_string()), "")


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: code of every word in order, offsets of the texts, and the distinct words by code."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.values
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        offsets = before[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.slice(0).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 for every i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` from batches sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        n = table.num_rows
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        for key in keys:
            column = table.column(key).combine_chunks()
            differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), True)
            change[1:] |= differs.to_numpy(zero_copy_only=False).astype(bool)
        first = tuple(table.column(key)[0].as_py() for key in keys)
        change[0] = first != last
        last = tuple(table.column(key)[n - 1].as_py() for key in keys)
        at = 0
        for cut_at in [*np.flatnonzero(change).tolist(), n]:
            if cut_at > at:
                held.append(table.slice(at, cut_at - at))
            if cut_at < n and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            at = cut_at
    if held:
        yield pa.concat_tables(held).combine_chunks()


class Forest:
    """Union-find over 0 .. n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a < b:
            self.up[b] = a
        else:
            self.up[a] = b
        return True


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is connected, for the nodes of ``edges(a, b)``.

    Goes on until no label moves; each round hands each node the smallest label among its neighbours and then the label of its label;
    sums are merged before the shuffle, so a node with very many links is no hot key.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
               .where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = cut(labels)
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        # stored, so that both sides of the next join are dealt for it and Spark may split a large component's nodes
        drawn = cut(labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("now")))
        jumped = drawn.join(
            drawn.select(F.col("node").alias("now"), F.col("now").alias("next")), "now", "left"
        ).select("node", "was", F.least("now", F.coalesce("next", "now")).alias("component"))
        jumped = cut(jumped)
        moved = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("node", "component")
        if not moved:
            return labels

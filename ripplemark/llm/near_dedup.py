"""Near-duplicate documents by a forest of sorted MinHash orders.

A document is its set of distinct word shingles. Equal sets are one node. Every node has one label per tree, a
row of MinHash values; a tree is the nodes in the order of their labels. Nodes whose labels share the base prefix, a common
prefix of four values at least, form a region and are candidates for one another, however many they are: a deeper
prefix in crowded regions would lose links there, so the depth stays and the work is cut into blocks instead.

Inside a region, signatures are compared and only a spanning forest of likely links leaves the task, never its
pairs. Trees together give loose clusters. The full sets of each cluster's nodes then meet once, every pair is
measured exactly, and again only a spanning forest leaves the task. A region or cluster too large for one task is
cut into blocks, and every pair of blocks gets a task, so no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.shared import Forest, components, cut, map_batches, sorted_groups, texts, words
from ripplemark.llm.token_ids import slices

TREES, DEPTH, BASE = 12, 8, 4
#: Nodes of one block of a region; every pair of blocks meets.
REGION = 4096
#: Shingles and nodes of one block of a cluster.
BLOCK_SHINGLES, BLOCK_NODES = 1_000_000, 4096
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    return x ^ (x >> np.uint64(32))


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty for a text without words."""
    codes, offsets, vocabulary = words(pc.ascii_lower(text))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.cast(pa.large_binary()).to_pylist()),
                         dtype=np.uint64, count=len(vocabulary))[codes]
    n = len(hashed)
    grams = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        part = hashed[k:] if k else hashed
        grams[: n - k] = _mixed(grams[: n - k] * _MIX[0] + part)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:  # the whole sequence as one
            x = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                x = _mixed(x * _MIX[0] + hashed[k : k + 1])
            out.append(_mixed(x + np.uint64(1)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20261201).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sign(batches: Iterator[pa.RecordBatch], width: int, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    factors = _multipliers()
    for batch in (some for whole in batches for some in slices(whole, most=4 << 20)):
        sets = shingle_sets(texts(batch), width)
        full = [s for s in sets if len(s)]
        orders = np.empty((len(full), TREES * DEPTH), dtype=">u2")
        for at in range(0, len(full), 500):
            some = full[at : at + 500]
            joined = np.concatenate(some)
            starts = np.concatenate(([0], np.cumsum([len(s) for s in some])[:-1]))
            for j, factor in enumerate(factors):
                least = np.minimum.reduceat(_rotated(joined * factor), starts)
                orders[at : at + 500, j] = (_mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
        rows = iter(range(len(full)))
        at = [next(rows) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
             pa.array([None if i is None else orders[i].tobytes() for i in at], pa.binary()), *(batch.column(c) for c in keep)],
            names=["doc_id", "n_shingles", "set_id", "orders", *keep])


def _rotated(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(32))


def _loose(batches: Iterator[pa.RecordBatch], least_equal: int) -> Iterator[pa.RecordBatch]:
    """Likely links inside each block of a region, or across two, as a spanning forest (a: root, b: node)."""
    out: list[tuple[int, int]] = []
    for region in sorted_groups(batches, ["tree", "prefix", "i", "j"]):
        n = region.num_rows
        if n < 2:
            continue
        ids = region.column("set_id").to_numpy()
        low = np.frombuffer(b"".join(region.column("low").to_pylist()), dtype=np.uint8).reshape(n, -1)
        across = int((region.column("own").to_numpy() == region.column("i")[0].as_py()).sum())
        inner = across == n  # one block; otherwise its nodes have met in a task of their own
        root = np.arange(n)
        for i in range(n - 1 if inner else across):
            # nodes of one tree needn't be compared again, and once everything is one tree nothing is left to find
            first = i + 1 if inner else across
            rest = first + np.flatnonzero(root[first:] != root[i])
            if not len(rest):
                continue
            near = rest[(low[rest] == low[i]).sum(axis=1) >= least_equal]
            if len(near):
                joined = np.unique(np.append(root[near], root[i]))
                root[np.isin(root, joined)] = joined[0]
        out += [(int(ids[r]), int(ids[i])) for i, r in enumerate(root.tolist()) if r != i]
        if len(out) > 20_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in (some for whole in batches for some in slices(whole, most=4 << 20)):
        wanted = batch.column("set_id").to_pylist()
        sets = shingle_sets(texts(batch), width)
        right = [i for i, s in enumerate(sets) if len(s) and set_id(s) == wanted[i]]
        some = batch.take(pa.array(right, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [some.column("set_id"), some.column("cluster"), some.column("blocks"),
             pa.array([sets[i].tobytes() for i in right], pa.binary())],
            names=["set_id", "cluster", "blocks", "shingles"])


def _linked(sets: list[np.ndarray], percent: int, forest: Forest) -> None:
    """Joins every two sets whose similarity is at least ``percent`` / 100."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                small, large = sorted((int(sizes[i]), int(sizes[j])))
                if 100 * small >= percent * large and forest.root(i) != forest.root(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (small + large - both):
                        forest.join(i, j)
        return
    owner = np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1  # a shingle of one set is in no intersection
    owner, code = owner[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    by_code = np.argsort(code, kind="stable")
    owner, code = owner[by_code], code[by_code]
    n_codes = int(code[-1]) + 1 if len(code) else 0
    edges = np.searchsorted(code, np.arange(0, n_codes + 512, 512))
    for top in range(0, n, 512):
        rows = min(512, n - top)
        both = np.zeros((rows, n), dtype=np.float32)
        for k in range(len(edges) - 1):
            part = slice(edges[k], edges[k + 1])
            have = np.zeros((n, 512), dtype=np.float32)
            have[owner[part], code[part] - 512 * k] = 1
            both += have[top : top + rows] @ have.T
        both = both.astype(np.int64)
        union = sizes[top : top + rows, None] + sizes[None, :] - both
        i, j = np.nonzero(np.triu(100 * both >= percent * union, 1 + top))
        for a, b in zip((i + top).tolist(), j.tolist(), strict=True):
            forest.join(a, b)


def _exact(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for group in sorted_groups(batches, ["cluster", "i", "j"]):
        ids, first = np.unique(group.column("set_id").to_numpy(), return_index=True)
        if len(ids) < 2:
            continue
        raw = group.column("shingles").combine_chunks()
        sets = [np.frombuffer(raw[int(k)].as_py(), dtype=np.uint64) for k in first]
        forest = Forest(len(ids))
        _linked(sets, percent, forest)
        out += [(int(ids[r]), int(ids[i])) for i in range(len(ids)) if (r := forest.root(i)) != i]
        if len(out) > 20_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles have ``width`` words, and a shorter
    text is one shingle. Documents with ``100 * intersection >= percent * union`` are linked. component_id is the
    smallest doc_id reachable; kept means doc_id = component_id. A null or wordless text has no set and is linked
    with nothing. Rows that repeat a doc_id keep their rows. A row without doc_id is linked by its text; its
    component_id is the smallest doc_id there, or null if there is none, and then kept is true.

    With ``keep``, columns of ``docs`` to pass through, there is also group_id: one number per component, null without a
    set, which tells components of rows that repeat a doc_id apart.

    A link of similarity s is a candidate with probability 1 - (1 - s^4)^12 (0.9999 at 0.85, 0.998 at 0.8) before
    links over third documents; candidates are confirmed on full sets.
    """
    own = docs.select("doc_id", "text")
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    signed = cut(map_batches(docs.select("doc_id", "text", *keep), partial(_sign, width=width, keep=keep),
                             "doc_id long, n_shingles long, set_id long, orders binary" + kinds))
    nodes = (signed.where("set_id is not null").groupBy("set_id")
             .agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("orders").alias("orders")))
    nodes = cut(nodes)

    share = percent / 100
    least_equal = int(TREES * DEPTH * (share - 4 * (share * (1 - share) / (TREES * DEPTH)) ** 0.5))
    prefix = F.expr(f"substring(orders, tree * {2 * DEPTH} + 1, {2 * BASE})")
    rows = (nodes.withColumn("low", F.unhex(F.regexp_replace(F.hex("orders"), "..(..)", "$1")))
            .select("set_id", "orders", "low", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
            .select("set_id", "low", "tree", prefix.alias("prefix")))
    slim = nodes.select("orders", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "tree", prefix.alias("prefix"))
    crowded = (slim.groupBy("tree", "prefix").count().where(F.col("count") > REGION)
               .select("tree", "prefix", F.ceil(F.col("count") / REGION).cast("int").alias("blocks")))
    regions = (rows.join(crowded, ["tree", "prefix"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
               .withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("tree", "prefix", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       "own", "set_id", "low"))
    count = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    loose = (regions.repartition(int(count), "tree", "prefix", "i", "j")
             .sortWithinPartitions("tree", "prefix", "i", "j", "own", "set_id")
             .mapInArrow(partial(_loose, least_equal=least_equal), "a long, b long"))
    clusters = components(loose).withColumnsRenamed({"node": "set_id", "component": "cluster"})

    # only the texts of clustered nodes are read again, once each
    members = cut(clusters.join(nodes.select("set_id", "least", "n"), "set_id"))
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("many"))
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("many") / BLOCK_NODES)).cast("int")
    members = (members.join(sizes, "cluster")
               .select(F.col("least").alias("doc_id"), "set_id", "cluster", blocks.alias("blocks")))
    found = (own.join(members.hint("shuffle_hash"), own["doc_id"].eqNullSafe(members["doc_id"]))
             .select("text", "set_id", "cluster", "blocks")
             .mapInArrow(partial(_full_sets, width=width), "set_id long, cluster long, blocks int, shingles binary"))
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    dealt = (found.withColumn("own", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "set_id", "shingles"))
    strict = (dealt.repartition(int(count), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
              .mapInArrow(partial(_exact, percent=percent), "a long, b long"))
    linked = components(strict).withColumnsRenamed({"node": "set_id"})

    named = nodes.select("set_id", "least").join(linked, "set_id", "left").select(
        "set_id", "least", F.coalesce("component", "set_id").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("set_id", "component_id", F.col("component").alias("group_id"))
    return (signed.select("doc_id", "n_shingles", "set_id", *keep).join(named, "set_id", "left")
            .select("doc_id", "n_shingles", *keep, *(["group_id"] if keep else []),
                    F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))

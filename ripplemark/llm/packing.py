"""Best-fit packing of documents into sequences, with bounds that certify each part.

Pieces are dealt into parts of a bounded number of pieces. Each part is packed best-fit decreasing, and
dual-feasible functions bound from below how many sequences its pieces need. While
all parts together use more than the bound of all pieces, they exchange pieces: a part above its own bound gives up all
sequences that have room left, any other part its loose ends, the sequences with a sixteenth of their room. What is
given up is dealt anew, into parts twice as large for four rounds, and packed again, until the bound is met, one part is
left, or a round saves nothing. Sequences without room never change.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.shared import cut, map_batches, sorted_groups, texts
from ripplemark.llm.token_ids import WordIds, slices

#: Pieces of one part in the first round, about, and how often that number is doubled; a task holds one part.
PART, DOUBLED = 16_384, 4


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Sequences of ``capacity`` that ``lengths`` need at least, by two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    many = np.bincount(lengths, counts, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    count, volume = np.cumsum(many), np.cumsum(many * size)
    # pieces below t count nothing, pieces above capacity - t a whole sequence
    t = np.arange(1, capacity // 2 + 1)
    whole = count[-1] - count[capacity - t]
    between = volume[capacity - t] - volume[t - 1]
    best = int(np.max(-(-(whole * capacity + between) // capacity), initial=-(-volume[-1] // capacity)))
    for k in range(1, 24):
        scaled = (k + 1) * size
        worth = np.where(scaled % capacity == 0, k * size, capacity * (scaled // capacity))
        best = max(best, int(-(-np.sum(worth * many) // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and place of each piece, and the number of sequences: best-fit decreasing."""
    where = np.zeros(len(lengths), dtype=np.int64)
    place = np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, chosen, used = capacity, used, used + 1
        where[i], place[i] = chosen, capacity - room
        if left := room - need:
            by_room[left].append(chosen)
            mask |= 1 << left
    return where, place, used


def _cut_up(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    model = WordIds.of(tokenizer)
    for batch in batches:
        for some in slices(batch):
            ids, offsets = model.encode(texts(some))
            keys = some.column("doc_id").to_pylist()
            rows = []
            for key, a, b in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append((key, piece, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])


def _pack(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    for part in sorted_groups(batches, ["part"]):
        lengths = part.column("length").to_numpy()
        where, place, used = best_fit(lengths, capacity)
        room = capacity - np.bincount(where, weights=lengths).astype(np.int64)
        n = len(lengths)
        part = part.append_column("bin", pa.array(where)).append_column("offset", pa.array(place))
        part = part.append_column("room", pa.array(room[where]))
        part = part.append_column("gap", pa.array(np.full(n, used - lower_bound(lengths, capacity), dtype=np.int64)))
        yield from part.to_batches()


_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, part long"


def _packed(pieces: DataFrame, round_no: int, parts: int, capacity: int) -> DataFrame:
    """``pieces`` dealt into parts by their stored row number and packed; kept in the shared folder."""
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(parts)))
    packed = (dealt.repartition(parts, "part").sortWithinPartitions("part", "row")
              .mapInArrow(partial(_pack, capacity=capacity), f"{_FIELDS}, bin long, offset long, room long, gap long"))
    return cut(packed.withColumn("round", F.lit(round_no)))


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, part: int = PART) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: where it lies.

    A document is its ids by the tokenizer file and ``end_id``; a null or empty text is the end id alone. Only a
    document longer than ``capacity`` is cut, into pieces of that length and a last one that may be shorter.
    Columns: doc_id, piece, start (ids of the document before the piece), length, ids_crc32, sequence_id, offset, and
    gap: how many sequences the part of this sequence has beyond its certified bound (0: none could be saved there).
    Rows that repeat a doc_id, or have none, are documents of their own. An empty table gives no row.
    """
    pieces = map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        partial(_cut_up, tokenizer=tokenizer, end_id=end_id, capacity=capacity),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    ).withColumn("row", F.monotonically_increasing_id())
    pieces = cut(pieces)
    total = pieces.count()
    state = _packed(pieces, 0, max(1, -(-total // part)), capacity)
    settled: list[DataFrame] = []
    lengths = pieces.groupBy("length").count().toArrow()  # a row per length at most
    least = lower_bound(lengths["length"].to_numpy(), capacity, lengths["count"].to_numpy())
    used = state.select("part", "bin").distinct().count()
    loose = (F.col("room") > 0) & ((F.col("gap") > 0) | (F.col("room") >= capacity // 16))
    for round_no in count(1):
        if used <= least:
            break
        use = (state.where(loose).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("bin").alias("bins"))
               .agg(F.sum("n"), F.sum("bins"), F.count("*")).first())
        if not use[0] or use[2] < 2:
            break
        again = _packed(state.where(loose).select(*pieces.columns), round_no, max(1, -(-use[0] // (part << min(round_no, DOUBLED)))), capacity)
        now = again.select("part", "bin").distinct().count()
        if now >= use[1]:
            break
        used += now - use[1]
        settled.append(state.where(~loose))
        state = again
    for done in settled:
        state = state.unionByName(done)
    name = F.col("round") * F.lit(1 << 50) + F.col("part") * F.lit(1 << 20) + F.col("bin")
    return state.select("doc_id", "piece", "start", "length", "ids_crc32", name.alias("sequence_id"), "offset", "gap")

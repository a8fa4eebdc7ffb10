"""Token ids in files of independent zstandard frames.

A file is, in order:

* one zstandard frame per document, whose content is the ids, little-endian, 2 or 4 bytes each;
* a skippable frame (magic 0x184D2A50) with the index: one byte for the bytes of an id, then per document the
  doc_id (8 bytes), a byte that says whether there is one, and in blocks of columns: all doc_ids, then all flags;
* a seek table in the public seekable layout: a skippable frame (magic 0x184D2A5E) with one entry per frame before
  it (compressed size, content size, low 32 bits of the content's XXH64, 4 bytes each), the number of entries, a
  descriptor byte that says entries have checksums, and the magic 0x8F92EAB1.

A plain zstandard reader that skips skippable frames gets all ids of the file. A reader of some documents reads the
end of the file, finds their frames, and decompresses those alone. Files are written under names that no other attempt
uses, and only the manifest, which Spark commits, says which ones count; a file of a lost task is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.llm.shared import cut, map_batches, texts
from ripplemark.llm.token_ids import WordIds, slices

#: Fixed values of the public frame formats.
INDEX_MAGIC, TABLE_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("content", "<u4"), ("check", "<u4")])
MANIFEST = "part int, path string, first_doc long, last_doc long, n_docs long, n_ids long"


def check_of(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class Writer:
    """Writes one file; documents in the order they come."""

    def __init__(self, sink, id_bytes: int, level: int = 1):
        self.sink, self.id_bytes = sink, id_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        content = ids.astype(f"<u{self.id_bytes}").tobytes()
        packed = self.packer.compress(content)
        self.sink.write(packed)
        self.entries.append((len(packed), len(content), check_of(content)))
        self.docs.append(doc_id)
        self.n_ids += len(ids)

    def close(self) -> None:
        docs = np.array([0 if d is None else d for d in self.docs], dtype="<i8")
        there = np.array([d is not None for d in self.docs], dtype="u1")
        index = bytes([self.id_bytes]) + docs.tobytes() + there.tobytes()
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array([*self.entries, (len(index) + 8, 0, check_of(b""))], dtype=ENTRY).tobytes()
        foot = struct.pack("<IBI", len(self.entries) + 1, CHECKSUMS, FOOT_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(table) + len(foot)) + table + foot)
        self.sink.close()


class Reader:
    """Reads the end of a file, and then the documents asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - n * ENTRY.itemsize
        kind, length = struct.unpack("<II", self._at(start - 8, 8))
        if kind != TABLE_MAGIC or length != n * ENTRY.itemsize + 9:
            raise ValueError("damaged seek table")
        table = np.frombuffer(self._at(start, n * ENTRY.itemsize), dtype=ENTRY)
        self.entries = table[:-1]
        self.starts = np.concatenate(([0], np.cumsum(table["packed"].astype(np.int64))))
        index = self._at(int(self.starts[n - 1]) + 8, int(table["packed"][-1]) - 8)
        self.id_bytes = index[0]
        n_docs = n - 1
        self.docs = np.frombuffer(index, dtype="<i8", count=n_docs, offset=1)
        self.there = np.frombuffer(index, dtype="u1", count=n_docs, offset=1 + 8 * n_docs).astype(bool)
        self.lengths = self.entries["content"].astype(np.int64) // self.id_bytes
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def _content(self, packed: bytes, k: int) -> np.ndarray:
        content = self.unpacker.decompress(packed, max_output_size=max(1, int(self.entries["content"][k])))
        if check_of(content) != int(self.entries["check"][k]):
            raise ValueError(f"checksum of frame {k} differs")
        return np.frombuffer(content, dtype=f"<u{self.id_bytes}")

    def read(self, wanted: np.ndarray, ahead: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of the frames numbered ``wanted``, ascending; neighbours are fetched together."""
        at = 0
        while at < len(wanted):
            to = at + 1
            first = int(self.starts[wanted[at]])
            while to < len(wanted) and wanted[to] == wanted[to - 1] + 1 and self.starts[wanted[to] + 1] - first < ahead:
                to += 1
            block = self._at(first, int(self.starts[wanted[to - 1] + 1]) - first)
            for k in wanted[at:to].tolist():
                yield k, self._content(block[int(self.starts[k]) - first : int(self.starts[k + 1]) - first], k)
            at = to


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    batches = (b for b in batches if b.num_rows)
    first = next(batches, None)
    if first is None:
        return
    part = TaskContext.get().partitionId()
    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
    where, inner = fs.FileSystem.from_uri(path)
    where.create_dir(inner.rpartition("/")[0], recursive=True)
    model = WordIds.of(tokenizer)
    largest = max(model.tokenizer.get_vocab_size(), end_id + 1)
    out = Writer(where.open_output_stream(inner, compression=None), 2 if largest <= 1 << 16 else 4)

    def rest():
        yield first
        yield from batches

    for batch in rest():
        for some in slices(batch):
            ids, offsets = model.encode(texts(some))
            keys = some.column("doc_id").to_pylist()
            for key, a, b in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                out.add(key, np.append(ids[a:b], np.uint32(end_id)))
    out.close()
    known = [d for d in out.docs if d is not None]
    yield pa.RecordBatch.from_pylist([{
        "part": part, "path": path, "first_doc": min(known, default=None), "last_doc": max(known, default=None),
        "n_docs": len(out.docs), "n_ids": out.n_ids}], pa.schema([
            ("part", pa.int32()), ("path", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
            ("n_docs", pa.int64()), ("n_ids", pa.int64())]))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2,
                      docs_per_file: int = 50_000) -> DataFrame:
    """Writes ``docs(doc_id, text)`` in ascending doc_id order (without one: first; ties by text); the manifest.

    ``folder`` is a URI that all executors can write to. The manifest has a row per file, with ``start``: the ids in
    all files before. A null or empty text is the end id alone. An empty table makes no file.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_files = max(shuffles, -(-own.count() // docs_per_file))
    ordered = own.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "text")
    written = cut(map_batches(ordered, partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id), MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            where, inner = fs.FileSystem.from_uri(row["path"])
            with where.open_input_file(inner) as source:
                file = Reader(source)
                before = np.concatenate(([0], np.cumsum(file.lengths))) + row["start"]
                frames = np.arange(len(file.docs)) if wanted is None else np.flatnonzero(
                    file.there & np.isin(file.docs, wanted))
                rows: list[tuple] = []
                held = 0
                for k, ids in file.read(frames):
                    ids = ids.astype("<u4")
                    rows.append((int(file.docs[k]) if file.there[k] else None, int(before[k]), len(ids),
                                 zlib.crc32(ids.tobytes()), ids if with_ids else None))
                    held += len(ids)
                    if len(rows) >= 10_000 or with_ids and held > 4 << 20:
                        yield _rows(rows, with_ids)
                        rows, held = [], 0
                yield _rows(rows, with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    n = 5 if with_ids else 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names=names[:n])


def read_token_files(manifest: DataFrame, *, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents, or of the few named, from the files.

    Only files whose range has a named document are opened, and only its frames are decompressed.
    """
    wanted = None if doc_ids is None else np.array(sorted(set(doc_ids)), dtype=np.int64)
    files = manifest.select("part", "path", "first_doc", "last_doc", "start")
    if wanted is not None:
        inside = F.exists(F.array(*[F.lit(int(d)) for d in wanted]) if len(wanted) else F.array().cast("array<long>"),
                          lambda d: d.between(F.col("first_doc"), F.col("last_doc")))
        files = files.where(inside)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return files.repartition(n, "part").mapInArrow(partial(_read, wanted=wanted, with_ids=with_ids), kind)

"""Reversed ranked search: documents stream past an index of the items, not the other way round.

The items' terms form an inverted index (term, items that have it, how often), which is broadcast. One pass over the
documents takes the statistics the ranking needs, a second one turns each document's counts of those terms into scores
of all items they touch and keeps the best of every item in a table of fixed size per task; the tables are merged.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.llm.shared import cut, map_batches, ragged, texts, words, worker_state
from ripplemark.llm.token_ids import slices

#: Items and postings of one broadcast index; more items go in further blocks, a pass over the documents each.
ITEMS, POSTINGS = 4_096, 200_000
#: Places of the table of scores that one step fills (documents x items).
CELLS = 1 << 21
#: Scores below this are exact as double sums; beyond it a step adds them as whole numbers.
EXACT = 1 << 53
#: Tasks whose tables meet in one group of the first merge.
MERGED = 64


def _folding() -> bytes:
    """For each byte what the term splitter makes of it: letters and digits stay, A-Z in lower case, other ASCII a space."""
    table = bytearray(range(256))
    for b in range(128):
        if not chr(b).isalnum():
            table[b] = 32
        elif chr(b).isupper():
            table[b] = b + 32
    return bytes(table)


_FOLD = _folding()


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of each text: the code of every term in order, offsets of the texts, the distinct terms by code.

    Bytes from 0x80 on, all of characters beyond ASCII, belong to terms; so folding bytes is folding characters.
    """
    _, offsets, content = text.buffers()
    if content is not None:
        content = pa.py_buffer(content.to_pybytes().translate(_FOLD))
    return words(pa.LargeStringArray.from_buffers(len(text), offsets, content))


class Index:
    """The inverted index of a block of items: for each term the items that have it, and how often."""

    def __init__(self, vocabulary: list[str], starts: np.ndarray, item: np.ndarray, times: np.ndarray):
        self.starts, self.item, self.times = starts, item, times
        self.terms = pa.array(vocabulary, pa.large_string())

    @staticmethod
    def plain(counted: list[Counter]) -> tuple:
        """Its parts as plain values, which can be broadcast."""
        vocabulary = sorted({t for c in counted for t in c})
        place = {t: k for k, t in enumerate(vocabulary)}
        entries = np.array(sorted((place[t], k, n) for k, c in enumerate(counted) for t, n in c.items()), dtype=np.int64)
        entries = entries.reshape(-1, 3)
        starts = np.searchsorted(entries[:, 0], np.arange(len(vocabulary) + 1))
        return vocabulary, starts, entries[:, 1].copy(), entries[:, 2].copy()

    @classmethod
    def of(cls, sent) -> Index:
        """The broadcast index; a worker keeps that of the last block."""
        number, *parts = sent.value
        kept = worker_state(("item index",), dict)
        if number not in kept:
            kept.clear()
            kept[number] = cls(*parts)
        return kept[number]

    def counts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of terms of each text, and (text, term of the index, occurrences) of what it has of the index."""
        codes, offsets, vocabulary = terms(text)
        known = pc.fill_null(pc.index_in(vocabulary, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        known = known.astype(np.int64)[codes]
        hit = known >= 0
        row = np.repeat(np.arange(len(text)), np.diff(offsets))[hit]
        n = max(1, len(self.terms))
        pair, times = np.unique(row * n + known[hit], return_counts=True)
        return np.diff(offsets), pair // n, pair % n, times.astype(np.int64)


def _counted(text: str | None) -> Counter:
    codes, _, vocabulary = terms(pa.array([text or ""], pa.large_string()))
    return Counter(vocabulary.take(pa.array(codes)).to_pylist())


def _statistics(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(term, n): documents with each term; under -1 documents with any term at all, under -2 the terms of them."""
    index = Index.of(sent)
    frequency = np.zeros(len(index.terms), dtype=np.int64)
    n_docs = n_terms = 0
    for batch in batches:
        for some in slices(batch):
            n, _, term, _ = index.counts(texts(some))
            frequency += np.bincount(term, minlength=len(frequency))
            n_docs += int((n > 0).sum())
            n_terms += int(n.sum())
    there = np.flatnonzero(frequency)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((there, [-1, -2])), pa.int64()),
         pa.array(np.concatenate((frequency[there], [n_docs, n_terms])), pa.int64())], names=["term", "n"])


class Heaps:
    """The best ``k`` (score, doc_id) of every item: higher scores first, then smaller doc_ids, rows without one last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, dtype=np.int64)  # what a score has to reach
        nothing = np.empty(0, dtype=np.int64)
        self.held = (nothing, nothing, nothing, nothing.astype(bool))  # item, score, doc_id, without doc_id

    def add(self, *new: np.ndarray) -> None:
        item, score, doc, none = (np.concatenate(pair) for pair in zip(self.held, new, strict=True))
        order = np.lexsort((doc, none, -score, item))
        ordered = item[order]
        order = order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < self.k]
        self.held = item[order], score[order], doc[order], none[order]
        n = np.bincount(self.held[0], minlength=len(self.least))
        full = n == self.k
        self.least[full] = self.held[1][np.cumsum(n) - 1][full]


def _scores(index: Index, rows: int, n_items: int, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The table of scores of ``rows`` documents: every posting of every term they have adds its value."""
    length = index.starts[term + 1] - index.starts[term]
    posting = ragged(index.starts[term], length)
    cell = np.repeat(row * n_items, length) + index.item[posting]
    worth = np.repeat(value, length) * index.times[posting]
    if worth.sum(dtype=np.float64) < EXACT:
        return np.bincount(cell, worth, rows * n_items).astype(np.int64).reshape(rows, n_items)
    table = np.zeros(rows * n_items, dtype=np.int64)
    np.add.at(table, cell, worth)
    return table.reshape(rows, n_items)


def _best(batches: Iterator[pa.RecordBatch], sent, ranking, k: int) -> Iterator[pa.RecordBatch]:
    index = Index.of(sent)
    weights, n_docs, n_terms, item_ids = ranking.value
    n_items = len(item_ids)
    heaps = Heaps(n_items, k)
    for batch in batches:
        for some in slices(batch):
            n, row, term, times = index.counts(texts(some))
            doc = some.column("doc_id").cast(pa.int64())
            none = pc.is_null(doc).to_numpy(zero_copy_only=False).astype(bool)
            doc = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False)
            m = 25 + 75 * n.astype(np.int64) * n_docs // max(1, n_terms)
            value = weights[term] * (1_000_000_000 * times // (1000 * times + 8 * m[row]))
            before = np.concatenate(([0], np.cumsum(np.bincount(row, index.starts[term + 1] - index.starts[term], len(n)))))
            entry = np.searchsorted(row, np.arange(len(n) + 1))
            at = 0
            while at < len(n):
                to = int(np.searchsorted(before, before[at] + CELLS, side="right")) - 1
                to = max(at + 1, min(to, at + CELLS // n_items, len(n)))
                mine = slice(entry[at], entry[to])
                table = _scores(index, to - at, n_items, row[mine] - at, term[mine], value[mine])
                r, item = np.nonzero(table >= heaps.least)
                if len(r):
                    heaps.add(item, table[r, item], doc[at + r], none[at + r])
                at = to
    item, score, doc, none = heaps.held
    ids = pa.array(item_ids, pa.int64()).take(pa.array(item))
    yield pa.RecordBatch.from_arrays(
        [pa.array(item, pa.int32()), ids, pa.array(doc, pa.int64(), mask=none), pa.array(score, pa.int64()),
         pa.array(np.full(len(item), TaskContext.get().partitionId() // MERGED), pa.int32())],
        names=["item", "item_id", "doc_id", "score", "task"])


def _ranked(heaps: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(own: DataFrame, counted: list[Counter], item_ids: list[int | None], k: int) -> DataFrame:
    context = own.sparkSession.sparkContext
    plain = Index.plain(counted)
    sent = context.broadcast((uuid.uuid4().hex, *plain))
    found = (map_batches(own, partial(_statistics, sent=sent), "term long, n long")
             .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    n = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist(), strict=True))
    n_docs, n_terms = n.get(-1, 0), n.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n.get(t, 0) + 1))) for t in range(len(plain[0]))],
                       dtype=np.int64)
    ranking = context.broadcast((weights, n_docs, n_terms, item_ids))
    heaps = map_batches(own, partial(_best, sent=sent, ranking=ranking, k=k),
                        "item int, item_id long, doc_id long, score long, task int")
    best = cut(_ranked(_ranked(heaps, ["item", "task"], k), ["item"], k).select("item_id", "rank", "doc_id", "score"))
    sent.destroy()
    ranking.destroy()
    return best


def search(docs: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every row of ``items(item_id, text)``.

    Terms are runs of ASCII letters and digits and all characters beyond ASCII, A-Z in lower case. Scores are whole
    numbers: of each term of the item, repeats included, a weight that falls with the documents that have it, times how
    far its occurrences in the document saturate, longer documents later. Only scores above 0 count. Equal scores rank by
    doc_id, rows without one last; rows that repeat a doc_id each count; items that repeat an item_id, or have none, are
    searched each and ranked apart. An item without terms, a null text and an empty table find nothing. Every document is
    scored for every item. Extra columns don't matter.

    Items are read a partition at a time and searched in blocks of bounded size, each in two passes over the documents.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text")
    results: list[DataFrame] = []
    counted: list[Counter] = []
    item_ids: list[int | None] = []
    held = 0
    for item_id, text in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        count = _counted(text)
        if not count:
            continue
        if held + len(count) > POSTINGS and held or len(counted) == ITEMS:
            results.append(_search_block(own, counted, item_ids, k))
            counted, item_ids, held = [], [], 0
        counted.append(count)
        item_ids.append(item_id)
        held += len(count)
    if counted or not results:
        results.append(_search_block(own, counted or [Counter()], item_ids or [None], k))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found

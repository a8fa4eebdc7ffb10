"""Token counts of whole texts by a two-tier lookup of pre-tokens on the map side.

First tier: a table of frequent pre-tokens and their lengths, the same for all workers, broadcast. Second tier: each
worker's own memory of the pre-tokens that the table lacks, which it encodes when it meets them. Pre-tokens are never
shuffled; what tasks hand over for the table is a bounded number of their most frequent ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.shared import cut, map_batches, most_frequent, texts, worker_state
from ripplemark.llm.token_ids import slices

#: Entries of the broadcast table (about 1 MB), and what one task contributes to it at most.
TABLE, PER_TASK = 32_768, 8_192
#: Texts that a model which normalises would change: case, width, ligatures, marks, white space.
PROBES = ("Ab ß", "Ａﬁ²", "e\u0301 é", "a  b", "c\td\n")
#: Pre-tokens a worker remembers beyond the table.
REMEMBERED = 300_000


def pretokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What lies between single spaces, one after another, and the offsets of the texts."""
    lists = pc.split_pattern(text, " ")
    return lists.values, lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's most frequent pre-tokens; rare ones are forgotten on the way, so memory is bounded."""
    seen: Counter[str] = Counter()
    for batch in batches:
        for some in slices(batch):
            found, _ = pretokens(texts(some))
            counts = pc.value_counts(found)
            top = counts.take(pc.select_k_unstable(
                counts.field("counts"), min(4 * PER_TASK, len(counts)), [("x", "descending")])) if len(counts) else counts
            seen.update(dict(zip(top.field("values").to_pylist(), top.field("counts").to_pylist(), strict=True)))
            if len(seen) > 16 * PER_TASK:
                seen = Counter(dict(seen.most_common(4 * PER_TASK)))
    top = seen.most_common(PER_TASK)
    yield pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])


class _Lengths:
    """Token counts of pre-tokens by a sentencepiece model, remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(re.search("[^▁]▁", model.id_to_piece(k)) for k in range(model.get_piece_size())):
            raise ValueError("the model has pieces that reach over a space")
        if any(model.normalize(probe) != "▁" + probe.replace(" ", "▁") for probe in PROBES):
            raise ValueError("the model normalises texts")
        self.known: dict[str, int] = {}

    def encode(self, some: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(some, num_threads=1)] if some else []

    def of(self, some: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if unknown := [w for w in some if w not in known]:
            known.update(zip(unknown, self.encode(unknown), strict=True))
        return [known[w] for w in some]


def _count(batches: Iterator[pa.RecordBatch], path: str, table) -> Iterator[pa.RecordBatch]:
    model = worker_state(("piece lengths", path), lambda: _Lengths(path))
    frequent, lengths = table.value
    frequent = pa.array(frequent, pa.large_string())
    for batch in batches:
        for some in slices(batch):
            text = texts(some)
            found, offsets = pretokens(text)
            coded = found.dictionary_encode()
            distinct = coded.dictionary
            row = pc.fill_null(pc.index_in(distinct, value_set=frequent), -1).to_numpy(zero_copy_only=False)
            length = np.where(row >= 0, np.append(lengths, 0)[row], 0).astype(np.int64)
            missed = np.flatnonzero(row < 0)
            length[missed] = model.of(distinct.take(pa.array(missed)).to_pylist())
            codes = coded.indices.to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(length[codes])))[offsets]
            n = ends[1:] - ends[:-1]
            # runs of spaces, spaces at an end and the space sign itself: the text as a whole
            blank = pc.index_in(pa.array([""], pa.large_string()), value_set=distinct)[0].as_py()
            odd = pc.match_substring(text, "▁").to_numpy(zero_copy_only=False).astype(bool)
            if blank is not None:
                at = np.concatenate(([0], np.cumsum(codes == blank)))[offsets]
                odd |= at[1:] > at[:-1]
            if odd.any():
                n[odd] = model.encode(text.filter(pa.array(odd)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id").cast(pa.int64()), pc.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, model: str, *, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs(doc_id, text)``.

    ``model`` is a sentencepiece file whose pieces have the space sign at their start only and whose texts aren't
    normalised, so that a text is the pre-tokens between single spaces, each with the sign before it. Counts equal
    the library's for the whole text, without begin or end. Other models are refused. Null text: empty, 0 tokens. Every row stays.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text")
    seen = cut(map_batches(own, _frequent, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    frequent = [r.word for r in most_frequent(seen, "n", TABLE).select("word").collect()]
    table = (frequent, np.array(_Lengths(model).encode(frequent), dtype=np.int32))
    counted = own.mapInArrow(partial(_count, path=model, table=docs.sparkSession.sparkContext.broadcast(table)),
                             "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""A bigram language model held in log-frequency Bloom filters, and the scores of texts by it.

Counts are quantised to levels, level q for counts from 2^(q-1) to 2^q - 1, and an n-gram of level q is in the filter
once for each level up to q; a reader probes level after level until one is missing. A filter has 12 bits an entry,
in segments of 128 KB, each built by one task.

Words have a filter of their own, which is broadcast whole; pairs have theirs broadcast in groups of segments of bounded
size, a pass over the texts for each. A token's chance needs its pair, its word and the word before, so it is found wholly in the
pass that has its pair; a pass hands on one sum per text, and the sums of all passes add up.

All words and all pairs are in the filters. Exact counts, for the base score, are joined by word; the most frequent ones are looked up before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.shared import cut, map_batches, most_frequent, sorted_groups, texts, words
from ripplemark.llm.token_ids import slices

#: Bits of a segment, bits per entry, probes per entry.
SEGMENT_BITS, ENTRY_BITS, PROBES = 1 << 20, 12, 6
#: Segments of pairs broadcast at a time (128 MB).
GROUP = 1024
#: Words whose exact counts are looked up without a shuffle (2 MB).
HEAD = 131_072
#: Least and most weight of a pair's frequency beside the word's own.
WEIGHT = (0.02, 0.9)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_END = np.uint64(0x5BD1E9955BD1E994)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


class Tokens:
    """Tokens of some texts: words, A-Z lower-cased, and one end for each text. Keys of words are even, of pairs odd."""

    def __init__(self, text: pa.Array):
        codes, offsets, distinct = words(pc.ascii_lower(text))
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_numpy(zero_copy_only=False)), dtype=np.uint64,
                             count=len(distinct))
        n_text = len(offsets) - 1
        self.offsets = offsets + np.arange(n_text + 1)
        self.distinct = np.append(hashed, _END) & ~np.uint64(1)
        self.codes = np.full(self.offsets[-1], len(hashed), dtype=np.int64)
        ends = self.offsets[1:] - 1
        inner = np.ones(self.offsets[-1], dtype=bool)
        inner[ends] = False
        self.codes[inner] = codes
        self.words = self.distinct[self.codes]
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[self.offsets[:-1]] = _END  # a text begins where another could have ended
        self.before = before
        self.pairs = _mixed(before * _A + self.words) | np.uint64(1)

    def summed(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.offsets[:-1]) if len(self.offsets) > 1 else np.zeros(0, x.dtype)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (some for whole in batches for some in slices(whole)):
        tokens = Tokens(texts(batch))
        counted = (tokens.distinct, np.bincount(tokens.codes, minlength=len(tokens.distinct))), np.unique(tokens.pairs, return_counts=True)
        for key, n in counted:
            for at in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], names=["key", "n"])


def levels_of(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1]


def counts_of(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    return np.where(level > 0, 1.5 * 2.0 ** (level.astype(np.int64) - 1) - 0.5, 0.0)


def _start(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and stride of the probes for a key at a level."""
    start = _mixed(key + np.uint64(level * int(_A) & (1 << 64) - 1))
    return start, (start >> np.uint64(20)) | np.uint64(1)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in sorted_groups(batches, ["segment"]):
        key = group.column("key").to_numpy().view(np.uint64)
        level = levels_of(group.column("n").to_numpy())
        bits = np.zeros(SEGMENT_BITS, dtype=bool)
        for q in range(1, int(level.max()) + 1):
            start, step = _start(key[level >= q], q)
            for k in range(PROBES):
                bits[(start + np.uint64(k) * step) & np.uint64(SEGMENT_BITS - 1)] = True
        yield pa.RecordBatch.from_arrays(
            [group.column("segment").combine_chunks().slice(0, 1), pa.array([np.packbits(bits).tobytes()])],
            names=["segment", "bits"])


class Filter:
    """Some consecutive segments of a filter."""

    def __init__(self, bits: np.ndarray, first: int, n_segments: int):
        self.bits, self.first, self.n_segments = bits, first, n_segments
        self.held = len(bits) * 8 // SEGMENT_BITS

    def has(self, key: np.ndarray) -> np.ndarray:
        """Whether the segment of each key is here."""
        segment = (key.view(np.int64) >> 1) % self.n_segments - self.first
        return (segment >= 0) & (segment < self.held)

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Level of each key, whose segments are all here."""
        found = np.zeros(len(key), dtype=np.uint8)
        here = np.arange(len(key))
        base = ((key.view(np.int64) >> 1) % self.n_segments - self.first) * (SEGMENT_BITS // 8)
        q = 1
        while len(here):
            there = np.arange(len(here))
            start, step = _start(key[here], q)
            for k in range(PROBES):  # most keys that aren't there are told by the first probe or two
                place = ((start + np.uint64(k) * step) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)
                hit = ((self.bits[base[there] + (place >> 3)] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)
                there, start, step = there[hit], start[hit], step[hit]
            here, base = here[there], base[there]
            found[here] = q
            q += 1
        return found


class Model:
    """Counts of the training texts: the filters' segments and exact counts of words."""

    def __init__(self, docs: DataFrame):
        counts = map_batches(docs.select("text"), _grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        self.counts = cut(counts)
        self.is_word = F.col("key").bitwiseAND(F.lit(1)) == 0
        level = F.floor(F.log2(F.col("n")) + 1e-12) + 1
        total = self.counts.agg(
            F.sum(F.when(self.is_word, F.col("n"))), F.sum(self.is_word.cast("long")), F.sum(F.when(self.is_word, level)),
            F.sum(F.when(~self.is_word, level)), F.sum(F.when(~self.is_word, F.col("n") - 1))).first()
        self.tokens, self.distinct, word_entries, pair_entries, again = (int(x or 0) for x in total)
        #: how often a training token follows its forerunner not for the first time
        self.weight = min(max(again / max(self.tokens, 1), WEIGHT[0]), WEIGHT[1])
        self.word_segments, self.pair_segments = (max(1, -(-n * ENTRY_BITS // SEGMENT_BITS)) for n in (word_entries, pair_entries))
        self.word_counts = cut(self.counts.where(self.is_word))  # read often, and far fewer than all

    def _segments(self, counts: DataFrame, n_segments: int) -> DataFrame:
        """The segments in order, range after range."""
        shuffles = int(self.counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = min(n_segments, max(shuffles, 1))
        dealt = counts.withColumn("segment", F.pmod(F.shiftright("key", 1), F.lit(n_segments)).cast("int"))
        place = F.floor(F.col("segment").cast("long") * parts / n_segments).cast("int")
        return cut(dealt.repartitionById(parts, place).sortWithinPartitions("segment")
                   .mapInArrow(_segments, "segment int, bits binary"))

    def _groups(self, counts: DataFrame, n_segments: int, most: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """What makes a filter of each ``most`` segments, filled as they arrive: the driver holds one group at a time."""
        size = SEGMENT_BITS // 8
        first, bits = 0, np.zeros(min(most, n_segments) * size, dtype=np.uint8)
        for segment, raw in self._segments(counts, n_segments).toLocalIterator():
            while segment >= first + most:
                yield bits, first, n_segments
                first += most
                bits = np.zeros(min(most, n_segments - first) * size, dtype=np.uint8)
            at = (segment - first) * size
            bits[at : at + size] = np.frombuffer(raw, dtype=np.uint8)
        while True:
            yield bits, first, n_segments
            first += most
            if first >= n_segments:
                return
            bits = np.zeros(min(most, n_segments - first) * size, dtype=np.uint8)

    def words(self) -> tuple[np.ndarray, int, int]:
        return next(self._groups(self.word_counts, self.word_segments, self.word_segments))

    def pairs(self) -> Iterator[tuple[np.ndarray, int, int]]:
        return self._groups(self.counts.where(~self.is_word), self.pair_segments, GROUP)

    def head(self) -> tuple[np.ndarray, np.ndarray]:
        rows = most_frequent(self.word_counts, "n", HEAD).select("key", "n").toArrow()
        key = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        return key[order], rows.column("n").to_numpy()[order]


def _log_probability(tokens: Tokens, word: np.ndarray, pair: np.ndarray, n: int, v: int, weight: float) -> np.ndarray:
    """log10 of each token's chance after the one before: the pair's frequency mixed with the word's own.

    Up to the width of the levels, chances after a token sum to one.
    """
    c_word, c_pair = counts_of(word), counts_of(pair)
    c_before = np.empty_like(c_word)
    c_before[1:] = c_word[:-1]
    starts = tokens.offsets[:-1]
    c_before[starts] = c_word[tokens.offsets[1:] - 1]  # ends: as many as texts
    c_pair = np.minimum(c_pair, c_before)
    own = (c_word + 1) / (n + v + 1)
    return np.log10(weight * c_pair / np.maximum(c_before, 1) + (1 - weight) * own)


def _sums(tokens: Tokens, words: Filter, pairs: Filter, n: int, v: int, weight: float) -> np.ndarray:
    """Per text, the log10 chances of the tokens whose pair is in this part of the filter."""
    word = words.levels(tokens.distinct)[tokens.codes]  # each distinct word once
    here = pairs.has(tokens.pairs)
    pair = np.zeros(len(word), dtype=np.uint8)
    pair[here] = pairs.levels(tokens.pairs[here])
    logs = _log_probability(tokens, word, pair, n, v, weight) if len(word) else np.zeros(0)
    return tokens.summed(np.where(here, logs, 0.0))


def _first_pass(batches: Iterator[pa.RecordBatch], word_bits, pair_bits, exact, n: int, v: int, weight: float) -> Iterator[pa.RecordBatch]:
    words, pairs = Filter(*word_bits.value), Filter(*pair_bits.value)  # plain values are broadcast, as workers needn't have this package
    known, counts = exact.value
    for batch in (some for whole in batches for some in slices(whole)):
        tokens = Tokens(texts(batch))
        at = np.minimum(np.searchsorted(known, tokens.distinct), max(len(known) - 1, 0))
        found = known[at] == tokens.distinct if len(known) else np.zeros(len(tokens.distinct), dtype=bool)
        logs = np.where(found, np.log10(counts[at] + 1.0), 0.0) if len(known) else np.zeros(len(tokens.distinct))
        in_head, logs = found[tokens.codes], logs[tokens.codes]
        tail = np.flatnonzero(~in_head)
        ends = np.searchsorted(tail, tokens.offsets).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), batch.column("digest"), pa.array(np.diff(tokens.offsets)),
             pa.array(tokens.summed(in_head.astype(np.int64))), pa.array(tokens.summed(logs)),
             pa.array(_sums(tokens, words, pairs, n, v, weight)),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.words[tail].view(np.int64)))],
            names=["doc_id", "held_out", "digest", "n_tokens", "head_known", "head_logs", "score", "tail"])


def _next_pass(batches: Iterator[pa.RecordBatch], word_bits, pair_bits, n: int, v: int, weight: float) -> Iterator[pa.RecordBatch]:
    words, pairs = Filter(*word_bits.value), Filter(*pair_bits.value)
    for batch in (some for whole in batches for some in slices(whole)):
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), pa.array(_sums(Tokens(texts(batch)), words, pairs, n, v, weight))], names=["digest", "part"])


def train_and_score(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs(doc_id, text)``.

    Learns from the rows where ``held_out`` is false. Tokens are words, A-Z lower-cased, and an end per text (a null or
    empty text is its end). base_score adds log10((c + 1) / (N + V + 1)) over tokens, with exact counts of the training
    tokens; score is the bigram model's log10 probability of the text. Without any training row N = V = 0, and both
    are over nothing known. Repeated rows count and are scored as often as they are there.

    The first pass gives all rows; each further one, if pairs need more than one group, gives its sum for each different
    text, found again by a digest of the text.
    """
    context = docs.sparkSession.sparkContext
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
    own = docs.select("doc_id", held_out.alias("held_out"), text.alias("text"), digest.alias("digest"))
    model = Model(own.where(~F.col("held_out")))
    n, v = model.tokens, model.distinct
    word_bits, exact = context.broadcast(model.words()), context.broadcast(model.head())
    rows = None
    parts: list[DataFrame] = []
    for group in model.pairs():
        pair_bits = context.broadcast(group)
        del group
        step = {"word_bits": word_bits, "pair_bits": pair_bits, "n": n, "v": v, "weight": model.weight}
        if rows is None:
            rows = cut(own.mapInArrow(partial(_first_pass, exact=exact, **step), (
                "doc_id long, held_out boolean, digest binary, n_tokens long, head_known long, head_logs double, score double, "
                "tail array<long>")))
        else:
            parts.append(cut(own.select("digest", "text").mapInArrow(partial(_next_pass, **step), "digest binary, part double")
                             .dropDuplicates(["digest"])))
        pair_bits.destroy()
    word_bits.destroy()
    exact.destroy()
    if parts:
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        rows = rows.join(every.groupBy("digest").agg(F.sum("part").alias("part")), "digest").withColumn("score", F.col("score") + F.col("part"))
        rows = cut(rows)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    tail = rows.select("row", F.explode("tail").alias("key"))
    found = (tail.join(model.word_counts, "key").groupBy("row")
             .agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("tail_logs")))
    none = float(np.log10(n + v + 1))
    return rows.drop("tail").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.coalesce("tail_logs", F.lit(0.0)) - F.col("n_tokens") * none).alias("base_score"), "score")

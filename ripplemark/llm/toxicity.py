"""Toxicity by multiple-instance learning: only documents have labels, sentences get scores.

A sentence's score is logistic in its words and their beginnings; a document is toxic if any sentence is, so sentence
scores are combined by noisy-or: 1 - prod(1 - p). The weights are fitted to document labels through that formula,
and the fitted sentence scores say where the offence is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemark.llm.shared import crc_mod, map_batches, texts, words
from ripplemark.llm.token_ids import slices

#: Labelled documents the model is fitted to, at most about, and bytes of their texts: a sample by hash where there are more.
SAMPLE, SAMPLE_BYTES = 6_000, 64 << 20
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5)
#: A feature has to be this much likelier in toxic documents: twice the log likelihood ratio to one common rate.
LEAST_TOLD = 18.0
STEPS, RATE, SHRINK, BIAS = 300, 0.1, 1e-5, -6.0
SCORED = ("score", "n_sentences", "offending")
_MARK = "\x1e"
_STRIPPED = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…¡¿"


class Sentences:
    """The sentences of some texts: they end at . ! ? before white space, and at line ends."""

    def __init__(self, text: pa.Array):
        codes, offsets, self.distinct = words(pc.replace_substring(text, "\n", f" {_MARK} "))
        mark = pc.index_in(pa.array([_MARK], self.distinct.type), value_set=self.distinct)[0].as_py()
        ends = pc.match_substring_regex(self.distinct, r"""[.!?]["'”’»)\]]*$""").to_numpy(zero_copy_only=False)
        after = np.zeros(len(codes) + 1, dtype=bool)
        after[1:] = ends.astype(bool)[codes]
        if mark is not None:
            is_mark = codes == mark
            after[1:] |= is_mark
            before = np.concatenate(([0], np.cumsum(~is_mark)))
            # a sentence may begin at any kept word whose forerunner, kept or not, ended one
            begins = np.zeros(before[-1] + 1, dtype=bool)
            begins[before[np.flatnonzero(after)]] = True
            codes, offsets = codes[~is_mark], before[offsets]
            after = begins
        after[offsets[:-1]] = True
        self.codes = codes
        self.starts = np.flatnonzero(after[: len(codes)])
        self.lengths = np.diff(np.append(self.starts, len(codes)))
        self.of_text = np.searchsorted(self.starts, offsets)

    def features(self) -> list[pa.Array]:
        """For each kind, the feature of every distinct word (null: none)."""
        lower = pc.utf8_lower(pc.utf8_trim(self.distinct, characters=_STRIPPED))
        length = pc.utf8_length(lower)
        none = pa.scalar(None, lower.type)
        return [pc.if_else(pc.greater(length, 0), lower, none)] + [
            pc.if_else(pc.greater(length, k), pc.utf8_slice_codeunits(lower, 0, k), none) for k in BEGINNINGS]

    def logits(self, weight: np.ndarray, bias: float) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0)
        return np.add.reduceat(weight[self.codes], self.starts) + bias

    def summed(self, per_sentence: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(per_sentence)))
        return total[self.of_text[1:]] - total[self.of_text[:-1]]

    def words_of(self, sentence: int) -> str:
        at = self.starts[sentence]
        return " ".join(self.distinct.take(pa.array(self.codes[at : at + self.lengths[sentence]])).to_pylist())


def fit(text: pa.Array, toxic: np.ndarray) -> tuple[float, list[tuple[int, str, float]]]:
    """Bias and (kind, feature, weight) of the features with weight, from texts and their labels."""
    if not len(toxic) or toxic.all() or not toxic.any():
        return (BIAS if not len(toxic) or not toxic.any() else -BIAS), []
    found = Sentences(text)
    bounds = np.append(found.starts, len(found.codes))[found.of_text]  # first word of each text
    names: list[tuple[int, str]] = []
    parts = []
    size = 0
    for kind, feature in enumerate(found.features()):
        coded = feature.dictionary_encode()
        n_kind = len(coded.dictionary)
        at = pc.fill_null(coded.indices, n_kind).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.zeros((2, n_kind), dtype=np.int64)  # clean and toxic documents with the feature
        for first in range(0, len(toxic), 256):
            some = slice(first, first + 256)
            lengths = np.diff(bounds[first : first + 257])
            owner = np.repeat(np.arange(len(lengths)), lengths)
            have = at[found.codes[bounds[first] : bounds[first] + len(owner)]]
            of_doc, of_feature = np.divmod(np.unique(owner * (n_kind + 1) + have), n_kind + 1)
            for label in (0, 1):
                of = of_feature[(toxic[some][of_doc] == bool(label)) & (of_feature < n_kind)]
                counts[label] += np.bincount(of, minlength=n_kind)
        told = _telling(counts[1], counts[0], int(toxic.sum()), int((~toxic).sum()))
        place = np.append(np.where(told, np.cumsum(told) - 1 + size, -1), -1)
        parts.append(place[at])
        names += [(kind, f) for f in coded.dictionary.filter(pa.array(told)).to_pylist()]
        size += int(told.sum())
    theta, bias = np.zeros(size + 1), BIAS  # the last one is for words without the feature, and stays 0
    first, second = np.zeros(size + 2), np.zeros(size + 2)
    n = len(toxic)
    # only words with a feature move a sentence; all other sentences of a document are alike
    at = np.flatnonzero(np.any([p >= 0 for p in parts], axis=0)[found.codes])
    sentence = np.searchsorted(found.starts, at, side="right") - 1
    told_sentences, sentence = np.unique(sentence, return_inverse=True)
    doc = np.searchsorted(found.of_text, told_sentences, side="right") - 1
    rest = np.diff(found.of_text) - np.bincount(doc, minlength=n)
    parts = [np.where(p < 0, size, p)[found.codes[at]] for p in parts]
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence, weights=np.sum([theta[p] for p in parts], axis=0), minlength=len(doc))
        evidence = rest * np.logaddexp(0, bias) + np.bincount(doc, weights=np.logaddexp(0, z), minlength=n)
        pull = np.where(toxic, -1 / np.expm1(np.clip(evidence, 1e-6, 500)), 1.0) / n
        slope = pull[doc] / (1 + np.exp(-np.maximum(z, -500)))
        grad = np.zeros(size + 2)
        for p in parts:
            grad[: size + 1] += np.bincount(p, weights=slope[sentence], minlength=size + 1)
        grad[size], grad[size + 1] = 0, slope.sum() + (pull * rest).sum() / (1 + np.exp(-bias))
        grad[:size] += SHRINK * theta[:size]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta -= move[: size + 1]
        bias = min(bias - move[size + 1], -3.0)
    return float(bias), [(kind, f, float(w)) for (kind, f), w in zip(names, theta, strict=False)]


def _telling(with_toxic: np.ndarray, with_clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Features whose share of toxic documents is above that of clean ones beyond chance."""
    both = with_toxic + with_clean
    share = n_toxic / (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(with_toxic > 0, with_toxic * np.log(with_toxic / (both * share)), 0)
                     + np.where(with_clean > 0, with_clean * np.log(with_clean / (both * (1 - share))), 0))
    return (with_toxic > share * both) & (ratio >= LEAST_TOLD)


def _within(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The first rows whose texts have ``most`` bytes together."""
    held = 0
    for batch in batches:
        sizes = held + np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        n = int(np.searchsorted(sizes, most, side="right"))
        if n:
            yield batch.slice(0, n)
        if n < batch.num_rows:
            return
        held = int(sizes[-1]) if n else held


def _fit(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in _within(batches, most_bytes) if b.num_rows]
    text = pa.concat_arrays([texts(b) for b in held]) if held else pa.array([], pa.large_string())
    toxic = np.concatenate([b.column("toxic").to_numpy(zero_copy_only=False) for b in held]) == 1 if held else np.zeros(0, bool)
    bias, weights = fit(text, toxic)
    weights = [(-1, "", bias), *weights]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
        zip(*weights, strict=True), (pa.int32(), pa.string(), pa.float64()), strict=True)], names=["kind", "feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, str, float]]:
    """The model as (kind, feature, weight) rows, the bias first, from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    With more than ``sample`` labels, a sample by hash of doc_id of about that size; of these, in the order of another
    hash, the first whose texts have ``most_bytes`` together. So rows and bytes of what the fitting task holds are bounded. A doc_id with several labels is toxic if any says so.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) < int(1_000_003 * sample / total))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        "text", "toxic", F.xxhash64("doc_id", "text", F.lit("order")).alias("place"))
    ordered = chosen.repartition(1).sortWithinPartitions("place")
    fitted = map_batches(ordered, partial(_fit, most_bytes=most_bytes), "kind int, feature string, weight double")
    return [tuple(r) for r in fitted.collect()] or [(-1, "", BIAS)]  # no task where nothing is labelled


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    bias, kinds = model.value
    kinds = [(pa.array(names, pa.large_string()), np.append(weights, 0.0)) for names, weights in kinds]
    for batch in (some for whole in batches for some in slices(whole)):
        found = Sentences(texts(batch))
        weight = np.zeros(len(found.distinct))
        for feature, (names, weights) in zip(found.features(), kinds, strict=True):
            weight += weights[pc.fill_null(pc.index_in(feature, value_set=names), len(names)).to_numpy(zero_copy_only=False)]
        z = found.logits(weight, bias)
        score = -np.expm1(-found.summed(np.logaddexp(0, z)))
        hot = np.flatnonzero(z >= 0)
        text_of = np.searchsorted(found.of_text, hot, side="right") - 1
        offending: list[list[str]] = [[] for _ in range(batch.num_rows)]
        for sentence, row in zip(hot.tolist(), text_of.tolist(), strict=True):
            offending[row].append(found.words_of(sentence))
        kept = [name for name in batch.schema.names if name not in SCORED]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in kept), pa.array(np.clip(score, 0.0, 1.0)),
             pa.array(np.diff(found.of_text), pa.int64()), pa.array(offending, pa.list_(pa.string()))],
            names=[*kept, *SCORED])


def score(docs: DataFrame, model: list[tuple[int, str, float]]) -> DataFrame:
    """``docs`` with the columns score, n_sentences and offending (which replace any of these names).

    score is the chance that some sentence is toxic; offending are the words of the sentences that alone have one of a
    half at least. A null or wordless text has no sentence and score 0. Rows are scored one by one, whatever repeats.
    """
    kinds = [([f for k, f, _ in model if k == kind], np.array([w for k, _, w in model if k == kind]))
             for kind in range(1 + len(BEGINNINGS))]
    bias = next(w for k, _, w in model if k == -1)
    shared = docs.sparkSession.sparkContext.broadcast((bias, kinds))
    kept = [f for f in docs.schema.fields if f.name not in SCORED]
    return map_batches(docs, partial(_score, model=shared), T.StructType([
        *kept, T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.LongType()),
        T.StructField("offending", T.ArrayType(T.StringType()))]))


def train_and_score(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """``score`` with a model that never sees the labels of a fifth of the documents, and whether a row is of that fifth."""
    model = train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0), sample=sample)
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")

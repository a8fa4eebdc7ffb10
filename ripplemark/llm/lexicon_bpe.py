"""Byte-level BPE of whole texts by a lexicon automaton and exact merges, and back.

Frequent words (the tokenizer's pre-tokens) of all documents are compiled with their ids into a minimal acyclic
transducer, which goes to every machine as one file and is mapped into memory there. The distinct words of a batch walk
through it together; those it lacks are merged exactly, pair by pair in the order of the merge table. Decoding joins the
bytes of the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.shared import cut, map_batches, most_frequent, ragged, shared_dir, texts, worker_state
from ripplemark.llm.token_ids import _byte_letters, slices
from ripplemark.llm.transducer import Transducer, compiled

#: Words of the lexicon, what one task proposes at most, and the longest word in it (bytes).
LEXICON, PER_TASK, LONGEST = 131_072, 8_192, 64
#: Words the lexicon lacks that a worker remembers with their ids.
REMEMBERED = 400_000
#: From this length (bytes) a word is merged by a queue of its pairs rather than in a batch.
QUEUED = 2048
LARGE = pa.large_string()
#: The pre-tokens of this kind of tokenizer (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Letters and marks of parts that are split by whole arrays: words, marks behind them, single line feeds between.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~"
_EASY = f"^[{_LETTERS}]+[{_MARKS}]*(?:\n[{_LETTERS}]+[{_MARKS}]*)*$"
#: A space that could belong to a longer run of white space: between anything that isn't printed, or at the end.
_RUN = r"[^\p{L}\p{N}\p{M}\p{P}\p{S}] (?:[^\p{L}\p{N}\p{M}\p{P}\p{S}]|\z)"


class Merges:
    """The merge table of a byte-level BPE tokenizer file, and the bytes of its ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, before = whole["model"], whole["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        added = whole["added_tokens"]
        if not plain or not split or whole["normalizer"] or any(
                t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("not a byte-level BPE tokenizer without normaliser")
        vocabulary, letters = model["vocab"], _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.single = np.array([vocabulary[c] for c in letters], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in added}
        self.n = 1 + max([*vocabulary.values(), *self.special.values()])
        tokens: list[bytes] = [b""] * self.n
        for token, k in vocabulary.items():
            tokens[k] = bytes(byte_of[c] for c in token)
        for token, k in self.special.items():
            tokens[k] = token.encode()
        self.tokens = pa.array(tokens, pa.large_binary())
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocabulary[a] * self.n + vocabulary[b] for a, b in pairs] or [-1], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs] or [0], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.never = len(key)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def merge(self, content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word and all ids in order; words are runs of bytes, as for the transducer.

        In each round every unfinished word has all places of its lowest-ranked pair joined, from the left, which is
        what joining them one by one comes to, as a pair that a join makes new ranks behind the join.
        """
        lengths = np.diff(offsets)
        long = np.flatnonzero(lengths >= QUEUED)
        queued = [self._queued(content[offsets[k] : offsets[k + 1]]) for k in long.tolist()]
        done_words = [long]
        done_ids = [np.concatenate([np.empty(0, np.int64), *queued])]
        done_lengths = [np.array([len(x) for x in queued], dtype=np.int64)]
        word = np.flatnonzero(lengths < QUEUED)
        held = lengths[word]
        ids = self.single[content[ragged(offsets[word], held)]]
        rank = None
        while len(word):
            ends = np.cumsum(held)
            last = np.zeros(len(ids), dtype=bool)
            last[ends[held > 0] - 1] = True
            if rank is None:
                rank = np.full(len(ids), self.never, dtype=np.int64)
                at = np.flatnonzero(~last)
                rank[at] = self.rank(ids[at], ids[at + 1])
            least = np.full(len(word), self.never, dtype=np.int64)
            some = np.flatnonzero(held)
            if len(some):
                least[some] = np.minimum.reduceat(rank, (ends - held)[some])
            over = least == self.never
            if over.any():
                of_over = np.repeat(over, held)
                done_words.append(word[over])
                done_ids.append(ids[of_over])
                done_lengths.append(held[over])
                word, held, least = word[~over], held[~over], least[~over]
                ids, rank = ids[~of_over], rank[~of_over]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, held))
            # of places side by side (a letter repeated) every other one, from the left
            new_run = np.concatenate(([True], np.diff(hit) != 1))
            in_run = np.arange(len(hit)) - np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[in_run % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            stays = np.ones(len(ids), dtype=bool)
            stays[hit + 1] = False
            number = np.repeat(np.arange(len(word)), held)
            held = held - np.bincount(number[hit], minlength=len(word))
            place = np.cumsum(stays) - 1
            joined = place[hit]
            ids, rank, number = ids[stays], rank[stays], number[stays]
            for at in (joined, joined[joined > 0] - 1):  # pairs that begin and that end with a joined one
                inside = np.zeros(len(at), dtype=bool)
                room = at + 1 < len(ids)
                inside[room] = number[at[room]] == number[at[room] + 1]
                rank[at[~inside]] = self.never
                at = at[inside]
                rank[at] = self.rank(ids[at], ids[at + 1])
        words = np.concatenate(done_words)
        counts = np.concatenate(done_lengths)
        flat = np.concatenate(done_ids)
        order = np.argsort(words, kind="stable")
        starts = np.cumsum(counts) - counts
        return counts[order], flat[ragged(starts[order], counts[order])]

    def _queued(self, word: np.ndarray) -> np.ndarray:
        """One long word by a queue of its pairs."""
        ids = self.single[word].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = np.array(ids[:-1], dtype=np.int64)
        first = self.rank(left, np.array(ids[1:], dtype=np.int64)).tolist()
        queue = [(r, k) for k, r in enumerate(first) if r < self.never]
        heapq.heapify(queue)
        rank = [*first, self.never]
        table, never = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True)), self.never
        while queue:
            r, k = heapq.heappop(queue)
            if rank[k] != r:
                continue
            gone = after[k]
            ids[k] = int(self.made[r])
            ids[gone], rank[gone] = -1, -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            for at in (before[k], k):
                if at >= 0:
                    to = after[at]
                    rank[at] = table.get(ids[at] * self.n + ids[to], never) if to < n else never
                    if rank[at] < never:
                        heapq.heappush(queue, (rank[at], at))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)


class Codec:
    """Encodes and decodes batches of texts with a tokenizer file and, if there is one, a mapped lexicon."""

    def __init__(self, path: str, lexicon: Transducer | None = None):
        from tokenizers import pre_tokenizers

        self.merges = Merges(path)
        self.lexicon = lexicon
        self.pattern = regex.compile(PATTERN)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))) or r"(?!)")
        self.assigned: set[str] = set()
        self.decimal = pa.array([str(k) for k in range(self.merges.n)], LARGE)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = np.empty(0, dtype=np.int64)
        self.starts = np.zeros(1, dtype=np.int64)

    def _words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens. The library itself reads code points that one of the two
        Unicode tables at hand doesn't know."""
        if not text.isascii():
            new = set(text) - self.assigned
            if new:
                unknown = {c for c in new if unicodedata.category(c) == "Cn"}
                self.assigned |= new - unknown
                if unknown:
                    return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a whole text."""
        if not any(s in text for s in self.merges.special):
            return self._words(text)
        found, at = [], 0
        for hit in self.split.finditer(text):
            found += [*self._words(text[at : hit.start()]), hit.group()]
            at = hit.end()
        return found + self._words(text[at:])

    def parts(self, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of the distinct parts one after another, their number by part, the part at each place of the
        texts, and the offsets of the texts.

        A part is what a single space begins, with the space; its pre-tokens are the same wherever it stands, unless the
        space may be one of a longer run of white space, or a special token is near: then the text is one part.
        """
        whole = pc.match_substring_regex(text, _RUN)
        for s in self.merges.special:
            whole = pc.or_(whole, pc.match_substring(text, s))
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False).astype(bool))
        lists = pc.split_pattern(pc.if_else(whole, pa.scalar("", LARGE), text), " ")
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.values
        head = np.zeros(len(flat), dtype=bool)
        head[offsets[:-1]] = True
        codes = np.empty(len(flat), dtype=np.int64)
        found, counts, n = [], [], 0
        for mask, before in ((~head, " "), (head, "")):
            coded = flat.filter(pa.array(mask)).dictionary_encode()
            easy = pc.match_substring_regex(coded.dictionary, _EASY)
            held = pc.binary_join_element_wise(pa.scalar(before, LARGE), coded.dictionary, pa.scalar("", LARGE))
            cut_up = pc.replace_substring_regex(held.filter(easy), f"([{_LETTERS}])([{_MARKS}])", "\\1\0\\2")
            cut_up = pc.split_pattern(pc.replace_substring(cut_up, "\n", "\0\n\0"), "\0")
            others = [self._words(w) for w in held.filter(pc.invert(easy)).to_pylist()]
            found += [cut_up.flatten(), pa.array([w for some in others for w in some], LARGE)]
            counts += [np.diff(cut_up.offsets.to_numpy(zero_copy_only=False)), np.fromiter(map(len, others), np.int64, len(others))]
            is_easy = easy.to_numpy(zero_copy_only=False).astype(bool)
            place = np.where(is_easy, np.cumsum(is_easy) - 1, is_easy.sum() + np.cumsum(~is_easy) - 1)
            codes[mask] = n + place[coded.indices.to_numpy(zero_copy_only=False)]
            n += len(held)
        codes[offsets[alone]] = np.arange(n, n + len(alone))
        wholes = [self.pretokens(t) for t in text.take(pa.array(alone)).to_pylist()]
        found.append(pa.array([w for some in wholes for w in some], LARGE))
        counts.append(np.fromiter(map(len, wholes), np.int64, len(wholes)))
        return pa.concat_arrays(found), np.concatenate(counts), codes, offsets

    def _learn(self, words: list[str]) -> None:
        held = pa.array(words, pa.large_binary())
        offsets = np.frombuffer(held.buffers()[1], dtype=np.int64, count=len(held) + 1)
        content = np.frombuffer(held.buffers()[2] or b"", dtype="u1")
        if self.lexicon is not None:
            found, counts, ids = self.lexicon.find(content, offsets)
        else:
            found, counts, ids = np.zeros(len(words), bool), np.zeros(len(words), np.int64), np.empty(0, np.int64)
        missed = np.flatnonzero(~found)
        sizes = np.diff(offsets)[missed]
        more, merged = self.merges.merge(content[ragged(offsets[missed], sizes)], np.concatenate(([0], np.cumsum(sizes))))
        starts = np.cumsum(counts) - counts
        starts[missed] = len(ids) + np.cumsum(more) - more
        counts[missed] = more
        both = np.concatenate((ids.astype(np.int64), merged))
        for k, word in enumerate(words):
            if word in self.merges.special:
                starts[k], counts[k] = len(both), 1
                both = np.append(both, self.merges.special[word])
        self.row.update(zip(words, range(len(self.starts) - 1, len(self.starts) - 1 + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts)))
        self.ids = np.concatenate((self.ids, both[ragged(starts, counts)]))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the offsets of the texts (large strings, none null)."""
        found, n_words, codes, offsets = self.parts(text)
        if len(self.row) > REMEMBERED:
            self.clear()
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = list(map(self.row.get, distinct))
        if None in rows:
            self._learn([w for w, k in zip(distinct, rows, strict=True) if k is None])
            rows = list(map(self.row.get, distinct))
        words = np.array(rows, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.starts[words + 1] - self.starts[words]
        part_ids = self.ids[ragged(self.starts[words], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(n_words)))]
        sizes = np.diff(ends)[codes]
        ids = part_ids[ragged(ends[:-1][codes], sizes)]
        return ids, np.concatenate(([0], np.cumsum(sizes)))[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each run of ids; those of an unknown id are empty, as the library leaves it out."""
        known = np.where((ids >= 0) & (ids < self.merges.n), ids, 0)
        pieces = self.merges.tokens.take(pa.array(known))
        if (known != ids).any():
            pieces = pc.if_else(pa.array(known == ids), pieces, pa.scalar(b"", pa.large_binary()))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), pieces), pa.scalar(b"", pa.large_binary()))

    def listed(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The ids of each run as decimal numbers with commas between."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), self.decimal.take(pa.array(ids))),
                              pa.scalar(",", LARGE))


def _frequent(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """The task's most frequent words; rare ones are forgotten on the way, so memory is bounded."""
    codec = worker_state(("codec", tokenizer, None), lambda: Codec(tokenizer))
    seen: Counter[str] = Counter()
    for batch in batches:
        for some in slices(batch):
            found, n_words, codes, _ = codec.parts(texts(some))
            coded = found.dictionary_encode()
            seen_here = np.bincount(codes, minlength=len(n_words))
            counts = np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.repeat(seen_here, n_words))
            top = np.argsort(-counts, kind="stable")[: 4 * PER_TASK]
            seen.update(dict(zip(coded.dictionary.take(pa.array(top)).to_pylist(), counts[top].astype(np.int64).tolist(), strict=True)))
            if len(seen) > 16 * PER_TASK:
                seen = Counter(dict(seen.most_common(4 * PER_TASK)))
    top = [(w, n) for w, n in seen.most_common(PER_TASK) if len(w.encode()) <= LONGEST and w not in codec.merges.special]
    yield pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])


def build_lexicon(docs: DataFrame, tokenizer: str, *, words: int = LEXICON) -> str:
    """Compiles the most frequent words of ``docs(text)`` and makes the file known to all executors; its name.

    The words only decide how much is looked up rather than merged, never a result. At most ``words`` words of at most
    64 bytes are in it, a few MB. The file lies in the shared folder; executors that join later fetch it too.
    """
    spark = docs.sparkSession
    merges = Merges(tokenizer)
    seen = cut(map_batches(docs.select("text"), partial(_frequent, tokenizer=tokenizer), "word string, n long")
               .groupBy("word").agg(F.sum("n").alias("n")))
    frequent = [r.word.encode() for r in most_frequent(seen, "n", words).select("word").collect()]
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in frequent], dtype=np.int64))).astype(np.int64)
    counts, ids = merges.merge(np.frombuffer(b"".join(frequent), dtype="u1"), offsets)
    ends = np.cumsum(counts)
    block = compiled((w, tuple(ids[e - c : e].tolist())) for w, c, e in zip(frequent, counts.tolist(), ends.tolist(), strict=True))
    name = f"lexicon-{hashlib.sha256(block).hexdigest()[:24]}.bin"
    where, inner = fs.FileSystem.from_uri(f"{shared_dir(spark)}/{name}")
    where.create_dir(inner.rpartition("/")[0], recursive=True)
    with where.open_output_stream(inner, compression=None) as out:
        out.write(block)
    spark.sparkContext.addFile(f"{shared_dir(spark)}/{name}")
    return name


def _codec(tokenizer: str, lexicon: str | None) -> Codec:
    return worker_state(("codec", tokenizer, lexicon), lambda: Codec(
        tokenizer, Transducer.mapped(SparkFiles.get(lexicon)) if lexicon else None))


def _own(batch: pa.RecordBatch) -> list[tuple[str, pa.Array]]:
    return [(name, batch.column(name)) for name in batch.schema.names]


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, lexicon: str | None) -> Iterator[pa.RecordBatch]:
    codec = _codec(tokenizer, lexicon)
    for batch in batches:
        for some in slices(batch):
            ids, offsets = codec.encode(texts(some))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, tokenizer: str, *, lexicon: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of ``docs(doc_id, text)``: the ids of the whole text, special strings as their tokens.

    ``lexicon`` is a name that ``build_lexicon`` gave. Null and empty texts have no ids. Repeated rows each stay, extra
    columns go, an empty table gives an empty one. Refuses a tokenizer file that isn't byte-level BPE without normaliser.
    """
    Merges(tokenizer)
    own = docs.select(F.col("doc_id").cast("long"), "text")
    return map_batches(own, partial(_encode, tokenizer=tokenizer, lexicon=lexicon), "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(tokenizer, None)
    for batch in batches:
        lists = pc.fill_null(batch.column("ids"), [])
        flat = pc.list_flatten(lists)
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
        ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        found = [b.decode("utf-8", "replace") for b in codec.decode(ids, offsets).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) for every row of ``encoded(doc_id, ids)``, special tokens included.

    Bytes that aren't UTF-8 become replacement signs, unknown and null ids nothing, null lists the empty text.
    """
    Merges(tokenizer)
    own = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return map_batches(own, partial(_decode, tokenizer=tokenizer), "doc_id long, text string")


def _round_trip(batches: Iterator[pa.RecordBatch], tokenizer: str, lexicon: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(tokenizer, lexicon)
    for batch in batches:
        for some in slices(batch):
            ids, offsets = codec.encode(texts(some))
            listed = [hashlib.sha256(x.as_buffer()).hexdigest() for x in codec.listed(ids, offsets)]
            back = [x.as_py() for x in codec.decode(ids, offsets)]
            back = [hashlib.sha256(b.decode("utf-8", "replace").encode()).hexdigest() for b in back]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()),
                 pa.array(listed, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``: digests of its ids and of what they
    decode to, with a lexicon of the words of these documents. Rows as in ``encode``."""
    own = docs.select(F.col("doc_id").cast("long"), "text")
    name = build_lexicon(own, tokenizer)
    return map_batches(own, partial(_round_trip, tokenizer=tokenizer, lexicon=name),
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Token ids of whole texts through a per-worker cache of words."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ripplemark.llm.shared import ragged, words, worker_state

#: Words a worker remembers; beyond that it starts afresh, so memory is bounded.
REMEMBERED = 300_000
#: Composed letters of Latin scripts, each its own lower case or with a single one, then punctuation.
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F"
_MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but the apostrophe, which may begin a token of letters
_PLAIN = f"^[{_LETTERS}]+[{_MARKS}]*$"
_ENDED = f"^([{_LETTERS}\u2C65\u2C66]+)([{_MARKS}]+)$"
_END = "\0"


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _merge_ranks(model: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes by rank, a zero byte for the word's end; None if ids aren't in the order of merges."""
    vocabulary, end = model["vocab"], model["end_of_word_suffix"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    letters = {c: b for b, c in enumerate(_byte_letters())}
    if any(vocabulary.get(a + b) != 512 + k for k, (a, b) in enumerate(merges)):
        return None
    if sorted(vocabulary.get(c, -1) for c in letters) != list(range(256)):
        return None
    if sorted(vocabulary.get(c + end, -1) for c in letters) != list(range(256, 512)):
        return None
    ranks = {}
    for token, k in vocabulary.items():
        if k < 512 + len(merges):
            bare = token.removesuffix(end)
            ranks[bytes(letters[c] for c in bare) + (b"\0" if bare != token else b"")] = k
    return ranks


class WordIds:
    """Ids by word for a tokenizer that drops white space, splits letters from punctuation and lower-cases.

    A text is the tokens of its words in order, as no token of such a tokenizer spans white space. A word of plain
    letters goes straight to the merge table, read as byte ranks; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        ranks = _merge_ranks(model) if model.get("end_of_word_suffix") else None
        self.merges = None
        if ranks:
            self.merges = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
            self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
            self.ends[[k for token, k in ranks.items() if token.endswith(b"\0")]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordIds:
        return worker_state(("word ids", path), lambda: cls(path))

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = np.empty(1 << 20, dtype=np.uint32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.used = self.rows = 0

    def _learn(self, unknown: list[str]) -> None:
        plain: list[str] = []
        odd = unknown
        if self.merges is not None:
            held = pa.array(unknown, pa.large_string())
            mask = pc.match_substring_regex(held, _PLAIN)
            plain, odd = held.filter(mask), held.filter(pc.invert(mask)).to_pylist()
            lower = pc.utf8_lower(plain)
            lower = pc.replace_substring_regex(lower, _ENDED, r"\1" + _END + r"\2")
            pieces = 1 + pc.count_substring(lower, _END).to_numpy(zero_copy_only=False).astype(np.int64)
            plain = plain.to_numpy(zero_copy_only=False).tolist()
            if plain:
                ids = np.array(self.merges.encode_ordinary(_END.join([*lower.to_numpy(zero_copy_only=False), ""])),
                               dtype=np.uint32)
                self._add(plain, ids, np.flatnonzero(self.ends[ids])[np.cumsum(pieces) - 1] + 1)
        if odd:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            self._add(odd, np.array([k for x in found for k in x], dtype=np.uint32), np.cumsum([len(x) for x in found]))

    def _add(self, some: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(some)
        if self.rows + n + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros(len(self.starts) + n, dtype=np.int64)))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(len(self.ids) + len(ids), dtype=np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.rows + 1 : self.rows + 1 + n] = ends + self.used
        self.row.update(zip(some, range(self.rows, self.rows + n), strict=True))
        self.rows += n
        self.used += len(ids)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each text."""
        codes, offsets, vocabulary = words(text)
        distinct = vocabulary.to_numpy(zero_copy_only=False).tolist()
        if self.rows > REMEMBERED:
            self.clear()
        if unknown := [w for w in distinct if w not in self.row]:
            self._learn(unknown)
        rows = np.fromiter(map(self.row.__getitem__, distinct), dtype=np.int64, count=len(distinct))[codes]
        starts = self.starts[rows]
        lengths = self.starts[rows + 1] - starts
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[ragged(starts, lengths)], ends[offsets]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20):
    """Consecutive parts of a batch with about ``most`` bytes of text each (one row at least)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        base = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()

"""A minimal acyclic transducer from words to sequences of ids, in one block of memory.

Words are added in byte order. States that can't change any more are replaced by equal ones met before, so common
beginnings and common ends are stored once; outputs lie as near to the start as the words allow, which makes equal ends
equal. The finished automaton is a few flat arrays, so a file of it can be mapped into memory, shared by all workers of
a machine, and walked by whole arrays of words a byte at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

from ripplemark.llm.shared import ragged

#: First bytes of a file, and the largest label of an arc plus one.
MAGIC, LABELS = b"rmtrans1", 256
#: Name and type of each array, in the file's order.
ARRAYS = (("keys", "<u8"), ("targets", "<u4"), ("out_starts", "<u4"), ("final", "<u1"), ("final_starts", "<u4"), ("pool", "<u4"))


def _common(a: tuple, b: tuple) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


class _State:
    """A state on the path of the last word; ``arcs`` are [label, output, target]."""

    __slots__ = ("arcs", "final", "output")

    def __init__(self):
        self.arcs: list[list] = []
        self.final, self.output = False, ()

    def delay(self, output: tuple) -> None:
        """``output`` comes no longer before this state but on all ways out of it."""
        for arc in self.arcs:
            arc[1] = output + arc[1]
        if self.final:
            self.output = output + self.output


class Builder:
    """Takes (word, ids) with strictly ascending words."""

    def __init__(self):
        self.path = [_State()]
        self.last = b""
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []

    def _settled(self, state: _State) -> int:
        same = (state.final, state.output, tuple((a, out, to) for a, out, to in state.arcs))
        number = self.known.get(same)
        if number is None:
            number = self.known[same] = len(self.states)
            self.states.append(same)
        return number

    def _settle(self, depth: int) -> None:
        while len(self.path) - 1 > depth:
            state = self.path.pop()
            self.path[-1].arcs[-1][2] = self._settled(state)

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        if word <= self.last and (word or self.path[0].final or self.path[0].arcs):
            raise ValueError("words have to ascend")
        shared = _common(word, self.last)
        self._settle(shared)
        for depth in range(1, shared + 1):
            arc = self.path[depth - 1].arcs[-1]
            k = _common(arc[1], ids)
            if k < len(arc[1]):
                self.path[depth].delay(arc[1][k:])
                arc[1] = arc[1][:k]
            ids = ids[k:]
        for k, label in enumerate(word[shared:]):
            self.path[-1].arcs.append([label, ids if k == 0 else (), None])
            self.path.append(_State())
        end = self.path[-1]
        end.final = True
        if shared == len(word):  # the empty word
            end.output = ids
        self.last = word

    def finish(self) -> bytes:
        """The automaton as one block: magic, lengths of the arrays, the start state, the arrays at multiples of 8."""
        self._settle(0)
        start = self._settled(self.path[0])
        keys, targets, outs, final, finals = [], [], [], [], []
        for number, (is_final, output, arcs) in enumerate(self.states):
            final.append(is_final)
            finals.append(output)
            for label, out, to in arcs:  # labels ascend, since words do
                keys.append(number * LABELS + label)
                targets.append(to)
                outs.append(out)
        lengths = [len(x) for x in [*outs, *finals]]
        starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        values = {"keys": keys, "targets": targets, "out_starts": starts[: len(outs) + 1], "final": final,
                  "final_starts": starts[len(outs) :], "pool": [k for x in [*outs, *finals] for k in x]}
        block = bytearray()
        for name, kind in ARRAYS:
            block += np.asarray(values[name], dtype=kind).tobytes()
            block += b"\0" * (-len(block) % 8)
        head = struct.pack(f"<{len(ARRAYS) + 1}Q", start, *[len(values[name]) for name, _ in ARRAYS])
        return MAGIC + head + bytes(block)


def compiled(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The block of the words, which may come in any order; repeated words have to agree."""
    builder = Builder()
    for word, ids in sorted(dict(entries).items()):
        builder.add(word, tuple(ids))
    return builder.finish()


class Transducer:
    """Looks words up in a block, of which nothing is copied."""

    def __init__(self, block):
        block = np.frombuffer(block, dtype="u1") if isinstance(block, bytes | bytearray) else block
        if block[:8].tobytes() != MAGIC:
            raise ValueError("not a transducer")
        self.start, *lengths = struct.unpack_from(f"<{len(ARRAYS) + 1}Q", block, 8)
        at = 8 * (len(ARRAYS) + 2)
        for (name, kind), n in zip(ARRAYS, lengths, strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, block[at : at + size].view(kind))
            at += size + -size % 8

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        return cls(np.memmap(path, dtype="u1", mode="r"))

    def find(self, content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words ``content[offsets[k]:offsets[k + 1]]``: which are there, how many ids each has, all ids in order."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        state = np.full(n, self.start, dtype=np.int64)
        alive = np.arange(n)
        # what word k puts out at byte j is piece j of its run of lengths[k] + 1 pieces, the last one for its end
        pieces = np.concatenate(([0], np.cumsum(lengths + 1)))
        piece_start = np.zeros(pieces[-1], dtype=np.int64)
        piece_length = np.zeros(pieces[-1], dtype=np.int64)
        found = np.zeros(n, dtype=bool)
        step = 0
        while len(alive):
            ends = lengths[alive] == step
            done = alive[ends]
            here = state[done]
            good = self.final[here].astype(bool)
            done, here = done[good], here[good]
            found[done] = True
            at = pieces[done] + step
            piece_start[at] = self.final_starts[here]
            piece_length[at] = self.final_starts[here + 1].astype(np.int64) - self.final_starts[here]
            alive = alive[~ends]
            if not len(alive) or not len(self.keys):
                break
            wanted = state[alive].astype(np.uint64) * np.uint64(LABELS) + content[offsets[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[arc] == wanted
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.targets[arc]
            at = pieces[alive] + step
            piece_start[at] = self.out_starts[arc]
            piece_length[at] = self.out_starts[arc + 1].astype(np.int64) - self.out_starts[arc]
            step += 1
        piece_length[np.repeat(~found, lengths + 1)] = 0
        ends = np.concatenate(([0], np.cumsum(piece_length)))
        return found, ends[pieces[1:]] - ends[pieces[:-1]], self.pool[ragged(piece_start, piece_length)]

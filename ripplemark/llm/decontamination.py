"""Benchmark items found in documents, also with their numbers, names and units exchanged.

Words become canonical: numbers, units and names are typed placeholders. A capital at the start of a text, sentence or
line may be a name or not, so a window with such words is there once for each of its readings. Windows of canonical words
of the items are a hash table that documents probe as they stream by. Where one hits, the item is laid on the document
and all its windows are compared; where the document has other values than the item, they have to be consistent: each
value of the item is one value of the document throughout, and two values aren't one. Windows of the plain words are probed too, so that a passage whose
capitals were changed is found as well.

Items go out in blocks of a bounded number of windows, one pass over the documents per block, whatever their number.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.shared import cut, map_batches, texts, words, worker_state
from ripplemark.llm.token_ids import slices

#: Words of a window; shorter items are one window, and items of fewer words than LEAST are found word for word only.
WINDOW, LEAST = 8, 4
#: Words that are no placeholder which a match of templates needs, and a window to be probed. Items with too few such
#: windows to be sure of a hit are probed by all their windows that have one such word.
LEAST_LITERAL = 4
#: An exact run of so many words is a leak, or this share of an item's windows.
LEAST_RUN, LEAST_SHARE, LEAST_TEMPLATE = 13, 0.5, 0.6
#: Windows of items, in all their readings, broadcast at a time (some 40 bytes each).
BLOCK = 1_000_000

# Units, and numbers in words.
UNITS = """mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons oz lb lbs pound pounds
ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week
weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj cal kcal n pa kpa bar k °c °f degrees degree
percent % $ € £ dollar dollars cent cents euro euros b kb mb gb tb bit bits byte bytes m² m³ km² km/h mph m/s""".split()
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million""".split()

_MARK = "\x1e"
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%$") + "«»“”„’‘…¡¿"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_KINDS = ("word", "number", "unit", "name")
_PLACES = np.array([xxhash.xxh3_64_intdigest(f"<{k}>") for k in _KINDS], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


class Templates:
    """Words of some texts: kind 0 is a word, 1 a number, 2 a unit, 3 a name, 4 a word or a name."""

    def __init__(self, text: pa.Array):
        codes, offsets, raw = words(pc.replace_substring(text, "\n", f" {_MARK} "))
        bare = pc.utf8_trim(raw, characters=_EDGES)
        lower = pc.utf8_lower(bare)
        number = pc.or_(pc.match_substring_regex(bare, r"^[$]?[+-]?\d[\d.,:/]*(st|nd|rd|th|[%$a-zA-Z°²³/]{1,4})?$"),
                        pc.is_in(lower, value_set=pa.array(NUMBER_WORDS, lower.type)))
        unit = pc.is_in(lower, value_set=pa.array(UNITS, lower.type))
        capital = pc.match_substring_regex(bare, r"^\p{Lu}[\p{Ll}\p{Lu}'’-]+$")
        ends = pc.or_(pc.match_substring_regex(raw, r"""[.!?:|]["'”’»)\]]*$"""), pc.equal(raw, _MARK))
        as_numpy = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
        full = as_numpy(pc.and_(pc.greater(pc.binary_length(bare), 0), pc.not_equal(raw, _MARK)))
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, lower.to_numpy(zero_copy_only=False)), dtype=np.uint64,
                             count=len(lower))
        fresh = np.ones(len(codes), dtype=bool)  # at the start of a sentence a capital says nothing
        fresh[1:] = as_numpy(ends)[codes[:-1]]
        fresh[offsets[:-1][offsets[:-1] < len(codes)]] = True
        kind = np.where(as_numpy(number), 1, np.where(as_numpy(unit), 2, 0)).astype(np.int8)
        kinds = np.where((kind[codes] == 0) & as_numpy(capital)[codes], np.where(fresh, np.int8(4), np.int8(3)), kind[codes])
        keep = full[codes]
        before = np.concatenate(([0], np.cumsum(keep)))
        self.offsets = before[offsets]
        self.kinds = kinds[keep]
        self.plain = hashed[codes[keep]]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows and their plain hashes."""
        n = len(self.plain)
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        starts = np.flatnonzero(np.arange(n) + width <= ends)
        h = np.full(len(starts), width, dtype=np.uint64)
        for k in range(width):
            h = _mixed(h * _A + self.plain[starts + k])
        return starts, h

    def readings(self, starts: np.ndarray, width: int, vocabulary: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions in ``starts``, canonical hashes and numbers of literal words of all readings of these windows.

        With a sorted ``vocabulary``, only readings whose literal words are in it.
        """
        word, name = self.kinds % 4 == 0, self.kinds >= 3
        if vocabulary is not None:
            at = np.minimum(np.searchsorted(vocabulary, self.plain), max(len(vocabulary) - 1, 0))
            word &= vocabulary[at] == self.plain if len(vocabulary) else False
            none = np.concatenate(([0], np.cumsum((self.kinds % 4 == 0) & ~word & ~name)))
            which = np.flatnonzero(none[starts + width] == none[starts])
        else:
            which = np.arange(len(starts))
        both = word & name
        keys = np.where(word, self.plain, _PLACES[np.where(name, 3, self.kinds)])
        often = np.concatenate(([0], np.cumsum(both)))
        cost = np.cumsum(np.int64(1) << (often[starts[which] + width] - often[starts[which]]))
        first = 0
        while first < len(which):
            until = max(first + 1, int(np.searchsorted(cost, (cost[first - 1] if first else 0) + 500_000, side="right")))
            some = which[first:until]
            first = until
            h, literal = np.full(len(some), width, dtype=np.uint64), np.zeros(len(some), dtype=np.int8)
            for k in range(width):
                at = starts[some] + k
                two = np.flatnonzero(both[at])
                named = _mixed(h[two] * _A + _PLACES[3])
                h, more = _mixed(h * _A + keys[at]), literal[two]
                literal = literal + word[at]
                if len(two):
                    some = np.concatenate((some, some[two]))
                    h, literal = np.concatenate((h, named)), np.concatenate((literal, more))
            yield some, h ^ _PLACES[0], literal


class Block:
    """Some items as tables of window hashes."""

    def __init__(self, ids: list[int | None], items: list[str], least: int = LEAST):
        found = Templates(pa.array(items, pa.large_string()))
        self.ids, self.offsets, self.plain, self.kinds = ids, found.offsets, found.plain, found.kinds
        self.lengths = np.diff(found.offsets)
        self.n_windows = np.maximum(self.lengths - WINDOW + 1, np.minimum(self.lengths, 1))
        self.vocabulary = np.unique(found.plain[found.kinds % 4 == 0])
        owner = np.repeat(np.arange(len(ids)), self.lengths)
        placed = np.concatenate(([0], np.cumsum(found.kinds != 0)))
        self.tables: dict[int, tuple] = {}
        widths = {int(min(n, WINDOW)) for n in self.lengths if n >= max(least, 1)}
        for width in widths:
            starts, plain = found.windows(width)
            own = self.lengths[owner[starts]]
            right = own == width if width < WINDOW else own >= WINDOW
            starts, plain = starts[right], plain[right]
            item = owner[starts]
            place = starts - found.offsets[:-1][item]
            # rich in every reading; if more than four tenths are, a match has one of them
            rich = width - (placed[starts + width] - placed[starts]) >= LEAST_LITERAL
            dense = np.bincount(item[rich], minlength=len(ids)) <= (1 - LEAST_TEMPLATE) * self.n_windows + 1e-6
            probed = np.flatnonzero(rich | dense[item])
            keys, at = [plain], [np.arange(len(starts))]
            for some, h, literal in found.readings(starts[probed], width) if width >= LEAST else ():
                keys.append(h[literal > 0])
                at.append(probed[some[literal > 0]])
            keys, at = np.concatenate(keys), np.concatenate(at)
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            quick = np.zeros(1 << 20, dtype=bool)
            quick[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables[width] = (keys, item[at], place[at], quick)


def _clashes(pairs: list[tuple[int, int, int]]) -> list[int]:
    """Which of ``pairs`` (kind, value of the item, value of the document) contradict one before.

    Each value of the item is one value of the document, and no two of one kind are the same.
    """
    there: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    out = []
    for k, (kind, own, found) in enumerate(pairs):
        if there.get((kind, own), found) != found or back.get((kind, found), own) != own:
            out.append(k)
        else:
            there[kind, own], back[kind, found] = found, own
    return out


def _runs(x: np.ndarray, width: int) -> np.ndarray:
    """Whether all of x[k : k + width] hold, for every k."""
    return _runs_of(x, width) == width


def _runs_of(x: np.ndarray, width: int) -> np.ndarray:
    """How many of x[k : k + width] hold, for every k."""
    sums = np.concatenate(([0], np.cumsum(x)))
    return sums[width:] - sums[:-width]


def _laid(found: Templates, row: int, block: Block, item: int, shift: int) -> np.ndarray | None:
    """First words of the item's windows that the row has as templates or word for word, if these make a leak."""
    width, n = int(min(block.lengths[item], WINDOW)), int(block.n_windows[item])
    low = max(int(found.offsets[row]), shift)
    high = min(int(found.offsets[row + 1]), shift + int(block.lengths[item]))
    if high - low < width:
        return None
    here, there = slice(low, high), slice(*(int(block.offsets[item]) - shift + x for x in (low, high)))
    kind, own, value, other = block.kinds[there], block.plain[there], found.plain[here], found.kinds[here]
    same = own == value
    literal = same & (kind % 4 == 0) & (other % 4 == 0)
    fixed = (kind == other) & ((kind == 1) | (kind == 2) | (kind == 3))
    free = ~literal & ~fixed & (kind >= 3) & (other >= 3)  # names only if a capital at a start is one
    exact = _runs(same, width)

    def judged(held: np.ndarray, least: int) -> tuple[np.ndarray, list[int], list[int]]:
        """Windows, the slots they cover, and those of them that clash."""
        windows = _runs(held, width)
        windows &= _runs_of(kind % 4 == 0, width) >= least
        covered = np.zeros(len(held) + 1, dtype=np.int64)
        np.add.at(covered, np.flatnonzero(windows), 1)
        np.add.at(covered, np.flatnonzero(windows) + width, -1)
        inside = np.cumsum(covered)[:-1] > 0
        slots = [*np.flatnonzero(inside & fixed).tolist(), *np.flatnonzero(inside & free & held).tolist()]
        bad = _clashes([(min(int(kind[p]), 3), int(own[p]), int(value[p])) for p in slots])
        if (windows | exact).sum() / n < LEAST_TEMPLATE or (inside & literal).sum() < LEAST_LITERAL:
            return np.zeros(0, dtype=np.int64), slots, bad
        return np.flatnonzero(windows | exact) + low, slots, bad

    every = literal | fixed | free
    if (_runs(every, width) | exact).sum() / n < LEAST_TEMPLATE:
        return None
    windows, slots, bad = judged(every, 0)
    if len(bad) and free.any():  # capitals that can't be names of one value each are words
        less = every.copy()
        less[[slots[k] for k in bad if free[slots[k]]]] = False
        windows, slots, bad = judged(less, 0)
    for least in (0, min(LEAST_LITERAL, width)):
        if len(bad) or not len(windows):
            windows, slots, bad = judged(literal | fixed, least)
    return windows if len(windows) and not bad else None


def _matches(text: pa.Array, block: Block) -> Iterator[tuple[int, int, float, int, int, bool]]:
    """(row, item, share of its windows, longest exact run in words, first word, exact) of the leaks in some texts."""
    found = Templates(text)
    hits: dict[tuple[int, int, int], set[int]] = defaultdict(set)
    for width, (keys, items, places, quick) in block.tables.items():
        starts, plain = found.windows(width)
        probes = [(True, np.arange(len(starts)), plain)]
        readings = found.readings(starts, width, block.vocabulary) if width >= LEAST else ()
        for exact, which, h in chain(probes, ((False, some, h) for some, h, _ in readings)):
            likely = np.flatnonzero(quick[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            first = np.searchsorted(keys, h[likely], side="left")
            last = np.searchsorted(keys, h[likely], side="right")
            for k in np.flatnonzero(last > first).tolist():
                at = int(starts[which[likely[k]]])
                row = int(np.searchsorted(found.offsets, at, side="right")) - 1
                for j in range(int(first[k]), int(last[k])):
                    held = hits[row, int(items[j]), at - int(places[j])]
                    if exact:
                        held.add(at)
    best: dict[tuple[int, int], tuple] = {}
    for (row, item, shift), exact in hits.items():
        width = int(min(block.lengths[item], WINDOW))
        n = int(block.n_windows[item])
        run = longest = 0
        for at in sorted(exact):
            run = run + 1 if at - 1 in exact else 1
            longest = max(longest, run + width - 1)
        literal = len(exact) / n >= LEAST_SHARE or longest >= LEAST_RUN
        if literal:
            windows = np.array(sorted(exact))
        elif (windows := _laid(found, row, block, item, shift)) is None:
            continue
        row_ = (len(windows) / n, longest, int(windows[0] - found.offsets[row]), literal)
        best[row, item] = max(best.get((row, item), row_), row_)
    for (row, item), (share, longest, first, exact) in sorted(best.items()):
        yield row, item, min(share, 1.0), longest, first, exact


def _search(batches: Iterator[pa.RecordBatch], shared, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    number, *parts = shared.value  # plain values are broadcast, as workers needn't have this package
    kept = worker_state(("benchmark block",), dict)  # a worker keeps the tables of the last block
    if number not in kept:
        kept.clear()
        kept[number] = Block(*parts)
    block = kept[number]
    for batch in (some for whole in batches for some in slices(whole)):
        keys = batch.column("doc_id").to_pylist()
        found = list(_matches(texts(batch), block))
        rows = [(keys[row], block.ids[item], *rest, int(block.lengths[item])) for row, item, *rest in found]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        at = pa.array([row for row, *_ in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *(batch.column(c).take(at) for c in keep)],
            names=["doc_id", "item_id", "share", "longest_run", "first_word", "exact", "item_words", *keep])


_LEAKS = ("doc_id long, item_id long, share double, longest_run long, first_word long, exact boolean, item_words long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, block: int = BLOCK, least_words: int = LEAST,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, item_id, share, longest_run, first_word, exact, item_words, and the columns ``keep``) for the rows of ``docs`` that hold an item.

    An item of ``benchmark(item_id, text)`` is in a document if half of its 8-word windows are there word for word, or
    a run of 13 of its words, or six tenths of its windows as templates with consistent values. share is that of its
    windows, longest_run the longest exact run in words, first_word where the match begins, and exact is false for
    re-parameterised items. Case, punctuation and line ends don't count. Items of 4 to 7 words are one window. Items of
    fewer words, searched if ``least_words`` says so, are one that is only found word for word; item_words, the number of
    an item's words, tells them apart.
    Items without a word, and null texts, match nothing. Items that repeat an item_id, or have none, are searched each, and
    two items with one text both match. Where an item lies in a document more than once, the place with the largest share
    counts, then that with the longest run, then the later one. Rows that repeat a doc_id each give their own rows; a row
    without doc_id gives rows without one.

    Items are read a partition at a time; each block's matches are stored before the next block goes out.
    """
    own = docs.select("doc_id", "text", *keep)
    kind = _LEAKS + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    context = docs.sparkSession.sparkContext
    results: list[DataFrame] = []
    ids: list[int | None] = []
    held: list[str] = []
    n_words = 0

    def searched() -> DataFrame:
        sent = context.broadcast((uuid.uuid4().hex, ids, held, least_words))
        found = cut(map_batches(own, partial(_search, shared=sent, keep=keep), kind))
        sent.destroy()
        return found

    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    for item_id, text in items.toLocalIterator():
        size = 2 * len(text.split())  # windows, in the readings that most words have
        if held and n_words + size > block:
            results.append(searched())
            ids, held, n_words = [], [], 0
        ids.append(item_id)
        held.append(text)
        n_words += size
    if held or not results:
        results.append(searched())
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found

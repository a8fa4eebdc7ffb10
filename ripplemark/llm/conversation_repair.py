"""Damage to conversations, its faults, and the cheapest repair of their role structure.

Roles have to read ``(s?(ua)+)?``. The repair of a run of turns is found by iterative-deepening A*: depth-first search
in ASCII order of the edits (D, I, K, R) under a cost bound that rises to the least cost that was cut off, so the first
accepting path is the cheapest and, of equal ones, the ASCII-least. What failed goes into a transposition table as a
lower bound of the cost still to come, which prunes later visits and later rounds.

A conversation of any length is spread over tasks by ranges of its turns and searched in blocks of bounded size: for each
state a block can begin in and each state it can end in, the search gives the best path, and the blocks' paths are chained
in order. An insertion belongs to the block of the turn behind it. Paths over the same turns end with a turn's edit, so none
of them begins another one, and the ASCII-least whole path is made of ASCII-least pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.shared import BLANKS, cut, map_batches, worker_state

#: Turns of a block, and patterns of blocks whose paths a worker remembers.
BLOCK, REMEMBERED = 24, 100_000
#: What the roles so far allow next: s or u at the start, u behind s, a behind u, u behind a; and the accepted end.
START, SYSTEM, USER, ASSISTANT, END = range(5)
#: The state behind a role's initial, by state.
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Insertions that lead from a state to an accepted end.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Costs of the edits, and of a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: A turn as the search sees it: a role initial (s, u, a, or o for others), in upper case if truncated; x if it has to go.
OTHER, GONE = "o", "x"
_NEVER = 1 << 60


def _edits(symbol: str, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, turns it takes, next state) of one turn in ASCII order of the edits."""
    steps, found = STEPS[state], [("D", DELETE, 1, state)]
    inserted = next(to for role, to in steps.items() if role != "s")
    found.append(("I", INSERT, 0, inserted))
    if symbol != GONE:
        extra = TRUNCATED if symbol.isupper() else 0
        if symbol.lower() in steps:
            found.append(("K", extra, 1, steps[symbol.lower()]))
        found.append(("R", REROLE + extra, 1, inserted))
    return found


class Search:
    """Cheapest paths over one block of turns to one end; the tables serve all states it can begin in."""

    def __init__(self, symbols: str, end: int):
        self.symbols, self.end = symbols, end
        n = len(symbols)
        # what the turns from each one on cost at least: those that have to go, and one for each truncated one
        self.least = [0] * (n + 1)
        for k in range(n - 1, -1, -1):
            self.least[k] = self.least[k + 1] + (DELETE if symbols[k] == GONE else TRUNCATED if symbols[k].isupper() else 0)
        self.bound = [[cost] * 4 for cost in self.least]  # raised by what failed
        self.edits = {(s, q): _edits(s, q) for s in set(symbols) for q in range(4)}
        self.most = DELETE * n + 2 * INSERT  # to drop all turns and insert what is missing

    def best(self, state: int) -> tuple[int, str] | None:
        """(cost, edits) from ``state`` at the first turn, or none if the end can't be reached."""
        limit = self.bound[0][state]
        while limit <= self.most:
            path = self._within(0, state, limit)
            if path is not None:
                return limit, path
            limit = self.bound[0][state]
        return None

    def _within(self, k: int, state: int, room: int) -> str | None:
        """The ASCII-least edits from turn ``k`` on that cost at most ``room``; a failure raises the bound there."""
        if self.bound[k][state] > room:
            return None
        if k == len(self.symbols):
            if state == self.end:
                return ""
            if self.end == END and INSERT * len(CLOSING[state]) <= room:
                return CLOSING[state]
            self.bound[k][state] = INSERT * len(CLOSING[state]) if self.end == END else _NEVER
            return None
        least = _NEVER
        for edit, cost, takes, to in self.edits[self.symbols[k], state]:
            if cost <= room:
                rest = self._within(k + takes, to, room - cost)
                if rest is not None:
                    return edit + rest
            least = min(least, cost + self.bound[k + takes][to])
        self.bound[k][state] = max(self.bound[k][state], least)
        return None


def block_paths(symbols: str, starts: tuple[int, ...], ends: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, edits) of the best path between each state to begin in and each to end in that it can reach."""
    found = {}
    for end in ends:
        search = Search(symbols, end)
        for start in starts:
            if (path := search.best(start)) is not None:
                found[start, end] = path
    return found


def chained(blocks: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """(cost, edits) of the best path through blocks in order; the last one may already end accepted."""
    best: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: cost and place among the paths to all states, ASCII-least first
    trail = []
    for paths in blocks:
        ways: dict[int, tuple[int, int, str, int]] = {}
        for (start, end), (cost, edits) in paths.items():
            if start in best:
                way = (best[start][0] + cost, best[start][1], edits, start)
                if end not in ways or way < ways[end]:
                    ways[end] = way
        order = sorted(ways, key=lambda q: ways[q][1:3])
        best = {q: (ways[q][0], place) for place, q in enumerate(order)}
        trail.append({q: (ways[q][3], ways[q][2]) for q in ways})
    # equal costs: paths differ before they close, as no path over the same turns begins another one
    cost, _, state = min((c + INSERT * len(CLOSING.get(q, "")), place, q) for q, (c, place) in best.items())
    pieces = [CLOSING.get(state, "")]
    for back in reversed(trail):
        state, edits = back[state]
        pieces.append(edits)
    return cost, "".join(reversed(pieces))


# --- damage and faults ---------------------------------------------------------------------------------------------


def _key(conv: Column, turn: Column) -> Column:
    return F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with damage by crc32 of ``conv_id:turn`` modulo 20; null role and text: a space.

    0 drops the row, which stays here with 0 copies; 1 empties its text; 2 takes its ``.!?`` away; 3 makes 2 copies of
    it; 4 sets role user. Rows that repeat conv_id and turn are all damaged alike. Extra columns go.
    """
    kind = F.crc32(_key(F.col("conv_id"), F.col("turn")).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


#: Order of a conversation's turns: by turn, those without one first; equal turns by role and a digest of the text.
ORDER = ("turn", "role", "digest")


def _coded(damaged: DataFrame) -> DataFrame:
    """Damaged rows with a digest of their text and whether it is blank or cut off."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    return damaged.withColumns({
        "digest": F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)),
        "blank": bare == "",
        "cut_off": ~F.substring(bare, -1, 1).isin(".", "!", "?"),
    })


def _flagged(coded: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text, with the number of its copies and whether an earlier turn has the
    same role and text. Counts and first turns are merged before the shuffle; texts don't move."""
    rows = coded.groupBy("conv_id", *ORDER, "blank", "cut_off").agg(F.sum("copies").alias("copies"))
    rows = cut(rows.withColumn("at", F.struct(F.col("turn").isNotNull().alias("there"), "turn")))
    first = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "digest")]
    return rows.alias("r").join(first.alias("f"), same, "left").select(
        "r.conv_id", *(f"r.{c}" for c in ORDER), "blank", "cut_off", "copies",
        F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("seen"))


# --- search over sorted ranges -------------------------------------------------------------------------------------

_SEGMENT = pa.schema([
    *((c, pa.int64()) for c in ("conv_id", "place", "first_turn", "last_turn")), ("first_role", pa.string()),
    ("last_role", pa.string()), *((c, pa.int64()) for c in ("n_turns", "n_rows", "blank", "duplicate", "truncated", "illegal")),
    ("paths", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])))])
_REPORT = pa.schema([
    *((c, pa.int64()) for c in ("conv_id", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
LEGAL = {"su", "ua", "au"}


class _Segment:
    """Up to BLOCK turns of a conversation that follow each other in one task."""

    def __init__(self, conv, place: int):
        self.conv, self.place, self.symbols = conv, place, ""
        self.first_turn = self.last_turn = None
        self.first_role = self.last_role = None
        self.n = {"n_turns": 0, "n_rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn, role: str, symbol: str, fault: str | None, times: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.n["n_turns"] += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        initial = role[:1]
        if self.last_role is None:
            self.first_role = initial
        else:
            self.n["illegal"] += self.last_role + initial not in LEGAL
        self.n["illegal"] += (times - 1) * (2 * initial not in LEGAL)
        self.last_role = initial
        if fault:
            self.n[fault] += times
        self.n["n_rows"] += times
        self.symbols += symbol * times

    def row(self, first: bool, last: bool) -> dict:
        starts = (START,) if first else (START, SYSTEM, USER, ASSISTANT)
        ends = (END,) if last else (START, SYSTEM, USER, ASSISTANT)
        kept = worker_state(("conversation paths",), dict)
        if len(kept) > REMEMBERED:
            kept.clear()
        key = (self.symbols, starts, ends)
        if key not in kept:
            kept[key] = [{"start": a, "end": b, "cost": cost, "edits": edits}
                         for (a, b), (cost, edits) in sorted(block_paths(*key).items())]
        return {"conv_id": self.conv, "place": self.place, "first_turn": self.first_turn, "last_turn": self.last_turn,
                "first_role": self.first_role, "last_role": self.last_role, **self.n, "paths": kept[key]}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the task's range of sorted turns. Only what lies inside the range is known to begin or end a conversation."""
    base = TaskContext.get().partitionId() << 40
    out: list[dict] = []
    held: _Segment | None = None
    place, first, nothing = base, False, object()
    conv = nothing
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "cut_off", "copies", "seen")]
        for this, turn, role, blank, cut_off, copies, seen in zip(*columns, strict=True):
            if conv is nothing or this != conv:
                if held is not None:
                    out.append(held.row(first, True))
                first = conv is not nothing
                conv = this
                place += 1
                held = _Segment(conv, place)
            initial = role[:1] if role[:1] in ("s", "u", "a") else OTHER
            once = "blank" if blank else "duplicate" if seen else "truncated" if cut_off else None
            symbol = GONE if once in ("blank", "duplicate") else initial.upper() if once else initial
            left = copies
            while left:
                if len(held.symbols) >= BLOCK:
                    out.append(held.row(first, False))
                    first = False
                    place += 1
                    held = _Segment(conv, place)
                if left == copies:
                    held.add(turn, role, symbol, once, 1)
                    left -= 1
                else:
                    n = min(left, BLOCK - len(held.symbols))
                    held.add(turn, role, GONE, "blank" if blank else "duplicate", n)
                    left -= n
        if len(out) >= 5_000:
            yield pa.RecordBatch.from_pylist(out, _SEGMENT)
            out = []
    if held is not None:
        out.append(held.row(first, False))
    yield pa.RecordBatch.from_pylist(out, _SEGMENT)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its segments in order."""
    out: list[dict] = []
    blocks: list[dict] = []
    held: dict | None = None

    def closed() -> dict:
        cost, audit = chained(blocks)
        first, last = held.pop("first_turn"), held.pop("last_turn")
        held.pop("last_role")
        gaps = 0 if first is None else last - first + 1 - held.pop("n_turns")
        return held | {"gaps": gaps, "cost": cost, "audit": audit}

    for batch in batches:
        for row in batch.to_pylist():
            paths = {(p["start"], p["end"]): (p["cost"], p["edits"]) for p in row["paths"]}
            if held is None or row["conv_id"] != held["conv_id"]:
                if held is not None:
                    out.append(closed())
                blocks, held = [paths], {k: v for k, v in row.items() if k not in ("place", "first_role", "paths")}
                continue
            blocks.append(paths)
            if held["last_role"] is not None and row["first_role"] is not None:
                held["illegal"] += held["last_role"] + row["first_role"] not in LEGAL
            held["n_turns"] += row["n_turns"] - (row["first_turn"] is not None and row["first_turn"] == held["last_turn"])
            for c in ("n_rows", "blank", "duplicate", "truncated", "illegal"):
                held[c] += row[c]
            held["first_turn"] = row["first_turn"] if held["first_turn"] is None else held["first_turn"]
            held["last_turn"] = row["last_turn"] if row["last_turn"] is not None else held["last_turn"]
            held["last_role"] = row["last_role"] or held["last_role"]
        if len(out) >= 5_000:
            yield pa.RecordBatch.from_pylist(out, _REPORT)
            out = []
    if held is not None:
        out.append(closed())
    yield pa.RecordBatch.from_pylist(out, _REPORT)


def _spark_type(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<struct<start:int,end:int,cost:long,edits:string>>')}" for f in schema)


def audit(damaged: DataFrame) -> DataFrame:
    """(conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation of
    ``damaged(conv_id, turn, role, text, copies)``, also of those that have no copy of any row.

    Texts don't move: turns travel as digests, ordered over all tasks by conversation and turn, so a conversation that
    holds most of all turns is spread like any other. audit is the string of its edits.
    """
    n = int(damaged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = cut(_flagged(_coded(damaged)))
    ordered = turns.repartitionByRange(n, "conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    segments = map_batches(ordered, _segments, _spark_type(_SEGMENT))
    gathered = segments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "place")
    return gathered.mapInArrow(_reports, _spark_type(_REPORT))


# --- repaired turns ------------------------------------------------------------------------------------------------


class _Walk:
    """Applies a conversation's edits to its turns as they come."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, START

    def _made(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "user" if self.state == USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """What goes in before the next turn, or behind the last one."""
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._made(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[self.state][role[:1]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._made(), text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[tuple[str, str, str]]]]:
    """(report of a conversation that begins or none, repaired turns that follow); a None report and no turn ends one."""
    walk: _Walk | None = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("report", "role", "text", "copies")]
        for report, role, text, copies in zip(*columns, strict=True):
            if report is not None:
                if walk is not None:
                    yield None, list(walk.inserted())
                walk = _Walk(report["audit"])
                yield report, []
            else:
                for _ in range(copies):
                    if lines := list(walk.turn(role, text)):
                        yield None, lines
    if walk is not None:
        yield None, list(walk.inserted())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_REPORT, ("repaired_sha256", pa.string())])
    out: list[dict] = []
    held, digest, begun = None, None, False
    for report, lines in _conversations(batches):
        if report is not None:
            if held is not None:
                out.append(held | {"repaired_sha256": digest.hexdigest()})
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            held, digest, begun = report, hashlib.sha256(), False
        for _, role, text in lines:
            digest.update(f"\n{role}:{text}".encode() if begun else f"{role}:{text}".encode())
            begun = True
    if held is not None:
        out.append(held | {"repaired_sha256": digest.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    out: list[tuple] = []
    size, conv, place = 0, None, 0
    for report, lines in _conversations(batches):
        if report is not None:
            conv, place = report["conv_id"], 0
        for edit, role, text in lines:
            out.append((conv, place, edit, role, text))
            place += 1
            size += len(text)
        if len(out) >= 5_000 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in out], kinds)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in out], kinds)


def _together(damaged: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report, then its turns in order. They pass through one task as a stream: batches are held, not
    conversations, since a digest of a conversation's whole text, and its order, allow nothing else."""
    n = int(damaged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("copies", "int"), ("digest", "binary"))}
    heads = reports.select("conv_id", F.lit(0).alias("tag"), F.struct(*reports.columns).alias("report"), *(v.alias(c) for c, v in none.items()))
    rows = _coded(damaged.where("copies > 0"))
    rows = rows.select("conv_id", F.lit(1).alias("tag"), F.lit(None).cast(heads.schema["report"].dataType).alias("report"), *none)
    both = heads.unionByName(rows).repartition(n, "conv_id").sortWithinPartitions("conv_id", "tag", *ORDER)
    return both.select("report", "role", "text", "copies")


def repair(damaged: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every conversation of ``damaged(conv_id, turn, role, text, copies)``
    after its cheapest repair, numbered from 0. edit is K, R or I. Conversations that lose all turns have no row."""
    reports = cut(audit(damaged))
    return map_batches(_together(damaged, reports), _turns, "conv_id long, place long, edit string, role string, text string")


def repaired_digests(damaged: DataFrame) -> DataFrame:
    """What ``audit`` gives, with repaired_sha256: of the repaired turns as ``role:text``, joined by line feeds.

    Turns without a number come first; equal numbers go by role, then by a digest of the text, rows that repeat another
    altogether side by side. Null roles and texts count as one space. A conversation without id is one conversation.
    conv_id and turn are whole numbers.
    """
    reports = cut(audit(damaged))
    return map_batches(_together(damaged, reports), _digests, _spark_type(_REPORT) + ", repaired_sha256 string")

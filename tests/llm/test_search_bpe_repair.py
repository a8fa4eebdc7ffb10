"""Reversed search, the BPE lexicon and conversation repair against slow versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ripplemark.llm import conversation_repair as repairs
from ripplemark.llm import lexicon_bpe, reverse_search
from ripplemark.llm.conversation_repair import END, START, Search, block_paths, chained, damage, repair, repaired_digests
from ripplemark.llm.lexicon_bpe import Codec, build_lexicon, decode, encode, round_trip
from ripplemark.llm.reverse_search import search, terms
from ripplemark.llm.transducer import Builder, Transducer, compiled

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


# --- transducer and BPE --------------------------------------------------------------------------------------------


def walked(transducer, some):
    content = np.frombuffer(b"".join(some), dtype="u1")
    found, counts, ids = transducer.find(content, np.concatenate(([0], np.cumsum([len(w) for w in some], dtype=np.int64))))
    ends = np.cumsum(counts)
    return [tuple(ids[e - c : e].tolist()) if there else None for there, c, e in zip(found, counts, ends, strict=True)]


def test_transducer_gives_each_word_its_ids_and_shares_ends(tmp_path):
    rng = random.Random(5)
    some = {"".join(rng.choice("abc") for _ in range(rng.randrange(8))).encode(): tuple(rng.choices(range(3), k=rng.randrange(4))) for _ in range(500)}
    block = compiled(some.items())
    (tmp_path / "words").write_bytes(block)
    probes = [*some, b"zzz", b"abcabcabcabcabc"]
    for transducer in (Transducer(block), Transducer.mapped(str(tmp_path / "words"))):
        assert walked(transducer, probes) == [some.get(w) for w in probes]
    same_ends = Transducer(compiled((a + b"ation", (k,)) for k, a in enumerate([b"b", b"c", b"st", b"n"])))
    assert len(same_ends.final) == 1 + 1 + 6  # start, behind "s", the letters of "ation" and the end
    assert walked(Transducer(compiled([])), [b"", b"a"]) == [None, None]
    with pytest.raises(ValueError):
        builder = Builder()
        builder.add(b"b", (1,))
        builder.add(b"a", (2,))


ALPHABET = "ab  \n\t'sreé1.,!　\x85​ß漢😀<|>͸"
ODD = [None, "", " ", "  two  spaces ", "a\nb\r\n\tc", "<|endoftext|> x<|endoftext|>y", "don't I'LL it's", "a\x1cb\x85c\xa0d", "a\n \nb", "a\n ",
       "a  ", "a   b", "\n b", "1.2.3 $%& _a_", "漢字 かな", "😀😀 ", "word " * 900, "a" * 5000, "xyz\0" * 1500, "aaaa aaa aaaaa", "՘ x՘y", "\0 \0"]


def bpe_rows():
    rng = random.Random(4)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(800)]
    return [*enumerate([*ODD, *made]), (3, "again"), (3, "again"), (None, "no id")]


def test_ids_and_texts_equal_the_library_with_and_without_a_lexicon(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame([(d, t, 7) for d, t in bpe_rows()], DOCS + ", ids int")
    expected = Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t in bpe_rows())
    lexicon = build_lexicon(docs, BYTES, words=300)
    for name in (None, lexicon):
        assert Counter((r.doc_id, tuple(r.ids)) for r in encode(docs, BYTES, lexicon=name).collect()) == expected
    back = decode(encode(docs, BYTES, lexicon=lexicon), BYTES).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t or "") for d, t in bpe_rows())
    digests = Counter(tuple(r) for r in round_trip(docs, BYTES).collect())
    assert digests == Counter(
        (d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
         hashlib.sha256(library.decode(list(ids), skip_special_tokens=False).encode()).hexdigest()) for d, ids in expected.elements())
    assert round_trip(docs.limit(0), BYTES).count() == 0


def test_decoding_ids_that_no_text_has(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    runs = [[], [162], [162, 96, 50256, 10], [220, 0, 255, 188]]
    odd = spark.createDataFrame([(k, ids) for k, ids in enumerate(runs)] + [(9, None), (10, [64, None, 10**6, -1, 65])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in decode(odd, BYTES).collect()}
    assert [got[k] for k in range(4)] == [library.decode(ids, skip_special_tokens=False) for ids in runs]
    assert got[9] == "" and got[10] == library.decode([64, 65], skip_special_tokens=False)


def test_every_word_is_merged_in_rank_order_also_by_the_queue(monkeypatch):
    codec = Codec(BYTES)
    some = ["aaaa", "mississippi", "x" * 31, "thethethe", "ÄÖÜ" * 9]
    batched = codec.encode(pa.array(some, pa.large_string()))[0].tolist()
    monkeypatch.setattr(lexicon_bpe, "QUEUED", 1)
    assert Codec(BYTES).encode(pa.array(some, pa.large_string()))[0].tolist() == batched


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Codec(public_tokenizers.path("word_bpe_49k.json"))


# --- reversed search -----------------------------------------------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def slow_search(docs, items, k):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    frequency = Counter(t for _, c in counted for t in c)
    found = []
    for item_id, text in items:
        scored = []
        for d, c in counted:
            n = sum(c.values())
            score = 0
            for t in plain_terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        found += [(item_id, rank + 1, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k])]
    return Counter(found)


def search_rows():
    rng = random.Random(2)
    some = ["the", "The", "café", "x1", "Éa", "über", "漢字", "a", "b", "c\xa0d"]
    docs = [(d, rng.choice([" ", "-", "\n"]).join(rng.choices(some, k=rng.randrange(30)))) for d in range(200)]
    docs += [(d, "a b same") for d in (700, 500, 600)] + [(5, "a b same"), (None, "a b same"), (None, "the the"), (901, None), (902, ""), (903, "the " * 9000)]
    items = [(k, " ".join(rng.choices(some, k=rng.randrange(1, 9)))) for k in range(40)]
    return docs, [*items, (100, "a b same"), (100, "a b same"), (None, "the x1"), (101, None), (102, "..."), (103, "nowhere")]


@pytest.mark.parametrize(("block", "cells", "exact"), [(4096, 1 << 21, 1 << 53), (7, 64, 0)])
def test_search_equals_scoring_every_pair(spark, monkeypatch, block, cells, exact):
    monkeypatch.setattr(reverse_search, "ITEMS", block)
    monkeypatch.setattr(reverse_search, "CELLS", cells)
    monkeypatch.setattr(reverse_search, "EXACT", exact)
    rows, queries = search_rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], DOCS + ", score int").repartition(5)
    items = spark.createDataFrame([(i, t, "x") for i, t in queries], "item_id long, text string, doc_id string")
    for k in (10, 3):
        assert Counter(tuple(r) for r in search(docs, items, k=k).collect()) == slow_search(rows, queries, k)


def test_search_of_and_in_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(docs.limit(0), items).count() == 0 == search(docs, items.limit(0)).count()
    assert [tuple(r)[:3] for r in search(docs, items).collect()] in ([], [(1, 1, 1)])


def test_terms_split_at_ascii_only():
    codes, _, vocabulary = terms(pa.array(["A-b_c Ü—x\x85 9", ""], pa.large_string()))
    assert [vocabulary[int(k)].as_py() for k in codes] == ["a", "b", "c", "Ü—x\x85", "9"]


# --- conversation repair -------------------------------------------------------------------------------------------


def slow_repair(faulty):
    """(cost, edits, lines) of the cheapest and then ASCII-least edits, by trying all that could be."""
    n, best = len(faulty), None
    for n_inserts in range(n + 3):
        for edits in set(itertools.permutations("I" * n_inserts + "T" * n)) if n_inserts + n < 8 else ():
            for kinds in itertools.product("DKR", repeat=n):
                kind, rows, cost, roles, lines, path = iter(kinds), iter(faulty), 0, "", [], ""
                for e in edits:
                    now = "a" if roles[-1:] == "u" else "u"
                    name = {"a": "assistant", "u": "user"}[now]
                    if e == "I":
                        cost, roles, path = cost + 2, roles + now, path + "I"
                        lines.append(f"{name}:")
                        continue
                    (role, text, fault), k = next(rows), next(kind)
                    path += k
                    if k == "D":
                        cost += 3
                        continue
                    if fault in ("blank", "duplicate"):
                        break
                    cost += (2 if k == "R" else 0) + (fault == "truncated")
                    roles += now if k == "R" else role[:1] or "?"
                    lines.append(f"{name if k == 'R' else role}:{text}")
                else:
                    if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, path) < best[:2]):
                        best = cost, path, lines
    return best


def slow_report(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        held = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            held += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()[:16]))
        faulty, seen = [], set()
        for _, role, text in held:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in held if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(held)]
        cost, path, lines = slow_repair(faulty)
        faults = Counter(f for _, _, f in faulty)
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                       sum(p not in ("su", "ua", "au") for p in pairs), cost, path, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def conversation_rows():
    rng = random.Random(6)
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.randrange(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "ux"])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, rng.choice(["Yes.", "no", " ", None, "Why?\n", "So", "é　", "Hm!"])))
    rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("block", [24, 2])
def test_repair_equals_trying_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(repairs, "BLOCK", block)
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, copies string")
    got = {r.conv_id: tuple(r)[2:4] + tuple(r)[4:] for r in repaired_digests(damage(table.repartition(6))).select(
        "conv_id", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    expected = slow_report(rows)
    assert set(got) == set(expected)
    for conv, row in expected.items():
        assert got[conv] == row, conv
    lines = {}
    for r in sorted(repair(damage(table)).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == e[-1] for c, e in expected.items())


def by_table(symbols):
    """The cheapest edits by a table over turns and states instead of a search."""
    best = {START: (0, "")}
    for s in symbols:
        ways = {}
        for q, (cost, path) in best.items():
            opened = [(q, 0, "")] + [(to, 2, "I") for e, _, takes, to in repairs._edits("x", q) if e == "I"]
            for state, more, before in opened:
                for edit, price, takes, to in repairs._edits(s, state):
                    if takes:
                        ways.setdefault(to, []).append((cost + more + price, path + before + edit))
        best = {q: min(w) for q, w in ways.items()}
    return min((c + 2 * len(repairs.CLOSING[q]), p + repairs.CLOSING[q]) for q, (c, p) in best.items())


def test_blocks_chained_give_the_whole_search():
    rng = random.Random(9)
    for _ in range(300):
        symbols = "".join(rng.choice("suauauaxUASoO") for _ in range(rng.randrange(40)))
        expected = by_table(symbols)
        assert block_paths(symbols, (START,), (END,))[START, END] == expected
        blocks = [symbols[k : k + 6] for k in range(0, len(symbols), 6)]
        assert chained([block_paths(b, (0, 1, 2, 3), (0, 1, 2, 3)) for b in blocks]) == expected


def test_failures_raise_bounds_and_never_above_the_truth():
    search = Search("uuaxAsaO", END)
    cost, path = search.best(START)
    assert (cost, path) == by_table("uuaxAsaO")
    for k in range(9):
        for q in range(4):
            rest = Search("uuaxAsaO"[k:], END).best(q)
            assert search.bound[k][q] <= rest[0]


def test_a_long_conversation_is_spread_and_an_empty_table_is_empty(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Line {k}.") for k in range(3000)] + [(2, 0, "user", "Hi.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repaired_digests(damage(table)).collect()}
    assert len(got[1].audit) >= got[1].n_rows > 2500
    symbols = "".join("x" if f in ("blank", "duplicate") else r[0].upper() if f else r[0] for r, f in long_faults(rows))
    assert (got[1].cost, got[1].audit) == by_table(symbols)
    assert repaired_digests(damage(table.limit(0))).count() == 0


def long_faults(rows):
    seen, out = set(), []
    for c, turn, role, text in rows:
        if c != 1:
            continue
        kind = zlib.crc32(f"{c}:{turn}".encode()) % 20
        role, text = "user" if kind == 4 else role, "" if kind == 1 else text.replace(".", "") if kind == 2 else text
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            out.append((role, "blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text[-1] != "." else None))
            seen.add((role, text))
    return out

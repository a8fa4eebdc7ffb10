"""Near copies, common lines, leaks and quality rules against slow versions."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ripplemark.llm import near_dedup
from ripplemark.llm.decontamination import find_leaks
from ripplemark.llm.line_dedup import drop_common_lines
from ripplemark.llm.near_dedup import near_duplicates
from ripplemark.llm.quality_rules import judge
from ripplemark.llm.shared import components

DOCS = "doc_id long, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text, width):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])


def slow_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return [(d, len(sets[i]), min((x for x in groups[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def near_rows():
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "one two three"), (6, "one two three")]
    n = 10
    for size in (2, 3, 40):
        base = prose(rng, 120)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n + k, " ".join(prose(rng, 80))) for k in range(30)]
    rows.append((None, rows[10][1]))
    rows.append((5000, " ".join(prose(rng, 60_000, 10**9))))  # very long
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, small):
    if small:  # blocks of clusters and crowded regions, at the size of a test
        monkeypatch.setattr(near_dedup, "BLOCK_NODES", 8)
        monkeypatch.setattr(near_dedup, "REGION", 32)
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS + ", set_id int, component string")
    got = near_duplicates(docs, width=3, percent=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(slow_components(rows, 3, 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_near_the_threshold_in_a_crowded_region(spark, monkeypatch):
    rng = random.Random(12)
    hub = prose(rng, 200, 10**9)
    rows = [(0, " ".join(hub))]
    for k in range(1, 301):  # each is 0.80 to 0.83 like the hub, and less like the others
        copy = list(hub)
        for at in rng.sample(range(3, 197, 6), 6):
            copy[at] = f"x{k}-{at}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(near_dedup, "REGION", 4096)
    whole = Counter((r.doc_id, r.component_id) for r in near_duplicates(docs, width=3, percent=80).collect())
    monkeypatch.setattr(near_dedup, "REGION", 16)
    crowded = Counter((r.doc_id, r.component_id) for r in near_duplicates(docs, width=3, percent=80).collect())
    assert crowded == whole == Counter((d, c) for d, _, c in slow_components(rows, 3, 80))


def test_near_duplicates_of_an_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(1000, 1100)} == {1000}


def slow_lines(rows, least):
    keys = [[lower(line.strip(" \t\n\v\f\r")) for line in (t or "").split("\n")] for _, t in rows]
    held = defaultdict(set)
    for (d, _), ks in zip(rows, keys):
        for k in ks:
            held[k].add(d)
    out = []
    for (d, t), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if not k or len(held[k]) < least]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_common_lines_go_from_every_document(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "Foot Er\nown"), (4, "Foot Er\nown"), (None, "foot er"), (None, "foot er\nÉ")]
    for k in range(10, 40):
        lines = [f"own line {k} {j}" for j in range(rng.randrange(4))] + ["  FOOT er\t"] * rng.randrange(3) + ["É", "é"][: k % 3]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    rows.append((99, "\n".join(f"line {k}" if k % 2 else "foot er" for k in range(20_000))))
    docs = spark.createDataFrame([(d, t, "s", 3) for d, t in rows], DOCS + ", source string, n_lines int")
    got = drop_common_lines(docs, least_docs=10)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == Counter(slow_lines(rows, 10))
    assert drop_common_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_measures_and_host_verdicts(spark):
    rng = random.Random(6)
    texts = [None, "", "a", "a b", "a b c", "a a a a", "x y z x y z", "# $ %\n# $ %\n\n \n", "a\n\na\nb\x0bc a\n",
             " ".join(prose(rng, 60, 5)), " ".join(prose(rng, 30_000, 50)), " ".join(prose(rng, 80)), "é É ß #*$%&|<>"]
    rows = [(k, t, "h") for k, t in enumerate(texts)] + [(90, "a b c", None), (90, "a b c", None)]
    rows += [(100 + k, "too short", "bad") for k in range(80)] + [(200 + k, " ".join(prose(rng, 90, 10**6)), "bad") for k in range(5)]
    rows += [(300 + k, " ".join(prose(rng, 90, 10**6)), "good") for k in range(90)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, DOCS + ", source string").withColumnRenamed("x", "y")).collect()}
    for d, t, host in rows:
        t = t or ""
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(grams)
        again = {p for k, g in enumerate(grams) if often[g] > 1 for p in (k, k + 1, k + 2)}
        full = [x for x in t.split("\n") if words(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(again)), d
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept) and r.host == host
    assert got[100].host_failed and not got[300].host_failed and got[90].host_rate is None
    assert got[200].kept and got[300].kept  # clean documents stay, also those of a bad host
    assert got[100].host_rate < 80 / 85  # drawn towards the rate of all
    assert judge(spark.createDataFrame([], DOCS + ", source string")).count() == 0


ITEM = "If Alice buys 12 apples and gives 5 apples to Bob, how many apples does Alice have left after walking 3 km to town?"
OTHER = "If Maria buys 40 apples and gives 7 apples to Juan, how many apples does Maria have left after walking 9 miles to town?"


def test_leaks_word_for_word_and_with_other_values(spark):
    long_item = " ".join(f"b{k}" for k in range(60))
    items = spark.createDataFrame([(1, ITEM), (2, long_item), (3, None), (4, "two words"), (5, "four words are enough"),
                                   (2, long_item)], "item_id int, text string")
    rows = [(10, "Before. " + ITEM.upper() + " After."), (11, "x " + OTHER), (12, OTHER.replace("does Maria", "does Pedro")),
            (13, "\n".join(f"b{k}," for k in range(20, 36))), (14, " ".join(f"b{k}" for k in range(9))), (15, None), (16, ""),
            (17, "here FOUR words, are enough!"), (18, "two words"), (11, "x " + OTHER), (None, ITEM),
            (19, " ".join(f"z{k}" for k in range(50_000)) + " " + long_item)]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], DOCS + ", item_id int")
    expected = Counter({(10, 1, True): 1, (11, 1, False): 2, (13, 2, True): 1, (17, 5, True): 1, (None, 1, True): 1, (19, 2, True): 1})
    for block in (1_000_000, 60):  # one pass and several
        found = find_leaks(docs, items, block=block).collect()
        assert Counter((r.doc_id, r.item_id, r.exact) for r in set(found)) == Counter(expected.keys())
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0


def test_names_at_starts_and_items_dense_in_numbers_are_leaks(spark):
    names = "Tom has 5 apples. Anna has 3 pears. Tom gives 2 apples to Anna."
    dense = "Mix 3 kg sand, 5 kg lime, 7 l water, 2 kg clay and 9 kg ash slowly."
    inner = "We saw that Rosa kept seven old boats near the harbour wall while Rosa painted every one of them."
    items = spark.createDataFrame([(1, names), (2, dense), (3, inner)], "item_id long, text string")
    other = names.replace("Tom", "Maria").replace("Anna", "Pedro").replace("5", "8").replace("2", "6")
    rows = [(1, "So.\n" + other), (2, other.replace("to Pedro", "to Maria")), (3, other.replace(". ", ".\n")),
            (4, "x y z. Mix 4 kg sand, 6 kg lime, 8 l water, 1 kg clay and 2 kg ash slowly."),
            (5, inner.replace("Rosa", "\nClara")), (6, inner.replace("Rosa", "\nClara", 1).replace("Rosa", "\nEmma")),
            (7, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"), (8, "\n".join(["The", "List", "Of", "Words"] * 40))]
    found = find_leaks(spark.createDataFrame(rows, DOCS), items).collect()
    assert {(r.doc_id, r.item_id, r.exact) for r in found} == {
        (1, 1, False), (3, 1, False), (4, 2, False), (5, 3, False)}

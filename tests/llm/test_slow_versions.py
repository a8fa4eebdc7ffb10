"""Toxicity and decontamination against loops over sentences and over all places of all items."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ripplemark.llm import toxicity
from ripplemark.llm.decontamination import find_leaks

DOCS = "doc_id long, text string"


# --- toxicity ------------------------------------------------------------------------------------------------------


def sentences_of(text):
    out = []
    for line in (text or "").split("\n"):
        current = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", line):
            current.append(word)
            if re.search(r"""[.!?]["'”’»)\]]*$""", word):
                out.append(current)
                current = []
        if current:
            out.append(current)
    return out


def features_of(word):
    bare = word.strip(toxicity._STRIPPED).lower()
    return [(0, bare)] * bool(bare) + [(kind + 1, bare[:k]) for kind, k in enumerate(toxicity.BEGINNINGS) if len(bare) > k]


def evidence_of(text, weights, bias):
    """Minus the log of the chance that no sentence is toxic."""
    return sum(math.log1p(math.exp(bias + sum(weights.get(f, 0.0) for w in s for f in features_of(w)))) for s in sentences_of(text))


def labelled():
    rng = random.Random(3)
    texts, toxic = [], []
    for k in range(160):
        parts = [" ".join(f"v{rng.randrange(60)}" for _ in range(6)).capitalize() + rng.choice([".", "!", "?)", "\n", " \n"]) for _ in range(rng.randrange(1, 6))]
        if k % 3 == 0:
            parts[rng.randrange(len(parts))] = f"You {rng.choice(['rotter', 'swinewald', 'swinefeld'])} you."
        texts.append(" ".join(parts))
        toxic.append(k % 3 == 0)
    return texts, np.array(toxic)


def test_scores_equal_a_loop_over_sentences(spark):
    texts, toxic = labelled()
    model = toxicity.fit(pa.array(texts, pa.large_string()), toxic)
    rows = [(-1, "", model[0]), *model[1]]
    odd = [*texts, None, "", "...", "No end", "A. B! C?\n\nD", "you swineX.you rotter"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], DOCS)
    weights = {(kind, f): w for kind, f, w in model[1]}
    for r in toxicity.score(docs, rows).collect():
        assert r.score == pytest.approx(-math.expm1(-evidence_of(r.text, weights, model[0])), abs=1e-9), r.text
        assert r.n_sentences == len(sentences_of(r.text))
        assert r.offending == [" ".join(s) for s in sentences_of(r.text) if evidence_of(" ".join(s), weights, model[0]) >= math.log(2)]


def test_a_step_goes_down_the_slope_of_the_documents_likelihood(monkeypatch):
    texts, toxic = labelled()
    monkeypatch.setattr(toxicity, "STEPS", 1)
    bias, rows = toxicity.fit(pa.array(texts, pa.large_string()), toxic)
    assert rows

    def loss(weights, base):
        total = 0.0
        for text, bad in zip(texts, toxic, strict=True):
            evidence = evidence_of(text, weights, base)
            total += -math.log(-math.expm1(-evidence)) if bad else evidence
        return total / len(texts)

    h = 1e-5
    for kind, feature, moved in rows:
        slope = (loss({(kind, feature): h}, toxicity.BIAS) - loss({(kind, feature): -h}, toxicity.BIAS)) / (2 * h)
        assert moved == pytest.approx(-toxicity.RATE * slope / (abs(slope) + 1e-8), rel=1e-3)
    slope = (loss({}, toxicity.BIAS + h) - loss({}, toxicity.BIAS - h)) / (2 * h)
    assert bias == pytest.approx(toxicity.BIAS - toxicity.RATE * slope / (abs(slope) + 1e-8), rel=1e-3)


# --- decontamination -----------------------------------------------------------------------------------------------


def plain(text):
    return [w for w in (w.strip(".,;:!?").lower() for w in (text or "").split()) if w]


def is_number(word):
    return re.fullmatch(r"\d+", word) is not None


def consistent(pairs):
    return all((a == c) == (b == d) for a, b in pairs for c, d in pairs)


def slow_leaks(docs, items):
    """Every item laid on every place of every document. Texts have words in lower case and numbers only."""
    found = set()
    for d, text in docs:
        words = plain(text)
        for i, item in items:
            own = plain(item)
            width = min(len(own), 8)
            if len(own) < 4:
                continue
            n = len(own) - width + 1
            for shift in range(1 - len(own), len(words)):
                there = [words[shift + k] if 0 <= shift + k < len(words) else None for k in range(len(own))]
                same = [a == b for a, b in zip(own, there, strict=True)]
                exact = [all(same[k : k + width]) for k in range(n)]
                longest = max(len(r) for r in "".join("x" if e else " " for e in exact).split(" "))
                if sum(exact) / n >= 0.5 or longest and longest + width - 1 >= 13:
                    found.add((d, i, True))
                    continue
                like = [b is not None and (a == b or is_number(a) and is_number(b)) for a, b in zip(own, there, strict=True)]
                literal = [s and not is_number(a) for s, a in zip(same, own, strict=True)]
                for least in (0, min(4, width)):
                    windows = [all(like[k : k + width]) and sum(not is_number(a) for a in own[k : k + width]) >= least for k in range(n)]
                    inside = {j for k in range(n) if windows[k] for j in range(k, k + width)}
                    share = sum(w or e for w, e in zip(windows, exact, strict=True)) / n
                    slots = [(own[j], there[j]) for j in inside if is_number(own[j])]
                    if share >= 0.6 and sum(literal[j] for j in inside) >= 4 and consistent(slots):
                        found.add((d, i, False))
                        break
    return {(d, i) for d, i, _ in found}, {(d, i) for d, i, e in found if e}


def test_leaks_equal_laying_every_item_on_every_place(spark):
    rng = random.Random(17)
    word = lambda: str(rng.randrange(20)) if rng.random() < 0.2 else f"w{rng.randrange(40)}x"
    items = [(k, " ".join(word() for _ in range(rng.randrange(3, 26)))) for k in range(40)]
    docs = []
    for d in range(160):
        words = [word() for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            how = rng.random()
            if how < 0.3:  # part of it
                at = rng.randrange(len(own))
                own = own[at : at + rng.randrange(1, 26)]
            elif how < 0.6:  # other numbers, each for each
                other = {w: str(rng.randrange(100, 200)) for w in own if is_number(w)}
                own = [other.get(w, w) for w in own]
            elif how < 0.8:  # other numbers, anyhow
                own = [str(rng.randrange(100, 200)) if is_number(w) else w for w in own]
            else:
                own = [w if rng.random() > 0.1 else word() for w in own]
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((d, " ".join(words)))
    got = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    every, exact = slow_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == every and len(every) > 60
    assert {(r.doc_id, r.item_id) for r in got if r.exact} <= exact


def test_short_and_nameless_items_and_places_that_tie(spark):
    items = spark.createDataFrame([(1, "red fox"), (None, "a blue owl sat there"), (2, "a blue owl sat there"), (3, ""), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "The Red fox and a blue owl sat there. A blue owl sat there!"), (8, "red blue fox")], DOCS)
    got = {(r.doc_id, r.item_id, r.first_word, r.item_words) for r in find_leaks(docs, items, least_words=1).collect()}
    assert got == {(7, 1, 1, 2), (7, None, 9, 5), (7, 2, 9, 5)}  # the later of equal places
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()} == {(7, None), (7, 2)}

"""Tokens, files, packing, page text, toxicity and the language model against slow versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ripplemark.llm import language_model, toxicity
from ripplemark.llm.html_text import extract_text, main_text
from ripplemark.llm.packing import best_fit, lower_bound, pack
from ripplemark.llm.shared import crc_mod, texts
from ripplemark.llm.token_counts import count_tokens
from ripplemark.llm.token_files import read_token_files, write_token_files
from ripplemark.llm.token_ids import WordIds, slices

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "  two  spaces ", "a\nb\r\n\tc", "<|endoftext|> x<|startoftext|>y", "<s> </s>", "don't I'LL it's", "İstanbul ŉ ǅ ß ẞ",
       "ÉTÉ, été. é ΑΣ", "a\x1cb\x85c\xa0d", "1.2.3 $%& ![x](y) _a_", "▁a ▁", "漢字 かな", "😀😀", "word " * 9000]


def rows():
    rng = random.Random(8)
    made = [(k, " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(300))))
            for k in range(100, 160)]
    return list(enumerate(ODD)) + made + [(100, "again"), (100, "again"), (None, "no id")]


def ids_of(text, end):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    return np.array(model.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_word_ids_equal_the_library_also_for_slices():
    held = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows()])], names=["text"])
    model = WordIds(WORDS)
    for part in slices(held, most=2000):
        ids, offsets = model.encode(texts(part))
        for k, t in enumerate(part.column("text").to_pylist()):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(t, 0)[:-1].tolist(), t


def test_slices_have_texts_of_their_own():
    held = pa.RecordBatch.from_arrays([pa.array([f"É{k} ABC" for k in range(1000)])], names=["text"])
    import pyarrow.compute as pc

    got = [x for part in slices(held, most=500) for x in pc.ascii_lower(texts(part)).to_pylist()]
    assert got == [f"É{k} abc" for k in range(1000)]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows()], DOCS + ", n_tokens int")
    got = Counter(tuple(r) for r in count_tokens(docs, PIECES, limit=100).collect())
    expected = []
    for d, t in rows():
        n = len(model.encode(t or ""))
        expected.append((d, len((t or "").encode()), n, n > 100))
    assert got == Counter(expected)
    assert count_tokens(docs.limit(0), PIECES).count() == 0


def test_token_files_round_trip_and_single_documents(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows()], DOCS + ", path string")
    manifest = write_token_files(docs, f"file://{tmp_path}/ids", WORDS, end_id=2)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (d, t) in zip(got, order, strict=True):
        ids = ids_of(t, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        assert r.ids == ids.tolist()
        at += len(ids)
    some = read_token_files(manifest, doc_ids=[100, 5, 10**9]).collect()
    assert sorted(r.doc_id for r in some) == [5, 100, 100, 100]
    assert read_token_files(manifest, doc_ids=[]).count() == 0
    assert read_token_files(write_token_files(docs.limit(0), f"file://{tmp_path}/none", WORDS)).count() == 0
    import zstandard

    path = next(p for p in (tmp_path / "ids").iterdir())
    raw = path.read_bytes()
    zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)  # any reader skips the tables
    broken = bytearray(raw)
    broken[12] ^= 255
    path.write_bytes(bytes(broken))
    with pytest.raises(Exception, match="differs|decompress|corrupt|frame|Zstd"):
        read_token_files(manifest).collect()


def test_packing_places_every_piece_once(spark):
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows()], DOCS + ", part int")
    got = pack(docs, WORDS, capacity=512, part=64).collect()
    expected = []
    for d, t in rows():
        ids = ids_of(t, 1)
        expected += [(d, k, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes()))
                     for k, at in enumerate(range(0, len(ids), 512))]
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected)
    for sequence in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    least = lower_bound(np.array([r.length for r in got]), 512)
    assert least <= len({r.sequence_id for r in got}) <= least + 1
    assert pack(docs.limit(0), WORDS).count() == 0


def test_bounds_never_exceed_what_is_used_and_tell_optimal_packings():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 500):
        for high in (10, 60, 100):
            lengths = rng.integers(1, high + 1, n)
            where, place, used = best_fit(lengths, 100)
            assert lower_bound(lengths, 100) <= used <= 1.3 * lower_bound(lengths, 100) + 1
            assert (np.bincount(where, weights=lengths) <= 100).all()
    assert lower_bound(np.full(10, 51), 100) == 10  # volume alone says 6
    assert lower_bound(np.full(9, 34), 100) == 5  # three don't fit


PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a href=/>home</a></nav><div id="content">
<h1>Title here</h1><p>First para of some length, &amp; it goes on for a good while, long enough to be seen.</p><ul><li>item one<li>item
two</ul><div class="share">Share me</div><p>Second <b>bold</b>text&nbsp;x<br>new</p><p>It.</p></div><div class="sidebar"><p>Other stuff that
is long enough to be a paragraph of its own, and then some more words after it.</p></div><section id="comments"><p>I disagree completely
with the author and I will tell you at length why that is so.</p></section><form><input name=q>Search</form><footer>&copy; 2020</footer>"""


def test_main_text_is_the_article_without_furniture(spark):
    body = "Title here\n\nFirst para of some length, & it goes on for a good while, long enough to be seen.\n\nitem one\n\nitem two" \
           "\n\nSecond boldtext x new\n\nIt."
    assert main_text(PAGE)[0] == body
    article = "<body><p>Stray words</p><article><h1>A</h1><p>b<p>c<aside>no</aside><p>d<script>e='</p>'</script></article><p>after"
    assert main_text(article)[0] == "A\n\nb\n\nc\n\nd"
    assert main_text("<p>a < b & c &lt; d <br/>e <x")[0] == "a < b & c < d e"
    assert main_text("<!-- <p>no</p> --><div>yes</div><style>p{}</style><nav>a<ul><li>b</ul></nav>")[0] == "yes"
    assert main_text("<div " * 20_000)[0] == "" and main_text("<a b='" * 2000)[0] == ""
    long = "<article>" + "".join(f"<p>para {k}</p>" for k in range(20_000)) + "</article>"
    assert main_text(long)[0].count("\n\n") == 19_999
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 3), (None, "v", "", 3)],
                                  "page_id long, url string, html string, text int")
    got = Counter(tuple(r)[:4] for r in extract_text(pages).collect())
    assert got == Counter([(1, "u", body, len(body))] * 2 + [(2, None, "", 0), (None, "v", "", 0)])
    assert extract_text(pages.limit(0)).count() == 0


def test_a_story_outside_article_elements_is_kept():
    story = " ".join(f"story{k}" for k in range(60))
    page = f"<body><div><p>{story}</p><p>{story}</p></div><article><p>Short teaser</p></article><main><p>More</p></main></body>"
    assert main_text(page) == (f"{story}\n\n{story}", 1)
    report = " ".join(f"report{k}" for k in range(60))
    both = f"<div><p>{story}</p></div><article><p>{report}</p><nav>a</nav><p>b</p></article>"
    assert main_text(both) == (f"{story}\n\n{report}\n\nb", 3)
    assert main_text("<div><p>twenty odd characters here</p></div><article><p>a teaser of fair length</p></article>")[0] == (
        "a teaser of fair length")


def toxic_rows(n=900):
    rng = random.Random(9)
    out, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.2
        sentences = [" ".join(f"v{rng.randrange(300)}" for _ in range(8)).capitalize() + "." for _ in range(rng.randrange(2, 12))]
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = sentences[at][:-1] + f" {rng.choice(['rotter', 'swinewald', 'swinefeld', 'swineberg'])}."
        out.append((k, " ".join(sentences)))
        labels.append((k, 0, int(toxic)))
    return out, labels


def test_toxicity_is_learnt_from_documents_and_found_in_sentences(spark):
    rows_, labels = toxic_rows()
    extra = [(5000, None), (5001, ""), (5002, "V1 v2. You swinetal you! V3."), (5002, "V1 v2. You swinetal you! V3."), (None, "v1 " * 90_000)]
    docs = spark.createDataFrame([(d, t, 1.5) for d, t in rows_ + extra], DOCS + ", score double")
    known = spark.createDataFrame(labels + [(5001, None, None), (None, 1, 1), (0, 0, labels[0][2])], "doc_id long, quality int, toxic int")
    got = toxicity.train_and_score(docs, known, sample=100_000).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows_) + len(extra)
    held = [(by_id[d].predicted, t) for d, _, t in labels if by_id[d].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held) and len(held) > 100
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by_id[5000].score == 0 and by_id[5001].score == 0
    assert by_id[5002].predicted == 1 and by_id[5002].offending == ["You swinetal you!"]  # an unseen ending
    kept = toxicity.score(docs, toxicity.train(docs, known.limit(0)))
    assert kept.columns == ["doc_id", "text", "score", "n_sentences", "offending"] and kept.where("score >= 0.5").count() == 0
    assert toxicity.train_and_score(docs.limit(0), known).count() == 0


def test_labels_of_the_held_out_fifth_change_nothing(spark):
    rows_, labels = toxic_rows(400)
    docs = spark.createDataFrame(rows_, DOCS)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    scores = [{r.doc_id: r.score for r in toxicity.train_and_score(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()}
              for x in (labels, turned)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-12)


@pytest.mark.parametrize("group", [1024, 1])
def test_language_model_base_is_exact_and_the_model_is_better(spark, monkeypatch, group):
    monkeypatch.setattr(language_model, "GROUP", group)  # several groups of segments: several passes
    monkeypatch.setattr(language_model, "SEGMENT_BITS", 1 << 14)
    monkeypatch.setattr(language_model, "HEAD", 50)
    rng = random.Random(10)
    phrases = [" ".join(f"p{rng.randrange(900)}" for _ in range(6)) for _ in range(60)]
    rows_ = [(k, " ".join(rng.choice(phrases) for _ in range(rng.randrange(1, 40)))) for k in range(200)]
    rows_ += [(900, None), (901, ""), (902, "New words\x0bONLY here É"), (902, "New words\x0bONLY here É"), (None, "p1 p2")]
    docs = spark.createDataFrame([(d, t, 2) for d, t in rows_], DOCS + ", n int")
    got = language_model.train_and_score(docs, crc_mod(docs["doc_id"], 7) == 2).collect()
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0"] for _, t in rows_]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows_]
    counts = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((d, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
                       for (d, _), ws, h in zip(rows_, tokens, held))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert all(r.score < 0 for r in got)


def test_language_model_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    from pyspark.sql import functions as F

    row = language_model.train_and_score(docs, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert language_model.train_and_score(docs.limit(0), F.lit(False)).count() == 0


def test_pairs_seen_once_raise_the_score(spark):
    rows = [(0, "red fox", False), (1, "blue owl", False), (2, "red fox", True), (3, "red owl", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in language_model.train_and_score(docs, docs["held"]).collect()}
    assert got[2] > got[3] + 0.01  # the same word counts, and only the pairs of the first were seen


@pytest.mark.parametrize("group", [1, 1024])
def test_scores_equal_a_dictionary_of_levels(spark, monkeypatch, group):
    """Level by level from exact counts; keys that the filters take for more than they are count with what they give."""
    monkeypatch.setattr(language_model, "GROUP", group)
    monkeypatch.setattr(language_model, "SEGMENT_BITS", 1 << 14)
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(120)]
    rows_ = [(k, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(120)], k=rng.randrange(60)))) for k in range(150)]
    rows_ += [(500, None), (3, rows_[3][1]), (3, "another text w1 w2"), (None, "w1 w1 w1")]
    docs = spark.createDataFrame(rows_, DOCS)
    held_out = crc_mod(docs["doc_id"], 7) == 2
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows_]
    trained = pa.array([t for (_, t), h in zip(rows_, held, strict=True) if not h], pa.large_string())
    tokens = language_model.Tokens(texts(pa.RecordBatch.from_arrays([trained], names=["text"])))
    counts = Counter(tokens.words.tolist()) + Counter(tokens.pairs.tolist())
    model = language_model.Model(docs.where(~held_out))
    filters = {True: [language_model.Filter(*model.words())], False: [language_model.Filter(*g) for g in model.pairs()]}
    wrong = set()

    def level(key):
        true = int(math.log2(counts[key])) + 1 if counts[key] else 0
        one = np.array([key], dtype=np.uint64)
        told = next(int(f.levels(one)[0]) for f in filters[key % 2 == 0] if f.has(one)[0])
        assert told >= true
        if told > true:
            wrong.add(key)
        return told

    def middle(q):
        return 1.5 * 2 ** (q - 1) - 0.5 if q else 0.0

    n, v = sum(c for k, c in counts.items() if k % 2 == 0), sum(1 for k in counts if k % 2 == 0)
    again = sum(c - 1 for k, c in counts.items() if k % 2)
    weight = min(max(again / n, language_model.WEIGHT[0]), language_model.WEIGHT[1])
    expected = []
    for d, t in rows_:
        own = language_model.Tokens(pa.array([t or ""], pa.large_string()))
        total = 0.0
        for word, before, pair in zip(own.words.tolist(), own.before.tolist(), own.pairs.tolist(), strict=True):
            c_before, c_word = middle(level(before)), middle(level(word))
            c_pair = min(middle(level(pair)), c_before)
            total += math.log10(weight * c_pair / max(c_before, 1) + (1 - weight) * (c_word + 1) / (n + v + 1))
        expected.append((d, round(total, 6)))
    got = Counter((r.doc_id, round(r.score, 6)) for r in language_model.train_and_score(docs, held_out).collect())
    assert got == Counter(expected)
    assert len(wrong) < 0.02 * len(counts)


STORY = ("Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod. " * 11).strip()


@pytest.mark.parametrize("names", ["layout with-sidebar", "content-area has-sidebar", "no-share", "page header-fixed", "post related-none",
                                   "entry nav-open", "sidebar", "widget share"])
def test_a_wrapper_that_names_furniture_keeps_its_story(names):
    inner = f"<h1>Title of it</h1><p>{STORY}</p>"
    assert main_text(f'<body><div class="{names}">{inner}</div><p>A line beside it.</p></body>')[0].startswith(f"Title of it\n\n{STORY}")
    assert main_text(f"<body><div class='{names}'><article>{inner}</article></div></body>")[0] == f"Title of it\n\n{STORY}"
    nested = f"<div class='{names}'>{inner}<div class='sidebar'><p>Some words about the site, its people and its past.</p></div></div>"
    assert main_text(nested)[0] == f"Title of it\n\n{STORY}"


def test_named_elements_beside_a_story_go_and_comments_at_any_length():
    for name in ("ad", "sidebar", "cookie-notice", "related-posts"):
        page = f"<p>{STORY}</p><div class='{name}'><p>{STORY[:300]}</p></div><p>{STORY}</p>"
        assert main_text(page)[0] == f"{STORY}\n\n{STORY}"
    assert main_text(f"<p>{STORY}</p><div id='comments'>{f'<p>{STORY}</p>' * 5}</div>")[0] == STORY
    assert main_text("<div class='ad'><p>Only this.</p></div>")[0] == "Only this."


def test_menus_rights_and_tags_of_a_page_of_plain_divs_go():
    paragraphs = [f"Paragraph {k} tells of many things at some length, so that nobody takes it for a menu, and ends here." for k in range(5)]
    menu = "".join(f"<div><a href='/{k}'>Menu {k}</a></div>" for k in range(8))
    tags = "".join(f"<div><a href='/t{k}'>tag {k}</a></div>" for k in range(12))
    body = "<div>A title for the story</div>" + "".join(f"<div>{p}</div>" for p in paragraphs)
    page = f"<html><body>{menu}{body}<div>© 2024 Example Media. All rights reserved.</div>{tags}</body></html>"
    assert main_text(page) == ("\n\n".join(["A title for the story", *paragraphs]), 1)
    two = f"{menu}{body}<div>one</div><div>two</div><div>three</div><div>four</div>{body}"
    assert main_text(two)[0].count("Paragraph 3") == 2


def without_tags(page):
    """The page with its structure told by nothing but plain divs."""
    at = page.find("<body")
    body = re.sub(r"<(nav|ul|li|article|header|footer|aside|main|section|h1|p)\b[^>]*>", "<div>", page[at:])
    body = re.sub(r"</(nav|ul|li|article|header|footer|aside|main|section|h1|p)>", "</div>", body)
    return page[:at] + re.sub(r' class="[^"]*"', "", body)


def test_plain_divs_give_the_text_of_the_tagged_page(spark, small_dir):
    pages = [r.html for r in spark.read.parquet(f"{small_dir}/pages.parquet").select("html").collect()]
    alike = [main_text(page)[0] == main_text(without_tags(page))[0] for page in pages]
    assert sum(alike) >= 0.9 * len(alike) > 0


def slow_regions(lines):
    """The definition for lines without tags, names and titles, line by line."""
    weight = [len(t) if linked <= len(t) / 2 else 0 for t, linked in lines]
    covered = [max(sum(weight[j : j + 3]) for j in range(max(0, k - 2), k + 1)) >= 30 for k in range(len(weight))]
    kept, k = [], 0
    while k < len(weight):
        run = k
        while weight[k] and run < len(weight) and covered[run]:
            run += 1
        if run > k:
            tall = [j for j in range(k, run) if weight[j] >= 86] or [j for j in range(k, run) if weight[j]]
            first, last = tall[0], tall[-1]
            while first > k and weight[first - 1]:
                first -= 1
            while last + 1 < run and weight[last + 1]:
                last += 1
            if max(sum(weight[j : min(j + 3, last + 1)]) for j in range(first, last + 1)) >= 86:
                kept += [t for t, _ in lines[first : last + 1]]
        k = max(run, k + 1)
    return kept


def test_lines_of_text_and_links_equal_the_slow_windows():
    rng = random.Random(12)
    for _ in range(200):
        lines = []
        for _ in range(rng.randrange(1, 25)):
            text = " ".join("word" for _ in range(rng.choice([1, 2, 8, 9, 30])))
            lines.append((text, len(text) if rng.random() < 0.3 else 0))
        page = "".join(f"<div><a>{t}</a></div>" if linked else f"<div>{t}</div>" for t, linked in lines)
        expected = slow_regions(lines)
        if expected:
            assert main_text(page)[0].split("\n\n") == expected

"""The pipeline's stages: what each lets through, and that they run one after another."""

import hashlib
import random

import corpus_pipeline as pipeline
from ripplemark.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_stages_take_out_what_they_should(spark, tmp_path):
    rng = random.Random(11)
    item = prose(rng, 40)
    texts = {k: prose(rng, 120) + ("\nshared foot" if k < 30 else "") for k in range(60)}
    texts[70] = texts[40] + " and"  # a near copy
    texts[71] = prose(rng, 50) + " " + item + " " + prose(rng, 50)
    texts[72], texts[73] = "", None
    for k in range(100, 160):
        texts[k] = prose(rng, 30) + ". You rotter you. " + prose(rng, 30)
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    rows.append(rows[50])
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int(k >= 100)) for k in texts]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").collect()) for name, df in seen.items()}
    clean = [*range(51), *range(50, 60), 70, 71, 72, 73]
    assert ids["toxicity"] == clean
    assert ids["line_dedup"] == clean
    assert all("shared foot" not in r.text and r.n_chars == len(r.text) for r in seen["line_dedup"].collect())
    assert ids["near_dedup"] == [*range(60), 71, 72, 73]
    assert ids["decontamination"] == [*range(60), 72, 73]
    assert sorted(set(ids["packing"])) == ids["decontamination"]
    assert pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_every_operator_has_one_query_and_the_oracle_names_one():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_rows_of_one_doc_id_are_told_apart_and_users_columns_stay(spark, tmp_path):
    rng = random.Random(5)
    item, copied, other, own = prose(rng, 40), prose(rng, 120), prose(rng, 120), prose(rng, 120)
    leaking = prose(rng, 30) + " " + item
    rows = [(1, copied), (5, copied + " and"), (5, other), (6, leaking), (6, own), (None, leaking), (None, prose(rng, 90)), (7, own[:400]), (7, own[:400]),
            (8, "You rotter."), (9, None), (9, ""), (1, copied + " too")]
    rows += [(100 + k, prose(rng, 30) + ". You rotter you. " + prose(rng, 30)) for k in range(60)] + [(300 + k, prose(rng, 60)) for k in range(60)]
    kinds = DOCS.split(", ")[0] + ", text string, score double, n_sentences int, offending string, n_lines int, n_dropped int, digest string, component_id int"
    table = spark.createDataFrame([(d, t, 7.5, 3, "x", -1, -2, "y", 4) for d, t in rows], kinds)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 0, int(k < 200)) for k in [*range(100, 160), *range(300, 360)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == table.columns
        assert {tuple(r)[2:] for r in docs.collect()} == {(7.5, 3, "x", -1, -2, "y", 4)}
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert not any("rotter" in (t or "") for _, t in left)
    few = sorted(((d, t) for d, t in left if d is None or d < 100), key=str)
    first = min((t for t in (copied, copied + " too")), key=lambda t: hashlib.sha256(t.encode()).hexdigest()[:32])
    assert few == sorted([(1, first), (5, other), (6, own), (None, rows[6][1]), (7, own[:400]), (9, "")], key=str)
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() == len(left)


def test_empty_tables_take_nothing_out(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for name, rows in (("full", docs), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert pipeline.run(spark, f"{tmp_path}/{name}").count() == rows.count()

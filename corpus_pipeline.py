"""A training-data pipeline over ``documents``: each stage's rows are written and read again by the next.

Toxic documents go, lines that recur across documents go, one document of each group of near copies stays, documents
that hold a benchmark item go, and what is left is packed into sequences.

Null texts count as empty and rows without doc_id as documents of their own; columns of any name pass through all
stages but the last, also those that an operator would make. Empty tables of documents, labels or benchmark items leave
nothing to take out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.llm import toxicity
from ripplemark.llm.decontamination import find_leaks
from ripplemark.llm.line_dedup import drop_common_lines
from ripplemark.llm.near_dedup import near_duplicates
from ripplemark.llm.packing import pack
from ripplemark.llm.shared import cut, shared_dir


def _aside(docs: DataFrame, *made: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its own columns of the names an operator makes out of the way, and how to name them back."""
    back = {f"__own_{c}": c for c in docs.columns if c in made}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def _digest(text: Column | str = "text") -> Column:
    """Of the text, null as empty; tells rows of one doc_id apart."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text are in ``gone(doc_id, digest)``; a null doc_id equals another."""
    gone = cut(gone.select(F.col("doc_id").alias("__doc"), F.col("digest").alias("__gone")).distinct())
    marked = docs.withColumn("__text", _digest())
    return marked.join(gone, marked["doc_id"].eqNullSafe(gone["__doc"]) & (marked["__text"] == gone["__gone"]), "left_anti").drop("__text")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under a half, by a model of the labels of these documents.

    Without a label of either kind, all stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held, back = _aside(docs, *toxicity.SCORED)
    scored = toxicity.score(held, model).where(F.col("score") < 0.5)
    return scored.select(*held.columns).withColumnsRenamed(back)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rid of lines that ten documents share; n_chars follows the text."""
    held, back = _aside(docs, "n_lines", "n_dropped")
    kept = drop_common_lines(held, least_docs=10, least_chars=1).select(*held.columns).withColumnsRenamed(back)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that shares 80 % of its 5-word shingles.

    Rows are told apart by doc_id and text: of rows with the same doc_id and near texts the one with the smallest digest
    stays, and of rows that repeat both, one; rows with the same doc_id and other texts stand for themselves. Rows without
    doc_id go only where their text is near that of a document with one.
    """
    marked = docs.select("doc_id", "text", _digest().alias("digest"))
    groups = cut(near_duplicates(marked, width=5, percent=80, keep=("digest",)))
    row = F.struct("doc_id", "digest")
    first = groups.where("group_id is not null and doc_id is not null").groupBy("group_id").agg(F.min(row).alias("first"))
    gone = groups.join(first, "group_id").where(~row.eqNullSafe(F.col("first")))
    kept = _without(docs, gone)
    once = kept.where("doc_id is not null").withColumn("__text", _digest()).dropDuplicates(["doc_id", "__text"])
    return once.drop("__text").unionByName(kept.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of four words or more; shorter ones are too common to tell a leak."""
    marked = docs.select("doc_id", "text", _digest().alias("digest"))
    leaks = find_leaks(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("digest",))
    return _without(docs, leaks)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can't express a trained model, a tokenizer or a packing; tests compare stages with slow versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

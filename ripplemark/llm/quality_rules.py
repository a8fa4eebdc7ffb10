"""Quality rules of documents, and verdicts on their hosts. DataFrame functions only.

Rules look at one document. Their failures are added up by host, and each host's failure rate is drawn towards
the rate of all hosts by a beta prior that is fitted to the hosts themselves. A document of a host whose drawn rate
is high has to keep a margin from every limit; elsewhere the limits themselves do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.shared import BLANKS, cut

_SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 3


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE, -1))


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    n_repeat_words counts the words in 3-word windows that occur twice or more, the first one included. Hashes of the
    windows are sorted with their position in the low bits, which makes equal windows neighbours; neighbours are then
    compared by whole hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    first = docs.select(
        *[F.col(c) for c in docs.columns if c != "text"], words_of(text).alias("__words"), lines.alias("__lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    counted = first.select(
        "*", F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    ).drop("__words", "__lines")
    windows = F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")
    hashed = counted.select(
        "*", F.transform(
            F.slice("__hashes", F.lit(1), windows),
            lambda h, i: F.xxhash64(h, *[F.get("__hashes", i + k) for k in range(1, WINDOW)])).alias("__windows"),
        # low bits that hold any position
        F.expr("shiftleft(1L, cast(ceil(log2(n_words + 2)) as int)) - 1").alias("__low"),
    ).drop("__hashes")
    sorted_ = hashed.select(
        "*", F.sort_array(F.transform(
            "__windows", lambda h, i: h.bitwiseAND(F.bitwise_not("__low")).bitwiseOR(i.cast("long")))).alias("__sorted"))

    def at(x: Column) -> Column:
        return x.bitwiseAND(F.col("__low")).cast("int")

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce(
            (x.bitwiseXOR(y) <= F.col("__low")) & (x.bitwiseXOR(y) >= 0)
            & (F.get("__windows", at(x)) == F.get("__windows", at(y))), F.lit(False))

    again = F.filter("__sorted", lambda x, i: equal(x, F.get("__sorted", i - 1)) | equal(x, F.get("__sorted", i + 1)))
    places = sorted_.select("*", F.sort_array(F.transform(again, at)).alias("__places")).drop("__windows", "__sorted")
    covered = F.aggregate(
        F.transform("__places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__places", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda total, n: total + n)
    kept = [c for c in docs.columns if c != "text"]
    return places.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         covered.cast("long").alias("n_repeat_words"))


def judge(docs: DataFrame, *, host: str = "source", least_words: int = 50, most_repeat: int = 50,
          most_host_rate: float = 0.5, margin_repeat: int = 25, margin_symbols: int = 10) -> DataFrame:
    """(doc_id, host, measures, base_failed, host_rate, host_failed, kept) for every row of ``docs``.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeat`` percent of them repeated. A host fails
    if its rate, drawn to the prior, is over ``most_host_rate``; then a document is kept only if at most
    ``margin_repeat`` percent of its words are repeated and it has at most ``margin_symbols`` symbols per 100 words.
    Null text: no words. Null host: judged by its own rules only, host_rate null. Repeated rows count as often as they
    are there. Only doc_id, text and the host column are read, so names of other columns don't matter.
    """
    base = with_measures(docs.select("doc_id", "text", F.col(host).cast("string").alias("host"))).withColumn(
        "base_failed", (F.col("n_words") < least_words)
        | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words")))
    base = cut(base)
    hosts = cut(base.where("host is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    rate = F.col("failed") / F.col("n")
    sums = hosts.agg(F.sum("n"), F.sum("failed"), F.count("*"), F.sum(F.col("n") * rate * rate),
                     F.sum(F.col("n") * F.col("n"))).first()
    strength, mean = _prior(*sums)
    hosts = hosts.select("host", ((F.col("failed") + strength * mean) / (F.col("n") + strength)).alias("host_rate"))
    judged = base.join(hosts, "host", "left").withColumn(
        "host_failed", F.coalesce(F.col("host_rate") > most_host_rate, F.lit(False)))
    wide = ((100 * F.col("n_repeat_words") <= margin_repeat * F.col("n_words"))
            & (100 * F.col("n_symbols") <= margin_symbols * F.col("n_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & (~F.col("host_failed") | wide)).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "host_rate", "host_failed", "kept")


def _prior(n: int | None, failed: int | None, hosts: int, squares: float | None, n_squares: int | None):
    """Strength and mean of the beta prior by moments: what hosts differ beyond what chance makes them differ."""
    if not n:
        return 1.0, 0.5
    mean = failed / n
    noise = mean * (1 - mean)
    between = squares - n * mean * mean - (hosts - 1) * noise
    spread = n - n_squares / n
    variance = between / spread if spread > 0 else 0.0
    strength = noise / variance - 1 if variance > 0 else 1e6
    return float(min(max(strength, 1.0), 1e6)), float(mean)

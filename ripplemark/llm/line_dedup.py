"""Lines that recur across documents, dropped from all of them. DataFrame functions only.

Lines travel as a 128-bit hash of their key and a position; texts move once, to meet their own dropped positions.
The distinct documents of a hash are counted after equal (hash, document) rows were merged, so a line that very many
documents share is no hot key, and the join back to such a line's documents is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.shared import BLANKS, cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hash(column: Column) -> Column:
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit("second"), column).alias("b"))


def drop_common_lines(docs: DataFrame, *, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` rid of common lines, and the columns n_lines, n_dropped and keyed.

    Texts are split at \\n; a null or empty text is one empty line. A key is a line without white space at its ends,
    A-Z lower-cased. Keys of ``least_chars`` code points that ``least_docs`` documents have lose all their lines
    everywhere; the others stay, joined by \\n, in order. A document is a doc_id, so rows that repeat one count once
    (rows without doc_id count as one document together), while each row keeps its own lines. Other columns pass
    through; columns named n_lines or n_dropped are replaced. An empty table gives no row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.drop("n_lines", "n_dropped").withColumn("__row", _hash(text))
    slim = base.select("doc_id", "__row", F.posexplode(F.transform(F.split(text, "\n", -1), line_key)).alias("at", "key"))
    slim = cut(slim.where(F.char_length("key") >= least_chars)
               .select("doc_id", "__row", "at", _hash(F.col("key")).alias("h")))
    # stored, so that both sides of the join are dealt for it and Spark may split a hot line's rows
    common = cut(slim.select("h", "doc_id").distinct().groupBy("h").agg(F.count("*").alias("n"))
                 .where(F.col("n") >= least_docs).select("h"))
    gone = (slim.join(common, "h", "left_semi").groupBy(F.col("doc_id").alias("__doc"), F.col("__row").alias("__same"))
            .agg(F.array_sort(F.collect_set("at")).alias("__gone")))
    lines = F.split(text, "\n", -1)
    n_gone = F.coalesce(F.size("__gone"), F.lit(0))
    # what lies between the dropped positions, each stretch cut out once
    kept = F.flatten(F.transform(
        F.sequence(F.lit(0), n_gone),
        lambda k: F.slice(
            F.col("__lines"),
            F.when(k == 0, F.lit(1)).otherwise(F.get("__gone", k - 1) + 2),
            F.when(k == n_gone, F.size("__lines")).otherwise(F.get("__gone", k))
            - F.when(k == 0, F.lit(0)).otherwise(F.get("__gone", k - 1) + 1))))
    met = base.join(gone.hint("shuffle_hash"),
                    base["doc_id"].eqNullSafe(gone["__doc"]) & (base["__row"] == gone["__same"]), "left")
    return (met.withColumn("__lines", lines)
            .withColumn("n_lines", F.size("__lines").cast("long"))
            .withColumn("n_dropped", n_gone.cast("long"))
            .withColumn("text", F.when(n_gone == 0, text).otherwise(F.array_join(kept, "\n")))
            .select(*docs.drop("n_lines", "n_dropped").columns, "n_lines", "n_dropped"))

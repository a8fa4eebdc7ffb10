"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.llm import language_model, toxicity
from ripplemark.llm.conversation_repair import damage, repaired_digests
from ripplemark.llm.decontamination import find_leaks
from ripplemark.llm.html_text import extract_text
from ripplemark.llm.lexicon_bpe import round_trip
from ripplemark.llm.line_dedup import drop_common_lines
from ripplemark.llm.near_dedup import near_duplicates
from ripplemark.llm.packing import pack
from ripplemark.llm.quality_rules import judge
from ripplemark.llm.reverse_search import search
from ripplemark.llm.shared import crc_mod, shared_dir
from ripplemark.llm.token_counts import count_tokens
from ripplemark.llm.token_files import read_token_files, write_token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.train_and_score(docs, labels).select("doc_id", "held_out", "score", "predicted", "n_sentences")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    manifest = write_token_files(_table(spark, sf_dir, "documents"), folder, _tokenizer("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest, with_ids=False)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(_table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least_words=1)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.train_and_score(_table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


def op11_reverse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(damage(_table(spark, sf_dir, "conversations"))).drop("n_rows")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: made for name, made in list(globals().items()) if name.startswith("op") and callable(made)
}

_LINES = """
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
"""
_KEYED = f"""
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM ({_LINES})
"""
_OP6 = f"""
WITH keyed AS ({_KEYED}),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.key = c.key
GROUP BY doc_id
"""

#: Words of each document, by a class that says "anything but ASCII white space".
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_OP8 = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
measured AS (
  SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])
           - len(list_distinct([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN covered c USING (doc_id)
),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM based WHERE source IS NOT NULL GROUP BY 1),
total AS (
  SELECT sum(n) AS n, sum(failed) / sum(n) AS mean, count(*) AS hosts, sum(failed * failed / n) AS squares, sum(n * n) AS nn FROM hosts
),
spread AS (
  SELECT mean, (squares - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / nullif(n - nn / n, 0) AS between_hosts FROM total
),
prior AS (
  SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 1e6) ELSE 1e6 END AS strength
  FROM spread
),
rates AS (SELECT source, (failed + strength * mean) / (n + strength) > 0.5 AS bad FROM hosts, prior)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND (NOT coalesce(bad, false) OR (100 * n_repeat_words <= 25 * n_words AND 100 * n_symbols <= 10 * n_words)) AS kept
FROM based LEFT JOIN rates USING (source)
"""
_OP9 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, chr(10)) FROM docs WHERE len(w) BETWEEN 1 AND 2
  )
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM docs
  UNION SELECT reached.doc_id, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.other
)
SELECT docs.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(other) AS component_id, docs.doc_id = min(other) AS kept
FROM docs JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY docs.doc_id
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
_OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, terms, len(terms) AS n FROM (SELECT doc_id, {_TERMS} AS terms FROM documents)),
total AS (SELECT count(*) FILTER (n > 0) AS nn, coalesce(sum(n), 0)::BIGINT AS l FROM docs),
items AS (SELECT i, item_id, term, count(*) AS times FROM (
  SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark)
) GROUP BY ALL),
occurs AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY ALL
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM occurs, total GROUP BY term
),
valued AS (
  SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l))) AS worth
  FROM occurs JOIN docs USING (d) JOIN weights USING (term), total
),
scored AS (
  SELECT i, item_id, d, doc_id, CAST(sum(times * worth) AS BIGINT) AS score
  FROM items JOIN valued USING (term) GROUP BY ALL HAVING sum(times * worth) > 0
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored
WINDOW best AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER best <= 10
"""

#: States: 0 start, 1 behind s, 2 behind u, 3 behind a. No cheapest path inserts twice before a turn, or before it drops one.
_OP13 = r"""
WITH RECURSIVE remainders AS (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
    FROM range(256) x(i))
),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
),
kinds AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, remainders
),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(sha256(text), 1, 32), copy) AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
  FROM damaged
),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed
),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
steps(q, initial, made, to_q) AS (VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
inserts AS (SELECT q, made, to_q FROM steps WHERE made IS NOT NULL),
starts AS (SELECT q, '' AS edits, 0 AS cost, [] :: VARCHAR[] AS lines, q AS now FROM range(4) x(q)
           UNION ALL SELECT q, 'I', 2, [made || ':'], to_q FROM inserts),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, [] :: VARCHAR[] AS lines
  FROM conversations
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT w.conv_id, f.i, o.q, CAST(w.cost + o.cost AS BIGINT) AS cost, w.audit || o.edits AS audit, list_concat(w.lines, o.lines) AS lines
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1, LATERAL (
      SELECT w.q AS q, 'D' AS edits, 3 AS cost, [] :: VARCHAR[] AS lines
      UNION ALL
      SELECT s.to_q, b.edits || 'K', b.cost + (f.fault IS NOT NULL) :: INT, list_append(b.lines, f.role || ':' || f.text)
      FROM starts b JOIN steps s ON s.q = b.now WHERE b.q = w.q AND s.initial = left(f.role, 1) AND coalesce(f.fault, 'truncated') = 'truncated'
      UNION ALL
      SELECT s.to_q, b.edits || 'R', b.cost + 2 + (f.fault IS NOT NULL) :: INT, list_append(b.lines, s.made || ':' || f.text)
      FROM starts b JOIN inserts s ON s.q = b.now WHERE b.q = w.q AND coalesce(f.fault, 'truncated') = 'truncated'
    ) o
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1
),
closed AS (
  SELECT w.conv_id, w.cost + CASE q WHEN 2 THEN 2 WHEN 1 THEN 4 ELSE 0 END AS whole, audit || CASE q WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END AS edits,
         list_concat(lines, CASE q WHEN 2 THEN ['assistant:'] WHEN 1 THEN ['user:', 'assistant:'] ELSE [] END) AS lines
  FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0)
),
ended AS (
  SELECT conv_id, whole AS cost, edits AS audit, lines FROM closed
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY whole, edits) = 1
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
       sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLES: dict[str, str] = {"op6_line_dedup": _OP6, "op8_quality_rules": _OP8, "op9_near_duplicates": _OP9,
                           "op11_reverse_search": _OP11, "op13_conversation_repair": _OP13}

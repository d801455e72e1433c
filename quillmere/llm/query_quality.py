"""op7: the quality ledger of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import quality


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = quality.decide(quality.ledger(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(F.lit(quality.BASE)) != 0).alias("base_failed"), "kept", "n_lines", "n_exclaims", "fail_bits")


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\t-\r ]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\t-\r ]')) AS lines
  FROM t
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), d AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n >= 2
), c AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims
  FROM w LEFT JOIN c USING (rid)
), b AS (
  SELECT *, ((n_words < 50)::BIGINT * 1 + (100 * n_repeat_words > 50 * n_words)::BIGINT * 2 + (10 * n_symbols > n_words)::BIGINT * 4
    + (20 * n_dup_lines > 7 * n_lines)::BIGINT * 8 + (word_chars < 3 * n_words)::BIGINT * 16 + (word_chars > 10 * n_words)::BIGINT * 32
    + (5 * n_exclaims > n_words)::BIGINT * 64)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, n_lines, n_exclaims, fail_bits
FROM b
"""

QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": SQL}

"""op6: words of all documents that stand in a window of a benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import decontaminate


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-/:-`{-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-/:-`{-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark
), v AS (
  SELECT DISTINCT item_id, array_to_string(words[s + 1 : s + 13], ' ') AS w, least(len(words), 13) AS n
  FROM (SELECT item_id, words, unnest(range(0, greatest(len(words) - 12, 1))) AS s FROM i WHERE len(words) > 0)
), n AS (
  SELECT DISTINCT n FROM v
), g AS (
  SELECT rid, s, n, array_to_string(words[s + 1 : s + n], ' ') AS w
  FROM (SELECT rid, words, n, unnest(range(0, len(words) - n + 1)) AS s FROM d, n WHERE len(words) >= n)
), m AS (
  SELECT rid, s, g.n, item_id FROM g JOIN v USING (w)
), h AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM m)) GROUP BY rid
), t AS (
  SELECT rid, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM m) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {"op6_decontaminate": SQL}

"""op8: components of all documents by the similarity of their shingle sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import jaccard_join


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# pairs by shared shingles, then all that each document reaches
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT rid, list_distinct(list_transform(range(0, greatest(len(words) - 3, 1)), lambda i: array_to_string(words[i + 1 : i + 4], ' '))) AS grams
  FROM d WHERE len(words) > 0
), g AS (
  SELECT rid, len(grams) AS n, unnest(grams) AS gram FROM s
), p AS (
  SELECT x.rid AS a, y.rid AS b FROM g x JOIN g y ON x.gram = y.gram AND x.rid < y.rid
  GROUP BY x.rid, y.rid HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT rid, rid AS other FROM s UNION SELECT r.rid, e.b FROM r JOIN e ON r.other = e.a
), m AS (
  SELECT r.rid, min(d.doc_id) AS least FROM r JOIN d ON d.rid = r.other GROUP BY r.rid
)
SELECT doc_id, coalesce(len(grams), 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id
FROM d LEFT JOIN s USING (rid) LEFT JOIN m USING (rid)
"""

QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLES = {"op8_jaccard_join": SQL}

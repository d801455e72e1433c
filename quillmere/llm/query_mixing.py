"""op4: the mix of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import mixing


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"))
    mixed = mixing.mix(rows, F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r ]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), s AS (
  SELECT k, sum(size)::BIGINT AS source_size, ([5, 2, 1])[1 + ((row_number() OVER (ORDER BY k) - 1) % 3)::INT]::BIGINT AS w
  FROM d GROUP BY k
), o AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY source_size / w::DOUBLE, k) AS i FROM s
), p AS (
  SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
         sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM o
), c AS (
  SELECT *, l * w > 3 * source_size * ws AS above FROM p
), f AS (
  SELECT (any_value(total) - coalesce(sum(3 * source_size) FILTER (WHERE above), 0))::BIGINT AS l, (sum(w) FILTER (WHERE NOT above))::BIGINT AS ws FROM c
), t AS (
  SELECT k, source_size, CASE WHEN above THEN (3 * source_size)::DOUBLE ELSE (f.l * w)::DOUBLE / f.ws::DOUBLE END AS target FROM c, f
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
         ('0x' || substr(md5('mix' || k), 1, 3))::INT / 4096.0::DOUBLE AS u, row_number() OVER (PARTITION BY k ORDER BY size, doc_id) - 1 AS rk
  FROM d JOIN t USING (k)
)
SELECT doc_id, size, source_size, target, (floor(e * (rk + 1) + u) - floor(e * rk + u))::BIGINT * size AS taken,
       (floor(e * (rk + 1) + u) - floor(e * rk + u))::BIGINT AS copies
FROM r
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": SQL}

"""op9: lines of all documents that many documents hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.line_dedup import LineStore


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # as an incremental corpus: a hundredth of the documents is deleted and comes back
    some = docs.where(F.pmod("doc_id", F.lit(100)) == 0)
    store = LineStore.build(docs).delete(some.select("doc_id")).insert(some)
    kept = store.dedup(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT rid, doc_id, i, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), c AS (
  SELECT k, max(doc_id) AS best FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT rid) >= 5
), m AS (
  SELECT rid, doc_id, i, line, c.k IS NOT NULL AND doc_id IS DISTINCT FROM best AS gone FROM l LEFT JOIN c USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": SQL}

"""op10: all pages as WARC records, read back from the archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import warc


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_warcs(warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 is spelled out: 32 five-bit groups of the 160-bit digest
SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(0, 8), lambda k: lpad(bin(('0x' || substr(x, 5 * k + 1, 5))::BIGINT), 20, '0')), '') AS bits FROM p
), d AS (
  SELECT page_id, x, strlen(h)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY x) AS best,
         array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, 5 * k + j + 1, 1)::INT * (16 >> j)))::INT, 1)), '') AS payload_digest
  FROM b
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d
"""

QUERIES = {"op10_warc": op10_warc}
ORACLES = {"op10_warc": SQL}

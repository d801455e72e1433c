"""op5: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import html_text


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


# The supplied pages hold their main text in an article element with nothing else in it. SQL cannot find it elsewhere; that is
# what the labelled pages of the tests are for.
SQL = r"""
WITH a AS (
  SELECT page_id, url, list_transform(regexp_extract_all(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), lambda x: regexp_replace(x, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g')) AS parts FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(array_to_string(parts, '<p>'), '</?(?:p|h[1-6]|div|li|ul|ol|blockquote|section)\b[^>]*>'),
         lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g'))) AS blocks FROM a
), c AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM c
"""

QUERIES = {"op5_html_text": op5_html_text}
ORACLES = {"op5_html_text": SQL}

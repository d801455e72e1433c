"""A corpus pipeline of five of the llm operators.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame; all but
the last return the columns of documents. run() writes each stage's rows as Parquet in the shared folder and reads them
again for the next one.

Rows with a null or empty text are rejected by the quality rules. Rows with one doc_id and one text are one document from
the near-duplicate stage on. Tables without rows pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import decontaminate, jaccard_join, mixing, quality, token_ids
from quillmere.shared import materialise, tidied

#: Near duplicates: word shingles and percent of similarity.
SHINGLE, SIMILARITY = 5, 80
END = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps."""
    return quality.decide(quality.ledger(docs)).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id (null last), of equal ones that with the smallest
    hash of its text. Rows are told apart by a written number, so null or repeated doc_ids take no other row along."""
    keyed = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    classes = jaccard_join.classes(keyed, doc_id="_row", k=SHINGLE, threshold=SIMILARITY).withColumnRenamed("doc_id", "_row")
    rows = keyed.select("_row", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text")).join(classes, "_row")
    # texts without words link with nothing; of these only rows with one doc_id and one text are one document
    empty = F.col("n_shingles") == 0
    group = (F.when(~empty, F.col("component_id")), F.when(empty, F.col("_id")), F.when(empty, F.col("_text")))
    rows = materialise(rows.select("_row", "_id", "_text", *(g.alias(f"_group{i}") for i, g in enumerate(group))), "rows", few=True)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text", "_row")).alias("first")
    kept = rows.groupBy("_group0", "_group1", "_group2").agg(first).select("first._row")
    # numbers alone, and broadcast up to a checked number of them
    gone = materialise(rows.select("_row").join(kept, "_row", "left_anti"), "gone", few=True)
    if gone.count() <= jaccard_join.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return keyed.join(gone, "_row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates. A decision goes by doc_id and text; the texts stay where they are."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find(keyed, items, keep=["doc_id", "_text"]).where("contaminated")
    hit = materialise(found.select(F.col("doc_id").alias("_hit"), F.col("_text").alias("_hit_text")).distinct(), "contaminated", few=True)
    if hit.count() <= jaccard_join.BROADCAST_ROWS:
        hit = F.broadcast(hit)
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_hit")) & (F.xxhash64("text") == F.col("_hit_text")), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(mixing.mix(docs, mixing.n_words(F.col("text"))), docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents in files, and what these hold of each document."""
    files = token_ids.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), END)
    return token_ids.read_tokens(files, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
    ("token-ID output", token_output),
]

#: Tokens and connected components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        # what a stage wrote on its way goes; the token files are what the pipeline makes
        docs = tidied(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"stage-{k}", keep=("tokens", "token-files"))
    return docs

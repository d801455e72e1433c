"""op2: the ids of all documents, from the files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import token_ids

END = 2


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = token_ids.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), END)
    return token_ids.read_tokens(files, with_ids=False)


QUERIES = {"op2_token_ids": op2_token_ids}
ORACLES: dict[str, str] = {}

"""Snapshot updates from a stream of mutation files.

Each micro-batch is applied as one update. Replaying a batch gives the same snapshot, so the checkpoint of the stream and
idempotent updates together lose and double nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillmere.sources import jsonl
from quillmere.sources.snapshot import Snapshot


def follow(spark: SparkSession, folder: str, root: str, checkpoint: str, files_per_batch: int = 100, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Applies JSONL files of operations as they arrive in a folder; stops when what is there is done (availableNow).

    after: called with the number of each batch when it is applied and not yet committed.
    """
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(folder)
    rows = lines.select(F.col("_metadata.file_modification_time").cast("long").alias("_o1"), F.col("_metadata.file_path").alias("_o2"), F.col("value").alias("line"))

    def apply(batch: DataFrame, number: int) -> None:
        some = batch.withColumn("_o3", F.monotonically_increasing_id()).where(F.btrim("line", F.lit(" \t\r\n")) != "")
        Snapshot.open(batch.sparkSession, root).apply(jsonl.numbered(some, ["_o1", "_o2", "_o3"]))
        if after is not None:
            after(number)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

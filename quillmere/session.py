"""Session factory with the settings that the engine's semantics rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Sets what results depend on: case-sensitive names and UTC."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillmere")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "2097152")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return configure(builder.getOrCreate())

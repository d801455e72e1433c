"""Folders that the driver and all executors share.

Everything an operator materialises goes to a fresh folder below spark.checkpoint.dir. Spark's own writers commit tables
atomically. Files that tasks write themselves get a name of their own for each attempt and count only once a committed
table lists them, so a task that runs twice, or an executor that is lost, leaves nothing that is read later.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables of a few narrow columns are written by about a task for each core, or for so many shuffle partitions where those
#: are more, and not by one for each partition: small files cost more than they hold.
PARTITIONS_A_TASK = 8
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 2 << 20

#: Folders made by operators that are being tidied up in this thread, innermost last.
_making = threading.local()
#: Folders of local sessions that have no shared folder, by application.
_local: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    """The shared folder of the session. Only a session within this process may do without: it gets a temporary folder."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("operators write to spark.checkpoint.dir, a folder that the driver and all executors share; set it")
    return _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="quillmere-"))


def scratch(spark: SparkSession, label: str) -> str:
    """URI of a new folder in the shared folder of the session."""
    path = f"{base(spark).rstrip('/')}/quillmere/{label}-{uuid.uuid4().hex}"
    made = getattr(_making, "stack", None)
    if made:
        made[-1].append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Folders that are made within are removed at the end."""
    if not hasattr(_making, "stack"):
        _making.stack = []
    made: list[str] = []
    _making.stack.append(made)
    try:
        yield
    finally:
        _making.stack.pop()
        for path in made:
            remove(spark, path)


def materialise(df: DataFrame, label: str, few: bool = False, compression: str = "snappy") -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and what is nondeterministic is fixed.

    few: df is narrow and small against the input, so that one task may write several partitions of it.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    if few:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_TASK))
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bounds what goes to a Python worker at a time by its bytes, unless the session's own bound is smaller. Without it a
    batch of long texts is bounded by its rows alone, and both sides hold several times its size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:  # other spellings have units above bytes
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Gives what a Python worker has freed back to the system; the worker stays for later tasks, beside a growing JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator], rows: int = 1 << 15) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, with batches of so many rows at most, and release() at the end of each task."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            for batch in run(batches):
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows)
        finally:
            release()

    return wrapped


def remove(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidied(make: Callable[[], DataFrame], spark: SparkSession, label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """What make() returns, written; the folders that were made on the way are removed, but for those with these labels."""
    if not hasattr(_making, "stack"):
        _making.stack = []
    made: list[str] = []
    _making.stack.append(made)
    try:
        try:
            result = make()
        finally:
            _making.stack.pop()
        return materialise(result, label)
    finally:
        for path in made:
            if path.rpartition("/")[2].rpartition("-")[0] not in keep:
                remove(spark, path)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


@contextmanager
def writing(uri: str) -> Iterator:
    """A binary file in the shared folder, for tasks; its folder is made if needed."""
    filesystem, path = _filesystem(uri)
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(path, compression=None) as out:
        yield out


def read_bytes(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """Bytes of a file in the shared folder, for tasks."""
    filesystem, path = _filesystem(uri)
    with filesystem.open_input_file(path) as source:
        source.seek(start)
        return source.read(length) if length is not None else source.read()

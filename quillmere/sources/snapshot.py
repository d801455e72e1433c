"""Snapshots: immutable, versioned tables of documents.

    root/CURRENT           JSON: the version that readers see, its schema and row count; replaced by a rename
    root/v=000001/         Parquet: _row, _doc and the typed fields
    root/v=000001.index/   analysed columns, terms, postings and trigrams, if prepared

A version is written beside the others and shown when it is whole; readers of older versions are not disturbed. Updates are
all or nothing.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere import errors
from quillmere.operators import search as searching
from quillmere.operators.prepared import Index
from quillmere.plans.binder import Field, Schema
from quillmere.shared import _filesystem, materialise, passing, read_bytes, writing
from quillmere.sources import jsonl


def _uri(root: str) -> str:
    return root.rstrip("/") if "://" in root else "file://" + os.path.abspath(root)


@contextlib.contextmanager
def write_lock(root: str) -> Iterator[None]:
    """One writer at a time; another one is told so at once. For file systems with locks; elsewhere writers must agree."""
    if not root.startswith("file://"):
        yield
        return
    path = root.removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.lock", "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise errors.Busy("another writer holds the snapshot") from None
        yield


def data_files(folder: str) -> tuple[tuple[str, int], ...]:
    from pyarrow import fs

    filesystem, path = _filesystem(folder)
    found = filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return tuple(sorted((i.base_name, i.size) for i in found if i.base_name.endswith(".parquet")))


@dataclass(frozen=True)
class Manifest:
    version: int
    rows: int
    fields: tuple[Field, ...]
    files: tuple[tuple[str, int], ...] = ()  # name and bytes of each data file

    @classmethod
    def read(cls, root: str) -> Manifest:
        try:
            data = json.loads(read_bytes(f"{root}/CURRENT"))
        except FileNotFoundError:
            raise errors.NotFound(f"no snapshot in {root}") from None
        return cls(data["version"], data["rows"], tuple(Field(**f) for f in data["fields"]), tuple((n, size) for n, size in data.get("files", ())))

    def check(self, root: str) -> None:
        """That the version's files are those that were published. Reads no data."""
        if self.files and (now := data_files(f"{root}/v={self.version:06d}")) != self.files:
            lost = sorted(set(self.files) - set(now))
            raise errors.QuillmereError(f"the snapshot is damaged: {lost[0][0] if lost else 'a file that it does not know'}")

    def publish(self, root: str) -> None:
        mark = f"{root}/.CURRENT-{uuid.uuid4().hex}"
        with writing(mark) as out:
            out.write(json.dumps(asdict(self)).encode())
        filesystem, path = _filesystem(mark)
        filesystem.move(path, path.rpartition("/")[0] + "/CURRENT")


class Snapshot:
    """One version of a snapshot."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest):
        self.spark, self.root, self.manifest = spark, root, manifest
        spark.conf.set("spark.sql.caseSensitive", "true")
        self.schema = Schema(manifest.fields)
        self.frame = spark.read.schema(jsonl.spark_schema(self.schema)).parquet(self._path(manifest.version))
        self.table = searching.Table(self.frame, self.schema)
        self.index: Index | None = Index.find(self.table, f"{self._path(manifest.version)}.index")

    def _path(self, version: int) -> str:
        return f"{self.root}/v={version:06d}"

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Snapshot:
        root = _uri(root)
        manifest = Manifest.read(root)
        manifest.check(root)
        return cls(spark, root, manifest)

    @classmethod
    def build(cls, spark: SparkSession, source: str, root: str) -> Snapshot:
        """From JSONL files; a snapshot that stands there already is replaced only when the new one is whole."""
        spark.conf.set("spark.sql.caseSensitive", "true")
        with write_lock(_uri(root)), passing(spark):
            return cls._write(spark, _uri(root), jsonl.read_numbered(spark, source))

    @classmethod
    def _write(cls, spark: SparkSession, root: str, lines: DataFrame) -> Snapshot:
        schema = jsonl.infer(lines)
        if schema.fields:
            ids = materialise(jsonl.columns(lines, Schema(tuple(f for f in schema.fields if f.name == "_id"))).select("_id"), "ids")
            if twice := ids.groupBy("_id").count().where("count > 1").orderBy("_id").limit(1).collect():
                raise errors.AlreadyExists(f"_id {twice[0]['_id']} stands twice")
        try:
            version = Manifest.read(root).version + 1
        except errors.NotFound:
            version = 1
        jsonl.columns(lines, schema).write.mode("overwrite").parquet(f"{root}/v={version:06d}", compression="zstd")
        manifest = Manifest(version, lines.count(), schema.fields, data_files(f"{root}/v={version:06d}"))
        manifest.publish(root)
        return cls(spark, root, manifest)

    # --- reading ---

    def search(self, query: str, limit: int = 1000, mode: str = "auto", **options) -> searching.Result:
        """mode: auto uses the prepared index, if there is one and the query allows it; scan never does. Hits are the same."""
        if self.index is not None and mode != "scan":
            return self.index.search(query, max_hits=limit, **options)
        return searching.search(self.table, query, max_hits=limit, **options)

    def explain(self, query: str, **options) -> str:
        """What a query binds to and the plan it makes; no row is read but for statistics."""
        result = self.search("EXPLAIN " + query if not query.lstrip().startswith("EXPLAIN") else query, **options)
        if result.plan.statement.mode != "EXPLAIN ANALYZE":
            return f"{result.plan}\n"
        count = len(result.rows())
        return f"{result.plan}\n{json.dumps({'mode': result.mode, 'hits': count, 'seconds': round(result.seconds, 3), **result.counters()})}\n"

    def stats(self) -> dict:
        fields = [{"name": f.name, "type": f.type, **({"dimensions": f.dims} if f.dims else {})} for f in self.schema.fields]
        return {"version": self.manifest.version, "rows": self.manifest.rows, "fields": fields}

    def document(self, row: int) -> str | None:
        found = self.frame.where(F.col("_row") == row).select("_doc").collect()
        return found[0]["_doc"] if found else None

    def verify(self) -> None:
        """Derives every cell from its document again and compares."""
        lines = self.frame.select("_row", F.col("_doc").alias("line"))
        again = jsonl.columns(lines, self.schema)
        differ = self.frame.exceptAll(again).limit(1).count() or again.exceptAll(self.frame).limit(1).count()
        if differ or self.frame.count() != self.manifest.rows:
            raise errors.QuillmereError("the snapshot's columns do not match its documents")

    def prepare(self) -> Index:
        self.index = Index.build(self.table, f"{self._path(self.manifest.version)}.index")
        return self.index

    # --- changing ---

    def update(self, batch: str) -> Snapshot:
        """Applies a JSONL file of {"op":"upsert","document":{...}} and {"op":"delete","id":"..."} and returns the next version.

        The last operation on an _id counts; all documents are checked. Rows keep their order, new ones follow as they first
        appear. Deleting what is not there does nothing.
        """
        return self.apply(jsonl.numbered(jsonl.read_lines(self.spark, batch), ["_o1", "_o2", "_o3"]))

    def apply(self, ops: DataFrame) -> Snapshot:
        """ops: numbered lines."""
        with write_lock(self.root):
            current = Snapshot.open(self.spark, self.root)
            parsed = materialise(ops.mapInArrow(_operations, "_row long, _id string, doc string, code string, message string"), "operations")
            if bad := parsed.where("code is not null").orderBy("_row").limit(1).collect():
                raise jsonl._CODES[bad[0]["code"]](f"operation {bad[0]['_row']}: {bad[0]['message']}")
            last = parsed.groupBy("_id").agg(F.max_by("doc", "_row").alias("new"), F.min(F.when(F.col("doc").isNotNull(), F.col("_row"))).alias("first"))
            old = current.frame.select("_id", "_doc", F.col("_row").alias("old_row")) if current.schema.fields else self.spark.createDataFrame([], "_id string, _doc string, old_row long")
            both = old.join(last.withColumn("touched", F.lit(True)), "_id", "full_outer")
            line = F.when(F.col("touched"), F.col("new")).otherwise(F.col("_doc"))
            merged = both.select(line.alias("line"), F.col("old_row").isNull().alias("_o1"), F.coalesce("old_row", "first").alias("_o2")).where("line is not null")
            return self._write(self.spark, self.root, jsonl.numbered(merged, ["_o1", "_o2"]))

    def vacuum(self) -> None:
        """Removes all versions but the current one."""
        from pyarrow import fs

        filesystem, path = _filesystem(self.root)
        for info in filesystem.get_file_info(fs.FileSelector(path)):
            if info.base_name.startswith("v=") and not info.base_name.startswith(f"v={Manifest.read(self.root).version:06d}"):
                filesystem.delete_dir(info.path)


def _operations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("_row", pa.int64()), ("_id", pa.string()), ("doc", pa.string()), ("code", pa.string()), ("message", pa.string())])
    for batch in batches:
        out = []
        for row, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                op = jsonl.load(line)
                if not isinstance(op, dict) or op.get("op") not in ("upsert", "delete") or set(op) != {"op", "document" if op["op"] == "upsert" else "id"}:
                    raise errors.QuillmereError("an operation is an upsert with a document or a delete with an id")
                if op["op"] == "upsert":
                    doc = jsonl.dump(op["document"])
                    jsonl.checked(doc)
                    out.append({"_row": row, "_id": op["document"]["_id"], "doc": doc})
                elif isinstance(op["id"], str) and not isinstance(op["id"], jsonl.Lexeme) and op["id"]:
                    out.append({"_row": row, "_id": op["id"]})
                else:
                    raise errors.QuillmereError("a delete names an id")
            except errors.QuillmereError as e:
                out.append({"_row": row, "code": e.code, "message": e.message})
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)


def compact(segments: list[DataFrame], order: str = "_row") -> DataFrame:
    """The newest row of each _id over segments from old to new; survivors in the order of segments and rows."""
    whole = None
    for i, s in enumerate(segments):
        own = s.withColumn("_segment", F.lit(i))
        whole = own if whole is None else whole.unionByName(own, allowMissingColumns=True)
    newest = whole.groupBy("_id").agg(F.max(F.struct("_segment", order)).alias("_last"))
    kept = whole.join(newest, "_id").where((F.col("_segment") == F.col("_last._segment")) & (F.col(order) == F.col(f"_last.{order}")))
    return kept.drop("_last").orderBy("_segment", order).drop("_segment")

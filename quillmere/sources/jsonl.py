"""JSON Lines with a strict, inferred schema.

Spark's own JSON reader widens and converts where this model must refuse, so lines are read as text and judged by Python's
parser with hooks that keep number lexemes and see duplicate names. A first pass reduces each partition to one row for each
field; the driver settles the schema from these and fails on the first bad line; a second pass writes typed columns.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere import errors
from quillmere.operators.ranks import ranged, with_rank
from quillmere.plans.binder import Field, Schema
from quillmere.shared import materialise

MAX_DIMS, MAX_FIELDS, MAX_TEXT = 4096, 256, 1 << 20
_CODES = {e.code: e for e in (errors.QuillmereError, errors.ParseError, errors.TypeMismatch, errors.Unsupported, errors.LimitExceeded, errors.AlreadyExists)}
SQL_TYPES: dict[str, T.DataType] = {"INT": T.LongType(), "FLOAT": T.DoubleType(), "BOOL": T.BooleanType(), "TEXT": T.StringType(), "VECTOR": T.ArrayType(T.FloatType()), "NULL": T.StringType()}


class Lexeme(str):
    """A number as it is spelled."""


def _pairs(items: list[tuple[str, object]]) -> dict:
    out = dict(items)
    if len(out) != len(items):
        raise errors.ParseError("duplicate name in an object")
    return out


def _constant(name: str):
    raise errors.ParseError(f"{name} is not JSON")


def load(line: str):
    try:
        value = json.loads(line, object_pairs_hook=_pairs, parse_int=Lexeme, parse_float=Lexeme, parse_constant=_constant)
        json.dumps(value, ensure_ascii=False).encode("utf-8")  # lone surrogates
    except errors.QuillmereError:
        raise
    except (ValueError, RecursionError) as e:
        raise errors.ParseError(f"not JSON: {e}") from None
    return value


def dump(value) -> str:
    """Compact, in the order and with the numbers of the source."""
    match value:
        case Lexeme():
            return str(value)
        case dict():
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in value.items()) + "}"
        case list():
            return "[" + ",".join(map(dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _number(n: Lexeme) -> int | float:
    if any(c in n for c in ".eE"):
        x = float(n)
        if not math.isfinite(x):
            raise errors.TypeMismatch(f"{n} is no finite number")
        return x
    if len(n) > 20 or not -(1 << 63) <= int(n) < 1 << 63:
        raise errors.TypeMismatch(f"{n} does not fit 64 bits")
    return int(n)


def typed(value) -> tuple[str, int, object]:
    """Type, dimensions and value of a field."""
    match value:
        case None:
            return "NULL", 0, None
        case bool():
            return "BOOL", 0, value
        case Lexeme():
            x = _number(value)
            return ("INT" if isinstance(x, int) else "FLOAT"), 0, x
        case str():
            if len(value.encode()) > MAX_TEXT:
                raise errors.LimitExceeded("a text is too long")
            return "TEXT", 0, value
        case list():
            if not value or len(value) > MAX_DIMS or not all(isinstance(x, Lexeme) for x in value):
                raise errors.TypeMismatch("a vector has 1 to 4096 numbers")
            with np.errstate(over="ignore"):
                floats = np.array([float(x) for x in value]).astype(np.float32)
            if not np.isfinite(floats).all():
                raise errors.TypeMismatch("vector entries must be finite 32-bit floats")
            return "VECTOR", len(floats), floats.tolist()
    raise errors.Unsupported("nested objects are not supported")


def checked(line: str) -> dict[str, tuple[str, int, object]]:
    """The fields of a document, or the error that its line is."""
    doc = load(line)
    if not isinstance(doc, dict):
        raise errors.TypeMismatch("a row must be an object")
    for name in doc:
        if not name or "\0" in name:
            raise errors.QuillmereError("field names must not be empty or hold NUL")
    key = doc.get("_id")
    if not isinstance(key, str) or isinstance(key, Lexeme) or not key or "\0" in key:
        raise errors.QuillmereError("_id must be a text, not empty and without NUL")
    return {k: typed(v) for k, v in doc.items()}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Nonblank lines (line) of JSONL files with their order (_o1, _o2, _o3)."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("_o1"), F.col("_metadata.file_block_start").alias("_o2"), F.monotonically_increasing_id().alias("_o3"), F.col("value").alias("line"))
    return rows.where(F.btrim("line", F.lit(" \t\r\n")) != "")


def numbered(lines: DataFrame, order: list[str]) -> DataFrame:
    """line and its place from 0, _row."""
    return materialise(with_rank(ranged(lines, [F.col(c) for c in order], "lines"), "_row").select("_row", "line"), "numbered-lines")


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """Nonblank lines of JSONL files and their places from 0. A split's lines stand in their order, so that only the splits
    are put in order and no line is moved."""
    text = spark.read.text(path).where(F.btrim("value", F.lit(" \t\r\n")) != "")
    lines = text.select(F.col("_metadata.file_path").alias("_o1"), F.col("_metadata.file_block_start").alias("_o2"), F.monotonically_increasing_id().alias("_o3"), F.col("value").alias("line"))
    lines = materialise(lines, "lines", compression="zstd")
    splits = lines.groupBy("_o1", "_o2").agg(F.min("_o3").alias("_first"), F.count("*").alias("_rows"))
    before = Window.orderBy("_o1", "_o2").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialise(splits.select("_o1", "_o2", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")), "splits")
    return lines.join(F.broadcast(splits), ["_o1", "_o2"]).select((F.col("_o3") - F.col("_first") + F.col("_before")).alias("_row"), "line")


_FOUND = "field string, type string, dims int, first long, at int, code string, message string"
_FOUND_KIND = pa.schema([("field", pa.string()), ("type", pa.string()), ("dims", pa.int32()), ("first", pa.int64()), ("at", pa.int32()), ("code", pa.string()), ("message", pa.string())])


def infer(lines: DataFrame) -> Schema:
    """The schema of numbered lines: _id first, then fields as they appear; a field that is only null is of type NULL."""

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, int], tuple[int, int]] = {}
        worst: tuple[int, str, str] | None = None
        for batch in batches:
            for row, line, valid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if not valid:
                        raise errors.ParseError("invalid UTF-8")
                    for at, (name, (kind, dims, _)) in enumerate(checked(line).items()):
                        key = (name, kind, dims)
                        found[key] = min(found.get(key, (row, at)), (row, at))
                except errors.QuillmereError as e:
                    worst = min(worst or (row, e.code, e.message), (row, e.code, e.message))
        out = [{"field": n, "type": k, "dims": d, "first": r, "at": a} for (n, k, d), (r, a) in found.items()]
        if worst:
            out.append({"first": worst[0], "code": worst[1], "message": worst[2]})
        if out:
            yield pa.RecordBatch.from_pylist(out, _FOUND_KIND)

    seen = lines.select("_row", F.make_valid_utf8("line"), F.is_valid_utf8("line")).mapInArrow(reduce_, _FOUND)
    wrong = F.min(F.when(F.col("code").isNotNull(), F.struct("first", "code", "message"))).alias("wrong")
    groups = seen.groupBy("field", "type", "dims").agg(F.min(F.struct("first", "at")).alias("place"), wrong).collect()
    if bad := [g["wrong"] for g in groups if g["wrong"]]:
        row, code, message = min(bad)
        raise _CODES[code](f"row {row}: {message}")
    kinds: dict[str, set[tuple[str, int]]] = {}
    places: dict[str, tuple] = {}
    for g in groups:
        kinds.setdefault(g["field"], set()).add((g["type"], g["dims"]))
        places[g["field"]] = min(places.get(g["field"], tuple(g["place"])), tuple(g["place"]))
    if len(kinds) > MAX_FIELDS:
        raise errors.LimitExceeded("too many fields")
    fields = []
    for name in sorted(kinds, key=lambda n: (n != "_id", places[n])):
        real = kinds[name] - {("NULL", 0)}
        if len(real) > 1:
            raise errors.TypeMismatch(f"field {name} mixes {', '.join(sorted(f'{k}({d})' if d else k for k, d in real))}")
        kind, dims = next(iter(real), ("NULL", 0))
        fields.append(Field(name, kind, dims or None))
    return Schema(tuple(fields))


def spark_schema(schema: Schema) -> T.StructType:
    """Of a snapshot's files: the row, the document as it was read, and a column for each field."""
    return T.StructType([T.StructField("_row", T.LongType()), T.StructField("_doc", T.StringType()), *(T.StructField(f.name, SQL_TYPES[f.type]) for f in schema.fields)])


def columns(lines: DataFrame, schema: Schema) -> DataFrame:
    """Numbered lines as typed columns."""
    kinds = {"INT": pa.int64(), "FLOAT": pa.float64(), "BOOL": pa.bool_(), "TEXT": pa.string(), "VECTOR": pa.list_(pa.float32()), "NULL": pa.string()}
    fields = [(f.name, kinds[f.type]) for f in schema.fields]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [checked(x) for x in batch.column(1).to_pylist()]
            own = [pa.array([d[n][2] if n in d else None for d in docs], k) for n, k in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["_row", "_doc", *(n for n, _ in fields)])

    return lines.select("_row", "line").mapInArrow(convert, spark_schema(schema))

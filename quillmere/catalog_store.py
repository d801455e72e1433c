"""Queries for what is not a search: ingestion, snapshots, updates, the language's texts, results and servers.

Each builds what it needs from the supplied tables below the shared folder and returns rows that SQL can make of the same
tables.
"""

from __future__ import annotations

import contextlib
import io
import json
import threading
import urllib.parse
import urllib.request
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere import errors
from quillmere.functions import dates
from quillmere.operators import ann
from quillmere.plans import ast
from quillmere.plans.parser import parse
from quillmere.shared import passing, scratch
from quillmere.sources import jsonl
from quillmere.sources.snapshot import Manifest, Snapshot, write_lock

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _source(spark: SparkSession, rows: DataFrame, key: str, label: str) -> str:
    """A table as JSON lines in the order of its key; the key is named _id and a text."""
    folder = scratch(spark, label)
    fields = [F.col(key).cast("string").alias("_id"), *(c for c in rows.columns if c != key)]
    # files are numbered by ranges of the key, so that their names have its order
    rows.repartitionByRange(key).sortWithinPartitions(key).select(F.to_json(F.struct(*fields)).alias("value")).write.text(folder, compression="gzip")
    return folder


@lru_cache(maxsize=16)
def _snapshot(spark: SparkSession, sf_dir: str, table: str) -> Snapshot:
    key = {"documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id"}[table]
    root = scratch(spark, f"{table}-snapshot")
    with passing(spark):
        return Snapshot.build(spark, _source(spark, spark.read.parquet(f"{sf_dir}/{table}.parquet"), key, f"{table}-lines"), root)


_LINE = """'{"_id":"' || doc_id || '","quality":' || quality || ',"toxic":' || toxic || '}'"""

# --- ingestion and snapshots (A) ------------------------------------------------------------------------------------


@plain("a1_jsonl_scan", "SELECT doc_id::VARCHAR AS _id, md5(text) AS text, lang, source, n_chars FROM documents")
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, "documents").frame.select("_id", F.md5("text").alias("text"), "lang", "source", "n_chars")


@plain("a2_json_parser", "SELECT doc_id::VARCHAR AS _id, 'INT' AS kind, quality::VARCHAR AS value FROM labels")
def _parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.text(_source(spark, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "labels-lines"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            docs = [jsonl.checked(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([{"_id": d["_id"][2], "kind": d["quality"][0], "value": str(d["quality"][2])} for d in docs], pa.schema([(n, pa.string()) for n in ("_id", "kind", "value")]))

    return lines.mapInArrow(read, "_id string, kind string, value string")


@plain("a3_json_serializer", f"SELECT {_LINE} AS line FROM labels")
def _serializer(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat(F.lit('{ "_id" : "'), F.col("doc_id").cast("string"), F.lit('" , "quality":'), F.col("quality").cast("string"), F.lit(' ,"toxic" : '), F.col("toxic").cast("string"), F.lit(" }"))

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([jsonl.dump(jsonl.load(x)) for x in batch.column(0).to_pylist()], pa.string())], names=["line"])

    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(spaced.alias("line")).mapInArrow(write, "line string")


@plain("a4_columnar_encode", "SELECT vec_id::VARCHAR AS _id, label::BIGINT AS label, embedding FROM embeddings")
def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, "embeddings").frame.select("_id", "label", "embedding")


@plain("a5_open_and_verify", "SELECT 1::BIGINT AS version, count(*)::BIGINT AS rows, true AS whole, 'INVALID' AS damaged FROM labels")
def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _snapshot(spark, sf_dir, "labels")
    again = Snapshot.open(spark, made.root)
    again.verify()
    other = Manifest(again.manifest.version, again.manifest.rows, again.manifest.fields, ((("gone.parquet", 1)), *again.manifest.files))
    try:
        other.check(again.root)
        code = "none"
    except errors.QuillmereError as e:
        code = e.code
    return spark.createDataFrame([(again.manifest.version, again.manifest.rows, True, code)], "version long, rows long, whole boolean, damaged string")


@plain("a6_atomic_publish", "SELECT doc_id::VARCHAR AS _id, quality::BIGINT AS quality FROM labels")
def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build that fails leaves what readers see."""
    made = _snapshot(spark, sf_dir, "labels")
    bad = scratch(spark, "bad-lines")
    spark.createDataFrame([('{"_id":"1","quality":1}',), ('{"_id":"2","quality":"good"}',)], "value string").write.text(bad)
    with contextlib.suppress(errors.TypeMismatch):
        Snapshot.build(spark, bad, made.root)
    return Snapshot.open(spark, made.root).frame.select("_id", "quality")


@plain("a7_bounded_read", "SELECT doc_id::VARCHAR AS _id FROM labels WHERE toxic = 1 AND quality = 0")
def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, "labels").frame.where("toxic = 1 AND quality = 0").select("_id")


@plain("a8_document_by_row", f"SELECT r AS row, line FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r, {_LINE} AS line FROM labels) WHERE r IN (0, 7, 60)")
def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _snapshot(spark, sf_dir, "labels")
    return spark.createDataFrame([(r, table.document(r)) for r in (0, 7, 60) if table.document(r) is not None], "row long, line string")


_PAGE = f"SELECT doc_id::VARCHAR AS _id, r AS row, 0.0::DOUBLE AS score, line AS document, n AS total FROM (SELECT doc_id, toxic, quality, row_number() OVER (ORDER BY doc_id) - 1 AS r, {_LINE} AS line FROM labels), (SELECT count(*)::BIGINT AS n FROM labels WHERE quality = 1) WHERE quality = 1 ORDER BY toxic DESC, _id LIMIT 15"
_ASKED = "quality=1 SORT BY toxic DESC LIMIT 15"


def _hits(spark: SparkSession, result: dict) -> DataFrame:
    rows = [(h["_id"], h["row"], float(h["score"]), json.dumps(h["document"], separators=(",", ":")), result["execution"]["total"]) for h in result["hits"]]
    return spark.createDataFrame(rows, "_id string, row long, score double, document string, total long")


@plain("a9_result_json", _PAGE)
def _result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, json.loads(_snapshot(spark, sf_dir, "labels").search(_ASKED).to_json()))


@plain("a10_schema_report", "SELECT 0::BIGINT AS place, '_id' AS name, 'TEXT' AS type, NULL::BIGINT AS dimensions UNION ALL SELECT 1, 'embedding', 'VECTOR', max(len(embedding)) FROM embeddings UNION ALL SELECT 2, 'label', 'INT', NULL")
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _snapshot(spark, sf_dir, "embeddings").stats()["fields"]
    return spark.createDataFrame([(i, f["name"], f["type"], f.get("dimensions")) for i, f in enumerate(fields)], "place long, name string, type string, dimensions long")


@plain("a11_command_line", _PAGE)
def _command(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere import cli

    root = _snapshot(spark, sf_dir, "labels").root
    with contextlib.redirect_stdout(io.StringIO()) as out:
        assert cli.run(spark, ["search", root, _ASKED]) == 0
    return _hits(spark, json.loads(out.getvalue()))


@plain("a12_http", _PAGE)
def _http(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.server import http_server

    server = http_server(_snapshot(spark, sf_dir, "labels"))
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/search?q={urllib.parse.quote(_ASKED)}") as answer:
            return _hits(spark, json.load(answer))
    finally:
        server.shutdown()
        server.server_close()


@plain("a13_tools", _PAGE)
def _tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.server import tools

    call = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {"query": _ASKED}}}
    out = io.StringIO()
    tools(_snapshot(spark, sf_dir, "labels"), io.StringIO(json.dumps(call) + "\n"), out)
    return _hits(spark, json.loads(json.loads(out.getvalue())["result"]["content"][0]["text"]))


@plain("a14_library_calls", "SELECT count(*)::BIGINT AS rows, count_if(quality = 1)::BIGINT AS found, count_if(quality = 1)::BIGINT AS prepared, min(doc_id)::VARCHAR AS first FROM labels")
def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Snapshot.open(spark, _snapshot(spark, sf_dir, "labels").root)
    table.prepare()
    again = Snapshot.open(spark, table.root)
    found, prepared = table.search("quality=1", mode="scan"), again.search("quality=1")
    return spark.createDataFrame([(table.stats()["rows"], found.total, prepared.total if prepared.mode == "prepared" else -1, json.loads(table.document(0))["_id"])], "rows long, found long, prepared long, first string")


@plain("a15_prepared_after_reopening", "SELECT doc_id::VARCHAR AS _id FROM documents WHERE contains(lower(text), 'apache licen')")
def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _snapshot(spark, sf_dir, "documents")
    if table.index is None:
        table.prepare()
    found = Snapshot.open(spark, table.root).search('text:substr("apache licen")')
    assert found.mode == "postings"
    return found.scored.select("_id")


# --- changes (A16, A17, K) ------------------------------------------------------------------------------------------


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are deleted, good ones get another quality, and for each good one a new document comes."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    put = lambda key, quality, toxic: F.to_json(F.struct(F.lit("upsert").alias("op"), F.struct(key.alias("_id"), quality.alias("quality"), toxic.alias("toxic")).alias("document")))
    gone = F.to_json(F.struct(F.lit("delete").alias("op"), F.col("doc_id").cast("string").alias("id")))
    key = F.col("doc_id").cast("string")
    ops = rows.where("toxic = 1").select(gone.alias("value")).unionByName(rows.where("toxic = 0 AND quality = 1").select(F.explode(F.array(put(key, F.lit(7), F.lit(0)), put(F.concat(F.lit("new-"), key), F.lit(8), F.lit(0)))).alias("value")))
    return ops


_CHANGED = "SELECT doc_id::VARCHAR AS _id, CASE WHEN quality = 1 THEN 7 ELSE quality END::BIGINT AS quality FROM labels WHERE toxic = 0 UNION ALL SELECT 'new-' || doc_id, 8 FROM labels WHERE toxic = 0 AND quality = 1"


def _fresh(spark: SparkSession, sf_dir: str) -> Snapshot:
    return Snapshot.build(spark, _source(spark, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "labels-lines"), scratch(spark, "labels-changing"))


@plain("k1_update", _CHANGED)
def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = scratch(spark, "operations")
    _operations(spark, sf_dir).write.text(batch)
    return _fresh(spark, sf_dir).update(batch).frame.select("_id", "quality")


@plain("k1_update_is_all_or_nothing", "SELECT doc_id::VARCHAR AS _id, quality::BIGINT AS quality FROM labels")
def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, batch = _fresh(spark, sf_dir), scratch(spark, "operations")
    _operations(spark, sf_dir).unionByName(spark.createDataFrame([('{"op":"upsert","document":{"_id":"z","quality":"x"}}',)], "value string")).write.text(batch)
    with contextlib.suppress(errors.QuillmereError):
        made.update(batch)
    return Snapshot.open(spark, made.root).frame.select("_id", "quality")


@plain("k2_writer_lock", "SELECT 'BUSY' AS code, count(*)::BIGINT AS rows FROM labels")
def _locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _fresh(spark, sf_dir)
    batch = scratch(spark, "operations")
    _operations(spark, sf_dir).write.text(batch)
    code = "none"
    with write_lock(made.root):
        try:
            made.update(batch)
        except errors.Busy as e:
            code = e.code
    return spark.createDataFrame([(code, Snapshot.open(spark, made.root).frame.count())], "code string, rows long")


@plain("k3_delete", "SELECT doc_id::VARCHAR AS _id FROM labels WHERE quality <> 0")
def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = scratch(spark, "operations")
    spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select(F.to_json(F.struct(F.lit("delete").alias("op"), F.col("doc_id").cast("string").alias("id"))).alias("value")).write.text(batch)
    return _fresh(spark, sf_dir).update(batch).frame.select("_id")


@plain("a17_old_versions_stay", "SELECT doc_id::VARCHAR AS _id, quality::BIGINT AS quality FROM labels")
def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, batch = _fresh(spark, sf_dir), scratch(spark, "operations")
    _operations(spark, sf_dir).write.text(batch)
    made.update(batch)
    return made.frame.select("_id", "quality")


def _follow(spark: SparkSession, sf_dir: str, break_: bool) -> DataFrame:
    from quillmere.streaming import mutations

    made, folder, checkpoint = _fresh(spark, sf_dir), scratch(spark, "operations"), scratch(spark, "stream")
    _operations(spark, sf_dir).repartition(3).write.text(folder)
    if break_:
        # the first run ends between the update and its commit; the second one replays the batch
        with contextlib.suppress(Exception):
            mutations.follow(spark, folder, made.root, checkpoint, after=_lost).awaitTermination()
    mutations.follow(spark, folder, made.root, checkpoint).awaitTermination()
    return Snapshot.open(spark, made.root).frame.select("_id", "quality")


def _lost(_: int) -> None:
    raise RuntimeError("lost between the update and its commit")


@plain("a16_stream_of_mutations", _CHANGED)
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _follow(spark, sf_dir, False)


@plain("k5_recovery", _CHANGED)
def _recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _follow(spark, sf_dir, True)


# --- dates as cells (D3) --------------------------------------------------------------------------------------------


@plain("d3_stored_cells", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch(date_trunc('day', ts)) WHEN 1 THEN epoch(date_trunc('second', ts)) WHEN 2 THEN epoch(date_trunc('minute', ts)) - 5400
  WHEN 3 THEN epoch(date_trunc('minute', ts)) ELSE NULL END::BIGINT AS seconds FROM events""")
def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.pmod("event_id", F.lit(6))
    show = lambda pattern: F.date_format("ts", pattern)
    cell = (
        F.when(form == 0, show("yyyy-MM-dd")).when(form == 1, show("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(form == 2, F.concat(show("yyyy-MM-dd'T'HH:mm"), F.lit("+01:30")))
        .when(form == 3, show("yyyy-MM-dd't'HH:mm")).when(form == 4, show("yyyy-MM-dd HH:mm")).otherwise(F.concat(show("yyyy-MM"), F.lit("-32")))
    )
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", cell.alias("cell"))
    return rows.select("event_id", dates.instant(F.col("cell"))[0].alias("seconds"))


# --- approximate vectors (G): recall against all rows ---------------------------------------------------------------


def _recall(rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Whether at least nine in ten of the exact k nearest of the asked rows were found."""
    queries = rows.where("vec_id % 100 = 0")  # the stated queries, a hundredth of the rows
    exact = ann.exact_block_search(rows, queries, k, 64, vector="embedding", key="vec_id").select("query", "vec_id")
    hit = exact.join(found.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"), F.count("*").alias("asked"))


_ENOUGH = "SELECT true AS enough, 10 * count(*)::BIGINT AS asked FROM embeddings WHERE vec_id % 100 = 0"


@plain("g1_graph_recall", _ENOUGH)
def _graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere import catalog

    return _recall(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), catalog.QUERIES["g1_graph_search"](spark, sf_dir), 10)


@plain("g4_quantized_recall", _ENOUGH)
def _code_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere import catalog

    return _recall(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), catalog.QUERIES["g4_quantized_search"](spark, sf_dir), 10)


# --- the language (B12, B13, C10, C11, J) ---------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The languages and sources, a few of each."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source").where("lang IS NOT NULL AND source IS NOT NULL").distinct().orderBy("lang", "source").limit(200).collect()
    return [(r[0], r[1]) for r in rows]


_PAIRS = "(SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL ORDER BY lang, source LIMIT 200)"
_SLOPPY = "  lang = {0}&&source:({1}||other)   !n_chars :  < 5 ( text:'a  b'^2.50 )  LIMIT  7"
_CANON = """'lang=' || lang || ' AND source:(' || source || ' OR other) AND NOT n_chars:<5 AND text:"a  b"^2.5 LIMIT 7'"""


@plain("j1_parser", f"SELECT lang, source, 4::BIGINT AS clauses, 7::BIGINT AS page FROM {_PAIRS}")
def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = [(lang, source, parse(_SLOPPY.format(lang, source))) for lang, source in _pairs(spark, sf_dir)]
    return spark.createDataFrame([(a, b, len(ast.clauses(t.where)), t.limit) for a, b, t in trees], "lang string, source string, clauses long, page long")


@plain("j2_canonical_text", f"SELECT {_CANON} AS text FROM {_PAIRS}")
def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(ast.show(parse(_SLOPPY.format(*p))),) for p in _pairs(spark, sf_dir)], "text string")


@plain("j3_nested_lists", f"SELECT '(statement (where (and (clause lang = (word ' || lang || ')) (not (clause source : (word ' || source || '))))) (limit 3))' AS text FROM {_PAIRS}")
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(ast.sexpr(parse(f"lang={a} -source:{b} LIMIT 3")),) for a, b in _pairs(spark, sf_dir)], "text string")


@plain("j4_equal_trees", f"SELECT lang, source, true AS same, false AS other FROM {_PAIRS}")
def _equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a, b, parse(_SLOPPY.format(a, b)) == parse(ast.show(parse(_SLOPPY.format(a, b)))), parse(f"lang={a}") == parse(f"lang={a}^2")) for a, b in _pairs(spark, sf_dir)]
    return spark.createDataFrame(rows, "lang string, source string, same boolean, other boolean")


@plain("j5_explain", "SELECT 'quality=1 AND toxic:<1' AS query, 0::BIGINT AS hits, true AS leaves, false AS lexical")
def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _snapshot(spark, sf_dir, "labels")
    query = "quality=1 AND toxic:<1"
    result = table.search(f"EXPLAIN {query}")
    return spark.createDataFrame([(query, len(result.rows()), table.explain(query).count("Leaf(") == 2, result.plan.lexical)], "query string, hits long, leaves boolean, lexical boolean")


_COUNTED = "count(*)::BIGINT AS rows_scanned, count_if(quality = 1)::BIGINT AS matched, 0::BIGINT AS lexical_scored, 0::BIGINT AS vectors_scored FROM labels"


@plain("j6_explain_analyze", f"SELECT least(20, count_if(quality = 1))::BIGINT AS hits, {_COUNTED}")
def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _snapshot(spark, sf_dir, "labels").explain("EXPLAIN ANALYZE quality=1", mode="scan")
    found = json.loads(text.rstrip("\n").rpartition("\n")[2])
    names = ("hits", "rows_scanned", "matched", "lexical_scored", "vectors_scored")
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))


@plain("i6_counters", "SELECT count(*)::BIGINT AS rows_scanned, count_if(label >= 3 AND label < 7)::BIGINT AS matched, 0::BIGINT AS lexical_scored, count_if(label >= 3 AND label < 7)::BIGINT AS vectors_scored FROM embeddings")
def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _snapshot(spark, sf_dir, "embeddings")
    found = table.search(f"label:>=3 AND label:<7 AND embedding:[{','.join(['1'] * 64)}]", mode="scan").counters()
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{n} long" for n in found))


def _refusals(name: str, *cases: tuple[str, str]) -> None:
    """Queries over the documents that are refused, and the codes."""
    values = ", ".join("('" + q.replace("'", "''") + f"', '{code}')" for q, code in cases)

    @plain(name, f"SELECT * FROM (VALUES {values}) AS t(query, code)")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillmere.catalog import _table
        from quillmere.operators.search import search

        out = []
        for query, _code in cases:
            try:
                search(_table(spark, sf_dir, "documents"), query)
                out.append((query, "none"))
            except errors.QuillmereError as e:
                out.append((query, e.code))
        return spark.createDataFrame(out, "query string, code string")


_refusals("b12_clause_parameters", ("text(k=3):the", "UNSUPPORTED"), ("n_chars(w=1):5", "UNSUPPORTED"))
_refusals("b13_unit_suffixes", ("n_chars:1MB", "UNSUPPORTED"), ("n_chars:<2KB", "UNSUPPORTED"))
_refusals("c10_stars_inside_words", ("text:th*e", "UNSUPPORTED"), ("text:*the", "UNSUPPORTED"))
_refusals("c11_near", ("text:near(the,3)", "UNSUPPORTED"),)
_refusals("j7_errors", ("text:(", "PARSE"), ('text:"the', "PARSE"), ("n_chars:soon", "TYPE"), ("* LIMIT 5000", "LIMIT"), ("n_chars:1..", "PARSE"))
_refusals("j8_strict_binding", ("nowhere:5", "TYPE"), ("lang<en", "TYPE"), ("* SORT BY nowhere", "TYPE"), ("lang=en OR n_chars:many", "TYPE"))
_refusals("j10_watch_and_source", ("WATCH lang=en", "UNSUPPORTED"), ("SOURCE(here) lang=en", "UNSUPPORTED"), ("lang=en FACET source", "UNSUPPORTED"))

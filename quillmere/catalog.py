"""The supplied tables as searchable tables, and one query for each operator, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text, vectors
from quillmere.operators import ann, prepared, search
from quillmere.plans import binder as b
from quillmere.plans.compiler import quoted
from quillmere.shared import scratch
from quillmere.sources.snapshot import compact

_KINDS = {"string": "TEXT", "bigint": "INT", "int": "INT", "double": "FLOAT", "boolean": "BOOL", "array<float>": "VECTOR"}


def table_of(frame: DataFrame, key: str, dims: int | None = None) -> search.Table:
    """A frame with an integral key as a searchable table: _id is the key as text, timestamps become ISO text."""
    columns, fields = [F.col(key).cast("string").alias("_id"), F.col(key).cast("long").alias("_row")], [b.Field("_id", "TEXT")]
    for name, kind in frame.dtypes:
        if name == key:
            continue
        c = quoted(name)
        if kind.startswith("timestamp"):
            c, kind = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), "string"
        elif kind == "int":
            c = c.cast("long")
        columns.append(c.alias(name))
        fields.append(b.Field(name, _KINDS[kind], dims if kind == "array<float>" else None))
    return search.Table(frame.select(*columns), b.Schema(tuple(fields)))


@lru_cache(maxsize=64)
def _table(spark: SparkSession, sf_dir: str, name: str) -> search.Table:
    spark.conf.set("spark.sql.caseSensitive", "true")
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    match name:
        case "hybrid":
            vec = read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
            return table_of(read("documents").join(vec, "doc_id", "left"), "doc_id", 64)
        case "embeddings":
            return table_of(read("embeddings"), "vec_id", 64)
    return table_of(read(name), {"documents": "doc_id", "events": "event_id", "orders": "o_orderkey", "pages": "page_id", "customer": "c_custkey", "part": "p_partkey"}[name])


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def hits(name: str, table: str, query: str, sql: str | None = None, score: bool = False, now: int = 1_700_000_000) -> None:
    """Registers a query of the language: ids (and scores to nine digits) of all its matches, or of its page if it has one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.search(_table(spark, sf_dir, table), query, now=now)
        out = found.hits if "LIMIT" in query else found.scored
        return out.select("_id", *([F.round("score", 9).alias("score")] if score else []))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def plain(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# --- SQL of the analyzer and of scores ------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NORM = f"translate(%s, {_q(text._FROM)}, {_q(text._TO)})"
_TOKENS = f"regexp_extract_all({_NORM}, '[^{text.SEPARATORS}]+')"


def tokens_sql(column: str) -> str:
    return _TOKENS.replace("%s", column, 1)


def norm_sql(column: str) -> str:
    return _NORM.replace("%s", column, 1)


def bm25_sql(table: str, key: str, column: str, tokens: list[str], match: str, where: str = "TRUE", boost: float = 1.0, limit: str = "") -> str:
    """Scores of the rows that match; statistics over the whole table."""
    tf = lambda t: f"len(list_filter(tk, lambda x: x = {_q(t)}))"
    df = ", ".join(f"count_if(list_contains(tk, {_q(t)})) AS df{i}" for i, t in enumerate(tokens))
    part = lambda i, t: f"ln(1 + (n - df{i} + .5::DOUBLE) / (df{i} + .5::DOUBLE)) * {tf(t)} / ({tf(t)} + 1.2::DOUBLE * (.25::DOUBLE + .75::DOUBLE * len(tk) / avgdl))"
    score = " + ".join(part(i, t) for i, t in enumerate(tokens))
    return f"""
WITH t AS (SELECT *, {tokens_sql(column)} AS tk FROM {table}),
s AS (SELECT count_if(len(tk) > 0) AS n, sum(len(tk))::DOUBLE / count_if(len(tk) > 0) AS avgdl, {df} FROM t)
SELECT {key}::VARCHAR AS _id, round(({score}) * {boost}::DOUBLE, 9) AS score FROM t, s WHERE ({match}) AND ({where}) {limit}"""


def _ids(table: str, key: str, where: str, tail: str = "") -> str:
    return f"SELECT {key}::VARCHAR AS _id FROM {table} WHERE {where} {tail}"


D = lambda where, tail="": _ids("documents", "doc_id", where, tail)
E = lambda where, tail="": _ids("events", "event_id", where, tail)
O = lambda where, tail="": _ids("orders", "o_orderkey", where, tail)  # noqa: E731, E741
_has = lambda word: f"list_contains({tokens_sql('text')}, {_q(word)})"

# --- filters (B) ----------------------------------------------------------------------------------------------------

hits("b1_match_all", "documents", "*", D("TRUE"))
hits("b2_exists", "hybrid", "embedding:*", "SELECT doc_id::VARCHAR AS _id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
hits("b2_missing", "hybrid", "NOT embedding:exists()", "SELECT doc_id::VARCHAR AS _id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
for _n, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    hits(f"b3_int_{_n}", "events", f"user_id:{_op}50", E(f"user_id {_op.replace('!=', '<>')} 50"))
hits("b4_float_compare", "events", "value:>=99.5", E("value >= 99.5"))
hits("b4_float_on_orders", "orders", "o_totalprice:<150000.25", O("o_totalprice < 150000.25::DOUBLE"))
hits("b6_exact_text", "documents", "source=src7", D("source = 'src7'"))
hits("b6_not_exact_text", "documents", "lang!=en", D("lang <> 'en'"))
hits("b7_range", "documents", "n_chars:500..1500", D("n_chars BETWEEN 500 AND 1500"))
hits("b7_open_range", "documents", "n_chars:*..700", D("n_chars <= 700"))
hits("b8_any_of", "documents", "lang=(de OR fr, es)", D("lang IN ('de', 'fr', 'es')"))
hits("b8_any_of_ints", "events", "user_id:(1 OR 2 OR 3)", E("user_id IN (1, 2, 3)"))
hits("b9_vector_as_filter", "hybrid", f"NOT NOT embedding:[{','.join(['1'] * 64)}]", "SELECT doc_id::VARCHAR AS _id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")


@plain("b5_bool", "SELECT doc_id::VARCHAR AS _id FROM documents WHERE n_chars > 1000 AND lang = 'en'")
def _bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("n_chars") > 1000).alias("long"), "lang")
    return search.search(table_of(frame, "doc_id"), "long:yes AND long!=false AND lang=en").scored.select("_id")


hits("b10_int_index_form", "events", "user_id:>=10 AND user_id:<20", E("user_id >= 10 AND user_id < 20"))
hits("b11_semantic_alias", "embeddings", f"semantic:[{','.join(['1'] + ['0'] * 63)}] LIMIT 50",
     "SELECT vec_id::VARCHAR AS _id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS score FROM embeddings ORDER BY embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) DESC, _id LIMIT 50", score=True)

# --- text (C) -------------------------------------------------------------------------------------------------------


@plain("c1_normalize", f"SELECT doc_id, md5({norm_sql('text')}) AS norm FROM documents")
def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(text.normalized(F.col("text"))).alias("norm"))


@plain("c2_tokenize", f"SELECT doc_id, len({tokens_sql('text')})::BIGINT AS n, md5(array_to_string({tokens_sql('text')}, ' ')) AS tokens FROM documents")
def _tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    spell = text.spelled(text.normalized(F.col("text")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", spell.alias("s")).select("doc_id", text.n_tokens(F.col("s")).alias("n"), F.md5(F.replace(F.btrim("s"), F.lit("  "), F.lit(" "))).alias("tokens"))


hits("c3_term", "documents", "text:the", bm25_sql("documents", "doc_id", "text", ["the"], "list_contains(tk, 'the')"), score=True)
hits("c3_terms_in_a_word", "documents", "text:the-and", bm25_sql("documents", "doc_id", "text", ["the", "and"], "list_contains(tk, 'the') AND list_contains(tk, 'and')"), score=True)
hits("c4_phrase", "documents", 'text:"of the"', bm25_sql("documents", "doc_id", "text", ["of", "the"], "contains(' ' || array_to_string(tk, ' ') || ' ', ' of the ')"), score=True)
hits("c4_phrase_call", "documents", 'text:phrase("la que")', bm25_sql("documents", "doc_id", "text", ["la", "que"], "contains(' ' || array_to_string(tk, ' ') || ' ', ' la que ')"), score=True)
hits("c5_prefix", "documents", "text:thinghe*", D(f"len(list_filter({tokens_sql('text')}, lambda x: starts_with(x, 'thinghe'))) > 0"))
hits("c5_prefix_call", "documents", "text:prefix(schein)", D(f"len(list_filter({tokens_sql('text')}, lambda x: starts_with(x, 'schein'))) > 0"))
hits("c6_substring", "documents", 'text:substr("rights reserved")', D(f"contains({norm_sql('text')}, 'rights reserved')"))
_near = lambda word, most: f"len(list_filter({tokens_sql('text')}, lambda x: abs(length(x) - {len(word)}) <= {most} AND levenshtein(x, {_q(word)}) <= {most})) > 0"
hits("c7_fuzzy", "documents", "text~lizenz", D(_near("lizenz", 2)))
hits("c7_fuzzy_call", "documents", "text:fuzzy(reserved,1)", D(_near("reserved", 1)))
hits("c7_fuzzy_short", "documents", "source~src1", D("levenshtein(source, 'src1') <= 1"))
hits("c8_regex", "documents", "text:/[0-9]{3}\\.[0-9]+\\.[0-9]+\\.[0-9]+/", D("regexp_matches(text, '[0-9]{3}\\.[0-9]+\\.[0-9]+\\.[0-9]+')"))
hits("c8_regex_flags", "documents", "text:/^all rights reserved\\.$/im", D("regexp_matches(text, '(?im)^all rights reserved\\.$')"))
hits("c8_regex_call", "documents", 'text:regex("@[a-z0-9]+\\\\.example")', D("regexp_matches(text, '@[a-z0-9]+\\.example')"))
hits("c9_bare_value", "documents", "the", f"WITH x AS ({bm25_sql('documents', 'doc_id', 'text', ['the'], chr(34) + 'tk' + chr(34) + ' IS NOT NULL')}) SELECT _id, score FROM x WHERE score > 0", score=True)


@lru_cache(maxsize=16)
def _index(spark: SparkSession, sf_dir: str) -> prepared.Index:
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    return prepared.Index.build(table_of(frame, "doc_id"), scratch(spark, "index"))


@plain("c12_term_dictionary", f"SELECT term, count(DISTINCT doc_id)::BIGINT AS holding, count(*)::BIGINT AS occurrences FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) WHERE starts_with(term, 'thing') GROUP BY term")
def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).lookup("text", "thing").select("term", "holding", "occurrences")


@plain("c13_prepared_term", bm25_sql("documents", "doc_id", "text", ["stthing"], "list_contains(tk, 'stthing')"))
def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search("text:stthing").scored.select("_id", F.round("score", 9).alias("score"))


@plain("c13_prepared_phrase", bm25_sql("documents", "doc_id", "text", ["in", "the"], "contains(' ' || array_to_string(tk, ' ') || ' ', ' in the ')", "lang = 'en' AND n_chars > 2000"))
def _prepared_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search('text:"in the" AND lang=en AND n_chars:>2000').scored.select("_id", F.round("score", 9).alias("score"))


@plain("c14_prepared_substring", D(f"contains({norm_sql('text')}, 'apache licen')"))
def _prepared_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search('text:substr("apache licen")').scored.select("_id")


@plain("c15_postings", f"SELECT term, _row, count(*)::BIGINT AS tf FROM (SELECT doc_id AS _row, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL")
def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings.where("field = 'text'").select("term", "_row", "tf")


@plain("c16_trigrams", f"SELECT gram, count(*)::BIGINT AS n FROM (SELECT DISTINCT doc_id, substr(x, i, 3) AS gram FROM (SELECT doc_id, x, unnest(range(1, length(x) - 1)) AS i FROM (SELECT doc_id, {norm_sql('text')} AS x FROM documents))) WHERE length(gram) = 3 GROUP BY gram")
def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).trigrams.where("field = 'text'").groupBy("gram").agg(F.count("*").alias("n"))


# --- dates (D) ------------------------------------------------------------------------------------------------------

hits("d1_month", "events", "ts:2024-01", E("ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"))
hits("d1_year", "orders", "o_orderdate:1995", O("o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"))
hits("d2_relative", "orders", "o_orderdate:<now-9000d", O("o_orderdate < TIMESTAMP '2023-11-14 22:13:20' - INTERVAL 9000 DAY"))
hits("d2_relative_months", "orders", "o_orderdate:>=today-320mo", O("o_orderdate >= TIMESTAMP '1997-03-14'"))
for _n, _op, _sql in (("lt", "<", "< TIMESTAMP '1996-03-01'"), ("le", "<=", "< TIMESTAMP '1996-04-01'"), ("gt", ">", ">= TIMESTAMP '1996-04-01'"), ("ge", ">=", ">= TIMESTAMP '1996-03-01'")):
    hits(f"d4_date_{_n}", "orders", f"o_orderdate:{_op}1996-03", O(f"o_orderdate {_sql}"))
hits("d4_date_ne", "orders", "o_orderdate!=1996-03", O("NOT (o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01')"))
hits("d5_date_range", "orders", "o_orderdate:1994-06-15..1995-02", O("o_orderdate >= TIMESTAMP '1994-06-15' AND o_orderdate < TIMESTAMP '1995-03-01'"))
hits("d6_bare_date", "orders", "1996-03-02", O("o_orderdate >= TIMESTAMP '1996-03-02' AND o_orderdate < TIMESTAMP '1996-03-03'"))

# --- Boolean composition (E) ----------------------------------------------------------------------------------------

hits("e1_and", "documents", "lang=en n_chars:>1000 && source=src3", D("lang = 'en' AND n_chars > 1000 AND source = 'src3'"))
hits("e2_or", "documents", "lang=de || n_chars:<300", D("lang = 'de' OR n_chars < 300"))
hits("e3_not", "documents", "!lang=en -source=src3 NOT n_chars:<1000", D("lang <> 'en' AND source <> 'src3' AND n_chars >= 1000"))
hits("e6_field_group", "documents", "n_chars:(>1000 AND <1200 OR 500..600)", D("n_chars > 1000 AND n_chars < 1200 OR n_chars BETWEEN 500 AND 600"))
hits("e7_boost", "documents", "text:the^2.5", bm25_sql("documents", "doc_id", "text", ["the"], "list_contains(tk, 'the')", boost=2.5), score=True)


@plain("e4_set_operations", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 1000 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = docs.where("lang = 'en'").select("doc_id").intersect(docs.where("n_chars > 1000").select("doc_id"))
    return some.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1"), "doc_id", "left_anti").distinct()


# --- scores (F) -----------------------------------------------------------------------------------------------------


@plain("f1_corpus_statistics", f"WITH t AS (SELECT {tokens_sql('text')} AS tk FROM documents) SELECT count_if(len(tk) > 0)::BIGINT AS n, sum(len(tk))::BIGINT AS tokens, count_if(list_contains(tk, 'the'))::BIGINT AS holding FROM t")
def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "documents").stats({"text": {"the"}})["text"]
    return spark.createDataFrame([(s.rows, s.tokens, s.holding["the"])], "n long, tokens long, holding long")


hits("f2_bm25_filtered", "documents", "text:the AND lang=en AND n_chars:>3000", bm25_sql("documents", "doc_id", "text", ["the"], "list_contains(tk, 'the')", "lang = 'en' AND n_chars > 3000"), score=True)
hits("f3_constant_score", "documents", "text:substr(example)^3 OR text:prefix(mail)",
     f"SELECT _id, score FROM (SELECT doc_id::VARCHAR AS _id, round(CASE WHEN contains({norm_sql('text')}, 'example') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN len(list_filter({tokens_sql('text')}, lambda x: starts_with(x, 'mail'))) > 0 THEN 1.0::DOUBLE ELSE 0 END, 9) AS score FROM documents) WHERE score > 0", score=True)

_V = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_VQ = f"[{','.join(map(str, _V))}]"
_COS = f"list_sum(list_transform(list_zip(embedding, {_VQ}::FLOAT[]), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * {sum(x * x for x in vectors.as_floats(_V))!r}::DOUBLE)"
hits("f4_cosine", "embeddings", f"embedding:{_VQ}", f"SELECT vec_id::VARCHAR AS _id, round({_COS}, 9) AS score FROM embeddings", score=True)
hits("f6_vector_and_filter", "embeddings", f"embedding:{_VQ}^2 AND label:>=5", f"SELECT vec_id::VARCHAR AS _id, round(({_COS}) * 2::DOUBLE, 9) AS score FROM embeddings WHERE label >= 5", score=True)
_BM = bm25_sql("documents", "doc_id", "text", ["the"], "list_contains(tk, 'the')")
hits("f5_rrf", "hybrid", f"text:the AND embedding:{_VQ}", f"""
WITH l AS ({_BM.replace('round(', '(').replace(', 9)', ')')}), v AS (SELECT vec_id::VARCHAR AS _id, {_COS} AS cosine FROM embeddings),
j AS (SELECT l._id, row_number() OVER (ORDER BY round(score, 12) DESC, l._id) AS lr, row_number() OVER (ORDER BY cosine DESC, l._id) AS vr FROM l JOIN v ON l._id = v._id)
SELECT _id, round(1.0::DOUBLE / (60 + lr) + 1.0::DOUBLE / (60 + vr), 9) AS score FROM j""", score=True)
hits("f6_filter_only", "documents", "lang=fr", "SELECT doc_id::VARCHAR AS _id, 0.0::DOUBLE AS score FROM documents WHERE lang = 'fr'", score=True)


def _metric(name: str, expression: str) -> None:
    @plain(f"f7_{name}", f"SELECT vec_id, round({expression}, 6) AS score FROM embeddings")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(vectors.metric(F.col("embedding"), vectors.as_floats(_V), name), 6).alias("score"))


_metric("dot", f"list_sum(list_transform(list_zip(embedding, {_VQ}::FLOAT[]), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))")
_metric("l2", f"1 / (1 + sqrt(list_sum(list_transform(list_zip(embedding, {_VQ}::FLOAT[]), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))))")
_metric("cosine", _COS)


@plain("f8_scalar_quantize", """
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT vec_id, e, list_min(e) AS low, (list_max(e) - list_min(e)) / 255.0::DOUBLE AS step FROM t)
SELECT vec_id, round(low, 9) AS low, round(step, 9) AS step, list_sum(list_transform(e, lambda x: least(255, floor((x - low) / step + .5::DOUBLE))))::BIGINT AS codes FROM s""")
def _quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors.quantize(F.col("embedding"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", q.alias("q"))
    return rows.select("vec_id", F.round("q.low", 9).alias("low"), F.round("q.step", 9).alias("step"), F.aggregate("q.codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("codes"))


# --- approximate vectors (G): tested by recall ----------------------------------------------------------------------


@plain("g1_graph_search")
def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.graph_block_search(ann.graphs(rows, 64, "embedding", "vec_id"), rows.where("vec_id % 100 = 0"), 10, 64, vector="embedding", key="vec_id")


@plain("g4_quantized_search")
def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes, model = ann.quantized(rows, 64, "embedding", "vec_id")
    return ann.quantized_block_search(codes, model, rows.where("vec_id % 100 = 0"), 10, 64, vector="embedding", key="vec_id")


# --- order and pages (H), aggregation (I), language (J), changes (K) ------------------------------------------------

hits("h1_default_order", "documents", "text:the LIMIT 20", bm25_sql("documents", "doc_id", "text", ["the"], "list_contains(tk, 'the')", limit="ORDER BY 2 DESC, 1 LIMIT 20"), score=True)
hits("h2_sort_by", "documents", "lang=en SORT BY n_chars DESC, source LIMIT 50", D("lang = 'en'", "ORDER BY n_chars DESC, source, _id LIMIT 50"))
hits("h2_missing_last", "hybrid", "* SORT BY label DESC LIMIT 700", "SELECT d.doc_id::VARCHAR AS _id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id ORDER BY label DESC NULLS LAST, _id LIMIT 700")
hits("h3_tie_by_id", "documents", "* SORT BY lang DESC LIMIT 100", D("TRUE", "ORDER BY lang DESC, _id LIMIT 100"))
hits("h4_limit_offset", "events", "value:>50 LIMIT 30 OFFSET 15 SORT BY value", E("value > 50", "ORDER BY value, _id LIMIT 30 OFFSET 15"))
hits("h4_limit_zero", "documents", "* LIMIT 0", D("FALSE"))


@plain("h6_top_k", f"SELECT vec_id, round({_COS}, 9) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.exact(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), _V, 10, vector="embedding", key="vec_id").withColumn("score", F.round("score", 9))


@plain("i1_total", f"SELECT count(*)::BIGINT AS total FROM documents WHERE {_has('the')}")
def _total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), "text:the LIMIT 5").matched.agg(F.count("*").alias("total"))


@plain("i3_term_frequencies", f"SELECT term, count(*)::BIGINT AS tf FROM (SELECT unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term")
def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    terms = docs.select(F.explode(F.split(F.btrim(text.spelled(text.normalized(F.col("text")))), " +")).alias("term"))
    return terms.where("term <> ''").groupBy("term").agg(F.count("*").alias("tf"))


@plain("i4_centroid", "SELECT i::INT AS i, round(avg(x::DOUBLE), 9) AS mean FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY i")
def _centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.posexplode("embedding").alias("i", "x"))
    return values.groupBy("i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("mean"))


@plain("i5_facet", "SELECT source AS value, count(*)::BIGINT AS n FROM documents WHERE lang = 'en' GROUP BY source")
def _facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facet(_table(spark, sf_dir, "documents"), "lang=en FACET source")["source"]


@plain("j9_scan_mode", bm25_sql("documents", "doc_id", "text", ["stthing"], "list_contains(tk, 'stthing')"))
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), "text:stthing").scored.select("_id", F.round("score", 9).alias("score"))


@plain("k4_compaction", "SELECT doc_id::VARCHAR AS _id, CASE WHEN lang = 'de' THEN 'new' ELSE lang END AS lang FROM documents")
def _compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").frame.select("_id", "_row", "lang")
    return compact([rows, rows.where("lang = 'de'").withColumn("lang", F.lit("new"))]).select("_id", "lang")


from quillmere import catalog_store  # noqa: E402

QUERIES.update(catalog_store.QUERIES)
ORACLES.update(catalog_store.ORACLES)

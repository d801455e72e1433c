"""Search over one table: a query in, ranked hits out, as one DataFrame plan."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.errors import QuillmereError
from quillmere.operators.ranks import ranged, with_rank
from quillmere.plans import binder as b
from quillmere.plans.compiler import Compiled, Compiler, Stats, Views, analysed, quoted, scored_terms, with_views
from quillmere.plans.parser import Limits, parse

#: What the engine accepts of a query.
LIMITS = Limits(depth=32, clauses=256, items=256)
#: Ranks over up to so many rows come from one window, over more from a sort by ranges.
WINDOW_ROWS = 1_000_000


@dataclass
class Table:
    """A frame with _id, _row and typed fields, its schema, and what is known about it."""

    frame: DataFrame
    schema: b.Schema
    stored: frozenset[str] = frozenset()  # text fields with analysed columns
    known: dict[tuple[str, str | None], tuple[int, int]] = field(default_factory=dict)

    @cached_property
    def splits(self) -> int:
        return self.frame.rdd.getNumPartitions()

    def spread(self, frame: DataFrame) -> DataFrame:
        """A table of fewer splits than there are cores is dealt out before its texts are analysed; one of more never is."""
        cores = self.frame.sparkSession.sparkContext.defaultParallelism
        return frame.repartition(cores, "_row") if self.splits < cores else frame

    def stats(self, wanted: dict[str, set[str]]) -> dict[str, Stats]:
        """Corpus statistics of the whole table, whatever a query filters. One job for all that is not known yet; they stay
        valid because a table does not change."""
        views, exprs, names = Views(self.stored | frozenset(wanted)), [], []
        from quillmere.functions import text

        new = {n for n in wanted if n not in self.stored}
        frame = self.frame.select("_row", *map(quoted, new | {f"_{form}_{n}" for n in wanted if n in self.stored for form in ("spell", "length")}))
        frame = with_views(self.spread(frame) if new else frame, {n: {"spell", "length"} for n in wanted if n not in self.stored})

        for name, tokens in wanted.items():
            length, spell = views.length(name), views.spell(name)
            if (name, None) not in self.known:
                names.append((name, None))
                exprs += [F.count_if(length > 0), F.sum(F.when(length > 0, length))]
            for token in sorted(tokens):
                if (name, token) not in self.known:
                    names.append((name, token))
                    exprs += [F.count_if(text.has_term(spell, token)), F.lit(0)]
        if exprs:
            row = frame.agg(*(e.alias(f"x{i}") for i, e in enumerate(exprs))).first()
            for i, key in enumerate(names):
                self.known[key] = (row[2 * i] or 0, row[2 * i + 1] or 0)
        return {n: Stats(*self.known[n, None], {t: self.known[n, t][0] for t in tokens}) for n, tokens in wanted.items()}


@dataclass
class Result:
    """Hits (_id, _row, score, document) in order; what they are drawn from; and how."""

    hits: DataFrame
    plan: b.Plan
    matched: DataFrame
    scored: DataFrame  # every match with its score, in no order and without LIMIT and OFFSET
    mode: str
    seconds: float = 0.0
    looked_at: DataFrame | None = None  # the rows that the condition was put to

    @cached_property
    def total(self) -> int:
        """All rows that match, before LIMIT and OFFSET."""
        return self.matched.count()

    def counters(self) -> dict[str, int]:
        """What the search went through: rows that the condition was put to (those a prepared index left), rows that match,
        and how many of these have a lexical score and a vector's."""
        if self.mode == "explain" or self.looked_at is None:
            return {"rows_scanned": 0, "matched": 0, "lexical_scored": 0, "vectors_scored": 0}
        row = self.matched.agg(F.count("*"), F.count_if(F.col("_lexical") > 0), F.count_if(F.col("_active"))).first()
        return {"rows_scanned": self.looked_at.count(), "matched": row[0], "lexical_scored": row[1], "vectors_scored": row[2]}

    def rows(self) -> list:
        return self.hits.collect()

    def ids(self) -> list[str]:
        return [r["_id"] for r in self.hits.select("_id").collect()]

    def to_json(self) -> str:
        """Hits and an execution block, scores with 17 digits."""
        rows = self.rows()
        hits = [f'{{"_id":{json.dumps(r["_id"], ensure_ascii=False)},"row":{r["_row"]},"score":{r["score"]:.17g},"document":{r["document"] or "null"}}}' for r in rows]
        execution = {"total": self.total, "count": len(rows), "mode": self.mode, "lexical": self.plan.lexical, "vector": self.plan.vector, **self.counters()}
        return f'{{"hits":[{",".join(hits)}],"execution":{json.dumps(execution)}}}'


def order_of(plan: b.Plan) -> list[Column]:
    """Missing values last in both directions; _id settles all ties."""
    keys = []
    for name, descending in plan.sort:
        c = F.col("score") if name == "_score" else quoted(name)
        keys.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return [*(keys or [F.col("score").desc()]), F.col("_id").asc()]


def _ranked(frame: DataFrame, condition: Column, order: list[Column], name: str, few: bool) -> DataFrame:
    """frame with ranks from 1 among the rows of the condition; null for the others."""
    if few:
        place = F.row_number().over(Window.orderBy(F.when(condition, 0).otherwise(1), *order))
        return frame.withColumn(name, F.when(condition, place))
    sort = [F.when(condition, 0).otherwise(1), *order]
    return with_rank(ranged(frame, sort, "rank"), name).withColumn(name, F.when(condition, F.col(name) + 1))


def fused(matched: DataFrame, few: bool) -> DataFrame:
    """Reciprocal ranks, 1 / (60 + rank), of the lexical scores above zero and of the active vectors, added up."""
    ranks = _ranked(matched, F.col("_lexical") > 0, [F.col("_lexical").desc(), F.col("_id")], "_lr", few)
    ranks = _ranked(ranks, F.col("_active"), [F.col("_vector").desc(), F.col("_id")], "_vr", few)
    part = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (60.0 + F.col(c))).otherwise(0.0)
    return ranks.withColumn("score", part("_lr") + part("_vr"))


def compiled_of(table: Table, plan: b.Plan, stats: dict[str, Stats], k1: float = 1.2, b_: float = 0.75) -> Compiled | None:
    if plan.root is None:
        return None
    return Compiler(table.schema, Views(table.stored | frozenset(analysed(plan.root, table.schema))), stats, k1, b_).node(plan.root)


def matching(table: Table, plan: b.Plan, compiled: Compiled | None, frame: DataFrame, keep: list[Column]) -> DataFrame:
    """Rows that match, with _lexical, _vector, _active and what is kept of them."""
    zero = F.lit(0.0)
    if compiled is None:
        return frame.select(*keep, zero.alias("_lexical"), zero.alias("_vector"), F.lit(False).alias("_active"))
    pick = lambda c, other: other if c is None else c
    wanted = {n: forms for n, forms in analysed(plan.root, table.schema).items() if n not in table.stored}
    match = compiled.match
    if wanted:
        # what needs no analysis goes first, down to the scan; the number, not deterministic, keeps the rest above the
        # analysed columns, which would be unfolded into every use of them otherwise
        frame = table.spread(frame.where(compiled.pre) if compiled.pre is not None else frame)
        frame = with_views(frame.withColumn("_above", F.monotonically_increasing_id()), wanted)
        match = (F.col("_above") >= 0) & match
    return frame.where(match).select(*keep, pick(compiled.lexical, zero).alias("_lexical"), pick(compiled.vector, zero).alias("_vector"), pick(compiled.active, F.lit(False)).alias("_active"))


def search(table: Table, query: str, max_hits: int = 1000, k1: float = 1.2, b_: float = 0.75, now: int | None = None, frame: DataFrame | None = None, mode: str = "scan", few: bool | None = None) -> Result:
    """frame: the rows to look at, if a prepared index has already ruled out others; statistics are the whole table's."""
    import math

    if not (math.isfinite(k1) and k1 >= 0 and 0 <= b_ <= 1 and 0 <= max_hits <= 1_000_000):
        raise QuillmereError("invalid search options")
    start = time.time()
    plan = b.bind(parse(query, LIMITS), table.schema, int(time.time()) if now is None else now, max_hits)
    rows = frame if frame is not None else table.frame
    if plan.statement.mode == "EXPLAIN":
        empty = rows.limit(0).select("_id", "_row", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("document"))
        return Result(empty, plan, empty, empty, "explain")
    stats = table.stats(scored_terms(plan.root, table.schema))
    compiled = compiled_of(table, plan, stats, k1, b_)
    sorted_by = [n for n, _ in plan.sort if n not in ("_score", "_id")]
    document = F.col("_doc") if "_doc" in rows.columns else F.lit(None).cast("string")
    if plan.lexical and plan.vector:
        narrow = matching(table, plan, compiled, rows, [F.col("_id"), F.col("_row"), *map(quoted, dict.fromkeys(sorted_by))])
        if few is None:
            few = narrow.limit(WINDOW_ROWS + 1).count() <= WINDOW_ROWS
        ranked = fused(narrow, few)
        page = ranked.orderBy(*order_of(plan)).offset(plan.offset).limit(plan.limit)
        # documents are fetched for the page alone
        page = page.select("_id", "_row", "score", *map(quoted, dict.fromkeys(sorted_by)))
        hits = page.join(rows.select(F.col("_row"), document.alias("document")), "_row").orderBy(*order_of(plan)).select("_id", "_row", "score", "document")
        return Result(hits, plan, narrow, ranked, mode, time.time() - start, rows)
    matched = matching(table, plan, compiled, rows, [F.col("_id"), F.col("_row"), document.alias("document"), *map(quoted, dict.fromkeys(sorted_by))])
    scored = matched.withColumn("score", F.col("_vector") if plan.vector and not plan.lexical else F.col("_lexical"))
    hits = scored.orderBy(*order_of(plan)).offset(plan.offset).limit(plan.limit).select("_id", "_row", "score", "document")
    return Result(hits, plan, matched, scored, mode, time.time() - start, rows)


def facet(table: Table, query: str, now: int | None = None) -> dict[str, DataFrame]:
    """FACET f, ...: values of the fields among all matching rows by frequency. An extension of the language."""
    plan = b.bind(parse(query, LIMITS), table.schema, int(time.time()) if now is None else now, facets=True)
    compiled = compiled_of(table, plan, table.stats(scored_terms(plan.root, table.schema)))
    rows = matching(table, plan, compiled, table.frame, [quoted(n) for n in dict.fromkeys(plan.statement.facets)])
    return {n: rows.groupBy(quoted(n).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()) for n in plan.statement.facets}

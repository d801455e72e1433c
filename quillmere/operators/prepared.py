"""Prepared text search: analysed columns, a term dictionary, postings and trigrams as Parquet tables.

Postings and trigrams are written as lists: a task goes through the analysed texts by blocks and writes, for each block and
term, the rows that hold it. Each file is sorted by term, so that a look-up reads a row group or two of each; nothing is
dealt out anew, and a row costs a few bits in a list and not a row of a table. A normalised text is stored only where lower()
does not give it.

A query is answered from the analysed columns, so no text is analysed again; where a conjunction holds a term, a phrase or
a substring of three bytes, the rarest list among them first rules out all other rows. Results are those of a scan.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text
from quillmere.operators import search as searching
from quillmere.plans import binder as b
from quillmere.plans.compiler import Views, quoted, scored_terms
from quillmere.plans.parser import parse
from quillmere.shared import bound_batches, read_bytes, releasing, remove, writing

#: Up to so many candidate rows are looked up by their numbers: the columns are sorted by them, so that row groups and
#: pages without one are skipped.
LOOKUP_ROWS = 2_000
#: Numbers that are looked for as one set.
LOOKUP_SET = 50
#: Candidate rows are broadcast up to this number, else joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of a row group of the columns.
ROW_GROUP = 8 << 20


def _among(name: str, numbers: list[int]) -> Column:
    """Sets of neighbouring numbers: one set of all would be held against row groups by its ends alone, and as comparisons of
    single numbers, which nest, two thousand are too deep for a task's stack."""
    return reduce(or_, (F.col(name).isin(numbers[i : i + LOOKUP_SET]) for i in range(0, len(numbers), LOOKUP_SET)))


#: Bytes of texts that are made into lists at once.
BLOCK_BYTES = 4 << 20
_POSTINGS = "field string, term string, holding long, occurrences long, rows array<bigint>, tfs array<int>"
_TRIGRAMS = "field string, gram string, holding long, rows array<bigint>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Rows and texts of many batches at a time; rows without a text are left out."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[np.ndarray, pa.Array]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        table = table.filter(pc.is_valid(table.column(1)))
        return table.column(0).to_numpy(), pa.chunked_array(table.column(1)).combine_chunks()

    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(x.nbytes for x in held) >= BLOCK_BYTES:
                yield whole()
    if held:
        yield whole()


def _lists(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of sorted codes, number of a word times len(rows) plus place of a row: the words' numbers, where their lists begin, and
    offsets and rows of the lists."""
    words, places = np.divmod(codes, max(1, len(rows)))
    first = np.flatnonzero(np.diff(words, prepend=-1))
    return words[first], first, pa.array(np.append(first, len(words)), pa.int32()), pa.array(rows[places])


def _term_lists(field: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, spelled in _blocks(batches):
            tokens = pc.split_pattern(spelled, " ")
            parents, tokens = pc.list_parent_indices(tokens), tokens.flatten()
            there = pc.not_equal(tokens, "")
            named = tokens.filter(there).dictionary_encode()
            codes, tfs = np.unique(named.indices.to_numpy().astype(np.int64) * len(rows) + parents.filter(there).to_numpy(), return_counts=True)
            if len(codes):
                words, first, offsets, held = _lists(rows, codes)
                counts = np.diff(np.append(first, len(codes)))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (held, pa.array(tfs, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(words)), named.dictionary.take(pa.array(words)), pa.array(counts), pa.array(np.add.reduceat(tfs, first)), *lists], names=["field", "term", "holding", "occurrences", "rows", "tfs"])

    return releasing(run, 1 << 13)


def _gram_lists(field: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the distinct stretches of three characters of each text."""

    def make(rows: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        used = np.zeros(0x110000, bool)
        used[points] = True
        alphabet = np.flatnonzero(used)
        k, n = len(alphabet), len(rows)
        if k**3 * n >= 1 << 63:
            for part in (slice(None, n // 2), slice(n // 2, None)):
                yield from make(rows[part], texts[part])
            return
        number = (np.cumsum(used) - 1)[points]
        place = np.repeat(np.arange(n), [len(t) for t in texts])
        inside = place[:-2] == place[2:]
        codes = np.unique((((number[:-2] * k + number[1:-1]) * k + number[2:]) * n + place[:-2])[inside])
        if len(codes):
            grams, first, offsets, held = _lists(rows, codes)
            text_ = alphabet[np.stack([grams // k // k, grams // k % k, grams % k], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(grams)), pa.array([text_[i : i + 3] for i in range(0, len(text_), 3)]), pa.array(np.diff(np.append(first, len(codes)))), pa.ListArray.from_arrays(offsets, held)], names=["field", "gram", "holding", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, norms in _blocks(batches):
            if len(rows):
                yield from make(rows, norms.to_pylist())

    return releasing(run, 1 << 13)


@dataclass
class Index:
    table: searching.Table  # with analysed columns
    terms: DataFrame  # field, term, holding, occurrences; sorted
    postings: DataFrame  # field, term, _row, tf
    trigrams: DataFrame  # field, gram, _row

    @classmethod
    def build(cls, table: searching.Table, path: str) -> Index:
        spark, views = table.frame.sparkSession, Views()
        remove(spark, f"{path}/READY")
        names = [f.name for f in table.schema.fields if f.type == "TEXT" and f.name != "_id"]
        # analysis is the work here: a table of few splits is dealt out to all cores first
        cores = spark.sparkContext.defaultParallelism
        frame = table.frame if table.frame.rdd.getNumPartitions() >= cores else table.frame.repartition(cores)
        added = {}
        for n in names:
            added |= {f"_norm_{n}": F.when(text.is_ascii(quoted(n)), None).otherwise(views.norm(n)), f"_spell_{n}": views.spell(n), f"_length_{n}": views.length(n)}
        frame = frame.withColumns(added).sortWithinPartitions("_row")
        compact = {"compression": "zstd", "parquet.block.size": ROW_GROUP}
        frame.write.mode("overwrite").options(**compact).parquet(f"{path}/columns")
        stored, kept = cls._columns(spark, path, names), Views(frozenset(names))
        bound_batches(spark)
        postings, trigrams = spark.createDataFrame([], _POSTINGS), spark.createDataFrame([], _TRIGRAMS)
        for i, n in enumerate(names):
            own = stored.select("_row", kept.spell(n)).mapInArrow(_term_lists(n), _POSTINGS)
            grams = stored.select("_row", kept.norm(n)).mapInArrow(_gram_lists(n), _TRIGRAMS)
            postings, trigrams = (own, grams) if i == 0 else (postings.unionByName(own), trigrams.unionByName(grams))
        # sorted files have narrow row groups, which the filter on a term skips
        postings.sortWithinPartitions("field", "term").write.mode("overwrite").options(**compact).parquet(f"{path}/postings")
        trigrams.sortWithinPartitions("field", "gram").write.mode("overwrite").options(**compact).parquet(f"{path}/trigrams")
        posted = spark.read.parquet(f"{path}/postings")
        terms = posted.groupBy("field", "term").agg(F.sum("holding").alias("holding"), F.sum("occurrences").alias("occurrences"))
        terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/terms")
        with writing(f"{path}/READY") as out:  # an index without it is not whole
            out.write(b"1")
        return cls.open(table, path)

    @staticmethod
    def _columns(spark: SparkSession, path: str, names: Iterable[str]) -> DataFrame:
        frame = spark.read.parquet(f"{path}/columns")
        return frame.withColumns({f"_norm_{n}": F.when(text.is_ascii(quoted(n)), F.lower(quoted(n))).otherwise(quoted(f"_norm_{n}")) for n in names})

    @classmethod
    def find(cls, table: searching.Table, path: str) -> Index | None:
        """The index in this folder, if a whole one is there."""
        try:
            read_bytes(f"{path}/READY")
        except FileNotFoundError:
            return None
        return cls.open(table, path)

    @classmethod
    def open(cls, table: searching.Table, path: str) -> Index:
        spark = table.frame.sparkSession
        names = frozenset(f.name for f in table.schema.fields if f.type == "TEXT" and f.name != "_id")
        read = lambda what: spark.read.parquet(f"{path}/{what}")
        postings = read("postings").select("field", "term", F.inline(F.arrays_zip("rows", "tfs"))).toDF("field", "term", "_row", "tf")
        trigrams = read("trigrams").select("field", "gram", F.explode("rows").alias("_row"))
        return cls(searching.Table(cls._columns(spark, path, names), table.schema, names, dict(table.known)), read("terms"), postings.withColumn("tf", F.col("tf").cast("long")), trigrams)

    def lookup(self, field: str, prefix: str) -> DataFrame:
        """Terms of a field that begin so, in order."""
        return self.terms.where((F.col("field") == field) & F.startswith("term", F.lit(prefix))).orderBy("term")

    def _learn(self, wanted: dict[str, set[str]]) -> None:
        """Document frequencies from the dictionary instead of the table."""
        for name, tokens in wanted.items():
            new = sorted(t for t in tokens if (name, t) not in self.table.known)
            if new:
                found = {r["term"]: r["holding"] for r in self.terms.where((F.col("field") == name) & F.col("term").isin(new)).collect()}
                self.table.known.update({(name, t): (found.get(t, 0), 0) for t in new})

    def candidates(self, root: b.Bound | None) -> tuple[DataFrame, int] | None:
        """Rows (_row) outside of which nothing can match, and their number; None if the query gives no list to go by."""
        tests = [root] if isinstance(root, b.Leaf) else list(root.kids) if isinstance(root, b.Branch) and root.kind == "and" else []
        lists: list[tuple[str, str, str]] = []
        for n in tests:
            if isinstance(n, b.Leaf) and n.field is not None and n.field.name in self.table.stored:
                if isinstance(n.test, b.Terms):
                    lists += [("terms", n.field.name, t) for t in n.test.tokens]
                elif isinstance(n.test, b.Substring) and len(n.test.text) >= 3:
                    lists += [("grams", n.field.name, n.test.text[i : i + 3]) for i in range(len(n.test.text) - 2)]
        terms = [x for x in lists if x[0] == "terms"]
        if terms:
            self._learn({f: {t for _, g, t in terms if g == f} for _, f, _ in terms})
            _, field, term = min(terms, key=lambda x: self.table.known[x[1], x[2]][0])
            return self.postings.where((F.col("field") == field) & (F.col("term") == term)).select("_row"), self.table.known[field, term][0]
        if lists:
            wanted = {(f, g) for _, f, g in lists}
            match = None
            for f, g in sorted(wanted):
                one = (F.col("field") == f) & (F.col("gram") == g)
                match = one if match is None else match | one
            sizes = {(r["field"], r["gram"]): r["count"] for r in self.trigrams.where(match).groupBy("field", "gram").count().collect()}
            field, gram = min(sorted(wanted), key=lambda x: sizes.get(x, 0))
            return self.trigrams.where((F.col("field") == field) & (F.col("gram") == gram)).select("_row"), sizes.get((field, gram), 0)
        return None

    def search(self, query: str, max_hits: int = 1000, now: int | None = None, **options) -> searching.Result:
        now = int(time.time()) if now is None else now
        plan = b.bind(parse(query, searching.LIMITS), self.table.schema, now, max_hits)
        frame, mode = None, "prepared"
        if plan.statement.mode != "EXPLAIN":
            self._learn(scored_terms(plan.root, self.table.schema))
            found = self.candidates(plan.root)
            if found is not None:
                rows, n = found
                mode, frame = "postings", self.table.frame
                if n <= LOOKUP_ROWS:
                    # n is exact, so this is bounded
                    numbers = sorted(r[0] for r in rows.collect())
                    frame = frame.where(_among("_row", numbers)) if numbers else frame.limit(0)
                else:
                    frame = frame.join(F.broadcast(rows) if n <= BROADCAST_ROWS else rows, "_row", "left_semi")
        return searching.search(self.table, query, max_hits, now=now, frame=frame, mode=mode, **options)

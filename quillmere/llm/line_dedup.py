"""Reversible line dedup: sharded cuckoo filters before exact reference counts.

A LineStore keeps, in the shared folder, three tables. `refs` is the truth: one row for each key of a line and each
document that holds it. `counts` sums it up by key: documents that hold it and the largest doc_id among them. `filters` has
one cuckoo filter for each shard of the key space over the frequent keys, those that at least `least_docs` documents hold.
insert() and delete() of documents return a new store: they add or take back references, count the touched keys anew, and
insert into or delete from the filters the keys that became or ceased to be frequent. Deleting what was inserted gives the
counts and results of before; nothing else is rebuilt.

dedup() drops lines. With filters and frequent keys within BROADCAST_BYTES, a checked size, tasks test each line against its
shard's filter, and only what passes, against the exact keys, so each text is read once and moved nowhere. Beyond that size
the lines that matter are joined with the counts by key, in a join whose hot keys Spark splits, and come back by doc_id;
filters that no task can hold would need the same shuffle by key to be asked, so that join does without them. The number of
shards grows with the frequent keys.

A key is 128 bits of hash; two lines are taken as equal when these agree.

Defined cases: a null or empty text is one empty line; a null doc_id counts as a document and never is the largest, unless
no holder has an id, then all keep the line; rows with one doc_id are documents of their own that keep or lose a line
together; an empty table gives an empty result; other columns are kept, clashing ones replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.exprs import SPACES
from quillmere.shared import bound_batches, materialise

LEAST_CHARS = 40
LEAST_DOCS = 5
#: A filter serves about so many keys; there are twice as many shards from double that number on.
SHARD_KEYS = 500_000
#: Up to so many bytes of filters and exact frequent keys go to every task.
BROADCAST_BYTES = 64 << 20


def line_key(line: str) -> str:
    """White space at both ends is no part of the key, nor is the case of A-Z."""
    line = line.strip(SPACES)
    return line.lower() if line.isascii() else line.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _hash(key: str) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return _signed(n >> 64), _signed(n & 0xFFFFFFFFFFFFFFFF)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


# --- cuckoo filter --------------------------------------------------------------------------------------------------


class Cuckoo:
    """A cuckoo filter over pairs of longs: fingerprints of 16 bits, 4 to a bucket, each in one of two buckets.

    What was inserted is always found; what was not, in about 8 of 65536 cases. Equal entries may stand up to 8 times.
    """

    SLOTS = 4

    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, SLOTS) uint16, 0 is free; buckets is a power of two

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, n) / (cls.SLOTS * 0.8)))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> Cuckoo:
        n = len(hi)
        while True:
            made = cls.sized(n)
            if made.insert(hi, lo):
                return made
            n = 2 * n + 16

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (hi.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        one = (lo.view(np.uint64) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        step = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return (bucket ^ step.astype(np.int64)) & (len(self.table) - 1)

    def insert(self, hi: np.ndarray, lo: np.ndarray, rounds: int = 200) -> bool:
        """False, with the table as before, if there is no room."""
        before = self.table.copy()
        mark, one, two = self._places(np.asarray(hi, np.int64), np.asarray(lo, np.int64))
        rng = np.random.default_rng(len(mark))
        at = one
        for _ in range(rounds):
            mark, at = self._settle(mark, at, at)
            mark, at = self._settle(mark, at, self._other(at, mark))
            if not len(mark):
                return True
            # each of the rest takes the slot of another, which then looks for a place in its second bucket
            _, first = np.unique(at, return_index=True)
            slot = rng.integers(0, self.SLOTS, len(first))
            out = self.table[at[first], slot]
            self.table[at[first], slot] = mark[first]
            mark = mark.copy()
            mark[first], at = out, at.copy()
            at[first] = self._other(at[first], out)
        self.table = before
        return False

    def _settle(self, mark, at, bucket):
        """Puts entries into free slots of these buckets, one entry to a bucket and slot; the rest comes back."""
        for slot in range(self.SLOTS):
            if not len(mark):
                break
            free = np.flatnonzero(self.table[bucket, slot] == 0)
            _, first = np.unique(bucket[free], return_index=True)
            chosen = free[first]
            self.table[bucket[chosen], slot] = mark[chosen]
            rest = np.ones(len(mark), bool)
            rest[chosen] = False
            mark, at, bucket = mark[rest], at[rest], bucket[rest]
        return mark, at

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Takes out entries that were inserted."""
        for mark, one, two in zip(*self._places(np.asarray(hi, np.int64), np.asarray(lo, np.int64)), strict=True):
            for bucket in (one, two):
                slots = np.flatnonzero(self.table[bucket] == mark)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(np.asarray(hi, np.int64), np.asarray(lo, np.int64))
        return (self.table[one] == mark[:, None]).any(axis=1) | (self.table[two] == mark[:, None]).any(axis=1)


# --- keys of lines --------------------------------------------------------------------------------------------------

_KEYS = "doc_id long, hi long, lo long"
_KEYS_KIND = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])


def line_keys(docs: DataFrame, least_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and each different key in it that is long enough."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int | None] = []
            his: list[int] = []
            los: list[int] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key in {k for line in (t or "").split("\n") if len(line) >= least_chars and len(k := line_key(line)) >= least_chars}:
                    hi, lo = _hash(key)
                    ids.append(d), his.append(hi), los.append(lo)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64())], schema=_KEYS_KIND)

    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(keys, _KEYS)


def _count(refs: DataFrame) -> DataFrame:
    return refs.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("hi"), 64 - 16 - bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


@dataclass(frozen=True)
class LineStore:
    spark: SparkSession
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    least_chars: int = LEAST_CHARS
    least_docs: int = LEAST_DOCS
    bits: int = 6  # of the key that name its shard
    shard_keys: int = SHARD_KEYS

    @classmethod
    def empty(cls, spark: SparkSession, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int = 6, shard_keys: int = SHARD_KEYS) -> LineStore:
        none = lambda schema: spark.createDataFrame([], schema)
        return cls(spark, none(_KEYS), none("hi long, lo long, n_docs long, largest long"), none("shard int, data binary"), least_chars, least_docs, bits, shard_keys)

    @classmethod
    def build(cls, docs: DataFrame, keep_refs: bool = True, **options) -> LineStore:
        """A store of these documents. Without the references no document can be deleted later."""
        new = cls.empty(docs.sparkSession, **options)
        refs = line_keys(docs, new.least_chars)
        if keep_refs:
            refs = materialise(refs, "line-refs")
        counts = materialise(_count(refs), "line-counts", few=True)
        return replace(new, refs=refs, counts=counts)._rebuilt()

    def insert(self, docs: DataFrame) -> LineStore:
        added = materialise(line_keys(docs, self.least_chars), "line-refs")
        counts = self.counts.unionByName(_count(added)).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("largest").alias("largest"))
        return self._changed(self.refs.unionByName(added), materialise(counts, "line-counts", few=True))

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """Takes back the documents with these ids (column doc_id)."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        match = F.col("doc_id").eqNullSafe(F.col("gone"))
        refs = materialise(self.refs.join(gone, match, "left_anti"), "line-refs", few=True)
        touched = self.refs.join(gone, match, "left_semi").select("hi", "lo").distinct()
        anew = _count(refs.join(touched, ["hi", "lo"], "left_semi"))
        return self._changed(refs, materialise(self.counts.join(touched, ["hi", "lo"], "left_anti").unionByName(anew), "line-counts", few=True))

    def _frequent(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("n_docs") >= self.least_docs).select("hi", "lo")

    def _rebuilt(self) -> LineStore:
        """All filters anew, with as many shards as the number of frequent keys asks for."""
        keys = self._frequent(self.counts)
        bits = max(self.bits, math.ceil(math.log2(max(1, keys.count()) / self.shard_keys)))
        none = self.spark.createDataFrame([], "shard int, data binary")
        return replace(self, bits=min(bits, 16), filters=none)._refilter(keys.withColumn("enters", F.lit(True)))

    def _changed(self, refs: DataFrame, counts: DataFrame) -> LineStore:
        if self._frequent(counts).count() > 2 * self.shard_keys << self.bits and self.bits < 16:
            return replace(self, refs=refs, counts=counts)._rebuilt()
        now, was = self._frequent(counts), self._frequent(self.counts)
        enter = now.join(was, ["hi", "lo"], "left_anti").withColumn("enters", F.lit(True))
        leave = was.join(now, ["hi", "lo"], "left_anti").withColumn("enters", F.lit(False))
        return replace(self, refs=refs, counts=counts)._refilter(enter.unionByName(leave))

    def _refilter(self, changes: DataFrame) -> LineStore:
        """Applies the changes to the filters of their shards; a full filter is built anew from the counts, twice as large."""

        def apply(key, old, new):
            import pandas as pd

            data = old["data"].iloc[0] if len(old) else None
            enter, leave = new[new["enters"].astype(bool)], new[~new["enters"].astype(bool)]
            if data is None:
                table = Cuckoo.of(enter["hi"].to_numpy(np.int64), enter["lo"].to_numpy(np.int64))
            else:
                table = Cuckoo.from_bytes(data)
                table.delete(leave["hi"].to_numpy(np.int64), leave["lo"].to_numpy(np.int64))
                if not table.insert(enter["hi"].to_numpy(np.int64), enter["lo"].to_numpy(np.int64)):
                    return pd.DataFrame({"shard": [key[0]], "data": [None]})
            return pd.DataFrame({"shard": [key[0]], "data": [table.to_bytes()]})

        def whole(key, pdf):
            import pandas as pd

            return pd.DataFrame({"shard": [key[0]], "data": [Cuckoo.of(pdf["hi"].to_numpy(np.int64), pdf["lo"].to_numpy(np.int64)).to_bytes()]})

        changes = changes.select(_shard(self.bits).alias("shard"), "hi", "lo", "enters")
        changed = materialise(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, "shard int, data binary"), "line-filters", few=True)
        full = changed.where("data is null").select("shard")
        again = self._frequent(self.counts).withColumn("shard", _shard(self.bits)).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(whole, "shard int, data binary")
        return replace(self, filters=materialise(changed.where("data is not null").unionByName(again), "line-filters", few=True))

    # --- dropping lines ---

    def dedup(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """docs with text replaced by what is kept, and n_lines and n_dropped (long)."""
        drops = materialise(self.counts.where(F.col("n_docs") >= self.least_docs), "line-drops", few=True)
        n = drops.count()
        size = 24 * n + (self.filters.agg(F.sum(F.octet_length("data"))).first()[0] or 0)
        keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "_drop")]
        if size <= broadcast_bytes:
            return self._dedup_in_place(docs.select(*keep), drops, doc_id, text)
        refs = line_keys(docs, self.least_chars, doc_id, text)
        lost = refs.join(drops, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("largest")))
        lost = lost.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("_drop")).withColumnRenamed("doc_id", "_doc")
        joined = docs.select(*keep).join(lost, F.col(doc_id).cast("long").eqNullSafe(F.col("_doc")), "left").drop("_doc")
        return _cut(joined, None, self.least_chars, doc_id, text)

    def _dedup_in_place(self, docs: DataFrame, drops: DataFrame, doc_id: str, text: str) -> DataFrame:
        """Ships the filters and the frequent keys, of a size that dedup() has checked."""
        rows = drops.select("hi", "lo", "largest").toArrow()
        hi, lo = (rows.column(c).to_numpy().astype(np.int64) for c in ("hi", "lo"))
        largest, known = rows.column("largest").fill_null(0).to_numpy().astype(np.int64), ~np.asarray(rows.column("largest").is_null())
        order = np.lexsort((lo, hi))
        filters = {r["shard"]: bytes(r["data"]) for r in self.filters.toLocalIterator()}
        sent = self.spark.sparkContext.broadcast((hi[order], lo[order], largest[order], known[order], filters, self.bits))
        return _cut(docs, sent, self.least_chars, doc_id, text)


class _Exact:
    """The frequent keys that passed a filter, looked up exactly."""

    def __init__(self, hi, lo, largest, known, filters, bits):
        self.hi, self.lo, self.largest, self.known, self.bits = hi, lo, largest, known, bits
        self.filters = {k: Cuckoo.from_bytes(v) for k, v in filters.items()}

    def drops(self, ids: np.ndarray, has_id: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hi), bool)
        shard = ((hi.view(np.uint64) >> np.uint64(48 - self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for part in np.split(order, bounds[1:]):
            if len(part) and (table := self.filters.get(int(shard[part[0]]))) is not None:
                out[part] = table.contains(hi[part], lo[part])
        for i in np.flatnonzero(out):
            a, b = np.searchsorted(self.hi, hi[i], "left"), np.searchsorted(self.hi, hi[i], "right")
            k = a + np.searchsorted(self.lo[a:b], lo[i])
            found = k < b and self.lo[k] == lo[i]
            out[i] = found and not (self.known[k] == has_id[i] and (not has_id[i] or self.largest[k] == ids[i]))
        return out


def _cut(docs: DataFrame, sent, least_chars: int, doc_id: str, text: str) -> DataFrame:
    """Drops the lines with a key that is in _drop or, with sent, that the filters and exact keys name."""
    names = [c for c in docs.columns if c != "_drop"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names and f.name != text)
    schema = f"{schema}, `{text}` string, n_lines long, n_dropped long".removeprefix(", ")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = _Exact(*sent.value) if sent else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = batch.column(names.index(doc_id)).cast(pa.int64()).to_pylist()
                texts = batch.column(names.index(text)).to_pylist()
                lines = [(t or "").split("\n") for t in texts]
                where = [(i, j, _hash(k)) for i, parts in enumerate(lines) for j, line in enumerate(parts) if len(line) >= least_chars and len(k := line_key(line)) >= least_chars]
                if exact:
                    owners = np.array([i for i, _, _ in where], np.int64)
                    keys = np.array([k for _, _, k in where], np.int64).reshape(-1, 2)
                    drop = exact.drops(np.array([d or 0 for d in ids], np.int64)[owners], np.array([d is not None for d in ids], bool)[owners], np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])) if where else []
                else:
                    named = [{(x["hi"], x["lo"]) for x in v or ()} for v in batch.column(len(names)).to_pylist()]
                    drop = [k in named[i] for i, _, k in where]
                lost: dict[int, set[int]] = {}
                for (i, j, _), gone in zip(where, drop, strict=True):
                    if gone:
                        lost.setdefault(i, set()).add(j)
                kept = ["\n".join(x for j, x in enumerate(parts) if j not in lost[i]) if i in lost else t or "" for i, (t, parts) in enumerate(zip(texts, lines, strict=True))]
                others = [batch.column(k) for k, c in enumerate(names) if c != text]
                columns = [*others, pa.array(kept, pa.string()), pa.array(map(len, lines), pa.int64()), pa.array([len(lost.get(i, ())) for i in range(len(lines))], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*(c for c in names if c != text), text, "n_lines", "n_dropped"])

    ordered = [*names, *(["_drop"] if not sent else [])]
    return docs.select(*ordered).mapInArrow(cut, schema).select(*names, "n_lines", "n_dropped")

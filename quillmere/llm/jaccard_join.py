"""Size-aware heavy-light Jaccard join of documents by their sets of word shingles.

Two sets link when 100 * intersection >= THRESHOLD * union. All sets are put in one order of shingles, rare ones first, so
that the first n - least + l shingles of a set, its prefix, share at least l shingles with the prefix of any set it links
with (least: the overlap that a set of n needs at least).

- Small sets enumerate the subsets of two shingles of their prefix (l = 2); two small sets that link share one.
- Large sets enter the inverted lists of their prefix's shingles with an l that grows with n, and lists are scanned for
  pairs that share l shingles at fitting places. Small sets that a large one may link with enter these lists as well.
- The boundary is the size with the least cost over the histogram of set sizes: rows that are enumerated, and partners met
  in lists, by the mean length of the lists.

Work on copies and near copies must not grow with the square of their number:

- Equal sets are one class, named by a hash of the set, from the start.
- A list's members are first compared with one of them alone, the most central (the one with the most frequent shingles);
  what links is one component. Lists of shingles that are known to be frequent are split by member, and each part has its
  own first member, which are compared among each other. A list whose members are one component by then is done.
- In longer ones of the other lists, members are compared by blocks with their whole sets, and two blocks yield a spanning
  forest: a row for each component that is joined, not for each link. A block holds sets of about one size, a bounded number
  of shingles and, where a component has many members, these alone; only blocks whose sizes may link and which do not lie in
  one component meet. In short lists, pairs of members from different components are enumerated.

Candidates are verified with their whole sets. No list, group or number of partners is capped. What the driver learns is a
histogram and a table of at most MOST_FREQUENT frequent shingles, by the 32-bit halves of their hashes; it only orders
shingles, so its bound changes no result.

Defined cases: a null text or one without words has the empty set and links with nothing; fewer words than a shingle has
are one shingle; repeated rows and doc_ids are documents of their own that link as equal sets; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm import shingles
from quillmere.llm.components import components
from quillmere.shared import bound_batches, materialise, release, releasing, tidied

THRESHOLD = 85
SHINGLE = 4
#: Shingles in fewer documents than this are not told apart by frequency.
LEAST_FREQUENT = 8
MOST_FREQUENT = 1_000_000
#: Members of a part of a frequent shingle's list.
PART = 4096
#: Lists of more members than this are settled by whole sets, in blocks of about so many members and shingles at most (a
#: larger set is a block of its own).
LONG, BLOCK, BLOCK_SHINGLES = 64, 512, 1 << 18
#: Ids of candidates are broadcast up to this number, else joined by shuffle.
BROADCAST_ROWS = 1_000_000


def least_overlap(n, threshold: int):
    """What a set of n must share at least with any set it links with."""
    return (threshold * n + 99) // 100


def shared_least(n):
    """l of a set of n in the inverted lists."""
    return 1 + n // 24


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# --- pass 1: classes and frequencies --------------------------------------------------------------------------------

_SCAN = "doc_id long, n int, cls long, bucket int, marks binary, counts binary"
_SCAN_KIND = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("bucket", pa.int32()), ("marks", pa.binary()), ("counts", pa.binary())])
_HELD = 3_000_000


def _squeeze(x: np.ndarray) -> bytes:
    """Small differences of sorted 32-bit values, by byte planes."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def _summed(held: list[np.ndarray], bits: int) -> Iterator[dict]:
    marks, counts = np.unique(np.concatenate(held), return_counts=True)
    for bucket, part in enumerate(np.split(np.arange(len(marks)), np.searchsorted(marks, (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).astype(np.uint32)))):
        if len(part):
            own = marks[part]
            yield {"bucket": bucket, "marks": _squeeze(np.diff(own, prepend=np.uint32(0))), "counts": _squeeze(counts[part])}


def _scan(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """A row for each document (doc_id, n, cls) and rows (bucket, marks, counts) that sum up how often marks occur."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ids = batch.column(0)
            for first, texts in shingles.stretches(batch):
                found = list(shingles.sets(texts, k))
                n = [len(s) for s in found]
                cls = np.array([shingles.set_id(s) for s in found], np.uint64)
                none = pa.nulls(len(n))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(n)), pa.array(n, pa.int32()), pa.array(_signed(cls)), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())], schema=_SCAN_KIND)
                held += [(s >> np.uint64(32)).astype(np.uint32) for s in found]
                size += sum(n)
                if size > _HELD:
                    yield pa.RecordBatch.from_pylist(list(_summed(held, bits)), _SCAN_KIND)
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_pylist(list(_summed(held, bits)), _SCAN_KIND)

    return materialise(docs.mapInArrow(releasing(scan), _SCAN), "sets")


def _frequencies(scanned: DataFrame) -> DataFrame:
    """(mark, n) for marks in LEAST_FREQUENT documents; for each bucket a row with mark null: sums of n and n * n of the others."""

    def count(key, pdf):
        import pandas as pd

        marks = np.concatenate([np.cumsum(_unsqueeze(m), dtype=np.uint32) for m in pdf["marks"]])
        counts = np.concatenate([_unsqueeze(c) for c in pdf["counts"]]).astype(np.int64)
        order = np.argsort(marks, kind="stable")
        marks, counts = marks[order], counts[order]
        first = np.flatnonzero(np.diff(marks.astype(np.int64), prepend=-1))
        n = np.add.reduceat(counts, first)
        many = n >= LEAST_FREQUENT
        rest = n[~many].astype(np.float64)
        out = pd.DataFrame({"mark": marks[first][many].astype(np.int64), "n": n[many], "n1": 0.0, "n2": 0.0})
        out["mark"] = out["mark"].astype("Int64")
        return pd.concat([out, pd.DataFrame({"mark": pd.array([None], "Int64"), "n": [0], "n1": [rest.sum()], "n2": [(rest * rest).sum()]})], ignore_index=True)

    parts = scanned.where("bucket is not null").select("bucket", "marks", "counts")
    return materialise(parts.groupBy("bucket").applyInPandas(count, "mark long, n long, n1 double, n2 double"), "frequencies", few=True)


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent marks, sorted, and their numbers: all above the frequency at which they are MOST_FREQUENT."""
    level = F.floor(F.log2("n") * 8).cast("int")
    some = counted.where("mark is not null").select("mark", "n", level.alias("level"))
    least, total = None, 0
    for r in some.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > MOST_FREQUENT:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    rows = some.where(F.col("level") >= least).select("mark", "n").toArrow()
    marks, n = rows.column("mark").to_numpy().astype(np.uint32), rows.column("n").to_numpy()
    order = np.argsort(marks)
    return marks[order], n[order]


def boundary(sizes: dict[int, int], partners: float, threshold: int) -> int:
    """The largest size whose sets enumerate subsets: the least cost over the histogram {size: sets}."""
    n = np.array(sorted(sizes), np.int64)
    if not len(n):
        return 0
    of = np.array([sizes[int(x)] for x in n], np.float64)
    pairs = n - least_overlap(n, threshold) + 2
    light = of * pairs * (pairs - 1) / 2
    lists = of * np.minimum(n, n - least_overlap(n, threshold) + shared_least(n)) * (1 + partners)
    best, at = math.inf, 0
    for x in [0, *n.tolist()]:
        cost = light[n <= x].sum() + lists[100 * n > threshold * x].sum()
        if cost < best:
            best, at = cost, x
    return int(at)


# --- pass 2: postings -----------------------------------------------------------------------------------------------

_POST = "key long, part int, cls long, n int, pos int, central int, light boolean"
_POST_KIND = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("central", pa.int32()), ("light", pa.bool_())])


def ordered(tokens: np.ndarray, marks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a set in the common order, rare ones first, and their known frequencies (0: not frequent)."""
    if not len(marks):
        return tokens, np.zeros(len(tokens), np.int64)
    own = (tokens >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(marks, own), len(marks) - 1)
    freq = np.where(marks[at] == own, counts[at], 0)
    order = np.argsort(freq, kind="stable")  # the rest by hash, as they come
    return tokens[order], freq[order]


def postings(tokens: np.ndarray, freq: np.ndarray, threshold: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, places, frequencies and kinds (subset or not) under which a set is found; sets too small to link enter none."""
    n = len(tokens)
    least = least_overlap(n, threshold)
    keys, places, freqs, light = [], [], [], []
    if n and n <= limit:
        p = min(n, n - least + 2)
        i, j = np.triu_indices(p, 1)
        keys.append(shingles._mix(tokens[i] * np.uint64(0xD6E8FEB86659FD93) + shingles._mix(tokens[j])))
        places.append(j)
        freqs.append(np.minimum(freq[i], freq[j]))
        light.append(np.ones(len(i), bool))
    if 100 * n > threshold * limit:
        p = min(n, n - least + shared_least(n))
        keys.append(tokens[:p])
        places.append(np.arange(p))
        freqs.append(freq[:p])
        light.append(np.zeros(p, bool))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(map(np.concatenate, (keys, places, freqs, light)))  # type: ignore[return-value]


def _post(docs: DataFrame, k: int, threshold: int, limit: int, sent) -> DataFrame:
    # a set can link with a different one only if it may miss one shingle of the union
    smallest = -(-threshold // (100 - threshold))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, counts = sent.value
        seen: set[int] = set()
        for batch in batches:
            for _, texts in shingles.stretches(batch):
                out: list[list[np.ndarray]] = [[] for _ in range(7)]
                for tokens in shingles.sets(texts, k):
                    n, name = len(tokens), shingles.set_id(tokens)
                    if n < smallest or name in seen:
                        continue
                    seen.add(name)
                    tokens, freq = ordered(tokens, marks, counts)
                    keys, places, freqs, light = postings(tokens, freq, threshold, limit)
                    m = len(keys)
                    cls = _signed(np.array([name], np.uint64))[0]
                    central = int(1000 * np.count_nonzero(freq) / n)
                    parts = -(-freqs // PART)
                    part = np.where(parts > 1, 1 + (name >> 20) % np.maximum(1, parts), 0)  # 0: the list is in one part
                    for column, x in zip(out, (_signed(keys), part.astype(np.int32), np.full(m, cls), np.full(m, n, np.int32), places.astype(np.int32), np.full(m, central, np.int32), light), strict=True):
                        column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=_POST_KIND)

    return docs.mapInArrow(releasing(post), _POST)


# --- lists ----------------------------------------------------------------------------------------------------------

_LIST = "kind int, key long, part int, cls long, n int, pos int, central int, light boolean, other long, other_n int"
_LIST_KIND = pa.schema([("kind", pa.int32()), *_POST_KIND, ("other", pa.int64()), ("other_n", pa.int32())])
#: Rows of a list that are held at a time.
HELD_ROWS = 1 << 18


def _fits(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets of n and m that share a shingle at these places may still link, if it is the first they share."""
    rest = 1 + np.minimum(n - pos - 1, m - at - 1)
    return ((100 + threshold) * (rest + np.minimum(pos, at)) >= threshold * (n + m)) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))


def _lists(posted: DataFrame, threshold: int, held_rows: int) -> DataFrame:
    """Reads lists off postings that are sorted by key, part and class. Kind 0: members of lists of two at least; kind 1:
    (cls, other) for a member and the list's most central one; kind 2: the most central of each part of a split list. A part
    of more than held_rows is read in pieces, each like a part of its own."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        carried: tuple[int, int] | None = None  # key and part that an earlier piece ended in
        names = _POST_KIND.names

        def columns(batch):
            return {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}

        def emit(x: dict[str, np.ndarray], cut: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal carried
            if not len(x["key"]):
                return
            ends = (x["key"][-1], x["part"][-1])
            pieces = [p for p in (carried, ends if cut else None) if p is not None]
            new = np.ones(len(x["key"]), bool)
            new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["part"][1:] != x["part"][:-1])
            again = ~new
            again[1:] &= x["cls"][1:] == x["cls"][:-1]
            again[:1] = False
            if again.any():
                x = {c: v[~again] for c, v in x.items()}
                new = new[~again]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(new)))
            own = np.repeat(np.arange(len(start)), size)
            # the most central member of each list; the smallest class of equals
            order = np.lexsort((x["cls"], -x["central"].astype(np.int64), own))
            head = order[start]
            top = head[own]
            several = size[own] > 1
            member = several & (top != np.arange(len(new)))
            close = member & _fits(x["n"].astype(np.int64), x["pos"].astype(np.int64), x["n"][top].astype(np.int64), x["pos"][top].astype(np.int64), threshold)

            def rows(kind, at, other=None):
                none = pa.nulls(len(at))
                far = [none.cast(pa.int64()), none.cast(pa.int32())] if other is None else [pa.array(x["cls"][other]), pa.array(x["n"][other])]
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *(pa.array(x[c][at]) for c in names), *far], schema=_LIST_KIND)

            split = x["part"] > 0
            for key, part in pieces:
                split |= (x["key"] == key) & (x["part"] == part)
            carried = ends if cut else None
            kept = np.flatnonzero(several | split)  # a part may have one member; the others are in other parts
            if len(kept):
                yield rows(0, kept)
            heads = head[split[head]]
            if len(heads):
                yield rows(2, heads)
            pairs = np.flatnonzero(close)
            if len(pairs):
                yield rows(1, pairs, top[pairs])

        for batch in batches:
            x = columns(batch)
            if rest is not None:
                x = {c: np.concatenate([rest[c], x[c]]) for c in names}
            if not len(x["key"]):
                continue
            last = np.flatnonzero((x["key"] != x["key"][-1]) | (x["part"] != x["part"][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            whole = len(x["key"]) - cut > held_rows
            if whole:
                cut = len(x["key"])
            yield from emit({c: v[:cut] for c, v in x.items()}, whole)
            rest = {c: v[cut:].copy() for c, v in x.items()}
        if rest is not None:
            yield from emit(rest)

    return posted.mapInArrow(releasing(lists), _LIST)


# --- verification ---------------------------------------------------------------------------------------------------

_SETS = "cls long, tokens array<long>"


def _sets(wanted: DataFrame, docs: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """(cls, tokens) for these classes (cls), made again from the texts of their owners."""
    ids = materialise(wanted.distinct().join(owners, "cls").select(F.col("doc_id").alias("_owner")).distinct(), "owners", few=True)
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in shingles.stretches(batch):
                found = list(shingles.sets(texts, k))
                names = _signed(np.array([shingles.set_id(s) for s in found], np.uint64))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(found))))], names=["cls", "tokens"])

    owned = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_owner")), "left_semi").select("doc_id", "text")
    return materialise(owned.mapInArrow(releasing(make), _SETS).dropDuplicates(["cls"]), "candidate-sets")


def _verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, k: int, threshold: int) -> DataFrame:
    """Of pairs (a, b) of classes those that link."""
    made = _sets(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))), docs, owners, k)
    one = made.select(F.col("cls").alias("a"), F.col("tokens").alias("x"))
    two = made.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(100 * both >= threshold * (F.size("x") + F.size("y") - both)).select("a", "b")


def forest(names: np.ndarray, tokens: list[np.ndarray], component: np.ndarray, side: np.ndarray, both_sides: bool, threshold: int) -> list[tuple[int, int]]:
    """Links that join the components of these sets as all their links would: at most one less than there are components.

    both_sides: only links between the two sides are wanted.
    """
    n = np.array([len(t) for t in tokens])
    left_rows = np.flatnonzero(~side) if both_sides else np.arange(len(n))
    right_rows = np.flatnonzero(side) if both_sides else left_rows
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens), dtype=np.int32), n)
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    del order
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    del flat
    start = np.flatnonzero(new)
    shared = np.repeat(np.diff(np.append(start, len(new))) > 1, np.diff(np.append(start, len(new))))
    column, owner = (np.cumsum(new, dtype=np.int32)[shared], owner[shared])
    del new, shared
    if len(column):
        column = np.cumsum(np.diff(column, prepend=column[0]) > 0, dtype=np.int32)
    exact = np.float32 if 200 * n.max() < 1 << 24 else np.float64
    common = np.zeros((len(left_rows), len(right_rows)), exact)
    place = np.empty(len(n), np.int64)
    place[left_rows] = np.arange(len(left_rows))
    if both_sides:
        place[right_rows] = np.arange(len(right_rows))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        part = slice(np.searchsorted(column, at), np.searchsorted(column, at + 1024))
        own, col = owner[part], column[part] - at
        ones = []
        for rows, mine in ((left_rows, ~side[own] if both_sides else np.ones(len(own), bool)), *(((right_rows, side[own]),) if both_sides else ())):
            hot = np.zeros((len(rows), 1024), exact)
            hot[place[own[mine]], col[mine]] = 1
            ones.append(hot)
        common += ones[0] @ ones[-1].T
    common *= 100 + threshold  # in place: the matrices are what this takes of memory
    least = (threshold * n).astype(exact)
    common -= least[left_rows, None]
    linked = common >= least[None, right_rows]
    del common
    linked &= component[left_rows, None] != component[None, right_rows]
    root = {c: c for c in component.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    comp = component.tolist()
    for i, j in zip(*np.nonzero(linked), strict=True):
        i, j = int(left_rows[i]), int(right_rows[j])
        a, b = top(comp[i]), top(comp[j])
        if a != b:
            root[a] = b
            out.append((int(names[i]), int(names[j])))
    return out


def _forests(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) among the members (key, cls, n, component) of long lists, by pairs of blocks of a list.

    Sets of one band of sizes link only with those of the same band and the two next to it. A component with more members in
    a list's band than a block has blocks of its own, so that a list of one large component and a few other members takes
    work in proportion to its length. Blocks are dealt by hash; that a pair of blocks is made costs one narrow row.
    """

    def join(pdf):
        import pandas as pd

        side = pdf["side"].to_numpy().astype(bool)
        links = forest(pdf["cls"].to_numpy(), [np.asarray(t) for t in pdf["tokens"]], pdf["component"].to_numpy(), side, bool(side.any()), threshold)
        release()
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    width = math.log(100 / threshold) * 1.000001  # rounding must not put sets that may link two bands apart
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    rows = members.select("key", "cls", "n", "component", band.alias("band"))
    large = rows.groupBy("key", "band", "component").agg(F.count("*").alias("of")).where(F.col("of") > BLOCK).select("key", "band", "component", F.lit(True).alias("large"))
    rows = rows.join(large, ["key", "band", "component"], "left").withColumn("owner", F.when(F.col("large"), F.col("component")))
    group = ["key", "band", "owner"]
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = rows.groupBy(*group).agg(parts.alias("parts"))
    same = (F.col("r.key") == F.col("s.key")) & (F.col("r.band") == F.col("s.band")) & F.col("r.owner").eqNullSafe(F.col("s.owner"))
    rows = rows.alias("r").join(sized.alias("s"), same).select("r.*", F.pmod(F.xxhash64(F.col("r.cls"), F.lit(7)), F.col("s.parts")).cast("int").alias("part"))
    rows = materialise(rows, "block-members", few=True)
    blocks = rows.groupBy(*group, "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    blocks = blocks.withColumn("id", F.xxhash64(*group, "part"))
    far = blocks.select("key", F.col("id").alias("j"), F.col("band").alias("band_j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    near = blocks.select("key", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band_j"), F.col("band").alias("band_i"), F.col("id").alias("i"), "low", "high")
    met = near.join(far, ["key", "band_j"]).where((F.col("band_i") < F.col("band_j")) | (F.col("i") <= F.col("j")))
    met = met.where(~((F.col("low") == F.col("high")) & (F.col("low_j") == F.col("high_j")) & (F.col("low") == F.col("low_j"))))
    met = materialise(met.select("key", "i", "j"), "block-pairs", few=True)
    sides = met.select("key", "i", "j", F.col("i").alias("id"), F.lit(False).alias("side")).unionByName(met.where("i <> j").select("key", "i", "j", F.col("j").alias("id"), F.lit(True).alias("side")))
    cut = rows.withColumn("id", F.xxhash64(*group, "part")).select("key", "id", "cls", "component").join(sides, ["key", "id"]).select("key", "i", "j", "side", "cls", "component")
    return cut.join(sets, "cls").groupBy("key", "i", "j").applyInPandas(join, "a long, b long").distinct()


# --- the join -------------------------------------------------------------------------------------------------------


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles (long) and component_id: the smallest doc_id that links lead to, its own included.

    The result is written; what was written on the way to it is removed.
    """
    return tidied(lambda: _classes(docs, doc_id, text, k, threshold), docs.sparkSession, "components")


def _classes(docs: DataFrame, doc_id: str, text: str, k: int, threshold: int) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bits = max(4, math.ceil(math.log2(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    scanned = _scan(docs, k, bits)
    own = scanned.where("bucket is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    owners = materialise(own.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "classes", few=True)

    counted = _frequencies(scanned)
    n1, n2 = counted.agg(F.sum("n1"), F.sum("n2")).first()
    marks, counts = _frequent(counted)
    sizes = own.where("n_shingles between 1 and 1000").groupBy("n_shingles").count().collect()  # at most 1000 rows
    limit = boundary({r[0]: r[1] for r in sizes}, (n2 or 0) / (n1 or 1), threshold)
    sent = spark.sparkContext.broadcast((marks, counts))

    posted = _post(docs, k, threshold, limit, sent).repartition("key", "part").sortWithinPartitions("key", "part", "cls")
    listed = materialise(_lists(posted, threshold, HELD_ROWS), "lists")
    heads = listed.where("kind = 2")
    best = heads.groupBy("key").agg(F.max(F.struct("central", "cls", "n")).alias("best"))
    far = heads.join(best, "key").where("cls <> best.cls").select(F.least("cls", "best.cls").alias("a"), F.greatest("cls", "best.cls").alias("b"), "light", F.least("n", "best.n").alias("n"))
    small = F.least(F.col("n"), F.col("other_n"))
    stars = listed.where("kind = 1").select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b"), "light", small.alias("n")).unionByName(far)
    enough = (F.max("light")) | (F.count("*") >= 1 + F.floor(F.min("n") / 24))
    stars = materialise(stars.groupBy("a", "b").agg(enough.alias("enough")).where("enough").select("a", "b"), "stars", few=True)
    links = materialise(_verified(stars, docs, owners, k, threshold), "star-links", few=True)
    label = components(links)

    # members of lists that hold two components still
    members = listed.where("kind = 0").select("key", "cls", "n", "pos", "light")
    members = members.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    members = materialise(members, "members", few=True)
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", "size")
    members = materialise(members.join(mixed, "key"), "mixed-members", few=True)
    # long lists: all that their members' whole sets link; pairs that meet in one are settled by that
    long = members.where(F.col("size") > LONG).select("key", "cls", "n", "component")
    joined = materialise(_forests(long, _sets(long.select("cls"), docs, owners, k), threshold), "long-links", few=True)
    # short lists: pairs that share enough of them
    short = members.where(F.col("size") <= LONG)
    x, y = (short.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "pos", "light", "component"))) for s in "ab")
    rest = 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1) + F.least("pos_a", "pos_b")
    close = ((100 + threshold) * rest >= threshold * (F.col("n_a") + F.col("n_b"))) & (100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    met = x.join(y, "key").where((F.col("cls_a") < F.col("cls_b")) & (F.col("component_a") != F.col("component_b")) & close)
    met = met.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg((F.max("light_a") | (F.count("*") >= 1 + F.floor(F.min(F.least("n_a", "n_b")) / 24))).alias("enough"))
    met = materialise(met.where("enough").select("a", "b"), "met", few=True)
    more = _verified(met, docs, owners, k, threshold).unionByName(joined)
    label = components(links.unionByName(more))

    named = label.join(owners.withColumnRenamed("cls", "node"), "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "component").select(F.col("node").alias("cls"), "component_id")
    each = owners.select("cls", F.col("doc_id").alias("owner")).join(linked, "cls", "left").select("cls", F.coalesce("component_id", "owner").alias("component_id"))
    return own.join(each, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

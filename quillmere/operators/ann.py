"""Approximate vector search, always followed by exact scores.

Quantizer: vectors are centred, rotated by a seeded orthogonal matrix and kept as one sign for each dimension with two
correction factors. A query estimates its distance to every code (in Arrow batches, on the executors), takes the best
`factor * k` of each partition, and scores these exactly. Graph: each partition of the table builds a proximity graph of its
own vectors; a query walks every graph and merges what they find. What reaches one place is k rows for each partition.

Blocks of queries: graphs are built and written once, over so many partitions that none has many more than GRAPH_ROWS rows;
queries go to the tasks QUERIES at a time, and every piece of the table answers with k rows for each.

Both are approximations without a promised recall; the exact search is the contract.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import vectors
from quillmere.shared import materialise


def exact(frame: DataFrame, q: list[float], k: int, metric: str = "cosine", vector: str = "v", key: str = "_id") -> DataFrame:
    """The k nearest rows: key and score, best first; ties by key."""
    q = vectors.as_floats(q)
    return frame.where(F.col(vector).isNotNull()).select(key, vectors.metric(F.col(vector), q, metric).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def centroid(frame: DataFrame, dims: int, vector: str = "v") -> np.ndarray:
    """Means by dimension, from one partial aggregation."""
    row = frame.agg(*(F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dims))).first()
    return np.array([x or 0.0 for x in row])


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


@dataclass
class Quantizer:
    """Signs of rotated, centred vectors; estimate() is unbiased for the inner product of unit vectors."""

    centre: np.ndarray
    turn: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, length of the centred vector, and how well its signs stand for it."""
        y = (x - self.centre) @ self.turn.T
        norm = np.linalg.norm(y, axis=1)
        signs = y >= 0
        agreement = np.abs(y).sum(axis=1) / np.maximum(norm, 1e-30) / np.sqrt(y.shape[1])
        return np.packbits(signs, axis=1), norm, np.where(norm > 0, agreement, 1.0)

    def estimate(self, q: np.ndarray, codes: np.ndarray, norm: np.ndarray, agreement: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the query, and bounds below them (eps0 = 1.9)."""
        d = len(q)
        y = self.turn @ (q - self.centre)
        length = np.linalg.norm(y)
        unit = y / max(length, 1e-30)
        signs = np.unpackbits(codes, axis=1)[:, :d].astype(np.float64) * 2 - 1
        dot = signs @ unit / np.sqrt(d) / np.maximum(agreement, 1e-30)
        slack = 1.9 * np.sqrt(np.maximum(0, 1 - agreement**2)) / np.maximum(agreement, 1e-30) / np.sqrt(max(1, d - 1))
        return norm**2 + length**2 - 2 * norm * length * dot, norm**2 + length**2 - 2 * norm * length * (dot + slack)


def quantized(frame: DataFrame, dims: int, vector: str = "v", key: str = "_id", seed: int = 7) -> tuple[DataFrame, Quantizer]:
    """Codes of all rows with a vector, written: key, vector, code, norm, agreement."""
    frame = frame.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("v"))
    model = Quantizer(centroid(frame, dims), rotation(dims, seed))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, norm, agreement = model.encode(_matrix(b.column(1), dims))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes]), pa.array(norm), pa.array(agreement)], names=[key, "v", "code", "norm", "agreement"])

    kind = frame.schema[key].dataType.simpleString()
    return materialise(frame.mapInArrow(encode, f"`{key}` {kind}, v array<float>, code binary, norm double, agreement double"), "codes"), model


def quantized_search(codes: DataFrame, model: Quantizer, q: list[float], k: int, factor: int = 8, key: str = "_id", metric: str = "cosine") -> DataFrame:
    """The k nearest by exact score among the `factor * k` best estimates of each partition."""
    q = vectors.as_floats(q)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            signs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            distance, _ = model.estimate(np.array(q), signs, b.column(3).to_numpy(), b.column(4).to_numpy())
            part = pa.table({key: b.column(0), "v": b.column(1), "d": distance})
            held = part if held is None else pa.concat_tables([held, part])
            if len(held) > factor * k:
                held = held.take(np.argsort(held["d"].to_numpy(), kind="stable")[: factor * k])
        if held is not None:
            yield from held.select([key, "v"]).combine_chunks().to_batches()

    kind = codes.schema[key].dataType.simpleString()
    return exact(codes.mapInArrow(best, f"`{key}` {kind}, v array<float>"), q, k, metric, "v", key)


# --- graph ----------------------------------------------------------------------------------------------------------


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 3) -> np.ndarray:
    """Neighbours (n, degree or a few more) by cosine distance, -1 where there are fewer. Each vector meets the beam that are
    nearest to it and as many at random, and keeps those that no nearer neighbour makes redundant (by alpha); neighbours take
    it in as far as they have room. What row 0 does not reach then gets an edge from the nearest row that it does reach."""
    n = len(x)
    unit, rng = _unit(x), np.random.default_rng(seed)
    pools = np.empty((n, min(2 * beam, n + beam)), np.int64)
    for at in range(0, n, _BLOCK):
        near = unit[at : at + _BLOCK] @ unit.T
        pools[at : at + _BLOCK, :-beam] = np.argpartition(-near, min(beam, n) - 1, axis=1)[:, : min(beam, n)]
    pools[:, -beam:] = rng.integers(0, n, (n, beam))
    out = _pruned(unit, np.arange(n), pools, degree, alpha)
    # both ways
    i, slot = np.nonzero(out >= 0)
    j = out[i, slot]
    pairs = np.unique(np.concatenate([i * n + j, j * n + i]))
    i, j = pairs // n, pairs % n
    order = np.lexsort((1 - np.einsum("pd,pd->p", unit[i], unit[j]), i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    room = place < 4 * degree
    both = np.full((n, 4 * degree), -1, np.int64)
    both[i[room], place[room]] = j[room]
    table = np.full((n, degree), -1, np.int64)
    table[:] = both[:, :degree]
    full = np.flatnonzero(both[:, degree] >= 0)
    if len(full):
        table[full] = _pruned(unit, full, both[full], degree, alpha)
    return _joined(unit, table).astype(np.int32)


def _pruned(unit: np.ndarray, rows: np.ndarray, pools: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(rows, degree): of each pool, from near to far, what no nearer one that was kept makes redundant; -1 in a pool is none."""
    out = np.full((len(rows), degree), -1, np.int64)
    for at in range(0, len(rows), _BLOCK // 4):
        pool, own = pools[at : at + _BLOCK // 4], rows[at : at + _BLOCK // 4]
        distance = 1 - np.einsum("rpd,rd->rp", unit[pool], unit[own])
        distance[(pool < 0) | (pool == own[:, None])] = np.inf
        order = np.lexsort((pool, distance), axis=1)
        pool, distance = np.take_along_axis(pool, order, 1), np.take_along_axis(distance, order, 1)
        alive = np.isfinite(distance)
        alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]  # one that was drawn twice stands side by side
        between = unit[pool]
        between = 1 - between @ between.transpose(0, 2, 1)
        line = np.arange(len(pool))
        for step in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            p = alive.argmax(axis=1)
            out[at : at + _BLOCK // 4, step] = np.where(some, pool[line, p], -1)
            alive[line, p] = False
            alive &= alpha * between[line, p] > distance
    return out


def _joined(unit: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The table with as many columns more as it takes for row 0 to reach all rows."""
    n = len(table)
    reached = np.zeros(n, bool)
    extra: list[list[int]] = [[] for _ in range(n)]

    def spread(front: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            near = np.unique(table[front])
            near = near[near >= 0]
            front = near[~reached[near]]

    spread(np.zeros(1, np.int64))
    for j in range(n):
        if not reached[j]:
            known = np.flatnonzero(reached)
            closest = unit[known] @ unit[j]
            # of equal ones that with the fewest such edges, so that copies do not all hang on one row
            ties = known[closest >= closest.max() - 1e-12]
            extra[min(ties.tolist(), key=lambda r: len(extra[r]))].append(j)
            spread(np.array([j]))
    width = max(map(len, extra), default=0)
    more = np.full((n, width), -1, np.int64)
    for i, row in enumerate(extra):
        more[i, : len(row)] = row
    return np.concatenate([table, more], axis=1)


def _walk(unit: np.ndarray, edges, q: np.ndarray, beam: int, start: int) -> list[tuple[float, int]]:
    """Best-first search with a beam: (distance, row), nearest first."""
    seen = {start}
    pool = [(float(1 - unit[start] @ q), start)]
    done: set[int] = set()
    while True:
        todo = next((j for _, j in pool if j not in done), None)
        if todo is None:
            return pool
        done.add(todo)
        new = [int(j) for j in edges[todo] if j >= 0 and int(j) not in seen]
        if new:
            seen.update(new)
            pool = sorted([*pool, *zip((1 - unit[new] @ q).tolist(), new, strict=True)])[:beam]


#: Rows of a beam that are followed at once.
_FOLLOWED = 4


def _walks(unit: np.ndarray, edges: np.ndarray, q: np.ndarray, beam: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first searches of all q side by side: distances and rows (q, beam), nearest first; where there are fewer, -1."""
    m, n = len(q), len(unit)
    far, rows, done = np.full((m, beam), np.inf), np.full((m, beam), -1, np.int64), np.ones((m, beam), bool)
    far[:, 0], rows[:, 0], done[:, 0] = 1 - q @ unit[start], start, False
    seen, tag = np.zeros(m * n, bool), np.zeros(m * n, np.int32)
    seen[np.arange(m) * n + start] = True
    while True:
        own, at = np.nonzero(~done & ((~done).cumsum(axis=1) <= _FOLLOWED))
        if not len(own):
            return far, rows
        done[own, at] = True
        near = edges[rows[own, at]]
        own = np.repeat(own, (near >= 0).sum(axis=1))
        near = near[near >= 0].astype(np.int64)
        place = own * n + near
        new = ~seen[place]
        own, near, place = own[new], near[new], place[new]
        tag[place] = np.arange(len(place))
        once = tag[place] == np.arange(len(place))
        own, near, place = own[once], near[once], place[once]
        if not len(own):
            continue
        seen[place] = True
        slot = np.arange(len(own)) - np.searchsorted(own, own)
        wide = int(slot.max()) + 1
        more = np.full((m, wide), np.inf), np.full((m, wide), -1, np.int64), np.ones((m, wide), bool)
        more[0][own, slot] = 1 - np.einsum("pd,pd->p", unit[near], q[own])
        more[1][own, slot] = near
        more[2][own, slot] = False
        far, rows, done = (np.concatenate(both, axis=1) for both in zip((far, rows, done), more, strict=True))
        best = np.argsort(far, axis=1, kind="stable")[:, :beam]
        far, rows, done = (np.take_along_axis(x, best, 1) for x in (far, rows, done))


def graph_search(frame: DataFrame, q: list[float], k: int, dims: int, partitions: int = 8, beam: int = 64, vector: str = "v", key: str = "_id", allowed=None) -> DataFrame:
    """Builds a graph for each partition, walks it, and scores what it finds exactly; allowed: a filter on the rows found."""
    q = vectors.as_floats(q)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole).combine_chunks()
        x = _matrix(table.column(1).chunk(0), dims)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        own = np.array(q) / max(np.linalg.norm(q), 1e-30)
        rows = [j for _, j in _walk(unit, build_graph(x), own, max(beam, k), 0)]
        yield from table.take(rows).to_batches()

    rows = frame.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("v"), *([allowed.alias("_ok")] if allowed is not None else []))
    kind = frame.schema[key].dataType.simpleString()
    found = rows.repartition(partitions, key).mapInArrow(find, f"`{key}` {kind}, v array<float>" + (", _ok boolean" if allowed is not None else ""))
    if allowed is not None:  # after the walk, as a filter on the graph's answers: fewer than k may be left
        found = found.where("_ok")
    return exact(found, q, k, "cosine", "v", key)


# --- blocks of queries ----------------------------------------------------------------------------------------------

#: Rows of a graph, queries that are sent to the tasks at once, and rows whose estimates are ranked at once.
GRAPH_ROWS, QUERIES, RANKED = 2048, 8192, 2048
_BLOCK = 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _blocks(queries: DataFrame, dims: int, vector: str, key: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and vectors of all queries, so many at a time as the driver may hold."""
    wanted = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).cast("array<float>").alias("q"))
    parts = -(-wanted.count() // (QUERIES // 2))
    if not parts:
        return
    wanted = materialise(wanted.withColumn("_part", F.pmod(F.xxhash64("query"), F.lit(parts))), "queries")
    for i in range(parts):
        table = wanted.where(F.col("_part") == i).toArrow().combine_chunks()
        if len(table):
            yield table.column("query").combine_chunks(), _matrix(table.column("q").combine_chunks(), dims)


def _merged(found: list[DataFrame], k: int, key: str) -> DataFrame:
    """The k best of each query."""
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return whole.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def exact_block_search(frame: DataFrame, queries: DataFrame, k: int, dims: int, vector: str = "v", key: str = "_id") -> DataFrame:
    """query, key and cosine score of the k nearest rows to each query: all rows are met by all queries. Scores are those of
    exact() to the last bit, ties by key; a product of matrices only rules out what is clearly not among the k nearest."""
    kind, asked = frame.schema[key].dataType.simpleString(), queries.schema[key].dataType.simpleString()
    rows = frame.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<float>").alias("v"))
    found = []
    for names, q in _blocks(queries, dims, vector, key):
        sent = frame.sparkSession.sparkContext.broadcast((names, q))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            unit_q = _unit(q)
            floor = np.full(len(q), -np.inf)  # the k-th score so far
            own, scores, keys = np.empty(0, np.int64), np.empty(0), None
            for whole in batches:
                for first in range(0, whole.num_rows, RANKED):
                    b = whole.slice(first, RANKED)
                    x = _matrix(b.column(1), dims)
                    unit, some = _unit(x), min(k, b.num_rows)
                    more_own, more_rows, more_scores = [own], [], [scores]
                    for at in range(0, len(q), _BLOCK):
                        near = np.nan_to_num(unit_q[at : at + _BLOCK] @ unit.T, nan=1.0)
                        least = np.maximum(np.partition(near, -some, axis=1)[:, -some], floor[at : at + _BLOCK])
                        i, j = np.nonzero(near >= least[:, None] - 1e-9)
                        more_own.append(i + at)
                        more_rows.append(j)
                        more_scores.append(_scores(x, q, j, i + at))
                    new = b.column(0).take(pa.array(np.concatenate(more_rows)))
                    keys = new if keys is None else pa.concat_arrays([keys, new])
                    own, scores = np.concatenate(more_own), np.concatenate(more_scores)
                    order, place = _ranked(own, scores, keys, k)
                    own, scores, keys = own[order], scores[order], keys.take(pa.array(order))
                    floor[own[place == k - 1]] = scores[place == k - 1]
            if keys is not None:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), keys, pa.array(scores)], names=["query", key, "score"])

        found.append(rows.mapInArrow(best, f"query {asked}, `{key}` {kind}, score double"))
    if not found:
        found = [frame.sparkSession.createDataFrame([], f"query {asked}, `{key}` {kind}, score double")]
    return _merged(found, k, key)


def _added(a: np.ndarray, b: np.ndarray, i, j) -> np.ndarray:
    """Products of rows i of a and j of b, added up from the first element to the last, as vectors does."""
    total = np.zeros(len(i))
    for u, v in zip(a.T, b.T, strict=True):
        total += u[i] * v[j]
    return total


def _scores(x: np.ndarray, q: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Cosines of pairs as vectors.cosine has them, so that copies have one score wherever they are."""
    every = np.arange(len(x)), np.arange(len(q))
    length, far = _added(x, x, every[0], every[0])[rows], _added(q, q, every[1], every[1])[own]
    score = np.divide(_added(x, q, rows, own), np.sqrt(length * far), out=np.zeros(len(rows)), where=(length != 0) & (far != 0))
    return np.clip(np.nan_to_num(score, nan=1.0), -1.0, 1.0)


def _ranked(own: np.ndarray, scores: np.ndarray, keys: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k best of each query stand, best first, ties by key; and their places."""
    order = np.lexsort((pc.rank(keys, tiebreaker="dense").to_numpy(), -scores, own))
    place = np.arange(len(order)) - np.searchsorted(own[order], own[order])
    return order[place < k], place[place < k]


def graphs(frame: DataFrame, dims: int, vector: str = "v", key: str = "_id") -> DataFrame:
    """A graph for each of so many partitions as the rows need, written: a row for each, with vectors, edges and the keys of each
    vector in order. Copies are one node, so that they neither crowd out each other's neighbours nor lose any of their keys."""
    rows = frame.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<float>").alias("v"))
    parts = max(1, -(-rows.count() // GRAPH_ROWS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if whole:
            table = pa.Table.from_batches(whole).combine_chunks()
            x, node = np.unique(_matrix(table.column(1).combine_chunks(), dims).astype("<f4"), axis=0, return_inverse=True)
            rank = pc.rank(table.column(0).combine_chunks(), tiebreaker="first").to_numpy()
            keys = table.column(0).combine_chunks().take(pa.array(np.lexsort((rank, node))))
            ends = np.cumsum(np.bincount(node, minlength=len(x))).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *(pa.array([y.tobytes()]) for y in (ends, x, build_graph(x.astype(np.float64)).astype("<i4")))], names=["keys", "ends", "x", "edges"])

    kind = frame.schema[key].dataType.simpleString()
    return materialise(rows.repartition(parts, key).mapInArrow(build, f"keys array<{kind}>, ends binary, x binary, edges binary"), "graphs")


def graph_block_search(built: DataFrame, queries: DataFrame, k: int, dims: int, beam: int = 64, vector: str = "v", key: str = "_id") -> DataFrame:
    """query, key and cosine score of what walks of all graphs find nearest to each query."""
    kind = built.schema["keys"].dataType.elementType.simpleString()
    asked = queries.schema[key].dataType.simpleString()
    found = []
    for names, q in _blocks(queries, dims, vector, key):
        sent = built.sparkSession.sparkContext.broadcast((names, q))

        def walk(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for b in batches:
                for i in range(b.num_rows):
                    keys = b.column(0)[i].values
                    ends = np.frombuffer(b.column(1)[i].as_py(), "<i4").astype(np.int64)
                    first = np.concatenate([[0], ends[:-1]])
                    x = np.frombuffer(b.column(2)[i].as_py(), "<f4").astype(np.float64).reshape(-1, dims)
                    edges = np.frombuffer(b.column(3)[i].as_py(), "<i4").reshape(len(x), -1)
                    unit = _unit(x)
                    for at in range(0, len(q), _BLOCK):
                        some = q[at : at + _BLOCK]
                        _, nodes = _walks(unit, edges, _unit(some), max(beam, k), 0)
                        own, place = np.nonzero(nodes[:, :k] >= 0)
                        nodes = nodes[own, place]
                        scores = _scores(x, some, nodes, own)
                        held = np.minimum(ends[nodes] - first[nodes], k)  # of copies, no more than k can be among the k nearest
                        rows = np.repeat(first[nodes], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
                        own, scores, near = np.repeat(own, held), np.repeat(scores, held), keys.take(pa.array(rows))
                        order, _ = _ranked(own, scores, near, k)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(own[order] + at)), near.take(pa.array(order)), pa.array(scores[order])], names=["query", key, "score"])

        found.append(built.mapInArrow(walk, f"query {asked}, `{key}` {kind}, score double"))
    if not found:
        found = [built.sparkSession.createDataFrame([], f"query {asked}, `{key}` {kind}, score double")]
    return _merged(found, k, key)


def quantized_block_search(codes: DataFrame, model: Quantizer, queries: DataFrame, k: int, dims: int, factor: int = 8, vector: str = "v", key: str = "_id") -> DataFrame:
    """query, key and cosine score of the k nearest by exact score among the `factor * k` best estimates of cosine of every RANKED rows, and
    all those whose bound (eps0 = 1.9) does not keep them from the k nearest."""
    kind, asked = codes.schema[key].dataType.simpleString(), queries.schema[key].dataType.simpleString()
    found = []
    for names, q in _blocks(queries, dims, vector, key):
        sent = codes.sparkSession.sparkContext.broadcast((names, q))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            turned, unit_q = (q - model.centre) @ model.turn.T, _unit(q)
            for whole in batches:
                for first in range(0, whole.num_rows, RANKED):
                    b = whole.slice(first, RANKED)
                    signs = np.unpackbits(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)[:, :dims] * 2.0 - 1
                    norm, agreement = b.column(3).to_numpy(), b.column(4).to_numpy()
                    x = _matrix(b.column(1), dims)
                    unit, own_length = _unit(x), np.linalg.norm(x, axis=1)
                    slack = 1.9 * np.sqrt(np.maximum(0, 1 - agreement**2)) / np.maximum(agreement, 1e-30) / np.sqrt(max(1, dims - 1))
                    some = min(factor * k, b.num_rows)
                    for at in range(0, len(q), _BLOCK):
                        y = turned[at : at + _BLOCK]
                        length, far = np.linalg.norm(y, axis=1)[:, None], np.linalg.norm(q[at : at + _BLOCK], axis=1)[:, None]
                        dot = y @ signs.T / np.maximum(length, 1e-30) / np.sqrt(dims) / np.maximum(agreement, 1e-30)
                        both = np.maximum(2 * own_length * far, 1e-30)
                        cosine = (own_length**2 + far**2 - norm**2 - length**2 + 2 * norm * length * dot) / both
                        bound = cosine + 2 * norm * length * slack / both
                        near = np.argpartition(-cosine, some - 1, axis=1)[:, :some]
                        least = np.sort(np.einsum("qcd,qd->qc", unit[near], unit_q[at : at + _BLOCK]), axis=1)[:, -min(k, some)]
                        rows, own = [], []
                        for i in range(len(y)):
                            open_ = bound[i] >= least[i]
                            open_[near[i]] = True
                            pool = np.flatnonzero(open_)
                            score = unit[pool] @ unit_q[at + i]
                            top = pool[score >= np.partition(score, -min(k, len(pool)))[-min(k, len(pool))] - 1e-9]
                            rows.append(top)
                            own.append(np.full(len(top), at + i))
                        rows, own = np.concatenate(rows), np.concatenate(own)
                        scores, keys = _scores(x, q, rows, own), b.column(0).take(pa.array(rows))
                        order, _ = _ranked(own, scores, keys, k)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(own[order])), keys.take(pa.array(order)), pa.array(scores[order])], names=["query", key, "score"])

        found.append(codes.select(key, "v", "code", "norm", "agreement").mapInArrow(best, f"query {asked}, `{key}` {kind}, score double"))
    if not found:
        found = [codes.sparkSession.createDataFrame([], f"query {asked}, `{key}` {kind}, score double")]
    return _merged(found, k, key)

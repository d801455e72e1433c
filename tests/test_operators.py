import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere import catalog, catalog_store, cli, shared
from quillmere.functions import vectors
from quillmere.operators import ann, prepared
from quillmere.operators.ranks import ranged, with_rank
from quillmere.operators.search import facet
from quillmere.sources.snapshot import Snapshot
from quillmere.streaming.mutations import follow


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 32)).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "_id long, v array<float>")


def test_exact_metrics(points):
    x, frame = points
    q = x[3].astype(float).tolist()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit[3]), kind="stable")[:10]
    assert [r["_id"] for r in ann.exact(frame, q, 10).collect()] == want.tolist()
    assert ann.exact(frame, q, 1, "l2").first()["score"] == 1.0
    assert np.isclose(ann.exact(frame, q, 1, "dot").first()["score"], (x.astype(float) @ x[3]).max())


def test_approximate_search_finds_most_neighbours(points):
    x, frame = points
    codes, model = ann.quantized(frame, 32)
    hits = {"codes": 0, "graph": 0}
    for i in (0, 7, 99):
        q = x[i].astype(float).tolist()
        want = {r["_id"] for r in ann.exact(frame, q, 10).collect()}
        got = [r["_id"] for r in ann.quantized_search(codes, model, q, 10).collect()]
        assert got[0] == i
        hits["codes"] += len(want & set(got))
        got = [r["_id"] for r in ann.graph_search(frame, q, 10, 32, partitions=2).collect()]
        assert got[0] == i
        hits["graph"] += len(want & set(got))
    assert min(hits.values()) >= 27, hits
    some = ann.graph_search(frame, x[0].astype(float).tolist(), 5, 32, partitions=1, allowed=F.col("_id") % 2 == 0).collect()
    assert some and all(r["_id"] % 2 == 0 for r in some)


def test_bounds_lie_below_estimates(points):
    x, _ = points
    model = ann.Quantizer(x.mean(axis=0).astype(float), ann.rotation(32))
    assert np.allclose(model.turn @ model.turn.T, np.eye(32))
    estimate, bound = model.estimate(x[1].astype(float), *model.encode(x.astype(float)))
    true = ((x.astype(float) - x[1]) ** 2).sum(axis=1)
    assert (bound <= estimate + 1e-9).all() and np.corrcoef(estimate, true)[0, 1] > 0.8


@pytest.fixture(scope="module")
def copies(spark):
    """3000 vectors, every third one of 20 that are often repeated."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[::3] = x[rng.integers(1, 60, 1000) // 3 * 3]
    x[5] = 0
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "_id long, v array<float>").repartition(5)
    return x, frame


def test_block_brute_force_is_the_exact_search(copies):
    x, frame = copies
    got = {}
    for r in ann.exact_block_search(frame, frame.where("_id % 500 < 4"), 10, 16).collect():
        got.setdefault(r["query"], []).append((-r["score"], r["_id"]))
    assert set(got) == {i for i in range(3000) if i % 500 < 4}
    for i in (0, 1, 2, 3, 500, 2501):
        want = [(r["_id"], r["score"]) for r in ann.exact(frame, x[i].tolist(), 10).collect()]
        assert [(j, -s) for s, j in sorted(got[i])] == want


def test_approximate_searches_settle_copies_by_key(copies, monkeypatch):
    x, frame = copies
    monkeypatch.setattr(ann, "GRAPH_ROWS", 1000)
    queries = frame.where("_id % 30 = 0")
    want = {(r["query"], r["_id"]) for r in ann.exact_block_search(frame, queries, 10, 16).collect()}
    codes, model = ann.quantized(frame, 16)
    for found in (ann.graph_block_search(ann.graphs(frame, 16), queries, 10, 16), ann.quantized_block_search(codes, model, queries, 10, 16)):
        got = {(r["query"], r["_id"]) for r in found.collect()}
        assert len(want & got) >= 0.99 * len(want)


def test_recall_plan_does_not_grow_with_queries(spark):
    rows = spark.range(6000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * F.col("id")).cast("float")).alias("embedding"))
    plan = catalog_store._recall(rows, spark.createDataFrame([], "query long, vec_id long"), 10)
    assert plan._jdf.queryExecution().analyzed().toString().count("\n") < 100


def test_graph_of_many_rows_is_made_at_once_and_reaches_all():
    x = np.random.default_rng(2).standard_normal((2048, 64))
    x[:300] = x[0]
    began = time.process_time()
    edges = ann.build_graph(x)
    assert time.process_time() - began < 15
    reached, front = {0}, [0]
    while front:
        front = [j for i in front for j in edges[i].tolist() if j >= 0 and j not in reached and not reached.add(j)]
    assert len(reached) == 2048


def test_prepared_lookup_of_many_rows(spark, tmp_path):
    """As many candidates as are looked up by number; lists of several blocks; texts that lower() does not normalise."""
    rows = spark.range(0, 12000, 1, 4).select("id", F.when(F.col("id") % 6 == 0, F.concat(F.lit("Ein Nadel\uff21 \U0001f600 im heu heu "), F.col("id"))).when(F.col("id") % 7 > 0, F.concat(F.lit("ein heu \u00fc "), F.col("id"))).alias("text"))
    index = prepared.Index.build(catalog.table_of(rows, "id"), f"file://{tmp_path}/index")
    for query in ('text:substr("nadela")', "text:nadela", 'text:substr("\U0001f600 i")'):
        found = index.search(query)
        assert found.mode == "postings"
        assert {int(r["_id"]) for r in found.scored.collect()} == set(range(0, 12000, 6))
    assert [tuple(r) for r in index.lookup("text", "heu").select("term", "holding", "occurrences").collect()] == [("heu", 10571, 12571)]
    assert index.postings.where("term = 'heu' AND tf = 2").count() == 2000
    # lists come without a shuffle, one row for many rows of the table
    assert spark.read.parquet(f"file://{tmp_path}/index/postings").where("term = 'heu'").count() <= 8


def test_scalar_quantization(points, spark):
    x, frame = points
    rows = frame.select("v", vectors.dequantize(vectors.quantize(F.col("v"))).alias("d"), vectors.quantize(F.col("v"))["step"].alias("s")).collect()
    for r in rows[:50]:
        assert np.abs(np.array(r["v"]) - np.array(r["d"])).max() <= r["s"] / 2 + 1e-4
    flat = spark.createDataFrame([([2.0, 2.0],)], "v array<float>").select(vectors.dequantize(vectors.quantize(F.col("v")))).first()[0]
    assert flat == [2.0, 2.0]


def test_ranks_over_ranges(spark):
    frame = spark.range(0, 5000, 1, 7).select(F.pmod(F.col("id") * 37, F.lit(11)).alias("g"), (F.col("id") * 7919 % 5003).alias("x"))
    rows = with_rank(ranged(frame, [F.col("g"), F.col("x")], "t"), "rank").collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: (r["g"], r["x"]))] == list(range(5000))
    rows = with_rank(ranged(frame, [F.col("g"), F.col("x")], "t"), "rank", "g").collect()
    for g in range(11):
        assert [r["rank"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["x"])] == list(range(sum(r["g"] == g for r in rows)))


def test_facets_streams_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({"_id": str(i), "kind": "ab"[i % 3 > 0], "n": i}) for i in range(9)))
    table = Snapshot.build(spark, f"file://{tmp_path}/in.jsonl", str(tmp_path / "s"))
    assert [tuple(r) for r in facet(table.table, "n:>0 FACET kind")["kind"].collect()] == [("b", 6), ("a", 2)]
    (tmp_path / "ops").mkdir()
    (tmp_path / "ops" / "1.jsonl").write_text(json.dumps({"op": "delete", "id": "0"}) + "\n" + json.dumps({"op": "upsert", "document": {"_id": "9", "kind": "c", "n": 9}}))
    follow(spark, f"file://{tmp_path}/ops", str(tmp_path / "s"), f"file://{tmp_path}/checkpoint").awaitTermination(120)
    assert Snapshot.open(spark, str(tmp_path / "s")).search("* SORT BY n LIMIT 20").ids() == [str(i) for i in range(1, 10)]
    assert cli.main(["search", str(tmp_path / "s"), "n:>=8"]) == 0
    assert json.loads(capsys.readouterr().out)["execution"]["total"] == 2
    assert cli.main(["search", str(tmp_path / "s"), "n:>="]) == 1
    assert cli.main(["stats", str(tmp_path / "s")]) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", ["g1_graph_search", "g4_quantized_search"])
def test_registered_approximate_searches_recall(spark, name, monkeypatch):
    monkeypatch.setattr(ann, "GRAPH_ROWS", 1000)  # several graphs, and several blocks of queries
    monkeypatch.setattr(ann, "QUERIES", 16)
    path = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").toArrow()
    ids, x = rows.column(0).to_numpy(), np.array(rows.column(1).to_pylist(), np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in catalog.QUERIES[name](spark, path).collect():
        got.setdefault(r["query"], {})[r["vec_id"]] = r["score"]
    asked = np.flatnonzero(ids % 100 == 0)
    assert set(got) == set(ids[asked].tolist())
    hits = 0
    for i in asked:
        score, own = unit @ unit[i], got[int(ids[i])]
        assert len(own) == 10 and all(abs(score[ids == j][0] - s) < 1e-6 for j, s in own.items())
        hits += len(set(ids[np.lexsort((ids, -score))[:10]].tolist()) & set(own))
    print(name, hits, 10 * len(asked))
    assert hits >= 0.9 * 10 * len(asked)


def test_lines_are_numbered_in_the_order_of_files_and_nothing_is_left(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for f in range(3):
        (tmp_path / "in" / f"{f}.jsonl").write_text("\n \n".join(json.dumps({"_id": f"{f}-{i}"}) for i in range(40 * (3 - f))) + "\n")
    monkeypatch.setattr(shared, "base", lambda _: f"file://{tmp_path}/shared")
    table = Snapshot.build(spark, f"file://{tmp_path}/in", str(tmp_path / "s"))
    assert [r["_id"] for r in table.frame.orderBy("_row").collect()] == [f"{f}-{i}" for f in range(3) for i in range(40 * (3 - f))]
    assert [r["_row"] for r in table.frame.orderBy("_row").collect()] == list(range(240))
    assert not os.listdir(tmp_path / "shared" / "quillmere")

import hashlib

import numpy as np
import pytest

from quillmere.llm.line_dedup import Cuckoo, LineStore, line_key

LONG = "A line that is long enough to have a key of its own, number "


def brute(docs, least_docs=5):
    keys = {}
    for i, (d, t) in enumerate(docs):
        for k in {line_key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                keys.setdefault(k, []).append(d)
    best = {k: max((d for d in v if d is not None), default=None) for k, v in keys.items() if len(v) >= least_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if line_key(x) not in best or best[line_key(x)] == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 64, 1000, 20000])
def test_cuckoo_filter_finds_what_it_holds(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(-(1 << 63), (1 << 63) - 1, (2, n), dtype=np.int64)
    table = Cuckoo.of(hi, lo)
    assert table.contains(hi, lo).all()
    other = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 20000), dtype=np.int64)
    assert table.contains(*other).mean() < 0.002
    again = Cuckoo.from_bytes(table.to_bytes())
    again.delete(hi[: n // 2], lo[: n // 2])
    assert again.contains(hi[n // 2 :], lo[n // 2 :]).all()
    if n > 100:
        assert again.contains(hi[: n // 2], lo[: n // 2]).mean() < 0.01


def test_a_full_filter_says_so_and_stays_as_it_was():
    table = Cuckoo.sized(10)
    many = np.arange(1000, dtype=np.int64)
    before = table.table.copy()
    assert not table.insert(many << 50, many)
    assert (table.table == before).all()


DOCS = [
    *((i, f"{LONG}1\nown {i}\n  {LONG}1  ") for i in range(7)),
    (7, LONG.upper() + "1"),
    (8, None),
    (9, ""),
    (10, "\n\n"),
    *((20 + i, LONG + "2") for i in range(4)),
    (24, LONG + "2 café É"),
    (24, LONG + "2"),
    (24, LONG + "2"),
    (None, LONG + "2"),
    (30, "x" * 200_000),
]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("size", [1 << 26, 0])
def test_both_ways_agree_with_brute_force(spark, size):
    docs = frame(spark, DOCS)
    got = LineStore.build(docs).dedup(docs, broadcast_bytes=size)
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == brute(DOCS)


def test_insert_and_delete_are_reversible(spark):
    half, rest = DOCS[:9], DOCS[9:]
    first = LineStore.build(frame(spark, half))
    both = first.insert(frame(spark, rest))
    docs = frame(spark, DOCS)
    whole = sorted(map(repr, both.dedup(docs).collect()))
    assert whole == sorted(map(repr, LineStore.build(docs).dedup(docs).collect()))
    back = both.delete(frame(spark, rest).select("doc_id"))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, first.counts.collect()))
    left = frame(spark, half)
    assert sorted(map(repr, back.dedup(left).collect())) == sorted(map(repr, first.dedup(left).collect()))


def test_empty_table_and_clashing_columns(spark):
    docs = frame(spark, []).selectExpr("doc_id", "text", "1 AS n_lines", "'x' AS source")
    assert LineStore.build(docs).dedup(docs).collect() == []
    some = frame(spark, DOCS[:3]).selectExpr("doc_id", "text", "'a' AS n_lines", "'x' AS source")
    got = LineStore.build(some).dedup(some)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    assert {r["source"] for r in got.collect()} == {"x"}


def test_query_on_null_and_empty_text(spark, tmp_path):
    from quillmere.llm.query_line_dedup import op9_line_dedup

    frame(spark, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["kept_sha256"]) for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert (8, hashlib.sha256(b"").hexdigest()) in got


def test_shards_grow_with_the_keys(spark):
    lines = [(d, "\n".join(f"line number {k} that is long enough to be counted here" for k in range(40))) for d in range(6)]
    docs = frame(spark, lines)
    small = LineStore.build(docs.where("doc_id < 5"), bits=1, shard_keys=10)
    assert small.bits == 2
    more = frame(spark, [(d, "\n".join(f"another line {k} that is long enough to be counted here" for k in range(200))) for d in range(10, 16)])
    grown = small.insert(docs.where("doc_id = 5")).insert(more)
    assert grown.bits > small.bits
    both = docs.unionByName(more)
    want = sorted(map(repr, LineStore.build(both).dedup(both).collect()))
    assert sorted(map(repr, grown.dedup(both).collect())) == want
    assert sorted(map(repr, grown.dedup(both, broadcast_bytes=0).collect())) == want

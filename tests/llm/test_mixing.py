import random

import pytest
from pyspark.sql import functions as F

from quillmere.llm import mixing
from tests.llm.common import docs


def rows(n=600, seed=1):
    rng = random.Random(seed)
    return [(i if i % 50 else None, rng.choice([None, "", " ".join("x" * rng.randrange(1, 200))]), rng.choice([None, "", "é", *["hot"] * 8, *[f"s{k}" for k in range(9)]])) for i in range(n)]


def brute_targets(sizes):
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[k] for k in full)
        shared = sum(weight[k] for k in keys if k not in full)
        over = {k for k in keys if k not in full and rest * weight[k] > 3 * sizes[k] * shared}
        if not over:
            return {k: 3 * sizes[k] if k in full else rest * weight[k] / shared for k in keys}
        full |= over


def test_targets_and_samples(spark):
    table = rows()
    mixed = mixing.mix(docs(spark, table), mixing.n_words(F.col("text")))
    got = mixed.collect()
    sizes = {}
    for _, t, s in table:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(table)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]} and own[0]["target"] == pytest.approx(want[s])
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - want[s]) <= 2 * max(r["size"] for r in own) + 1
        assert all(0 <= r["copies"] <= 3 for r in own)
        each = want[s] / sizes[s] if sizes[s] else 0
        assert all(r["copies"] in (int(each), int(each) + 1) for r in own)
    again = mixing.mix(docs(spark, table[::-1]).repartition(7), mixing.n_words(F.col("text"))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.emit(mixed, ["doc_id"]).count() == sum(r["copies"] for r in got)


def test_one_source_no_words_and_no_rows(spark):
    one = mixing.mix(docs(spark, [(i, "a b", "s") for i in range(9)]).withColumn("target", F.lit("mine")), mixing.n_words(F.col("text"))).collect()
    assert [r["copies"] for r in one] == [1] * 9
    none = mixing.mix(docs(spark, [(1, None, None), (1, None, None)]), mixing.n_words(F.col("text"))).collect()
    assert [(r["copies"], r["target"]) for r in none] == [(0, 0.0)] * 2
    assert mixing.mix(docs(spark, []), mixing.n_words(F.col("text"))).collect() == []


def test_other_columns_may_clash_and_ties_are_settled(spark):
    table = docs(spark, [(None, f"a{i} b", "s") for i in range(40)] + [(None, "c d", "t")] * 3).withColumns({"_key": F.lit("k"), "_place": F.lit(1), "_range": F.lit(2), "_kept": F.lit(3), "copies": F.lit("x")})
    size = mixing.n_words(F.col("text"))
    one = mixing.mix(table, size)
    assert one.columns == [c for c in table.columns if c != "copies"] + ["size", "source_size", "target", "copies"]
    again = mixing.mix(table.repartition(5, "text"), size)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, again.collect()))
    assert {(r["_key"], r["_place"], r["_range"], r["_kept"]) for r in one.collect()} == {("k", 1, 2, 3)}

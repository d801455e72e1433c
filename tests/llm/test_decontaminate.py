import random
import re

import pytest
from pyspark.sql import functions as F

from quillmere.llm import decontaminate
from tests.llm.common import docs, prose


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(i)
    out = []
    for d, t, _ in rows:
        w, hit, named = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (own := tuple(w[s : s + k])) in windows:
                    hit |= set(range(s, s + k))
                    named |= windows[own]
        out.append((d, len(w), len(hit), len(named), ",".join(sorted(map(str, named))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("literals,broadcast", [(50_000, 200_000), (0, 0)])
def test_both_ways_agree_with_brute_force(spark, literals, broadcast):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([1, 3, 4, 5, 12, 13, 14, 40]), 60)) for i in range(25)] + [(30, None), (31, "  ,"), (32, "W1 w2"), (33, "Écoute, ÉTÉ x-Y z"), (40, prose(random.Random(9), 30)), (41, prose(random.Random(9), 30))]
    rows = [(i, prose(rng, rng.randrange(0, 80), 60), None) for i in range(60)] + [(100, None, None), (101, "", None), (7, "w1,W2!", None), (7, "w1,W2!", None), (102, "écoute ÉTÉ x y z", None), (103, "x " * 5000 + prose(random.Random(9), 30), None)]
    found = decontaminate.find(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), literals=literals, broadcast_rows=broadcast)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in found.collect()), key=repr)
    assert got == brute(rows, items)
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_tables_and_clashing_columns(spark):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    frame = docs(spark, [(1, "a b c d", None), (None, "x", None)]).withColumn("items", F.lit(1))
    assert [r["n_hit"] for r in decontaminate.find(frame, none).collect()] == [0, 0]
    assert decontaminate.find(docs(spark, []), some).collect() == []
    got = decontaminate.find(frame, some)
    assert dict(got.dtypes)["items"] == "array<string>" and sorted(r["n_hit"] for r in got.collect()) == [0, 3]


def test_names_of_the_steps_may_clash(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    table = docs(spark, [(1, "x " + " ".join(f"w{i}" for i in range(13)), None), (2, None, None)]).withColumns({c: F.lit(c) for c in ("_at5", "_row", "_hits", "_words", "_kept", "_text", "n_hit")})
    got = {r["doc_id"]: r for r in decontaminate.find(table, items).collect()}
    assert got[1]["n_hit"] == 13 and got[2]["n_hit"] == 0 and all(got[1][c] == c for c in ("_at5", "_row", "_hits", "_words", "_kept", "_text"))

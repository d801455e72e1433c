import random
import re

import pytest
from pyspark.sql import functions as F

from quillmere.llm import quality
from tests.llm.common import docs, prose


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered), t.count("!")


TEXTS = [None, "", " \n\t ", "one", "a b c", "a b c d", "a a a", "a a a a", "a b c a b c", "x y\nx y\n\nx y\n z", "é ü é ü é ü # & |", "a\x0bb\x0cc\x0bd a\rb c", " nbsp\xa0is no space " * 3, "w " * 30_000]


def texts():
    rng = random.Random(3)
    return [*TEXTS, *TEXTS[:4], *(prose(rng, rng.randrange(1, 300), rng.choice([3, 20, 400])) for _ in range(60))]


def test_measures_agree_with_brute_force(spark):
    rows = [(i, t, None) for i, t in enumerate(texts())]
    got = {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) for r in quality.measure(docs(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}


def test_policies_and_ablations_come_from_the_bits(spark):
    ledger = quality.ledger(docs(spark, [(i, t, None) for i, t in enumerate(texts())]))
    rows = ledger.collect()
    for r in rows:
        want = sum(quality.BITS[x.name] for x in quality.RULES if eval(x.fails, {}, {m: r[m] for m in quality.MEASURES}))
        assert r["fail_bits"] == want
    kept = {r["doc_id"] for r in quality.decide(ledger).where("kept").collect()}
    assert kept == {r["doc_id"] for r in rows if not r["fail_bits"] & quality.POLICIES["v1"]}
    for r in quality.ablations(ledger).collect():
        bits = [x["fail_bits"] for x in rows]
        assert r["n_failed"] == sum(bool(b & r["bit"]) for b in bits)
        assert r["n_failed_alone"] == sum(b == r["bit"] for b in bits)
        assert r["n_kept_without"] == sum(not b & ~r["bit"] for b in bits)


def test_filters_stay_above_the_measurements(spark):
    plan = quality.decide(quality.ledger(docs(spark, [(1, "a b", None)]))).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert plan.count("split(") < 12


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_empty_tables_and_clashing_columns(spark, rows):
    frame = docs(spark, rows).withColumns({"n_words": F.lit("mine"), "fail_bits": F.lit("x"), "extra": F.lit(1)})
    got = quality.decide(quality.ledger(frame))
    assert got.count() == len(rows)
    assert dict(got.dtypes)["n_words"] == "bigint" and "extra" in got.columns and len(set(got.columns)) == len(got.columns)


def test_names_of_the_steps_may_clash(spark):
    table = docs(spark, [(1, "a b c", None)]).withColumns({c: F.lit(c) for c in ("_qm_words", "_qm_n", "_qm_text", "_kept", "fail_bits", "n_words")})
    row = quality.ledger(table).first()
    assert row["n_words"] == 3 and all(row[c] == c for c in ("_qm_words", "_qm_n", "_qm_text", "_kept"))

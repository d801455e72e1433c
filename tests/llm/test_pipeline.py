import hashlib
import importlib
import itertools
import math
import random
import re
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.common import docs, prose
from tests.llm.test_mixing import brute_targets


def test_stages_on_planted_documents(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(3)
    item = prose(rng, 30, 5000)
    clean = [(i, prose(rng, 200, 5000), f"s{i % 3}") for i in range(40)]
    copies = [(100, clean[0][1], "s0"), (101, clean[1][1] + " one more end", "s1")]
    leaked = (102, prose(rng, 100, 5000) + " " + item, "s2")
    junk = [(103, "short", "s0"), (104, "a b c " * 100, "s1"), (105, None, None), (106, "&&& ### " * 60, "s2")]
    table = docs(spark, [*clean, *copies, leaked, *junk, clean[5]])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [{r[0] for r in clean} | {100, 101, 102}, {r[0] for r in clean} | {102}, {r[0] for r in clean}]
    for (name, stage), ids in zip(pipeline.STAGES[:3], want, strict=False):
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == table.columns, name
        assert {r["doc_id"] for r in rows.select("doc_id").collect()} == ids, name
    assert rows.count() == 40  # the row that stood twice stands once
    mixed = pipeline.source_mix(spark, rows, str(tmp_path))
    assert mixed.columns == table.columns
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == mixed.count() and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)


def test_empty_documents(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_are_decided_by_row(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(5)
    x, y, z, u, v, w = (prose(rng, 200, 5000) for _ in range(6))
    near = lambda t: t + " one more end"
    rows = [
        (1, x, "a"), (5, x, "a"), (5, y, "a"),  # a copy does not take another text of its id along
        (None, x, "a"), (None, z, "a"),  # nor all rows without an id
        (7, u, "a"), (7, near(u), "a"),  # near copies with one id
        (None, v, "a"), (None, near(v), "a"),  # and without one
        (9, w, "a"), (9, w, "b"), (8, near(w), "a"),
        (10, " ", "a"), (10, " ", "a"), (11, " ", "a"), (10, "", "a"), (None, None, "a"), (None, None, "a"),
    ]
    table = docs(spark, rows)
    got = pipeline.near_duplicates(spark, table, str(tmp_path))
    assert got.columns == table.columns
    name = {x: "x", y: "y", z: "z", u: "u", near(u): "u", v: "v", near(v): "v", near(w): "w near"}
    out = sorted(((r["doc_id"], name.get(r["text"], r["text"])) for r in got.collect()), key=str)
    assert out == sorted([(1, "x"), (5, "y"), (None, "z"), (7, "u"), (None, "v"), (8, "w near"), (10, " "), (11, " "), (10, ""), (None, None)], key=str)


def brute_quality(t):
    """Whether every rule of the newest policy is passed."""
    text = t or ""
    words = [w for w in re.split(r"[\t-\r ]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\t-\r ]", x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = len({i + j for at in places.values() if len(at) > 1 for i in at for j in range(3)})
    n, chars, symbols = len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>")
    failed = (n < 50, 100 * repeated > 50 * n, 10 * symbols > n, 20 * (len(lines) - len(set(lines))) > 7 * len(lines), chars < 3 * n, chars > 10 * n, 5 * text.count("!") > n)
    return not any(failed)


def brute_copies(rows):
    """One row of each component of near copies: the smallest doc_id, null last."""

    def grams(t):
        w = [x.decode() for x in t.encode().lower().split()]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    sets, root = [grams(t) for _, t, _ in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    best = {}
    for i, (d, _, _) in enumerate(rows):
        best[top(i)] = min(best.get(top(i), (2, 0, 0)), (d is None, d or 0, i))
    return [rows[i] for _, _, i in best.values()]


def brute_clean(rows, items):
    def words(t):
        return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))

    windows = [tuple(w[i : i + 13]) for w in map(words, items) for i in range(max(1, len(w) - 12))]
    out = []
    for row in rows:
        w = words(row[1])
        hit = {i + j for x in windows for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x for j in range(len(x))}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(row)
    return out


def brute_mix(rows):
    """The copies that the mix takes, by its order and offsets."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    goal, out = brute_targets(sizes), []
    for s in sizes:
        key = "1" if s is None else "0" + s
        offset = int(hashlib.md5(("mix" + key).encode()).hexdigest()[:3], 16) / 4096
        each = goal[s] / sizes[s]
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (len(r[1].split()), r[0] is not None, r[0] or 0))
        for k, r in enumerate(own):
            out += [r] * (math.floor(each * (k + 1) + offset) - math.floor(each * k + offset))
    return out


def test_the_whole_pipeline_agrees_with_brute_force(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(12)
    items = [prose(rng, 40, 5000), prose(rng, 13, 5000), "only four words here"]
    texts = [prose(rng, rng.randrange(60, 240), 5000) + "".join(f" é{k}" for k in range(rng.randrange(3))) for _ in range(60)]
    rows = [(i, t, rng.choice(["a", "a", "b", "c", "d", None])) for i, t in enumerate(texts)]
    # near copies and copies, with and without ids, one id on two texts, rows that stand twice
    rows += [(200 + i, texts[i] + " and one more end", "a") for i in range(6)] + [(None, texts[7], "b"), (None, texts[8] + " x", None), (None, prose(rng, 90, 5000), "b")]
    rows += [(9, prose(rng, 120, 5000), "c"), rows[10], rows[10], (11, texts[12], "d")]
    # benchmark passages: enough of a text, too little of one, and a whole short item
    rows += [(300, prose(rng, 80, 5000) + " " + items[0], "a"), (301, prose(rng, 400, 5000) + " " + items[1], "b"), (302, prose(rng, 60, 5000) + " " + items[1].upper(), "c"), (303, prose(rng, 55, 5000) + " only four words here", "d")]
    rows += [(400, None, "a"), (401, "", None), (402, "too short", "b"), (403, "a b c " * 60, "c"), (404, "what! now! " * 40, "a"), (405, "## %% " * 50, "d")]
    rng.shuffle(rows)
    docs(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = brute_mix(brute_clean(brute_copies([r for r in rows if brute_quality(r[1])]), items))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(d, [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for d, t, _ in kept]
    want = sorted(((d, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for d, x in ids), key=repr)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == want
    assert len(want) > 60 and {r["start"] for r in got} == set(itertools.accumulate([0, *(r["n_tokens"] for r in sorted(got, key=lambda r: r["start"]))][:-1]))

import random

import pytest

from quillmere.llm import jaccard_join as J
from quillmere.llm import shingles
from tests.llm.common import docs, prose


def brute(rows, k, threshold):
    def grams(t):
        w = [x.decode("utf-8") for x in (t or "").encode().lower().split()]
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= threshold * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def family(rng, size, n, edits):
    base = prose(rng, n).split()
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "a b", "a b c d", "A b c D", "a b c d e", "É x y z", "é x y z"]
    for size, n, edits in ((60, 140, 5), (40, 60, 3), (25, 30, 2), (12, 400, 12), (30, 25, 2)):
        texts += family(rng, size, n, edits)
    passage = prose(rng, 100)
    texts += [f"{passage} {prose(rng, rng.randrange(5, 60))}" for _ in range(40)] + [prose(rng, rng.randrange(1, 120)) for _ in range(60)] + [texts[20]] * 15
    rng.shuffle(texts)
    return [(i, t, None) for i, t in enumerate(texts)] + [(3, texts[3], None), (3, "else where it stands", None), (None, None, None)]


@pytest.mark.parametrize("k,threshold,small", [(4, 85, False), (4, 85, True), (5, 80, True)])
def test_components_agree_with_brute_force(spark, monkeypatch, k, threshold, small):
    if small:  # so that each way of the operator is taken
        for name, value in (("LONG", 4), ("BLOCK", 8), ("BLOCK_SHINGLES", 500), ("PART", 10), ("LEAST_FREQUENT", 2), ("BROADCAST_ROWS", 0), ("HELD_ROWS", 3)):
            monkeypatch.setattr(J, name, value)
    rows = corpus(17)
    got = J.classes(docs(spark, rows), k=k, threshold=threshold).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k, threshold)


@pytest.mark.parametrize("held", [1, 2, 3])
def test_a_list_read_in_pieces_keeps_its_last_member(spark, monkeypatch, held):
    # seven sets in one list that is in one part; the pieces end at each place
    for name, value in (("HELD_ROWS", held), ("LONG", 2), ("LEAST_FREQUENT", 10**6)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(held)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 40 + 3 * i], *(f"x{rng.randrange(10**6)}" for _ in range(2))]), None) for i in range(7)]
    got = J.classes(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4, 85)


def test_empty_table(spark):
    assert J.classes(docs(spark, [])).collect() == []


def test_prefixes_share_what_they_must():
    rng = random.Random(2)
    for _ in range(3000):
        a = set(rng.sample(range(60), rng.randrange(1, 50)))
        b = {x if rng.random() < 0.95 else 100 + x for x in a}
        if 100 * len(a & b) < 85 * len(a | b):
            continue
        for l_of in (J.shared_least, lambda n: 2):
            cut = lambda s: set(sorted(s)[: len(s) - J.least_overlap(len(s), 85) + l_of(len(s))])
            assert len(cut(a) & cut(b)) >= min(l_of(len(a)), l_of(len(b)), len(a & b))


def test_hashing_many_texts_equals_one_by_one():
    texts = [b"", b" ", b"a", b"A b", "é Ü x y z".encode(), b"a b c d e", b"x" * 5000 + b" y"]
    together = list(shingles.sets(texts, 4))
    assert all((x == next(iter(shingles.sets([t], 4)))).all() for x, t in zip(together, texts, strict=True))
    assert len(together[5]) == 2 and len(together[3]) == 1 and len(together[0]) == 0


def test_boundary_is_the_cheapest():
    sizes = {10: 1000, 40: 500, 200: 100}
    assert J.boundary({}, 1.0, 85) == 0
    assert J.boundary(sizes, 0.0, 85) <= J.boundary(sizes, 50.0, 85) <= 200

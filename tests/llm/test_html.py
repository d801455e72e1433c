import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now, cheap.</div>
<article><h1>Title &amp; more</h1><p><b>First  bold\n text that goes on, and on.<br><p>Second &eacute; text, with <a href="x">a link</a> inside of it.</p></article>
<footer>&copy; x.com &middot; Some words.</footer></body></html>"""


def test_a_page():
    assert H.main_text(PAGE, H.trained()) == "Title & more\nFirst bold text that goes on, and on.\nSecond é text, with a link inside of it."


def test_held_out_accuracy():
    rng, right, kept, said_all, hits = np.random.default_rng(99), 0, 0, 0, 0
    for _ in range(300):
        page, said = H.labelled_page(rng)
        found = H.blocks(page)
        want = H.labels_of(found, said)
        assert sum(want) == len(said)
        got = H.trained().decode(H.features(found))
        right += got == want
        kept, said_all, hits = kept + sum(got), said_all + len(said), hits + sum(a & b for a, b in zip(got, want, strict=True))
    assert right / 300 > 0.93 and hits / kept > 0.98 and hits / said_all > 0.99


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    for _ in range(50):
        f = H.Field(rng.standard_normal(6), rng.standard_normal(2), rng.standard_normal((2, 2)))
        rows = [rng.choice(6, rng.integers(0, 4), replace=False).tolist() for _ in range(rng.integers(1, 8))]
        score = lambda y: f.start[y[0]] + sum(f.weights[r].sum() for r, l in zip(rows, y, strict=True) if l) + sum(f.step[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        best = max(([n >> k & 1 for k in range(len(rows))] for n in range(1 << len(rows))), key=score)
        assert score(f.decode(rows)) == pytest.approx(score(best))


@pytest.mark.parametrize("page", ["", "<", "<a", "<p title='x>y'>q", "<!-- x", "<script>x", "<p>a<style>b", "< b", "&amp", "<p", "</p></p>", "<a " * 50_000, "<p>" * 50_000, "\"<a '" * 50_000, "<div>" * 20_000, "<script>" * 30_000, "<!--" * 50_000, "</x>" * 50_000])
def test_broken_pages_end(page):
    start = time.process_time()
    H.main_text(page, H.trained())
    assert time.process_time() - start < 10


def test_frames(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "", "")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x")))
    out = sorted((r["page_id"] or 0, r["text"][:5], r["n_chars"]) for r in got.collect())
    n = len(H.main_text(PAGE, H.trained()))
    assert out == [(0, "", 0), (1, "Title", n), (1, "Title", n), (2, "", 0)]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


LONG = [f"Paragraph {w} goes on for some words, and on, and ends here." for w in ("one", "two", "three")]


@pytest.mark.parametrize("between", ['<svg class="i"/>', '<svg class="i"><path d="m"/>', '<svg><g><path d="m"></g></svg>', "<math/>", "<canvas>", "<object data='x'>", "<iframe src='x'>", "<button></button>", "<select></select>", "<button>", "<select>"])
def test_nothing_after_an_element_is_lost(between):
    page = f"<body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>A title of it</h1><p>{LONG[0]}</p>{between}<p>{LONG[1]}</p><p>{LONG[2]}</p></article><footer>&copy; x.com</footer></body>"
    texts = [b.text for b in H.blocks(page)]
    assert [t for t in texts if t in LONG] == LONG and texts[-1] == "© x.com"
    last = H.blocks(page)[-1]
    assert last.path == {"body", "footer"}
    if between not in ("<button>", "<select>", "<canvas>", "<iframe src='x'>"):  # what follows those is inside of them
        assert H.main_text(page, H.trained()).split("\n")[-3:] == LONG


def test_elements_in_a_line():
    found = H.blocks("<p>An <svg><path d='m'/></svg> icon, <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <button>Go</button> text</p><object><p>Instead</p></object>")
    assert [(b.text, "button" in b.path, "object" in b.path) for b in found] == [("An icon, x=1 and", False, False), ("Go", True, False), ("text", False, False), ("Instead", False, True)]


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>One paragraph of text.</p></article>", "One paragraph of text."),
        ("<article><p>Hello there, this is it.</p></article><footer>&copy; x.com All rights</footer>", "Hello there, this is it."),
        (f"<main><p>{'Words that go on. ' * 25}</p></main>", ("Words that go on. " * 25).strip()),
        ("<nav><a href=x>a</a></nav><article><p data-x=don't>A one here.</p><p>B two there.</p><p>it's C</p><p>D four.</p></article>", "A one here.\nB two there.\nit's C\nD four."),
        ("<section>" * 520 + "<aside class=sidebar>junk of the side bar</aside><article><h1>T</h1><p>Real text, that is the main one.</p><p>More of it.</p></article>", "T\nReal text, that is the main one.\nMore of it."),
    ],
)
def test_pages_that_were_lost_once(page, text):
    assert H.main_text(page, H.trained()) == text


def test_deep_pages_take_linear_time():
    import time

    def took(n):
        start = time.time()
        H.blocks("<div><x-y>" * n + "a" + "</div>" * n + "</p></span></li>" * n)
        return time.time() - start

    took(100)
    assert took(40_000) < 12 * took(5_000) + 0.5

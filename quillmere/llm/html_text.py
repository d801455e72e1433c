"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is scanned once into leaf blocks: stretches of text between tags that break the flow, each with its ancestor tags,
the words of their classes and ids, and how much of it stands in links. A field with two labels, text and rest, scores each
block by these and by features of its words, and neighbouring labels by their transition; Viterbi finds the best labelling.

The field is trained here on made-up labelled pages (N_PAGES of them, from a seed; a second or two on the driver) by
gradient ascent of the likelihood, with the forward-backward sums of all pages at a time. Its weights, a few hundred
numbers, go to the tasks; the input's size plays no role in training.

Scripts and styles are skipped, without an end up to the page's. Other elements with content of their own (svg, object, button
and so on) are blocks with that element among their ancestors; unclosed ones end with their parent, and svg and math also at
'/>' or an element of HTML. The text of math belongs to its sentence.

Defined cases: a null or empty page, or one without text, gives an empty text; unclosed tags, quotes and comments end with
the page; very long pages take linear time; repeated rows are each parsed; an empty table gives an empty result; other
columns are kept, clashing ones replaced.
"""

from __future__ import annotations

import functools
import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmere.shared import bound_batches

#: HTML's elements by how they are read.
RAW = ("script", "style")
#: Elements that stand in a line: what they hold is a block of its own, but without text they do not break the flow.
WIDGETS = frozenset("svg object canvas iframe select button textarea noscript template".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements of HTML that end svg and math.
BREAKS_OUT = frozenset("article aside blockquote body center dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table tbody td th tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the same group closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body div section article main aside nav form header footer blockquote".split())

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: The end of a tag, or an attribute's value with its opening quote; a value without quotes may hold quotes.
_VALUE_OR_END = re.compile(r">|=\s*(?:[\"']|[^\s>\"'][^\s>]*)")
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}[^>]*>", re.I) for t in RAW}


@dataclass
class Block:
    tag: str
    path: frozenset[str]
    marks: frozenset[str]
    text: str
    linked: int = 0


_ROOT: tuple[str, frozenset[str], frozenset[str], bool] = ("", frozenset(), frozenset(), False)


@dataclass
class _Page:
    """Open elements and the block that is being read."""

    #: Of each open element: its tag, the tags and the hints from the root to it, and whether it stands in svg or math.
    stack: list[tuple[str, frozenset[str], frozenset[str], bool]] = field(default_factory=list)
    count: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    in_link: bool = False
    blocks: list[Block] = field(default_factory=list)
    #: Places of open widgets in the stack: those with text, and after them those without any so far.
    told: list[int] = field(default_factory=list)
    silent: list[int] = field(default_factory=list)

    def flush(self) -> None:
        if not self.parts:
            return
        stack = self.stack[: self.silent[0]] if self.silent else self.stack
        text = " ".join(self.decode(self.parts).split())
        if text:
            tag, path, marks, _ = stack[-1] if stack else _ROOT
            linked = len(" ".join(self.decode(self.link_parts).split())) if self.link_parts else 0
            self.blocks.append(Block(tag, path, marks, text, linked))
        self.parts, self.link_parts = [], []

    @staticmethod
    def decode(parts: list[str]) -> str:
        text = "".join(parts)
        return htmllib.unescape(text) if "&" in text else text

    def add(self, text: str) -> None:
        if text:
            if self.silent and not text.isspace():
                self.flush()
                self.told, self.silent = self.told + self.silent, []
            self.parts.append(text)
            if self.in_link:
                self.link_parts.append(text)

    def close(self, tags: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        """Closes the innermost of these elements, unless an element of `within` stands above it."""
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                if self.told and self.told[-1] >= i:
                    self.flush()
                self.told, self.silent = ([k for k in x if k < i] if x else x for x in (self.told, self.silent))
                for tag, *_ in self.stack[i:]:
                    self.count[tag] -= 1
                del self.stack[i:]
                return
            if self.stack[i][0] in within:
                return

    def open(self, tag: str, marks: frozenset[str]) -> None:
        if tag in WIDGETS:
            self.silent.append(len(self.stack))
        _, path, above, foreign = self.stack[-1] if self.stack else _ROOT
        # elements share the sets of their parents where they add nothing, so deep pages take linear time
        self.stack.append((tag, path if tag in path else path | {tag}, above if marks <= above else above | marks, tag in FOREIGN or (foreign and tag != "foreignobject")))
        self.count[tag] = self.count.get(tag, 0) + 1

    def foreign(self) -> bool:
        """Whether the innermost of svg, math and foreignobject is one of the first two."""
        return bool(self.stack) and self.stack[-1][3]


#: Words of classes and ids by what they hint at.
HINTS = {
    "advert": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager",
    "side": "sidebar side aside rail widget widgets",
    "foot": "footer foot colophon copyright legal",
    "head": "header masthead topbar top logo branding",
    "notice": "cookie cookies consent notice notices notification alert popup modal overlay gdpr disclaimer",
    "comment": "comment comments commentlist reply replies respond discussion disqus reviews",
    "share": "share sharing social follow",
    "more": "related recommended more trending popular teaser tags",
    "form": "form login signup subscribe subscription newsletter search searchbox",
    "text": "article articlebody article-body post entry content story text main body prose",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}


@functools.lru_cache(maxsize=4096)
def _hints(attributes: str) -> frozenset[str]:
    words = [w for m in _MARKS.finditer(attributes) for w in re.split(r"[\s_-]+", next((g for g in m.groups() if g), "").lower())]
    return frozenset(_HINT[w] for w in words if w in _HINT)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in their order."""
    p, at, n = _Page(), 0, len(page)
    last_end = page.rfind(">")
    unclosed: set[str] = set()
    drawn = False  # whether svg or math was met
    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last_end:
            p.add(page[at:])
            break
        p.add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            at = page.find(">", start) + 1
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            p.add("<")
            at = start + 1
            continue
        end = m.end()
        while (q := _VALUE_OR_END.search(page, end)) and q[0] != ">":
            quote = q[0][-1]
            if quote not in "\"'" or q[0][:-1].strip() != "=":  # a value without quotes
                end = q.end()
                continue
            close = -1 if quote in unclosed else page.find(quote, q.end())
            if close < 0:  # a quote that stands alone is no quote
                unclosed.add(quote)
                end = q.end()
            else:
                end = close + 1
        end = q.start() if q else page.find(">", start)
        name = m[0].lower()
        at = end + 1
        if name[0] == "/":
            name = name[1:]
            if name == "a":
                p.in_link = False
            if name in WIDGETS or name == "math":
                p.close((name,))
            elif name not in INLINE and (name in BREAKS_OUT or name == "foreignobject" or not (drawn and p.foreign())):
                p.flush()
                if name == "p":
                    p.close(("p",), SCOPES)
                else:
                    p.close((name,))
            continue
        if drawn and name not in FOREIGN and p.foreign():
            if name in BREAKS_OUT:
                p.flush()
                p.close(("svg", "math"))
            elif name not in _RAW_END or page[end - 1] == "/":  # parts of a drawing or a formula
                if name == "foreignobject" and page[end - 1] != "/":
                    p.open(name, frozenset())
                continue
        if name in _RAW_END:
            p.add(" ")
            closing = _RAW_END[name].search(page, at)
            at = closing.end() if closing else n
            continue
        if name in WIDGETS or name == "math":
            if name not in ("button", "select", "textarea", "math"):
                p.add(" ")
            if name not in FOREIGN or page[end - 1] != "/":
                drawn = drawn or name in FOREIGN
                p.open(name, _hints(page[m.end() : end]))
            continue
        if name in ("param", "source", "track"):
            continue
        if name in INLINE:
            if name == "a":
                p.in_link = True
            elif name in ("br", "img", "input"):
                p.add(" ")
            continue
        p.flush()
        if name in VOID:
            continue
        p.close(("p",), SCOPES)
        if name in CLOSES:
            p.close(CLOSES[name], SCOPES - {"tr", "table"} if name in ("td", "th", "tr") else SCOPES)
        if name not in ("html", "head", "body") or not p.stack:
            p.open(name, _hints(page[m.end() : end]))
    p.flush()
    return p.blocks


# --- features -------------------------------------------------------------------------------------------------------

_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "ul", "ol", "table", "blockquote", "figure", "dl", "head", "fieldset", "title", *sorted(WIDGETS))
_OWN = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "div", "pre", "dt", "dd", "body", "section", "article", "blockquote", "figcaption", "footer", "address")
_NAMES = (
    *(f"in:{t}" for t in _TAGS), *(f"own:{t}" for t in _OWN), *(f"hint:{h}" for h in HINTS), "in:article+header", "in:article+aside", "in:article+nav", "in:article+form", "in:article+footer", "hints:against", "hints:none",
    "chars<20", "chars<60", "chars<200", "chars>=200", "links:0", "links<.3", "links<.7", "links>=.7", "sentence", "commas", "rights", "asks", "first", "last", "early", "late", "bias",
)
_INDEX = {n: i for i, n in enumerate(_NAMES)}
_RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved|privacy|impressum", re.I)
_ASKS = re.compile(r"cookie|subscribe|sign up|newsletter|log ?in|advert|sponsored|leave a (?:reply|comment)|accept all", re.I)
_AGAINST = frozenset(HINTS) - {"text", "head"}


@functools.lru_cache(maxsize=65536)
def _placed(tag: str, path: frozenset[str], marks: frozenset[str]) -> tuple[int, ...]:
    out = [_INDEX[f"in:{t}"] for t in _TAGS if t in path]
    if tag in _OWN:
        out.append(_INDEX[f"own:{tag}"])
    out += [_INDEX[f"hint:{m}"] for m in marks]
    if "article" in path:
        out += [_INDEX[f"in:article+{t}"] for t in ("header", "aside", "nav", "form", "footer") if t in path]
    out.append(_INDEX["hints:against" if marks & _AGAINST else "hints:none"] if marks & _AGAINST or not marks else _INDEX["hint:text"])
    return (*out, _INDEX["bias"])


def features(found: list[Block]) -> list[list[int]]:
    """Indices of the features of each block."""
    out, n = [], len(found)
    for i, b in enumerate(found):
        chars = len(b.text)
        f = list(_placed(b.tag, b.path, b.marks))
        f.append(_INDEX["chars<20" if chars < 20 else "chars<60" if chars < 60 else "chars<200" if chars < 200 else "chars>=200"])
        share = b.linked / chars
        f.append(_INDEX["links:0" if not b.linked else "links<.3" if share < 0.3 else "links<.7" if share < 0.7 else "links>=.7"])
        if b.text[-1] in ".!?…”\"":
            f.append(_INDEX["sentence"])
        if "," in b.text:
            f.append(_INDEX["commas"])
        if chars < 300:
            if _RIGHTS.search(b.text):
                f.append(_INDEX["rights"])
            if _ASKS.search(b.text):
                f.append(_INDEX["asks"])
        if not i:
            f.append(_INDEX["first"])
        if i == n - 1:
            f.append(_INDEX["last"])
        if 5 * i < n:
            f.append(_INDEX["early"])
        if 5 * i >= 4 * n:
            f.append(_INDEX["late"])
        out.append(f)
    return out


# --- the field ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """weights: of each feature for label 1 against 0; start and step: scores of first labels and of neighbours."""

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The best labels, by Viterbi."""
        if not rows:
            return []
        w = self.weights.tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.start.tolist()
        b += sum(w[i] for i in rows[0])
        back = []
        for f in rows[1:]:
            e = sum([w[i] for i in f])
            from_a = a + s00 >= b + s10
            from_b = a + s01 >= b + s11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + s00 if from_a else b + s10), (a + s01 if from_b else b + s11) + e
        label = int(b > a)
        out = [label]
        for k in reversed(back):
            label = k[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[list[list[int]]], labels: list[list[int]], epochs: int = 250, decay: float = 0.01) -> Field:
    """Gradient ascent of the penalised likelihood, all pages at a time (padded to the longest)."""
    n, t, k = len(pages), max(map(len, pages)), len(_NAMES)
    x = np.zeros((n, t, k), np.float32)
    y, on = np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (rows, own) in enumerate(zip(pages, labels, strict=True)):
        for j, f in enumerate(rows):
            x[i, j, f] = 1
        y[i, : len(own)], on[i, : len(own)] = own, True
    pairs = on[:, 1:] & on[:, :-1]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    w, start, step = np.zeros(k), np.zeros(2), np.zeros((2, 2))
    mean = [np.zeros_like(v) for v in (w, start, step)]
    size = [np.zeros_like(v) for v in (w, start, step)]
    for epoch in range(1, epochs + 1):
        score = np.zeros((n, t, 2))
        score[:, :, 1] = np.where(on, x @ w.astype(np.float32), 0)
        ahead, behind = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        ahead[:, 0] = start + score[:, 0]
        for j in range(1, t):
            new = np.logaddexp.reduce(ahead[:, j - 1, :, None] + step[None], axis=1) + score[:, j]
            ahead[:, j] = np.where(on[:, j, None], new, ahead[:, j - 1])
        for j in range(t - 2, -1, -1):
            new = np.logaddexp.reduce(step[None] + (score[:, j + 1] + behind[:, j + 1])[:, None, :], axis=2)
            behind[:, j] = np.where(on[:, j + 1, None], new, 0)
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + behind - whole[:, None, None]) * on[:, :, None]
        both = np.exp(ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - whole[:, None, None, None]) * pairs[:, :, None, None]
        first = np.array([(y[:, 0] == a).sum() for a in (0, 1)], float)
        grads = [np.einsum("ntk,nt->k", x, ((y == 1) & on) - p[:, :, 1]) / n - decay * w / 10, (first - p[:, 0].sum(axis=0)) / n - decay * start / 10, (seen - both.sum(axis=(0, 1))) / n - decay * step / 10]
        for v, g, m, s in zip((w, start, step), grads, mean, size, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.2 * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.99**epoch)) + 1e-8)
    return Field(w, start, step)


# --- labelled pages -------------------------------------------------------------------------------------------------

N_PAGES = 600


def labelled_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A made-up page and its main text, block by block."""
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda q: rng.random() < q
    word = lambda: "".join(pick(*"bcdfglmnprstvw") + pick("a", "e", "i", "o", "u", "é", "ü") for _ in range(rng.integers(1, 5)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    sentence = lambda: (words(4, 14) + pick(", ", " ") + words(2, 10)).capitalize() + pick(".", ".", "!", "?")
    short = lambda: words(1, 6).capitalize() + pick("", "", ".")
    said: list[str] = []

    def main(text: str) -> str:
        said.append(" ".join(text.split()))
        return text

    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(rng.integers(a, b)))

    def junk() -> str:
        kind = rng.integers(11)
        hint = lambda *x: f' {pick("class", "id")}="{pick("", word() + " ")}{pick(*x)}"'
        text = pick(short, sentence, lambda: sentence() + " " + sentence())
        if kind < 2:
            return f"<div{hint('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo-box', 'ad-slot')}>{text()}</div>"
        if kind == 2:
            return f"<aside{pick('', hint('sidebar', 'widget'))}>{pick('', f'<h3>{short()}</h3>')}<p>{text()}</p>{pick('', f'<ul>{links(2, 6)}</ul>')}</aside>"
        if kind == 3:
            return f"<div{hint('cookie-notice', 'consent', 'notice', 'popup', 'alert')}><p>{pick('We use cookies. ', '', '')}{text()}</p></div>"
        if kind == 4:
            return f"<form action='/s'><p>{pick('Subscribe to our newsletter. ', 'Log in. ', '')}{text()}</p><label>{short()}</label><input name='q'></form>"
        if kind == 5:
            return f"<section{hint('comments', 'comment-list', 'replies', 'discussion')}><h2>{pick('Comments', short())}</h2>{''.join(f'<div{hint('comment', 'reply')}><p>{text()}</p></div>' for _ in range(rng.integers(1, 5)))}</section>"
        if kind == 6:
            return f"<div{hint('share', 'social', 'follow')}><a href='#'>{word()}</a> <a href='#'>{word()}</a></div>"
        if kind == 7:
            return f"<div{hint('related', 'recommended', 'more', 'trending')}><h3>{short()}</h3><ul>{links(2, 6)}</ul></div>"
        if kind == 10:
            return pick(f"<button>{words(1, 4)}</button>", f"<select><option>{word()}<option>{words(1, 3)}</select>", f"<svg><title>{words(1, 3)}</title><path d='m'/></svg>", f"<noscript>{sentence()}</noscript>", f"<textarea>{short()}</textarea>", f"<iframe src='/x'>{short()}</iframe>", f"<canvas>{short()}</canvas>", f"<template><p>{text()}</p></template>")
        if kind == 8:
            return f"<div{hint('sidebar', 'side', 'widget')}><p>{text()}</p></div>"
        return f"<nav{pick('', hint('breadcrumb', 'toc'))}><ul>{links(2, 5)}</ul></nav>"

    def paragraph() -> str:
        body = " ".join(sentence() for _ in range(rng.integers(1, 7))) if chance(0.85) else short()
        kind = rng.integers(12)
        if kind == 0:
            return f"<blockquote>{main(body)}</blockquote>"
        if kind == 1:
            listed = "".join(f"<li>{main(short())}</li>" for _ in range(rng.integers(2, 5)))
            return pick(f"<ul>{listed}</ul>", f"<ol>{listed}</ol>")
        if kind == 2:
            return f"<h{(level := rng.integers(2, 5))}>{main(short())}</h{level}>"
        if kind == 3:
            return f"<p><b>{main(body)}<br>"
        if kind == 4:
            link, rest = word(), words(3, 8)
            said.append(f"{link} {rest}")
            return f'<p><a href="/x">{link}</a> {rest}</p>'
        if kind == 6 and chance(0.5):
            return f"<object data='x'><p>{main(body)}</p></object>"
        if kind == 5 and chance(0.4):
            return f"<table><tr><td>{main(short())}</td><td>{main(short())}</td></tr></table>"
        return f"<p>{main(body)}</p>"

    shell = pick('<article>|</article>', '<article class="post">|</article>', '<main>|</main>', '<main><article>|</article></main>', '<div class="content">|</div>', '<div id="article-body">|</div>', '<div class="entry"><section>|</section></div>', "<article><div>|</div></article>", "<div>|</div>", "|").split("|")
    out = ["<!DOCTYPE html><html><head><title>t</title></head><body>"]
    if chance(0.15):  # next to nothing but a paragraph or two, in an element that says what they are
        shell = pick('<article>|</article>', '<article class="post">|</article>', '<main>|</main>', '<div class="content">|</div>', '<div id="article-body">|</div>').split("|")
        out = [pick("", out[0]), shell[0], *(f"<p>{main(' '.join(sentence() for _ in range(rng.integers(1, 5))) if chance(0.8) else short())}</p>" for _ in range(pick(1, 1, 2))), shell[1]]
        if chance(0.5):
            out.append(f"<footer>{pick('&copy; ', 'Copyright ', '')}{word()}.com {short()}</footer>")
        return "".join(out), said
    if chance(0.5):
        out.append(f"<header{pick('', ' class=masthead')}>{pick(f'<h1>{short()}</h1>', f'<div class=logo>{short()}</div>', f'<p>{short()}</p>')}</header>")
    if chance(0.8):
        out.append(f"<nav><ul>{links(2, 8)}</ul></nav>" if chance(0.6) else f'<div class="{pick("menu", "navbar", "top-nav")}"><ul>{links(2, 8)}</ul></div>')
    out += [junk() for _ in range(rng.integers(0, 3))]
    out.append(shell[0])
    if chance(0.85):
        title = f"<h1>{main(pick(short, sentence)())}</h1>"
        out.append(f"<header>{title}</header>" if chance(0.15) else title)
    for _ in range(rng.integers(1, 9)):
        out.append(paragraph())
        if chance(0.12):
            out.append(junk())
    out.append(shell[1])
    out += [junk() for _ in range(rng.integers(0, 3))]
    if chance(0.85):
        out.append(f"<footer>{pick('&copy; ', 'Copyright ', '')}{word()}.com &middot; {pick(short, sentence)()}</footer>" if chance(0.8) else f'<div class="footer"><p>{sentence()}</p><p>All rights reserved</p></div>')
    return "".join(out) + pick("</body></html>", ""), said


def labels_of(found: list[Block], said: list[str]) -> list[int]:
    """1 for the blocks that are the main text's, which stand in the same order."""
    out, k = [], 0
    for b in found:
        hit = k < len(said) and b.text == said[k]
        out.append(int(hit))
        k += hit
    return out


@functools.cache
def trained() -> Field:
    rng = np.random.default_rng(11)
    pages, labels = [], []
    for _ in range(N_PAGES):
        page, said = labelled_page(rng)
        found = blocks(page)
        pages.append(features(found))
        labels.append(labels_of(found, said))
    return fit(pages, labels)


def main_text(page: str, model: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, model.decode(features(found)), strict=True) if keep)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """df without the page, with text and n_chars (long)."""
    names = [c for c in df.columns if c not in ("text", "n_chars", html)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names), "text string, n_chars long"])
    model = trained()
    bound_batches(df.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [main_text(h or "", model) for h in batch.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    return df.select(*names, html).mapInArrow(parse, schema)

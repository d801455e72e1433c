"""Bound trees to columns.

Every node becomes four columns: whether a row matches (never null), its lexical score, its vector score and whether a
vector clause of it is active. A whole query is then one filter and one projection over the table. A leaf is spelled
"present AND test", never coalesce(), so that filters still reach the Parquet scan.

A fifth column is a condition that every match fulfils and that needs no analysis of texts: comparisons as they are, and for
words that the text holds them at all. A scan applies it first and analyses only what passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import dates, regexes, text, vectors
from quillmere.plans import binder as b


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Stats:
    """Of a text field over the whole table: rows with tokens, tokens in all, rows that hold each term."""

    rows: int
    tokens: int
    holding: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Views:
    """Where the analysed forms of text fields come from: expressions over the text, or stored columns."""

    stored: frozenset[str] = frozenset()

    def norm(self, name: str) -> Column:
        return quoted(f"_norm_{name}") if name in self.stored else text.normalized(quoted(name))

    def spell(self, name: str) -> Column:
        return quoted(f"_spell_{name}") if name in self.stored else text.spelled(text.normalized(quoted(name)))

    def length(self, name: str) -> Column:
        return quoted(f"_length_{name}") if name in self.stored else text.n_tokens(self.spell(name))


@dataclass(frozen=True)
class Compiled:
    match: Column
    lexical: Column | None = None
    vector: Column | None = None
    active: Column | None = None
    pre: Column | None = None  # None: nothing can be said without analysis
    exact: bool = False  # pre is match


def _exactly(match: Column, *scores: Column | None) -> Compiled:
    return Compiled(match, *scores, *[None] * (3 - len(scores)), match, True)


def _sum(parts: list[tuple[Column, Column]]) -> Column | None:
    """Scores of those that match."""
    terms = [F.when(match, score).otherwise(F.lit(0.0)) for match, score in parts]
    return reduce(lambda x, y: x + y, terms) if terms else None


@dataclass
class Compiler:
    schema: b.Schema
    views: Views
    stats: dict[str, Stats]
    k1: float = 1.2
    b: float = 0.75

    def node(self, n: b.Bound) -> Compiled:
        if isinstance(n, b.Leaf):
            return self.leaf(n)
        kids = [self.node(k) for k in n.kids]
        if n.kind == "not":
            return _exactly(~kids[0].match) if kids[0].exact else Compiled(~kids[0].match)
        pres = [k.pre for k in kids if k.pre is not None]
        pre = reduce(and_, pres) if n.kind == "and" and pres else reduce(or_, pres) if n.kind == "or" and len(pres) == len(kids) else None
        match = reduce(and_ if n.kind == "and" else or_, (k.match for k in kids))
        active = [k for k in kids if k.active is not None]
        return Compiled(
            match,
            _sum([(k.match, k.lexical) for k in kids if k.lexical is not None]),
            _sum([(k.match, k.vector) for k in active if k.vector is not None]),
            match & reduce(or_, (k.match & k.active for k in active)) if active else None,  # type: ignore[operator]
            pre,
            all(k.exact for k in kids),
        )

    def leaf(self, n: b.Leaf) -> Compiled:
        if n.field is None:
            if isinstance(n.test, b.Exists):
                return _exactly(F.lit(True))
            return self.some([self.test(f, n.op, n.test, n.boost) for f in self.schema.searchable])
        return self.test(n.field, n.op, n.test, n.boost)

    @staticmethod
    def some(parts: list[Compiled]) -> Compiled:
        """At least one of the parts."""
        if not parts:
            return _exactly(F.lit(False))
        pre = reduce(or_, (p.pre for p in parts)) if all(p.pre is not None for p in parts) else None
        return Compiled(reduce(or_, (p.match for p in parts)), _sum([(p.match, p.lexical) for p in parts if p.lexical is not None]), pre=pre, exact=all(p.exact for p in parts))

    def test(self, f: b.Field, op: str, t: b.Test, boost: float) -> Compiled:
        if isinstance(t, b.Any):
            return self.some([self.test(f, op, x, boost) for x in t.items])
        if f.type == "NULL":
            return _exactly(F.lit(False))
        cell = quoted(f.name)
        present = cell.isNotNull()
        flat = F.lit(float(boost))
        match t:
            case b.Exists():
                return _exactly(present)
            case b.Compare(value):
                return _exactly(present & _compare(cell, op, F.lit(value)))
            case b.Between(low, high):
                out = present
                if low is not None:
                    out = out & (cell >= F.lit(low))
                if high is not None:
                    out = out & (cell <= F.lit(high))
                return _exactly(out)
            case b.OnDate(stretch):
                return _exactly(present & dates.compare(cell, op, stretch))
            case b.InDates(low, high):
                return _exactly(present & dates.between(cell, low, high))
            case b.Near(q):
                return _exactly(present, None, vectors.cosine(cell, list(q)) * flat, present)
            case b.Exact(value):
                return _exactly(present & _compare(cell, op, F.lit(value)))
            case b.Substring(value):
                return Compiled(present & F.contains(self.views.norm(f.name), F.lit(value)), flat, pre=present & text.may_hold(cell, [value]))
            case b.Prefix(value):
                return Compiled(present & text.has_prefix(self.views.spell(f.name), value), flat, pre=present & text.may_hold(cell, [value]))
            case b.Fuzzy(value, distance):
                return Compiled(present & text.has_fuzzy(self.views.spell(f.name), value, distance), flat, pre=present)
            case b.Pattern(java):
                return _exactly(present & regexes.matches(cell, java), flat)
            case b.Terms(tokens, phrase):
                spell = self.views.spell(f.name)
                held = text.has_phrase(spell, list(tokens)) if phrase else reduce(and_, (text.has_term(spell, x) for x in dict.fromkeys(tokens)))
                return Compiled(present & held, self.bm25(f.name, tokens) * flat, pre=present & text.may_hold(cell, list(dict.fromkeys(tokens))))
        raise TypeError(t)

    def bm25(self, name: str, tokens: tuple[str, ...]) -> Column:
        """log1p((N - df + .5) / (df + .5)) * tf / (tf + k1 * (1 - b + b * dl / avgdl)), summed over the query's tokens."""
        import math

        s = self.stats[name]
        if not s.rows:
            return F.lit(0.0)
        mean = s.tokens / s.rows
        share = F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * self.views.length(name) / F.lit(mean))
        out = None
        for token in tokens:
            df = s.holding[token]
            weight = math.log1p((s.rows - df + 0.5) / (df + 0.5))
            tf = text.term_frequency(self.views.spell(name), token)
            term = F.lit(weight) * tf / (tf + share)
            out = term if out is None else out + term
        return out  # type: ignore[return-value]


def _compare(cell: Column, op: str, value: Column) -> Column:
    match op:
        case ":" | "=":
            return cell == value
        case "!=":
            return cell != value
        case "<":
            return cell < value
        case "<=":
            return cell <= value
        case ">":
            return cell > value
        case ">=":
            return cell >= value
    raise ValueError(op)


def analysed(root: b.Bound | None, schema: b.Schema) -> dict[str, set[str]]:
    """The text fields whose analysed forms a query's tests need, and which: norm, spell, length."""
    out: dict[str, set[str]] = {}

    def walk(t: b.Test, fields: list[b.Field]) -> None:
        if isinstance(t, b.Any):
            for x in t.items:
                walk(x, fields)
        forms = {b.Substring: {"norm"}, b.Prefix: {"spell"}, b.Fuzzy: {"spell"}, b.Terms: {"spell", "length"}}.get(type(t))
        for f in fields if forms else []:
            if f.type == "TEXT":
                out.setdefault(f.name, set()).update(forms)  # type: ignore[arg-type]

    for leaf in b.leaves(root):
        walk(leaf.test, [leaf.field] if leaf.field else schema.searchable)
    return out


def with_views(frame: DataFrame, wanted: dict[str, set[str]]) -> DataFrame:
    """frame with the analysed forms of these text fields as columns, so that each is made once for a row."""
    base = Views()
    spelled = {f"_spell_{n}": base.spell(n) for n, forms in wanted.items() if "spell" in forms} | {f"_norm_{n}": base.norm(n) for n, forms in wanted.items() if "norm" in forms}
    stored = Views(frozenset(wanted))
    return frame.withColumns(spelled).withColumns({f"_length_{n}": text.n_tokens(stored.spell(n)) for n, forms in wanted.items() if "length" in forms})


def scored_terms(root: b.Bound | None, schema: b.Schema) -> dict[str, set[str]]:
    """The tokens of each text field whose statistics a query needs."""
    out: dict[str, set[str]] = {}

    def walk(t: b.Test, fields: list[b.Field]) -> None:
        if isinstance(t, b.Any):
            for x in t.items:
                walk(x, fields)
        elif isinstance(t, b.Terms):
            for f in fields:
                out.setdefault(f.name, set()).update(t.tokens)

    for leaf in b.leaves(root):
        walk(leaf.test, [leaf.field] if leaf.field else schema.searchable)
    return out

"""Trees of a query against a schema: every name, type, operator and literal is settled here, before anything runs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Union

from quillmere.errors import LimitExceeded, TypeMismatch, Unsupported
from quillmere.functions import dates, regexes, text
from quillmere.functions.vectors import as_floats
from quillmere.plans import ast

MAX_TOKENS, MAX_ITEMS, MAX_SORT, MAX_TEXT = 16, 256, 8, 16384
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # NULL, INT, FLOAT, BOOL, TEXT or VECTOR
    dims: int | None = None


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    def find(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def searchable(self) -> list[Field]:
        """What a value without a field searches."""
        return [f for f in self.fields if f.type == "TEXT" and f.name != "_id"]


# --- bound values ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Exists:
    pass


@dataclass(frozen=True)
class Compare:
    value: int | float | bool


@dataclass(frozen=True)
class Between:
    low: int | float | None
    high: int | float | None


@dataclass(frozen=True)
class OnDate:
    stretch: dates.Stretch


@dataclass(frozen=True)
class InDates:
    low: dates.Stretch | None
    high: dates.Stretch | None


@dataclass(frozen=True)
class Near:
    vector: tuple[float, ...]


@dataclass(frozen=True)
class Exact:
    text: str


@dataclass(frozen=True)
class Terms:
    tokens: tuple[str, ...]
    phrase: bool


@dataclass(frozen=True)
class Prefix:
    text: str


@dataclass(frozen=True)
class Substring:
    text: str


@dataclass(frozen=True)
class Fuzzy:
    text: str
    distance: int


@dataclass(frozen=True)
class Pattern:
    java: str


@dataclass(frozen=True)
class Any:
    items: tuple[Test, ...]


Test = Union[Exists, Compare, Between, OnDate, InDates, Near, Exact, Terms, Prefix, Substring, Fuzzy, Pattern, Any]
SCORED = (Terms, Prefix, Substring, Fuzzy, Pattern)


@dataclass(frozen=True)
class Leaf:
    field: Field | None  # None: the fields that are searched by default
    op: str
    test: Test
    boost: float


@dataclass(frozen=True)
class Branch:
    kind: str  # and, or, not
    kids: tuple[Bound, ...]


Bound = Union[Leaf, Branch]


@dataclass(frozen=True)
class Plan:
    root: Bound | None
    statement: ast.Statement
    lexical: bool
    vector: bool
    sort: tuple[tuple[str, bool], ...]  # field or _score, descending
    limit: int
    offset: int


def scores_text(test: Test) -> bool:
    return any(map(scores_text, test.items)) if isinstance(test, Any) else isinstance(test, SCORED)


def leaves(node: Bound | None) -> list[Leaf]:
    return [] if node is None else [node] if isinstance(node, Leaf) else [x for k in node.kids for x in leaves(k)]


class Binder:
    def __init__(self, schema: Schema, now: int):
        self.schema, self.now = schema, now
        self.lexical = self.vector = False

    # --- values ---

    @staticmethod
    def unsupported(v: ast.Value) -> Unsupported:
        return Unsupported("this value or operator is not supported", *v.span)

    @staticmethod
    def mismatch(v: ast.Value) -> TypeMismatch:
        return TypeMismatch("value or operator does not match the field's type", *v.span)

    def number(self, v: ast.Value, kind: str) -> int | float:
        if isinstance(v, ast.DateTime) and v.precision == "year":  # four digits are read as a year
            return v.year if kind == "INT" else float(v.year)
        if not isinstance(v, ast.Number):
            raise self.mismatch(v)
        if v.suffix:
            raise self.unsupported(v)
        if kind == "INT" and v.integer is None:
            raise self.mismatch(v)
        return v.integer if kind == "INT" else v.value  # type: ignore[return-value]

    @staticmethod
    def raw(v: ast.Value) -> str | None:
        match v:
            case ast.Word(t) | ast.String(t) | ast.Number(t) | ast.DateTime(t):
                return t
        return None

    def test(self, v: ast.Value, kind: str, op: str) -> Test:
        match v:
            case ast.Star():
                if op != ":":
                    raise self.unsupported(v)
                return Exists()
            case ast.AnyOf(items):
                if op not in (":", "="):
                    raise self.unsupported(v)
                if len(items) > MAX_ITEMS:
                    raise LimitExceeded("too many values in a group", *v.span)
                return Any(tuple(self.test(x, kind, op) for x in items))
            case ast.Range(low, high):
                if op not in (":", "="):
                    raise self.unsupported(v)
                ends = [x for x in (low, high) if x is not None]
                if kind == "TEXT" and all(isinstance(x, ast.DateTime) for x in ends):
                    return InDates(*(x and dates.resolve(x, self.now) for x in (low, high)))  # type: ignore[arg-type]
                if kind not in ("INT", "FLOAT"):
                    raise self.mismatch(v)
                return Between(*(None if x is None else self.number(x, kind) for x in (low, high)))
            case ast.Call("exists", ()):
                if op != ":":
                    raise self.unsupported(v)
                return Exists()
        match kind:
            case "INT" | "FLOAT":
                if op == "~":
                    raise self.mismatch(v)
                return Compare(self.number(v, kind))
            case "BOOL":
                word = self.raw(v)
                if op not in (":", "=", "!=") or word not in TRUE + FALSE:
                    raise self.mismatch(v)
                return Compare(word in TRUE)
            case "VECTOR":
                if op != ":" or not isinstance(v, ast.Vector):
                    raise self.unsupported(v)
                return Near(tuple(as_floats(v.values)))
            case "TEXT":
                return self.text(v, op)
        raise self.mismatch(v)

    def text(self, v: ast.Value, op: str) -> Test:
        if isinstance(v, ast.DateTime):
            if op == "~":
                raise self.unsupported(v)
            return OnDate(dates.resolve(v, self.now))
        if op not in (":", "=", "!=", "~"):
            raise self.mismatch(v)
        if isinstance(v, ast.Regex):
            if op != ":":
                raise self.unsupported(v)
            return Pattern(regexes.to_java(v.pattern, v.flags))
        if isinstance(v, ast.Call):
            return self.call(v, op)
        raw = self.raw(v)
        if raw is None:
            raise self.mismatch(v)
        if op in ("=", "!="):
            return Exact(raw)
        if op == "~":
            return self.fuzzy(raw, None, v)
        if isinstance(v, ast.Word):
            stars = [i for i, c in enumerate(raw) if c in "*?"]
            if stars == [len(raw) - 1] and raw[-1] == "*" and len(raw) > 1:
                return self.prefix(raw[:-1], v)
            if stars:
                raise self.unsupported(v)
        return self.terms(raw, isinstance(v, ast.String), v)

    def call(self, v: ast.Call, op: str) -> Test:
        if op != ":" or not v.args:
            raise self.unsupported(v)
        first = v.args[0]
        if v.name == "regex" and len(v.args) == 1:
            if isinstance(first, ast.Regex):
                return self.text(first, op)
            if not isinstance(first, ast.Word | ast.String):
                raise self.mismatch(v)
            return Pattern(regexes.to_java(first.text.encode().decode("latin-1")))
        if v.name not in ("substr", "prefix", "phrase", "fuzzy") or len(v.args) > 1 + (v.name == "fuzzy"):
            raise self.unsupported(v)
        distance = None
        if len(v.args) == 2:
            d = v.args[1]
            if not isinstance(d, ast.Number) or d.integer is None or d.suffix or not 0 <= d.integer <= 64:
                raise self.mismatch(v)
            distance = d.integer
        raw = self.raw(first)
        if raw is None:
            raise self.mismatch(v)
        match v.name:
            case "substr":
                return Substring(self.short(text.normalize(raw), v))
            case "prefix":
                return self.prefix(raw, v)
            case "phrase":
                return self.terms(raw, True, v)
        return self.fuzzy(raw, distance, v)

    def short(self, norm: str, v: ast.Value) -> str:
        if len(norm.encode()) > MAX_TEXT:
            raise LimitExceeded("query text limit exceeded", *v.span)
        return norm

    def terms(self, raw: str, phrase: bool, v: ast.Value) -> Terms:
        found = text.tokenize(self.short(raw, v))
        if not 1 <= len(found) <= MAX_TOKENS:
            raise LimitExceeded("a text value needs 1 to 16 tokens", *v.span)
        return Terms(tuple(found), phrase)

    def prefix(self, raw: str, v: ast.Value) -> Prefix:
        norm = self.short(text.normalize(raw), v)
        if not norm:
            raise self.mismatch(v)
        return Prefix(norm)

    def fuzzy(self, raw: str, distance: int | None, v: ast.Value) -> Fuzzy:
        norm = self.short(text.normalize(raw), v)
        if not norm:
            raise self.mismatch(v)
        return Fuzzy(norm, distance if distance is not None else 0 if len(norm) <= 2 else 1 if len(norm) <= 5 else 2)

    # --- trees ---

    def field(self, c: ast.Clause) -> Field | None:
        if c.field is None:
            return None
        found = self.schema.find(c.field)
        if found is None and c.field == "semantic":
            vectors = [f for f in self.schema.fields if f.type == "VECTOR"]
            found = vectors[0] if len(vectors) == 1 else None
        if found is None:
            raise TypeMismatch(f"unknown or ambiguous field {c.field}", c.span[0], len(c.field.encode()))
        return found

    def node(self, n: ast.Node, positive: bool) -> Bound:
        match n:
            case ast.Not(kid):
                return Branch("not", (self.node(kid, False),))
            case ast.And(kids) | ast.Or(kids):
                return Branch("and" if isinstance(n, ast.And) else "or", tuple(self.node(k, positive) for k in kids))
        if n.params:
            raise Unsupported("clause parameters are not implemented", *n.span)
        if not math.isfinite(n.boost) or n.boost < 0:
            raise TypeMismatch("invalid boost", *n.span)
        field = self.field(n)
        kind = field.type if field else "TEXT"
        test = self.test(n.value, kind, n.op)
        if isinstance(test, Near) and field and len(test.vector) != field.dims:
            raise TypeMismatch("vector dimensions do not match the field", *n.span)
        if kind == "VECTOR" and not isinstance(test, Exists | Near):
            raise TypeMismatch("vector dimensions do not match the field", *n.span)
        if positive:
            self.vector = self.vector or isinstance(test, Near)
            self.lexical = self.lexical or kind == "TEXT" and scores_text(test)
        return Leaf(field, n.op, test, n.boost)


def bind(statement: ast.Statement, schema: Schema, now: int, max_hits: int = 1000, facets: bool = False) -> Plan:
    """facets: allow FACET, an extension."""
    if statement.mode == "WATCH" or statement.sources or statement.facets and not facets:
        raise Unsupported("WATCH, SOURCE and FACET are not implemented", *statement.span)
    if len(statement.sort) > MAX_SORT:
        raise LimitExceeded("too many sort keys", *statement.span)
    sort = []
    for key in statement.sort:
        if key.field != "_score":
            field = schema.find(key.field)
            if field is None or field.type == "VECTOR":
                raise TypeMismatch(f"cannot sort by {key.field}", *statement.span)
        sort.append((key.field, key.direction == "DESC" or key.direction is None and key.field == "_score"))
    if statement.limit is not None and statement.limit > max_hits:
        raise LimitExceeded(f"LIMIT is above {max_hits}", *statement.span)
    binder = Binder(schema, now)
    root = binder.node(statement.where, True) if statement.where is not None else None
    limit = min(20, max_hits) if statement.limit is None else statement.limit
    return Plan(root, statement, binder.lexical, binder.vector, tuple(sort), limit, statement.offset or 0)


__all__ = ["Binder", "Field", "Plan", "Schema", "bind", "leaves", "scores_text"]

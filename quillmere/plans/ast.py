"""Syntax trees of queries, their canonical text and an S-expression view.

Spans are byte offsets into the query. They take no part in equality, so two trees are equal when they mean the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

Span = tuple[int, int]


def _span() -> Span:
    return field(default=(0, 0), compare=False, kw_only=True)  # type: ignore[return-value]


@dataclass(frozen=True)
class Word:
    text: str
    span: Span = _span()


@dataclass(frozen=True)
class String:
    text: str
    span: Span = _span()


@dataclass(frozen=True)
class Number:
    raw: str
    value: float
    integer: int | None  # if the lexeme is an integer that fits 64 bits
    suffix: str
    span: Span = _span()


@dataclass(frozen=True)
class DateTime:
    """A calendar literal of some precision, or a base (now, today, yesterday) with an offset."""

    raw: str
    precision: str  # year, month, day, minute, second, fraction or relative
    year: int = 0
    month: int = 1
    day: int = 1
    hour: int = 0
    minute: int = 0
    second: int = 0
    nanos: int = 0
    zone_minutes: int = 0
    base: str = ""
    amount: int = 0
    unit: str = ""
    span: Span = _span()


@dataclass(frozen=True)
class Regex:
    pattern: str  # as bytes, one character each
    flags: frozenset[str]
    span: Span = _span()


@dataclass(frozen=True)
class Star:
    span: Span = _span()


@dataclass(frozen=True)
class Vector:
    values: tuple[float, ...]
    span: Span = _span()


@dataclass(frozen=True)
class Range:
    low: Value | None
    high: Value | None
    span: Span = _span()


@dataclass(frozen=True)
class AnyOf:
    items: tuple[Value, ...]
    span: Span = _span()


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Value, ...]
    span: Span = _span()


Value = Union[Word, String, Number, DateTime, Regex, Star, Vector, Range, AnyOf, Call]


@dataclass(frozen=True)
class Clause:
    field: str | None
    op: str  # : = != < <= > >= ~
    value: Value
    boost: float = 1.0
    params: tuple[tuple[str, Value], ...] = ()
    span: Span = _span()


@dataclass(frozen=True)
class And:
    kids: tuple[Node, ...]
    span: Span = _span()


@dataclass(frozen=True)
class Or:
    kids: tuple[Node, ...]
    span: Span = _span()


@dataclass(frozen=True)
class Not:
    kid: Node
    span: Span = _span()


Node = Union[Clause, And, Or, Not]


@dataclass(frozen=True)
class SortKey:
    field: str
    direction: str | None = None  # ASC, DESC or as the field wants it


@dataclass(frozen=True)
class Statement:
    where: Node | None = None
    mode: str = ""  # EXPLAIN, EXPLAIN ANALYZE or WATCH
    sources: tuple[str, ...] = ()
    sort: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int | None = None
    facets: tuple[str, ...] = ()
    span: Span = _span()


def clauses(node: Node | None) -> list[Clause]:
    if node is None:
        return []
    if isinstance(node, Clause):
        return [node]
    return [c for k in ((node.kid,) if isinstance(node, Not) else node.kids) for c in clauses(k)]


# --- canonical text -------------------------------------------------------------------------------------------------


def _quoted(text: str) -> str:
    named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t"}
    return '"' + "".join(named.get(c) or (f"\\u{ord(c):04X}" if c < " " else c) for c in text) + '"'


def show_value(v: Value | None) -> str:
    match v:
        case None | Star():
            return "*"
        case Word(text):
            return text
        case String(text):
            return _quoted(text)
        case Number(raw) | DateTime(raw):
            return raw
        case Regex(pattern, flags):
            return f"/{_as_text(pattern.replace('/', chr(92) + '/'))}/{''.join(f for f in 'ism' if f in flags)}"
        case Range(low, high):
            return f"{show_value(low)}..{show_value(high)}"
        case AnyOf(items):
            return f"({' OR '.join(map(show_value, items))})"
        case Call(name, args):
            return f"{name}({','.join(map(show_value, args))})"
        case Vector(values):
            return f"[{','.join(f'{x:.9g}' for x in values)}]"
    raise TypeError(v)


def _as_text(latin: str) -> str:
    return latin.encode("latin-1").decode("utf-8", "replace")


def show_node(node: Node, outer: int = 0) -> str:
    match node:
        case Clause():
            head = ""
            if node.field is not None:
                params = f"({','.join(f'{k}={show_value(v)}' for k, v in node.params)})" if node.params else ""
                head = f"{node.field}{params}{':' if node.op[0] in '<>' else ''}{node.op}"
            return head + show_value(node.value) + (f"^{node.boost:.17g}" if node.boost != 1 else "")
        case Not(kid):
            own, text = 3, f"NOT {show_node(kid, 3)}"
        case And(kids):
            own, text = 2, " AND ".join(show_node(k, 2) for k in kids)
        case Or(kids):
            own, text = 1, " OR ".join(show_node(k, 1) for k in kids)
    return f"({text})" if own < outer else text


def show(s: Statement) -> str:
    """The canonical text of a statement; parsing it gives an equal statement."""
    parts = [s.mode] if s.mode else []
    if s.sources:
        parts.append(f"SOURCE({','.join(s.sources)})")
    if s.where is not None:
        parts.append(show_node(s.where))
    if s.sort:
        parts.append("SORT BY " + ",".join(k.field + (f" {k.direction}" if k.direction else "") for k in s.sort))
    if s.limit is not None:
        parts.append(f"LIMIT {s.limit}")
    if s.offset is not None:
        parts.append(f"OFFSET {s.offset}")
    if s.facets:
        parts.append("FACET " + ",".join(s.facets))
    return " ".join(parts)


def sexpr(s: Statement, spans: bool = False) -> str:
    """A statement as nested lists, for debugging."""

    def at(x) -> str:
        return f" @{x.span[0]}+{x.span[1]}" if spans else ""

    def node(n: Node) -> str:
        match n:
            case Clause():
                boost = f" (boost {n.boost:.17g})" if n.boost != 1 else ""
                params = "".join(f" (param {k} {show_value(v)})" for k, v in n.params)
                return f"(clause{at(n)} {n.field or '_'} {n.op} ({type(n.value).__name__.lower()} {show_value(n.value)}){params}{boost})"
            case Not(kid):
                return f"(not{at(n)} {node(kid)})"
            case And(kids) | Or(kids):
                return f"({type(n).__name__.lower()}{at(n)} {' '.join(map(node, kids))})"

    parts = [f"(where {node(s.where)})" if s.where is not None else ""]
    parts += [f"(sort {k.field} {k.direction or 'DEFAULT'})" for k in s.sort]
    parts += [f"({name} {v})" for name, v in (("limit", s.limit), ("offset", s.offset)) if v is not None]
    parts += [f"({name} {' '.join(v)})" for name, v in (("source", s.sources), ("facet", s.facets)) if v]
    return f"(statement{at(s)}{' ' + s.mode.lower().replace(' ', '-') if s.mode else ''} {' '.join(p for p in parts if p)})"

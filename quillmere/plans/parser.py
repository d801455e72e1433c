"""Query text to syntax trees.

The text is read as UTF-8 bytes, one character each, so that every position is a byte offset. One pattern cuts it into
tokens; a small descent with one token of look-ahead builds the tree.

    statement := [EXPLAIN [ANALYZE] | WATCH] [SOURCE(name, ...)] [any] {SORT BY key, ... | LIMIT n | OFFSET n | FACET name, ...}
    any       := all {OR all}                 all   := one {[AND] one}
    one       := (NOT | -) one | (any) | [field [params] op] value [^boost]
    op        := : | [:] (= | != | < | <= | > | >= | ~)
    value     := scalar [.. scalar]           field:( any ) carries its field and operator into the group
"""

from __future__ import annotations

import calendar
import math
import re
from dataclasses import dataclass, replace
from typing import NamedTuple

from quillmere.errors import LimitExceeded, ParseError
from quillmere.plans import ast

KEYWORDS = frozenset("AND OR NOT EXPLAIN ANALYZE WATCH SOURCE SORT BY ASC DESC LIMIT OFFSET FACET".split())
COMPARE = frozenset(("=", "!=", "<", "<=", ">", ">=", "~"))

_STOPS = r"\x00 \t\r\n\f\v()\[\]\"'<>=!~^,"
_TOKEN = re.compile(
    rf"""
    (?P<space>[ \t\r\n\f\v]+)
  | (?P<mark>!=|<=|>=|&&|\|\||\.\.|[()\[\]:=~^,\-!<>])
  | (?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
  | (?P<regex>/(?:\\.|[^/\\])*/[A-Za-z]*)
  | (?P<open>["'/])
  | (?P<word>(?=\d{{4}}-)(?:(?!\.\.|&&|\|\|)[^{_STOPS}])+|(?:(?!\.\.|&&|\|\|)[^{_STOPS}:])+)
    """,
    re.X | re.S,
)
_NAME = re.compile(r"[A-Za-z_\x80-\xff][A-Za-z0-9_.\x80-\xff-]*\Z")
_NUMBER = re.compile(r"([+-]?)(\d+)((?:\.\d+)?(?:[eE][+-]?\d+)?)([A-Za-z%\x80-\xff]*)\Z")
_RELATIVE = re.compile(r"(now|today|yesterday)(?:\Z|([+-])(.*)\Z)", re.S)
_OFFSET = re.compile(r"(\d+)(s|m|h|d|w|mo|y)\Z")
_DATE = re.compile(r"(\d{4})-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?(?:Z|([+-])(\d\d):(\d\d))?)?)?\Z")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|(.))|([^\\]+)|(\\)", re.S)


@dataclass(frozen=True)
class Limits:
    query_bytes: int = 64 * 1024
    depth: int = 64
    clauses: int = 4096
    items: int = 4096
    string_bytes: int = 16 * 1024


class Token(NamedTuple):
    kind: str  # a mark, a keyword, word, string, regex or end
    text: str
    pos: int

    @property
    def end(self) -> int:
        return self.pos + len(self.text)


_SAME = {"&&": "AND", "||": "OR", "!": "NOT"}


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ParseError("NUL byte in query", at, 1)
        kind, got = m.lastgroup, m[0]
        if kind == "open":
            raise ParseError(f"unterminated {'regex' if got == '/' else 'string'} started here", at, len(text) - at)
        if kind == "mark":
            kind = _SAME.get(got, got)
        elif kind == "word" and got in KEYWORDS:
            kind = got
        if kind != "space":
            out.append(Token(kind, got, at))
        at = m.end()
    return [*out, Token("end", "", len(text))]


def _text(latin: str, at: Token) -> str:
    try:
        return latin.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        raise ParseError("invalid UTF-8", at.pos, len(at.text)) from None


def number(raw: str, span: ast.Span) -> ast.Number | None:
    m = _NUMBER.match(raw)
    if not m:
        return None
    sign, whole, rest, suffix = m.groups()
    value = float(sign + whole + rest)
    if not math.isfinite(value):
        raise ParseError("number is outside the finite double range", *span)
    integer = int(sign + whole) if not rest else None
    if integer is not None and not -(1 << 63) <= integer < 1 << 63:
        integer = None
    raw, suffix = (x.encode("latin-1").decode("utf-8", "replace") for x in (raw, suffix))
    return ast.Number(raw, value, integer, suffix, span=span)


def datetime(raw: str, span: ast.Span) -> ast.DateTime | None:
    """A date, if the word has the form of one; a word of that form that is none is an error."""
    wrong = ParseError("invalid calendar date or relative date/time", *span)
    if m := _RELATIVE.match(raw):
        base, sign, rest = m.groups()
        if sign is None:
            return ast.DateTime(raw, "relative", base=base, span=span)
        m = _OFFSET.match(rest)
        amount = int(sign + m[1]) if m else 0
        if not m or not -(1 << 63) <= amount < 1 << 63:
            raise wrong
        return ast.DateTime(raw, "relative", base=base, amount=amount, unit=m[2], span=span)
    if re.fullmatch(r"\d{4}", raw):
        if raw == "0000":
            raise wrong
        return ast.DateTime(raw, "year", int(raw), span=span)
    if not re.match(r"\d{4}-", raw):
        return None
    m = _DATE.match(raw)
    if not m:
        raise wrong
    year, month, day, hour, minute, second = (int(g or 0) for g in m.groups()[:6])
    zone = int(m[9] or 0) * 60 + int(m[10] or 0)
    if year < 1 or not 1 <= month <= 12 or m[3] and not 1 <= day <= calendar.monthrange(year, month)[1]:
        raise wrong
    if hour > 23 or minute > 59 or second > 59 or int(m[9] or 0) > 23 or int(m[10] or 0) > 59:
        raise wrong
    precision = "fraction" if m[7] else "second" if m[6] else "minute" if m[4] else "day" if m[3] else "month"
    return ast.DateTime(raw, precision, year, month, day or 1, hour, minute, second, int((m[7] or "").ljust(9, "0")), -zone if m[8] == "-" else zone, span=span)


class _Parser:
    def __init__(self, text: str, limits: Limits):
        self.text, self.limits, self.depth = text, limits, 0
        self.tokens, self.at = tokens(text), 0
        self.last = 0  # end of the token before this one

    # --- tokens ---

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.token
        self.last = t.end
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return t

    def take(self, kind: str) -> bool:
        if self.token.kind != kind:
            return False
        self.next()
        return True

    def wrong(self, message: str, at: Token | None = None) -> ParseError:
        at = at or self.token
        return ParseError(message, at.pos, len(at.text))

    def expect(self, kind: str, message: str) -> None:
        if not self.take(kind):
            raise self.wrong(message)

    def deeper(self) -> None:
        if self.depth >= self.limits.depth:
            raise LimitExceeded("query nesting limit exceeded", self.token.pos, len(self.token.text))
        self.depth += 1

    def few(self, items: list) -> list:
        if len(items) > self.limits.items:
            raise LimitExceeded("query list limit exceeded", self.token.pos, len(self.token.text))
        return items

    def short(self, text: str, at: Token) -> str:
        if len(text.encode("utf-8")) > self.limits.string_bytes:
            raise LimitExceeded("query string limit exceeded", at.pos, len(at.text))
        return text

    def span(self, start: int) -> ast.Span:
        return (start, self.last - start)

    @staticmethod
    def is_name(t: Token) -> bool:
        return t.kind == "word" and bool(_NAME.match(t.text))

    def name(self) -> str:
        if not self.is_name(self.token):
            raise self.wrong("expected an identifier")
        return self.short(_text(self.token.text, self.token), self.next())

    # --- values ---

    def numeric(self) -> ast.Number:
        start = self.token
        raw = start.text
        if start.kind == "-":
            self.next()
            if self.token.kind != "word" or self.token.pos != start.end:
                raise self.wrong("expected a number after '-'")
            raw += self.token.text
        elif start.kind != "word":
            raise self.wrong("expected a number")
        found = number(raw, (start.pos, len(raw)))
        if found is None:
            raise self.wrong("expected a number")
        self.next()
        return found

    def unescape(self, t: Token) -> str:
        out: list[str] = []
        high = None
        for code, char, plain, _ in _ESCAPE.findall(t.text[1:-1]):
            unit = int(code, 16) if code else None
            if unit is not None and 0xDC00 <= unit <= 0xDFFF and high is not None:
                out.append(chr(0x10000 + ((high - 0xD800) << 10) + unit - 0xDC00))
                high = None
                continue
            named = {"\\": "\\", "'": "'", '"': '"', "n": "\n", "t": "\t"}.get(char)
            if high is not None or unit == 0 or unit is not None and 0xDC00 <= unit <= 0xDFFF or unit is None and not plain and named is None:
                raise self.wrong("invalid string escape (NUL and unpaired surrogates are forbidden)", t)
            if unit is not None and 0xD800 <= unit <= 0xDBFF:
                high = unit
            else:
                out.append(chr(unit) if unit is not None else named if named is not None else _text(plain, t))
        if high is not None:
            raise self.wrong("invalid string escape (NUL and unpaired surrogates are forbidden)", t)
        return self.short("".join(out), t)

    def regex(self, t: Token) -> ast.Regex:
        body, _, flags = t.text[1:].rpartition("/")
        if len(set(flags)) != len(flags) or not set(flags) <= set("ism"):
            raise self.wrong("unknown or repeated regex flag", t)
        pattern = re.sub(r"\\(.)", lambda m: "/" if m[1] == "/" else m[0], body, flags=re.S)
        if len(pattern) > self.limits.string_bytes:
            raise LimitExceeded("query string limit exceeded", t.pos, len(t.text))
        return ast.Regex(pattern, frozenset(flags), span=(t.pos, len(t.text)))

    def listed(self, close: str, item, separators: tuple[str, ...], message: str) -> list:
        """Items up to the closing mark; none may be missing after a separator."""
        self.deeper()
        self.next()
        items: list = []
        while self.token.kind != close:
            items.append(item())
            self.few(items)
            if self.token.kind not in separators:
                break
            self.next()
            if self.token.kind == close:
                raise self.wrong("expected another item after the separator")
        self.expect(close, message)
        self.depth -= 1
        return items

    def entry(self) -> float:
        n = self.numeric()
        if n.suffix or not abs(n.value) <= 3.4028235677973366e38:  # what rounds to a finite 32-bit float
            raise ParseError("vector entries must be finite float numbers without units", *n.span)
        return n.value

    def scalar(self) -> ast.Value:
        t = self.token
        match t.kind:
            case "-":
                return self.numeric()
            case "string":
                self.next()
                return ast.String(self.unescape(t), span=(t.pos, len(t.text)))
            case "regex":
                self.next()
                return self.regex(t)
            case "[":
                values = self.listed("]", self.entry, (",",), "expected ']' after vector")
                return ast.Vector(tuple(values), span=self.span(t.pos))
            case "(":
                items = self.listed(")", self.value, (",", "OR"), "expected ')' after value group")
                if not items:
                    raise self.wrong("empty value group", t)
                return items[0] if len(items) == 1 else ast.AnyOf(tuple(items), span=self.span(t.pos))
            case "word":
                self.next()
                if self.token.kind == "(" and self.is_name(t):
                    args = self.listed(")", self.value, (",",), "expected ')' after call arguments")
                    return ast.Call(_text(t.text, t), tuple(args), span=self.span(t.pos))
                span = (t.pos, len(t.text))
                if t.text == "*":
                    return ast.Star(span=span)
                return datetime(t.text, span) or number(t.text, span) or ast.Word(self.short(_text(t.text, t), t), span=span)
        raise self.wrong("expected a value")

    def value(self) -> ast.Value:
        low = self.scalar()
        if not self.take(".."):
            return low
        high = self.scalar()
        if any(isinstance(v, ast.Range | ast.AnyOf | ast.Call | ast.Vector) for v in (low, high)):
            raise self.wrong("range endpoint must be a scalar")
        end = high.span[0] + high.span[1]
        return ast.Range(*(None if isinstance(v, ast.Star) else v for v in (low, high)), span=(low.span[0], end - low.span[0]))

    # --- expressions; `bound` is the clause whose field and operator a group carries ---

    def operator(self) -> str:
        colon = self.take(":")
        if self.token.kind in COMPARE:
            return self.next().kind
        if not colon:
            raise self.wrong("expected a field operator")
        return ":"

    def begins(self, bound: ast.Clause | None) -> bool:
        kind = self.token.kind
        return kind in ("word", "string", "regex", "(", "[", "NOT", "-") or bound is not None and (kind in COMPARE or kind == ":")

    def boosted(self, node: ast.Node) -> tuple[ast.Node, bool]:
        if not self.take("^"):
            return node, False
        n = self.numeric()
        if n.suffix:
            raise ParseError("boost must be a number without units", *n.span)
        return self.scaled(node, n.value), True

    def scaled(self, node: ast.Node, by: float) -> ast.Node:
        match node:
            case ast.Clause():
                if not math.isfinite(node.boost * by):
                    raise ParseError("effective boost is not finite", *node.span)
                return replace(node, boost=node.boost * by)
            case ast.Not(kid):
                return replace(node, kid=self.scaled(kid, by))
        return replace(node, kids=tuple(self.scaled(k, by) for k in node.kids))

    def params(self) -> tuple[tuple[str, ast.Value], ...]:
        def one() -> tuple[str, ast.Value]:
            key = self.name()
            self.expect("=", "expected '=' after parameter name")
            return key, self.value()

        return tuple(self.listed(")", one, (",",), "expected ')' after parameters"))

    def term(self, bound: ast.Clause | None) -> tuple[ast.Node, bool]:
        """A clause, and whether it is a bare value that may join a list of alternatives."""
        start, simple = self.token.pos, True
        clause = bound or ast.Clause(None, ":", ast.Star())
        named = False
        if bound is not None:
            if self.token.kind in COMPARE or self.token.kind == ":":
                clause, simple = replace(clause, op=self.operator()), False
        elif self.is_name(self.token):
            follows = self.ahead()
            has_params = follows.kind == "(" and self.is_name(self.ahead(2)) and self.ahead(3).kind == "="
            if follows.kind == ":" or follows.kind in COMPARE or has_params:
                named = True
                field = self.name()
                params = self.params() if has_params else ()
                clause = replace(clause, field=field, params=params, op=self.operator())
        if named and self.token.kind == "(":
            opening = self.token
            self.deeper()
            self.next()
            node, pure = self.any(clause)
            if self.token.kind != ")":
                raise self.wrong("unbalanced '(' in field group", opening)
            self.next()
            self.depth -= 1
            if pure and isinstance(node, ast.Or):
                items = tuple(k.value for k in node.kids)  # type: ignore[union-attr]
                node = replace(clause, value=ast.AnyOf(items, span=self.span(opening.pos)))
            node, _ = self.boosted(node)
            return (replace(node, span=self.span(start)) if isinstance(node, ast.Clause) else node), False
        node, boosted = self.boosted(replace(clause, value=self.value(), span=self.span(start)))
        return replace(node, span=self.span(start)), simple and not boosted

    def one(self, bound: ast.Clause | None) -> tuple[ast.Node, bool]:
        t = self.token
        if t.kind in ("NOT", "-"):
            if t.kind == "-" and self.text[t.end : t.end + 1] in ("", *" \t\r\n\f\v"):
                raise self.wrong("prefix '-' must immediately precede a term")
            self.deeper()
            self.next()
            kid, _ = self.one(bound)
            self.depth -= 1
            return ast.Not(kid, span=self.span(t.pos)), False
        if t.kind == "(":
            self.deeper()
            self.next()
            node, simple = self.any(bound)
            if self.token.kind != ")":
                raise self.wrong("unbalanced '('", t)
            self.next()
            self.depth -= 1
            if bound is not None:
                node, boosted = self.boosted(node)
                simple = simple and not boosted
            return node, simple
        return self.term(bound)

    def joined(self, kind: type, kids: list[ast.Node], start: int) -> ast.Node:
        flat = [x for k in kids for x in (k.kids if isinstance(k, kind) else (k,))]
        return kind(tuple(self.few(flat)), span=self.span(start))

    def all(self, bound: ast.Clause | None) -> tuple[ast.Node, bool]:
        start = self.token.pos
        node, simple = self.one(bound)
        kids = [node]
        while self.token.kind == "AND" or self.begins(bound):
            self.take("AND")
            kids.append(self.one(bound)[0])
        return (node, simple) if len(kids) == 1 else (self.joined(ast.And, kids, start), False)

    def any(self, bound: ast.Clause | None) -> tuple[ast.Node, bool]:
        start = self.token.pos
        node, simple = self.all(bound)
        kids = [node]
        while self.token.kind == "OR" or bound is not None and self.token.kind == ",":
            self.next()
            kid, also = self.all(bound)
            kids.append(kid)
            simple = simple and also
        return (node, simple) if len(kids) == 1 else (self.joined(ast.Or, kids, start), simple)

    # --- statements ---

    def names(self) -> list[str]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return self.few(out)

    def count(self) -> int:
        n = self.numeric()
        if n.integer is None or n.integer < 0 or n.suffix:
            raise ParseError("LIMIT and OFFSET require a non-negative int64 integer", *n.span)
        return n.integer

    def statement(self) -> ast.Statement:
        start, mode, sources = self.token.pos, "", []
        if self.take("EXPLAIN"):
            mode = "EXPLAIN ANALYZE" if self.take("ANALYZE") else "EXPLAIN"
        elif self.take("WATCH"):
            mode = "WATCH"
        if self.take("SOURCE"):
            self.expect("(", "expected '(' after SOURCE")
            sources = self.names()
            self.expect(")", "expected ')' after sources")
        where = self.any(None)[0] if self.begins(None) else None
        sort: list[ast.SortKey] = []
        facets: list[str] = []
        counts: dict[str, int] = {}
        while self.token.kind != "end":
            kind = self.token.kind
            if kind not in ("SORT", "FACET", "LIMIT", "OFFSET"):
                raise self.wrong("unexpected token after expression; expected SORT, LIMIT, OFFSET or FACET")
            if kind in counts:
                raise self.wrong("duplicate LIMIT or OFFSET clause")
            self.next()
            if kind == "SORT":
                self.expect("BY", "expected BY after SORT")
                while True:
                    field = self.name()
                    sort.append(ast.SortKey(field, self.next().kind if self.token.kind in ("ASC", "DESC") else None))
                    if not self.take(","):
                        break
            elif kind == "FACET":
                facets += self.names()
            else:
                counts[kind] = self.count()
        if len(ast.clauses(where)) > self.limits.clauses:
            raise LimitExceeded("query clause limit exceeded", *self.span(start))
        return ast.Statement(where, mode, tuple(sources), tuple(sort), counts.get("LIMIT"), counts.get("OFFSET"), tuple(facets), span=self.span(start))


def parse(query: str, limits: Limits | None = None) -> ast.Statement:
    limits = limits or Limits()
    data = query.encode("utf-8", "surrogatepass")
    if len(data) > limits.query_bytes:
        raise LimitExceeded("query length limit exceeded", 0, 0)
    if (nul := data.find(0)) >= 0:
        raise ParseError("NUL byte in query", nul, 1)
    return _Parser(data.decode("latin-1"), limits).statement()

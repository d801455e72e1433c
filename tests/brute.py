"""A second, naive reading of the query language over lists of dicts: what searches are held against."""

from __future__ import annotations

import calendar
import math
import re
from datetime import datetime, timedelta, timezone

from quillmere.plans import ast


def fold(text: str) -> str:
    """Full-width forms to ASCII, then A-Z to a-z, character by character."""
    out = []
    for c in text:
        if 0xFF01 <= ord(c) <= 0xFF5E:
            c = chr(ord(c) - 0xFEE0)
        elif c == "\u3000":
            c = " "
        out.append(c.lower() if "A" <= c <= "Z" else c)
    return "".join(out)


def words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z_\u00a1-\u167f\u1681-\u180d\u180f-\u1fff\u2070-\u2dff\u2e80-\u2fff\u3040-\ufefe\uff00-\U0010ffff]+", fold(text))


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def instant(cell: str) -> datetime | None:
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)(?:[Tt](\d\d:\d\d(?::\d\d)?)(Z|[+-]\d\d:\d\d)?)?", cell)
    if not m:
        return None
    try:
        return datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00'}{(m[3] or '+00:00').replace('Z', '+00:00')}").astimezone(timezone.utc)
    except ValueError:
        return None


def stretch(v: ast.DateTime) -> tuple[datetime, datetime]:
    low = datetime(v.year, v.month, v.day, v.hour, v.minute, tzinfo=timezone.utc)
    match v.precision:
        case "year":
            return low, low.replace(year=v.year + 1)
        case "month":
            return low, low + timedelta(days=calendar.monthrange(v.year, v.month)[1])
        case "day":
            return low, low + timedelta(days=1)
    return low, low + timedelta(minutes=1)


def compare(op: str, x, y) -> bool:
    return {":": x == y, "=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


class Brute:
    def __init__(self, docs: list[dict], kinds: dict[str, str]):
        self.docs, self.kinds = docs, kinds
        self.texts = [f for f, k in kinds.items() if k == "TEXT" and f != "_id"]
        self.tokens = {f: [words(d[f]) if d.get(f) is not None else [] for d in docs] for f in self.texts}

    def bm25(self, i: int, f: str, query: list[str]) -> float:
        full = [t for t in self.tokens[f] if t]
        mean = sum(map(len, full)) / len(full)
        own, score = self.tokens[f][i], 0.0
        for q in query:
            df, tf = sum(q in t for t in full), own.count(q)
            score += math.log(1 + (len(full) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
        return score

    def value(self, i: int, f: str, op: str, v: ast.Value) -> tuple[bool, float, float | None]:
        """Whether a field matches a value, its lexical score, and its vector score where it has one."""
        cell, kind = self.docs[i].get(f), self.kinds[f]
        if isinstance(v, ast.AnyOf):
            got = [self.value(i, f, op, x) for x in v.items]
            return any(g[0] for g in got), sum(g[1] for g in got if g[0]), None
        if cell is None:
            return False, 0.0, None
        if isinstance(v, ast.Star) or isinstance(v, ast.Call) and v.name == "exists":
            return True, 0.0, None
        if kind == "VECTOR":
            dot, size = sum(a * b for a, b in zip(cell, v.values, strict=True)), math.hypot(*cell) * math.hypot(*v.values)
            return True, 0.0, dot / size if size else 0.0
        if isinstance(v, ast.Range):
            return (v.low is None or cell >= float(v.low.raw)) and (v.high is None or cell <= float(v.high.raw)), 0.0, None
        if kind in ("INT", "FLOAT"):
            return compare(op, cell, int(v.raw) if kind == "INT" else float(v.raw)), 0.0, None
        if isinstance(v, ast.DateTime):
            when = instant(cell)
            if when is None:
                return False, 0.0, None
            low, end = stretch(v)
            return {":": low <= when < end, "=": low <= when < end, "!=": not low <= when < end, "<": when < low, "<=": when < end, ">": when >= end, ">=": when >= low}[op], 0.0, None
        if kind == "BOOL":
            return compare(op, cell, v.text in ("true", "yes")), 0.0, None
        return (*self.text(i, f, op, v), None)

    def text(self, i: int, f: str, op: str, v: ast.Value) -> tuple[bool, float]:
        cell = self.docs[i][f]
        own = self.tokens[f][i] if f != "_id" else []
        if isinstance(v, ast.Regex):
            flags = sum(getattr(re, x.upper()) for x in v.flags)
            return re.search(v.pattern.encode("latin-1").decode(), cell, flags) is not None, 1.0
        if isinstance(v, ast.Call):
            arg = fold(v.args[0].text)
            match v.name:
                case "prefix":
                    return any(w.startswith(arg) for w in own), 1.0
                case "substr":
                    return arg in fold(cell), 1.0
                case "fuzzy":
                    return any(edits(w, arg) <= v.args[1].integer for w in own), 1.0
        if op in ("=", "!="):
            return (cell == v.text) == (op == "="), 0.0
        if op == "~":
            most = 0 if len(v.text) <= 2 else 1 if len(v.text) <= 5 else 2
            return any(edits(w, fold(v.text)) <= most for w in own), 1.0
        if isinstance(v, ast.Word) and v.text.endswith("*"):
            return any(w.startswith(fold(v.text[:-1])) for w in own), 1.0
        query = words(v.text)
        if isinstance(v, ast.String):
            n = len(query)
            return bool(n) and any(own[k : k + n] == query for k in range(len(own) - n + 1)), self.bm25(i, f, query)
        return all(q in own for q in query), self.bm25(i, f, query)

    def node(self, i: int, n: ast.Node) -> tuple[bool, float, float | None]:
        if isinstance(n, ast.Clause):
            if n.field is None and isinstance(n.value, ast.Star):
                return True, 0.0, None
            fields = [n.field] if n.field else self.texts
            got = [self.value(i, f, n.op, n.value) for f in fields]
            vector = next((g[2] for g in got if g[2] is not None), None)
            return any(g[0] for g in got), n.boost * sum(g[1] for g in got if g[0]), None if vector is None else n.boost * vector
        if isinstance(n, ast.Not):
            return not self.node(i, n.kid)[0], 0.0, None
        kids = [self.node(i, k) for k in n.kids]
        match = all(k[0] for k in kids) if isinstance(n, ast.And) else any(k[0] for k in kids)
        active = [k[2] for k in kids if k[0] and k[2] is not None]
        return match, sum(k[1] for k in kids if k[0]), sum(active) if match and active else None

    def search(self, where: ast.Node | None, fused: bool = False) -> dict[str, float]:
        """Scores of the documents that match, by _id."""
        found = {d["_id"]: self.node(i, where) if where is not None else (True, 0.0, None) for i, d in enumerate(self.docs)}
        found = {k: g for k, g in found.items() if g[0]}
        if not fused:
            return {k: g[2] if g[2] is not None else g[1] for k, g in found.items()}
        lexical = sorted((k for k, g in found.items() if g[1] > 0), key=lambda k: (-found[k][1], k))
        vector = sorted((k for k, g in found.items() if g[2] is not None), key=lambda k: (-found[k][2], k))
        return {k: sum(1 / (61 + ranks.index(k)) for ranks in (lexical, vector) if k in ranks) for k in found}

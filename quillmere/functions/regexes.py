"""Regular expressions of the query language, for Java's engine.

The dialect is over bytes: literals, ., classes, ^ $, groups, |, * + ? {m,n}, and the escapes \\d \\s \\w \\D \\S \\W \\n \\r
\\t \\xHH; flags i, s and m. Patterns are checked here and spelled anew as character sets over a text of one character for
each byte, so that what Java does otherwise (line ends, Unicode, lazy and possessive forms) cannot matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.errors import LimitExceeded, ParseError, Unsupported

MAX_REPEAT, MAX_DEPTH = 1024, 128
_DIGIT = frozenset(range(48, 58))
_WORD = _DIGIT | set(range(65, 91)) | set(range(97, 123)) | {95}
_SPACE = frozenset({32, *range(9, 14)})
_ALL = frozenset(range(256))
_SETS = {"d": _DIGIT, "w": frozenset(_WORD), "s": _SPACE}
_CONTROL = {"n": 10, "r": 13, "t": 9}
_COUNT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")


def _cases(byte: int) -> set[int]:
    c = chr(byte)
    return {byte, ord(c.swapcase())} if c.isascii() and c.isalpha() else {byte}


class _Transpiler:
    def __init__(self, pattern: str, flags: frozenset[str]):
        self.p, self.at, self.flags, self.depth = pattern, 0, flags, 0

    def peek(self) -> str:
        return self.p[self.at : self.at + 1]

    def wrong(self, message: str) -> ParseError:
        return ParseError(f"regex: {message}", self.at, 1)

    def fold(self, bytes_: set[int]) -> set[int]:
        return set().union(*map(_cases, bytes_)) if "i" in self.flags else set(bytes_)

    def spell(self, bytes_: set[int]) -> str:
        """A Java class of exactly these bytes."""
        if not bytes_:
            return "(?!)"
        out, rest = [], sorted(bytes_)
        while rest:
            first = last = rest.pop(0)
            while rest and rest[0] == last + 1:
                last = rest.pop(0)
            out.append(f"\\x{first:02x}" + (f"-\\x{last:02x}" if last > first else ""))
        return f"[{''.join(out)}]"

    def item(self) -> tuple[set[int], int | None]:
        """One element of a class or of the pattern: its bytes and, if it is a single byte, which."""
        c = self.peek()
        if not c:
            raise self.wrong("missing character")
        self.at += 1
        if c != "\\":
            return {ord(c)}, ord(c)
        c = self.peek()
        if not c:
            raise self.wrong("trailing escape")
        self.at += 1
        if c.lower() in _SETS:
            own = _SETS[c.lower()]
            return set(own if c.islower() else _ALL - own), None
        if c in _CONTROL:
            return {_CONTROL[c]}, _CONTROL[c]
        if c == "x":
            m = re.compile(r"[0-9A-Fa-f]{2}").match(self.p, self.at)
            if not m:
                raise self.wrong("expected two hex digits after \\x")
            self.at = m.end()
            return {int(m[0], 16)}, int(m[0], 16)
        if c.isascii() and c.isalnum():
            raise Unsupported("regex: unsupported escape or backreference", self.at, 1)
        return {ord(c)}, ord(c)

    def klass(self) -> str:
        self.at += 1
        invert = self.peek() == "^"
        self.at += invert
        found: set[int] = set()
        some = False
        while self.peek() not in ("", "]"):
            own, low = self.item()
            some = True
            if self.peek() == "-" and self.p[self.at + 1 : self.at + 2] not in ("", "]"):
                self.at += 1
                _, high = self.item()
                if low is None or high is None or high < low:
                    raise self.wrong("invalid character range")
                own = set(range(low, high + 1))
            found |= self.fold(own)
        if not some or not self.peek():
            raise self.wrong("empty or unterminated character class")
        self.at += 1
        return self.spell(set(_ALL - found) if invert else found)

    def atom(self) -> str:
        c = self.peek()
        match c:
            case "(":
                self.depth += 1
                if self.depth > MAX_DEPTH:
                    raise LimitExceeded("regex nesting limit exceeded", self.at, 1)
                self.at += 1
                if self.peek() == "?":
                    if self.p[self.at + 1 : self.at + 2] != ":":
                        raise Unsupported("regex: lookaround and inline flags are unsupported", self.at, 1)
                    self.at += 2
                inner = self.alternatives()
                if self.peek() != ")":
                    raise self.wrong("missing closing parenthesis")
                self.at += 1
                self.depth -= 1
                return f"(?:{inner})"
            case "^":
                self.at += 1
                return "(?:(?<![^\\n]))" if "m" in self.flags else "(?:\\A)"
            case "$":
                self.at += 1
                return "(?:(?![^\\n]))" if "m" in self.flags else "(?:\\z)"
            case "[":
                return self.klass()
            case ".":
                self.at += 1
                return "[\\x00-\\xff]" if "s" in self.flags else "[^\\n]"
            case "*" | "+" | "?" | "{" | "}" | "]":
                raise self.wrong("unexpected metacharacter")
        return self.spell(self.fold(self.item()[0]))

    def repeated(self) -> str:
        one = self.atom()
        c = self.peek()
        if c not in ("*", "+", "?", "{") or not c:
            return one
        mark = c
        if c == "{":
            m = _COUNT.match(self.p, self.at)
            if not m:
                raise self.wrong("invalid repetition")
            low, high = int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1])
            if max(low, high or 0) > MAX_REPEAT:
                raise LimitExceeded("regex repetition limit exceeded", self.at, len(m[0]))
            if high is not None and low > high:
                raise self.wrong("invalid repetition")
            mark = m[0]
        self.at += len(mark)
        if self.peek() and self.peek() in "*+?{":
            raise self.wrong("stacked or lazy quantifiers unsupported")
        return one + mark

    def alternatives(self) -> str:
        out = [""]
        while self.peek() not in ("", ")"):
            if self.peek() == "|":
                self.at += 1
                out.append("")
            else:
                out[-1] += self.repeated()
        return "|".join(out)


def to_java(pattern: str, flags: frozenset[str] = frozenset()) -> str:
    """pattern: the bytes of a regular expression, one character each."""
    t = _Transpiler(pattern, flags)
    out = t.alternatives()
    if t.peek():
        raise t.wrong("unmatched closing parenthesis")
    return out


def as_bytes(text: Column) -> Column:
    """A text with one character for each of its bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def matches(text: Column, java: str) -> Column:
    return F.rlike(as_bytes(text), F.lit(java))

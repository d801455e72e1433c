"""The analyzer: normalisation and tokens, as Python for queries and as columns for data.

A text's tokens stand in one string, each between blanks of its own: " cat  sat ". Tokens hold no blanks, so a term, a
phrase or a prefix is a substring of it, and term frequencies and lengths follow from what replace() takes out; no array is
built and everything stays in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms and the ideographic space fold to ASCII, then A-Z to a-z. Nothing else folds.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FROM = WIDE + UPPER
_TO = NARROW.translate(str.maketrans(UPPER, LOWER)) + LOWER
_FOLD = str.maketrans(_FROM, _TO)

#: What separates tokens, after folding.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x9F\xA0\x{1680}\x{180E}\x{FEFF}\x{2000}-\x{206F}\x{2E00}-\x{2E7F}\x{3000}-\x{303F}"
_PYTHON = re.compile("[^" + re.sub(r"\\x\{(\w+)\}", r"\\u\1", SEPARATORS) + "]+")


def normalize(text: str) -> str:
    return text.translate(_FOLD)


def tokenize(text: str) -> list[str]:
    return _PYTHON.findall(normalize(text))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def normalized(text: Column) -> Column:
    """lower() folds exactly A-Z in texts of ASCII alone, many times faster than translate()."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.translate(text, _FROM, _TO))


def spelled(norm: Column) -> Column:
    """The tokens of a normalised text, each between blanks."""
    inner = F.btrim(F.regexp_replace(norm, f"[{SEPARATORS}]+", "  "))
    return F.concat(F.lit(" "), inner, F.lit(" "))


def n_tokens(spell: Column) -> Column:
    """spell is two blanks if there is no token, else has two more blanks than there are pairs of blanks around tokens."""
    return F.when(F.length(spell) <= 2, F.lit(0)).otherwise((F.length(spell) - F.length(F.replace(spell, F.lit(" "), F.lit("")))) / 2).cast("long")


def term_frequency(spell: Column, token: str) -> Column:
    return ((F.length(spell) - F.length(F.replace(spell, F.lit(f" {token} "), F.lit("")))) / (len(token) + 2)).cast("long")


def has_term(spell: Column, token: str) -> Column:
    return F.contains(spell, F.lit(f" {token} "))


def may_hold(raw: Column, words: list[str]) -> Column:
    """False only if the normalised text cannot hold all of these normalised words. lower() folds more than normalisation,
    which does no harm to words that it leaves alone; texts with full-width forms or ideographic spaces always may."""
    lower, data = F.lower(raw), raw.cast("binary")
    out = F.lit(True)
    for w in words:
        if w and w == w.lower():
            out = out & F.contains(lower, F.lit(w))
    for start in (b"\xef\xbc", b"\xef\xbd", b"\xe3\x80\x80"):
        out = out | F.contains(data, F.lit(bytearray(start)))
    return out


def has_phrase(spell: Column, tokens: list[str]) -> Column:
    return F.contains(spell, F.lit(f" {'  '.join(tokens)} "))


def has_prefix(spell: Column, prefix: str) -> Column:
    """A token that begins so; what cannot begin a token matches none."""
    if _PYTHON.fullmatch(prefix) is None:
        return F.lit(False)
    return F.contains(spell, F.lit(f" {prefix}"))


def has_fuzzy(spell: Column, word: str, distance: int) -> Column:
    """A token within so many single-character edits; lengths that differ by more are passed over."""
    tokens = F.split(F.btrim(spell), " +")
    near = lambda t: (F.abs(F.length(t) - len(word)) <= distance) & (t != "") & (F.levenshtein(t, F.lit(word), distance) >= 0)
    return F.exists(tokens, near)

"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII white space of the contracts, and the letters that are lower-cased.
SPACES = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def text_of(column: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does that for texts of ASCII alone, several times faster than translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """The non-empty parts between runs of the separators (a Java character class)."""
    return F.array_remove(F.split(text, separators + "+"), "")


def space_words(text: Column) -> Column:
    return split_words(text, "[\\t-\\r ]")


def packed(names: list[str]) -> Column:
    """The caller's columns as one, _kept, so that no name of theirs clashes with those of an operator's steps."""
    return F.struct(*([F.col(f"`{c}`") for c in names] or [F.lit(0)])).alias("_kept")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("_kept").getField(c).alias(c) for c in names]


def at(array: Column, index: Column) -> Column:
    """Element by position from 0; null beyond the ends."""
    return F.get(array, index)

"""Calendar dates in text cells.

A literal stands for a half-open stretch of UTC time; a cell, if it is a strict ISO date or time, for an instant. Instants
are pairs of epoch seconds and nanoseconds, so nothing is rounded.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.errors import LimitExceeded
from quillmere.plans import ast

FIRST, LAST = -62135596800, 253402300799  # seconds of the years 1 to 9999
_UNITS = {"": 0, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_EPOCH = date(1970, 1, 1).toordinal()
_DAY = 86400


@dataclass(frozen=True)
class Stretch:
    low: tuple[int, int]
    end: tuple[int, int]


def _seconds(year: int, month: int, day: int) -> int:
    return (date(year, month, day).toordinal() - _EPOCH) * _DAY


def resolve(v: ast.DateTime, now: int) -> Stretch:
    """now: seconds of the clock, read once for a query."""
    if v.precision == "relative":
        if not FIRST <= now <= LAST or abs(v.amount) > 1_000_000_000:
            raise LimitExceeded("date literal out of range", *v.span)
        start = now if v.base == "now" else now // _DAY * _DAY - (_DAY if v.base == "yesterday" else 0)
        if v.unit in ("mo", "y"):
            if not FIRST <= start <= LAST:
                raise LimitExceeded("date literal out of range", *v.span)
            days, rest = divmod(start, _DAY)
            at = date.fromordinal(days + _EPOCH)
            year, month = divmod(at.year * 12 + at.month - 1 + v.amount * (12 if v.unit == "y" else 1), 12)
            if not 1 <= year <= 9999:
                raise LimitExceeded("date literal out of range", *v.span)
            start = _seconds(year, month + 1, min(at.day, calendar.monthrange(year, month + 1)[1])) + rest
        else:
            start += v.amount * _UNITS[v.unit]
        if not FIRST <= start <= LAST:
            raise LimitExceeded("date literal out of range", *v.span)
        return Stretch((start, 0), (start + (1 if v.base == "now" else _DAY), 0))
    start = _seconds(v.year, v.month, v.day) + v.hour * 3600 + v.minute * 60 + v.second - v.zone_minutes * 60
    if v.precision == "fraction":
        end = (start, v.nanos + 1) if v.nanos < 999_999_999 else (start + 1, 0)
        return Stretch((start, v.nanos), end)
    width = {
        "year": (366 if calendar.isleap(v.year) else 365) * _DAY,
        "month": calendar.monthrange(v.year, v.month)[1] * _DAY,
        "day": _DAY,
        "minute": 60,
        "second": 1,
    }[v.precision]
    return Stretch((start, 0), (start + width, 0))


_CELL = r"\A[0-9]{4}-(?:0[1-9]|1[0-2])-[0-9]{2}(?:[Tt](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,9})?)?(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?)?\z"


def instant(cell: Column) -> tuple[Column, Column]:
    """Seconds and nanoseconds of a cell; null unless it is a date or time of the calendar."""
    part = lambda a, n: F.substring(cell, a, n).cast("int")
    day = F.substring(cell, 1, 10).try_cast("date")
    ok = F.rlike(cell, F.lit(_CELL)) & (F.substring(cell, 1, 4) != "0000") & day.isNotNull()
    timed = F.length(cell) > 10
    seconded = F.substring(cell, 17, 1) == ":"
    zone = F.regexp_extract(cell, r"([+-][0-9]{2}:[0-9]{2})\z", 1)
    shift = F.when(zone != "", (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 5, 2).cast("int") * 60) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)).otherwise(0)
    clock = F.when(timed, part(12, 2) * 3600 + part(15, 2) * 60 + F.when(seconded, part(18, 2)).otherwise(0) - shift).otherwise(0)
    fraction = F.regexp_extract(cell, r"\.([0-9]{1,9})", 1)
    seconds = F.when(ok, F.unix_date(day).cast("long") * _DAY + clock)
    nanos = F.when(ok, F.rpad(F.when(timed, fraction).otherwise(""), 9, "0").cast("int"))
    return seconds, nanos


def _from(seconds: Column, nanos: Column, bound: tuple[int, int]) -> Column:
    """The instant is at the bound or later."""
    if bound[1] == 0:
        return seconds >= bound[0]
    return (seconds > bound[0]) | (seconds == bound[0]) & (nanos >= bound[1])


def compare(cell: Column, op: str, s: Stretch) -> Column:
    """False, never null, for cells that are no dates."""
    seconds, nanos = instant(cell)
    low, end = _from(seconds, nanos, s.low), _from(seconds, nanos, s.end)
    held = {":": low & ~end, "=": low & ~end, "!=": ~low | end, "<": ~low, "<=": ~end, ">": end, ">=": low}[op]
    return seconds.isNotNull() & held


def between(cell: Column, low: Stretch | None, high: Stretch | None) -> Column:
    seconds, nanos = instant(cell)
    out = seconds.isNotNull()
    if low:
        out = out & _from(seconds, nanos, low.low)
    if high:
        out = out & ~_from(seconds, nanos, high.end)
    return out

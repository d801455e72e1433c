"""Vector arithmetic as columns: doubles throughout, added up from the first element to the last."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many elements a product is spelled out, which stays in generated code.
UNROLLED = 256


def as_floats(values) -> list[float]:
    """Query vectors are rounded to 32 bits, as stored ones are."""
    return [float(np.float32(x)) for x in values]


def _sum(v: Column, q: list[float], term) -> Column:
    if len(q) <= UNROLLED:
        return reduce(lambda a, b: a + b, (term(F.get(v, F.lit(i)).cast("double"), F.lit(x)) for i, x in enumerate(q)))
    pairs = F.zip_with(v, F.array(*map(F.lit, q)), lambda a, b: term(a.cast("double"), b))
    return F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)


def dot(v: Column, q: list[float]) -> Column:
    return _sum(v, q, lambda a, b: a * b)


def squared_distance(v: Column, q: list[float]) -> Column:
    return _sum(v, q, lambda a, b: (a - b) * (a - b))


def cosine(v: Column, q: list[float]) -> Column:
    """Within -1 and 1; 0 if either has no length."""
    own = _sum(v, q, lambda a, b: a * a)
    length = float(sum(x * x for x in q))
    value = F.when((own == 0) | F.lit(length == 0.0), F.lit(0.0)).otherwise(dot(v, q) / F.sqrt(own * F.lit(length)))
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))


def metric(v: Column, q: list[float], name: str) -> Column:
    """Scores for which more is nearer."""
    if name == "cosine":
        return cosine(v, q)
    if name == "dot":
        return dot(v, q)
    if name == "l2":
        return 1.0 / (1.0 + F.sqrt(squared_distance(v, q)))
    raise ValueError(name)


def quantize(v: Column) -> Column:
    """8-bit scalar quantization: (low, step, codes). A code is rounded half up; decode() is off by half a step at most."""
    d = F.transform(v, lambda x: x.cast("double"))
    low, high = F.array_min(d), F.array_max(d)
    step = (high - low) / 255.0
    codes = F.transform(d, lambda x: F.when(step == 0, F.lit(0)).otherwise(F.least(F.lit(255), F.floor((x - low) / F.when(step == 0, F.lit(1.0)).otherwise(step) + 0.5))).cast("int"))
    return F.struct(low.alias("low"), step.alias("step"), codes.alias("codes"))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["low"] + c * q["step"])

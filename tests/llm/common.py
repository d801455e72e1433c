"""Small tables with what operators must bear: nulls, empties, repeated rows, long texts, clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], DOC)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(n))

"""Benchmark decontamination as a prefix-filtered set join.

A window is `size` consecutive words of an item, or all words of a shorter item. A document holds a window if it holds all
of the window's shingles (5 words, or the whole of a shorter window), so one shingle of each window is a necessary prefix,
and the rarest in the corpus is the best one.

1. Items are cut into distinct windows, and these into shingles.
2. One pass over the documents counts how often each of these shingles occurs in them; only the counts are shuffled.
3. A window takes its rarest shingle as its prefix; one with a shingle that occurs nowhere is out. Shingles that are common
   in the corpus are no prefix of anything, and most windows of items that no document holds are gone.
4. A second pass probes the documents with the prefixes alone and writes the places with the few words around.
5. Places are joined with windows by the prefix. What would reach beyond the document's ends is out (length and position);
   the rest is compared word by word with the window. Confirmed windows become stretches of hit words.

In both passes the shingles looked for are literals of the query up to LITERALS. Above, the documents' shingles meet them in
a join by hash: rounds of BROADCAST_ROWS, each broadcast, for the counts. In step 5 windows are broadcast up to
BROADCAST_ROWS, else joined by shuffle, where Spark splits hot shingles.

Everything is built-in expressions. Defined cases: a null text has no words; a null item_id is kept as an item but cannot
be named in items; items with equal windows are all named; repeated documents are judged one by one; empty tables give no
hits; other columns are kept, clashing ones replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.exprs import ascii_lower, at, packed, split_words, text_of, unpacked
from quillmere.shared import materialise

WINDOW = 13
SHINGLE = 5
LITERALS = 50_000
BROADCAST_ROWS = 200_000
ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated")


def words_of(text: Column) -> Column:
    """Lower-cased runs of digits, ASCII letters and all beyond ASCII."""
    return split_words(ascii_lower(text_of(text)), "[\\x00-/:-`{-\\x7f]")


def _hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(at(words, i + j) for j in range(k)))


def windows_of(items: DataFrame, size: int, shingle: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: w (words joined by blanks), len, items (ids), and shingles, an array of (o, h)."""
    cut = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    each = cut.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, size))).alias("words"))
    each = each.groupBy("words").agg(F.collect_set("item").alias("items"))
    n = F.size("words")
    hashes = F.when(n >= shingle, F.transform(F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))), lambda o: F.struct(o.alias("o"), _hash(F.col("words"), o, shingle).alias("h"))))
    for k in range(1, shingle):
        hashes = hashes.when(n == k, F.array(F.struct(F.lit(0).alias("o"), _hash(F.col("words"), F.lit(0), k).alias("h"))))
    return each.select(F.concat_ws(" ", "words").alias("w"), n.alias("len"), "items", hashes.alias("shingles"))


def _literals(hashes: DataFrame) -> str:
    """Hashes, of a number that was checked, as SQL."""
    return ", ".join(f"{r['h']}L" if r["h"] != -(1 << 63) else "bigint('-9223372036854775808')" for r in hashes.select("h").collect()) or "NULL"


def _hashed(k: int) -> str:
    return f"xxhash64({k}, {', '.join(f'get(_words, i + {j})' for j in range(k))})"


def _shingles(k: int) -> Column:
    """(k, pos, h) of all shingles of k words."""
    n = F.size("_words")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.struct(F.lit(k).alias("k"), i.alias("pos"), _hash(F.col("_words"), i, k).alias("h")))
    return F.when(n >= k, each).otherwise(F.array().cast("array<struct<k:int,pos:int,h:bigint>>"))


def frequencies(words: DataFrame, hashes: DataFrame, lengths: list[int], literals: int, broadcast_rows: int) -> DataFrame:
    """(h, freq): how often these shingles occur in all documents (_words); written."""
    many = hashes.count()
    if many <= literals:
        wanted = _literals(hashes)
        found = [F.expr(f"CASE WHEN size(_words) >= {k} THEN filter(transform(sequence(0, size(_words) - {k}), i -> {_hashed(k)}), h -> h IN ({wanted})) ELSE array() END") for k in lengths]
        each = words.select(F.explode(F.concat(*found)).alias("h"))
    else:
        all_ = words.select(F.explode(F.concat(*map(_shingles, lengths))).alias("s")).select("s.h")
        rounds, each = -(-many // max(1, broadcast_rows)), None
        for r in range(rounds):
            part = lambda f, r=r: f.where(F.pmod("h", F.lit(rounds)) == r) if rounds > 1 else f
            own = part(all_).join(F.broadcast(part(hashes)), "h", "left_semi")
            each = own if each is None else each.unionByName(own)
    return materialise(each.groupBy("h").agg(F.count("*").alias("freq")), "shingle-counts", few=True)


def _places(words: DataFrame, hashes: DataFrame, lengths: list[int], size: int, literals: int) -> DataFrame:
    """_kept, _row, n_words and _hits: (pos, h, from, around) for each place of a prefix; written."""
    n = F.size("_words")

    def near(i: Column, k: Column, h: Column) -> Column:
        start = F.greatest(i - (F.lit(size) - k), F.lit(0))
        return F.struct(i.alias("pos"), h.alias("h"), start.alias("from"), F.slice("_words", start + 1, F.lit(2 * size) - k).alias("around"))

    if hashes.count() <= literals:
        wanted = _literals(hashes)
        spots = {k: F.expr(f"CASE WHEN size(_words) >= {k} THEN filter(sequence(0, size(_words) - {k}), i -> {_hashed(k)} IN ({wanted})) ELSE array() END") for k in lengths}
        step = words.select("_kept", "_words", *(s.alias(f"_at{k}") for k, s in spots.items()))
        around = lambda k: F.transform(f"_at{k}", lambda i: near(i, F.lit(k), _hash(F.col("_words"), i, k)))
        hits = [around(k) for k in lengths]
        step = step.select("_kept", n.cast("long").alias("n_words"), F.concat(*hits).alias("_hits"))
        return materialise(step.withColumn("_row", F.monotonically_increasing_id()), "places")
    words = materialise(words.withColumn("_row", F.monotonically_increasing_id()), "doc-words")
    all_ = words.select("_row", F.explode(F.concat(*map(_shingles, lengths))).alias("s")).select("_row", "s.*")
    some = all_.join(hashes, "h", "left_semi").groupBy("_row").agg(F.collect_list(F.struct("k", "pos", "h")).alias("_found"))
    back = words.join(some, "_row", "left")
    return materialise(back.select("_kept", n.cast("long").alias("n_words"), F.transform("_found", lambda s: near(s["pos"], s["k"], s["h"])).alias("_hits"), "_row"), "places")


def _covered(stretches: Column) -> Column:
    """Words that the sorted (start, len) cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(end - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"))

    return F.aggregate(stretches, zero, add, lambda a: a["n"])


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, shingle: int = SHINGLE, literals: int = LITERALS, broadcast_rows: int = BROADCAST_ROWS, keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep, which are written once) with n_words, n_hit, n_items (long), items (ids as strings, sorted) and contaminated (boolean)."""
    # the caller's columns travel in one, so that no name of theirs clashes with the steps'
    names = [c for c in (keep or docs.columns) if c not in ADDED]
    docs = docs.select(packed(names), F.col(f"`{text}`").alias("_text"))
    windows = materialise(windows_of(items, size, shingle, item_id, item_text), "windows", few=True)
    tokens = windows.select("w", "len", "items", F.explode("shingles").alias("s")).select("w", "len", "items", "s.o", "s.h")
    lengths = [r[0] for r in windows.select(F.least("len", F.lit(shingle)).alias("k")).distinct().orderBy("k").collect()] or [shingle]
    words = docs.select("_kept", words_of(F.col("_text")).alias("_words"))
    counts = frequencies(words.select("_words"), tokens.select("h").distinct(), lengths, literals, broadcast_rows)
    rarest = tokens.join(counts, "h", "left").groupBy("w").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "o", "h")).alias("s"), F.first("len").alias("len"), F.first("items").alias("items")
    )
    prefixes = materialise(rarest.where("s.freq > 0").select("w", "len", "items", "s.o", "s.h"), "prefixes", few=True)
    places = _places(words, prefixes.select("h").distinct(), lengths, size, literals)
    hits = places.select("_row", "n_words", F.explode("_hits").alias("p")).select("_row", "n_words", "p.*")
    if prefixes.count() <= broadcast_rows:
        prefixes = F.broadcast(prefixes)
    start = F.col("pos") - F.col("o")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.concat_ws(" ", F.slice("around", F.greatest(start - F.col("from") + 1, F.lit(1)), F.col("len"))) == F.col("w")
    found = hits.join(prefixes, "h").where(inside).where(same).select("_row", F.struct(start.alias("start"), F.col("len").alias("len")).alias("s"), "items")
    found = found.groupBy("_row").agg(F.array_sort(F.collect_set("s")).alias("s"), F.collect_set("items").alias("i"))
    found = found.select("_row", _covered(F.col("s")).alias("n_hit"), F.array_sort(F.transform(F.array_distinct(F.flatten("i")), lambda x: x.cast("string"))).alias("items"))
    out = places.drop("_hits").join(found, "_row", "left")
    out = out.select("_kept", "n_words", "n_hit", "items").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    out = out.select(*unpacked(names), "n_words", "n_hit", "items")
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})

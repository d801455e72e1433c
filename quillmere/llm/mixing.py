"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source size copies. The documents stand in order of size, so that the
sample is spread over all sizes; the expected copies are summed up along that order, one random offset is added, and a
document is emitted once for each integer that its stretch of the sum crosses. A source's taken words then differ from its
target by about one document. The order is global (ties go by a hash of the whole row) and the offset comes from a seed, so
reruns, and other partitionings, agree.

Sources are ranked, and their targets filled up, without gathering them: only two sums per round reach the driver. The
rows go through one range exchange and are written once; a source that holds most rows spreads over many ranges.

Defined cases: a null text has size 0; a null source is a source of its own and ranks last; documents of size 0 take part
and take no words; a source whose documents are all empty has target 0 and no copies; repeated rows are documents of their
own; an empty table gives an empty result; columns that clash with the added names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.exprs import packed, space_words, text_of, unpacked
from quillmere.operators.ranks import ranged, with_rank
from quillmere.shared import materialise

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
ADDED = ("size", "source_size", "target", "copies")


def n_words(text: Column) -> Column:
    return F.size(space_words(text_of(text))).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(_key, source_size) to the same with target: weights by rank, at most `most` times the size, the rest shared again."""
    table = with_rank(ranged(sources, [F.col("_key")], "mix-sources"), "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    table = materialise(table.select("_key", "source_size", weight.alias("_weight")), "mix-weights", few=True)
    total, shared = table.agg(F.sum("source_size"), F.sum("_weight")).first()
    left, full = total, 0
    while shared:
        above = F.lit(left).cast("decimal(38,0)") * F.col("_weight") > F.lit(most * shared).cast("decimal(38,0)") * F.col("source_size")
        now, taken, open_ = table.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("_weight")))).first()
        if now == full:
            break
        full, left, shared = now, total - (taken or 0), open_ or 0
    if not shared:
        return table.select("_key", "source_size", (F.col("source_size") * most).cast("double").alias("target"))
    above = F.lit(left).cast("decimal(38,0)") * F.col("_weight") > F.lit(most * shared).cast("decimal(38,0)") * F.col("source_size")
    share = (F.lit(left) * F.col("_weight")).cast("double") / F.lit(shared).cast("double")
    return table.select("_key", "source_size", F.when(above, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def mix(df: DataFrame, size: Column, source: str = "source", tie: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """df with size, source_size, target (of its source, in words) and copies (long, 0 to most)."""
    key = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))
    names = [c for c in df.columns if c not in ADDED]
    # the caller's columns travel in one, so that no name of theirs clashes; rows that tie in all else are equal
    kept = packed(names)
    rows = df.select(kept, key.alias("_key"), size.alias("size"), F.col(tie).alias("_tie"), F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if c in names and "map<" not in kind)).alias("_hash"))
    placed = ranged(rows, [F.col("_key"), F.col("size"), F.col("_tie"), F.col("_hash")], "mix")
    goal = targets(placed.groupBy("_key").agg(F.sum("size").alias("source_size")), weights, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_key"))), 1, 3), 16, 10).cast("double") / 4096.0
    goal = goal.select("_key", "source_size", "target", offset.alias("_offset"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_each"))
    ranks = with_rank(placed, "_rank", "_key").join(goal, "_key")
    reached = lambda rank: F.floor(F.col("_each") * rank + F.col("_offset"))
    copies = (reached(F.col("_rank") + 1) - reached(F.col("_rank"))).cast("long")
    return ranks.select(*unpacked(names), "size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy, with these columns."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")

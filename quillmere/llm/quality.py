"""Quality rules as a bitmask ledger.

ledger() evaluates every rule once and keeps, beside the measurements, one failure bit for each rule. Policies are
versioned masks over these bits, so accepting or rejecting under another policy, or asking what a rule alone rejects,
needs no text: decide() is one bitwise AND, ablations() sums bits over the distinct masks.

Everything is built-in expressions in one projection; nothing is shuffled but the few distinct masks of ablations().

Defined cases: a null text counts as empty (no words, no lines; it fails too_few_words); repeated rows are judged one by
one; an empty table gives an empty ledger; columns of the input whose names clash with the ledger's are replaced by the
ledger's, all others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.exprs import at, packed, space_words, text_of, unpacked

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  # SQL over the measurements


#: A bit keeps its meaning for ever; new rules get new bits.
RULES = (
    Rule("too_few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols_per_word", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "20 * n_dup_lines > 7 * n_lines"),
    Rule("short_words", 4, "word_chars < 3 * n_words"),
    Rule("long_words", 5, "word_chars > 10 * n_words"),
    Rule("exclamations", 6, "5 * n_exclaims > n_words"),
)
BITS = {r.name: 1 << r.bit for r in RULES}
BASE = BITS["too_few_words"] | BITS["repeated_windows"]

#: Masks by version. A document is kept under a policy if none of the policy's bits is set.
POLICIES = {
    "base": BASE,
    "v1": sum(BITS.values()),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims")


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _without(text: Column, what: str) -> Column:
    for c in what:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements.

    Repeated 3-word windows: each window start is one long, the window's hash above and its position below, so one sort of
    longs brings equal windows together. What is equal there is compared word by word, which makes the result exact; the
    words that the confirmed windows cover are counted from the gaps between their starts.
    """
    # the caller's columns travel in one, so that no name of theirs clashes with the steps'
    names = [c for c in df.columns if c not in MEASURES]
    kept = ["_kept"]
    body, words, n = F.col("_qm_text"), F.col("_qm_words"), F.col("_qm_n")
    step = df.select(packed(names), text_of(F.col(f"`{text}`")).alias("_qm_text"))
    step = step.select(*kept, body, space_words(body).alias("_qm_words"), F.filter(F.split(body, "\n"), lambda line: line.rlike("[^\\t-\\r ]")).alias("_qm_lines"))
    step = step.select(*kept, body, words, "_qm_lines", F.size(words).alias("_qm_n"))
    low = F.expr("shiftleft(1L, cast(ceil(log2(_qm_n + 1)) as int)) - 1L")
    step = step.select("*", low.alias("_qm_low"))
    sorted_ = F.when(
        n >= 4,
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(words, i), at(words, i + 1), at(words, i + 2)).bitwiseAND(F.bitwise_not(F.col("_qm_low"))).bitwiseOR(i.cast("long")))),
    )
    step = step.select("*", sorted_.alias("_qm_packed"))
    keys, position = F.col("_qm_packed"), F.col("_qm_low")
    same = lambda a, b: F.coalesce(a.bitwiseXOR(b) <= position, F.lit(False)) & F.coalesce(a.bitwiseXOR(b) >= 0, F.lit(False))
    suspects = F.filter(keys, lambda x, i: same(x, at(keys, i - 1)) | same(x, at(keys, i + 1)))
    step = step.select("*", suspects.alias("_qm_suspects"))
    window = lambda p: F.concat_ws(" ", at(words, p), at(words, p + 1), at(words, p + 2))
    spelled = F.when(F.size("_qm_suspects") > 0, F.array_sort(F.transform("_qm_suspects", lambda x: F.struct(window(x.bitwiseAND(position).cast("int")).alias("w"), x.bitwiseAND(position).cast("int").alias("p")))))
    step = step.select("*", spelled.alias("_qm_spelled"))
    pairs = F.col("_qm_spelled")
    starts = F.sort_array(F.transform(F.filter(pairs, lambda x, i: F.coalesce(x["w"] == at(pairs, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == at(pairs, i + 1)["w"], F.lit(False))), lambda x: x["p"]))
    step = step.select("*", starts.alias("_qm_starts"))
    first = F.col("_qm_starts")
    gaps = F.aggregate(F.transform(first, lambda p, i: F.least(F.lit(3), F.coalesce(at(first, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return step.select(
        *unpacked(names),
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        (F.length(body) - F.length(_without(body, SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("_qm_lines").cast("long").alias("n_lines"),
        (F.size("_qm_lines") - F.size(F.array_distinct("_qm_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(gaps, F.lit(0)).cast("long").alias("n_repeat_words"),
        _count(body, "!").cast("long").alias("n_exclaims"),
    )


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measurements and fail_bits (long): bit k is set if the rule with bit k fails."""
    measured = measure(df.drop("fail_bits"), text)
    # always 0, but not deterministic: else the optimizer would move filters on the result below the measurements and so
    # unfold these into one expression that measures again and again
    bits = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BITS[rule.name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def decide(ledgered: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds kept (boolean) under a policy, from the bits alone."""
    return ledgered.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(ledgered: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the policy without it would keep.

    The ledger is first reduced to counts by mask, at most 2 ** rules rows, before any rule looks at it.
    """
    mask = POLICIES[policy]
    counts = ledgered.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if BITS[r.name] & mask]
    one = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(BITS[r.name]).cast("long").alias("bit"))
    each = counts.select("bits", "n", F.explode(F.array(*map(one, rules))).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )

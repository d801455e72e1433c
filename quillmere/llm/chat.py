"""Chat formatting with a grammar that is proved by reparsing.

A conversation is rendered as

    <s>[TURN role]text[/TURN] ... </s>            text as it is
    <s>[TURN! role]text[/TURN] ... </s>           text escaped

and parse() recovers the turns by splitting at the control strings alone; a control string inside a text, this template's or
another's, is an error of the grammar. Rendering starts without escapes, is parsed back
and compared with the source; a conversation whose turns do not come back identical has the conflicting turns escaped, is
parsed and compared again, and is at last rendered with all turns escaped. Escaping doubles backslashes and puts one inside
each control string, so no text contains one; it is undone by the reverse. Roles are percent-encoded where they hold a
bracket, < or %. `identical` says that the comparison held.

Everything is built-in expressions: one aggregation brings a conversation's turns together, all else is one projection.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own; turns stand in order of turn
(nulls first), then role, then text, so repeated turns have a fixed order; a conversation is one row and so must fit into
memory; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings. No one is part of another, and none contains a backslash.
BEGIN, END, CLOSE, OPEN, OPEN_ESCAPED, OPEN_END = "<s>", "</s>", "[/TURN]", "[TURN ", "[TURN! ", "]"
#: Control strings of other templates are escaped as well, so that a text cannot speak for them.
FOREIGN = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
CONTROLS = (BEGIN, END, CLOSE, OPEN, OPEN_ESCAPED, *FOREIGN)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    for c in reversed(CONTROLS):
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


#: Characters of roles that begin a control string or end the opening of a turn, and what stands for them. The first one is
#: what the others are spelled with.
ROLE_MARKS = (("%", "%25"), ("[", "%5B"), ("]", "%5D"), ("<", "%3C"))


def escape_role(role: Column) -> Column:
    for c, mark in ROLE_MARKS:
        role = F.replace(role, F.lit(c), F.lit(mark))
    return role


def unescape_role(role: Column) -> Column:
    for c, mark in reversed(ROLE_MARKS):
        role = F.replace(role, F.lit(mark), F.lit(c))
    return role


def conflicts(text: Column) -> Column:
    out = F.lit(False)
    for c in CONTROLS:
        out = out | F.contains(text, F.lit(c))
    return out


def render(turns: Column, level: int) -> Column:
    """turns: array of (role, text). Level 0 escapes nothing, level 1 the texts with control strings, level 2 every text."""

    def one(t: Column) -> Column:
        role = escape_role(t["role"])
        plain = F.concat(F.lit(OPEN), role, F.lit(OPEN_END), t["text"], F.lit(CLOSE))
        escaped = F.concat(F.lit(OPEN_ESCAPED), role, F.lit(OPEN_END), escape(t["text"]), F.lit(CLOSE))
        return plain if level == 0 else escaped if level == 2 else F.when(conflicts(t["text"]), escaped).otherwise(plain)

    return F.concat(F.lit(BEGIN), F.array_join(F.transform(turns, one), ""), F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, as an array of (role, text); null if it does not follow the grammar."""
    body = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted) - len(BEGIN) - len(END))
    # the part behind the last close is empty
    parts = F.split(body, "\\[/TURN\\]", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(p: Column) -> Column:
        escaped = F.startswith(p, F.lit(OPEN_ESCAPED))
        head = F.when(escaped, F.lit(len(OPEN_ESCAPED))).otherwise(F.lit(len(OPEN)))
        stop = F.instr(p, OPEN_END)
        role = F.substring(p, head + 1, stop - head - 1)
        text = F.substring(p, stop + 1, F.length(p))
        sound = (escaped | F.startswith(p, F.lit(OPEN))) & (stop > head) & ~conflicts(text)
        return F.when(sound, F.struct(unescape_role(role).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text")))

    sound = F.startswith(formatted, F.lit(BEGIN)) & F.endswith(formatted, F.lit(END))
    return F.when(sound, F.transform(parts, one))


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, an array of (role, text) in order."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    each = F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(each)).alias("_turns"))
    return grouped.select("conv_id", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_chats(rows: DataFrame, **names: str) -> DataFrame:
    """conv_id, turns, formatted, level (of escaping) and identical (the reparsed turns are the source's)."""
    convs = conversations(rows, **names)
    tried = convs.select("conv_id", "turns", render(F.col("turns"), 0).alias("_0"))
    tried = tried.select("*", parse(F.col("_0")).eqNullSafe(F.col("turns")).alias("_ok0"))
    tried = tried.select("*", F.when(~F.col("_ok0"), render(F.col("turns"), 1)).alias("_1"))
    tried = tried.select("*", F.when(~F.col("_ok0"), parse(F.col("_1")).eqNullSafe(F.col("turns"))).alias("_ok1"))
    level = F.when(F.col("_ok0"), 0).when(F.col("_ok1"), 1).otherwise(2)
    done = tried.select("conv_id", "turns", F.when(F.col("_ok0"), F.col("_0")).when(F.col("_ok1"), F.col("_1")).otherwise(render(F.col("turns"), 2)).alias("formatted"), level.alias("level"), "_ok0", "_ok1")
    sure = F.coalesce(F.col("_ok0") | F.col("_ok1"), F.lit(False)) | parse(F.col("formatted")).eqNullSafe(F.col("turns"))
    return done.select("conv_id", "turns", "formatted", "level", sure.alias("identical"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """What the loss mask covers: the texts of this role, one after the other."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")

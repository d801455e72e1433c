import random

from quillmere.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def test_round_trip_of_hostile_turns(spark):
    rng = random.Random(5)
    pieces = [*chat.CONTROLS, "\\", "\\\\", "<\\s>", "<\\", "[", "]", "TURN", " ", "\n", "é", "a", "<s", "/s>", "[/INST", "\\_", "!"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys]tem", "[TURN x", None, "a\\b", "a\\_b", "%5D", "a%", "<s>", "]"]), rng.choice([None, "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))])) for c in range(300) for t in range(rng.randrange(1, 5))]
    rows += [(900, 0, "user", "plain"), (900, 0, "user", "plain"), (None, None, "user", "x" * 50_000)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, ROWS)).withColumn("back", chat.parse(chat.F.col("formatted"))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c])
        want = [(r, t) for _, _, r, t in turns]
        assert [tuple(t) for t in got[c]["turns"]] == want and [tuple(t) for t in got[c]["back"]] == want and got[c]["identical"]
        inner = got[c]["formatted"][len(chat.BEGIN) : -len(chat.END)]
        assert not any(x in inner for x in (chat.BEGIN, chat.END, *chat.FOREIGN))
    assert got[900]["level"] == 0 and {r["level"] for r in got.values()} >= {0, 1}


def test_the_main_path_is_native_and_empty_tables_pass(spark):
    done = chat.format_chats(spark.createDataFrame([], ROWS))
    assert done.collect() == []
    assert "Python" not in done._jdf.queryExecution().executedPlan().toString()


def test_broken_text_does_not_parse(spark):
    bad = ["<s>[TURN user]a</s>x", "<s>[TURN user]a<s>[/TURN]</s>", "<s>user]a[/TURN]</s>", "[TURN user]a[/TURN]"]
    rows = spark.createDataFrame([(b,) for b in bad], "f string").select(chat.parse(chat.F.col("f")).alias("t")).collect()
    assert all(r["t"] is None or None in r["t"] for r in rows)


def test_other_columns_may_clash(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", "x", 3)], ROWS + ", formatted string, level int")
    assert chat.format_chats(rows).select("formatted", "level").first() == ("<s>[TURN user]a[/TURN]</s>", 0)

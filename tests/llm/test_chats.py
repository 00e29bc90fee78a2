"""Quotations and reply order."""

from catalens.llm import chat_format
from catalens.llm.query_chats import _OP9_SQL
from compare import compare

import random

COLUMNS = [
    "conv_id", "turn", "role", "own_text", "n_quoted", "parent_turn", "thread_turn", "depth", "formatted",
]


def test_quoting_conversations_equal_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    rows = []
    for conv in range(12):
        own = []
        for turn in range(12):
            me = f"Line A {rng.randrange(6)} {conv}\n  line  B{rng.randrange(50)}\nend {rng.randrange(9)}."
            text = me
            if turn and rng.random() < 0.8:
                lines = own[rng.randrange(turn)].split("\n")[: rng.choice([1, 3])]
                level = rng.choice(["> ", ">", "> > ", ">> "])
                text = "On Monday X wrote:\n" + "\n".join(level + x.upper() for x in lines)
                text += f"\n>>> {own[0].split(chr(10))[0]}" if rng.random() < 0.3 else ""
                text += "\n\n" + me
            own.append(me)
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), text))
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats.coalesce(1).write.parquet(str(tmp_path / "chats"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/chats/*.parquet'")
    n, problems = compare(chat_format.format_chats(chats).select(*COLUMNS), con, _OP9_SQL)
    assert n == len(rows) and not problems, problems


def test_threads_and_odd_rows(spark):
    rows = [
        (1, 0, "u", "Hello there\nfriend"), (1, 1, "a", "> hello  THERE\n> friend\nhi"),
        (1, 2, "u", ">> hello there\n> hi\nOn it went:\nyes"), (1, 3, None, "> not said by anyone\nx"),
        (1, 4, "u", None), (1, 4, "u", None), (None, 1, "u", "> hi\nb"), (1, None, "u", "x"),
        (2, 1, "u", "> later\nfirst"), (2, 2, "u", "later"), (2, 3, "u", ">" * 300 + " deep"),
    ]
    chats = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, Depth int")
    got = chat_format.format_chats(chats).collect()
    assert len(got) == len(rows) and "_depth" in got[0].asDict()
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].parent_turn for t in range(5)] == [None, 0, 1, None, None]
    assert [by[1, t].thread_turn for t in range(5)] == [0, 0, 0, 3, 4]
    assert [by[1, t]["_depth"] for t in range(5)] == [0, 1, 2, 0, 0]
    assert by[1, 2].own_text == "On it went:\nyes" and by[1, 1].formatted == "<|a|>\nhi\n"
    assert by[2, 1].parent_turn is None and by[None, 1].thread_turn == 1
    assert chat_format.format_chats(chats.filter("false")).count() == 0

import duckdb
import pandas as pd

from waymark.llm import quotes as Q

TALK = [
    (1, 0, "a", "Shall we meet on Monday?\n\nI can do any time\nafter nine."),
    (1, 1, "b", "> Shall we meet on Monday?\n\nYes, let us."),
    (1, 2, "c", "On Sunday, b wrote:\n\n>> Shall we meet on MONDAY?\n> Yes, let  us.\n\nI cannot come."),
    (1, 3, "d", "No quotes here: 3 > 2\nwrote:"),
    (1, 4, "a", "> I can do any time\n> after nine.\n> I cannot come.\nWhy not?\n> No source for this"),
    (1, 5, "e", ">>> Shall we meet on Monday?\r\n\r\n> > I cannot\r\n> > come.\r\nTrue"),
    (1, 6, "e", ">"),
    (1, 6, "e", "> Why not?"),
    (1, 6, "e", "> Why not?"),
    (1, 7, "f", "> Why not?\n> I cannot come."),
    (2, 0, "a", "> Shall we meet on Monday?"),
    (2, 1, "a", None),
    (2, 2, "a", ""),
    (2, 3, None, "> later\n"),
    (2, 4, "a", "later"),
    (None, 1, "a", "> Shall we meet on Monday?\nx"),
    (3, None, "a", "> q\nx"),
    (4, 0, "a", "> " * 4000 + "deep\n" + "word\n" * 3000),
]


def pairs(rows):
    return {(r.conv_id, r.turn): r for r in rows}


def test_links_threads_and_order(spark):
    frame = spark.createDataFrame([(*r, "x", 1) for r in TALK], "conv_id long, turn long, role string, text string, level string, unit int")
    rows = Q.link_quotes(frame).collect()
    got = pairs(rows)
    assert {k: r.reply_to for k, r in got.items() if r.reply_to is not None} == {(1, 1): 0, (1, 2): 1, (1, 4): 0, (1, 5): 2, (1, 6): 4, (1, 7): 2}
    assert got[1, 2].text == "I cannot come." and got[1, 1].text == "Yes, let us." and got[1, 3].text == TALK[3][3] and got[1, 4].text == "Why not?"
    assert (got[1, 4].n_quotes, got[1, 4].n_linked) == (2, 1) and got[1, 5].thread_turn == 0
    talk = sorted((r.position, r.thread_turn, r.turn) for r in rows if r.conv_id == 1)
    assert [p for p, _, _ in talk] == list(range(10)) and [t for _, _, t in talk] == [0, 1, 2, 4, 5, 6, 6, 6, 7, 3]
    assert got[2, 1].text is None and got[2, 0].text == "" and got[2, 3].n_linked == 0
    assert got[None, 1].position is None and got[3, None].position is None and len(rows) == len(TALK)
    assert Q.link_quotes(frame.limit(0)).count() == 0


def test_sql_says_the_same(spark):
    talk = [r for r in TALK if r[0] is not None and r[1] is not None]
    talk += [(c, t + 20, r, x if x is None else "".join(f"> {y}\n" for y in x.split("\n")) + f"reply {t}") for c, t, r, x in talk[:8]]
    frame = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(talk, columns=["conv_id", "turn", "role", "text"]))
    result = con.sql(Q.ORACLE)
    columns = result.columns
    want = sorted(map(repr, result.fetchall()))
    got = sorted(repr(tuple(r[c] for c in columns)) for r in Q.link_quotes(frame).collect())
    assert got == want

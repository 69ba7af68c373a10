"""Rows that blocks of all pairs send: a query once for each of its cells, a place once for a part of the queries."""

import pyarrow as pa

from waymark.operators import search
from waymark.plans import fixture as X

SF = "/root/testdata/sf0.001"


def sent(frame, column):
    return [(r.cell, r.part, pa.ipc.open_stream(r[column]).read_all().num_rows) for r in frame.collect()]


def check(spark, monkeypatch, spaces, more):
    monkeypatch.setattr(search, "PAIR_PLACES", 7)
    monkeypatch.setattr(search, "PAIR_QUERIES", 3)
    monkeypatch.setattr(search, "PAIR_PART", 4)
    q, g, p = X.queries(spark, SF), X.gated(spark, SF), X.places(spark, SF)
    left, right = search._blocks(q, g, p, spaces, more)
    own, of = sent(left, "own"), sent(right, "of")
    assert sum(n for *_, n in own) == g.count()
    sizes, asked = ({r.cell: r["count"] for r in t.groupBy("cell").count().collect()} for t in (p, g))
    parts = {c: -(-(-(-n // 3)) // 4) for c, n in asked.items()}
    assert sum(n for *_, n in of) == sum(n * parts.get(c, 0) for c, n in sizes.items())
    assert max(parts.values()) > 1 and {(c, i) for c, i, _ in own} <= {(c, i) for c, i, _ in of}


def test_dequant_dot_sends_each_query_of_a_cell_once(spark, monkeypatch):
    check(spark, monkeypatch, ["cls"], [])


def test_blend_score_sends_each_query_of_a_cell_once(spark, monkeypatch):
    check(spark, monkeypatch, search.shared_spaces(X.RECIPE, X.queries(spark, SF), X.places(spark, SF)), ["csls"])

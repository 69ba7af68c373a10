"""Queries answer for whole tables, at a size beyond the first few thousand keys."""

import duckdb

from waymark.plans import queries

SF = "/root/testdata/sf0.01"


def test_every_order_has_a_shard_place(spark):
    got = queries.queries()["shard_order"](spark, SF).collect()
    want = duckdb.sql(f"SELECT o_custkey % 12, o_orderkey FROM '{SF}/orders.parquet' ORDER BY 1, 2").fetchall()
    assert len(want) == 15_000
    assert sorted((r.row, r.shard, r.i) for r in got) == [(k, *x) for k, x in enumerate(want)]


def test_every_supplier_name_is_looked_up(spark):
    got = queries.queries()["homonym_lookup"](spark, SF).collect()
    suppliers = duckdb.sql(f"SELECT s_suppkey, s_name FROM '{SF}/supplier.parquet'").fetchall()
    # rank and population as in plans.fixture.settlements and worldmap.clamp_rank
    places = sorted((min(k % 17, 14) if k % 11 else 14, -(k * 1000 % 70001 if k % 13 else 0), name) for k, name in suppliers)
    want = []
    for k, name in suppliers:
        asked = name if k % 2 == 0 else name[:5] + "?"
        exact = [p[2] for p in places if p[2] == asked]
        begun = [p[2] for p in places if p[2][:5] == asked[:5]]
        want.append((asked, (exact + begun + [None])[0]))
    assert len(want) == 100
    assert sorted((r.asked, r.name) for r in got) == sorted(want)

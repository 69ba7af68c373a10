"""Hubness against all places: no sample decides which places are found."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from waymark.operators import index
from waymark.plans import oracle, queries

ROWS, DIM = 5800, 64


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """More places than the sample of 5,000 rows has."""
    path = tmp_path_factory.mktemp("many")
    v = np.random.default_rng(4).normal(size=(ROWS, DIM)).astype("float32")
    table = {"vec_id": pa.array(np.arange(ROWS)), "embedding": pa.array(list(v), pa.list_(pa.float32())), "label": pa.array(np.zeros(ROWS), pa.int32())}
    pq.write_table(pa.table(table), path / "embeddings.parquet")
    return str(path)


def by_sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return {(q, rank): (row, s) for q, row, rank, s in con.execute(oracle.oracle_sql()[name]).fetchall()}


def test_topk_20_is_its_sql_beyond_the_sample(spark, folder):
    want = by_sql(folder, "topk_20")
    got = {(r.qid, r["rank"]): (r.row, r.s) for r in queries.queries()["topk_20"](spark, folder).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert "LIMIT" not in oracle.oracle_sql()["topk_20"]


def test_topk_candidates_begin_with_the_twenty(spark, folder):
    names = ["qid", "rank", "row", "s"]
    twenty = sorted(map(tuple, queries.queries()["topk_20"](spark, folder).select(names).collect()))
    found = queries.queries()["topk_candidates"](spark, folder).select(names)
    assert sorted(map(tuple, found.where("rank < 20").collect())) == twenty and found.where("rank = 99").count() > 0
    assert "LIMIT" not in oracle.oracle_sql()["topk_candidates"]


@pytest.mark.parametrize("block, group", [(4096, 16), (7, 2), (300, 1)])
def test_hubness_of_all_rows(spark, monkeypatch, block, group):
    monkeypatch.setattr(index, "HUB_BLOCK", block)
    monkeypatch.setattr(index, "HUB_GROUP", group)
    v = np.random.default_rng(5).normal(size=(100 if block == 7 else 900, 3))
    v[5] = v[6]
    rows = spark.createDataFrame([(f"r{i}", x[:2].tolist(), x.tolist()) for i, x in enumerate(v)], "row string, a array<double>, b array<double>").repartition(3)
    got = {r.row: r.csls for r in index.hubness_of_all(rows, ["a", "b"], top=5).collect()}
    want = np.stack([np.sort(x @ x.T, axis=1)[:, -5:].mean(axis=1) for x in (v[:, :2], v)], axis=1)
    assert len(got) == len(v) and np.allclose([got[f"r{i}"] for i in range(len(v))], want, atol=1e-12)
    few = index.hubness_of_all(rows.where("row in ('r1', 'r2')"), ["b"], top=5).collect()
    assert sorted(round(r.csls[0], 9) for r in few) == sorted(np.round((v[1:3] @ v[1:3].T).mean(axis=1), 9))
    assert index.hubness_of_all(rows.limit(0), ["a"]).count() == 0


def test_no_number_counts_as_the_largest():
    own, of = np.array([[1.0], [2.0]]), np.array([[1.0], [np.nan], [3.0]])
    assert np.isnan(index._larger(np.array([[5.0, 6.0], [0.0, 1.0]]), own, of, 2)).any(axis=1).all()


def test_what_is_held_of_a_block_meets_the_next():
    rng = np.random.default_rng(6)
    own, of = rng.normal(size=(300, 4)), rng.normal(size=(500, 4))
    held = np.empty((300, 0))
    for at in range(0, 500, 6):
        held = index._larger(held, own, of[at : at + 6], 10)
    assert np.allclose(np.sort(held), np.sort(own @ of.T, axis=1)[:, -10:])


def test_the_other_queries_keep_their_sql():
    assert all("LIMIT 5000" in oracle.oracle_sql()[name] for name in ("csls_topk_mean", "blend_score"))
    assert {"topk_20", "topk_candidates"} <= queries.queries().keys()

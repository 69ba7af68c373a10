"""Every query of the place search against its SQL, and the plans' shape."""

import math

import duckdb
import pytest

from waymark.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle.SELECTS))
def test_query_is_its_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == want


def test_queries_without_sql(spark):
    for name in sorted(queries.queries().keys() - oracle.SELECTS.keys()):
        assert queries.queries()[name](spark, SF).count() > 0

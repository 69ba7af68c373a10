import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations".split()


def norm(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


@pytest.fixture
def sql_rows(spark):
    """Hold a registered query against its SQL over whole tables."""

    def hold(query, sql, folder="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        found = query(spark, folder)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(found.columns)
        want = sorted((tuple(norm(row[names.index(c)]) for c in found.columns) for row in result.fetchall()), key=repr)
        assert sorted((tuple(map(norm, r)) for r in found.collect()), key=repr) == want and want

    return hold

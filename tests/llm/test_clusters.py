import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import clusters
from waymark.llm.queries import oracle_sql, queries


def brute(rows, k, rounds, dim, scale=256, seed=2):
    """rows: (vec_id, list). In Python's integers, one vector and centroid at a time."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        home = [near(q)[1] for _, q in kept]
        for j in range(len(centroids)):
            own = [q for (_, q), h in zip(kept, home) if h == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    long = lambda x: x if x <= clusters.LONG else None
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    return [(i, c, long(d), long(inertia[c]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, distance string")


def check(spark, rows, k=5, rounds=3, dim=4):
    found = clusters.centroid_clusters(frame(spark, rows).repartition(3), k=k, rounds=rounds, dim=dim).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute(rows, k, rounds, dim), key=repr)
    return found


def test_equals_integers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).round(3).tolist()) for i in range(300)]
    assert len(check(spark, rows)) == 300


@pytest.mark.parametrize("size", [2.0**14, 2.0**20, 2.0**26, 2.0**40, 1e30, 1e300])
def test_equals_integers_beyond_exact_products(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * (size if i % 3 else 1.0)).tolist()) for i in range(60)]
    check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(i, [i % 3 + 0.1, -0.001, 0.0, -7.5]) for i in range(9)] + [(2, [5.0, 5.0, 5.0, 5.0]), (2, [5.0, 5.0, 5.0, 5.0]), (None, [0.0, 0.0, 0.0, 0.0])]
    odd = [(20, None), (21, []), (22, [1.0]), (23, [1.0, nan, 0.0, 0.0]), (24, [inf, 0.0, 0.0, 0.0]), (25, [None, 0.0, 0.0, 0.0]), (26, [0.0] * 5)]
    assert len(check(spark, fine + odd)) == len(fine)
    assert len(check(spark, fine + odd, k=100)) == len(fine)


def test_ties_and_empty_clusters(spark):
    check(spark, [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(12)] + [(99, [-1.0, 0.0, 0.0, 0.0])])


def test_nothing_to_cluster(spark):
    assert clusters.centroid_clusters(frame(spark, [(1, [1.0])])).count() == 0
    assert clusters.centroid_clusters(frame(spark, [(1, [1.0])]).limit(0)).count() == 0
    only = clusters.centroid_clusters(frame(spark, [(None, [1.0, 2.0])]), dim=2).collect()
    assert [tuple(r) for r in only] == [(None, 0, None, None, None, None)]


def test_parts_by_magnitude():
    rows = np.array([[1.0] * 64, [2.0**18] * 64, [2.0**30] * 64])
    parts = list(clusters.nearest(rows, [[0] * 64]))
    assert [(p[1].dtype.kind, p[0].tolist()) for p in parts] == [("f", [0]), ("i", [1]), ("O", [2])]
    assert [int(p[3][0]) for p in parts] == [64 * int(x * 256) ** 2 for x in (1.0, 2.0**18, 2.0**30)]


def test_registered_query(spark, sql_rows):
    sql_rows(queries()["op12_centroids"], oracle_sql()["op12_centroids"])
    found = queries()["op12_centroids"](spark, "/root/testdata/sf0.001")
    total = found.agg(F.sum("distance"), F.max("inertia"), F.min("inertia")).first()
    assert total[0] == total[1] == total[2]

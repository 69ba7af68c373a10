"""Points by edges on squares against whole rings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import edgeindex, worldmap
from waymark.plans import fixture as X

SF = "/root/testdata/sf0.001"


def star(cx, cy, n, seed, size=9.0):
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = size * rng.uniform(0.4, 1.0, n)
    return [(float(cx + a * np.cos(t)), float(cy + a * np.sin(t))) for a, t in zip(r, angle)]


def features(spark):
    """Stars with holes, some over each other, one dense, one on the lines of the grid."""
    rows = [(i, [star(-60 + 13 * i, 10 * (i % 3) - 20, 40, i), star(-60 + 13 * i, 10 * (i % 3) - 20, 12, i + 50, 3.0)], f"f{i}") for i in range(9)]
    rows.append((20, [star(100, 30, 600, 7, 6.0)], "dense"))
    on = edgeindex.SHIFT
    rows.append((21, [[(120 + on, 0 + on), (130 + on, 0 + on), (130 + on, 5 + on), (135 + on, 10 + on), (120 + on, 10 + on)]], "lines"))
    rows.append((22, [[]], "none"))
    out = spark.createDataFrame(rows, "feature_id long, rings array<array<struct<lon:double,lat:double>>>, name string")
    return worldmap.boxes(out, pad=0.0)


def points(spark, n=800):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.uniform(-45, 50)), float(rng.uniform(-90, 150))) for i in range(n)]
    rows += [(n + i, 30 + float(rng.uniform(-7, 7)), 100 + float(rng.uniform(-7, 7))) for i in range(n)]
    on = edgeindex.SHIFT  # on lines and corners of squares, and of the feature that lies on them
    rows += [(3 * n + 10 * i + j, 2.5 * j + on, 115 + 2.5 * i + on) for i in range(10) for j in range(6)]
    return spark.createDataFrame(rows, "point_id long, lat double, lon double")


@pytest.fixture(scope="module")
def both(spark):
    f = features(spark)
    return f, edgeindex.edge_index(f, most=32)


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_containing_as_by_rings(spark, both):
    f, index = both
    p = points(spark)
    want = rows_of(worldmap.containing_by_rings(p, f))
    assert rows_of(edgeindex.containing(p, index)) == want and len({r[1] for r in want}) > 9
    assert any(r[2] == "lines" for r in want)


@pytest.mark.parametrize("device", [False, True])
def test_nearest_as_by_rings(spark, both, device):
    f, index = both
    p = points(spark, 200).unionByName(spark.createDataFrame([(90001, 89.99, 100.0), (90002, -35.0, -60.0)], "point_id long, lat double, lon double"))
    for km in (50.0, 300.0):
        want = rows_of(worldmap.nearest_coast_by_rings(p, f, km, device))
        assert rows_of(edgeindex.nearest_coast(p, index, km, device)) == want and len(want) > 30


def test_squares_are_bounded(spark, both):
    f, index = both
    held = index.rows.groupBy("level", "gx", "gy").agg(F.sum(F.size("edges")).alias("n"))
    assert held.agg(F.max("n")).first()[0] <= 32 and max(index.levels) > 2
    # a square is a leaf or was split, never both
    cells = {(r.level, r.gx, r.gy) for r in held.collect()}
    assert not any((0, x >> level, y >> level) in cells for level, x, y in cells if level)


def test_no_ring_is_joined(spark, both):
    _, index = both
    p = points(spark, 50)
    for df in (edgeindex.containing(p, index), edgeindex.nearest_coast(p, index), worldmap.country_at(p, index)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "rings" not in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_edges_that_cannot_be_split(spark):
    """More edges at one point than a square may have: they stay together in the smallest."""
    fan = [[(float(np.cos(t)), float(np.sin(t))) if k % 2 else (0.3, 0.3) for k, t in enumerate(np.linspace(0, 6, 40))]]
    f = worldmap.boxes(spark.createDataFrame([(1, fan, "fan")], "feature_id long, rings array<array<struct<lon:double,lat:double>>>, name string"), 0.0)
    index = edgeindex.edge_index(f, most=4, levels=3)
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([(i, float(rng.uniform(-1, 1)), float(rng.uniform(-1, 1))) for i in range(500)], "point_id long, lat double, lon double")
    assert rows_of(edgeindex.containing(p, index)) == rows_of(worldmap.containing_by_rings(p, f))


def test_empty(spark, both):
    f, index = both
    none = edgeindex.edge_index(f.limit(0))
    p = points(spark, 10)
    assert edgeindex.containing(p, none).count() == edgeindex.nearest_coast(p, none).count() == 0
    assert edgeindex.containing(p.limit(0), index).count() == 0


def test_all_points_of_the_tables(spark):
    f, p = X.features_of_nations(spark, SF), X.points(spark, SF)
    index = X.nation_index(spark, SF)
    assert rows_of(edgeindex.containing(p, index)) == rows_of(worldmap.containing_by_rings(p, f))
    assert rows_of(edgeindex.nearest_coast(p, index, 200.0)) == rows_of(worldmap.nearest_coast_by_rings(p, f, 200.0))

"""The nearest places by leaves, against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_KM
from waymark.operators import search


def by_all_pairs(points, places, k):
    """By numpy, in the order of the operator's own terms: equal distances are equal to the last bit."""
    rows = np.array([r[0] for r in places])
    a, b = np.radians([r[1] for r in places]), np.radians([r[2] for r in places])
    found = {}
    for q, lat, lon in points:
        p, l = np.radians(lat), np.radians(lon)
        half = np.sin((a - p) / 2) ** 2 + np.cos(p) * np.cos(a) * np.sin((b - l) / 2) ** 2
        km = 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(half, 0, 1)))
        found[q] = [(km[i], rows[i]) for i in np.lexsort((rows, km))[:k]]
    return found


@pytest.mark.parametrize("k", [1, 4, 900])
def test_nearest_by_leaves(spark, monkeypatch, k):
    rng = np.random.default_rng(5)
    at = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 250), rng.uniform(-180, 180, 250))]
    at += [(float(a), float(b)) for a, b in rng.normal((48.0, 11.0), 0.01, (150, 2))]
    at += [(90.0, 0.0), (90.0, 120.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0), (0.0, -179.9), (10.0, 20.0)] + [(48.0, 11.0)] * 40
    numbered = [((i * 7919) % 10007, *p) for i, p in enumerate(at)]
    places = spark.createDataFrame(numbered, "row long, lat double, lon double").repartition(3)
    asked = [(0.0, 179.95), (89.9, -60.0), (-89.0, 100.0), (48.0, 11.0), (48.001, 11.002), (-10.0, -160.0), *((float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 30), rng.uniform(-180, 180, 30)))]
    named = [(f"q{i}", *p) for i, p in enumerate(asked)]
    points = spark.createDataFrame(named, "qid string, lat double, lon double")
    want = by_all_pairs(named, numbered, k)
    monkeypatch.setattr(search, "LEAF", 16)
    monkeypatch.setattr(search, "PASS_POINTS", 5)
    got = {}
    for r in search.nearest(points, places, k).collect():
        got.setdefault(r.qid, []).append((r.km, r.row))
    assert got.keys() == want.keys()
    for q, rows in got.items():
        assert np.allclose([x[0] for x in sorted(rows)], [x[0] for x in want[q]], rtol=0, atol=1e-7)
        last = want[q][-1][0] - 1e-7  # what is nearer than the last must be there; equal to the last bit only when computed alike
        assert {x[1] for x in rows if x[0] < last} == {x[1] for x in want[q] if x[0] < last} and len(rows) == len(want[q])


def test_a_point_meets_few_leaves(spark, monkeypatch):
    monkeypatch.setattr(search, "LEAF", 64)
    places = spark.range(25600).select(F.col("id").alias("row"), ((F.col("id") % 160) / 160.0 - 0.5).alias("phi"), (F.floor(F.col("id") / 160) / 160.0).alias("lam"))
    leaves = search._leaves(places)
    points = spark.range(50).select(F.col("id").alias("qid"), (F.col("id") / 100 - 0.3).alias("phi"), F.lit(0.4).alias("lam"))
    assert leaves.groupBy("leaf").count().count() >= 400
    assert search._visits(points, leaves, 3).count() <= 50 * 30
    assert search.nearest(points.select("qid", F.col("phi").alias("lat"), F.col("lam").alias("lon")), places.limit(0).select("row", F.col("phi").alias("lat"), F.col("lam").alias("lon")), 3).count() == 0

"""Simplified borders against loops over all pairs of segments."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import simplify

SCHEMA = "feature_id long, rings array<array<struct<lon:double,lat:double>>>, name string"


def wavy(a, b, n, seed, height=0.3):
    """Points from a to b, both included, with some noise; the same whichever way one asks."""
    turned = b < a
    a, b = (b, a) if turned else (a, b)
    rng = np.random.default_rng([seed, *(int(100 * x) + 10_000 for x in (*a, *b))])
    t = np.linspace(0, 1, n)[:, None]
    p = np.array(a) + t * (np.array(b) - np.array(a))
    # nearer to the ends the noise is less, so that borders do not meet at corners
    p[1:-1] += rng.uniform(-height, height, (n - 2, 2)) * np.abs(np.array([b[1] - a[1], b[0] - a[0]]) / 4) * np.minimum(1, 4 * np.minimum(t, 1 - t))[1:-1]
    return p[::-1] if turned else p


def grid(size=3, n=30, step=4.0, seed=0):
    """Squares with wavy borders that neighbours share, the middle one with an island in a hole."""
    out = []
    for i, j in itertools.product(range(size), repeat=2):
        corners = [(i * step, j * step), ((i + 1) * step, j * step), ((i + 1) * step, (j + 1) * step), (i * step, (j + 1) * step)]
        rings = [[tuple(p) for a, b in zip(corners, corners[1:] + corners[:1]) for p in wavy(a, b, n, seed)[:-1].tolist()]]
        if (i, j) == (1, 1):
            angle = np.linspace(0, 2 * np.pi, 60, endpoint=False)
            island = [(6 + np.cos(t) * (0.8 + 0.05 * (k % 3)), 6 + np.sin(t) * (0.8 + 0.05 * (k % 3))) for k, t in enumerate(angle)]
            rings.append([tuple(map(float, p)) for p in island])
            out.append((99, [[tuple(map(float, p)) for p in island[20:] + island[:20]][::-1]], "island"))
        out.append((10 * i + j, rings, f"{i}{j}"))
    return out


def edges(rows):
    return [(r[0], tuple(ring[k]), tuple(ring[(k + 1) % len(ring)])) for r in rows for ring in r[1] for k in range(len(ring))]


def crossings(rows):
    """Pairs of distinct segments that have more in common than an end."""
    own = sorted({tuple(sorted(e[1:])) for e in edges(rows)})
    turn = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    out = []
    for (a, b), (c, d) in itertools.combinations(own, 2):
        if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
            continue
        shared = {a, b} & {c, d}
        if shared:
            s = shared.pop()
            p, q = ({a, b} - {s}).pop(), ({c, d} - {s}).pop()
            if turn(s, p, q) == 0 and (p[0] - s[0]) * (q[0] - s[0]) + (p[1] - s[1]) * (q[1] - s[1]) > 0:
                out.append(((a, b), (c, d)))
        elif turn(c, d, a) * turn(c, d, b) <= 0 and turn(a, b, c) * turn(a, b, d) <= 0:
            out.append(((a, b), (c, d)))
    return out


def run(spark, rows, tolerance, **options):
    found = simplify.simplified(spark.createDataFrame(rows, SCHEMA), tolerance, **options)
    assert found.columns == ["feature_id", "rings", "name"]
    return sorted((r.feature_id, [[(p.lon, p.lat) for p in ring] for ring in r.rings], r.name) for r in found.collect())


def deviation(before, after):
    """How far the points left out of a ring are from what replaces them."""
    most = 0.0
    for old, new in zip(before, after):
        where = {p: i for i, p in enumerate(old)}
        at = sorted(where[p] for p in new)
        for a, b in zip(at, [*at[1:], at[0] + len(old)]):
            p, q = np.array(old[a]), np.array(old[b % len(old)])
            for k in range(a + 1, b):
                x = np.array(old[k % len(old)])
                t = np.clip((x - p) @ (q - p) / max((q - p) @ (q - p), 1e-300), 0, 1)
                most = max(most, float(np.linalg.norm(x - p - t * (q - p))))
    return most


@pytest.mark.parametrize(("tolerance", "square"), [(0.05, 1.0), (0.4, 1.0), (3.0, 0.7)])
def test_borders_fit_together(spark, tolerance, square):
    rows = sorted(grid())
    assert not crossings(rows)
    found = run(spark, rows, tolerance, square=square)
    assert [(r[0], r[2], len(r[1])) for r in found] == [(r[0], r[2], len(r[1])) for r in rows]
    assert sum(len(ring) for r in found for ring in r[1]) < 0.8 * sum(len(ring) for r in rows for ring in r[1])
    assert not crossings(found)
    # a border has the features on its sides that it had: shared ones stay shared
    sides = Counter(tuple(sorted(e[1:])) for e in edges(found))
    outer = {tuple(sorted(e[1:])) for e in edges(found) if all(p[0] in (0, 12) or p[1] in (0, 12) for p in e[1:])}
    assert set(sides.values()) <= {1, 2} and all(n == 2 for e, n in sides.items() if all(0.9 < x < 11.1 for p in e for x in p)) and outer is not None
    for old, new in zip(rows, found):
        assert all(set(n) <= set(o) and len(n) >= 3 for o, n in zip(old[1], new[1]))
        assert deviation(old[1], new[1]) <= tolerance + 1e-12


def test_points_that_must_stay(spark):
    """A thin strip between two borders: straight lines would meet, so points come back."""
    low = [(float(x), 0.5 * np.sin(x)) for x in np.linspace(0, 6, 40)]
    high = [(x, y + 0.02) for x, y in low]
    strip = [tuple(map(float, p)) for p in [*low, *high[::-1]]]
    below = [tuple(map(float, p)) for p in [*low[::-1], (0.0, -3.0), (6.0, -3.0)]]
    rows = [(1, [strip], "a"), (2, [below], "b")]
    found = run(spark, rows, 10.0)
    assert not crossings(found) and len(found[0][1][0]) >= 4 and len(found[1][1][0]) < len(below)


def test_odd_features(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rows = [(1, [square, square[:2], []], "a"), (2, [square[:2]], "b"), (3, [], "c"), (4, [[p for p in square for _ in range(3)]], "d"), (5, [[square[0], square[2], square[1]]], "e")]
    found = run(spark, rows, 0.0)
    assert [(r[0], len(r[1])) for r in found] == [(1, 1), (4, 1), (5, 1)]
    assert found[0][1][0] != [] and set(found[0][1][0]) == set(square) == set(found[1][1][0])
    assert simplify.simplified(spark.createDataFrame([], SCHEMA), 1.0).count() == 0


def test_arcs_are_shared(spark):
    lines, uses = simplify.arcs(spark.createDataFrame(grid(), SCHEMA))
    n = Counter(r.arc for r in uses.collect())
    # 12 inner borders and the island's are used twice
    assert Counter(n.values())[2] == 12 + 1 and lines.count() == len(n)
    assert uses.where(F.col("feature_id") == 99).count() == 1

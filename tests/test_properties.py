"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.operators import fit, images
from waymark.sources import mapfile

degrees = st.floats(-179.0, 179.0).map(lambda x: round(x, 6))


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60))
def test_weights_cover_and_add_up(size, to):
    total = np.zeros(to)
    for t, s, w in images.weights(size, to):
        assert 0 <= s < size
        total[t] += w
    assert np.allclose(total, 1.0)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(degrees, degrees), min_size=3, max_size=8), st.text(max_size=10))
def test_maps_come_back(ring, name):
    data = mapfile.map_bytes([("land", "polygon", name, [ring])], [])
    world = mapfile.MapFile(data)
    (row,) = world.features()
    assert row[3] == name and [(p["lon"], p["lat"]) for p in row[8][0]] == ring and world.problems() == []


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_descent_lowers_the_loss(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, 3))
    y = (rng.random(30) < 0.5).astype(float)

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z)

    losses = [loss(*fit.gradient_descent(x, y, steps=n, rate=0.1)) for n in (0, 1, 10, 100)]
    assert losses == sorted(losses, reverse=True)

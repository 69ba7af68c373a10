"""What a task of the search holds does not grow with its queries."""

import tracemalloc

import numpy as np

from waymark.operators import search


def test_scores_of_a_block_are_held_for_a_few_queries():
    rng = np.random.default_rng(2)
    asked, known, rows = rng.normal(size=(1024, 8)), rng.normal(size=(4096, 8)), np.arange(4096)
    tracemalloc.start()
    parts = [(a, b, s) for a, b, s in search._best(asked, np.zeros(1024), known, np.zeros(4096), rows, 5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all of them are 32 MB, and were held several times
    at, place, s = (np.concatenate(x) for x in zip(*parts))
    whole = asked @ known.T
    assert at.tolist() == np.repeat(np.arange(1024), 5).tolist()
    assert place.reshape(1024, 5).tolist() == np.argsort(-whole, axis=1)[:, :5].tolist() and np.allclose(s, whole[at, place])

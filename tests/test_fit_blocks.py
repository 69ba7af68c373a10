"""A fit of many rows reads packed blocks, step by step, and needs no task that holds them."""

import numpy as np
from test_fit import by_hand, rows_of

from waymark.operators import fit


def test_a_step_reads_blocks_of_a_bounded_size(spark, monkeypatch):
    x, y, rows = rows_of(spark, 500)
    fold = np.arange(len(y)) % 5
    monkeypatch.setattr(fit, "ONE_TASK_VALUES", 10)
    monkeypatch.setattr(fit, "PART_VALUES", 100)
    monkeypatch.setattr(fit, "BLOCK_ROWS", 7)
    found = {r.fold: r for r in fit.fit(rows, ["a", "b", "c"], [0.0] * 3, [1.0] * 3, steps=12, rate=0.5, l2=1e-3).collect()}
    for f, r in found.items():
        w, b = by_hand(x[fold != f], y[fold != f], 12, 0.5, 1e-3)
        assert np.allclose(r.w, w, atol=1e-12) and np.isclose(r.b, b, atol=1e-12)
    assert not spark.sparkContext._jsc.getPersistentRDDs()

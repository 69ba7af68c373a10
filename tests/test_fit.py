"""Fits and what is written of them."""

import json

import numpy as np
from pyspark.sql import functions as F

from waymark import recipe as R
from waymark.operators import evaluate, fit, ranks
from waymark.plans import fixture as X


def rows_of(spark, n=300):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=n) > 0.3).astype(int)
    return x, y, spark.createDataFrame([(i % 5, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))], "fold int, y int, a double, b double, c double").repartition(3)


def by_hand(x, y, steps, rate, l2):
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w - rate * ((x * (p - y)[:, None]).mean(axis=0) + l2 * w), b - rate * (p - y).mean()
    return w, b


def test_fits_of_folds_in_one_task_and_by_partitions(spark, monkeypatch):
    x, y, rows = rows_of(spark)
    mean, sd = [0.1, 0.0, -0.1], [1.0, 2.0, 0.5]
    given = (x - mean) / sd
    fold = np.arange(len(y)) % 5
    for most in (fit.ONE_TASK_VALUES, 10):
        monkeypatch.setattr(fit, "ONE_TASK_VALUES", most)
        found = {r.fold: r for r in fit.fit(rows, ["a", "b", "c"], mean, sd, steps=15, rate=0.35, l2=1e-2).collect()}
        assert found.keys() == {-1, 0, 1, 2, 3, 4}
        for f, r in found.items():
            w, b = by_hand(given[fold != f], y[fold != f], 15, 0.35, 1e-2)
            assert np.allclose(r.w, w) and np.isclose(r.b, b)


def test_no_plan_of_a_fit_is_a_product(spark):
    _, _, rows = rows_of(spark, 50)
    plan = fit.fit(rows, ["a"], [0.0], [1.0], steps=2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_fitted_recipe_comes_back(spark, tmp_path):
    _, _, rows = rows_of(spark, 60)
    model = fit.as_linear(fit.fit(rows, ["a", "b"], [0.0, 1.0], [1.0, 2.0], steps=3), [0.0, 1.0], [1.0, 2.0])
    for confidence in (None, model):
        recipe = R.Recipe(rerank=model, rerank_lam=0.5, score_sd=0.3, confidence=confidence, top_k=50)
        R.write_recipe(spark, recipe, f"{tmp_path}/r.json", n_rows=10, top_k=7, quant="int8")
        assert R.read_recipe(spark, f"{tmp_path}/r.json") == recipe
        keys = json.loads((tmp_path / "r.json").read_text())
        assert keys["n_rows"] == 10 and keys["top_k"] == 50 and ("conf_w" in keys) == (confidence is not None)


def test_ranks_and_medians(spark):
    rng = np.random.default_rng(3)
    data = [("hot" if i % 3 else f"g{i % 7}", float(v), i) for i, v in enumerate(rng.integers(0, 40, 400))] + [("one", 5.0, 900), ("none", None, 901), (None, 2.0, 902), (None, 4.0, 903)]
    rows = spark.createDataFrame(data, "g string, v double, i int").repartition(4)
    got = {r.i: r.before for r in ranks.ranked(rows, ["g"], [F.asc("v"), F.asc("i")]).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0.0, r[2])
    for g in {r[0] for r in data}:
        for k, r in enumerate(sorted((r for r in data if r[0] == g), key=order)):
            assert got[r[2]] == k
    for upper in (False, True):
        found = {r.g: r.median for r in ranks.medians(rows, ["g"], "v", upper=upper).collect()}
        for g in {r[0] for r in data} - {"none"}:
            values = sorted(r[1] for r in data if r[0] == g)
            assert found[g] == (values[len(values) // 2] if upper else np.median(values))
        assert "none" not in found
    assert ranks.medians(rows, [], "v").first().median == np.median([r[1] for r in data if r[1] is not None])
    assert ranks.medians(rows.limit(0), ["g"], "v").count() == 0


def test_no_window_holds_the_whole_table(spark):
    frame = X.scored_answers(spark, "/root/testdata/sf0.001")
    plan = evaluate.tiers(frame, "p")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("__within")[0].split("rangepartitioning")[0]
    assert evaluate.error_report(frame.limit(0)).first().n == 0


def test_out_of_fold_probabilities(spark):
    _, _, rows = rows_of(spark)
    names, mean, sd = ["a", "b", "c"], [0.0] * 3, [1.0] * 3
    models = fit.fit(rows, names, mean, sd, steps=50)
    found = fit.with_probability(fit.out_of_fold(rows, models, names, mean, sd))
    assert found.where("p < 0 or p > 1").count() == 0
    assert evaluate.brier_auc(found.select("p", "y")).first().auc > 0.9

"""Search and rerank against plain numpy, and their edges."""

import numpy as np
from pyspark.sql import functions as F

from waymark.operators import fit, gate, index, rerank, search
from waymark.plans import fixture as X
from waymark.recipe import Recipe, read_recipe
from waymark.scratch import written

SF = "/root/testdata/sf0.001"


def test_gate_keeps_the_cell_that_crosses(spark):
    p = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.45), (1, 2, 0.05), (2, 3, 0.25), (2, 1, 0.25), (2, 2, 0.25), (2, 0, 0.25), (3, 0, 1.0)], "qid int, cell int, p double")
    got = {}
    for r in gate.gate(p, 0.9).collect():
        got.setdefault(r.qid, []).append(r.cell)
    assert {q: sorted(c) for q, c in got.items()} == {1: [0, 1], 2: [0, 1, 2, 3], 3: [0]}
    assert sorted(r.cell for r in gate.gate(p, 0.9, cap=2).where("qid = 2").collect()) == [0, 1]


def test_blocks_score_as_expressions_do(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 7)
    q, g, p = X.queries(spark, SF), X.gated(spark, SF), X.places(spark, SF)
    for k in (3, 100):
        recipe = Recipe(top_k=k)
        a = search.top_k(search.scored(q, g, p, recipe).select("qid", "row", "s"), k).collect()
        b = search.top_k(search.retrieve(q, g, p, recipe).select("qid", "row", "s"), k).collect()
        assert {(r.qid, r.row, r["rank"]): round(r.s, 9) for r in a} == {(r.qid, r.row, r["rank"]): round(r.s, 9) for r in b}


def test_a_space_that_is_missing_does_not_count(spark):
    q, g, p = X.queries(spark, SF).drop("cls_wh"), X.gated(spark, SF), X.places(spark, SF)
    assert search.shared_spaces(Recipe(), q, p) == ["geo5c", "geo10c", "geo25c"]
    assert search.retrieve(q, g, p, Recipe()).count() > 0


def top(spark, n, same=False):
    rows = [(1, i, i, -0.1 * (0 if same else i), 0.5, 10.0 + 0.05 * i, 20.0, [3 if same else i + 1, 2, -i]) for i in range(n)]
    return spark.createDataFrame(rows, "qid long, row long, rank int, s double, raw double, lat double, lon double, code array<tinyint>")


def test_features_both_ways_and_few_candidates(spark):
    for n in (1, 2, 3, 4, 9):
        rows = top(spark, n)
        a = {r.row: r for r in rerank.features_from_pairs(rows, Recipe()).collect()}
        b = {r.row: r for r in rerank.features(rows, Recipe()).collect()}
        assert len(a) == len(b) == n
        for i in a:
            for name in rerank.RERANK_FEATURES:
                assert abs(a[i][name] - b[i][name]) < 1e-9, (n, i, name)
        w = rerank.weights(rows).agg(F.sum("w")).first()[0]
        assert abs(w - 1) < 1e-9


def test_ties_go_to_the_lower_rank(spark):
    rows = rerank.reranked(rerank.features(top(spark, 3, same=True), X.RECIPE), X.RECIPE)
    assert sorted((r.place, r["rank"]) for r in rows.collect())[0][0] == 0


def test_answers_without_a_confidence_model_or_a_second(spark):
    recipe = Recipe(rerank=X.RECIPE.rerank)
    rows = rerank.reranked(rerank.features(top(spark, 1), recipe), recipe)
    one = rerank.answers(rows, spark.createDataFrame([(1, 1)], "qid long, n_candidates long"), recipe).first()
    assert one.confidence is None and one.margin == 0.0


def test_gradient_descent_is_what_it_says():
    x, y = np.array([[0.0], [1.0], [2.0]]), np.array([0.0, 0.0, 1.0])
    w, b = fit.gradient_descent(x, y, steps=1, rate=1.0)
    assert np.allclose(w, [(-(0 * 0.5 + 1 * 0.5 + 2 * -0.5)) / 3]) and np.isclose(b, -(0.5 + 0.5 - 0.5) / 3)


def test_whitened_rows_have_unit_covariance(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row long, v array<double>")
    mean, matrix = index.whitening(rows)
    assert np.allclose(np.cov(((v - mean) @ matrix).T, bias=True), np.eye(5), atol=1e-6)
    out = index.whitened(rows, mean, matrix).first().cls_wh
    assert np.isclose(np.dot(out, out), 1.0)


def wide_index(spark, path, cells=256, rows=8192, **options):
    """An index of many cells: one space of four numbers, some cells much larger than others."""
    rng = np.random.default_rng(0)
    found = [(i, int(min(rng.zipf(1.3) - 1, cells - 1)) if i % 4 else i // 4 % cells, float(i % 90), float(i % 180), [0.1 * (i % 7)], [int(x) for x in rng.integers(-127, 128, 4)], 0.01) for i in range(rows)]
    index.write_index(spark.createDataFrame(found, "row long, cell int, lat double, lon double, csls array<double>, cls array<tinyint>, cls_scale double"), path, **options)
    return index.PlaceIndex.open(spark, path), found


def asked_of(spark, n=5):
    rng = np.random.default_rng(1)
    queries = spark.createDataFrame([(q, rng.normal(size=4).tolist()) for q in range(n)], "qid long, cls array<double>")
    gated = spark.createDataFrame([(q, c, 0.5 / (1 + j)) for q in range(n) for j, c in enumerate((3, 200 + q, 0))], "qid long, cell int, p double")
    return queries, gated


WIDE = Recipe(blend={"cls": 1.0}, csls_spaces=("cls",), top_k=9)


def files_read(spark, df):
    """Files of each scan of a plan, after it has run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df.collect()
        leaves = plan.collectLeaves()
        return {leaves.apply(i).toString()[:400]: leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles")}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_search_reads_the_folders_of_its_gate(spark, tmp_path):
    found, rows = wide_index(spark, f"{tmp_path}/index", cells_of_bucket=4, rows_of_file=256)
    queries, gated = asked_of(spark)
    top = written(search.best(queries, gated, found, WIDE, True), "top")
    near = found.in_cells(gated)
    assert {r.cell for r in near.select("cell").distinct().collect()} == {0, 3, *range(200, 205)}
    for frame in (near, search.best(queries, gated, found, WIDE, True), search.best(queries, gated, found, WIDE, False), found.winners(top, True), found.winners(top, False)):
        assert "dynamicpruning" in frame._jdf.queryExecution().executedPlan().toString()
    # no place is shuffled before it is scored: the only exchange deals the best rows of each query
    plan = search.best(queries, gated, found, WIDE, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(qid") == 1 and "hashpartitioning(cell_bucket" not in plan and "FlatMapCoGroupsInArrow" not in plan
    narrow = gated.where("cell = 204")
    every = len(list((tmp_path / "index/places").glob("*/*.parquet")))
    read = [n for scan, n in files_read(spark, found.in_cells(narrow)).items() if "cell_bucket" in scan and "csls" in scan]
    assert every >= 64 and len(read) == 1 and read[0] * 16 <= every


def test_both_ways_find_what_expressions_do(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 100)
    monkeypatch.setattr(search, "SCAN_QUERIES", 2)
    found, rows = wide_index(spark, f"{tmp_path}/index")
    queries, gated = asked_of(spark)
    want = {(r.qid, r.row, r["rank"]): r.s for r in search.top_k(search.scored(queries, gated, found.places, WIDE), 9).collect()}
    for few in (True, False, None):
        got = {(r.qid, r.row, r["rank"]): r.s for r in search.best(queries, gated, found, WIDE, few).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plain = {(r.qid, r.row, r["rank"]) for r in search.best(queries, gated, index.PlainPlaces(found.places.drop("cell_bucket")), WIDE).collect()}
    assert plain == want.keys()
    top, counts = search.found(queries, gated, found, WIDE)
    assert {(r.qid, r.row) for r in top.collect()} == {k[:2] for k in want}
    size = {c: sum(r[1] == c for r in rows) for c in range(256)}
    assert {r.qid: (r.n_candidates, r.gate_cells) for r in counts.collect()} == {q: (size[3] + size[200 + q] + size[0], 3) for q in range(5)}


def test_ties_among_the_largest():
    s = np.array([[1.0, 2.0, 2.0, 2.0, 0.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    at, place = search._largest(s, np.array([9, 7, 5, 6, 1]), 2)
    assert at.tolist() == [0, 0, 1, 1] and place.tolist() == [2, 3, 4, 2]
    assert [x.tolist() for x in search._largest(s[:, :1], np.array([4]), 3)] == [[0, 1], [0, 0]]


def test_an_index_keeps_all_rows_in_order(spark, tmp_path):
    found, rows = wide_index(spark, f"{tmp_path}/index", rows_of_file=500)
    assert sorted((r.row, r.cell) for r in found.places.collect()) == [r[:2] for r in rows]
    assert {r.cell: r.n for r in found.sizes().collect()} == {c: n for c in range(256) if (n := sum(r[1] == c for r in rows))}
    for file in (tmp_path / "index/places").glob("*/*.parquet"):
        own = [(r.cell, r.row) for r in spark.read.parquet(str(file)).collect()]
        assert own == sorted(own) and len(own) <= 2000
    hot = [f for f in (tmp_path / "index/places/cell_bucket=0").glob("*.parquet")]
    assert len(hot) > 3  # the hot cell is several files
    index.write_index(found.places.drop("cell_bucket").limit(0), f"{tmp_path}/none")
    assert index.PlaceIndex.open(spark, f"{tmp_path}/none").cells.count() == 0


def test_a_queue_of_queries_without_places(spark, tmp_path):
    found, _ = wide_index(spark, f"{tmp_path}/index")
    queries, gated = asked_of(spark)
    nowhere = gated.withColumn("cell", F.lit(9999))
    for few in (True, False):
        assert search.best(queries, nowhere, found, WIDE, few).count() == 0
        assert search.best(queries, gated.limit(0), found, WIDE, few).count() == 0
    top, counts = search.found(queries, nowhere, found, WIDE)
    assert top.count() == 0 and {r.n_candidates for r in counts.collect()} == {0}


def test_quantise_half_to_even_and_floor(spark):
    rows = spark.createDataFrame([(0, [127.0, 0.5, 1.5, -2.5]), (1, [0.0, 0.0, 0.0, 0.0])], "row int, a array<double>")
    got = {r.row: r for r in index.quantised(rows, ["a"]).collect()}
    assert got[0].a == [127, 0, 2, -2] and got[1].a == [0, 0, 0, 0] and got[1].a_scale == 1e-12 / 127


def test_recipe_defaults(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"gate_mass": 0.5, "e7_w": [1.0], "e7_b": 2.0, "e7_feat_mu": [0.0], "e7_feat_sd": [1.0]}')
    recipe = read_recipe(spark, str(tmp_path / "r.json"))
    assert recipe.gate_mass == 0.5 and recipe.confidence is None and recipe.top_k == 100 and recipe.rerank.bias == 2.0


def test_queries_of_a_cell_go_in_blocks(spark, monkeypatch):
    q, g, p = X.queries(spark, SF), X.gated(spark, SF), X.places(spark, SF)
    whole = {(r.qid, r.row, r["rank"]): r.s for r in search.top_k(search.retrieve(q, g, p, X.RECIPE).select("qid", "row", "s"), 20).collect()}
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "BLOCK", 11)
    parts = {(r.qid, r.row, r["rank"]): r.s for r in search.top_k(search.retrieve(q, g, p, X.RECIPE).select("qid", "row", "s"), 20).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-9 for k in whole)


def test_points_in_several_passes(spark, monkeypatch):
    points, places = X.truth(spark, SF), X.places(spark, SF)
    whole = sorted(search.nearest(points, places, 3).collect())
    monkeypatch.setattr(search, "PASS_POINTS", 10)
    assert sorted(search.nearest(points, places, 3).collect()) == whole


def test_the_search_runs_once(spark):
    from waymark.plans import queries

    queries.locate(spark, SF)
    plan = queries.locate(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 12 and "dynamicpruning" in search.best(X.queries(spark, SF), X.gated(spark, SF), X.place_index(spark, SF), X.RECIPE)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan and "MapInArrow" not in plan
    search_plan = search.retrieve(X.queries(spark, SF), X.gated(spark, SF), X.places(spark, SF), X.RECIPE)._jdf.queryExecution().executedPlan().toString()
    assert search_plan.count("FlatMapCoGroupsInArrow") == 1


def test_the_hubness_sample_does_not_grow(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(200)], "row long, a array<double>")
    sample = np.array([[np.cos(i), np.sin(i)] for i in range(50)])
    found = index.hubness(rows, ["a"], top=5, sample_rows=50, order=F.col("row")).collect()
    for r in found:
        near = np.sort(sample @ [np.cos(r.row), np.sin(r.row)])[-5:]
        assert abs(r.csls[0] - near.mean()) < 1e-12
    few = index.hubness(rows.limit(3), ["a"], top=5).collect()
    assert len(few) == 3 and all(-1 <= r.csls[0] <= 1 for r in few)

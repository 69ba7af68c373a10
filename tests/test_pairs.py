"""Scores of all pairs by blocks, against the expressions."""

import math

from pyspark.sql import functions as F

from waymark.functions.vector import dequantised_dot
from waymark.operators import search
from waymark.plans import fixture as X
from waymark.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_blended_scores_of_all_pairs_by_blocks(spark, monkeypatch):
    q, g, p = X.queries(spark, SF), X.gated(spark, SF), X.places(spark, SF)
    want = {(r.qid, r.row): r.s for r in search.scored(q, g, p, X.RECIPE).collect()}
    for places, queries, step in ((search.PAIR_PLACES, search.PAIR_QUERIES, search.PAIR_STEP), (7, 3, 2)):
        monkeypatch.setattr(search, "PAIR_PLACES", places)
        monkeypatch.setattr(search, "PAIR_QUERIES", queries)
        monkeypatch.setattr(search, "PAIR_STEP", step)
        got = search.scored_in_blocks(q, g, p, X.RECIPE).collect()
        assert len(got) == len(want) and all(abs(want[r.qid, r.row] - r.s) < 1e-9 for r in got)
    assert search.scored_in_blocks(q, g.limit(0), p, X.RECIPE).count() == 0
    assert search.scored_in_blocks(q, g.withColumn("cell", F.lit(9999)), p, X.RECIPE).count() == 0


def test_blend_score_has_no_expression_for_each_pair(spark):
    assert "FlatMapCoGroupsInArrow" in plan(Q.blend_score(spark, SF)) and "zip_with" not in plan(Q.blend_score(spark, SF)).split("FlatMapCoGroupsInArrow")[0]


def test_products_of_all_pairs_by_blocks(spark, monkeypatch):
    q, g, p = X.queries(spark, SF), X.gated(spark, SF), X.places(spark, SF)
    pairs = q.select("qid", F.col("cls").alias("q")).join(g, "qid").join(p, "cell")
    want = {(r.qid, r.row): r.x for r in pairs.select("qid", "row", dequantised_dot(F.col("q"), F.col("cls"), F.col("cls_scale")).alias("x")).collect()}
    monkeypatch.setattr(search, "PAIR_PLACES", 7)
    monkeypatch.setattr(search, "PAIR_QUERIES", 3)
    got = search.dequantised_in_blocks(q, g, p, "cls", "x").collect()
    assert len(got) == len(want) and all(abs(want[r.qid, r.row] - r.x) < 1e-9 for r in got)
    assert "FlatMapCoGroupsInArrow" in plan(Q.dequant_dot(spark, SF))


def test_rounding_without_decimals(spark):
    values = [0.0078125, -0.0078125, 1.2345674999, -0.0000001, 0.0, 1e-9, 123456.7890125, 1e12, float("inf"), float("nan"), None, 2.5e-6, -7.4999999e-6]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    same = lambda a, b: a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    for a, b in zip(Q.rounded(rows).orderBy("i").collect(), Q.rounded_many(rows).orderBy("i").collect()):
        assert same(a.x, b.x), (a, b)
        assert b.x is None or str(b.x) != "-0.0"

"""Reranking by consensus: the candidates of a query are compared with one another.

Inputs are the top rows of each query: (qid, row, rank, s, lat, lon, code, raw),
code being the cls code and raw its product with the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions.geo import EARTH_KM, haversine_km
from waymark.functions.vector import dot, unit_candidate
from waymark.recipe import CONFIDENCE_FEATURES, RERANK_FEATURES, Linear, Recipe

#: Cosine above which two candidates look alike.
ALIKE = 0.5


def weights(top: DataFrame, temperature: float = 0.05) -> DataFrame:
    """top with the consensus weight w: softmax of s over the temperature."""
    of = W.partitionBy("qid")
    e = F.exp((F.col("s") - F.max("s").over(of)) / temperature)
    return top.withColumn("e", e).withColumn("w", F.col("e") / (F.sum("e").over(of) + 1e-12)).drop("e")


def pairs(top: DataFrame) -> DataFrame:
    """(qid, row, other, w_other, km, cc): every two candidates of a query, itself
    included. top has w."""
    own = top.withColumn("unit", unit_candidate(F.col("code")))
    a = own.select("qid", "row", "lat", "lon", "unit")
    b = own.select("qid", F.col("row").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("unit").alias("unit2"), F.col("w").alias("w_other"))
    return a.join(b, "qid").select("qid", "row", "other", "w_other", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km"), dot(F.col("unit"), F.col("unit2")).alias("cc"))


def within(km: float) -> Column:
    """The weight of the candidates within a distance, by aggregation of pairs."""
    return F.sum(F.when(F.col("km") <= km, F.col("w_other")).otherwise(0.0))


def cc_mean() -> Column:
    return F.sum(F.col("cc") * F.col("w_other"))


def cc_max3() -> Column:
    """The mean of the three largest cosines behind the largest (which is that
    with itself); of those there are, null for a single candidate."""
    after = F.slice(F.sort_array(F.collect_list("cc"), asc=False), 2, 3)
    return F.try_divide(F.aggregate(after, F.lit(0.0), lambda s, x: s + x), F.size(after))


def diffusion() -> Column:
    """The mean weight of the candidates that look alike, by their cosine."""
    alike = F.when(F.col("cc") > ALIKE, F.col("cc")).otherwise(0.0)
    return F.sum(alike * F.col("w_other")) / (F.sum(alike) + 1e-12)


def entropy(w: Column) -> Column:
    return -F.sum(w * F.log(F.greatest(w, F.lit(1e-12))))


def features_from_pairs(top: DataFrame, recipe: Recipe) -> DataFrame:
    """The reranker's features by joins and aggregates alone; columns qid, row,
    rank, s, then the features."""
    weighted = weights(top, recipe.temperature)
    per = pairs(weighted).groupBy("qid", "row").agg(within(10).alias("cons10"), within(25).alias("cons25"), within(50).alias("cons50"), diffusion().alias("d"), cc_mean().alias("cc_mean"), F.coalesce(cc_max3(), F.lit(0.0)).alias("cc_max3"))
    whole = weighted.groupBy("qid").agg(entropy(F.col("w")).alias("entropy"), F.count("*").alias("k"), F.max("s").alias("best"))
    wide = weighted.join(per, ["qid", "row"]).join(whole, "qid")
    margin = F.col("best") - F.col("s")
    out = {
        "score": F.col("s"), "raw": F.col("raw"), "log_rank": F.log1p(F.col("rank")), "margin": margin, "cons10": F.col("cons10"), "cons25": F.col("cons25"), "cons50": F.col("cons50"),
        "diffusion": F.col("d") * 10, "cc_mean": F.col("cc_mean"), "cc_max3": F.col("cc_max3"), "entropy": F.col("entropy"), "fill": F.col("k") / recipe.top_k,
        "score_cons25": F.col("s") * F.col("cons25"), "raw_cons25": F.col("raw") * F.col("cons25"), "margin_cons25": margin * F.col("cons25"), "diffusion_cons25": F.col("d") * F.col("cons25") * 10,
    }
    return wide.select("qid", "row", "rank", "s", *(out[f].alias(f) for f in RERANK_FEATURES))


def features(top: DataFrame, recipe: Recipe) -> DataFrame:
    """The same features, with the comparisons of a query's candidates as matrix
    products in one task: at most top_k rows come together there. Adds agree10,
    agree25 and agree100, the weights that the confidence takes."""
    qid = top.schema["qid"].dataType.simpleString()
    row = top.schema["row"].dataType.simpleString()
    names = [*RERANK_FEATURES, "agree10", "agree25", "agree100"]

    def of(group: pa.Table) -> pa.Table:
        k = group.num_rows
        s, raw, lat, lon, rank = (group.column(c).to_numpy().astype(np.float64) for c in ("s", "raw", "lat", "lon", "rank"))
        code = group.column("code").combine_chunks()
        code = code.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(k, -1)
        unit = code / (np.sqrt((code * code).sum(axis=1, keepdims=True)) + 1e-9)
        cc = unit @ unit.T
        phi, lam = np.radians(lat), np.radians(lon)
        half = np.sin((phi[:, None] - phi) / 2) ** 2 + np.cos(phi)[:, None] * np.cos(phi) * np.sin((lam[:, None] - lam) / 2) ** 2
        km = 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(half, 0, 1)))
        e = np.exp((s - s.max()) / recipe.temperature)
        w = e / (e.sum() + 1e-12)
        cons = {d: (w * (km <= d)).sum(axis=1) for d in (10, 25, 50, 100)}
        alike = np.where(cc > ALIKE, cc, 0.0)
        d = alike @ w / (alike.sum(axis=1) + 1e-12)
        best = np.sort(cc, axis=1)[:, ::-1][:, 1:4]
        cc3 = best.mean(axis=1) if best.shape[1] else np.zeros(k)
        margin, h = s.max() - s, float(-(w * np.log(np.maximum(w, 1e-12))).sum())
        columns = [s, raw, np.log1p(rank), margin, cons[10], cons[25], cons[50], d * 10, cc @ w, cc3, np.full(k, h), np.full(k, k / recipe.top_k), s * cons[25], raw * cons[25], margin * cons[25], d * cons[25] * 10, cons[10], cons[25], cons[100]]
        return pa.table({"qid": group.column("qid"), "row": group.column("row"), "rank": group.column("rank").cast(pa.int32()), "s": group.column("s"), **{n: pa.array(c) for n, c in zip(names, columns)}})

    schema = f"qid {qid}, row {row}, rank int, s double, " + ", ".join(f"{n} double" for n in names)
    return top.select("qid", "row", "rank", "s", "raw", "lat", "lon", "code").groupBy("qid").applyInArrow(of, schema)


def linear(model: Linear, names: tuple[str, ...]) -> Column:
    """bias plus the weighted, standardised features."""
    total = F.lit(model.bias)
    for name, w, mean, sd in zip(names, model.weights, model.mean, model.sd):
        total = total + w * ((F.col(name) - mean) / sd)
    return total


def reranked(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """rows of features with e7 and final, and place: 0 for the answer, then by final."""
    e7 = linear(recipe.rerank, RERANK_FEATURES)
    final = rows.withColumn("e7", e7).withColumn("final", F.col("s") / recipe.score_sd + recipe.rerank_lam * F.col("e7"))
    return final.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("final"), "rank")) - 1)


def answers(rows: DataFrame, n_candidates: DataFrame, recipe: Recipe) -> DataFrame:
    """One row for each query of reranked rows: the winner, its lead over the
    second, and the confidence (null without a model). n_candidates has (qid, n_candidates)."""
    second = F.max(F.when(F.col("place") == 1, F.col("final")))
    winner = F.max_by(F.struct("row", "s", "final", "raw", "entropy", "agree10", "agree25", "agree100"), -F.col("place")).alias("win")
    one = rows.groupBy("qid").agg(winner, second.alias("second")).join(n_candidates, "qid")
    flat = one.select(
        "qid", F.col("win.row").alias("row"), F.col("win.s").alias("s"), F.col("win.final").alias("final"), "n_candidates", F.col("win.agree10").alias("agree10"), F.col("win.agree25").alias("agree25"),
        F.col("win.agree100").alias("agree100"), F.col("win.raw").alias("top_sim"), F.coalesce(F.col("win.final") - F.col("second"), F.lit(0.0)).alias("margin"), F.col("win.entropy").alias("entropy"), F.log1p("n_candidates").alias("log_candidates"),
    )
    confidence = F.lit(None).cast("double") if recipe.confidence is None else 1.0 / (1.0 + F.exp(-linear(recipe.confidence, CONFIDENCE_FEATURES)))
    return flat.withColumn("confidence", confidence)


def spread_degrees(rows: DataFrame, top: int = 12) -> DataFrame:
    """(qid, span): the largest offset of the first answers from the winner, in
    degrees of latitude; rows has qid, place, lat, lon."""
    first = rows.where("place = 0").select("qid", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    near = rows.where(F.col("place") < top).join(first, "qid")
    return near.groupBy("qid").agg(F.max(F.greatest(F.abs(F.col("lat") - F.col("lat0")), F.abs(F.col("lon") - F.col("lon0")) * F.cos(F.radians("lat0")))).alias("span"))


def complete(one: DataFrame, queries: DataFrame) -> DataFrame:
    """answers for every query: one whose gate holds no place has no row, no
    candidates, and a confidence of 0."""
    out = queries.select("qid").join(one, "qid", "left")
    none = F.col("row").isNull()
    return out.withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0))).withColumn("confidence", F.when(none, 0.0).otherwise(F.col("confidence")))

"""The gate: which cells a query searches, from its posterior over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def posterior(logits: DataFrame) -> DataFrame:
    """(qid, cell, p): softmax of logits (qid, cell, logit) within each query."""
    of = W.partitionBy("qid")
    e = F.exp(F.col("logit") - F.max("logit").over(of))
    return logits.select("qid", "cell", e.alias("e")).select("qid", "cell", (F.col("e") / F.sum("e").over(of)).alias("p"))


def gate(p: DataFrame, mass: float = 0.95, cap: int = 400) -> DataFrame:
    """(qid, cell, p, rank): the likeliest cells, as long as those before have
    less than the mass, so the one that crosses it is in; at most cap. Of equal
    cells the lower number comes first."""
    order = W.partitionBy("qid").orderBy(F.desc("p"), "cell")
    before = F.coalesce(F.sum("p").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ranked = p.select("qid", "cell", "p", F.row_number().over(order).alias("rank"), before.alias("before"))
    return ranked.where((F.col("rank") <= cap) & (F.col("before") < mass)).drop("before")


def log_prior(p: Column, lam: float = 0.05) -> Column:
    return lam * F.log(F.greatest(p, F.lit(1e-12)))

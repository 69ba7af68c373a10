"""Places within an order, and medians, without a task that holds a whole group:
rows are dealt by ranges of the order, and a range adds the sizes of those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.scratch import written


def ranked(rows: DataFrame, keys: list[str], order: list[Column], weight: str | None = None, into: str = "before") -> DataFrame:
    """rows with how many rows of the same keys (or how much of the weight) come before each in the order."""
    spark = rows.sparkSession
    key = F.struct(*keys) if keys else F.lit(0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()).withColumn("__key", key)
    dealt = written(dealt, "ranked")  # ranges are drawn anew each time they are computed
    one = F.lit(1).cast("long") if weight is None else F.col(weight)
    sizes = dealt.groupBy("__key", "__part").agg(F.sum(one).alias("__size"))
    ahead = F.sum("__size").over(W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("__key", "__part", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    within = F.sum(one).over(W.partitionBy("__key", "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    placed = dealt.withColumn("__within", F.coalesce(within, F.lit(0))).join(sizes, ["__key", "__part"])
    return placed.withColumn(into, F.col("__ahead") + F.col("__within")).drop("__key", "__part", "__ahead", "__within")


def medians(rows: DataFrame, keys: list[str], value: str, into: str = "median", upper: bool = False) -> DataFrame:
    """(keys, into): the median of the values of each group that are not null, the mean
    of the two in the middle, or the upper one. Equal values are counted up first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    placed = ranked(counts, keys, [F.asc(value)], "__n", "__before")
    key = F.struct(*keys) if keys else F.lit(0)
    total = placed.groupBy(key.alias("__key")).agg(F.sum("__n").alias("__all"))
    placed = placed.withColumn("__key", key).join(total, "__key")

    def at(place: Column) -> Column:
        here = (F.col("__before") <= place) & (place < F.col("__before") + F.col("__n"))
        return F.max(F.when(here, F.col(value)))

    low, high = at(F.floor((F.col("__all") - 1) / 2)), at(F.floor(F.col("__all") / 2))
    return placed.groupBy("__key").agg((high if upper else (low + high) / 2).alias(into)).select(*(F.col(f"__key.{k}").alias(k) for k in keys), into)

"""Preparing images for an encoder: bicubic resizing, as a join with weights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kernel's parameter, and mean and deviation of the channels.
KERNEL, MEAN, DEVIATION = -0.5, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def cubic(x: np.ndarray, a: float = KERNEL) -> np.ndarray:
    x = np.abs(x)
    near = (a + 2) * x**3 - (a + 3) * x**2 + 1
    far = a * (x**3 - 5 * x**2 + 8 * x - 4)
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def weights(size: int, to: int) -> list[tuple[int, int, float]]:
    """(target, source, weight): which pixels of a row make each of the new ones.
    When shrinking, the kernel widens; the weights of a target add up to 1."""
    step = size / to
    wide = max(1.0, step)
    out = []
    for t in range(to):
        middle = (t + 0.5) * step
        first, last = max(0, math.floor(middle - 2 * wide + 0.5)), min(size, math.floor(middle + 2 * wide + 0.5))
        sources = np.arange(first, last)
        w = cubic((sources - middle + 0.5) / wide)
        out += zip([t] * len(sources), sources.tolist(), (w / w.sum()).tolist())
    return out


def resized(pixels: DataFrame, width: int, height: int, to: int) -> DataFrame:
    """Images (image, y, x, c, value) of one size made to by to: first along rows,
    then along columns, rounded to whole bytes after each. The weights are a
    table of the image's size, whatever the number of images."""
    spark = pixels.sparkSession

    def along(rows: DataFrame, axis: str, size: int) -> DataFrame:
        table = spark.createDataFrame(weights(size, to), f"target int, {axis} int, weight double")
        keys = [c for c in ("image", "y", "x", "c") if c != axis]
        total = rows.join(F.broadcast(table), axis).groupBy(*keys, F.col("target").alias(axis)).agg(F.sum(F.col("weight") * F.col("value")).alias("v"))
        return total.select("image", "y", "x", "c", F.greatest(F.least(F.floor(F.round("v", 9) + 0.5), F.lit(255)), F.lit(0)).cast("int").alias("value"))

    return along(along(pixels, "x", width), "y", height)


def normalised(pixels: DataFrame) -> DataFrame:
    """pixels with value as the encoder takes it, by channel."""
    mean, deviation = (F.array(*map(F.lit, x))[F.col("c")] for x in (MEAN, DEVIATION))
    return pixels.withColumn("value", (F.col("value") / 255.0 - mean) / deviation)


def tensors(pixels: DataFrame) -> DataFrame:
    """(image, tensor): channels, then rows, then columns, in one array."""
    ordered = F.array_sort(F.collect_list(F.struct("c", "y", "x", "value")))
    return pixels.groupBy("image").agg(F.transform(ordered, lambda p: p["value"].cast("float")).alias("tensor"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder's images, in order of their names."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select("path", "content").orderBy("path")

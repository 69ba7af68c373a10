"""Fitting the two linear models by plain gradient descent, as the model needs it:
the result depends on the number of steps and the rate, not on the objective alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.ranks import medians
from waymark.recipe import Linear
from waymark.scratch import written

#: Steps, rate and regularisation of the confidence's fit; fixed values.
CONFIDENCE_FIT = {"steps": 900, "rate": 0.35, "l2": 1e-4}


def moments(rows: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, sd) with the population deviation plus 1e-9."""
    stats = rows.agg(*(f(n).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    each = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"m_{n}").alias("mean"), (F.col(f"s_{n}") + 1e-9).alias("sd")) for n in names))
    return stats.select(F.explode(each).alias("e")).select("e.*")


def gradient_descent(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, l2: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias, from zeros; the bias is not regularised."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        error = 1.0 / (1.0 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) + l2 * w)
        b -= rate * error.mean()
    return w, b


#: Numbers (rows times features) that one task fits; with more, each step is a sum over partitions
#: of some PART_VALUES (16 MB), kept as blocks of BLOCK_ROWS rows.
ONE_TASK_VALUES, PART_VALUES, BLOCK_ROWS = 1 << 24, 1 << 21, 4096


def fit(rows: DataFrame, names: list[str], mean: list[float], sd: list[float], steps: int = 400, rate: float = 0.5, l2: float = 0.0) -> DataFrame:
    """(fold, w, b) of rows (fold, y, <names>): one fit for each fold, of all rows
    of the other folds, and one of all rows under fold -1. Folds are few. The
    result is the same in one task for each fold as by sums over partitions."""
    kind = rows.schema["fold"].dataType.simpleString()
    x = F.array(*((F.col(n).cast("double") - m) / s for n, m, s in zip(names, mean, sd)))
    given = written(rows.select("fold", F.col("y").cast("double").alias("y"), x.alias("x")), "given")
    folds = [-1, *sorted(r[0] for r in given.select("fold").distinct().collect())]
    if given.count() * len(names) > ONE_TASK_VALUES:
        w, b = _by_partitions(given, folds, len(names), steps, rate, l2)
        return rows.sparkSession.createDataFrame([(f, v.tolist(), float(c)) for f, v, c in zip(folds, w, b)], f"fold {kind}, w array<double>, b double")

    def one(group: pa.Table) -> pa.Table:
        matrix = group.column("x").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        w, b = gradient_descent(matrix, group.column("y").to_numpy(), steps, rate, l2)
        return pa.table({"fold": group.column("of")[:1], "w": pa.array([w.tolist()], pa.list_(pa.float64())), "b": pa.array([b])})

    every = F.array(*(F.lit(f).cast(kind) for f in folds))
    each = given.withColumn("of", F.explode(F.filter(every, lambda f: f != F.col("fold"))))
    return each.groupBy("of").applyInArrow(one, f"fold {kind}, w array<double>, b double")


def _by_partitions(given: DataFrame, folds: list, n: int, steps: int, rate: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """All folds at once: a step adds up the gradients of every partition, those of a fold's fit
    over the rows of the other folds; what comes back is one number for each weight. Rows are packed
    into blocks of numbers once, so that a step reads them as they are."""
    own, size = np.array(folds), n + 3
    counts = {r[0]: r[1] for r in given.groupBy("fold").count().collect()}
    total = np.array([sum(c for f, c in counts.items() if f != x) for x in folds], dtype=float)
    parts = max(sum(counts.values()) * size // PART_VALUES + 1, given.sparkSession.sparkContext.defaultParallelism)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = part.column(2).flatten().to_numpy().reshape(part.num_rows, n)
                block = np.column_stack([part.column(0).to_numpy(), part.column(1).to_numpy(), x, np.ones(part.num_rows)])
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], ["block"])

    packed = given.select("fold", "y", "x").repartition(parts).mapInArrow(pack, "block binary").persist(StorageLevel.MEMORY_AND_DISK)
    w = np.zeros((len(folds), n + 1))  # the bias is the last
    decay = np.append(np.full(n, l2), 0.0)
    try:
        for _ in range(steps):
            shared = given.sparkSession.sparkContext.broadcast(w)

            def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                out = np.zeros((len(own), n + 1))
                for batch in batches:
                    for value in batch.column(0):
                        block = np.frombuffer(value.as_buffer(), dtype=np.float64).reshape(-1, size)
                        error = block[:, 2:] @ shared.value.T
                        np.negative(error, out=error)
                        np.exp(error, out=error)
                        error += 1.0
                        np.reciprocal(error, out=error)
                        error -= block[:, 1, None]
                        error *= own[None, :] != block[:, 0, None]
                        out += error.T @ block[:, 2:]
                yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

            found = packed.mapInArrow(sums, "g array<double>").toArrow().column("g").combine_chunks()
            gradient = found.flatten().to_numpy().reshape(-1, len(own), n + 1).sum(axis=0) / total[:, None]
            w = w - rate * (gradient + decay * w)
            shared.unpersist()
    finally:
        packed.unpersist()
    return w[:, :n], w[:, n]


def out_of_fold(rows: DataFrame, models: DataFrame, names: list[str], mean: list[float], sd: list[float]) -> DataFrame:
    """rows with z, the linear score by the model of their own fold."""
    model = F.col("__model")
    z = model["b"]
    for i, (n, m, s) in enumerate(zip(names, mean, sd)):
        z = z + model["w"][i] * ((F.col(n) - m) / s)
    named = models.select("fold", F.struct("w", "b").alias("__model"))
    return rows.join(named, "fold").withColumn("z", z).drop("__model")


def best_lambda(rows: DataFrame, grid: list[float], score_sd: float) -> DataFrame:
    """(lam, median_km) of rows (qid, rank, s, z, km): for each lambda the median
    error of the winners by s / score_sd + lam * z; the best lambda first, of
    equals the first of the grid."""
    given = rows.withColumn("lam", F.explode(F.array(*map(F.lit, grid))))
    won = given.groupBy("lam", "qid").agg(F.max_by("km", F.struct(F.col("s") / score_sd + F.col("lam") * F.col("z"), -F.col("rank"))).alias("km"))
    found = medians(written(won, "won"), ["lam"], "km", "median_km")
    return found.orderBy("median_km", F.array_position(F.array(*map(F.lit, grid)), F.col("lam")))


def score_sd(rows: DataFrame) -> DataFrame:
    """One row: the population deviation of the scores s of all candidates there are."""
    return rows.agg(F.stddev_pop("s").alias("score_sd"))


def with_probability(scored: DataFrame) -> DataFrame:
    """Rows of out_of_fold() with p, the probability that their score z states."""
    return scored.withColumn("p", 1.0 / (1.0 + F.exp(-F.col("z"))))


def as_linear(models: DataFrame, mean: list[float], sd: list[float], fold: int = -1) -> Linear:
    """The model of a fold of fit(), as a recipe has it."""
    row = models.where(F.col("fold") == fold).first()
    return Linear(tuple(row.w), row.b, tuple(mean), tuple(sd))

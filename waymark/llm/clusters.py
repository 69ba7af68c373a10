"""Centroid clustering of integer vectors, exactly.

Vectors are packed into blocks, written once. In each round a task expands
|x|^2 - 2 x.c + |c|^2 for a block by one product of float64 matrices. Every number in it
is an integer, so it is exact as long as no sum can reach 2^53; rows for which a bound of
their magnitudes says otherwise go through 64-bit integers below 2^62 and Python's
integers beyond. Sums, counts and distances of a round are added up by treeAggregate,
as integers of any size; a round brings k x dim numbers to the driver, whatever the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import table, tidied, written

#: Clusters, rounds, components of a vector, the factor before rounding down, and the seed of the first centroids.
K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Rows taken at a time where float64 does not do.
FALLBACK_ROWS = 256
#: Below it every integer is a float64; above LONG a number is no 64-bit integer.
EXACT, LONG = 2.0**53, (1 << 63) - 1


def usable(embedding: Column, dim: int) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dim) & fine, F.lit(False))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), of any size."""
    return int(x) * scale if abs(x) >= 2.0**52 else math.floor(scale * x)


def nearest(rows: np.ndarray, centroids: list[list[int]], scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of finite float64 numbers, in parts of which each is computed by the fastest
    numbers that are exact for it: (places, floor(scale * rows), cluster, distance), the
    nearest centroid (the first of equals) and its squared distance."""
    dim = rows.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        q = np.floor(rows * float(scale))
        most = np.abs(q).max(axis=1, initial=0.0)
        far = min(float(max((abs(x) for c in centroids for x in c), default=0)), 1e200)
        # no partial sum of |x|^2, 2 x.c or |c|^2, in any order, is above it
        bound = dim * (most + far) ** 2
    exact = bound < EXACT
    if exact.any():
        at = np.flatnonzero(exact)
        x, c = q[at], np.array(centroids, dtype=np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)
        yield at, x, d.argmin(axis=1), d.min(axis=1).astype(np.int64)
    narrow = ~exact & (bound < 2.0**62)
    for of, kind in ((narrow, np.int64), (~exact & ~narrow, object)):
        other = np.flatnonzero(of)
        for i in range(0, len(other), FALLBACK_ROWS):
            at = other[i : i + FALLBACK_ROWS]
            x = q[at].astype(np.int64) if kind is np.int64 else np.array([[whole(float(v), scale) for v in row] for row in rows[at]], dtype=object)
            d = np.stack([((x - np.array(c, dtype=kind)) ** 2).sum(axis=1) for c in centroids], axis=1)
            cluster = np.array([row.index(min(row)) for row in d.tolist()])
            yield at, x, cluster, d[np.arange(len(at)), cluster]


def block_sums(rows: np.ndarray, centroids: list[list[int]], scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, distances) of each cluster over a block, integers of any size."""
    k = len(centroids)
    sums, counts, inertia = (np.zeros(shape, dtype=object) for shape in ((k, rows.shape[1]), k, k))
    for at, x, cluster, distance in nearest(rows, centroids, scale):
        counts += np.bincount(cluster, minlength=k)
        if x.dtype == np.float64 and np.abs(x).max() * len(at) < EXACT:
            mine = np.zeros((k, len(at)))
            mine[cluster, np.arange(len(at))] = 1.0
            sums += (mine @ x).astype(np.int64)
        else:
            np.add.at(sums, cluster, x.astype(np.int64).astype(object) if x.dtype == np.float64 else x.astype(object))
        if distance.dtype == np.int64 and int(distance.max()) * len(at) <= LONG:
            own = np.zeros(k, dtype=np.int64)
            np.add.at(own, cluster, distance)
            inertia += own
        else:
            np.add.at(inertia, cluster, distance.astype(object))
    return sums, counts, inertia


def _numbers(block: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(block, dtype=np.float64).reshape(-1, dim)


def _pack(dim: int):  # noqa: ANN202
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([values.reshape(-1, dim).tobytes()], pa.binary())], ["ids", "block"])

    return pack


def _adder(centroids: list[list[int]], dim: int, scale: int):  # noqa: ANN202
    def add(total: tuple | None, row: Row) -> tuple:
        return _joined(total, block_sums(_numbers(row.block, dim), centroids, scale))

    return add


def _joined(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    return tuple(x + y for x, y in zip(a, b))


def moved(centroids: list[list[int]], sums: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """floor(sum / count) of each component; a centroid without vectors stays."""
    return [[int(s) // int(n) for s in own] if n else c for c, own, n in zip(centroids, sums, counts)]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def as_long(x: int) -> int | None:
    return int(x) if int(x) <= LONG else None


def centroid_clusters(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each row
    with exactly dim components, none null or non-finite; other rows are left out.

    Each component x counts as floor(scale * x), x as double. The first centroids are the
    k rows of the smallest sha256 of "seed:vec_id" (all rows, where there are fewer; of
    rows that repeat an id, those of smaller components first). Rows without an id are
    clustered but start no centroid; where all are, they are in cluster 0 at no centroid,
    and their other columns are null. Rows that repeat an id are vectors of their own.
    Distances and sums that no long can hold are null. Other columns are not looked at; an
    empty table gives an empty result.
    """
    good = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where(usable(F.col("embedding"), dim))
    named = good.where("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("hash", "embedding").limit(k).select("embedding").collect()
    centroids = [[whole(x, scale) for x in r.embedding] for r in first]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return good.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(None).cast(t).alias(c) for c, t in (("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    blocks = written(good.mapInArrow(tidied(_pack(dim)), "ids array<long>, block binary"), "blocks")
    packed = blocks.select("block").rdd
    for _ in range(rounds):
        sums, counts, _ = packed.treeAggregate(None, _adder(centroids, dim, scale), _joined)
        centroids = moved(centroids, sums, counts)
    _, _, inertia = packed.treeAggregate(None, _adder(centroids, dim, scale), _joined)

    of_cluster, total = pa.array([as_long(x) for x in inertia], pa.int64()), as_long(sum(inertia))
    digests = pa.array([digest(c) for c in centroids])
    shared = rows.sparkSession.sparkContext.broadcast((centroids, of_cluster, digests))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, of_cluster, digests = shared.value
        for batch in batches:
            for ids, block in zip(batch.column(0), batch.column(1)):
                for at, _, cluster, distance in nearest(_numbers(block.as_buffer(), dim), centroids, scale):
                    own = distance if distance.dtype == np.int64 else [as_long(x) for x in distance.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [ids.values.take(pa.array(at)), pa.array(cluster, pa.int32()), pa.array(own, pa.int64()), of_cluster.take(pa.array(cluster)), pa.array([total] * len(at), pa.int64()), digests.take(pa.array(cluster))],
                        ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                    )

    return blocks.mapInArrow(tidied(assign), schema)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same from the definitions, in exact integers, a round after the other."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, q AS c FROM (SELECT q, sha256('2:' || vec_id::VARCHAR) AS h FROM kept ORDER BY h LIMIT 40)
)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(q) AS q, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT vec_id, q, cluster, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept CROSS JOIN c{i}
  ) GROUP BY vec_id
)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (
  SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY cluster) m USING (cluster)
)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.cluster::INTEGER AS cluster, distance,
  (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} USING (cluster)"""


ORACLE = _oracle()

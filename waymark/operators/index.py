"""Building a place index: views, cells, quantised spaces, hubness, whitening."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from waymark.functions.vector import dot, quantise, quantise_scale
from waymark.scratch import written

#: Rows that are multiplied at a time; rows of the sample against which hubness is measured.
BATCH, HUB_ROWS = 128, 5000
#: Rows of a block, each of which meets every other where hubness is measured against all rows, and blocks that one task keeps for them.
HUB_BLOCK, HUB_GROUP = 4096, 16
#: Neighbouring cells of a folder of the index, and rows of a file.
CELLS_OF_BUCKET, ROWS_OF_FILE = 8, 1 << 16


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix, without an object for each number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def one_view(rows: DataFrame, views: int = 4) -> DataFrame:
    """The first of each group of views rows, by row number."""
    return rows.where(F.col("row") % views == 0)


def assign_cells(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(row, cell): the centroid of the largest product, the lower cell of equals.
    Both have v; centroids are few (cells), and go to every task of rows."""
    table = centroids.select("cell", "v").orderBy("cell").toArrow()
    cells = table.column("cell").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(matrix_of(table.column("v")))
    kind = rows.schema["row"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix_of(batch.column(1))
            best = (v @ shared.value.T).argmax(axis=1) if len(v) else np.empty(0, dtype=int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells[best], pa.int32())], ["row", "cell"])

    return rows.select("row", "v").mapInArrow(nearest, f"row {kind}, cell int")


def cell_offsets(places: DataFrame, n_cells: int) -> DataFrame:
    """(cell, n, offset) of every cell, those without a place too."""
    counts = places.groupBy("cell").agg(F.count("*").alias("n"))
    cells = places.sparkSession.range(n_cells).select(F.col("id").cast("int").alias("cell"))
    before = F.coalesce(F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cells.join(counts, "cell", "left").na.fill({"n": 0}).select("cell", "n", before.alias("offset"))


def hubness(rows: DataFrame, spaces: list[str], top: int = 10, sample_rows: int = HUB_ROWS, order: Column | None = None) -> DataFrame:
    """(row, csls): for each of the spaces the mean of the largest products with a
    sample, itself included. The sample is the first sample_rows rows by the order
    (else a hash of the row), so its size does not grow with the table; it goes to
    every task once, for all spaces."""
    of = rows.orderBy(F.xxhash64("row") if order is None else order, "row").limit(sample_rows).select(*spaces).toArrow()
    shared = rows.sparkSession.sparkContext.broadcast([matrix_of(of.column(s)) for s in spaces])
    kind = rows.schema["row"].dataType.simpleString()

    def mean_of_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = []
                for i, matrix in enumerate(shared.value, 1):
                    near = matrix_of(part.column(i)) @ matrix.T
                    k = min(top, near.shape[1])
                    near.partition(near.shape[1] - k, axis=1)
                    found.append(near[:, -k:].mean(axis=1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.stack(found, axis=1).tolist(), pa.list_(pa.float64()))], ["row", "csls"])

    return rows.select("row", *spaces).mapInArrow(mean_of_best, f"row {kind}, csls array<double>")


def hubness_of_all(rows: DataFrame, spaces: list[str], top: int = 10) -> DataFrame:
    """(row, csls): as hubness(), against all rows. Rows are packed into blocks, and every block
    meets every other: the products grow with the square of the rows, what a task holds does
    not, and only the largest of a block and HUB_GROUP others leave the task. Rows are read
    once, and the blocks are written."""
    kind, sides = rows.schema["row"].dataType.simpleString(), range(len(spaces))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = TaskContext.get().partitionId() << 32, []

        def packed(table: pa.Table, number: int) -> pa.RecordBatch:
            own = table.column("row").combine_chunks()
            matrices = [pa.array([matrix_of(table.column(s)).tobytes()], pa.binary()) for s in spaces]
            return pa.RecordBatch.from_arrays([pa.array([first + number]), pa.array([len(own)]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *matrices], ["block", "n", "rows", *(f"m{i}" for i in sides)])

        number = 0
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= HUB_BLOCK:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, HUB_BLOCK), number)
                held, number = table.slice(HUB_BLOCK).to_batches(), number + 1
        if sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held), number)

    blocks = written(rows.select("row", *spaces).mapInArrow(pack, f"block long, n long, rows array<{kind}>, " + ", ".join(f"m{i} binary" for i in sides)), "hub_blocks")
    count = blocks.count()
    own = blocks.drop("rows").repartitionByRange(max(count, 1), "block")
    others = blocks.select(F.col("block").alias("other"), F.col("n").alias("n_other"), *(F.col(f"m{i}").alias(f"o{i}") for i in sides)).repartitionByRange(-(-count // HUB_GROUP) or 1, "other")

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for at, (block, n, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "n", "n_other")))):
                best = held.setdefault(block, [np.empty((n, 0)) for _ in sides])
                for i in sides:
                    a, b = (np.frombuffer(batch.column(f"{side}{i}")[at].as_buffer()).reshape(k, -1) for side, k in (("m", n), ("o", m)))
                    best[i] = _larger(best[i], a, b, top)
        for block, best in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in best)], ["block", *(f"b{i}" for i in sides)])

    def mean(names: pa.Table, found: pa.Table) -> pa.Table:
        row = names.column("rows").combine_chunks().flatten()
        means = [_largest_of(np.hstack([np.frombuffer(x.as_buffer()).reshape(len(row), -1) for x in found.column(f"b{i}")]), top).mean(axis=1) for i in sides]
        return pa.table({"row": row, "csls": pa.array(np.stack(means, axis=1).tolist(), pa.list_(pa.float64()))})

    met = own.hint("shuffle_replicate_nl").crossJoin(others).mapInArrow(largest, "block long, " + ", ".join(f"b{i} binary" for i in sides))
    return blocks.select("block", "rows").groupBy("block").cogroup(met.groupBy("block")).applyInArrow(mean, f"row {kind}, csls array<double>")


def _largest_of(values: np.ndarray, top: int) -> np.ndarray:
    """The largest of each line of values, top of them or as many as there are, in any order."""
    k = min(top, values.shape[1])
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k:]


def _larger(held: np.ndarray, own: np.ndarray, of: np.ndarray, top: int) -> np.ndarray:
    """The largest, for each row of own, of what is held of it and of its products with of."""
    out = np.empty((len(own), min(top, held.shape[1] + len(of))))
    for at in range(0, len(own), BATCH):
        part, products = held[at : at + BATCH], own[at : at + BATCH] @ of.T
        if part.shape[1] == top:
            # what is above the least one held, and no number, which counts as the largest
            mine, place = np.divmod(np.flatnonzero(~(products <= part.min(axis=1, keepdims=True))), len(of))
            number = np.arange(len(mine)) - np.searchsorted(mine, mine)
            more = np.full((len(part), number.max(initial=-1) + 1), -np.inf)
            more[mine, number] = products[mine, place]
            products = more
        out[at : at + BATCH] = _largest_of(np.hstack([part, products]), top)
    return out


def quantised(rows: DataFrame, spaces: list[str]) -> DataFrame:
    """rows with each space as int8 codes and <space>_scale."""
    out = rows
    for s in spaces:
        out = out.withColumn(f"{s}_scale", quantise_scale(F.col(s))).withColumn(s, quantise(F.col(s), F.col(f"{s}_scale")))
    return out


def covariance(rows: DataFrame, column: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the vectors, over all of them. Each task adds up its own
    moments, so what reaches the driver is of the size of the dimensions."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, 0.0, 0.0
        for batch in batches:
            v = np.array(batch.column(0).to_pylist(), dtype=float)
            if len(v):
                n, total, square = n + len(v), total + v.sum(axis=0), square + v.T @ v
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], ["n", "total", "square"])

    n, total, square = 0, 0.0, 0.0
    for row in rows.select(column).mapInArrow(sums, "n long, total array<double>, square array<double>").toLocalIterator():
        own = np.array(row.total)
        n, total, square = n + row.n, total + own, square + np.array(row.square).reshape(len(own), -1)
    if n == 0:
        raise ValueError("no vectors to take a covariance of")
    mean = total / n
    return mean, square / n - np.outer(mean, mean)


def whitening(rows: DataFrame, column: str = "v", floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix) of principal component whitening: eigenvectors of the
    covariance over the roots of their eigenvalues."""
    mean, square = covariance(rows, column)
    values, vectors = np.linalg.eigh(square)
    return mean, vectors / np.sqrt(np.maximum(values, floor))


def whitened(rows: DataFrame, mean: np.ndarray, matrix: np.ndarray, key: str = "row", column: str = "v", into: str = "cls_wh", unit: bool = True) -> DataFrame:
    """(key, into): (v - mean) times the matrix, normalised unless unit is False; the squared
    length of what is not normalised is v's squared distance from the mean by the covariance."""
    kind = rows.schema[key].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = (np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1) - mean) @ matrix
            if unit:
                v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v.tolist(), pa.list_(pa.float64()))], [key, into])

    return rows.select(key, column).mapInArrow(project, f"{key} {kind}, {into} array<double>")


def write_index(places: DataFrame, path: str, cells_of_bucket: int = CELLS_OF_BUCKET, rows_of_file: int = ROWS_OF_FILE) -> None:
    """path/places: places in order of their cells, in folders of neighbouring cells and
    files of some rows_of_file, so that a cell of any size is spread over files of its
    own; path/cells: (cell, cell_bucket, n) of each cell that has places; path/columns: no
    rows, only what columns places have."""
    bucket = F.floor(F.col("cell") / cells_of_bucket).cast("int").alias("cell_bucket")
    sizes = places.groupBy("cell").agg(F.count("*").alias("n")).select("cell", bucket, "n")
    sizes.coalesce(1).write.parquet(f"{path}/cells")
    files = -(-(places.sparkSession.read.parquet(f"{path}/cells").agg(F.sum("n")).first()[0] or 0) // rows_of_file) or 1
    dealt = places.select("*", bucket).repartitionByRange(files, "cell", "row").sortWithinPartitions("cell_bucket", "cell", "row")
    dealt.write.partitionBy("cell_bucket").parquet(f"{path}/places")
    places.limit(0).coalesce(1).write.parquet(f"{path}/columns")


@dataclass
class PlaceIndex:
    """An index written so. Searches read the folders of their cells only, and never
    shuffle its places: cells (cell, cell_bucket, n) are few, and go to every task."""

    places: DataFrame
    cells: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PlaceIndex:
        columns = spark.read.parquet(f"{path}/columns").schema.add("cell_bucket", T.IntegerType())
        return cls(spark.read.schema(columns).parquet(f"{path}/places"), spark.read.parquet(f"{path}/cells"))

    def in_cells(self, gated: DataFrame) -> DataFrame:
        """The places of the cells of gated (cell, p, ...). Which folders those are is
        known when the gate is: the folder is a key of the join, so others are pruned.
        The filter, which holds for every p, tells Spark that the gate is selective."""
        wanted = gated.where("p >= 0").select("cell").distinct().join(F.broadcast(self.cells), "cell").select("cell_bucket", "cell")
        return self.places.join(F.broadcast(wanted), ["cell_bucket", "cell"], "left_semi")

    def sizes(self) -> DataFrame:
        return self.cells.select("cell", "n")

    def winners(self, top: DataFrame, few: bool) -> DataFrame:
        """The places of top (cell, row, rank, ...), from the folders of their cells only;
        few: top is small enough to go to every task."""
        rows = top.where("rank >= 0").select("cell", "row").distinct().join(F.broadcast(self.cells.select("cell", "cell_bucket")), "cell")
        near = self.places.join(F.broadcast(rows.select("cell_bucket", "cell").distinct()), ["cell_bucket", "cell"], "left_semi")
        return near.join(F.broadcast(rows) if few else rows, ["cell_bucket", "cell", "row"], "left_semi")


@dataclass
class PlainPlaces:
    """Places in any frame: every search reads all of them."""

    places: DataFrame

    def in_cells(self, gated: DataFrame) -> DataFrame:
        return self.places

    def sizes(self) -> DataFrame:
        return self.places.groupBy("cell").agg(F.count("*").alias("n"))

    def winners(self, top: DataFrame, few: bool) -> DataFrame:
        rows = top.select("row").distinct()
        return self.places.join(F.broadcast(rows) if few else rows, "row", "left_semi")


def as_index(places):  # noqa: ANN001, ANN201
    """An index as it is, or a frame of places as one."""
    return PlainPlaces(places) if isinstance(places, DataFrame) else places


def open_index(spark: SparkSession, path: str) -> PlaceIndex | PlainPlaces:
    """What write_index() wrote at path, or any Parquet table of places."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cells")
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return PlaceIndex.open(spark, path) if there else PlainPlaces(spark.read.parquet(path))


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row on two runs (qid, v, cell): mean cosine, largest difference of a
    component, share of equal cells in percent."""
    rows = a.join(b.select("qid", F.col("v").alias("v2"), F.col("cell").alias("cell2")), "qid")
    cosine = dot(F.col("v"), F.col("v2")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("v2"), F.col("v2")))
    largest = F.array_max(F.zip_with("v", "v2", lambda x, y: F.abs(x - y)))
    return rows.agg(F.avg(cosine).alias("mean_cosine"), F.max(largest).alias("max_difference"), (F.avg((F.col("cell") == F.col("cell2")).cast("double")) * 100).alias("same_cell"))

"""Assets: manifests, file lists, shards, images, flat index files."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.operators.ranks import ranked

MANIFEST = "version int, tag string, base_url string, total_bytes long, files array<struct<path string, bytes long, sha256 string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of a manifest's files."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.explode("files").alias("f")).select("f.*")


def hashed(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of files (path, content)."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files of a folder whose names match."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def manifest_object(files: DataFrame, tag: str, base_url: str, version: int = 1) -> dict:
    """A manifest of files (path, bytes, sha256), in order of their paths; assets are
    few, whatever their size."""
    rows = sorted((r.path, r.bytes, r.sha256) for r in files.collect())
    return {"version": version, "tag": tag, "base_url": base_url, "total_bytes": sum(r[1] for r in rows), "files": [{"path": p, "bytes": n, "sha256": h} for p, n, h in rows]}


def totals(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """One row: how many files and bytes a manifest has, and how many are not there yet."""
    left = to_do(manifest, present).agg(F.count("*").alias("files_left"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_left"))
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).crossJoin(left)


def head(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n rows in an order, with their number i from 0: a sample that is
    asked for, such as the first images of a validation set."""
    first = rows.orderBy(*by).limit(n)
    return first.withColumn("i", (F.row_number().over(W.orderBy(*by)) - 1).cast("long"))


def to_do(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """The files of a manifest that are not there in the size it states."""
    return manifest.join(present, ["path", "bytes"], "left_anti")


def mismatched(manifest: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, bytes, found): files that a listing lacks or has in another size."""
    found = remote.select("path", F.col("bytes").alias("found"))
    return manifest.join(found, "path", "left").where(F.col("found").isNull() | (F.col("found") != F.col("bytes"))).select("path", "bytes", "found")


def shard_number(name: Column) -> Column:
    """The number at the end of _r<number>, by which shards are in order."""
    return F.regexp_extract(name, r"_r(\d+)", 1).try_cast("int")


def numbered(rows: DataFrame, name: str, at: str) -> DataFrame:
    """rows with shard and row: their place when shards are read in the order of
    their numbers. The rows of a shard are counted by ranges of it, so that no task
    holds a shard; a shard adds the sizes of those before it."""
    sharded = rows.withColumn("shard", shard_number(F.col(name)))
    sizes = sharded.groupBy("shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranked(sharded.where("shard is not null"), ["shard"], [F.asc(at)], into="within").join(sizes.select("shard", before.alias("before")), "shard")
    return placed.withColumn("row", F.col("before") + F.col("within")).drop("before", "within")


def image_number(path: Column) -> Column:
    """The number of a file name such as val_0007.jpg."""
    return F.regexp_extract(path, r"_(\d+)\.\w+$", 1).try_cast("int")


def read_flat(spark: SparkSession, path: str, kind: str, width: int, rows_per_part: int = 1 << 16) -> DataFrame:
    """(row, values) of a headerless file of numbers, width to a row, little
    endian; kind is numpy's, such as i1, u2, u4 or f4. The file must be whole rows.
    Tasks read ranges of rows, so files and columns of any size can be read."""
    spark.dataSource.register(FlatSource)
    options = {"kind": kind, "width": str(width), "rows": str(rows_per_part)}
    return spark.read.format("waymark_flat").options(**options).load(path)


class FlatSource(DataSource):
    """Ranges of rows of a flat file, by whatever file system its URI names."""

    @classmethod
    def name(cls) -> str:
        return "waymark_flat"

    def schema(self) -> str:
        return f"row long, values array<{'double' if self.options['kind'].startswith('f') else 'long'}>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _FlatReader(self.options["path"], self.options["kind"], int(self.options["width"]), int(self.options["rows"]))


@dataclass
class _Range(InputPartition):
    first: int
    rows: int


class _FlatReader(DataSourceReader):
    def __init__(self, path: str, kind: str, width: int, rows: int) -> None:
        self.path, self.type, self.width, self.rows = path, np.dtype(f"<{kind}"), width, rows

    def _file(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        system, place = self._file()
        n, rest = divmod(system.get_file_info(place).size, self.type.itemsize * self.width)
        if rest:
            raise ValueError(f"{self.path}: not a number of rows of {self.width}")
        return [_Range(i, min(self.rows, n - i)) for i in range(0, n, self.rows)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        system, place = self._file()
        row = self.type.itemsize * self.width
        with system.open_input_file(place) as file:
            data = file.read_at(partition.rows * row, partition.first * row)
        values = np.frombuffer(data, dtype=self.type).astype(np.float64 if self.type.kind == "f" else np.int64)
        for at in range(0, partition.rows, 4096):
            n = min(4096, partition.rows - at)
            own = pa.array(values[at * self.width : (at + n) * self.width])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.width, pa.int32()), own)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + partition.first + at), lists], ["row", "values"])


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape, values) of the arrays of a .npz bundle: models, centroids and other
    small parameters. Text and complex arrays are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                with np.load(io.BytesIO(data), allow_pickle=False) as bundle:
                    own = {k: bundle[k] for k in bundle.files if bundle[k].dtype.kind in "biuf"}
                arrays = [pa.array(list(own)), pa.array([list(x.shape) for x in own.values()], pa.list_(pa.int64())), pa.array([x.ravel().astype(float).tolist() for x in own.values()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["name", "shape", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "name string, shape array<long>, values array<double>")


def centroids(bundle: DataFrame, name: str = "centroids") -> DataFrame:
    """(cell, v): the rows of a bundle's matrix, one for each cell."""
    width = F.element_at("shape", -1).cast("int")
    rows = bundle.where((F.col("name") == name) & (F.size("shape") == 2)).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("shape")[0].cast("int") - 1)))
    return rows.select("cell", F.slice("values", F.col("cell") * width + 1, width).alias("v"))

"""The flat form of a place index: a headerless file for each column, rows in order of
their cells.

Reading asks for columns and opens those files only; a task reads one range of rows from
each of them. Files must agree on the number of rows. Writing puts every row at its place
in files of their final size, from all tasks at once, under names of their own; they get
their right names when all tasks are done, and go when one fails. That needs files that
can be written at any place, as local and mounted ones can.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from waymark.operators.index import cell_offsets
from waymark.operators.ranks import ranked
from waymark.scratch import written

#: Names of files and kinds of their numbers; fixed values.
LATLON, CELLS, OFFSETS, HUBNESS, CODES, SCALE = ("latlon.f32", "<f4"), ("cell_id.u16", "<u2"), ("cell_offsets.u32", "<u4"), ("csls_r.f32", "<f4"), (".i8", "i1"), (".scale.f32", "<f4")
#: Rows of a task, and of a batch.
ROWS_OF_TASK, ROWS_OF_BATCH = 1 << 16, 2048
#: The format holds so many cells, and rows (its readers take offsets as signed numbers).
MOST_CELLS, MOST_ROWS = 1 << 16, (1 << 31) - 1


@dataclass(frozen=True)
class File:
    """A file of the format: numbers of a kind, width to a row."""

    name: str
    kind: str
    width: int

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.kind).itemsize * self.width


def file_of(column: str, widths: dict[str, int]) -> File | None:
    """The file that holds a column; row is none: it is the place within all of them.
    widths has the numbers of a row of csls and of each space."""
    if column == "row":
        return None
    if column in ("lat", "lon"):
        return File(*LATLON, 2)
    if column == "cell":
        return File(*CELLS, 1)
    if column == "csls":
        return File(*HUBNESS, widths[column])
    if column.endswith("_scale"):
        return File(column.removesuffix("_scale") + SCALE[0], SCALE[1], 1)
    return File(column + CODES[0], CODES[1], widths[column])


def columns_of(spaces: list[str]) -> list[str]:
    return ["row", "cell", "lat", "lon", "csls", *(c for s in spaces for c in (s, f"{s}_scale"))]


def ddl(columns: list[str]) -> str:
    kind = {"row": "long", "cell": "int", "lat": "double", "lon": "double", "csls": "array<double>"}
    return ", ".join(f"{c} {kind.get(c) or ('double' if c.endswith('_scale') else 'array<tinyint>')}" for c in columns)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def is_flat(path: str) -> bool:
    """Whether a folder holds such an index. A path of a file system that only Spark
    knows does not."""
    try:
        system, place = _system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return system.get_file_info(f"{place}/{CELLS[0]}").type == fs.FileType.File


def _numbers(system: fs.FileSystem, place: str, kind: str) -> np.ndarray:
    with system.open_input_file(place) as file:
        return np.frombuffer(file.read(), dtype=kind)


def offsets_of(path: str) -> np.ndarray:
    """Where the rows of each cell begin, and their number at the end."""
    system, place = _system(path)
    return _numbers(system, f"{place}/{OFFSETS[0]}", OFFSETS[1]).astype(np.int64)


class FlatIndexSource(DataSource):
    """Rows of a folder of flat files. The schema says which columns, and so which files."""

    @classmethod
    def name(cls) -> str:
        return "waymark_index"

    def schema(self) -> str:
        raise ValueError("give the columns as a schema")

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(schema.names, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return _Writer(schema.names, self.options)


@dataclass
class _Rows(InputPartition):
    first: int
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict[str, str]) -> None:
        self.columns, self.path = columns, options["path"]
        self.files = {c: file_of(c, json.loads(options["widths"])) for c in columns}
        self.rows, self.ranges = int(options["rows"]), options.get("ranges")

    def partitions(self) -> list[InputPartition]:
        system, place = _system(self.path)
        known = {File(*CELLS, 1), *(f for f in self.files.values() if f)}
        sizes = {f.name: divmod(system.get_file_info(f"{place}/{f.name}").size or 0, f.row_bytes) for f in known if self._there(system, f"{place}/{f.name}")}
        n = sizes[CELLS[0]][0]
        wrong = sorted(f"{name}: {whole} rows and {rest} bytes" for name, (whole, rest) in sizes.items() if rest or whole != n)
        if wrong:
            raise ValueError(f"{self.path} has {n} rows, but not {', '.join(wrong)}")
        ranges = [(0, n)] if self.ranges is None else [tuple(map(int, x.split("-"))) for x in self.ranges.split(",") if x]
        return [_Rows(i, min(self.rows, b - i)) for a, b in ranges for i in range(a, b, self.rows)] or [_Rows(0, 0)]

    def _there(self, system: fs.FileSystem, place: str) -> bool:
        if system.get_file_info(place).type != fs.FileType.File:
            raise FileNotFoundError(place)
        return True

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        system, place = _system(self.path)
        opened = {f: system.open_input_file(f"{place}/{f.name}") for f in {f for f in self.files.values() if f}} if partition.rows else {}
        try:
            for at in range(partition.first, partition.first + partition.rows, ROWS_OF_BATCH):
                n = min(ROWS_OF_BATCH, partition.first + partition.rows - at)
                read = {f: np.frombuffer(file.read_at(n * f.row_bytes, at * f.row_bytes), dtype=f.kind).reshape(n, f.width) for f, file in opened.items()}
                yield pa.RecordBatch.from_arrays([self._column(c, read, at, n) for c in self.columns], self.columns)
        finally:
            for file in opened.values():
                file.close()

    def _column(self, column: str, read: dict[File, np.ndarray], at: int, n: int) -> pa.Array:
        file = self.files[column]
        if file is None:
            return pa.array(np.arange(at, at + n))
        values = read[file]
        if column == "cell":
            return pa.array(values[:, 0].astype(np.int32))
        if column == "csls" or file.kind == "i1":
            own = pa.array(values.ravel().astype(np.float64 if column == "csls" else np.int8))
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * file.width, pa.int32()), own)
        return pa.array(values[:, 1 if column == "lon" else 0].astype(np.float64))


@dataclass
class _Written(WriterCommitMessage):
    rows: int


class _Writer(DataSourceArrowWriter):
    """Puts the columns of a frame (row counts the rows from 0) into files of n rows."""

    def __init__(self, columns: list[str], options: dict[str, str]) -> None:
        self.n, self.token = int(options["n"]), options["token"]
        self.files: dict[File, list[str]] = {}
        for c in columns:
            if file := file_of(c, json.loads(options["widths"])):
                self.files.setdefault(file, []).append(c)
        self.path = local(options["path"])

    def _draft(self, file: File) -> str:
        return f"{self.path}/.{self.token}/{file.name}"

    def lay_out(self) -> None:
        """The drafts in their final size, before any task: tasks create nothing, so one
        that is killed late cannot bring back what abort() has removed."""
        os.makedirs(f"{self.path}/.{self.token}")
        for file in self.files:
            with open(self._draft(file), "wb") as draft:
                draft.truncate(self.n * file.row_bytes)

    def _values(self, batch: pa.RecordBatch, file: File) -> np.ndarray:
        own = [batch.column(c) for c in self.files[file]]
        flat = [x.flatten() if pa.types.is_list(x.type) or pa.types.is_large_list(x.type) else x for x in own]
        if any(len(x) * len(own) != batch.num_rows * file.width or x.null_count for x in flat) or any(x.null_count for x in own):
            raise ValueError(f"{file.name}: rows of other than {file.width} numbers")
        return np.stack([x.to_numpy(zero_copy_only=False) for x in flat], axis=-1).astype(file.kind).reshape(batch.num_rows, file.width)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        opened = {f: os.open(self._draft(f), os.O_WRONLY) for f in self.files}
        done = 0
        try:
            for batch in iterator:
                row = batch.column("row").to_numpy()
                values = {f: self._values(batch, f) for f in opened}
                edges = np.concatenate([[0], np.flatnonzero(np.diff(row) != 1) + 1, [len(row)]])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    for f, handle in opened.items():
                        if b > a:
                            _put(handle, values[f][a:b].tobytes(), int(row[a]) * f.row_bytes)
                done += len(row)
        finally:
            for handle in opened.values():
                os.close(handle)
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = sum(m.rows for m in messages if m)
        if done != self.n:
            self.abort(messages)
            raise ValueError(f"{done} of {self.n} rows were written")
        for f in self.files:
            os.replace(self._draft(f), f"{self.path}/{f.name}")
        os.rmdir(f"{self.path}/.{self.token}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(f"{self.path}/.{self.token}", ignore_errors=True)


def _put(handle: int, data: bytes, at: int) -> None:
    while data:
        done = os.pwrite(handle, data, at)
        data, at = data[done:], at + done


def local(path: str) -> str:
    """The folder of a path that can be written at any place."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: flat files are written to local or mounted folders")
    return parts.path or path


def read_index(spark: SparkSession, path: str, widths: dict[str, int], columns: list[str], cells: list[int] | None = None, rows_of_task: int = ROWS_OF_TASK) -> DataFrame:
    """The rows of a flat index, row from 0 in order of the cells, with some columns; all
    rows, or those of some cells, whose ranges the offsets tell. widths has the numbers of
    a row of csls and of each space. Files of any other size are an error."""
    spark.dataSource.register(FlatIndexSource)
    options = {"widths": json.dumps(widths), "rows": str(rows_of_task)}
    if cells is not None:
        offsets = offsets_of(path)
        ranges: list[list[int]] = []
        for c in sorted({c for c in cells if 0 <= c < len(offsets) - 1}):
            if ranges and ranges[-1][1] == offsets[c]:
                ranges[-1][1] = int(offsets[c + 1])
            else:
                ranges.append([int(offsets[c]), int(offsets[c + 1])])
        options["ranges"] = ",".join(f"{a}-{b}" for a, b in ranges)
    return spark.read.format("waymark_index").schema(ddl(columns)).options(**options).load(path)


def write_flat_index(places: DataFrame, path: str, spaces: list[str], n_cells: int) -> DataFrame:
    """Write places (row, cell, lat, lon, csls, and for each space codes and scale) as a
    flat index of n_cells cells, and return (row, at): where each row went. Rows are put in
    order of cell and row by ranges; files that are there are replaced when all is written."""
    if n_cells > MOST_CELLS:
        raise ValueError(f"{n_cells} cells; the format holds {MOST_CELLS}")
    spark = places.sparkSession
    at = written(ranked(places.select("row", "cell"), [], [F.asc("cell"), F.asc("row")], into="at"), "order")
    n, lowest, highest = at.agg(F.count("*"), F.min("cell"), F.max("cell")).first()
    if n > MOST_ROWS or (n and (lowest < 0 or highest >= n_cells)):
        raise ValueError(f"{n} rows, cells {lowest} to {highest}: not a flat index of {n_cells} cells")
    first = places.select(*(F.size(F.col(c)).alias(c) for c in (*spaces, "csls"))).first() if n else None
    widths = {c: first[c] if first else 0 for c in (*spaces, "csls")}
    folder, token = local(path), uuid.uuid4().hex
    os.makedirs(folder, exist_ok=True)
    spark.dataSource.register(FlatIndexSource)
    wide = places.join(at.select("row", "at"), "row").drop("row").withColumnRenamed("at", "row")
    dealt = wide.repartitionByRange(max(1, -(-n // ROWS_OF_TASK)), "row").sortWithinPartitions("row").select(*columns_of(spaces))
    options = {"path": folder, "widths": json.dumps(widths), "n": str(n), "token": token}
    _Writer(columns_of(spaces), options).lay_out()
    dealt.write.format("waymark_index").options(**options).mode("append").save()
    counts = cell_offsets(at, n_cells).orderBy("cell").toArrow()  # of the number of cells, which the format bounds
    offsets = np.append(counts.column("offset").to_numpy(), n).astype(OFFSETS[1])
    draft = f"{folder}/.{OFFSETS[0]}.{token}"
    with open(draft, "wb") as file:
        file.write(offsets.tobytes())
    os.replace(draft, f"{folder}/{OFFSETS[0]}")
    return at.select("row", "at")


class FlatIndex:
    """Searches of a flat index read the ranges of their cells only."""

    def __init__(self, spark: SparkSession, path: str, spaces: list[str] | None = None, dim: int | None = None) -> None:
        """The files of the folder tell the spaces, if they are not given, and the length
        of the vectors of each and of the columns of hubness, if dim is not."""
        self.spark, self.path = spark, path
        system, place = _system(path)
        sizes = {os.path.basename(i.path): i.size for i in system.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File}
        n = sizes[CELLS[0]] // 2
        self.spaces = spaces or sorted(x.removesuffix(CODES[0]) for x in sizes if x.endswith(CODES[0]) and not x.startswith("."))
        self.widths = {s: sizes.get(s + CODES[0], 0) // n if dim is None and n else dim or 0 for s in self.spaces}
        self.widths["csls"] = sizes.get(HUBNESS[0], 0) // (4 * n) if n else 0

    def read(self, columns: list[str] | None = None, cells: list[int] | None = None) -> DataFrame:
        return read_index(self.spark, self.path, self.widths, columns or columns_of(self.spaces), cells)

    def in_cells(self, gated: DataFrame) -> DataFrame:
        return self.read(cells=[r.cell for r in gated.select("cell").distinct().collect()])

    def sizes(self) -> DataFrame:
        n = np.diff(offsets_of(self.path))
        return self.spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(n)), pa.int32()), "n": pa.array(n)})).where("n > 0")

    def winners(self, top: DataFrame, few: bool) -> DataFrame:
        rows = top.select("row").distinct()
        near = self.read(["row", "cell", "lat", "lon", "cls", "cls_scale"], [r.cell for r in top.select("cell").distinct().collect()])
        return near.join(F.broadcast(rows) if few else rows, "row", "left_semi")

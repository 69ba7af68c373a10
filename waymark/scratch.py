"""Intermediate tables in the folder that driver and executors share, and single files."""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []
_once: dict[tuple[str, ...], tuple[str, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where
    that is unset, a temporary one on a local master; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _drop_scratch() -> None:
    for spark, path in _scratch:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone: nothing left to delete with
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    if not _scratch:
        atexit.register(_drop_scratch)
    path = f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a table of the shared folder and read back: cuts
    lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of the files at paths and below: one call
    for each folder, whatever the number of files. A path that is not there counts too."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found, left = hashlib.sha256(), list(paths)
    while left:
        path = left.pop()
        target = jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(conf)
        files = system.listStatus(target) if system.exists(target) else []
        text = jvm.org.apache.commons.lang3.ArrayUtils.toString(files) if files else ""
        found.update(f"{path}\n{re.sub(r'access_time=[0-9]+', '', text)}\n".encode())
        if "isDirectory=true" in text:
            left += sorted(f.getPath().toString() for f in files if f.isDirectory())
    return found.hexdigest()


def once(spark: SparkSession, key: tuple[str, ...], make: Callable[[], DataFrame], inputs: list[str]) -> DataFrame:
    """What make() gives, written the first time that a session asks for the key, and
    again when the files at inputs, which make() reads, are others than then."""
    return spark.read.parquet(once_path(spark, key, lambda path: make().write.parquet(path), inputs))


def once_path(spark: SparkSession, key: tuple[str, ...], write: Callable[[str], None], inputs: list[str]) -> str:
    """As once(): the path at which write() has put what it makes."""
    whole = (spark.sparkContext.applicationId, *key)
    now = stamp(spark, *inputs)
    if whole not in _once or _once[whole][0] != now:
        path = scratch_path(spark, key[0])
        write(path)
        _once[whole] = (now, path)
    return _once[whole][1]


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """One file, on any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()

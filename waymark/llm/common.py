"""What the operators share: tables, filters by id, components of a graph."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.scratch import scratch_path, shared_dir, written

__all__ = ["bound_batches", "components", "held_out", "id_filter", "scratch_path", "shared_dir", "table", "tidied", "written"]

#: Rows and bytes of a batch that goes to Python, at most: texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits of batches to BATCH, where they are above."""
    for key, most in BATCH.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read in batches of bounded size."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Give memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """work on a task's batches, after which the worker gives memory back: workers
    that wait for their next task stay as small as they can."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the rows kept from training: crc32 of the id as text, mod 4, is
    2. A null id is not held out (and is no training row either)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


#: Bits of id_filter(): 2 MB, whatever the number of ids.
FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame, column: str) -> Column:
    """A predicate on a column of that name which holds for every id of ids and
    for few others (a Bloom filter of fixed size), to thin out wide rows before
    a join on the id. With more ids than the filter is made for it lets more
    rows pass; the join decides."""
    places = [F.pmod(F.xxhash64(F.col(column).cast("long"), F.lit(i)), F.lit(FILTER_BITS)) for i in range(2)]
    bits = ids.select(F.explode(F.array(*places)).alias("place"))
    word, bit = F.shiftright("place", 5), F.expr("shiftleft(1L, cast(place & 31 as int))")
    table = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for row in bits.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        table[row.word] = row.bits
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def may_be_in(a: pa.Array, b: pa.Array) -> pa.Array:
        at = [x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
        hit = [(shared.value[x >> 5] >> (x & 31).astype(np.uint32)) & 1 for x in at]
        return pa.array((hit[0] & hit[1]).astype(bool))

    return may_be_in(*places)


def components(edges: DataFrame, name: str = "edges", max_rounds: int = 40) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (id,
    component_id) per id in an edge, component_id the smallest id reachable.

    Large-star and small-star in turn. A hub's neighbours are never gathered:
    its minimum comes from a combined aggregate and goes back by a join whose
    hot side Spark can split. Ends when a round changes nothing.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    seen = _digest(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written, so that the join deals both sides anew and can split a hub's rows
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), name)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        before, seen = seen, _digest(now)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    star = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return star.unionByName(star.select(F.col("component_id").alias("id"), "component_id").distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (row[0], row[1])

"""Scans over ordered values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from waymark.scratch import written

#: What a range of the order knows of each of its rows: the range and the place in it, the
#: mean as if the series began here, and the map (of a mean that came before) if it may not have.
STEPS = "__part int, __i long, __own double, __a double, __b double"


def smoothed(values: Column, keep: float = 0.75) -> Column:
    """The exponentially weighted mean of an array in order: the first value as it
    is, then keep of the mean before and the rest of the value. Null if empty."""
    step = lambda s, x: F.when(s.isNull() | (s == 0.0), x.cast("double")).otherwise(s * keep + x * (1 - keep))
    return F.aggregate(values, F.lit(None).cast("double"), step)


def by_window(samples: Column, ms: int = 500) -> Column:
    """Speeds in bytes a second from samples (t in ms, bytes), sorted by t: bytes
    are added up until more than ms have passed since the last speed."""
    start = F.struct(F.lit(0.0).alias("bytes"), F.lit(0).cast("long").alias("since"), F.array().cast("array<double>").alias("speeds"))

    def step(s: Column, x: Column) -> Column:
        total = s["bytes"] + x["bytes"]
        passed = x["t"] - s["since"]
        due = passed > ms
        return F.struct(
            F.when(due, 0.0).otherwise(total).alias("bytes"), F.when(due, x["t"]).otherwise(s["since"]).cast("long").alias("since"),
            F.when(due, F.concat(s["speeds"], F.array(total * 1000.0 / passed))).otherwise(s["speeds"]).alias("speeds"),
        )

    return F.aggregate(samples, start, step, lambda s: s["speeds"])


def smoothed_rows(rows: DataFrame, keys: list[str], order: list[str], value: str, keep: float = 0.75, into: str = "smoothed") -> DataFrame:
    """rows with the exponentially weighted mean up to each, within its series (equal keys)
    by the order, which must be without ties: zeros at the start of a series are 0, the
    first other value is taken as it is, then each mean is keep of the one before and the
    rest of the value. A null value has a null mean, and the series starts anew after it.
    Where no value is negative the last mean is that of smoothed().

    A step is an affine map of the mean before it, so maps compose: rows are dealt by
    ranges of the order and scanned once, each range also composing the map of its first
    series, which may have begun in an earlier one. From a row for each range follows the
    mean with which each begins. No task holds more of a series than its range."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__value", F.col(value).cast("double")).repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    columns = rows.columns
    names = [*columns, *(f.split()[0] for f in STEPS.split(", "))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, last = TaskContext.get().partitionId(), 0, None
        own, a, b = None, 1.0, 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            steps = []
            for begins, x in zip(_changes([batch.column(k) for k in keys], last), batch.column("__value").to_pylist()):
                if begins:
                    own, a = None, (a if i == 0 else None)
                own = x if not own or x is None else own * keep + x * (1 - keep)
                a, b = (None, None) if a is None or x is None else (a * keep, b * keep + x * (1 - keep))
                steps.append((own, a, b))
                i += 1
            last = [batch.column(k).slice(batch.num_rows - 1) for k in keys]
            own_, a_, b_ = (pa.array(c, pa.float64()) for c in zip(*steps))
            place = pa.array(range(i - batch.num_rows, i), pa.int64())
            given = [batch.column(n) for n in columns]
            yield pa.RecordBatch.from_arrays([*given, pa.array([part] * batch.num_rows, pa.int32()), place, own_, a_, b_], names)

    schema = spark.createDataFrame([], STEPS).schema
    steps = written(dealt.mapInArrow(scan, type(schema)(rows.schema.fields + schema.fields)), "smoothed")
    key = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))) if keys else F.lit(0)
    tail = F.struct(F.col("__own").alias("own"), F.col("__a").alias("a"), F.col("__b").alias("b"))
    ranges = steps.groupBy("__part").agg(F.min_by(key, "__i").alias("first"), F.max_by(key, "__i").alias("last"), F.max_by(tail, "__i").alias("tail"))
    before = spark.createDataFrame(_before(ranges.orderBy("__part").toLocalIterator()), "__part int, __before double")
    mean = F.when(F.col("__a").isNotNull() & (F.col("__before") != 0.0), F.col("__a") * F.col("__before") + F.col("__b")).otherwise(F.col("__own"))
    return steps.join(F.broadcast(before), "__part", "left").select(*columns, mean.alias(into))


def _changes(keys: list[pa.Array], last: list[pa.Array] | None) -> Iterator[bool]:
    """Whether each row's keys are others than those of the row before; nulls are equal."""
    n = len(keys[0]) if keys else None
    if n is None:
        yield last is None
        while True:
            yield False
    differs = [False] * n
    for j, k in enumerate(keys):
        before = pa.concat_arrays([last[j] if last else pa.nulls(1, k.type), k.slice(0, n - 1)])
        other = pc.if_else(pc.and_(k.is_valid(), before.is_valid()), pc.not_equal(k, before), pc.xor(k.is_valid(), before.is_valid()))
        differs = [d or o for d, o in zip(differs, other.to_pylist())]
    if last is None:
        differs[0] = True
    yield from differs


def _before(ranges: Iterator[Row]) -> list[tuple[int, float]]:
    """(range, the mean with which it begins), of those whose first series began before."""
    out, key, mean = [], None, None
    for r in ranges:
        if key is not None and r.first == key and mean is not None:
            out.append((r["__part"], mean))
        else:
            mean = None
        own, a, b = r.tail
        mean, key = (a * mean + b if a is not None and mean else own), r.last
    return out

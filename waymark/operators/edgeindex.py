"""Polygons as edges on squares, for points that ask what holds them or what is near.

The plane is dealt into squares that split in four where they have many edges. Of each
square and each ring that passes it or holds it there is one row, with the edges that
touch the square and whether the square's lower right corner is in the ring. A point finds
its square, and needs no other edges: going from that corner up the right side, and from
there to the point, it changes sides with each edge it crosses.

Grid lines are shifted by a little, so that corners of maps seldom lie on them. Where they
do, a point counts as a hair's breadth to the right and, by much less, above where it is,
as it does in the test of a ray.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import LAT_KM, LON_KM, segment_km
from waymark.scratch import scratch_path, written

#: Degrees of the largest squares, and of the shift of their lines.
SQUARE, SHIFT = 5.0, 0.00713
#: Edges of a square, above which it is split, at most so many times.
EDGES, LEVELS = 64, 12

_CELL = ["level", "gx", "gy"]


def _size(level: Column | int) -> Column:
    return F.lit(SQUARE) / F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)


def _place(x: Column, size: Column) -> Column:
    return F.floor((x - SHIFT) / size).cast("int")


def _line(place: Column, size: Column) -> Column:
    return place * size + SHIFT


def _cells(rows: DataFrame, level: Column, low_x: Column, high_x: Column, low_y: Column, high_y: Column) -> DataFrame:
    """rows with each square of the level that a box touches, be it on a side of both."""
    size, hair = _size(level), 1e-9
    out = rows.withColumn("level", level).withColumn("gx", F.explode(F.sequence(_place(low_x - hair, size), _place(high_x + hair, size))))
    return out.withColumn("gy", F.explode(F.sequence(_place(low_y - hair, size), _place(high_y + hair, size))))


def _edges(features: DataFrame) -> DataFrame:
    """(feature_id, ring, x1, y1, x2, y2) of all edges, each by itself."""
    rings = features.select("feature_id", F.posexplode("rings").alias("ring", "points")).where(F.size("points") > 0)
    after = lambda p, i: F.struct(p["lon"].alias("x1"), p["lat"].alias("y1"), F.get("points", (i + 1) % F.size("points"))["lon"].alias("x2"), F.get("points", (i + 1) % F.size("points"))["lat"].alias("y2"))
    return rings.select("feature_id", "ring", F.explode(F.transform("points", after)).alias("e")).select("feature_id", "ring", "e.*")


def _touching(edges: DataFrame, level: Column) -> DataFrame:
    x, y = (F.col("x1"), F.col("x2")), (F.col("y1"), F.col("y2"))
    return _cells(edges, level, F.least(*x), F.greatest(*x), F.least(*y), F.greatest(*y)).where(_passes())


def _quarters(rows: DataFrame) -> DataFrame:
    """rows with each of the four squares that theirs is split into."""
    four = F.explode(F.array(*(F.struct((F.col("gx") * 2 + i).alias("gx"), (F.col("gy") * 2 + j).alias("gy")) for i in (0, 1) for j in (0, 1))))
    return rows.withColumn("c", four).drop("gx", "gy").withColumn("level", F.col("level") + 1).select("*", "c.gx", "c.gy").drop("c")


def _sides() -> tuple[Column, Column, Column, Column]:
    """Left, right, lower and upper side of a row's square, a hair's breadth outside it."""
    size = _size(F.col("level"))
    wide = size * 1e-9 + 1e-12
    return _line(F.col("gx"), size) - wide, _line(F.col("gx") + 1, size) + wide, _line(F.col("gy"), size) - wide, _line(F.col("gy") + 1, size) + wide


def _overlaps(x_low: Column, x_high: Column, y_low: Column, y_high: Column) -> Column:
    left, right, low, high = _sides()
    return (left <= x_high) & (right >= x_low) & (low <= y_high) & (high >= y_low)


def _passes() -> Column:
    """Whether an edge touches a row's square: boxes overlap, and the square's corners are
    not all on one side of the edge."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    left, right, low, high = _sides()
    side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (left, right) for y in (low, high)]
    return _overlaps(F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)) & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)


@dataclass
class EdgeIndex:
    """rows: level, gx, gy, feature_id, name, ring, corner (whether the square's lower
    right corner is in the ring), edges, and the feature's box. levels: those that occur."""

    rows: DataFrame
    levels: list[int]

    def write(self, path: str) -> None:
        self.rows.write.parquet(path)

    @classmethod
    def read(cls, rows: DataFrame) -> EdgeIndex:
        return cls(rows, sorted(r.level for r in rows.select("level").distinct().collect()))


def edge_index(features: DataFrame, most: int = EDGES, levels: int = LEVELS) -> EdgeIndex:
    """The index of features (feature_id, name, rings, min_lon, min_lat, max_lon, max_lat).
    Squares of more than so many edges are split, up to so many times: a point where more
    edges meet than that stays in one. Each round deals the edges of such squares alone."""
    edges = written(_edges(features), "edges")
    here, done, split = _touching(edges, F.lit(0)), None, None
    for level in range(levels + 1):
        here = written(here, "dealt")
        counts = here.groupBy(*_CELL).agg(F.count("*").alias("n"))
        dense = written(counts.where((F.col("n") > most) & (F.col("level") < levels)).select(*_CELL), "dense")
        kept = here.join(dense, _CELL, "left_anti")
        done = kept if done is None else done.unionByName(kept)
        if dense.isEmpty():
            break
        split = dense if split is None else split.unionByName(dense)
        here = _quarters(here.join(dense, _CELL, "left_semi")).where(_passes())
    done = written(done, "edges_of_squares")

    # squares that no edge touches are leaves, too: the largest ones, and parts of those that were split
    boxes = features.select("feature_id", "name", "min_lon", "min_lat", "max_lon", "max_lat")
    rings = edges.groupBy("feature_id", "ring").agg(F.min("x1").alias("x_low"), F.max("x1").alias("x_high"), F.min("y1").alias("y_low"), F.max("y1").alias("y_high"))
    pairs = _cells(rings, F.lit(0), F.col("x_low"), F.col("x_high"), F.col("y_low"), F.col("y_high"))
    leaves = None
    for level in range(levels + 1 if split is not None else 1):
        pairs = written(pairs, "pairs")
        own = pairs if split is None else pairs.join(split.where(F.col("level") == level), _CELL, "left_anti")
        leaves = own if leaves is None else leaves.unionByName(own)
        if split is None:
            break
        inner = pairs.join(split.where(F.col("level") == level), _CELL, "left_semi")
        if inner.isEmpty():
            break
        pairs = _quarters(inner).where(_overlaps(F.col("x_low"), F.col("x_high"), F.col("y_low"), F.col("y_high")))
    leaves = written(leaves.select("feature_id", "ring", *_CELL).distinct(), "leaves")

    # a corner is in a ring if a ray from it, along the lower line of its square, meets an odd number of edges
    lines = written(leaves.select("feature_id", "ring", "level", "gy").distinct(), "lines")
    size = _size(F.col("level"))
    across = edges.join(lines, ["feature_id", "ring"]).withColumn("y", _line(F.col("gy"), size)).where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    across = across.select("feature_id", "ring", "level", "gy", F.when(F.col("y") == F.col("y2"), F.col("x2")).otherwise(F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))).alias("x"))
    corners = leaves.join(across, ["feature_id", "ring", "level", "gy"]).where(_line(F.col("gx") + 1, size) < F.col("x"))
    corners = corners.groupBy("feature_id", "ring", *_CELL).agg((F.count("*") % 2 == 1).alias("corner"))
    held = done.groupBy("feature_id", "ring", *_CELL).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    rows = leaves.join(corners, ["feature_id", "ring", *_CELL], "left").join(held, ["feature_id", "ring", *_CELL], "full_outer")
    rows = rows.withColumn("corner", F.coalesce("corner", F.lit(False))).where(F.col("corner") | F.col("edges").isNotNull()).join(boxes, "feature_id")
    path = scratch_path(features.sparkSession, "edge_index")
    rows.select(*_CELL, "feature_id", "name", "ring", "corner", F.coalesce("edges", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")).alias("edges"), "min_lon", "min_lat", "max_lon", "max_lat").write.parquet(path)
    return EdgeIndex.read(features.sparkSession.read.parquet(path))


def in_square(lat: Column, lon: Column) -> Column:
    """Whether a point is in the ring of a row of the index, of its own square."""
    size = _size(F.col("level"))
    right, low = _line(F.col("gx") + 1, size), _line(F.col("gy"), size)

    def beside(e: Column) -> Column:  # crossed on the way from the right side to the point
        at = e["x1"] + (lat - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return ((e["y1"] > lat) != (e["y2"] > lat)) & F.coalesce((lon < at) & (at <= right), F.lit(False))

    def upwards(e: Column) -> Column:  # crossed on the way up the right side
        slope = (e["y2"] - e["y1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0))
        at = F.when(e["x2"] == right, e["y2"]).otherwise(e["y1"] + (right - e["x1"]) * slope)
        above, below = (at > low) | ((at == low) & (slope > 0)), (at < lat) | ((at == lat) & (slope <= 0))
        return ((e["x1"] > right) != (e["x2"] > right)) & F.coalesce(above & below, F.lit(False))

    crossed = F.size(F.filter("edges", beside)) + F.size(F.filter("edges", upwards)) + F.col("corner").cast("int")
    return crossed % 2 == 1


def containing(points: DataFrame, index: EdgeIndex) -> DataFrame:
    """(point_id, feature_id, name): of the features that hold a point (point_id, lat, lon;
    in the outline and in no hole), the first. Points in none are left out."""
    at = F.explode(F.array(*map(F.lit, index.levels))) if index.levels else F.explode(F.array().cast("array<int>"))
    asked = points.select("point_id", "lat", "lon", at.alias("level"))
    size = _size(F.col("level"))
    asked = asked.withColumn("gx", _place(F.col("lon"), size)).withColumn("gy", _place(F.col("lat"), size))
    rows = index.rows.select(*_CELL, "feature_id", "name", "ring", "corner", "edges")
    rings = asked.join(rows, _CELL).where(in_square(F.col("lat"), F.col("lon")))
    held = rings.groupBy("point_id", "feature_id", "name").agg(F.min("ring").alias("first"), F.max("ring").alias("last")).where("first = 0 and last = 0")
    return held.groupBy("point_id").agg(F.min(F.struct("feature_id", "name")).alias("f")).select("point_id", "f.*")


def nearest_coast(points: DataFrame, index: EdgeIndex, max_km: float = 50.0, device: bool = False) -> DataFrame:
    """(point_id, feature_id, name, km): the feature whose rings come closest, below
    max_km; of equals the first. A point asks the squares that are within max_km of it.
    device: only outlines count, features are asked whose box is within km / 111 both ways,
    and a degree of latitude is 110.57 km."""
    lat, lon = F.col("lat"), F.col("lon")
    ky = 110.57 if device else LAT_KM
    east = LON_KM * F.cos(F.radians("lat"))
    # a hair more than max_km, so that rounding leaves out no square
    reach_lat = F.lit(max_km / ky * 1.000001)
    reach_lon = F.least(max_km * 1.000001 / F.greatest(east, F.lit(1e-6)), F.lit(360.0))
    pad_lat = F.lit(max_km / (111.0 if device else LAT_KM))
    pad_lon = pad_lat if device else max_km / F.greatest(east, F.lit(1.0))
    asked = points.select("point_id", "lat", "lon", reach_lat.alias("reach_lat"), reach_lon.alias("reach_lon"), pad_lat.alias("pad_lat"), pad_lon.alias("pad_lon"))
    # met on the largest squares, then by the squares' own boxes
    zero = _cells(asked, F.lit(0), lon - F.col("reach_lon"), lon + F.col("reach_lon"), lat - F.col("reach_lat"), lat + F.col("reach_lat"))
    zero = zero.withColumnsRenamed({"gx": "zx", "gy": "zy"}).drop("level")
    rows = index.rows.where(F.size("edges") > 0)
    rows = (rows.where("ring = 0") if device else rows).drop("corner")
    up = lambda g: F.floor(F.col(g) / F.pow(F.lit(2.0), F.col("level"))).cast("int")
    rows = rows.withColumn("zx", up("gx")).withColumn("zy", up("gy"))
    size = _size(F.col("level"))
    near = (_line(F.col("gx"), size) <= lon + F.col("reach_lon")) & (_line(F.col("gx") + 1, size) >= lon - F.col("reach_lon")) & (_line(F.col("gy"), size) <= lat + F.col("reach_lat")) & (_line(F.col("gy") + 1, size) >= lat - F.col("reach_lat"))
    held = lon.between(F.col("min_lon") - F.col("pad_lon"), F.col("max_lon") + F.col("pad_lon")) & lat.between(F.col("min_lat") - F.col("pad_lat"), F.col("max_lat") + F.col("pad_lat"))
    km = F.array_min(F.transform("edges", lambda e: segment_km(lat, lon, e, ky)))
    best = zero.join(rows, ["zx", "zy"]).where(near & held).select("point_id", "feature_id", "name", km.alias("km")).where(F.col("km") < max_km)
    return best.groupBy("point_id").agg(F.min(F.struct("km", "feature_id", "name")).alias("f")).select("point_id", "f.feature_id", "f.name", "f.km")

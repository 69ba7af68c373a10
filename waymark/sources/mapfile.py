"""A world map in one binary file: layers of polygons, lines and places.

spark.read.format("waymark_map").option("table", "features" | "places" | "rings" | "ranks" |
"header").load(uri) after register(spark). A reader goes by the offsets and record sizes
that the header states, so files with longer records can be read too. A layer is read in
ranges of records, each by a task that reads their bytes only; where Spark pushes filters
down to Python sources (map_table turns that on), other layers are left out, and of places
the file's rank index tells which range can have the ranks asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from waymark.scratch import write_bytes

#: Fixed values of the format: the magic number, microdegrees, kinds of layers, entries of a rank index.
MAGIC, SCALE, RANKS = 0x4D57474E, 1_000_000, 16
POLYGON, LINE, POINT = "polygon", "line", "point"
KINDS = [POLYGON, LINE, POINT]
#: The header's fields in order, four bytes each; fixed format.
HEADER = (
    "magic", "version", "layers", "features", "rings", "points",
    "names", "scale", "layer_at", "feature_at", "ring_at", "point_at",
    "name_at", "blob_at", "blob_bytes", "header_bytes", "point_layers", "places",
    "place_at", "place_bytes", "rank_at", "rank_entries", "layer_bytes", "feature_bytes",
    "ring_bytes", "point_bytes", "file_bytes",
)
HEADER_BYTES, LAYER, FEATURE, RING, VERTEX, PLACE = 128, struct.Struct("<4I"), struct.Struct("<3I4f"), struct.Struct("<2I"), struct.Struct("<2i"), struct.Struct("<I2i2I4B")
#: A box is wider than its points by so many degrees.
PAD = 2e-4
#: Records of a layer that a task reads.
RECORDS = 16384

SCHEMAS = {
    "features": "layer string, kind string, feature_id int, name string, min_lon double, min_lat double, max_lon double, max_lat double, rings array<array<struct<lon:double,lat:double>>>",
    "places": "layer string, place_id int, name string, lon double, lat double, pop_max long, country string, rank int, flags int, label_rank int",
    "rings": "ring int, first int, points int",
    "ranks": "layer string, rank int, before long",
    "header": "field string, value long",
}


class MapFile:
    """The tables of a map, from its bytes or from a function that gives n bytes at an
    offset. Raises ValueError for what is no map, or ends early."""

    def __init__(self, data: bytes | Callable[[int, int], bytes]) -> None:
        self.data = data
        start = self._bytes(0, HEADER_BYTES)
        if len(start) < 64:
            raise ValueError("no map: too short")
        n = min(len(HEADER), len(start) // 4)
        self.head = dict(zip(HEADER, struct.unpack(f"<{n}I", start[: 4 * n])))
        if self.head["magic"] != MAGIC or self.head["version"] not in (1, 2):
            raise ValueError("no map of a known version")
        if self.head["version"] == 1:  # no places, and records of the first sizes
            self.head |= {"place_at": 0, "places": 0, "point_layers": 0, "layer_bytes": LAYER.size, "feature_bytes": FEATURE.size, "ring_bytes": RING.size, "point_bytes": VERTEX.size, "place_bytes": PLACE.size}
        found = self._records("layer", LAYER, self.head["layers"])
        names = self._names({r[0] for r in found})
        self.layers = [(names[n], first, count, KINDS[kind]) for n, first, count, kind in found]

    def _bytes(self, at: int, n: int) -> bytes:
        return self.data(at, n) if callable(self.data) else self.data[at : at + n]

    def _whole(self, at: int, n: int) -> bytes:
        got = self._bytes(at, n)
        if len(got) < n:
            raise ValueError(f"the map ends within {n} bytes at {at}")
        return got

    def _records(self, what: str, kind: struct.Struct, n: int, first: int = 0) -> list[tuple]:
        at, size = self.head[f"{what}_at"], self.head[f"{what}_bytes"]
        if n == 0:
            return []
        data = self._whole(at + first * size, (n - 1) * size + kind.size)
        return [kind.unpack_from(data, i * size) for i in range(n)]

    def _names(self, numbers: set[int]) -> dict[int, str]:
        if not numbers:
            return {}
        low, high = min(numbers), max(numbers)
        at = np.frombuffer(self._whole(self.head["name_at"] + 4 * low, 4 * (high - low + 2)), "<u4").tolist()
        blob = self._whole(self.head["blob_at"] + at[0], at[-1] - at[0])
        return {n: blob[at[n - low] - at[0] : at[n - low + 1] - at[0]].decode() for n in numbers}

    def rings(self, first: int, count: int) -> list[tuple[int, int]]:
        """(first point, points) of rings."""
        return self._records("ring", RING, count, first)

    def rank_index(self, layer: str) -> list[int]:
        """How many places of a layer rank before each rank."""
        k = [name for name, _, _, kind in self.layers if kind == POINT].index(layer)
        return np.frombuffer(self._whole(self.head["rank_at"] + 4 * self.head["rank_entries"] * k, 4 * RANKS), "<u4").tolist()

    def features_at(self, layer: str, kind: str, first: int, count: int) -> Iterator[tuple]:
        """Features first to first + count, all of one layer: one read for each table."""
        found = self._records("feature", FEATURE, count, first)
        names = self._names({r[0] for r in found})
        low = min((r[1] for r in found if r[2]), default=0)
        rings = self.rings(low, max((r[1] + r[2] for r in found if r[2]), default=low) - low)
        begin = min((at for at, n in rings if n), default=0)
        points = self._records("point", VERTEX, max((at + n for at, n in rings if n), default=begin) - begin, begin)
        scale = self.head["scale"]
        for i, (name, ring, n, *box) in enumerate(found, first):
            own = rings[ring - low : ring - low + n] if n else []
            yield (layer, kind, i, names[name], *box, [[{"lon": x / scale, "lat": y / scale} for x, y in points[at - begin : at - begin + m]] for at, m in own])

    def places_at(self, layer: str, first: int, count: int) -> Iterator[tuple]:
        found = self._records("place", PLACE, count, first)
        names = self._names({n for r in found for n in (r[0], r[4])})
        scale = self.head["scale"]
        for i, (name, x, y, pop, country, rank, flags, label, _) in enumerate(found, first):
            yield (layer, i, names[name], x / scale, y / scale, pop, names[country], rank, flags, label)

    def features(self) -> Iterator[tuple]:
        for layer, first, count, kind in self.layers:
            if kind != POINT:
                yield from self.features_at(layer, kind, first, count)

    def places(self) -> Iterator[tuple]:
        for layer, first, count, kind in self.layers:
            if kind == POINT:
                yield from self.places_at(layer, first, count)

    def problems(self) -> list[str]:
        """What contradicts the format: sizes, order, boxes, ranks."""
        out = []
        if self.head["version"] == 2 and self.head["file_bytes"] != len(self.data):
            out.append("file size")
        counts = self.rings(0, self.head["rings"])
        if sum(n for _, n in counts) != self.head["points"]:
            out.append("points of rings")
        for layer, kind, i, _, *box, rings in self.features():
            lon, lat = ([p[k] for r in rings for p in r] for k in ("lon", "lat"))
            if lon and not (box[0] <= min(lon) and max(lon) <= box[2] and box[1] <= min(lat) and max(lat) <= box[3]):
                out.append(f"box of feature {i} of {layer}")
            if any(len(r) < (3 if kind == POLYGON else 2) for r in rings):
                out.append(f"short ring in feature {i} of {layer}")
        for layer, _, _, kind in self.layers:
            if kind == POINT:
                rows = [x for x in self.places() if x[0] == layer]
                order = [(r[7], -r[5], r[2]) for r in rows]
                if order != sorted(order):
                    out.append(f"order of {layer}")
                if self.rank_index(layer) != [sum(r[7] < rank for r in rows) for rank in range(RANKS)]:
                    out.append(f"rank index of {layer}")
        return out


def map_bytes(features: list, places: list) -> bytes:
    """The file of features (layer, kind, name, rings of (lon, lat) pairs) and
    places (layer, name, lon, lat, pop_max, country, rank, flags, label_rank),
    layers in order of appearance; places are put in the order of importance."""
    names: dict[str, int] = {"": 0}
    name_of = lambda x: names.setdefault(x or "", len(names))
    whole = lambda deg: int(np.clip(np.rint(deg * SCALE), -180 * SCALE, 180 * SCALE))
    layers, rows, rings, vertices, spots, index = [], [], [], [], [], []
    for layer in dict.fromkeys(f[0] for f in features):
        own = [f for f in features if f[0] == layer]
        layers.append((name_of(layer), len(rows), len(own), KINDS.index(own[0][1])))
        for _, _, name, parts in own:
            lon, lat = ([p[i] for r in parts for p in r] for i in (0, 1))
            rows.append((name_of(name), len(rings), len(parts), min(lon) - PAD, min(lat) - PAD, max(lon) + PAD, max(lat) + PAD))
            for part in parts:
                rings.append((len(vertices), len(part)))
                vertices += [(whole(x), whole(y)) for x, y in part]
    for layer in dict.fromkeys(p[0] for p in places):
        own = sorted((p for p in places if p[0] == layer), key=lambda p: (p[6], -p[4], p[1]))
        layers.append((name_of(layer), len(spots), len(own), KINDS.index(POINT)))
        index += [sum(p[6] < rank for p in own) for rank in range(RANKS)]
        spots += [(name_of(name), whole(lon), int(np.clip(np.rint(lat * SCALE), -90 * SCALE, 90 * SCALE)), pop, name_of(country), rank, flags, label, 0) for _, name, lon, lat, pop, country, rank, flags, label in own]
    texts = [x.encode() for x in names]
    tables = [b"".join(kind.pack(*r) for r in table) for kind, table in ((LAYER, layers), (FEATURE, rows), (RING, rings), (VERTEX, vertices), (PLACE, spots))]
    offsets = np.cumsum([0, *map(len, texts)]).astype("<u4").tobytes()
    sections = [*tables, np.array(index, "<u4").tobytes(), offsets, b"".join(texts)]
    at = np.cumsum([HEADER_BYTES, *map(len, sections)]).tolist()
    head = (MAGIC, 2, len(layers), len(rows), len(rings), len(vertices), len(names), SCALE, at[0], at[1], at[2], at[3], at[6], at[7], len(sections[7]), HEADER_BYTES, sum(x[3] == 2 for x in layers), len(spots), at[4], PLACE.size, at[5], RANKS, LAYER.size, FEATURE.size, RING.size, VERTEX.size, at[8])
    return struct.pack(f"<{len(head)}I", *head).ljust(HEADER_BYTES, b"\0") + b"".join(sections)


@dataclass
class Records(InputPartition):
    """Records of one layer (or, for other tables, of none)."""

    layer: str = ""
    kind: str = ""
    first: int = 0
    count: int = 0


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, records: int = RECORDS) -> None:
        self.path, self.table, self.records = path, table, records
        self.layers: set[str] | None = None
        self.least, self.most = 0, RANKS

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Layers and ranks leave out records; Spark checks all filters again."""
        for f in filters:
            name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if name == ("layer",) and isinstance(f, (EqualTo, In)):
                asked = set(f.value) if isinstance(f, In) else {value}
                self.layers = asked if self.layers is None else self.layers & asked
            elif name == ("rank",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) and isinstance(value, int):
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.most = min(self.most, value if isinstance(f, LessThan) else value + 1)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, value + 1 if isinstance(f, GreaterThan) else value)
            yield f

    def _open(self):  # noqa: ANN202
        system, place = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return system.open_input_file(place)

    def _ranged(self, world: MapFile, layer: str, first: int, count: int) -> tuple[int, int]:
        """The places of a layer that can have the ranks asked for: ranks before least rank
        before them, and those below most end where most begins. The last entries of an
        index do not tell ranks beyond it apart."""
        index = world.rank_index(layer)
        low = index[min(max(self.least, 0), RANKS - 1)]
        high = count if self.most >= RANKS else index[max(self.most, 0)]
        return first + low, max(0, min(high, count) - low)

    def partitions(self) -> list[InputPartition]:
        with self._open() as file:
            world = MapFile(lambda at, n: file.read_at(n, at))
            spans = []
            if self.table == "rings":
                spans.append(("", "", 0, world.head["rings"]))
            elif self.table in ("ranks", "header"):
                return [Records()]
            for layer, first, count, kind in world.layers if self.table in ("features", "places") else ():
                if (kind == POINT) == (self.table == "places") and (self.layers is None or layer in self.layers):
                    at, n = self._ranged(world, layer, first, count) if kind == POINT else (first, count)
                    spans.append((layer, kind, at, n))
        found = [Records(layer, kind, at, min(self.records, first + n - at)) for layer, kind, first, n in spans for at in range(first, first + n, self.records)]
        return found or [Records()]

    def read(self, partition: Records) -> Iterator[tuple]:
        p = partition
        with self._open() as file:
            world = MapFile(lambda at, n: file.read_at(n, at))
            if self.table == "places":
                yield from world.places_at(p.layer, p.first, p.count)
            elif self.table == "features":
                for *row, rings in world.features_at(p.layer, p.kind, p.first, p.count):
                    yield (*row, [[(q["lon"], q["lat"]) for q in r] for r in rings])
            elif self.table == "rings":
                for i, (first, n) in enumerate(world.rings(p.first, p.count), p.first):
                    yield (i, first, n)
            elif self.table == "ranks":
                for layer in (name for name, _, _, kind in world.layers if kind == POINT):
                    yield from ((layer, rank, before) for rank, before in enumerate(world.rank_index(layer)))
            else:
                yield from ((k, v) for k, v in world.head.items())
                yield ("bytes", file.size())


class MapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "waymark_map"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "features")]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], self.options.get("table", "features"), int(self.options.get("records", RECORDS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MapSource)


def map_table(spark: SparkSession, path: str, table: str = "features", records: int = RECORDS) -> DataFrame:
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("waymark_map").option("table", table).option("records", records).load(path)


def map_problems(spark: SparkSession, path: str) -> DataFrame:
    """(rule, layer, feature): what contradicts the format, found by joins and sums over the
    map's tables, so in as many tasks as they are read in. feature is that of a box or short
    ring, the place that comes too late in an order, or the rank of a wrong entry of a rank
    index; layer and feature are null for rules on the file. The rules of MapFile.problems."""
    head = map_table(spark, path, "header").groupBy().pivot("field", ["version", "file_bytes", "bytes", "points"]).agg(F.first("value"))
    points = map_table(spark, path, "rings").agg(F.coalesce(F.sum("points"), F.lit(0)).alias("all_points"))
    none = (F.lit(None).cast("string").alias("layer"), F.lit(None).cast("int").alias("feature"))
    size = head.where("version = 2 AND file_bytes <> bytes").select(F.lit("file size").alias("rule"), *none)
    rings = head.withColumn("k", F.lit(1)).join(points.withColumn("k", F.lit(1)), "k").where("points <> all_points").select(F.lit("points of rings").alias("rule"), *none)

    rows, p = map_table(spark, path), F.flatten("rings")
    lon, lat = F.transform(p, lambda q: q["lon"]), F.transform(p, lambda q: q["lat"])
    inside = (F.col("min_lon") <= F.array_min(lon)) & (F.array_max(lon) <= F.col("max_lon")) & (F.col("min_lat") <= F.array_min(lat)) & (F.array_max(lat) <= F.col("max_lat"))
    short = F.exists("rings", lambda r: F.size(r) < F.when(F.col("kind") == POLYGON, 3).otherwise(2))
    wrong = F.array_compact(F.array(F.when(~inside, "box"), F.when(short, "short ring")))
    features = rows.select(F.explode(wrong).alias("rule"), "layer", F.col("feature_id").alias("feature"))

    places = map_table(spark, path, "places")
    key = F.struct("rank", -F.col("pop_max"), "name")
    this, next_ = places.select("layer", "place_id", key.alias("a")), places.select("layer", (F.col("place_id") - 1).alias("place_id"), key.alias("b"))
    late = this.join(next_, ["layer", "place_id"]).where("b < a").select(F.lit("order").alias("rule"), "layer", (F.col("place_id") + 1).alias("feature"))
    ranks, counts = map_table(spark, path, "ranks"), places.groupBy("layer", F.col("rank").alias("r")).agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum(F.when(F.col("r") < F.col("rank"), F.col("n"))), F.lit(0))
    entries = ranks.join(counts, "layer", "left").groupBy("layer", "rank", "before").agg(below.alias("below")).where("before <> below")
    return size.unionByName(rings).unionByName(features).unionByName(late).unionByName(entries.select(F.lit("rank index").alias("rule"), "layer", F.col("rank").alias("feature")))


def write_map(features: DataFrame, places: DataFrame, path: str) -> int:
    """Write the map of features (layer, kind, name, rings) and places (layer, name, lon,
    lat, pop_max, country, rank, flags, label_rank) as one file, in order of layers and of
    feature_id, and return its bytes. A map is a few megabytes, by the format's purpose."""
    order = ["layer", "feature_id"] if "feature_id" in features.columns else ["layer"]
    rows = [(r.layer, r.kind, r.name, [[(p.lon, p.lat) for p in ring] for ring in r.rings]) for r in features.orderBy(*order).collect()]
    spots = [tuple(r) for r in places.select("layer", "name", "lon", "lat", "pop_max", "country", "rank", "flags", "label_rank").orderBy("layer").collect()]
    data = map_bytes(rows, spots)
    write_bytes(features.sparkSession, data, path)
    return len(data)

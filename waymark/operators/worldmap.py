"""Polygons and places: containment, the nearest coast, and the map's tables.

A feature has feature_id, name, min_lon, min_lat, max_lon, max_lat, and rings, an
array of arrays of points (lon, lat): the outline first, then holes. Rings are
open: the last point joins the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions.geo import LAT_KM, LON_KM, crosses, segment_km
from waymark.operators import edgeindex
from waymark.operators.edgeindex import EdgeIndex, edge_index

#: Degrees of a square of the grid on which points and boxes meet.
GRID = 5.0
#: Flags of places; fixed bits: capital, capital of a region, megacity, world city, label of a country.
CAPITAL, REGION_CAPITAL, MEGACITY, WORLD_CITY, COUNTRY_LABEL = 1, 2, 4, 8, 16
#: The rank of a place without one, the label rank of one without.
NO_RANK, NO_LABEL_RANK = 14, 255


def edges(ring: Column) -> Column:
    """Of a ring's points, each with the next, the last with the first."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p["lon"].alias("x1"), p["lat"].alias("y1"), q["lon"].alias("x2"), q["lat"].alias("y2")))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    return F.size(F.filter(edges(ring), lambda e: crosses(lat, lon, e))) % 2 == 1


def ring_km(lat: Column, lon: Column, ring: Column, ky: float = LAT_KM) -> Column:
    return F.array_min(F.transform(edges(ring), lambda e: segment_km(lat, lon, e, ky)))


def _squares(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / GRID).cast("int"), F.floor(high / GRID).cast("int"))


def near_boxes(points: DataFrame, features: DataFrame, pad_lat: Column, pad_lon: Column) -> DataFrame:
    """points joined with the features whose box, padded by degrees of the point,
    holds them. Both are put on the squares they touch, so the join has a key.
    points has point_id, lat and lon."""
    placed = features.withColumn("gx", F.explode(_squares(F.col("min_lon"), F.col("max_lon")))).withColumn("gy", F.explode(_squares(F.col("min_lat"), F.col("max_lat"))))
    asked = points.select("point_id", "lat", "lon", pad_lat.alias("pad_lat"), pad_lon.alias("pad_lon"))
    asked = asked.withColumn("gx", F.explode(_squares(F.col("lon") - F.col("pad_lon"), F.col("lon") + F.col("pad_lon")))).withColumn("gy", F.explode(_squares(F.col("lat") - F.col("pad_lat"), F.col("lat") + F.col("pad_lat"))))
    lat, lon = F.col("lat"), F.col("lon")
    held = lon.between(F.col("min_lon") - F.col("pad_lon"), F.col("max_lon") + F.col("pad_lon")) & lat.between(F.col("min_lat") - F.col("pad_lat"), F.col("max_lat") + F.col("pad_lat"))
    return asked.join(placed, ["gx", "gy"]).where(held)


def indexed(features: DataFrame | EdgeIndex) -> EdgeIndex:
    """The edges of features on squares; give the index itself to ask it more than once."""
    return edge_index(features) if isinstance(features, DataFrame) else features


def containing(points: DataFrame, features: DataFrame | EdgeIndex) -> DataFrame:
    """(point_id, feature_id, name): of the features that hold a point (in the
    outline and in no hole), the first. Points in none are left out."""
    return edgeindex.containing(points, indexed(features))


def containing_by_rings(points: DataFrame, features: DataFrame) -> DataFrame:
    """The same from the definition, by all edges of every feature whose box holds a
    point: for tests and small maps."""
    near = near_boxes(points, features, F.lit(0.0), F.lit(0.0))
    lat, lon = F.col("lat"), F.col("lon")
    holes = F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0)))
    inside = near.where(in_ring(lat, lon, F.col("rings")[0]) & ~F.exists(holes, lambda r: in_ring(lat, lon, r)))
    return inside.groupBy("point_id").agg(F.min(F.struct("feature_id", "name")).alias("f")).select("point_id", "f.*")


def nearest_coast(points: DataFrame, features: DataFrame | EdgeIndex, max_km: float = 50.0, device: bool = False) -> DataFrame:
    """(point_id, feature_id, name, km): the feature whose rings come closest, below
    max_km; of equals the first. device: only outlines count, both paddings are
    km / 111, and a degree of latitude is 110.57 km."""
    return edgeindex.nearest_coast(points, indexed(features), max_km, device)


def nearest_coast_by_rings(points: DataFrame, features: DataFrame, max_km: float = 50.0, device: bool = False) -> DataFrame:
    """The same from the definition, as containing_by_rings()."""
    lat, lon = F.col("lat"), F.col("lon")
    pad_lat = F.lit(max_km / (111.0 if device else LAT_KM))
    pad_lon = pad_lat if device else max_km / F.greatest(LON_KM * F.cos(F.radians("lat")), F.lit(1.0))
    ky = 110.57 if device else LAT_KM
    near = near_boxes(points, features, pad_lat, pad_lon).dropDuplicates(["point_id", "feature_id"])
    rings = F.slice("rings", 1, 1) if device else F.col("rings")
    km = F.array_min(F.transform(rings, lambda r: ring_km(lat, lon, r, ky)))
    best = near.select("point_id", "feature_id", "name", km.alias("km")).where(F.col("km") < max_km)
    return best.groupBy("point_id").agg(F.min(F.struct("km", "feature_id", "name")).alias("f")).select("point_id", "f.feature_id", "f.name", "f.km")


def country_at(points: DataFrame, features: DataFrame | EdgeIndex, max_km: float = 50.0, device: bool = False) -> DataFrame:
    """(point_id, name, km) for every point: the country that holds it (0 km), else
    the nearest one, else null."""
    features = indexed(features)
    held = containing(points, features).select("point_id", F.col("name").alias("held"))
    missed = points.join(held, "point_id", "left_anti")
    snapped = nearest_coast(missed, features, max_km, device).select("point_id", F.col("name").alias("snapped"), "km")
    out = points.select("point_id").join(held, "point_id", "left").join(snapped, "point_id", "left")
    return out.select("point_id", F.coalesce("held", "snapped").alias("name"), F.when(F.col("held").isNotNull(), 0.0).otherwise(F.col("km")).alias("km"))


def place_flags(kind: Column, capital: Column, mega: Column, world: Column) -> Column:
    """The bits of a settlement, from its class and the three markers."""
    kind = F.coalesce(kind, F.lit(""))

    def bit(here: Column, n: int) -> Column:
        return F.when(F.coalesce(here, F.lit(False)), n).otherwise(0)

    flags = bit((F.coalesce(capital, F.lit(0)) == 1) | kind.startswith("Admin-0 capital"), CAPITAL)
    return flags.bitwiseOR(bit(kind.startswith("Admin-1"), REGION_CAPITAL)).bitwiseOR(bit(mega == 1, MEGACITY)).bitwiseOR(bit(world == 1, WORLD_CITY))


def clamp_rank(rank: Column, missing: int = NO_RANK, most: int = NO_RANK) -> Column:
    return F.least(F.greatest(F.coalesce(rank, F.lit(missing)), F.lit(0)), F.lit(most))


def clean_name(*names: Column) -> Column:
    """The first name that is not empty, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))


def place_order() -> list[Column]:
    """The most important place first."""
    return [F.asc("rank"), F.desc("pop_max"), F.asc("name")]


def rank_index(places: DataFrame, slots: int = 16) -> DataFrame:
    """(rank, n, before): how many places each rank has, and how many rank before it."""
    counts = places.groupBy("rank").agg(F.count("*").alias("n"))
    all_ranks = places.sparkSession.range(slots).select(F.col("id").cast("int").alias("rank"))
    before = F.sum("n").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
    return all_ranks.join(counts, "rank", "left").na.fill({"n": 0}).select("rank", "n", F.coalesce(before, F.lit(0)).alias("before"))


def ring_area(ring: Column) -> Column:
    """Half the absolute sum of the edges' cross products."""
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def large_parts(parts: DataFrame, floor: float) -> DataFrame:
    """Of the polygons of a country (country, part, ring), those of an area of at
    least the floor, and always the largest, the first of equals."""
    rows = parts.withColumn("area", ring_area(F.col("ring")))
    order = W.partitionBy("country").orderBy(F.desc("area"), "part")
    return rows.withColumn("place", F.row_number().over(order)).where((F.col("area") >= floor) | (F.col("place") == 1)).drop("place")


def without_repeats(ring: Column) -> Column:
    """Points that equal the one before are dropped, and a last one that equals the first."""
    kept = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    last = F.element_at(kept, -1)
    return F.when((F.size(kept) > 1) & (last == kept[0]), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)


def boxes(features: DataFrame, pad: float = 2e-4) -> DataFrame:
    """features with the box of all their points, a little wider."""
    points = F.flatten("rings")

    def side(name: str, largest: bool) -> Column:
        values = F.transform(points, lambda p: p[name])
        return F.array_max(values) + pad if largest else F.array_min(values) - pad

    return features.select("*", *(side(n, m).alias(f"{'max' if m else 'min'}_{n}") for n in ("lon", "lat") for m in (False, True)))


def usable_rings(features: DataFrame, least: int = 3) -> DataFrame:
    """Rings of fewer points go; a feature whose outline goes, goes with it."""
    kept = F.filter("rings", lambda r: F.size(r) >= least)
    return features.where(F.size(F.col("rings")[0]) >= least).withColumn("rings", kept)


def inner_point(rings: Column) -> Column:
    """A point within a polygon: on the latitude in the middle of its outline, the middle
    of the widest stretch between two crossings of its rings. Null without a stretch."""
    lats = F.transform(rings[0], lambda p: p["lat"])
    lat = (F.array_min(lats) + F.array_max(lats)) / 2
    cut = F.filter(F.flatten(F.transform(rings, edges)), lambda e: (e["y1"] > lat) != (e["y2"] > lat))
    at = F.array_sort(F.transform(cut, lambda e: e["x1"] + (lat - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
    pairs = F.transform(F.filter(at, lambda x, i: i % 2 == 0), lambda x, i: F.struct((F.get(at, 2 * i + 1) - x).alias("wide"), (-i).alias("first"), ((F.get(at, 2 * i + 1) + x) / 2).alias("lon")))
    widest = F.array_max(F.filter(pairs, lambda p: p["wide"].isNotNull()))
    return F.when(widest.isNotNull(), F.struct(widest["lon"].alias("lon"), lat.alias("lat")))


def label_points(parts: DataFrame) -> DataFrame:
    """(country, lon, lat): the inner point of each country's largest part, by the area of
    its outline, the first of equals, of parts (country, part, rings). Parts whose outline has
    no inside (null or empty rings too) are passed over; a country of none has no row."""
    rows = parts.select("country", "part", inner_point(F.col("rings")).alias("p"), ring_area(F.col("rings")[0]).alias("area")).where("p is not null")
    best = rows.groupBy("country").agg(F.max_by("p", F.struct("area", -F.col("part"))).alias("p"))
    return best.select("country", "p.lon", "p.lat")


def names_per_layer(rows: DataFrame) -> DataFrame:
    """(layer, n, names): features or places of each layer, and how many names they have."""
    return rows.groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def geometry_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(layer, k, what) of two maps' features (layer, kind, k, name, rings, min_lon,
    min_lat, max_lon, max_lat; k their number within the layer): layers that are added or
    removed and layers of another kind or size as a whole (k null); of the others each
    feature whose name or rings, box or coordinates differ, the first of these three."""
    sizes = [x.groupBy("layer").agg(F.min("kind").alias(f"kind{i}"), F.count("*").alias(f"n{i}")) for i, x in ((0, old), (1, new))]
    layers = sizes[0].join(sizes[1], "layer", "full_outer")
    other = (F.col("kind0") != F.col("kind1")) | (F.col("n0") != F.col("n1"))
    what = F.when(F.col("n1").isNull(), "layer removed").when(F.col("n0").isNull(), "layer added").when(other, "layer differs")
    layers = layers.withColumn("what", what)
    box = F.struct("min_lon", "min_lat", "max_lon", "max_lat")
    own = [x.select("layer", "k", F.struct("name", F.size("rings").alias("n")).alias(f"name{i}"), box.alias(f"box{i}"), F.col("rings").alias(f"rings{i}")) for i, x in ((0, old), (1, new))]
    pairs = own[0].join(own[1], ["layer", "k"], "full_outer").join(layers.where("what is null").select("layer"), "layer", "left_semi")
    same = lambda name: F.col(f"{name}0").eqNullSafe(F.col(f"{name}1"))
    differs = F.when(~same("name"), "name or rings").when(~same("box"), "box").when(~same("rings"), "coordinates")
    found = pairs.select("layer", F.col("k").cast("long").alias("k"), differs.alias("what")).where("what is not null")
    return layers.where("what is not null").select("layer", F.lit(None).cast("long").alias("k"), "what").unionByName(found)


def difference(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and what became of them: removed, added, changed. Equal rows are left out."""
    a, b = (x.select(*keys, F.struct(*values).alias(n)) for x, n in ((old, "old"), (new, "new")))
    what = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, keys, "full_outer").select(*keys, what.alias("what")).where("what is not null")


def named_place(names: DataFrame, places: DataFrame) -> DataFrame:
    """(asked, name): for each asked name the most important place called so, else
    the most important one that begins with its first five letters."""
    ranked = F.struct("rank", (-F.col("pop_max")).alias("p"), "name")
    exact = names.join(places, names["asked"] == places["name"]).groupBy("asked").agg(F.min(ranked).alias("e"))
    begun = places.withColumn("begin", F.substring("name", 1, 5)).groupBy("begin").agg(F.min(ranked).alias("b"))
    out = names.join(exact, "asked", "left").join(begun, F.substring("asked", 1, 5) == F.col("begin"), "left")
    return out.select("asked", F.coalesce("e.name", "b.name").alias("name"))

"""GeoJSON feature collections as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.worldmap import NO_RANK, clamp_rank, clean_name

#: A collection, with geometries kept as text: their nesting differs by type.
COLLECTION = "features array<struct<properties:string,geometry:string>>"


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(properties, type, geometry) of every feature; the first two are JSON texts."""
    rows = spark.read.schema(COLLECTION).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    return rows.select("properties", F.get_json_object("geometry", "$.type").alias("type"), "geometry")


def rings_of(kind: Column, geometry: Column) -> Column:
    """The polygons or lines of a geometry, each an array of rings of (lon, lat):
    for a multi-part geometry several, for other types none."""
    point = "array<double>"
    part = {
        "Polygon": F.array(F.from_json(geometry, f"coordinates array<array<{point}>>")["coordinates"]),
        "MultiPolygon": F.from_json(geometry, f"coordinates array<array<array<{point}>>>")["coordinates"],
        "LineString": F.array(F.array(F.from_json(geometry, f"coordinates array<{point}>")["coordinates"])),
        "MultiLineString": F.transform(F.from_json(geometry, f"coordinates array<array<{point}>>")["coordinates"], lambda line: F.array(line)),
    }
    out = None
    for name, value in part.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    as_points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return F.transform(out, lambda polygon: F.transform(polygon, as_points))


def parts(rows: DataFrame) -> DataFrame:
    """(properties, part, rings), a row for each polygon or line of each feature."""
    return rows.select("properties", F.posexplode(rings_of(F.col("type"), F.col("geometry"))).alias("part", "rings"))


def settlements(rows: DataFrame, most: int = NO_RANK) -> DataFrame:
    """The named points of a collection whose rank (0 to 14; without one 14) is at most
    the given one, with the properties that places have."""
    names = {"NAME": "string", "NAMEASCII": "string", "SCALERANK": "int", "LONGITUDE": "double", "LATITUDE": "double", "FEATURECLA": "string", "ADM0CAP": "int", "MEGACITY": "int", "WORLDCITY": "int", "LABELRANK": "int", "POP_MAX": "long", "ADM0NAME": "string"}
    p = F.from_json("properties", ", ".join(f"{n} {t}" for n, t in names.items()))
    at = F.from_json("geometry", "coordinates array<double>")["coordinates"]
    name = clean_name(p["NAME"], p["NAMEASCII"])
    out = rows.where("type = 'Point'").select(
        name.alias("name"), p["SCALERANK"].alias("scalerank"), F.coalesce(p["LONGITUDE"], at[0]).alias("lon"), F.coalesce(p["LATITUDE"], at[1]).alias("lat"), p["FEATURECLA"].alias("featurecla"), p["ADM0CAP"].alias("adm0cap"),
        p["MEGACITY"].alias("megacity"), p["WORLDCITY"].alias("worldcity"), p["LABELRANK"].alias("labelrank"), F.coalesce(p["POP_MAX"], F.lit(0)).alias("pop_max"), F.trim(F.coalesce(p["ADM0NAME"], F.lit(""))).alias("country"),
    )
    return out.where(F.col("name").isNotNull() & (clamp_rank(F.col("scalerank")) <= most))

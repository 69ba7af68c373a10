"""The whole search: an index, a recipe and a map, asked by frames of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.gate import gate, posterior
from waymark.operators.index import PlaceIndex, PlainPlaces, as_index, open_index
from waymark.operators.rerank import answers, complete, features, reranked
from waymark.operators.search import found
from waymark.operators.worldmap import country_at
from waymark.recipe import Recipe, read_recipe
from waymark.scratch import written
from waymark.sources.flatindex import FlatIndex, is_flat
from waymark.sources.mapfile import map_table


@dataclass
class Engine:
    """An index of places as search.py describes them (cls among the spaces), or a frame of
    them, and the polygons of a map (or none: no countries)."""

    recipe: Recipe
    index: PlaceIndex | FlatIndex | PlainPlaces | DataFrame
    countries: DataFrame | None = None

    def __post_init__(self) -> None:
        self.index = as_index(self.index)

    @classmethod
    def load(cls, spark: SparkSession, recipe: str, index: str, world: str | None = None, layer: str = "countries_50m") -> Engine:
        """From the paths of a recipe (JSON), an index (what write_index() wrote, a folder
        of flat files, or Parquet) and a map file."""
        land = map_table(spark, world).where(F.col("layer") == layer) if world else None
        known = read_recipe(spark, recipe)
        places = FlatIndex(spark, index) if is_flat(index) else open_index(spark, index)
        return cls(known, places, land)

    def locate(self, queries: DataFrame, top_rows: int = 5, snap_km: float = 50.0) -> DataFrame:
        """A row for every query (qid, logits array<double>, a column for each
        space): row, lat, lon, country, confidence, gate_cells, n_candidates and
        top_rows, the first rows by the final score. The search runs within the call;
        queries are read twice, for their gates and for their spaces."""
        logits = queries.select("qid", F.posexplode("logits").alias("cell", "logit"))
        cells = gate(posterior(logits), self.recipe.gate_mass, self.recipe.gate_cap)
        wide, counts = found(queries, cells, self.index, self.recipe)
        wide = written(wide, "candidates")
        rows = reranked(features(wide, self.recipe), self.recipe)
        first = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") < top_rows, F.struct("place", "row")))), lambda x: x["row"])
        one = complete(answers(rows, counts.where("n_candidates > 0").select("qid", "n_candidates"), self.recipe), queries).join(rows.groupBy("qid").agg(first.alias("top_rows")), "qid", "left")
        one = one.join(counts.select("qid", "gate_cells"), "qid", "left")
        one = one.join(wide.select("qid", "row", "lat", "lon"), ["qid", "row"], "left")
        out = written(one.select("qid", "row", "lat", "lon", "confidence", F.coalesce("gate_cells", F.lit(0)).alias("gate_cells"), "n_candidates", "top_rows"), "located")
        if self.countries is None:
            return out.withColumn("country", F.lit(None).cast("string"))
        asked = out.where("row is not null").select(F.col("qid").alias("point_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
        named = country_at(asked, self.countries, snap_km).select(F.col("point_id").alias("qid"), F.col("name").alias("country"))
        return out.join(named, "qid", "left")


def write_results(located: DataFrame, path: str) -> None:
    """One JSON object for each query."""
    located.write.json(path)

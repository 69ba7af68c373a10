"""The place search over the driver's tables: which rows stand for what.

embeddings 0 to 15 are the centroids of the cells; of the others, those whose id
ends in 9 are queries and the rest are places. Coordinates, a map of the nations
and the models are made from keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.vector import dot, doubles, l2_normalise
from waymark.operators.edgeindex import EdgeIndex, edge_index
from waymark.operators.gate import gate, posterior
from waymark.operators.index import PlaceIndex, assign_cells, hubness, hubness_of_all, quantised, write_index
from waymark.operators.rerank import answers, features, reranked
from waymark.operators.search import found
from waymark.recipe import Linear, Recipe
from waymark.scratch import once, once_path, written

N_CELLS = 16
#: Rows of a task that makes places: a table is spread by its rows, as one file with one group of rows would be one task.
ROWS_OF_TASK = 8192
SPACES = ["cls", "geo5c", "geo10c", "geo25c", "cls_wh"]
#: First dimension (from 1) and number of dimensions of the parts of a vector.
PARTS = {"geo5c": (1, 32), "geo10c": (17, 32), "geo25c": (33, 32)}
RECIPE = Recipe(
    rerank=Linear((0.5, 1.0, -0.2, -0.5, 0.3, 0.6, 0.2, 0.1, 0.4, 0.5, -0.1, 0.2, 0.3, 0.4, -0.3, 0.1), -0.7, (0.0,) * 16, (1.0,) * 16),
    score_sd=0.2,
    confidence=Linear((0.4, 0.8, 0.3, 0.9, 0.5, -0.2, -0.1), -0.4, (0.1, 0.2, 0.8, 0.3, 0.4, 3.5, 5.0), (0.1, 0.2, 0.3, 0.2, 0.5, 0.6, 1.0)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("v"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("vec_id") < N_CELLS).select(F.col("vec_id").cast("int").alias("cell"), "v")


def is_query() -> Column:
    return (F.col("vec_id") >= N_CELLS) & (F.col("vec_id") % 10 == 9)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(is_query()).select(F.col("vec_id").alias("qid"), "v")


def place_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    tasks = max(rows.count() // ROWS_OF_TASK + 1, spark.sparkContext.defaultParallelism)
    dealt = rows.where((F.col("vec_id") >= N_CELLS) & ~is_query()).select("vec_id", "embedding").repartition(tasks, "vec_id")
    return dealt.select(F.col("vec_id").alias("row"), doubles(F.col("embedding")).alias("v"))


def mean_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """Of the places, to nine digits."""
    dims = place_vectors(spark, sf_dir).select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.round(F.avg("x"), 9).alias("m")).orderBy("i").collect()
    return [r.m for r in dims]


def with_spaces(rows: DataFrame, mean: list[float]) -> DataFrame:
    for name, (first, n) in PARTS.items():
        rows = rows.withColumn(name, l2_normalise(F.slice("v", first, n)))
    centred = F.zip_with("v", F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return rows.withColumn("cls", F.col("v")).withColumn("centred", centred).withColumn("cls_wh", l2_normalise(F.col("centred"))).drop("centred")


def coordinates(cell: Column, key: Column) -> tuple[Column, Column]:
    lat = -60.0 + 7.5 * cell + (key * 7919) % 1000 / F.lit(1000.0) * 0.6
    lon = -170.0 + 21.0 * cell + (key * 104729) % 1000 / F.lit(1000.0) * 0.6
    return lat, lon


def float_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, v, cell, lat, lon and the spaces, not yet coded."""
    rows = place_vectors(spark, sf_dir)
    placed = with_spaces(rows, mean_vector(spark, sf_dir)).join(assign_cells(rows, centroids(spark, sf_dir)), "row")
    lat, lon = coordinates(F.col("cell"), F.col("row"))
    return placed.withColumn("lat", lat).withColumn("lon", lon)


def sample_order() -> Column:
    """The order whose first rows are the sample for hubness."""
    return F.col("row") * 7919 % 100003


def csls_rows(rows: DataFrame) -> DataFrame:
    return hubness(rows, list(RECIPE.csls_spaces), order=sample_order())


def inputs(sf_dir: str) -> list[str]:
    """The table that the index and the searches are made from."""
    return [f"{sf_dir}/embeddings.parquet"]


def _index(spark: SparkSession, sf_dir: str, name: str, csls: Callable[[DataFrame], DataFrame]) -> PlaceIndex:
    def build(path: str) -> None:
        rows = once(spark, ("float_places", sf_dir), lambda: float_places(spark, sf_dir), inputs(sf_dir))
        own = written(csls(rows), "csls")  # the index is read several times while it is written
        write_index(quantised(rows.join(own, "row"), SPACES).drop("v"), path, cells_of_bucket=1)

    return PlaceIndex.open(spark, once_path(spark, (name, sf_dir), build, inputs(sf_dir)))


def place_index(spark: SparkSession, sf_dir: str) -> PlaceIndex:
    """The index: built and written once for a session, then read by every search."""
    return _index(spark, sf_dir, "places", csls_rows)


def whole_index(spark: SparkSession, sf_dir: str) -> PlaceIndex:
    """As place_index(), with hubness against all places."""
    return _index(spark, sf_dir, "whole_places", lambda rows: hubness_of_all(rows, list(RECIPE.csls_spaces)))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_index(spark, sf_dir).places.drop("cell_bucket")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spaces(query_vectors(spark, sf_dir), mean_vector(spark, sf_dir))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query against every centroid: the cells are a fixed, small number."""
    cells = centroids(spark, sf_dir).select(F.collect_list(F.struct("cell", F.col("v").alias("c"))).alias("cells")).first().cells
    known = F.array(*(F.struct(F.lit(x.cell).alias("cell"), F.array(*map(F.lit, x.c)).alias("c")) for x in sorted(cells, key=lambda x: x.cell)))
    return query_vectors(spark, sf_dir).select("qid", "v", F.explode(known).alias("k")).select("qid", "k.cell", (20.0 * dot(F.col("v"), F.col("k.c"))).alias("logit"))


def gated(spark: SparkSession, sf_dir: str, cap: int = RECIPE.gate_cap) -> DataFrame:
    return gate(posterior(logits(spark, sf_dir)), RECIPE.gate_mass, cap)


def best(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The top rows with what reranking needs, and (qid, n_candidates, gate_cells).
    The search runs once for a session; its rows are written."""

    def search() -> DataFrame:
        top, counts = found(queries(spark, sf_dir), gated(spark, sf_dir), place_index(spark, sf_dir), RECIPE)
        return top.drop("cell").join(counts, "qid")

    top = once(spark, ("best", sf_dir), search, inputs(sf_dir))
    counts = top.where("rank = 0").select("qid", "n_candidates", "gate_cells")
    return top.drop("n_candidates", "gate_cells"), counts


def final_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reranked rows with coordinates, candidate counts, answers)."""
    top, counts = best(spark, sf_dir)
    rows = written(reranked(features(top, RECIPE), RECIPE), "reranked")
    one = answers(rows, counts.select("qid", "n_candidates"), RECIPE)
    return rows.join(top.select("qid", "row", "lat", "lon"), ["qid", "row"]), counts, one


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, lat, lon): in the cell of the query's largest logit, the lower of equals."""
    cell = logits(spark, sf_dir).groupBy("qid").agg(F.max_by("cell", F.struct("logit", -F.col("cell"))).alias("cell"))
    lat, lon = coordinates(F.col("cell"), F.col("qid"))
    return cell.select("qid", lat.alias("lat"), lon.alias("lon"))


def features_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map: a five-cornered outline for each nation, a hole for every fifth, a
    second part for every seventh."""
    k = F.col("n_nationkey")
    cx, cy = -150.0 + 60.0 * (k % 6), -60.0 + 30.0 * F.floor(k / 6)
    hx, hy = 18.0 + (k % 3) * 4, 9.0 + k % 4

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))

    def box(x: Column, y: Column, w: Column, h: Column) -> Column:
        return F.array(point(x - w, y - h), point(x + w, y - h), point(x + w, y + h), point(x - w, y + h))

    outline = F.array(point(cx - hx, cy - hy), point(cx + hx, cy - hy), point(cx + hx + 2, cy), point(cx + hx, cy + hy), point(cx - hx, cy + hy))
    main = F.struct((k * 10).alias("feature_id"), F.when(k % 5 == 0, F.array(outline, box(cx, cy, hx / 3, hy / 3))).otherwise(F.array(outline)).alias("rings"))
    island = F.struct((k * 10 + 1).alias("feature_id"), F.array(box(cx, cy + hy + 2.0, F.lit(0.5), F.lit(0.5))).alias("rings"))
    parts = F.when(k % 7 == 3, F.array(main, island)).otherwise(F.array(main))
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.explode(parts).alias("f")).select("name", "f.*")
    points = F.flatten("rings")
    side = {}
    for n in ("lon", "lat"):
        values = F.transform(points, (lambda n: lambda p: p[n])(n))
        side[f"min_{n}"], side[f"max_{n}"] = F.array_min(values), F.array_max(values)
    return rows.select("feature_id", "name", "rings", *(c.alias(n) for n, c in side.items()))


def nation_index(spark: SparkSession, sf_dir: str) -> EdgeIndex:
    """The map's edges on squares, written once for a session."""
    path = once_path(spark, ("nations", sf_dir), lambda path: edge_index(features_of_nations(spark, sf_dir)).write(path), [f"{sf_dir}/nation.parquet"])
    return EdgeIndex.read(spark.read.parquet(path))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("point_id"), ((k * 37) % 1500 / F.lit(10.0) - 75.0).alias("lat"), ((k * 101) % 3400 / F.lit(10.0) - 170.0).alias("lon"))


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a map from the suppliers: name, rank, population, markers."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.when(k % 11 != 0, k % 17).cast("int").alias("scalerank"), F.when(k % 13 != 0, k * 1000 % 70001).alias("pop_max"),
        F.when(k % 5 == 0, "Admin-0 capital").when(k % 5 == 1, "Admin-1 region capital").when(k % 5 == 2, "Populated place").alias("featurecla"),
        (k % 3 == 0).cast("int").alias("adm0cap"), F.when(k % 4 != 1, (k % 4 == 0).cast("int")).alias("megacity"), (k % 6 == 0).cast("int").alias("worldcity"), F.when(k % 7 != 0, k % 300).cast("int").alias("labelrank"),
    )


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, p, y, km) for reports, from the orders: a stated confidence and an error."""
    k = F.col("o_orderkey")
    p = (k * 7919 % 1009) / F.lit(1009.0)
    km = F.when((k * 31) % 1009 < k * 7919 % 1009, (k % 250) / F.lit(10.0)).otherwise(25.5 + k * 13 % 3000)
    return table(spark, sf_dir, "orders").select(k.alias("qid"), p.alias("p"), km.alias("km")).withColumn("y", (F.col("km") <= 25).cast("int"))

"""Place search over a stream of queries: an extension of the batch search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.operators.gate import gate, posterior
from waymark.operators.index import PlaceIndex, PlainPlaces, as_index
from waymark.operators.search import best
from waymark.recipe import Recipe
from waymark.scratch import written


def batch_search(index: PlaceIndex | PlainPlaces | DataFrame, recipe: Recipe) -> Callable[[DataFrame], DataFrame]:
    """A function of queries (qid, logits array<double>, spaces) that gives their
    best places (qid, row, rank, s)."""

    index = as_index(index)

    def search(queries: DataFrame) -> DataFrame:
        logits = queries.select("qid", F.posexplode("logits").alias("cell", "logit"))
        cells = written(gate(posterior(logits), recipe.gate_mass, recipe.gate_cap), "gated")
        return best(queries, cells, index, recipe).select("qid", "row", "rank", "s")

    return search


def locate_stream(queries: DataFrame, index: PlaceIndex | PlainPlaces | DataFrame, recipe: Recipe, path: str, checkpoint: str) -> StreamingQuery:
    """Search each micro-batch of a streaming frame and write its answers under
    the batch's number, so a batch that is run again replaces its own."""
    search = batch_search(index, recipe)

    def write(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()

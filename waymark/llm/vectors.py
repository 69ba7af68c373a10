"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products.

A vector has a home cell, that of the nearest centroid, and visits every later
cell whose vectors may be close enough to it: if u lives in c2 and v in c1 then
<v, c1 - c2> <= <v - u, c1 - c2> <= |v - u| |c1 - c2|, so a vector that is further
on its side of the border than that has no link across it. Cells lose no pair.
There are cells for every length of vectors, more of them the more vectors the
largest label has. Homes and visitors of a cell are dealt into blocks of bounded
size; a task multiplies two blocks, tile by tile, and returns, for each vector with
a link, how many it has there and the smallest id that it reaches there: no pairs
leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import components, table, written

#: Vectors of at least this cosine are linked.
SIMILAR = 0.98
#: Vectors of the largest label for each cell; the least and most cells of a length,
#: and components (vectors times dimensions) of all centroids.
CELL_ROWS, CELLS, MAX_CELLS, CENTROID_VALUES = 4096, 8, 1024, 1 << 22
#: Rounds of k-means; vectors and components of the sample that it is fitted on.
ROUNDS, SAMPLE_ROWS, SAMPLE_VALUES = 8, 20_000, 1 << 22
#: Vectors of a block, and components; vectors of a tile of a product.
BLOCK, BLOCK_VALUES, TILE = 4096, 1 << 20, 256


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as unit rows in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, cells: int = CELLS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids. The first are taken one by one, each the row that is
    furthest from those before; an empty cell keeps its centroid."""
    if not len(rows):
        return np.empty((0, 0))
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(cells, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        home = (rows @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, rows)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centroids)
    return centroids


def cells_of(rows: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row, and a matrix of the later cells that it visits."""
    near = rows @ centroids.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centroids @ centroids.T)))
    ahead = near[np.arange(len(rows)), home][:, None] - near
    may = ahead <= np.sqrt(max(0.0, 2 - 2 * threshold)) * apart[home] + 1e-7
    return home, may & (np.arange(len(centroids))[None, :] > home[:, None])


def _tiles(n: int) -> list[slice]:
    return [slice(i, i + TILE) for i in range(0, n, TILE)]


def _smallest(linked: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of each row, the least of its own root and those that it is linked with."""
    far = np.iinfo(np.int64).max
    return np.concatenate([np.minimum(own[t], np.where(linked[t], other[None, :], far).min(axis=1)) for t in _tiles(len(own))])


def _block_links(threshold: float):  # noqa: ANN202
    def links(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        ids, copies = group.column("class_id").to_numpy(), group.column("copies").to_numpy()
        rows = unit_rows(group.column("embedding"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        one = not len(b) and group.column("q")[0].as_py() >= 0
        if one:  # a block and itself
            b = a
        right = rows[b].T
        linked = np.empty((len(a), len(b)), dtype=bool)
        for t in _tiles(len(a)):
            linked[t] = rows[a[t]] @ right >= threshold
        if one:
            np.fill_diagonal(linked, False)
        i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        linked, a, b = linked[np.ix_(i, j)], a[i], b[j]
        count_a, count_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        for t in _tiles(len(a)):
            part = linked[t].astype(np.int64)
            count_a[t] = part @ copies[b]
            count_b += copies[a[t]] @ part
        root_a, root_b = ids[a], ids[b]
        turned = np.ascontiguousarray(linked.T)
        while len(a):
            new_a = _smallest(linked, root_a, root_b)
            new_b = _smallest(turned, root_b, new_a)
            if (new_a == root_a).all() and (new_b == root_b).all():
                break
            root_a, root_b = new_a, new_b
        parts = [(ids[a], count_a, root_a)] + [(ids[b], count_b, root_b)] * (not one)
        out = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in range(3)]
        return pa.table({"class_id": out[0], "links": out[1], "root": out[2]})

    return links


def near_duplicate_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = SIMILAR) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every distinct vec_id: how many
    other vectors of the same label and a cosine >= threshold there are, the smallest id
    that links reach, and whether that is its own.

    Vectors without a label, and those that are null, zero or hold null or
    non-finite components, link with nothing; neither do vectors of different
    lengths. Rows that repeat an id are one vector: of usable ones the first by
    label and components. A row without an id has no links and no component and
    is kept. Other columns are not looked at; an empty table gives an empty result.
    """
    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    named = plain.where("vec_id is not null").select("vec_id", F.struct((F.col("label").isNull() | ~usable(F.col("embedding"))).alias("bad"), "label", "embedding").alias("own"))
    named = written(named.groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.*"), "named")
    good = named.where("not bad").select("vec_id", "label", "embedding")
    classes = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies")), "classes")
    member = good.join(classes, ["label", "embedding"]).select("vec_id", "class_id", "copies")

    found = written(_linked(classes, threshold), "found")
    star = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "class_id")
    linked = found.groupBy("class_id").agg(F.sum("links").alias("links")).join(star, "class_id")
    placed = member.join(linked, "class_id", "left").select(
        "vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id")
    )
    out = named.select("vec_id").join(placed, "vec_id", "left").unionByName(plain.where("vec_id is null").select("vec_id"), allowMissingColumns=True)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def centroids_of(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids for each length that a bounded sample holds, in proportion to the
    vectors of the largest label; other lengths are rare, and one cell each."""
    size = F.size("embedding")
    longest = classes.agg(F.max(size)).first()[0]
    if longest is None:
        return {}
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // longest))
    sample = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(rows).select("embedding").toArrow().column(0).combine_chunks()
    length = sample.value_lengths().to_numpy()
    dims = np.unique(length).tolist()
    counts = classes.where(size.isin(dims)).groupBy("label", size.alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n"))
    out, values = {}, 0
    for row in sorted(counts.collect(), key=lambda r: (-r.n, r.dim)):
        own = np.flatnonzero(length == row.dim)
        cells = min(max(CELLS, -(-row.n // CELL_ROWS)), MAX_CELLS, len(own), (CENTROID_VALUES - values) // row.dim)
        if cells > 1:
            out[row.dim] = spherical_kmeans(unit_rows(sample.take(pa.array(own))), cells)
            values += cells * row.dim
    return out


def _linked(classes: DataFrame, threshold: float) -> DataFrame:
    """(class_id, links, root), some rows for each vector that has links."""
    shared = classes.sparkSession.sparkContext.broadcast(centroids_of(classes))
    kind = classes.schema["embedding"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).value_lengths().to_numpy()
            cells: list[list[int]] = [[0]] * len(length)
            for dim in np.unique(length).tolist():
                if dim in shared.value:
                    at = np.flatnonzero(length == dim)
                    home, visits = cells_of(unit_rows(batch.column(3).take(pa.array(at))), shared.value[dim], threshold)
                    for i, h, v in zip(at.tolist(), home.tolist(), visits):
                        cells[i] = [h, *np.flatnonzero(v).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], ["label", "class_id", "copies", "embedding", "cells"])

    rows = classes.select("label", "class_id", "copies", "embedding").mapInArrow(place, f"label {label}, class_id long, copies long, embedding {kind}, cells array<int>")
    cell = ["label", "dim", "cell"]
    placed = written(rows.select("label", F.size("embedding").alias("dim"), "class_id", "copies", "embedding", F.posexplode("cells").alias("visit", "cell")), "placed")
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.col("dim"))))
    blocks = lambda own: F.greatest(F.ceil(F.sum(own.cast("int")) / most), F.lit(1)).cast("int")
    sizes = placed.groupBy(*cell).agg(blocks(F.col("visit") == 0).alias("homes"), blocks(F.col("visit") > 0).alias("visits"))
    placed = placed.join(written(sizes, "sizes"), cell)
    visiting = F.col("visit") > 0
    block = F.pmod(F.xxhash64("class_id"), F.when(visiting, F.col("visits")).otherwise(F.col("homes"))).cast("int")
    placed = placed.withColumn("block", block)
    all_homes = F.sequence(F.lit(0), F.col("homes") - 1)
    with_home = F.transform(all_homes, lambda k: F.struct(F.least("block", k).alias("p"), F.greatest("block", k).alias("q"), (F.col("block") > k).cast("int").alias("side")))
    with_visitor = F.transform(F.sequence(F.lit(0), F.col("visits") - 1), lambda k: F.struct(F.col("block").alias("p"), (-k - 1).alias("q"), F.lit(0).alias("side")))
    as_visitor = F.transform(all_homes, lambda k: F.struct(k.alias("p"), (-F.col("block") - 1).alias("q"), F.lit(1).alias("side")))
    dealt = placed.select(*cell, "class_id", "copies", "embedding", F.explode(F.when(visiting, as_visitor).otherwise(F.concat(with_home, with_visitor))).alias("at"))
    dealt = dealt.select(*cell, "class_id", "copies", "embedding", "at.*")
    return dealt.groupBy(*cell, "p", "q").applyInArrow(_block_links(threshold), "class_id long, links long, root long")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN roots r ON r.a = e.vec_id
"""

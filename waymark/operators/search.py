"""Candidates of the gated cells, their blended scores, and the best of them.

Queries have a column for each space (array<double>); places have row, cell,
lat, lon, csls (array<double>, in the order of the recipe's spaces), and for each
space <space> (array<tinyint>) and <space>_scale. Spaces without a column on
either side do not count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions.geo import EARTH_KM
from waymark.functions.vector import dequantised_dot, dot
from waymark.operators.gate import log_prior
from waymark.operators.index import PlaceIndex, PlainPlaces
from waymark.recipe import Recipe
from waymark.scratch import written

#: Places of a block, and queries, that one task scores at a time.
BLOCK, QUERY_BLOCK = 8192, 1024
#: So many queries go to every task of the places (66 MB at four spaces of 1024 numbers); of them so many are scored at a time.
FEW_QUERIES, SCAN_QUERIES = 2048, 64
#: Places, and queries, of a block of which every score leaves the task, and queries of it that are multiplied at a time (131,072 rows, 3 MB).
PAIR_PLACES, PAIR_QUERIES, PAIR_STEP = 2048, 1024, 64
#: Blocks of queries for which the places of a cell are sent once.
PAIR_PART = 4


def candidates(gated: DataFrame, places: DataFrame) -> DataFrame:
    """Every place of a query's gated cells: gated (qid, cell, p) and places joined on the cell."""
    return places.join(gated, "cell")


def blended(recipe: Recipe, spaces: list[str]) -> Column:
    """The score of a row that has query columns q_<space> and place columns."""
    total = log_prior(F.col("p"), recipe.prior_lam)
    for space in spaces:
        total = total + 2.0 * recipe.blend[space] * dequantised_dot(F.col(f"q_{space}"), F.col(space), F.col(f"{space}_scale"))
    for j, space in enumerate(recipe.csls_spaces):
        if space in recipe.blend:
            total = total - recipe.blend[space] * F.col("csls")[j]
    return total


def shared_spaces(recipe: Recipe, queries: DataFrame, places: DataFrame) -> list[str]:
    return [s for s in recipe.blend if s in queries.columns and s in places.columns]


def scored(queries: DataFrame, gated: DataFrame, places: DataFrame, recipe: Recipe) -> DataFrame:
    """(qid, row, p, s) of all candidates, by expressions alone."""
    spaces = shared_spaces(recipe, queries, places)
    left = queries.select("qid", *(F.col(s).alias(f"q_{s}") for s in spaces)).join(gated, "qid")
    wide = places.select("row", "cell", "csls", *(c for s in spaces for c in (s, f"{s}_scale")))
    return wide.join(left, "cell").select("qid", "row", "p", blended(recipe, spaces).alias("s"))


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query by s, the lower row first among equals; rank from 0."""
    order = W.partitionBy("qid").orderBy(F.desc("s"), "row")
    # filtered by the number itself, so that Spark keeps k rows of each task before the shuffle
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def log_priors(p: np.ndarray, recipe: Recipe) -> np.ndarray:
    return recipe.prior_lam * np.log(np.maximum(p, 1e-12))


def _sides(recipe: Recipe, spaces: list[str], of: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of places: the weighted vectors of all spaces side by side, and what hubness takes off the scores."""
    known = [2.0 * recipe.blend[s] * of.column(f"{s}_scale").to_numpy()[:, None] * _dense(of, s) for s in spaces]
    csls, off = _dense(of, "csls"), np.zeros(of.num_rows)
    for j, space in enumerate(recipe.csls_spaces):
        if space in recipe.blend:
            off += recipe.blend[space] * csls[:, j]
    return _side_by_side(known, of.num_rows), off


def _side_by_side(matrices: list[np.ndarray], n: int) -> np.ndarray:
    return np.hstack([np.empty((n, 0)), *matrices])


def _best(asked: np.ndarray, prior: np.ndarray, known: np.ndarray, off: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, place, score) of the k best places of each query. SCAN_QUERIES are scored at a
    time: what is held at once does not grow with the queries."""
    for at in range(0, len(asked), SCAN_QUERIES):
        s = asked[at : at + SCAN_QUERIES] @ known.T
        s += prior[at : at + SCAN_QUERIES, None]
        s -= off
        mine, place = _largest(s, rows, k)
        yield mine + at, place, s[mine, place]


def _dense(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _largest(s: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of the k largest of each row of s, the lower row first among equals."""
    at, place = np.nonzero(s >= np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None]) if k < s.shape[1] else np.nonzero(np.ones(s.shape, dtype=bool))
    order = np.lexsort((rows[place], -s[at, place], at))
    at, place = at[order], place[order]
    number = np.arange(len(at)) - np.searchsorted(at, at)
    return at[number < k], place[number < k]


#: What a block of queries and one of places have in common.
DEALT = ["cell", "block", "asker"]


def _dealt(queries: DataFrame, gated: DataFrame, places: DataFrame, spaces: list[str], more: list[str], of_block: int, of_asker: int) -> tuple[DataFrame, DataFrame]:
    """(DEALT, qid, p, q_<space>) and (DEALT, row, more, <space>, <space>_scale): queries and places of
    a cell in blocks of some of_asker and of_block, so that every block of either meets every one
    of the other. Cells are few: their sizes go to every task."""
    blocks = places.groupBy("cell").agg(F.ceil(F.count("*") / of_block).cast("int").alias("blocks"))
    askers = gated.groupBy("cell").agg(F.ceil(F.count("*") / of_asker).cast("int").alias("askers"))
    sizes = F.broadcast(blocks.join(askers, "cell"))
    dealt = places.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("asker", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)))
    right = dealt.select(*DEALT, "row", *more, *(c for s in spaces for c in (s, f"{s}_scale")))
    wanted = queries.select("qid", *(F.col(s).alias(f"q_{s}") for s in spaces)).join(gated.join(sizes, "cell"), "qid")
    wanted = wanted.withColumn("asker", F.pmod(F.xxhash64("qid"), F.col("askers")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return wanted.select(*DEALT, "qid", "p", *(f"q_{s}" for s in spaces)), right


def _blocks(queries: DataFrame, gated: DataFrame, places: DataFrame, spaces: list[str], more: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cell, part, own) and (cell, part, of): the queries and the places of a cell in blocks of some PAIR_QUERIES and
    PAIR_PLACES, each block one value (an Arrow stream). PAIR_PART blocks of queries are a part, which every block of
    places of the cell meets: a query is sent once for each of its cells, and a place once for each part."""
    blocks = places.groupBy("cell").agg(F.ceil(F.count("*") / PAIR_PLACES).cast("int").alias("blocks"))
    askers = gated.groupBy("cell").agg(F.ceil(F.count("*") / PAIR_QUERIES).cast("int").alias("askers"))
    sizes = F.broadcast(blocks.join(askers, "cell"))
    right = places.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("number"), "row", *more, *(c for s in spaces for c in (s, f"{s}_scale")))
    wanted = queries.select("qid", *(F.col(s).alias(f"q_{s}") for s in spaces)).join(gated.join(sizes, "cell"), "qid")
    left = wanted.select("cell", F.pmod(F.xxhash64("qid"), F.col("askers")).cast("int").alias("number"), "qid", "p", *(f"q_{s}" for s in spaces))

    def pack(own: pa.Table, of: pa.Table) -> pa.Table:
        sides = [(side, table) for side, table in enumerate((own, of)) if table.num_rows]
        keys = {c: pa.concat_arrays([t.column(c).combine_chunks()[:1] for _, t in sides]) for c in ("cell", "number")}
        return pa.table(keys | {"side": pa.array([side for side, _ in sides], pa.int32()), "data": pa.array([_streamed(t.drop_columns(["cell", "number"])) for _, t in sides], pa.binary())})

    cell = places.schema["cell"].dataType.simpleString()
    packed = left.groupBy("cell", "number").cogroup(right.groupBy("cell", "number")).applyInArrow(pack, f"cell {cell}, number int, side int, data binary")
    last = F.floor((F.col("askers") - 1) / PAIR_PART).cast("int")
    known = packed.where("side = 1").join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), last)).alias("part"), F.col("data").alias("of"))
    return packed.where("side = 0").select("cell", F.floor(F.col("number") / PAIR_PART).cast("int").alias("part"), F.col("data").alias("own")), known


def _streamed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _every(queries: DataFrame, gated: DataFrame, places: DataFrame, spaces: list[str], more: list[str], sides: Callable, into: str) -> DataFrame:
    """(qid, row, into) of all candidates: sides(own, of) gives a matrix of queries and what is added
    for each, a matrix of places and what is added for each; PAIR_STEP queries of a block are multiplied
    with one of places at a time, and leave the task before the next."""
    left, right = _blocks(queries, gated, places, spaces, more)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                own, of = (pa.ipc.open_stream(batch.column(c)[pair].as_buffer()).read_all() for c in ("own", "of"))
                asked, prior, known, rest = sides(own, of)
                qids, rows = own.column("qid").combine_chunks(), of.column("row").combine_chunks()
                for at in range(0, own.num_rows, PAIR_STEP):
                    s = asked[at : at + PAIR_STEP] @ known.T
                    s += prior[at : at + PAIR_STEP, None]
                    s += rest
                    n, m = s.shape
                    of_query, of_place = np.repeat(np.arange(at, at + n, dtype=np.int32), m), np.tile(np.arange(m, dtype=np.int32), n)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(of_query)), rows.take(pa.array(of_place)), pa.array(s.ravel())], ["qid", "row", into])

    qid, row = queries.schema["qid"].dataType.simpleString(), places.schema["row"].dataType.simpleString()
    return left.join(right, ["cell", "part"]).select("own", "of").mapInArrow(all_of, f"qid {qid}, row {row}, {into} double")


def scored_in_blocks(queries: DataFrame, gated: DataFrame, places: DataFrame, recipe: Recipe) -> DataFrame:
    """(qid, row, s) of all candidates, as scored(), by products of blocks. Queries and gated
    are read more than once: give them written."""
    spaces = shared_spaces(recipe, queries, places)

    def sides(own: pa.Table, of: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        known, off = _sides(recipe, spaces, of)
        prior = log_priors(own.column("p").to_numpy(), recipe)
        return _side_by_side([_dense(own, f"q_{s}") for s in spaces], own.num_rows), prior, known, -off

    return _every(queries, gated, places, spaces, ["csls"], sides, "s")


def dequantised_in_blocks(queries: DataFrame, gated: DataFrame, places: DataFrame, space: str, into: str) -> DataFrame:
    """(qid, row, into): the products of a space of all candidates, as dequantised_dot(), by blocks.
    Queries and gated are read more than once: give them written."""

    def sides(own: pa.Table, of: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        return _dense(own, f"q_{space}"), np.zeros(own.num_rows), of.column(f"{space}_scale").to_numpy()[:, None] * _dense(of, space), 0.0

    return _every(queries, gated, places, [space], [], sides, into)


def retrieve(queries: DataFrame, gated: DataFrame, places: DataFrame, recipe: Recipe) -> DataFrame:
    """(qid, cell, row, s): the best of each query's candidates, up to the recipe's
    top_k from each block of a cell. top_k() of it is that of all candidates.

    For any number of queries: places are dealt by cell and block, and so are the queries
    of a cell: a block of either is multiplied in one product, and only the best leave
    the task. A cell of any size, or one that any number of queries want, is several blocks.
    """
    spaces = shared_spaces(recipe, queries, places)
    left, right = _dealt(queries, gated, places, spaces, ["csls"], BLOCK, QUERY_BLOCK)
    qid, row, cell = queries.schema["qid"].dataType.simpleString(), places.schema["row"].dataType.simpleString(), places.schema["cell"].dataType.simpleString()

    def best(own: pa.Table, of: pa.Table) -> pa.Table:
        if not own.num_rows or not of.num_rows:
            return pa.table({"qid": own.column("qid")[:0], "cell": of.column("cell")[:0], "row": of.column("row")[:0], "s": pa.array([], pa.float64())})
        asked, prior = _side_by_side([_dense(own, f"q_{x}") for x in spaces], own.num_rows), log_priors(own.column("p").to_numpy(), recipe)
        at, place, s = (np.concatenate(x) for x in zip(*_best(asked, prior, *_sides(recipe, spaces, of), of.column("row").to_numpy(), recipe.top_k)))
        own_at, of_at = pa.array(at), pa.array(place)
        return pa.table({"qid": own.column("qid").take(own_at), "cell": of.column("cell").take(of_at), "row": of.column("row").take(of_at), "s": pa.array(s)})

    return left.groupBy(*DEALT).cogroup(right.groupBy(*DEALT)).applyInArrow(best, f"qid {qid}, cell {cell}, row {row}, s double")


def retrieve_few(queries: DataFrame, gated: DataFrame, places: DataFrame, recipe: Recipe) -> DataFrame:
    """As retrieve(), for at most FEW_QUERIES queries, which go to every task of the places:
    places stay where they are read. Each batch of a cell keeps the best for every query
    that wants the cell."""
    spaces = shared_spaces(recipe, queries, places)
    asked = queries.select("qid", *spaces).toArrow()
    if asked.num_rows > FEW_QUERIES:
        raise ValueError(f"more than {FEW_QUERIES} queries")
    number = {q: i for i, q in enumerate(asked.column("qid").to_pylist())}
    wanted = gated.select("cell", "qid", "p").toArrow().sort_by("cell")
    at = np.array([number.get(q, -1) for q in wanted.column("qid").to_pylist()], dtype=np.int64)
    known = at >= 0
    cells, first = np.unique(wanted.column("cell").to_numpy()[known], return_index=True)
    shared = queries.sparkSession.sparkContext.broadcast(
        (asked.column("qid").combine_chunks(), _side_by_side([_dense(asked, x) for x in spaces], asked.num_rows), at[known], wanted.column("p").to_numpy()[known], {int(c): (a, b) for c, a, b in zip(cells, first, np.append(first[1:], known.sum()))})
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors, at, p, of_cell = shared.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = np.append(np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1)), len(cell)) if len(cell) else np.zeros(1, dtype=int)
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                a, b = of_cell.get(int(cell[start]), (0, 0))
                for low in range(start, end, BLOCK):
                    part = batch.slice(low, min(end - low, BLOCK))
                    sides = _sides(recipe, spaces, part) if a < b else None
                    for i in range(a, b, QUERY_BLOCK):
                        own = at[i : min(b, i + QUERY_BLOCK)]
                        for mine, place, s in _best(vectors[own], log_priors(p[i : i + len(own)], recipe), *sides, part.column("row").to_numpy(), recipe.top_k):
                            yield pa.RecordBatch.from_arrays([qids.take(pa.array(own[mine])), part.column("cell").take(pa.array(place)), part.column("row").take(pa.array(place)), pa.array(s)], ["qid", "cell", "row", "s"])

    kinds = [f"{c} {(queries if c == 'qid' else places).schema[c].dataType.simpleString()}" for c in ("qid", "cell", "row")]
    return places.select("cell", "row", "csls", *(c for s in spaces for c in (s, f"{s}_scale"))).mapInArrow(best, f"{', '.join(kinds)}, s double")


def is_few(queries: DataFrame) -> bool:
    return queries.select("qid").limit(FEW_QUERIES + 1).count() <= FEW_QUERIES


def best(queries: DataFrame, gated: DataFrame, index: PlaceIndex | PlainPlaces, recipe: Recipe, few: bool | None = None) -> DataFrame:
    """(qid, cell, row, rank, s): the recipe's top_k places of each query, read from the
    gated cells only. A few queries go to the places, many are dealt with them. Queries and
    gated are read more than once: give them written."""
    places = index.in_cells(gated)
    search = retrieve_few if (is_few(queries) if few is None else few) else retrieve
    return top_k(search(queries, gated, places, recipe), recipe.top_k)


def found(queries: DataFrame, gated: DataFrame, index: PlaceIndex | PlainPlaces, recipe: Recipe) -> tuple[DataFrame, DataFrame]:
    """The top rows (qid, cell, row, rank, s, lat, lon, code, raw), what reranking needs,
    and (qid, n_candidates, gate_cells) of every query. The search runs here, once."""
    spaces = dict.fromkeys([*recipe.blend, "cls"])
    queries = written(queries.select("qid", *(s for s in spaces if s in queries.columns)), "queries")
    gated = written(gated.select("qid", "cell", "p"), "gated")
    few = is_few(queries)
    top = written(best(queries, gated, index, recipe, few), "top")
    late = index.winners(top, few).select("row", "lat", "lon", F.col("cls").alias("code"), "cls_scale")
    own = queries.select("qid", F.col("cls").alias("q"))
    wide = top.join(late, "row").join(F.broadcast(own) if few else own, "qid")
    raw = dot(F.col("q"), F.col("code")) * F.col("cls_scale")
    counts = gated.join(F.broadcast(index.sizes()), "cell", "left").groupBy("qid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_candidates"), F.count("*").alias("gate_cells"))
    return wide.select("qid", "cell", "row", "rank", "s", "lat", "lon", "code", raw.alias("raw")), counts


#: Places of a leaf, which are neighbours, and points of a block that meets a leaf.
LEAF, PASS_POINTS = 512, 16384
#: Bits of each axis in the order of neighbours, and what rounding may do to a distance on the unit sphere.
AXIS_BITS, SLACK = 20, 1e-7


def nearest(points: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(qid, row, km): the k places nearest to each point (qid, lat, lon), of equals the lower row.
    Points and places without a coordinate are left out.

    Places are packed into leaves of neighbours. The boxes of the leaves go to the points, which
    meet the leaves that may hold one of their k only; of places at one spot, the k lower rows count.
    """
    lowest = W.partitionBy("lat", "lon").orderBy("row")
    spots = _known(places).select("row", "lat", "lon").withColumn("number", F.row_number().over(lowest)).where(F.col("number") <= k)
    leaves = _leaves(spots.select("row", F.radians("lat").alias("phi"), F.radians("lon").alias("lam")))
    asked = written(_visits(_known(points).select("qid", F.radians("lat").alias("phi"), F.radians("lon").alias("lam")), leaves, k), "visits")
    askers = asked.groupBy("leaf").agg(F.ceil(F.count("*") / PASS_POINTS).cast("int").alias("askers"))
    left = asked.join(F.broadcast(askers), "leaf").withColumn("asker", F.pmod(F.xxhash64("qid"), F.col("askers")).cast("int"))
    right = leaves.join(F.broadcast(askers), "leaf").withColumn("asker", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)))
    kinds = points.schema["qid"].dataType.simpleString(), places.schema["row"].dataType.simpleString()

    def best(own: pa.Table, of: pa.Table) -> pa.Table:
        (p, q), (a, b) = ([t.column(c).to_numpy() for c in ("phi", "lam")] for t in (own, of))
        rows, found = of.column("row").to_numpy(), [(np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0))]
        for at in range(0, len(p) if len(a) else 0, SCAN_QUERIES):
            phi, lam = p[at : at + SCAN_QUERIES, None], q[at : at + SCAN_QUERIES, None]
            half = np.sin((a - phi) / 2) ** 2 + np.cos(phi) * np.cos(a) * np.sin((b - lam) / 2) ** 2
            km = 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(half, 0, 1)))
            mine, place = _largest(-km, rows, k)
            found.append((mine + at, place, km[mine, place]))
        mine, place, km = (np.concatenate(x) for x in zip(*found))
        return pa.table({"qid": own.column("qid").take(pa.array(mine)), "row": of.column("row").take(pa.array(place)), "km": pa.array(km)})

    met = left.select("leaf", "asker", "qid", "phi", "lam").groupBy("leaf", "asker").cogroup(right.select("leaf", "asker", "row", "phi", "lam").groupBy("leaf", "asker"))
    return top_k(met.applyInArrow(best, f"qid {kinds[0]}, row {kinds[1]}, km double").withColumn("s", -F.col("km")), k).select("qid", "row", "km")


def _known(rows: DataFrame) -> DataFrame:
    return rows.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")


def _on_sphere(phi: np.ndarray, lam: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], axis=1)


def _leaves(spots: DataFrame) -> DataFrame:
    """(leaf, row, phi, lam): places in an order that keeps neighbours together (the bits of the
    three axes in turn), cut every LEAF rows."""
    kind = spots.schema["row"].dataType.simpleString()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            axes = ((_on_sphere(batch.column(1).to_numpy(), batch.column(2).to_numpy()) + 1) * ((1 << AXIS_BITS - 1) - 1)).astype(np.int64)
            z = np.zeros(batch.num_rows, dtype=np.int64)
            for bit in range(AXIS_BITS):
                for i in range(3):
                    z |= (axes[:, i] >> bit & 1) << (3 * bit + i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], ["row", "phi", "lam", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            leaf = first + (seen + np.arange(batch.num_rows, dtype=np.int64)) // LEAF
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "row", "phi", "lam"])

    placed = written(spots.mapInArrow(order, f"row {kind}, phi double, lam double, z long"), "spots")
    dealt = placed.repartitionByRange(placed.count() // (64 * LEAF) + 1, "z", "row").sortWithinPartitions("z", "row")
    return written(dealt.select("row", "phi", "lam").mapInArrow(cut, f"leaf long, row {kind}, phi double, lam double"), "leaves")


def _visits(points: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    """(leaf, qid, phi, lam): the leaves that may hold one of the k nearest places of a point: no
    further at their nearest than the leaves that hold k places are at their furthest."""
    x = F.cos("phi") * F.cos("lam"), F.cos("phi") * F.sin("lam"), F.sin("phi")
    boxes = leaves.groupBy("leaf").agg(F.count("*").alias("n"), *(F.min(c).alias(f"low{i}") for i, c in enumerate(x)), *(F.max(c).alias(f"high{i}") for i, c in enumerate(x))).orderBy("leaf").toArrow()
    sides = [np.stack([boxes.column(f"{side}{i}").to_numpy() for i in range(3)], axis=1) for side in ("low", "high")]
    shared = points.sparkSession.sparkContext.broadcast((boxes.column("leaf").to_numpy(), boxes.column("n").to_numpy(), *sides))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, n, low, high = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows if len(leaf) else 0, SCAN_QUERIES):
                part = batch.slice(start, SCAN_QUERIES)
                at = _on_sphere(part.column(1).to_numpy(), part.column(2).to_numpy())
                near, far = np.zeros((len(at), len(leaf))), np.zeros((len(at), len(leaf)))
                for i in range(3):
                    under, over = low[:, i] - at[:, i, None], at[:, i, None] - high[:, i]
                    near += np.maximum(np.maximum(under, over), 0) ** 2
                    far += np.maximum(np.abs(under), np.abs(over)) ** 2
                order = np.argsort(far, axis=1)
                enough = np.minimum((np.cumsum(n[order], axis=1) < k).sum(axis=1), len(leaf) - 1)
                most = np.sqrt(np.take_along_axis(far, order, axis=1)[np.arange(len(at)), enough])
                if n.sum() < k:
                    most[:] = np.inf
                mine, of = np.nonzero(np.sqrt(near) <= most[:, None] + SLACK)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[of]), *(c.take(pa.array(mine)) for c in part.columns)], ["leaf", "qid", "phi", "lam"])

    return points.mapInArrow(visits, f"leaf long, qid {points.schema['qid'].dataType.simpleString()}, phi double, lam double")

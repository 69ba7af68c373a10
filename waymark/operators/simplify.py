"""Simpler borders that still fit together.

Rings are cut into arcs at the points where borders part, so that neighbours share whole
arcs. Each arc is simplified once, whichever features it bounds: it keeps its ends, and no
point of it is further than the tolerance from the simpler line. Where two of the simpler
segments touch or cross, points come back until none do, as far as the given borders do
not. The method is this library's own; it takes degrees as they are, on a plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.worldmap import without_repeats
from waymark.scratch import written

#: Degrees of a square of the grid on which segments meet.
SQUARE = 1.0
#: After so many rounds of giving points back, all points of what still crosses come back.
ROUNDS = 20

_POINTS = "array<struct<lon:double,lat:double>>"


def _xy(points: list[dict]) -> np.ndarray:
    return np.array([(p["lon"], p["lat"]) for p in points], dtype=float).reshape(-1, 2)


def cut(points: np.ndarray, nodes: list[int]) -> list[tuple[np.ndarray, bool]]:
    """(arc, forward) of an open ring, in its order: from node to node, or all around from
    its least point. Of an arc's two directions the lesser is taken, so that neighbours,
    which go along it in opposite ways, have the same."""
    n = len(points)
    if not nodes:
        nodes = [min(range(n), key=lambda i: tuple(points[i]))]
    out = []
    for a, b in zip(nodes, [*nodes[1:], nodes[0] + n]):
        arc = points[np.arange(a, b + 1) % n]
        forward = arc.tolist() <= arc[::-1].tolist()
        out.append((arc if forward else arc[::-1], forward))
    return out


def _distances(points: np.ndarray, a: int, b: int) -> np.ndarray:
    """Of the points between two, how far they are from the segment between those."""
    p, d, own = points[a], points[b] - points[a], points[a + 1 : b]
    length = float(d @ d)
    t = np.clip(((own - p) @ d) / length, 0.0, 1.0) if length else np.zeros(len(own))
    return np.sqrt(((own - p - t[:, None] * d) ** 2).sum(axis=1))


def kept_points(points: np.ndarray, tolerance: float, ends: list[int]) -> list[int]:
    """Of an arc, the points at ends and those that keep all others within the tolerance:
    the furthest of a stretch, again and again."""
    out, left = set(ends), list(zip(ends, ends[1:]))
    while left:
        a, b = left.pop()
        if b - a > 1:
            far = _distances(points, a, b)
            k = int(far.argmax())
            if far[k] > tolerance:
                out.add(a + 1 + k)
                left += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(out)


def first_ends(points: np.ndarray) -> list[int]:
    """The ends of an arc; of one that comes back to its start, two points more: the one
    furthest from there, and the one furthest from the line between."""
    n = len(points) - 1
    if n < 3 or (points[0] != points[-1]).any():
        return list(range(len(points))) if n < 3 and (points[0] == points[-1]).all() else [0, n]
    far = 1 + int(((points[1:n] - points[0]) ** 2).sum(axis=1).argmax())
    sides = [(float(_distances(points, a, b).max()), a + 1 + int(_distances(points, a, b).argmax())) for a, b in ((0, far), (far, n)) if b - a > 1]
    return sorted({0, far, max(sides)[1], n})


def returned(points: np.ndarray, tolerance: float, kept: list[int], bad: list[int], all_points: bool) -> list[int]:
    """kept with the furthest point of each bad segment (or all points of it), and what
    that makes necessary to stay within the tolerance."""
    out = set(kept)
    for k in bad:
        a, b = kept[k], kept[k + 1]
        if b - a > 1:
            middle = a + 1 + int(_distances(points, a, b).argmax())
            out |= set(range(a, b + 1)) if all_points else set(kept_points(points, tolerance, [a, middle, b]))
    return sorted(out)


def arcs(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of features (feature_id, rings): (arc, points) of each distinct arc, and (feature_id,
    ring, seq, forward, arc): which arcs a ring is made of. A point is where borders part if
    the points beside it, in all rings, are not two."""
    rings = features.select("feature_id", F.posexplode("rings").alias("ring", "points"))
    rings = written(rings.select("feature_id", "ring", without_repeats(F.col("points")).cast(_POINTS).alias("points")).where(F.size("points") > 2), "rings")
    beside = lambda by: lambda p, i: F.struct(p.alias("p"), F.get("points", F.pmod(i + by, F.size("points"))).alias("q"), i.alias("i"))
    around = rings.select("feature_id", "ring", F.explode(F.concat(F.transform("points", beside(1)), F.transform("points", beside(-1)))).alias("v")).select("feature_id", "ring", "v.*")
    nodes = around.select("p", "q").distinct().groupBy("p").count().where("count <> 2").select("p")
    at = around.join(nodes, "p").select("feature_id", "ring", "i").distinct().groupBy("feature_id", "ring").agg(F.array_sort(F.collect_list("i")).alias("nodes"))
    kind = features.schema["feature_id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [(r["feature_id"], r["ring"], i, forward, arc) for r in rows for i, (arc, forward) in enumerate(cut(_xy(r["points"]), r["nodes"] or []))]
            flat = [[{"lon": x, "lat": y} for x, y in f[4].tolist()] for f in found]
            names = ["feature_id", "ring", "seq", "forward", "points"]
            kinds = [batch.schema.field("feature_id").type, pa.int32(), pa.int32(), pa.bool_(), batch.schema.field("points").type]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[k]) for k in range(4)] + [pa.array(flat, kinds[4])], names)

    uses = rings.join(at, ["feature_id", "ring"], "left").mapInArrow(parts, f"feature_id {kind}, ring int, seq int, forward boolean, points {_POINTS}")
    uses = written(uses, "uses")
    name = F.concat_ws("/", F.col("feature_id").cast("string"), F.lpad(F.col("ring").cast("string"), 6, "0"), F.lpad(F.col("seq").cast("string"), 9, "0"))
    distinct = written(uses.groupBy("points").agg(F.min(name).alias("arc")), "arcs")
    return distinct.select("arc", "points"), written(uses.join(distinct, "points").select("feature_id", "ring", "seq", "forward", "arc"), "uses")


def segments(state: DataFrame) -> DataFrame:
    """(arc, k, x1, y1, x2, y2, more) of the segments between kept points; more: points are left out there."""
    point = lambda j: F.col("points")[F.col("kept")[j]]
    one = lambda k: F.struct(k.alias("k"), point(k)["lon"].alias("x1"), point(k)["lat"].alias("y1"), point(k + 1)["lon"].alias("x2"), point(k + 1)["lat"].alias("y2"), (F.col("kept")[k + 1] - F.col("kept")[k] > 1).alias("more"))
    return state.select("arc", F.explode(F.transform(F.sequence(F.lit(0), F.size("kept") - 2), one)).alias("s")).select("arc", "s.*")


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def meet(a: str, b: str) -> Column:
    """Whether two segments have more in common than one end of both."""
    ax, ay, bx, by = (F.col(f"{a}.{n}") for n in ("x1", "y1", "x2", "y2"))
    cx, cy, dx, dy = (F.col(f"{b}.{n}") for n in ("x1", "y1", "x2", "y2"))
    same = lambda x, y, u, v: ((x == u) & (y == v)).cast("int")
    first = same(ax, ay, cx, cy) + same(ax, ay, dx, dy)  # the first's start is an end of the second
    shared = first + same(bx, by, cx, cy) + same(bx, by, dx, dy)
    boxes = (F.greatest(ax, bx) >= F.least(cx, dx)) & (F.greatest(cx, dx) >= F.least(ax, bx)) & (F.greatest(ay, by) >= F.least(cy, dy)) & (F.greatest(cy, dy) >= F.least(ay, by))
    across = boxes & (_turn(cx, cy, dx, dy, ax, ay) * _turn(cx, cy, dx, dy, bx, by) <= 0) & (_turn(ax, ay, bx, by, cx, cy) * _turn(ax, ay, bx, by, dx, dy) <= 0)
    sx, sy, px, py = (F.when(first > 0, x).otherwise(y) for x, y in ((ax, bx), (ay, by), (bx, ax), (by, ay)))
    at_start = (cx == sx) & (cy == sy)
    qx, qy = F.when(at_start, dx).otherwise(cx), F.when(at_start, dy).otherwise(cy)
    folded = (_turn(sx, sy, px, py, qx, qy) == 0) & ((px - sx) * (qx - sx) + (py - sy) * (qy - sy) > 0)
    return F.when(shared >= 2, True).when(shared == 1, folded).otherwise(across)


def meeting(found: DataFrame, square: float = SQUARE) -> DataFrame:
    """(arc, k) of the segments that meet another, of those that leave points out. Segments
    meet on the squares of a grid, so the join has a key."""
    cells = lambda u, v: F.sequence(F.floor(F.least(u, v) / square).cast("int"), F.floor(F.greatest(u, v) / square).cast("int"))
    dealt = found.withColumn("gx", F.explode(cells("x1", "x2"))).withColumn("gy", F.explode(cells("y1", "y2")))
    a, b = dealt.alias("a"), dealt.alias("b")
    on = (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & (F.struct("a.arc", "a.k") < F.struct("b.arc", "b.k"))
    pairs = a.join(b, on).where((F.col("a.more") | F.col("b.more")) & meet("a", "b"))
    both = pairs.select(F.explode(F.array(F.struct("a.arc", "a.k", "a.more"), F.struct("b.arc", "b.k", "b.more"))).alias("s")).select("s.*")
    return both.where("more").select("arc", "k").distinct()


def simplified(features: DataFrame, tolerance: float, square: float = SQUARE) -> DataFrame:
    """features (feature_id, rings, ...) with simpler rings, and all their columns. Points
    that equal the one before are one; rings of fewer than three points go, and features
    without any ring with them. A border that two features share stays the same for both."""
    lines, uses = arcs(features)
    names = ["arc", "points", "kept"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_xy(p) for p in batch.column("points").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([kept_points(p, tolerance, first_ends(p)) for p in own], pa.list_(pa.int32()))], names)

    schema = f"arc string, points {_POINTS}, kept array<int>"
    state = written(lines.mapInArrow(first, schema), "simplified")
    for number in range(ROUNDS + 1):
        bad = written(meeting(segments(state), square), "meeting")
        if bad.isEmpty():
            break
        last = number == ROUNDS

        def again(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in (*names, "bad")))
                kept = [returned(_xy(p), tolerance, k, sorted(b), last) if b else k for _, p, k, b in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(kept, pa.list_(pa.int32()))], names)

        state = written(state.join(bad.groupBy("arc").agg(F.collect_list("k").alias("bad")), "arc", "left").mapInArrow(again, schema), "simplified")
    line = F.transform("kept", lambda i: F.col("points")[i])
    own = uses.join(state.select("arc", line.alias("line")), "arc")
    along = F.when(F.col("forward"), F.col("line")).otherwise(F.reverse("line"))
    parts = own.select("feature_id", "ring", F.struct("seq", F.slice(along, F.lit(1), F.size(along) - 1).alias("line")).alias("part"))
    rings = parts.groupBy("feature_id", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"])).alias("points"))
    whole = rings.groupBy("feature_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
    return features.drop("rings").join(whole, "feature_id").select(*features.columns)

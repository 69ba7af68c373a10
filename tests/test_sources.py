"""Sources, images, series and the stream."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import images, series, worldmap
from waymark.plans import fixture as X
from waymark.sources import assets, geojson, mapfile
from waymark.streaming import locate

SF = "/root/testdata/sf0.001"
BOX = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
FEATURES = [("land", "polygon", "A", [BOX, [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]), ("land", "polygon", "Bé", [[(20.0, 0.0), (21.0, 0.0), (20.0, 1.0)]]), ("coast", "line", "", [[(0.0, 0.0), (1.0, 1.0)]])]
PLACES = [("towns", "Small", 1.0, 2.0, 10, "A", 9, 0, 255), ("towns", "Large", 3.0, 4.0, 900, "A", 0, 9, 1), ("towns", "Equal", 3.0, 4.0, 900, "A", 0, 9, 1), ("labels", "Bé", 20.2, 0.2, 5, "Bé", 3, 16, 3)]


def test_map_round_trip(spark, tmp_path):
    data = mapfile.map_bytes(FEATURES, PLACES)
    assert mapfile.MapFile(data).problems() == []
    (tmp_path / "w.bin").write_bytes(data)
    rows = mapfile.map_table(spark, str(tmp_path / "w.bin")).collect()
    assert [(r.layer, r.kind, r.name, [[(p.lon, p.lat) for p in ring] for ring in r.rings]) for r in rows] == [(a, b, c, d) for a, b, c, d in FEATURES]
    places = mapfile.map_table(spark, f"file://{tmp_path}/w.bin", "places").collect()
    assert [r.name for r in places] == ["Equal", "Large", "Small", "Bé"] and places[1].flags == 9 and places[3].country == "Bé"
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 0.2, 20.2), (4, 5.0, 10.1), (5, 5.0, 40.0)], "point_id int, lat double, lon double")
    land = mapfile.map_table(spark, str(tmp_path / "w.bin")).where("kind = 'polygon'")
    got = {r.point_id: r.name for r in worldmap.country_at(points, land).collect()}
    assert got == {1: "A", 2: None, 3: "Bé", 4: "A", 5: None}


def test_map_damage():
    data = mapfile.map_bytes(FEATURES, PLACES)
    assert "file size" in mapfile.MapFile(data + b"x").problems()
    for bad in (b"", b"x" * 200):
        with pytest.raises(ValueError):
            mapfile.MapFile(bad)
    at = struct.unpack_from("<I", data, 4 * mapfile.HEADER.index("place_at"))[0]
    worse = bytearray(data)
    worse[at + 20] = 14
    assert {x.split(" of ")[0] for x in mapfile.MapFile(bytes(worse)).problems()} == {"order", "rank index"}


def test_map_problems_are_rows(spark, tmp_path):
    data = mapfile.map_bytes(FEATURES, PLACES)
    head = dict(zip(mapfile.HEADER, struct.unpack_from(f"<{len(mapfile.HEADER)}I", data)))

    def changed(at, new):
        worse = bytearray(data)
        worse[at : at + len(new)] = new
        return bytes(worse)

    cases = {
        "whole": (data, set()),
        "long": (data + b"x", {("file size", None, None)}),
        "late": (changed(head["place_at"] + 20, b"\x0e"), {("order", "towns", 1), *(("rank index", "towns", r) for r in range(1, 15))}),
        "index": (changed(head["rank_at"] + 4 * 5, b"\x09"), {("rank index", "towns", 5)}),
        "box": (changed(head["feature_at"] + 12, struct.pack("<f", 5.0)), {("box", "land", 0)}),
        "ring": (changed(head["ring_at"] + 4, struct.pack("<I", 2)), {("points of rings", None, None), ("short ring", "land", 0)}),
    }
    for name, (content, want) in cases.items():
        path = tmp_path / f"{name}.bin"
        path.write_bytes(content)
        got = {tuple(r) for r in mapfile.map_problems(spark, str(path)).collect()}
        assert got == want, name
        rules = lambda x: x.split(" of ")[0] if x != "points of rings" else x
        assert {rules(x.split(" in ")[0]) for x in mapfile.MapFile(content).problems()} == {g[0] for g in got}
    (tmp_path / "bad.bin").write_bytes(data[:-10])
    with pytest.raises(ValueError):
        list(mapfile.MapFile(data[:-10]).features()) + list(mapfile.MapFile(data[:-10]).places())


def test_map_reads_what_is_asked(spark, tmp_path):
    """Layers and ranks leave out ranges of records, whose bytes are not read; the rows are those of a filter on all."""
    towns = [(layer, f"{layer} {i}", i / 100, -i / 200, 5 * i, "A", (i * 7) % 19, 0, 1) for layer in ("towns", "labels") for i in range(2000)]
    data = mapfile.map_bytes(FEATURES, towns)
    path = tmp_path / "w.bin"
    path.write_bytes(data)
    places = mapfile.map_table(spark, str(path), "places", records=100)
    everything = [r for r in places.collect()]
    assert len(everything) == 4000 and mapfile.MapFile(data).problems() == []
    for where, keep in [("rank <= 3", lambda r: r["rank"] <= 3), ("rank < 3 AND layer = 'towns'", lambda r: r["rank"] < 3 and r.layer == "towns"), ("rank = 18", lambda r: r["rank"] == 18), ("rank >= 14 AND rank <= 16", lambda r: 14 <= r["rank"] <= 16), ("rank > 20", lambda r: False), ("rank < -1", lambda r: False), ("layer IN ('labels', 'x') AND rank = 0", lambda r: r.layer == "labels" and r["rank"] == 0), ("layer = 'towns' AND layer = 'labels'", lambda r: False)]:
        assert sorted(places.where(where).collect()) == sorted(r for r in everything if keep(r)), where
    assert places.where("layer = 'towns' AND rank < 2").rdd.getNumPartitions() == 3 and places.rdd.getNumPartitions() == 40
    assert mapfile.map_table(spark, str(path)).where("layer = 'coast'").rdd.getNumPartitions() == 1
    read = []

    def ranged(at, n):
        read.append(n)
        return data[at : at + n]

    world = mapfile.MapFile(ranged)
    index = world.rank_index("towns")
    assert len(list(world.places_at("towns", 0, index[2]))) == sum(r["rank"] < 2 and r.layer == "towns" for r in everything)
    assert sum(read) < len(data) / 2.5


def test_snap_distance_and_device_rules(spark):
    land = worldmap.boxes(spark.createDataFrame([(1, "A", [[{"lon": 0.0, "lat": 60.0}, {"lon": 1.0, "lat": 60.0}, {"lon": 1.0, "lat": 61.0}, {"lon": 0.0, "lat": 61.0}]])], "feature_id int, name string, rings array<array<struct<lon:double,lat:double>>>"), pad=0.0)
    km = float(111.32 * np.cos(np.radians(60.5)))
    points = spark.createDataFrame([(1, 60.5, 1 + 49.9 / km), (2, 60.5, 1 + 50.1 / km)], "point_id int, lat double, lon double")
    assert [(r.point_id, round(r.km, 2)) for r in worldmap.nearest_coast(points, land).collect()] == [(1, 49.9)]
    assert worldmap.nearest_coast(points, land, device=True).count() == 0  # its box is as narrow as at the equator


def test_rings(spark):
    ring = [{"lon": x, "lat": y} for x, y in [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]
    row = spark.createDataFrame([(ring,)], "ring array<struct<lon:double,lat:double>>").select(worldmap.without_repeats(F.col("ring")).alias("r"), worldmap.ring_area(F.col("ring")).alias("a")).first()
    assert len(row.r) == 3 and row.a == 0.5


def test_geojson(spark, tmp_path):
    rows = [
        {"properties": {"NAME": "P"}, "geometry": {"type": "Polygon", "coordinates": [BOX]}},
        {"properties": {"NAME": "M"}, "geometry": {"type": "MultiPolygon", "coordinates": [[BOX], [BOX, BOX]]}},
        {"properties": {"NAME": "L"}, "geometry": {"type": "MultiLineString", "coordinates": [BOX[:2], BOX[2:]]}},
        {"properties": {"NAME": " ", "NAMEASCII": "Town", "SCALERANK": 3, "POP_MAX": 7}, "geometry": {"type": "Point", "coordinates": [5.0, 6.0]}},
        {"properties": {}, "geometry": {"type": "Point", "coordinates": [5.0, 6.0]}},
    ]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    collection = geojson.read_collection(spark, str(tmp_path / "c.json"))
    got = [(json.loads(r.properties)["NAME"], r.part, len(r.rings), len(r.rings[0])) for r in geojson.parts(collection).collect()]
    assert got == [("P", 0, 1, 4), ("M", 0, 1, 4), ("M", 1, 2, 4), ("L", 0, 1, 2), ("L", 1, 1, 2)]
    town = geojson.settlements(collection).collect()
    assert [(t.name, t.lon, t.lat, t.scalerank, t.pop_max) for t in town] == [("Town", 5.0, 6.0, 3, 7)]


def test_assets(spark, tmp_path):
    (tmp_path / "index").mkdir()
    (tmp_path / "index/a.i1").write_bytes(np.arange(-6, 6, dtype="i1").tobytes())
    flat = assets.read_flat(spark, str(tmp_path / "index/a.i1"), "i1", 4).collect()
    assert [(r.row, r["values"]) for r in flat] == [(0, [-6, -5, -4, -3]), (1, [-2, -1, 0, 1]), (2, [2, 3, 4, 5])]
    hashed = assets.hashed(assets.read_files(spark, str(tmp_path / "index"))).collect()
    assert hashed[0].sha256 == hashlib.sha256(np.arange(-6, 6, dtype="i1").tobytes()).hexdigest() and hashed[0].bytes == 12
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "files": [{"path": "a", "bytes": 1, "sha256": "x"}, {"path": "b", "bytes": 2, "sha256": "y"}]}))
    manifest = assets.read_manifest(spark, str(tmp_path / "m.json"))
    there = spark.createDataFrame([("a", 1), ("b", 3)], "path string, bytes long")
    assert [r.path for r in assets.to_do(manifest.select("path", "bytes"), there).collect()] == ["b"]


def test_resize_is_what_loops_say(spark):
    rng = np.random.default_rng(2)
    for (h, w), to in (((7, 9), 4), ((3, 4), 6)):
        image = rng.integers(0, 256, (h, w, 3))
        rows = [("i", y, x, c, int(image[y, x, c])) for y in range(h) for x in range(w) for c in range(3)]
        got = images.resized(spark.createDataFrame(rows, "image string, y int, x int, c int, value int"), w, h, to)
        wx, wy = np.zeros((to, w)), np.zeros((to, h))
        for m, size in ((wx, w), (wy, h)):
            for t, s, v in images.weights(size, to):
                m[t, s] = v
            assert np.allclose(m.sum(axis=1), 1)
        rounded = lambda a: np.clip(np.floor(np.round(a, 9) + 0.5), 0, 255)
        want = rounded(np.einsum("th,hxc->txc", wy, rounded(np.einsum("tw,ywc->ytc", wx, image))))
        assert all(want[r.y, r.x, r.c] == r.value for r in got.collect())
        assert len(images.tensors(images.normalised(got)).first().tensor) == 3 * to * to


def test_smoothing(spark):
    row = spark.sql("SELECT array(4.0d, 8.0d, 0.0d) AS v, array(named_struct('t', 100L, 'bytes', 10d), named_struct('t', 600L, 'bytes', 20d), named_struct('t', 700L, 'bytes', 5d)) AS s")
    got = row.select(series.smoothed(F.col("v")).alias("m"), series.by_window(F.col("s")).alias("w")).first()
    assert got.m == (4.0 * 0.75 + 8.0 * 0.25) * 0.75 and got.w == [30 * 1000 / 600]


def in_turn(values, keep=0.75):
    out, mean = [], None
    for x in values:
        mean = x if not mean or x is None else mean * keep + x * (1 - keep)
        out.append(mean)
    return out


def test_smoothing_of_a_long_series_is_spread(spark):
    n = 1_000_000
    rows = spark.range(n, numPartitions=4).select(F.col("id").alias("t"), F.when(F.col("id") < 600_000, 0.0).otherwise(F.col("id") * 7919 % 1009 / 10.0).alias("v"))
    got = series.smoothed_rows(rows, [], ["t"], "v")
    spread = [p for p, in got.select(F.spark_partition_id()).distinct().collect()]
    found = got.orderBy("t").toPandas()
    want = in_turn([0.0 if i < 600_000 else i * 7919 % 1009 / 10 for i in range(n)])
    assert len(spread) > 1 and np.allclose(found.smoothed, want, rtol=1e-12, atol=0)


def test_smoothing_of_many_series(spark):
    """Nulls start a series anew, null keys are a key, zeros wait for the first value, series of any length, equal values; clashing names."""
    rng = np.random.default_rng(3)
    data = []
    for k in [None, "", "a", "b", "c", "long"]:
        for j in (None, 0, 1):
            for i in range(400 if k == "long" else int(rng.integers(0, 9))):
                x = rng.choice([None, 0.0, float(rng.integers(0, 50))], p=[0.05, 0.4, 0.55])
                data.append((k, j, i, x, "x"))
    rows = spark.createDataFrame(data, "k string, j int, t int, v double, tail string").repartition(3)
    got = {(r.k, r.j, r.t): r.smoothed for r in series.smoothed_rows(rows, ["k", "j"], ["t"], "v").collect()}
    assert len(got) == len(data)
    for key in {d[:2] for d in data}:
        own = sorted((d[2], d[3]) for d in data if d[:2] == key)
        for (t, _), want in zip(own, in_turn([x for _, x in own])):
            have = got[(*key, t)]
            assert (have is None) == (want is None) and (want is None or np.isclose(have, want, rtol=1e-12, atol=0)), (key, t)
    empty = series.smoothed_rows(rows.where("t < 0"), ["k"], ["t"], "v")
    assert empty.columns == ["k", "j", "t", "v", "tail", "smoothed"] and empty.count() == 0


def test_stream_answers_as_a_batch(spark, tmp_path):
    q, p = X.queries(spark, SF), X.places(spark, SF)
    logits = X.logits(spark, SF).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "logit"))), lambda x: x["logit"]).alias("logits"))
    given = q.join(logits, "qid").select("qid", "logits", *X.SPACES)
    given.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(given.schema).parquet(f"{tmp_path}/in")
    run = locate.locate_stream(stream, p, X.RECIPE, f"{tmp_path}/out", f"{tmp_path}/state")
    run.processAllAvailable()
    run.stop()
    got = {(r.qid, r["rank"]): r.row for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    top = X.best(spark, SF)[0]
    assert got == {(r.qid, r["rank"]): r.row for r in top.collect()}

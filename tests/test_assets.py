"""Flat files, bundles, manifests and the map as files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import worldmap
from waymark.plans import fixture as X
from waymark.sources import assets, geojson, mapfile

SF = "/root/testdata/sf0.001"


def test_flat_files_are_read_in_ranges(spark, tmp_path):
    for kind in ("i1", "u2", "f4", "f8"):
        data = np.arange(1000 * 3).astype(f"<{kind}").reshape(-1, 3)
        (tmp_path / kind).write_bytes(data.tobytes())
        rows = assets.read_flat(spark, f"file://{tmp_path}/{kind}", kind, 3, rows_per_part=77)
        assert rows.rdd.getNumPartitions() == 13
        assert [r["values"] for r in rows.orderBy("row").collect()] == data.tolist()
        assert [r.row for r in rows.orderBy("row").collect()] == list(range(1000))
    (tmp_path / "empty").write_bytes(b"")
    assert assets.read_flat(spark, f"{tmp_path}/empty", "i1", 3).count() == 0
    with pytest.raises(Exception, match="not a number of rows"):
        assets.read_flat(spark, f"{tmp_path}/i1", "i1", 7).count()


def test_bundles_and_centroids(spark, tmp_path):
    c = np.random.default_rng(1).normal(size=(4, 3))
    np.savez(tmp_path / "a.npz", centroids=c, b=np.float64(2.5), n=np.array([1, 2]), text=np.array(["x"]))
    rows = {r.name: r for r in assets.read_bundle(spark, f"{tmp_path}/a.npz").collect()}
    assert rows.keys() == {"centroids", "b", "n"} and rows["b"].shape == [] and rows["b"]["values"] == [2.5]
    got = assets.centroids(assets.read_bundle(spark, f"{tmp_path}/a.npz")).orderBy("cell").collect()
    assert [r.cell for r in got] == [0, 1, 2, 3] and np.allclose([r.v for r in got], c)


def test_manifests_come_back(spark, tmp_path):
    files = spark.createDataFrame([("b", 5, "y"), ("a", 3, "x")], "path string, bytes long, sha256 string")
    found = assets.manifest_object(files, "v1", "https://example.org/")
    assert found["total_bytes"] == 8 and [f["path"] for f in found["files"]] == ["a", "b"]
    (tmp_path / "m.json").write_text(json.dumps(found))
    assert sorted(map(tuple, assets.read_manifest(spark, f"{tmp_path}/m.json").collect())) == [("a", 3, "x"), ("b", 5, "y")]
    left = assets.totals(files, spark.createDataFrame([("a", 3), ("b", 4)], "path string, bytes long")).first()
    assert tuple(left) == (2, 8, 1, 5) and tuple(assets.totals(files.limit(0), files).first()) == (0, 0, 0, 0)


def test_places_beyond_a_rank_are_left_out(spark, tmp_path):
    rows = [{"properties": {"NAME": f"N{k}", "SCALERANK": k}, "geometry": {"type": "Point", "coordinates": [0.0, 0.0]}} for k in (None, -1, 0, 8, 9, 20)]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    found = geojson.read_collection(spark, f"{tmp_path}/c.json")
    assert geojson.settlements(found).count() == 6
    assert sorted(r.name for r in geojson.settlements(found, 8).collect()) == ["N-1", "N0", "N8"]


def test_a_map_is_written_and_its_first_version_read(spark, tmp_path):
    features = X.features_of_nations(spark, SF).withColumn("layer", F.lit("land")).withColumn("kind", F.lit("polygon"))
    places = spark.createDataFrame([("towns", "A", 1.0, 2.0, 10, "X", 3, 1, 255)], "layer string, name string, lon double, lat double, pop_max long, country string, rank int, flags int, label_rank int")
    path = f"{tmp_path}/world.bin"
    size = mapfile.write_map(features, places, path)
    data = (tmp_path / "world.bin").read_bytes()
    assert len(data) == size and mapfile.MapFile(data).problems() == []
    back = mapfile.map_table(spark, path)
    want = {r.feature_id: r for r in features.collect()}
    assert [r.name for r in back.orderBy("feature_id").collect()] == [want[k].name for k in sorted(want)]
    assert mapfile.map_table(spark, path, "places").first().name == "A"
    first = bytearray(mapfile.map_bytes([("land", "polygon", "A", [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]])], []))
    first[4:8] = (1).to_bytes(4, "little")
    (tmp_path / "v1.bin").write_bytes(bytes(first))
    (row,) = mapfile.map_table(spark, f"{tmp_path}/v1.bin").collect()
    assert row.name == "A" and len(row.rings[0]) == 3 and mapfile.map_table(spark, f"{tmp_path}/v1.bin", "places").count() == 0


def test_geometry_is_compared_feature_by_feature(spark):
    ring = [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}, {"lon": 0.0, "lat": 1.0}]
    schema = "layer string, kind int, k long, name string, rings array<array<struct<lon:double,lat:double>>>, min_lon double, min_lat double, max_lon double, max_lat double"
    row = lambda layer, k, name="a", rings=None, kind=0, box=1.0: (layer, kind, k, name, rings or [ring], 0.0, 0.0, box, 1.0)
    old = [row("a", 0), row("a", 1), row("a", 2), row("a", 3), row("b", 0), row("c", 0), row("d", 0), row("e", 0, None)]
    new = [row("a", 0), row("a", 1, "z"), row("a", 2, box=2.0), row("a", 3, rings=[ring[::-1]]), row("b", 0), row("b", 1), row("d", 0, kind=1), row("e", 0, None), row("f", 0)]
    found = worldmap.geometry_difference(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([("a", 1, "name or rings"), ("a", 2, "box"), ("a", 3, "coordinates"), ("b", None, "layer differs"), ("c", None, "layer removed"), ("d", None, "layer differs"), ("f", None, "layer added")], key=str)


def test_inner_points_lie_inside(spark):
    rows = X.features_of_nations(spark, SF).select(F.col("feature_id").cast("long").alias("feature_id"), "name", "rings", "min_lon", "max_lon", "min_lat", "max_lat", worldmap.inner_point(F.col("rings")).alias("p"))
    points = rows.select(F.col("feature_id").alias("point_id"), "p.lat", "p.lon")
    for r in worldmap.containing(points, rows.drop("p")).collect():
        assert r.feature_id <= r.point_id
    assert points.join(worldmap.containing(points, rows.drop("p")), "point_id", "left_anti").count() == 0

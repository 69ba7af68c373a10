"""The flat form of an index: to the byte, and what is refused."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waymark.sources import flatindex

SPACES = ["cls", "geo"]
N, CELLS, DIM = 1000, 30, 6


def rows(n=N):
    rng = np.random.default_rng(0)
    cell = np.sort(rng.integers(0, CELLS - 2, n))  # the last cells are empty
    out = {"row": np.arange(n), "cell": cell, "latlon": rng.uniform(-90, 90, (n, 2)).astype("<f4"), "csls": rng.normal(size=(n, 3)).astype("<f4")}
    for s in SPACES:
        out[s], out[f"{s}_scale"] = rng.integers(-128, 128, (n, DIM)).astype("i1"), rng.uniform(size=n).astype("<f4")
    return out


def bytes_of(own):
    """What the files should hold, written by numpy alone."""
    want = {"latlon.f32": own["latlon"].tobytes(), "cell_id.u16": own["cell"].astype("<u2").tobytes(), "csls_r.f32": own["csls"].tobytes()}
    want["cell_offsets.u32"] = np.concatenate([[0], np.cumsum(np.bincount(own["cell"], minlength=CELLS))]).astype("<u4").tobytes()
    for s in SPACES:
        want[f"{s}.i8"], want[f"{s}.scale.f32"] = own[s].tobytes(), own[f"{s}_scale"].tobytes()
    return want


def frame(spark, own):
    """Rows under other numbers, in no order; 10 i is the i-th of its cell's order."""
    data = [(int(i) * 10, int(own["cell"][i]), float(own["latlon"][i, 0]), float(own["latlon"][i, 1]), own["csls"][i].astype(float).tolist(), *(x for s in SPACES for x in (own[s][i].tolist(), float(own[f"{s}_scale"][i])))) for i in np.random.default_rng(1).permutation(len(own["row"]))]
    return spark.createDataFrame(data, "row long, cell int, lat double, lon double, csls array<double>, " + ", ".join(f"{s} array<tinyint>, {s}_scale double" for s in SPACES)).repartition(5)


def contents(path):
    return {f.name: f.read_bytes() for f in path.iterdir()} if path.exists() else {}


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(flatindex, "ROWS_OF_TASK", 64)


def test_to_the_byte_and_back(spark, tmp_path, small_tasks):
    own = rows()
    at = flatindex.write_flat_index(frame(spark, own), f"{tmp_path}/flat", SPACES, CELLS)
    assert {r.row: r["at"] for r in at.collect()} == {10 * i: i for i in range(N)}
    assert contents(tmp_path / "flat") == bytes_of(own)
    index = flatindex.FlatIndex(spark, f"{tmp_path}/flat")
    assert index.spaces == SPACES and index.widths == {"cls": DIM, "geo": DIM, "csls": 3}
    back = index.read()
    assert back.columns == flatindex.columns_of(SPACES) and back.rdd.getNumPartitions() >= 1
    flatindex.write_flat_index(back, f"{tmp_path}/again", SPACES, CELLS)
    assert contents(tmp_path / "again") == bytes_of(own)


def test_tasks_read_ranges_of_rows(spark, tmp_path):
    own = rows()
    (tmp_path / "flat").mkdir()
    for name, data in bytes_of(own).items():
        (tmp_path / "flat" / name).write_bytes(data)
    widths = {"cls": DIM, "geo": DIM, "csls": 3}
    got = flatindex.read_index(spark, f"file://{tmp_path}/flat", widths, ["lon", "row", "cls"], rows_of_task=300)
    assert got.rdd.getNumPartitions() == 4
    found = got.orderBy("row").toPandas()
    assert found.row.tolist() == list(range(N)) and np.array_equal(np.stack(found.cls), own["cls"]) and np.array_equal(found.lon.to_numpy(), own["latlon"][:, 1].astype(float))
    # files of other columns are not opened
    (tmp_path / "flat/geo.i8").unlink()
    assert got.count() == N
    with pytest.raises(Exception, match="geo.i8"):
        flatindex.read_index(spark, f"{tmp_path}/flat", widths, ["geo"]).count()


def test_cells_are_ranges(spark, tmp_path):
    own = rows()
    flatindex.write_flat_index(frame(spark, own), f"{tmp_path}/flat", SPACES, CELLS)
    index = flatindex.FlatIndex(spark, f"{tmp_path}/flat")
    for cells in ([3], [0, 1, 7, CELLS - 1, CELLS, -1], []):
        got = sorted(r.row for r in index.read(["row", "cell"], cells).collect())
        assert got == np.flatnonzero(np.isin(own["cell"], cells)).tolist()
    gated = spark.createDataFrame([(1, 3, 0.5), (2, 5, 0.5)], "qid int, cell int, p double")
    assert {r.cell for r in index.in_cells(gated).select("cell").distinct().collect()} == {3, 5}
    assert {r.cell: r.n for r in index.sizes().collect()} == {int(c): int(n) for c, n in zip(*np.unique(own["cell"], return_counts=True))}


def test_files_that_disagree_are_refused(spark, tmp_path):
    own = rows()
    flatindex.write_flat_index(frame(spark, own), f"{tmp_path}/flat", SPACES, CELLS)
    widths = {"cls": DIM, "geo": DIM, "csls": 3}
    for name, cut in (("cls.i8", DIM), ("cls.i8", 1), ("cls.scale.f32", 4), ("latlon.f32", 8), ("csls_r.f32", 12)):
        file = tmp_path / "flat" / name
        data = file.read_bytes()
        file.write_bytes(data[:-cut])
        with pytest.raises(Exception, match=name):
            flatindex.read_index(spark, f"{tmp_path}/flat", widths, flatindex.columns_of(SPACES)).count()
        file.write_bytes(data)
    assert flatindex.read_index(spark, f"{tmp_path}/flat", widths, flatindex.columns_of(SPACES)).count() == N


def test_a_task_that_fails_leaves_no_file(spark, tmp_path, small_tasks):
    own = rows()
    odd = frame(spark, own).withColumn("cls", F.when(F.col("row") == 5000, F.array(F.lit(1).cast("tinyint"))).otherwise(F.col("cls")))
    with pytest.raises(Exception, match="rows of other than"):
        flatindex.write_flat_index(odd, f"{tmp_path}/flat", SPACES, CELLS)
    assert contents(tmp_path / "flat") == {}
    good = frame(spark, own)
    flatindex.write_flat_index(good, f"{tmp_path}/flat", SPACES, CELLS)
    with pytest.raises(Exception, match="rows of other than"):
        flatindex.write_flat_index(odd, f"{tmp_path}/flat", SPACES, CELLS)
    assert contents(tmp_path / "flat") == bytes_of(own)  # what was there stays


def test_what_the_format_cannot_hold(spark, tmp_path):
    good = frame(spark, rows(20))
    with pytest.raises(ValueError, match="cells"):
        flatindex.write_flat_index(good, f"{tmp_path}/flat", SPACES, 1 << 17)
    with pytest.raises(ValueError, match="not a flat index"):
        flatindex.write_flat_index(good.withColumn("cell", F.lit(CELLS)), f"{tmp_path}/flat", SPACES, CELLS)
    with pytest.raises(ValueError, match="local or mounted"):
        flatindex.write_flat_index(good, "s3://bucket/flat", SPACES, CELLS)
    assert not flatindex.is_flat(f"{tmp_path}/flat") and not flatindex.is_flat("viewfs://store/x")


def test_an_empty_index(spark, tmp_path):
    flatindex.write_flat_index(frame(spark, rows(3)).limit(0), f"{tmp_path}/flat", SPACES, CELLS)
    assert {n: len(x) for n, x in contents(tmp_path / "flat").items()}["cell_offsets.u32"] == 4 * (CELLS + 1)
    assert flatindex.FlatIndex(spark, f"{tmp_path}/flat").read(["row", "cell"]).count() == 0


def test_rows_of_another_table_are_not_answered_from_the_old_index(spark, tmp_path):
    """The index and the search of a session are made anew when their table is another."""
    from waymark.plans import fixture as X

    def put(n, sf):
        import shutil

        old = tmp_path / "embeddings.parquet"
        if old.exists():
            old.unlink()
        table = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").slice(0, n)
        pq.write_table(table, old)
        shutil.copystat(f"/root/testdata/{sf}/embeddings.parquet", old)

    counts = []
    for n in (200, 300):
        put(n, "sf0.001")
        counts.append((X.places(spark, str(tmp_path)).count(), X.best(spark, str(tmp_path))[0].select("qid").distinct().count()))
    put(300, "sf0.001")
    first = X.place_index(spark, str(tmp_path)).places
    assert first.inputFiles() == X.place_index(spark, str(tmp_path)).places.inputFiles()
    assert counts[0][0] < counts[1][0] and counts[0][1] < counts[1][1]

"""Headers of images written by hand; turns, thinning and scaling against loops."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import orient

SOI, EOI = b"\xff\xd8", b"\xff\xd9"


def segment(marker, content):
    return bytes([0xFF, marker]) + struct.pack(">H", len(content) + 2) + content


def tags(order, value, kind=3, tag=0x0112, before=0):
    first = struct.pack(order + "HHI4s", 0x010F, 2, 4, b"abc\0") * before
    own = struct.pack(order + "HHI", tag, kind, 1) + struct.pack(order + ("HH" if kind == 3 else "I"), *((value, 0) if kind == 3 else (value,)))
    return b"Exif\0\0" + (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", before + 1) + first + own


def frame(w, h, marker=0xC0):
    return segment(marker, struct.pack(">BHHB", 8, h, w, 3) + b"\1\x22\0" * 3)


@pytest.mark.parametrize("order", ["<", ">"])
def test_headers_of_both_byte_orders(order):
    for value in range(1, 9):
        for before, kind in ((0, 3), (3, 3), (1, 4)):
            data = SOI + segment(0xE0, b"JFIF\0") + segment(0xE1, tags(order, value, kind, before=before)) + segment(0xC4, b"\0" * 30) + frame(640, 480, 0xC2) + segment(0xDA, b"\0") + b"\xff\xc0 noise"
            assert orient.header(data) == (640, 480, value)
    for wrong in (0, 9, 65535):
        assert orient.header(SOI + segment(0xE1, tags(order, wrong)) + frame(3, 2)) == (3, 2, 1)
    assert orient.header(SOI + segment(0xE1, tags(order, 6, tag=0x0113)) + frame(3, 2)) == (3, 2, 1)


def test_damaged_headers():
    whole = SOI + b"\xff\xff\xff" + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0") + segment(0xE1, tags(">", 8, before=2)) + b"\xff\xd0" + frame(70, 50) + EOI
    assert orient.header(whole) == (70, 50, 8)
    for n in range(len(whole)):
        w, h, o = orient.header(whole[:n])
        assert (w, h) in ((None, None), (70, 50)) and o in (1, 8)
    rng = np.random.default_rng(0)
    for _ in range(3000):
        bad = bytearray(whole)
        for i in rng.integers(0, len(whole), 3):
            bad[i] = int(rng.integers(0, 256))
        assert 1 <= orient.header(bytes(bad))[2] <= 8
    assert orient.header(None) == orient.header(b"") == orient.header(b"PNG") == (None, None, 1)
    endless = b"Exif\0\0II*\0" + struct.pack("<I", 2**32 - 1)
    assert orient.header(SOI + segment(0xE1, endless) + frame(3, 2)) == (3, 2, 1)


def test_headers_of_a_folder(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(SOI + segment(0xE1, tags("<", 6)) + frame(4000, 3000) + EOI)
    (tmp_path / "b.jpg").write_bytes(b"no image")
    from waymark.operators.images import read_images

    got = orient.headers(read_images(spark, str(tmp_path))).select("width", "height", "orientation", orient.thinning(F.col("width"), F.col("height")).alias("s")).collect()
    assert [tuple(r) for r in got][0] == (4000, 3000, 6, 4) and tuple(got[1])[:3] == (None, None, 1)


def test_sizes_are_what_loops_say(spark):
    sides = [(w, h, o) for w in (1, 2, 511, 512, 513, 1023, 1024, 1025, 2047, 2048, 5000) for h in (1, 384, 700, 4096) for o in (1, 3, 6, 8, 5)]
    rows = spark.createDataFrame(sides, "w int, h int, o int")
    for r in rows.select("*", orient.thinning(F.col("w"), F.col("h")).alias("s"), orient.final_size(F.col("w"), F.col("h"), F.col("o")).alias("to")).collect():
        s = 1
        while max(r.w, r.h) // (s * 2) >= 512:
            s *= 2
        w, h = -(-r.w // s), -(-r.h // s)
        if r.o in (6, 8):
            w, h = h, w
        if max(w, h) > 512:
            f = np.float32(512) / np.float32(max(w, h))
            w, h = int(np.floor(np.float32(w) * f + np.float32(0.5))), int(np.floor(np.float32(h) * f + np.float32(0.5)))
        assert (r.s, r.to.width, r.to.height) == (s, w, h), r


def table(images):
    return [(k, y, x, c, int(a[y, x, c])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1]) for c in range(a.shape[2])]


def arrays(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.image, {})[(r.y, r.x, r.c)] = r.value
    return {k: {p: v for p, v in sorted(d.items())} for k, d in out.items()}


PIXELS, SIZES = "image int, y int, x int, c int, value int", "image int, width int, height int, orientation int"
#: How numpy mends each orientation.
MENDED = {1: lambda a: a, 2: np.fliplr, 3: lambda a: np.rot90(a, 2), 4: np.flipud, 5: lambda a: a.transpose(1, 0, 2), 6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(a, 2).transpose(1, 0, 2), 8: np.rot90}


@pytest.mark.parametrize("mirrors", [False, True])
def test_orientations(spark, mirrors):
    rng = np.random.default_rng(1)
    images = {k: rng.integers(0, 256, (3, 5, 2)) for k in range(1, 9)}
    sizes = spark.createDataFrame([(k, 5, 3, k) for k in images], SIZES)
    got = arrays(orient.upright(spark.createDataFrame(table(images), PIXELS), sizes, mirrors))
    for k, a in images.items():
        want = MENDED[k](a) if mirrors or k in orient.TURNS else a
        assert got[k] == {p[1:4]: p[4] for p in table({k: want})}, k


def test_prepared_is_what_loops_say(spark):
    rng = np.random.default_rng(2)
    images = {1: rng.integers(0, 256, (7, 11, 1)), 2: rng.integers(0, 256, (20, 9, 1)), 3: rng.integers(0, 256, (4, 6, 1)), 4: rng.integers(0, 256, (3, 15, 1))}
    turned = {1: 6, 2: 8, 3: 3, 4: 1}
    sizes = spark.createDataFrame([(k, a.shape[1], a.shape[0], turned[k]) for k, a in images.items()], SIZES)
    side = 8
    got = arrays(orient.prepared(spark.createDataFrame(table(images), PIXELS), sizes, side))
    for k, a in images.items():
        s = 1
        while max(a.shape) // (s * 2) >= side:
            s *= 2
        blocks = [[int(np.floor(a[y : y + s, x : x + s, 0].mean() + 0.5)) for x in range(0, a.shape[1], s)] for y in range(0, a.shape[0], s)]
        b = MENDED[turned[k]](np.array(blocks)[:, :, None])[:, :, 0].astype(float)
        if max(b.shape) > side:
            f = side / max(b.shape)
            h, w = (int(np.floor(n * f + 0.5)) for n in b.shape)

            def line(v, to):
                out = []
                for t in range(to):
                    at = min(max((t + 0.5) * len(v) / to - 0.5, 0), len(v) - 1)
                    i = int(at)
                    out.append(v[i] * (1 - (at - i)) + (v[i + 1] * (at - i) if i + 1 < len(v) else 0))
                return out

            b = np.array([line(r, w) for r in b])
            b = np.floor(np.round(np.array([line(c, h) for c in b.T]).T, 6) + 0.5)
        assert got[k] == {(y, x, 0): int(v) for (y, x), v in np.ndenumerate(b)}, k


def test_nothing_and_unknown(spark):
    none = spark.createDataFrame([], PIXELS)
    sizes = spark.createDataFrame([(1, 2, 1, None), (2, 2, 1, 77)], SIZES)
    assert orient.prepared(none, sizes).count() == 0
    given = [(k, 0, x, 0, 10 * x) for k in (1, 2) for x in (0, 1)]
    assert sorted(tuple(r) for r in orient.prepared(spark.createDataFrame(given, PIXELS), sizes).collect()) == given

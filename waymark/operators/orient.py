"""Images the right way up and no larger than an encoder needs: what their headers say,
and pixel tables turned, thinned and scaled. No pictures are decoded here."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats: start of the file, of its scan and its end; frames; the block of
#: tags and its orientation; the longest side of an image.
START, SCAN, END, TAGS, NO_FRAMES, ALONE = 0xD8, 0xDA, 0xD9, 0xE1, (0xC4, 0xC8, 0xCC), (0x01, *range(0xD0, 0xD8))
ORIENTATION, SHORT, LONG, SIDE = 0x0112, 3, 4, 512
#: Orientations that a plain turn mends: by a half, to the right, to the left.
TURNS = (3, 6, 8)


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, content) of a JPEG file up to its scan; ends early where it is damaged."""
    if data[:2] != bytes([0xFF, START]):
        return
    at = 2
    while at + 1 < len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # a filling byte
            at += 1
        elif marker in ALONE:
            at += 2
        elif marker in (SCAN, END) or at + 4 > len(data):
            return
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if size < 2 or at + 2 + size > len(data):
                return
            yield marker, data[at + 4 : at + 2 + size]
            at += 2 + size


def tagged_orientation(block: bytes) -> int | None:
    """1 to 8, of a block of tags in either byte order; None without a valid one."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(block[6:10])
    if block[:6] != b"Exif\0\0" or order is None:
        return None
    tags = block[6:]
    try:
        (at,) = struct.unpack_from(f"{order}I", tags, 4)
        (n,) = struct.unpack_from(f"{order}H", tags, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", tags, at + 2 + 12 * i)
            if tag == ORIENTATION and kind in (SHORT, LONG) and count == 1:
                (value,) = struct.unpack_from(order + ("H" if kind == SHORT else "I"), tags, at + 10 + 12 * i)
                return value if 1 <= value <= 8 else None
    except struct.error:  # the block ends before its tags do
        pass
    return None


def header(data: bytes | None) -> tuple[int | None, int | None, int]:
    """(width, height, orientation) of a JPEG file: sizes are None where no frame is
    found, the orientation is 1 where none is stated."""
    width = height = turned = None
    for marker, content in segments(data or b""):
        if marker == TAGS and turned is None:
            turned = tagged_orientation(content)
        elif 0xC0 <= marker <= 0xCF and marker not in NO_FRAMES and width is None and len(content) >= 5:
            height, width = struct.unpack_from(">HH", content, 1)
    return width, height, turned or 1


def headers(files: DataFrame) -> DataFrame:
    """(path, width, height, orientation) of files (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.int32()) for i in range(3))], ["path", "width", "height", "orientation"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(read, "path string, width int, height int, orientation int")


def thinning(width: Column, height: Column, side: int = SIDE) -> Column:
    """The largest power of two by which the longer side can be divided and still be of
    at least the given size; 1 if none."""
    times = F.floor(F.greatest(width, height) / side).cast("long")
    return F.when(times < 1, 1).otherwise(F.pow(F.lit(2.0), F.length(F.bin(times)) - 1).cast("int"))


def swaps(orientation: Column, mirrors: bool = False) -> Column:
    """Whether rows become columns."""
    return F.coalesce(orientation.isin([5, 6, 7, 8] if mirrors else [6, 8]), F.lit(False))


def final_size(width: Column, height: Column, orientation: Column, side: int = SIDE, mirrors: bool = False) -> Column:
    """Struct (width, height) of an image that is thinned, turned and scaled to the side."""
    step = thinning(width, height, side)
    thin = [F.ceil(x / step).cast("int") for x in (width, height)]
    turn = swaps(orientation, mirrors)
    w, h = F.when(turn, thin[1]).otherwise(thin[0]), F.when(turn, thin[0]).otherwise(thin[1])
    factor = F.lit(float(side)).cast("float") / F.greatest(w, h).cast("float")
    scaled = lambda x: F.when(F.greatest(w, h) > side, F.floor((x.cast("float") * factor.cast("float")).cast("float") + 0.5)).otherwise(x).cast("int")
    return F.struct(scaled(w).alias("width"), scaled(h).alias("height"))


def turned_to(x: Column, y: Column, width: Column, height: Column, orientation: Column, mirrors: bool = False) -> Column:
    """Struct (x, y): where a pixel of an image of that size goes. Mirrored orientations
    (2, 4, 5, 7) stay as they are unless asked for, as do null and unknown ones."""
    right, down = width - 1 - x, height - 1 - y
    to = {1: (x, y), 2: (right, y), 3: (right, down), 4: (x, down), 5: (y, x), 6: (down, x), 7: (down, right), 8: (y, right)}
    at = F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    out = None
    for k, (a, b) in to.items():
        if k in TURNS or (mirrors and k > 1):
            here, value = orientation == k, F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"))
            out = F.when(here, value) if out is None else out.when(here, value)
    return out.otherwise(at)


def upright(pixels: DataFrame, sizes: DataFrame, mirrors: bool = False) -> DataFrame:
    """pixels (image, y, x, c, value) the right way up, by sizes (image, width, height,
    orientation), a row for each image."""
    at = turned_to(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("orientation"), mirrors)
    rows = pixels.select("image", "y", "x", "c", "value").join(sizes.select("image", "width", "height", "orientation"), "image")
    return rows.withColumn("at", at).select("image", F.col("at.y").alias("y"), F.col("at.x").alias("x"), "c", "value")


def thinned(pixels: DataFrame, sizes: DataFrame, side: int = SIDE) -> DataFrame:
    """pixels as means of blocks of thinning() by thinning(), to whole bytes, halves up."""
    step = thinning(F.col("width"), F.col("height"), side)
    rows = pixels.select("image", "y", "x", "c", "value").join(sizes.select("image", step.alias("step")), "image")
    keys = ["image", *(F.floor(F.col(n) / F.col("step")).cast("int").alias(n) for n in ("y", "x")), "c"]
    return rows.groupBy(*keys).agg(F.floor(F.avg("value") + 0.5).cast("int").alias("value"))


def scaled(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """pixels of images whose longer side is beyond the side, scaled to it: each new pixel is
    between the nearest two of its row, then of its column, to whole bytes after both."""
    sizes = pixels.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    sizes = sizes.select("*", final_size(F.col("width"), F.col("height"), F.lit(1), side).alias("to"), (F.greatest("width", "height") > side).alias("large"))
    rows = pixels.join(sizes, "image")

    def along(rows: DataFrame, axis: str, n: str) -> DataFrame:
        size, to = F.col(n), F.col(f"to.{n}")
        ratio = size / to
        place = lambda t: F.least(F.greatest((t + 0.5) * ratio - 0.5, F.lit(0.0)), (size - 1).cast("double"))
        near = lambda v: F.least(F.greatest(F.floor(v).cast("int"), F.lit(0)), to - 1)
        first, last = near((F.col(axis) - 0.5) / ratio - 0.5), near((F.col(axis) + 1.5) / ratio + 0.5)
        shares = F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("t"), (1 - F.abs(place(t) - F.col(axis))).alias("w")))
        parts = rows.withColumn("part", F.explode(F.filter(shares, lambda s: s["w"] > 0)))
        keys = [k for k in ("image", "y", "x", "c") if k != axis]
        sums = parts.groupBy(*keys, F.col("part.t").alias(axis)).agg(F.sum(F.col("value") * F.col("part.w")).alias("value"), F.first("width").alias("width"), F.first("height").alias("height"), F.first("to").alias("to"))
        return sums

    large = along(along(rows.where("large"), "x", "width"), "y", "height")
    whole = large.select("image", "y", "x", "c", F.floor(F.round("value", 6) + 0.5).cast("int").alias("value"))
    return rows.where(~F.col("large")).select("image", "y", "x", "c", F.col("value").cast("int").alias("value")).unionByName(whole)


def prepared(pixels: DataFrame, sizes: DataFrame, side: int = SIDE, mirrors: bool = False) -> DataFrame:
    """pixels (image, y, x, c, value) as an encoder takes them, by sizes (image, width, height,
    orientation) of the files: thinned, the right way up, no longer than the side."""
    step = thinning(F.col("width"), F.col("height"), side)
    thin = sizes.select("image", F.ceil(F.col("width") / step).cast("int").alias("width"), F.ceil(F.col("height") / step).cast("int").alias("height"), "orientation")
    return scaled(upright(thinned(pixels, sizes, side), thin, mirrors), side)

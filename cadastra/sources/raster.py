"""GeoTIFF files as rows of pixels: tiles or strips of one band, uncompressed or deflated."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Of a TIFF's field types the struct code and size in bytes.
_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
#: Tags: width, height, compression, offsets, sizes, rows per strip, predictor, tile width and height, sample format and bits.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, SAMPLES, SCALE, TIE = 322, 323, 324, 325, 339, 33550, 33922


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the values of the first image's tags; classic and big TIFF."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    out = {}
    for _ in range(count):
        tag, kind = struct.unpack_from(order + "HH", data, at)
        n = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
        place = at + (12 if big else 8)
        at += 20 if big else 12
        if kind in _TYPES:
            code, size = _TYPES[kind]
            if size * n > (8 if big else 4):
                place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
            out[tag] = struct.unpack_from(order + code * n, data, place)
    return order, out


def blocks(data: bytes, box: tuple[float, float, float, float] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lon, lat, value) of the pixels of each tile or strip that touches a box (west, south, east, north);
    others aren't decoded. Coordinates are of pixels' centres."""
    order, t = tags(data)
    width, height = t[WIDTH][0], t[HEIGHT][0]
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[t.get(SAMPLES, (1,))[0]] }{t[BITS][0] // 8}")
    (dx, dy), (x0, y0) = t[SCALE][:2], t[TIE][3:5]
    tiled = TILES in t
    bw, bh = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(t.get(ROWS, (height,))[0], height))
    places, sizes = (t[TILES], t[TILE_SIZES]) if tiled else (t[STRIPS], t[STRIP_SIZES])
    across = -(-width // bw)
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        top, left = k // across * bh, k % across * bw
        bottom, right = min(top + bh, height), min(left + bw, width)
        if box and (x0 + left * dx > box[2] or x0 + right * dx < box[0] or y0 - top * dy < box[1] or y0 - bottom * dy > box[3]):
            continue
        raw = data[place : place + size]
        compression = t.get(COMPRESSION, (1,))[0]
        if compression in (8, 32946):
            raw = zlib.decompress(raw)
        elif compression != 1:
            raise ValueError(f"compression {compression} is not known")
        rows = bh if tiled else bottom - top
        block = np.frombuffer(raw, kind, rows * bw).reshape(rows, bw)
        if t.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        elif t.get(PREDICTOR, (1,))[0] != 1:
            raise ValueError("this predictor is not known")
        block = block[: bottom - top, : right - left].astype(np.float64)
        lats = y0 - (np.arange(top, bottom) + 0.5) * dy
        lons = x0 + (np.arange(left, right) + 0.5) * dx
        yield np.tile(lons, len(lats)), np.repeat(lats, len(lons)), block.ravel()


def read_pixels(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, positive: bool = True) -> DataFrame:
    """lon, lat, value of GeoTIFF files, a task for each file and a batch of rows for each tile; pixels
    outside a box, and with ``positive`` those that aren't over 0, are left out. What ``grid_sum`` and
    ``zonal_sum`` take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                for lon, lat, value in blocks(data, box):
                    keep = np.isfinite(value) & (value > 0) if positive else np.ones(len(value), bool)
                    if box:
                        keep &= (lon >= box[0]) & (lon <= box[2]) & (lat >= box[1]) & (lat <= box[3])
                    yield pa.record_batch([pa.array(x[keep]) for x in (lon, lat, value)], ["lon", "lat", "value"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "lon double, lat double, value double")

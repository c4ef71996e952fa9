"""Media columns: texts as AVI files of motion JPEG, read back and cut into timed clips.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become 8x8 blocks of
quantised DCT coefficients, the unit that JPEG stores without loss: each byte is the 8 extra bits
of a coefficient of category 8. The Huffman tables have that one symbol, with a code of one bit,
so a block is 576 bits; a restart marker after every block keeps DC values apart. Reading
goes through the RIFF index and the JPEG segments. Frames are decoded to 32 x 32 grey pixels; a
shot begins where the histogram changes by more than an adaptive threshold.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import each, in_arrow, pick, table

SIDE = 32
BLOCKS = (SIDE // 8) ** 2
MS = 40  # a frame's time
BINS = 16
WINDOW, SPREAD, FLOOR = 8, 2.0, 0.05


def _zigzag() -> list[int]:
    """Raster place of each coefficient in JPEG's order: diagonals, by turns up and down."""
    at = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return [8 * r + c for r, c in at]


ZIGZAG = _zigzag()
_COS = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
#: From 64 coefficients in JPEG's order to 64 pixels: the inverse DCT of both directions.
INVERSE = np.kron(_COS, _COS)[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


ONE_SYMBOL = bytes([1, *[0] * 15, 8])
JPEG_HEAD = (
    b"\xff\xd8"
    + _segment(0xE0, b"AVI1" + bytes(10))
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + ONE_SYMBOL + b"\x10" + ONE_SYMBOL)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
RESTARTS = [bytes([0xFF, 0xD0 + i % 8]) for i in range(BLOCKS)]


def _jpeg(coded: bytes) -> bytes:
    """A frame of blocks of 72 bytes."""
    parts = [JPEG_HEAD]
    for i in range(BLOCKS):
        parts.append(coded[72 * i : 72 * i + 72].replace(b"\xff", b"\xff\x00"))
        parts.append(RESTARTS[i])
    parts[-1] = b"\xff\xd9"
    return b"".join(parts)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


#: Frames that are made or decoded at once, so that long texts take little more than their files.
AT_ONCE = 256


def _coded(payload: memoryview) -> Iterator[bytes]:
    """The JPEG frames of a payload, some at a time."""
    step = AT_ONCE * BLOCKS * 64
    for at in range(0, len(payload), step):
        part = bytes(payload[at : at + step])
        n = -(-len(part) // (64 * BLOCKS))
        bits = np.zeros((n * BLOCKS * 64, 9), np.uint8)
        bits[: len(part), 1:] = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 1), axis=1)
        coded = np.packbits(bits.reshape(-1)).tobytes()
        for i in range(n):
            yield _jpeg(coded[i * 72 * BLOCKS : (i + 1) * 72 * BLOCKS])


def write_avi(payload: bytes) -> bytes:
    """An AVI file that holds ``payload``, whose length is a multiple of 64."""
    chunks, sizes = [], []
    for f in _coded(memoryview(payload)):
        chunks.append(_chunk(b"00dc", f))
        sizes.append(len(f))
    n, largest = len(sizes), max(sizes)
    index, at = [], 4
    for chunk, size in zip(chunks, sizes, strict=True):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, size))
        at += len(chunk)
    main = struct.pack("<14I", MS * 1000, 0, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, MS, 1000, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    stream = _chunk(b"LIST", b"strl" + _chunk(b"strh", head) + _chunk(b"strf", form))
    about = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload bytes %d" % len(payload)))
    before = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + stream) + about
    before += b"LIST" + struct.pack("<I", at) + b"movi"
    after = _chunk(b"idx1", b"".join(index))
    whole = len(before) + at - 4 + len(after)
    return b"".join([b"RIFF", struct.pack("<I", whole), before, *chunks, after])


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def read_index(data: bytes) -> tuple[list[tuple[int, int]], int, float]:
    """(place, size) of JPEG frames by the file's index, its payload length and milliseconds per frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, frames, length, ms = 0, [], -1, float(MS)
    for name, at, size in _chunks(data, 12, len(data)):
        kind = data[at : at + 4] if name == b"LIST" else b""
        if kind == b"movi":
            movi = at
        elif kind == b"hdrl":
            ms = next((struct.unpack_from("<I", data, a)[0] / 1000 for c, a, _ in _chunks(data, at + 4, at + size) if c == b"avih"), ms)
        elif kind == b"INFO":
            for c, a, s in _chunks(data, at + 4, at + size):
                if c == b"ICMT" and (m := re.fullmatch(rb"payload bytes (\d+)", data[a : a + s])):
                    length = int(m[1])
        elif name == b"idx1":
            for k in range(size // 16):
                _, _, offset, n = struct.unpack_from("<4sIII", data, at + 16 * k)
                frames.append((movi + offset + 8, n))
    return frames, length, ms


def read_frames(data: bytes) -> tuple[list[bytes], int, float]:
    frames, length, ms = read_index(data)
    return [data[at : at + n] for at, n in frames], length, ms


def _huffman(table: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    out, code, at = {}, 0, 16
    for length, n in enumerate(table[:16], 1):
        for _ in range(n):
            out[length, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _blocks_by_bits(parts: list[bytes], dc: bytes, ac: bytes) -> np.ndarray:
    """Coefficients by any Huffman tables, bit by bit; each part starts DC prediction anew."""
    tables, rows = (_huffman(dc), _huffman(ac)), []
    for part in parts:
        bits, at, before = "".join(f"{b:08b}" for b in part), 0, 0

        def symbol(table: dict) -> int:
            nonlocal at
            for n in range(1, 17):
                if at + n <= len(bits) and (s := table.get((n, int(bits[at : at + n], 2)))) is not None:
                    at += n
                    return s
            return -1

        def extra(size: int) -> int:
            nonlocal at
            x = int(bits[at : at + size] or "0", 2)
            at += size
            return x if size == 0 or x >> (size - 1) else x - (1 << size) + 1

        while (s := symbol(tables[0])) >= 0:
            row, k = np.zeros(64, np.int16), 1
            before += extra(s)
            row[0] = before
            while k < 64 and (s := symbol(tables[1])) > 0:
                k += s >> 4
                if s & 15 and k < 64:
                    row[k] = extra(s & 15)
                k += 1
            rows.append(row)
    return np.array(rows, np.int16).reshape(-1, 64)


def read_jpeg(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (blocks x 64, in JPEG's order) and quantiser steps of a grey baseline frame."""
    at, tables, steps = 2, {}, np.ones(64, np.float32)
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            steps = np.frombuffer(body[1:65], np.uint8).astype(np.float32)
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDA:
            break
    parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", data[at : data.rindex(b"\xff\xd9")])]
    if tables[0] == tables[16] == ONE_SYMBOL and all(len(p) == 72 for p in parts):
        bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8)).reshape(-1, 9)
        if bits[:, 0].any():
            raise ValueError("a code that the table doesn't have")
        extra = np.packbits(bits[:, 1:]).astype(np.int16)
        return np.where(extra < 128, extra - 255, extra).reshape(-1, 64), steps
    return _blocks_by_bits(parts, tables[0], tables[16]), steps


def payload_of(coefficients: np.ndarray) -> bytes:
    return np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).tobytes()


def histograms(coefficients: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Grey-level histogram (BINS) of each frame: frames x blocks x 64 coefficients."""
    frames = coefficients.reshape(-1, BLOCKS, 64)
    pixels = (frames.reshape(-1, 64).astype(np.float32) * steps) @ INVERSE + 128
    level = (np.clip(np.rint(pixels), 0, 255).astype(np.int64) * BINS // 256).reshape(len(frames), -1)
    flat = level + BINS * np.arange(len(frames))[:, None]
    return np.bincount(flat.ravel(), minlength=BINS * len(frames)).reshape(-1, BINS)


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) frames of each shot. A cut is a histogram difference over the mean and SPREAD
    deviations of up to WINDOW differences before it, and over FLOOR."""
    total = hist.sum(axis=1).max() if len(hist) else 1
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * total)
    cuts = [0]
    for i, d in enumerate(diff.tolist()):
        seen = diff[max(0, i - WINDOW) : i]
        if d > max(FLOOR, float(seen.mean() + SPREAD * seen.std()) if len(seen) else 4 * FLOOR):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(hist)], strict=True))


def encode(text: bytes) -> bytes:
    return write_avi(text.ljust(max(64, -(-len(text) // 64) * 64), b"\x00"))


def describe(data: bytes) -> dict:
    """Payload, clips in milliseconds and the summed histogram of an AVI file that ``encode`` made."""
    frames, length, ms = read_index(data)
    hists, parts = [], []
    for k in range(0, len(frames), AT_ONCE):
        got = [read_jpeg(data[at : at + n]) for at, n in frames[k : k + AT_ONCE]]
        coefficients = np.concatenate([c for c, _ in got])
        hists.append(histograms(coefficients, got[0][1]))
        parts.append(payload_of(coefficients))
    hist = np.concatenate(hists)
    clips = [(round(a * ms), round(b * ms)) for a, b in shots(hist)]
    return {"payload": b"".join(parts)[:length], "frames": len(frames), "clips": clips, "hist": hist.sum(axis=0)}


SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, clips array<struct<start_ms:long,end_ms:long>>"
)


def _media(outputs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
        for batch in batches:
            for at in range(0, len(batch), 256):
                b = batch.slice(at, 256)
                rows = []
                for t in each(b.column("text"), 16):
                    avi = encode(t)
                    got = describe(avi)
                    p, clips = got["payload"], got["clips"]
                    feature = f"frames={got['frames']};shots={len(clips)};cuts={','.join(str(a) for a, _ in clips)};hist={','.join(map(str, got['hist']))}"
                    rows.append(
                        (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature,
                         [{"start_ms": x, "end_ms": y} for x, y in clips], avi if outputs else None)
                    )
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip, pa.binary()]
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "media"]
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                keep = len(names) if outputs else -1
                yield pa.record_batch([b.column("doc_id"), *cols[:keep]], ["doc_id", *names[:keep]])

    return run


def media_columns(docs: DataFrame, outputs: bool = False) -> DataFrame:
    """Sizes, digests, features and clips of every text of ``docs`` (doc_id, text) as an AVI file,
    all taken from the file as read back; with ``outputs`` also ``media``, the file.

    A null text counts as empty; an empty text is one block of zeros. Every row gives a row,
    equal texts equal values; other columns are ignored. A long text takes some six times its bytes.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}" + (", media binary" if outputs else "")
    return in_arrow(pick(docs, "doc_id", "text"), _media(outputs), schema)


def clip_rows(docs: DataFrame) -> DataFrame:
    """One row per shot: doc_id, clip (from 0), start_ms, end_ms."""
    got = media_columns(docs).select("doc_id", F.posexplode("clips").alias("clip", "at"))
    return got.select("doc_id", "clip", "at.start_ms", "at.end_ms")


def op10_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).drop("clips")


QUERIES = {"op10_media_avi": op10_media_avi}
ORACLES: dict = {}

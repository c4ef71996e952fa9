import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from cadastra.llm.media_avi import INVERSE, JPEG_HEAD, ONE_SYMBOL, ZIGZAG, _blocks_by_bits, clip_rows, describe, encode, histograms, media_columns, read_frames, read_jpeg, shots

RND = random.Random(1)
TEXTS = [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 9, b"\xff" * 5000, RND.randbytes(30_000)]


def padded(t):
    return t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    avi = encode(text)
    assert describe(avi)["payload"] == padded(text)
    assert avi[:4] == b"RIFF" and int.from_bytes(avi[4:8], "little") == len(avi) - 8


def test_fast_and_general_entropy_decoding_agree():
    frame = read_frames(encode(TEXTS[-1]))[0][3]
    parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", frame[len(JPEG_HEAD) : -2])]
    assert (_blocks_by_bits(parts, ONE_SYMBOL, ONE_SYMBOL) == read_jpeg(frame)[0]).all()


def test_zigzag_and_inverse_transform():
    assert ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(ZIGZAG) == list(range(64))
    flat = np.zeros(64)
    flat[0] = 80  # a DC coefficient is eight times the grey level
    assert np.allclose(flat @ INVERSE, 10)
    assert np.allclose(INVERSE @ INVERSE.T, np.eye(64), atol=1e-5)


def test_shots():
    still, other = np.array([900, 100]), np.array([100, 900])
    assert shots(np.array([still] * 6 + [other] * 4)) == [(0, 6), (6, 10)]
    assert shots(np.array([still])) == [(0, 1)]


def test_rows(docs):
    text = "some words " * 700
    got = media_columns(docs([(1, text), (2, None), (1, text)]), outputs=True).collect()
    one, two = [r for r in got if r.doc_id == 1]
    assert one == two and one.n_bytes == len(text) and one.media_bytes == len(one.media)
    assert one.payload_sha256 == hashlib.sha256(padded(text.encode())).hexdigest() and one.tail_crc32 == zlib.crc32(padded(text.encode())[-64:])
    null = next(r for r in got if r.doc_id == 2)
    assert (null.n_bytes, null.payload_bytes) == (0, 64)
    clips = clip_rows(docs([(1, text)])).collect()
    assert [c.clip for c in clips] == list(range(len(clips))) and clips[0].start_ms == 0 and clips[-1].end_ms == 40 * -(-len(padded(text.encode())) // 1024)
    assert media_columns(docs([])).count() == 0


def plain_index(data):
    """Chunks of an AVI file by walking all of them, without its index: frames in order."""
    def walk(at, end):
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"LIST":
                yield from walk(at + 12, at + 8 + size)
            else:
                yield name, data[at + 8 : at + 8 + size]
            at += 8 + size + size % 2

    return list(walk(12, len(data)))


@pytest.mark.parametrize("text", TEXTS)
def test_the_file_reads_alike_without_its_index(text):
    avi = encode(text)
    chunks = plain_index(avi)
    frames = [body for name, body in chunks if name == b"00dc"]
    assert frames == read_frames(avi)[0]
    main = next(body for name, body in chunks if name == b"avih")
    assert int.from_bytes(main[16:20], "little") == len(frames) and int.from_bytes(main[:4], "little") == 40_000


def plain_histogram(coefficients):
    """Grey levels of one frame by the sum that defines the inverse transform."""
    out = [0] * 16
    for block in coefficients:
        at = {ZIGZAG[k]: float(v) for k, v in enumerate(block) if v}
        for x in range(8):
            for y in range(8):
                total = 0.0
                for place, v in at.items():
                    r, c = divmod(place, 8)
                    scale = (0.5**0.5 if r == 0 else 1) * (0.5**0.5 if c == 0 else 1) / 4
                    total += scale * v * math.cos((2 * x + 1) * r * math.pi / 16) * math.cos((2 * y + 1) * c * math.pi / 16)
                out[min(255, max(0, round(total + 128))) * 16 // 256] += 1
    return out


def test_histogram_equals_the_definition():
    frame = read_frames(encode(b"Some words of a text, long enough for a block or two. " * 4))[0][0]
    coefficients, steps = read_jpeg(frame)
    got = histograms(coefficients, steps)[0].tolist()
    wanted = plain_histogram(coefficients.tolist())
    assert sum(got) == sum(wanted) == 1024 and sum(abs(a - b) for a, b in zip(got, wanted)) <= 4  # single precision at a border


def plain_shots(hist):
    total, cuts, diffs = max(map(sum, hist)), [0], []
    for i in range(1, len(hist)):
        d = sum(abs(a - b) for a, b in zip(hist[i], hist[i - 1])) / (2 * total)
        seen = diffs[-8:]
        limit = 0.2
        if seen:
            mean = sum(seen) / len(seen)
            limit = max(0.05, mean + 2 * (sum((x - mean) ** 2 for x in seen) / len(seen)) ** 0.5)
        if d > max(0.05, limit):
            cuts.append(i)
        diffs.append(d)
    return list(zip(cuts, [*cuts[1:], len(hist)]))


def test_shots_equal_the_definition():
    rnd = random.Random(6)
    for _ in range(100):
        base, hist = [rnd.randrange(100) for _ in range(16)], []
        for _ in range(rnd.randrange(1, 40)):
            if rnd.random() < 0.1:
                base = [rnd.randrange(100) for _ in range(16)]
            hist.append([x + rnd.randrange(4) for x in base])
        assert shots(np.array(hist)) == plain_shots(hist)


def test_long_texts_are_taken_some_frames_at_a_time():
    text = RND.randbytes(3_000_001)
    got = describe(encode(text))
    assert got["payload"] == padded(text) and got["frames"] == -(-len(padded(text)) // 1024) == got["clips"][-1][1] // 40


def test_clashing_columns_and_repeats(docs):
    df = docs([(1, "a"), (1, "a"), (None, "b")])
    for c in ("n_bytes", "media", "feature", "clips"):
        df = df.withColumn(c, df["doc_id"])
    assert sorted(r.n_bytes for r in media_columns(df).collect()) == [1, 1, 1]

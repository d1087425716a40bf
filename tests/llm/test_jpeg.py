"""The JPEG operator: round trips, and general baseline images from a small writer of known coefficients."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mediacat.llm import jpeg


def write_image(width, height, factors, restart=0, seed=0, separate=False):
    """A baseline image with random coefficients, codes of 8 bits each, and the DC coefficients of its first component."""
    rng = random.Random(seed)
    symbols = sorted({*range(9), *(run << 4 | size for run in range(16) for size in range(1, 7)), 0xF0})
    code = {s: i for i, s in enumerate(symbols)}
    bits = [0] * 7 + [len(symbols)] + [0] * 8
    wide, high = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    out = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JUNK" + b"\xff\xfe" + struct.pack(">H", 4) + b"hi"
    out += b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] + [1] * 63)
    frame = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + len(frame), 8, height, width, len(factors)) + frame
    for kind in (0x00, 0x10):
        out += b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), kind) + bytes(bits) + bytes(symbols)
    if restart:
        out += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    text, data = [], b""

    def put(value, n):
        text.append(format(value, f"0{n}b") if n else "")

    def number(v):
        n = abs(v).bit_length()
        return n, v if v > 0 else v + (1 << n) - 1

    def flush():
        nonlocal data
        joined = "".join(text)
        joined += "1" * (-len(joined) % 8)
        data += bytes(int(joined[i : i + 8], 2) for i in range(0, len(joined), 8)).replace(b"\xff", b"\xff\x00")
        text.clear()

    grid = np.zeros((down * factors[0][1], across * factors[0][0]), int)
    before = [0] * len(factors)
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            flush()
            data += bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            before = [0] * len(factors)
        for c, (h, v) in enumerate(factors):
            for y in range(v):
                for x in range(h):
                    dc = rng.randrange(-100, 100)
                    if c == 0:
                        grid[unit // across * v + y, unit % across * h + x] = dc
                    n, extra = number(dc - before[c])
                    before[c] = dc
                    put(code[n], 8)
                    put(extra, n)
                    k = 1
                    while k < 64 and rng.random() < 0.6:
                        if rng.random() < 0.1 and k + 16 < 63:
                            put(code[0xF0], 8)
                            k += 16
                        run = rng.randrange(0, min(15, 63 - k) + 1)
                        n, extra = number(rng.choice([-1, 1]) * rng.randrange(1, 63))
                        put(code[run << 4 | n], 8)
                        put(extra, n)
                        k += run + 1
                    if k < 64:
                        raise_end = code.get(0)
                        put(raise_end, 8)
    flush()
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(factors), len(factors)) + b"".join(bytes([i + 1, 0]) for i in range(len(factors))) + bytes([0, 63, 0]) + data + b"\xff\xd9"
    rows = -(-(-(-height * factors[0][1] // high)) // 8)
    cols = -(-(-(-width * factors[0][0] // wide)) // 8)
    return out, grid[:rows, :cols]


@pytest.mark.parametrize(("size", "factors", "restart"), [((40, 24), [(1, 1)], 0), ((33, 17), [(1, 1)] * 3, 0), ((50, 70), [(2, 2), (1, 1), (1, 1)], 0), ((64, 48), [(2, 1), (1, 1), (1, 1)], 3), ((1, 1), [(2, 2), (1, 1), (1, 1)], 0), ((100, 9), [(1, 1)], 2)])
def test_general_images(size, factors, restart):
    data, want = write_image(*size, factors, restart, seed=sum(size))
    frame, end = jpeg.parse(data, 0)
    assert end == len(data) and (frame.width, frame.height) == size
    dc = jpeg.decode_dc([frame])[0]
    assert np.array_equal(dc, want)
    assert np.array_equal(jpeg.thumbnail(frame, dc), np.clip(want + 128, 0, 255))


def test_images_of_one_table_together():
    made = [write_image(8 * n, 16, [(1, 1)], restart, seed=n) for n, restart in ((1, 0), (5, 2), (9, 0))]
    got = jpeg.decode_dc([jpeg.parse(d, 0)[0] for d, _ in made])
    assert all(np.array_equal(a, b) for a, (_, b) in zip(got, made, strict=True))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=1500), min_size=1, max_size=4))
def test_round_trip(texts):
    payloads = [jpeg.padded(t) for t in texts]
    assert all(len(p) % 576 == 0 and len(p) >= 576 and p.startswith(t) for p, t in zip(payloads, texts, strict=True))
    assert [p for p, _ in jpeg.read_back([jpeg.store(p) for p in payloads])] == payloads


def test_long_payload_is_several_images():
    payload = jpeg.padded(bytes(range(256)) * 1700)
    stored = jpeg.store(payload)
    assert len(jpeg.frames_of(stored)) == 3 and jpeg.read_back([stored])[0][0] == payload


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", b"GIF89a", b"\xff\xd8\xff\xc2\x00\x04ab\xff\xd9", b"\xff\xd8\xff\xd9", jpeg.store(b"a" * 576)[:-60], b"\xff\xd8\xff\xc4\x00\x15\x00" + b"\xff" * 18])
def test_malformed(data):
    with pytest.raises(jpeg.JpegError):
        jpeg.decode_dc([jpeg.parse(data, 0)[0]])


def test_operator(spark):
    texts = [None, "", "a" * 576, "é“日" * 300, "x " * 150_000, "same", "same"]
    rows = [(i, t, "v", 1) for i, t in zip([0, 1, 2, 3, 4, 5, None], texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string, media_bytes int").repartition(2)
    got = {r["doc_id"]: r for r in jpeg.media_features(docs).collect()}
    assert len(got) == len(texts)
    for i, t in zip([0, 1, 2, 3, 4, 5, None], texts, strict=True):
        data = (t or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = jpeg.store(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[5][1:] == got[None][1:]
    assert jpeg.media_features(docs.limit(0)).count() == 0


def test_thumbnails(spark):
    data, want = write_image(20, 20, [(1, 1)] * 3, seed=4)
    images = spark.createDataFrame([(1, data), (2, None), (3, b"no image"), (None, data)], "image_id long, content binary")
    got = {r["id"]: r for r in jpeg.thumbnails(images).collect()}
    assert (got[1]["width"], got[1]["height"]) == (20, 20) and bytes(got[1]["thumbnail"]) == np.clip(want + 128, 0, 255).astype(np.uint8).tobytes()
    assert got[2]["error"] and got[3]["error"] and got[3]["thumbnail"] is None and got[None]["average_hash"] == got[1]["average_hash"]

"""Baseline JPEG: marker parsing, Huffman decoding and luminance thumbnails from DC coefficients, in numpy.

Restart segments of many images with equal tables are decoded side by side, a symbol of every segment per step; an
image without restart markers is one segment. `store` keeps bytes losslessly as the DC coefficients of 8 x 8 blocks:
with a DC step of 8, a block's mean sample is the byte itself, so the thumbnail read back is the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import map_batches, record, text_groups

#: Blocks in a row of a stored image, and rows of blocks an image may have (65,535 samples at most; multiples of 24).
ACROSS, MOST_ROWS = 24, 8184
UNIT = 576
# Code lengths and symbols of the standard's luminance DC table (ITU-T T.81, table K.3).
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: One AC code, end of block, of one bit.
AC_BITS, AC_SYMBOLS = (1, *[0] * 15), (0,)


class JpegError(ValueError):
    pass


def huffman(bits: tuple[int, ...] | bytes, symbols: tuple[int, ...] | bytes) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(code, length) of each symbol in order, and for every 16-bit window the length and symbol of the code it starts with."""
    codes, size, value = [], np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code = k = 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            if code >> length or k >= len(symbols):
                raise JpegError("a Huffman table has too many codes")
            codes.append((code, length))
            span = slice(code << (16 - length), (code + 1) << (16 - length))
            size[span], value[span] = length, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes, size, value


_DC = huffman(DC_BITS, DC_SYMBOLS)[0]
_CODE = np.array([c for c, _ in _DC], np.uint32)
_SIZE = np.array([n for _, n in _DC], np.uint32)
_CATEGORY = np.array([int(d).bit_length() for d in range(256)], np.int64)


def _table(kind: int, bits, symbols) -> bytes:
    return b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), kind) + bytes(bits) + bytes(symbols)


def _header(rows: int) -> bytes:
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
    frame = b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, rows * 8, ACROSS * 8, 1, 1, 0x11, 0)
    scan = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)
    return b"\xff\xd8" + quant + frame + _table(0x00, DC_BITS, DC_SYMBOLS) + _table(0x10, AC_BITS, AC_SYMBOLS) + b"\xff\xdd" + struct.pack(">HH", 4, ACROSS) + scan


def _scan(blocks: np.ndarray) -> bytes:
    """Entropy-coded rows of blocks, a restart segment each, with stuffed bytes and restart markers."""
    level = blocks.reshape(-1, ACROSS).astype(np.int32) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = _CATEGORY[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint32)
    length = (_SIZE[size] + size.astype(np.uint32) + 1).astype(np.int64)
    word = (_CODE[size] << size.astype(np.uint32) | extra) << np.uint32(1)
    pad = -length.sum(axis=1) % 8
    length = np.column_stack([length, pad])
    word = np.column_stack([word, (1 << pad) - 1]).astype(np.uint32)
    step = np.arange(15, -1, -1, dtype=np.uint32)
    bits = (word[:, :, None] >> step) & np.uint32(1)
    data = np.packbits(bits[step < length[:, :, None]].astype(np.uint8))
    seg = length.sum(axis=1) // 8
    full = data == 255
    where = np.arange(len(data)) + np.cumsum(full) - full + 2 * np.repeat(np.arange(len(seg)), seg)
    out = np.zeros(len(data) + int(full.sum()) + 2 * (len(seg) - 1), np.uint8)
    out[where] = data
    ends = np.cumsum(seg)[:-1]
    mark = ends + np.cumsum(full)[ends - 1] + 2 * np.arange(len(ends))
    out[mark], out[mark + 1] = 255, 0xD0 + np.arange(len(ends)) % 8
    return out.tobytes()


def store(payload: bytes) -> bytes:
    """Bytes (a positive multiple of 576) as one or more baseline JPEG images in a row."""
    data = np.frombuffer(payload, np.uint8)
    parts = []
    for at in range(0, len(data), ACROSS * MOST_ROWS):
        part = data[at : at + ACROSS * MOST_ROWS]
        parts.append(_header(len(part) // ACROSS) + _scan(part) + b"\xff\xd9")
    return b"".join(parts)


@dataclass
class Frame:
    """One parsed image: dimensions, components of its luminance scan with tables, and entropy-coded bytes."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantization table
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component index, DC table, AC table
    restart: int = 0
    step: int = 0
    tables: dict[int, bytes] = field(default_factory=dict)
    data: bytes = b""


def parse(data: bytes, at: int) -> tuple[Frame, int]:
    """The image that starts at a byte, and where it ends. Only the scan with the first component is kept."""
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    frame, quant, interval, rgb, pos = Frame(), {}, 0, False, at + 2
    while True:
        if pos + 2 > len(data) or data[pos] != 0xFF:
            raise JpegError("a marker is missing")
        kind = data[pos + 1]
        pos += 1 if kind == 0xFF else 2
        if kind == 0xFF or 0xD0 <= kind <= 0xD7 or kind == 0x01:
            continue
        if kind == 0xD9:
            break
        if pos + 2 > len(data) or (size := struct.unpack_from(">H", data, pos)[0]) < 2 or pos + size > len(data):
            raise JpegError("a segment is cut off")
        body = data[pos + 2 : pos + size]
        pos += size
        try:
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    frame.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif kind == 0xDD:
                interval = struct.unpack(">H", body[:2])[0]
            elif kind == 0xEE and body[:5] == b"Adobe" and len(body) > 11 and body[11] == 0:
                rgb = True
            elif kind in (0xC0, 0xC1):
                bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not frame.height or not frame.width or not n:
                    raise JpegError("only 8-bit frames of known height")
                frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if any(not h or not v for _, h, v, _ in frame.parts):
                    raise JpegError("a sampling factor is 0")
            elif 0xC2 <= kind <= 0xCF and kind != 0xCC:
                raise JpegError("not a baseline frame")
            elif kind == 0xDA:
                end = pos
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        raise JpegError("a scan is cut off")
                    if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                        break
                    end += 2
                ids = [p[0] for p in frame.parts]
                scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                if any(c == 0 for c, _, _ in scan):
                    if rgb and len(frame.parts) > 1:
                        raise JpegError("no luminance component")
                    frame.scan, frame.data, frame.step, frame.restart = scan, data[pos:end], quant[frame.parts[0][3]], interval
                    frame.tables = {t: frame.tables[t] for t in sorted({x for _, d, a in scan for x in (d, 16 + a)})}
                pos = end
        except (IndexError, KeyError, ValueError, struct.error) as e:
            raise e if isinstance(e, JpegError) else JpegError("a segment is malformed") from e
    if not frame.scan:
        raise JpegError("no luminance scan")
    return frame, pos


def frames_of(data: bytes) -> list[Frame]:
    out, at = [], 0
    while at < len(data):
        frame, at = parse(data, at)
        out.append(frame)
    return out


def _layout(frame: Frame) -> tuple[int, int, list[int]]:
    """Units across and down, and the component of each block in a unit."""
    wide, high = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
    if len(frame.scan) == 1:
        _, h, v, _ = frame.parts[frame.scan[0][0]]
        return -(-(-(-frame.width * h // wide)) // 8), -(-(-(-frame.height * v // high)) // 8), [0]
    return -(-frame.width // (8 * wide)), -(-frame.height // (8 * high)), [i for i, (c, _, _) in enumerate(frame.scan) for _ in range(frame.parts[c][1] * frame.parts[c][2])]


def _segments(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, and where its restart segments start."""
    raw = np.frombuffer(data, np.uint8)
    mark = np.flatnonzero(raw[:-1] == 255) if len(raw) else np.zeros(0, np.int64)
    restart = mark[raw[mark + 1] >= 0xD0]
    drop = np.zeros(len(raw), np.int64)
    drop[mark[raw[mark + 1] == 0] + 1] = 1
    drop[restart] = drop[restart + 1] = 1
    gone = np.cumsum(drop)
    return raw[drop == 0], np.append(0, restart + 2 - gone[restart + 1])


def decode_dc(frames: list[Frame]) -> list[np.ndarray]:
    """DC coefficients of the first component of each image, as rows of blocks, cropped to the image."""
    out: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(frames)
    alike = defaultdict(list)
    for i, f in enumerate(frames):
        layout = _layout(f)
        alike[(tuple(f.tables.items()), tuple(f.scan), tuple(layout[2]))].append((i, layout))
    for (tables, scan, units), members in alike.items():
        place = {t: k for k, (t, _) in enumerate(tables)}
        pairs = [huffman(spec[:16], spec[16:])[1:] for _, spec in tables]
        size, value = (np.concatenate([p[j] for p in pairs]) for j in (0, 1))
        dc_table = np.array([place[scan[u][1]] for u in units], np.int64) << 16
        ac_table = np.array([place[16 + scan[u][2]] for u in units], np.int64) << 16
        luma = next(k for k, (c, _, _) in enumerate(scan) if c == 0)
        data, bits, blocks, base, total, bound = [], [], [], [], 0, 0
        for i, (across, down, _) in members:
            f = frames[i]
            raw, begin = _segments(f.data)
            n = across * down * len(units)
            each = f.restart * len(units) or n
            if len(begin) != -(-n // each):
                raise JpegError("restart markers do not match the interval")
            data.append(raw)
            bits.append((begin + bound) * 8)
            blocks.append(np.minimum(each, n - each * np.arange(len(begin))))
            base.append(total + each * np.arange(len(begin)))
            bound, total = bound + len(raw), total + n
        dc = _lanes(np.concatenate([*data, np.full(16, 255, np.uint8)]), np.concatenate(bits), np.concatenate(blocks), np.concatenate(base), total, size, value, dc_table, ac_table, np.array(units))
        at = 0
        for i, (across, down, _) in members:
            f, n = frames[i], across * down * len(units)
            own = dc[at : at + n].reshape(down, across, len(units))[:, :, [k for k, u in enumerate(units) if u == luma]]
            at += n
            _, h, v, _ = f.parts[0]
            if len(f.scan) > 1:
                own = own.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
                wide, high = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
                own = own[: -(-(-(-f.height * v // high)) // 8), : -(-(-(-f.width * h // wide)) // 8)]
            out[i] = own.reshape(own.shape[0], own.shape[1])
    return out


def _lanes(data, bit, blocks, base, total, size, value, dc_table, ac_table, units) -> np.ndarray:
    """Decodes one symbol of every unfinished segment a step; returns the DC coefficient of every block."""
    dc = np.zeros(total, np.int32)
    bit, blocks, base = bit.copy(), blocks.copy(), base.copy()
    block, k = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    before = np.zeros((len(bit), int(units.max()) + 1), np.int32)
    data = data.astype(np.uint32)
    limit = 8 * (len(data) - 16)
    while len(bit):
        if (bit > limit).any():
            raise JpegError("a scan ends early")
        unit = block % len(units)
        first = k == 0
        at = bit >> 3
        window = data[at] << 24 | data[at + 1] << 16 | data[at + 2] << 8 | data[at + 3]
        look = np.where(first, dc_table[unit], ac_table[unit]) + (window >> (16 - (bit & 7)).astype(np.uint32) & np.uint32(0xFFFF))
        length, symbol = size[look].astype(np.int64), value[look].astype(np.int64)
        if not length.all():
            raise JpegError("an unknown Huffman code")
        bit += length
        n = np.where(first, symbol, symbol & 15)
        at = bit >> 3
        window = data[at] << 24 | data[at + 1] << 16 | data[at + 2] << 8 | data[at + 3]
        extra = (window << (bit & 7).astype(np.uint32) >> np.uint32(16) >> (16 - n).astype(np.uint32)).astype(np.int32)
        bit += n
        start = np.flatnonzero(first)
        if len(start):
            m, e, u = n[start], extra[start], units[unit[start]]
            diff = np.where(e < (1 << m >> 1), e - (1 << m) + 1, e)
            before[start, u] += diff.astype(np.int32)
            dc[base[start] + block[start]] = before[start, u]
        k = np.where(first, 1, np.where(n > 0, k + (symbol >> 4) + 1, np.where(symbol == 0xF0, k + 16, 64)))
        over = k >= 64
        block += over
        k[over] = 0
        done = block >= blocks
        if done.any():
            stay = ~done
            bit, blocks, base, block, k, before = bit[stay], blocks[stay], base[stay], block[stay], k[stay], before[stay]
    return dc


def thumbnail(frame: Frame, dc: np.ndarray) -> np.ndarray:
    """A sample for each 8 x 8 block of the first component: its mean, 0 to 255."""
    return np.clip((dc * frame.step + 1024 + 4) >> 3, 0, 255).astype(np.uint8)


def hashes(image: np.ndarray) -> tuple[int, int]:
    """Average hash and difference hash (64 bits each) of a thumbnail pooled to 8 x 9 cells."""

    def pool(rows: int, cols: int) -> np.ndarray:
        at = [np.minimum(np.arange(n) * m // n, m - 1) for n, m in ((rows, image.shape[0]), (cols, image.shape[1]))]
        part = np.add.reduceat(np.add.reduceat(image.astype(np.float64), at[0], axis=0), at[1], axis=1)
        area = [np.maximum(np.diff(np.append(x, m)), 1) for x, m in zip(at, image.shape, strict=True)]
        return part / np.outer(area[0], area[1])

    eight, nine = pool(8, 8), pool(8, 9)
    number = lambda bits: int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big")
    return number(eight > eight.mean()), number(nine[:, 1:] > nine[:, :-1])


def read_back(media: list[bytes]) -> list[tuple[bytes, str]]:
    """Payload and feature (dimensions, images and thumbnail hashes) of each stored form."""
    parsed = [frames_of(m) for m in media]
    flat = [f for p in parsed for f in p]
    grids = iter(decode_dc(flat))
    out = []
    for frames in parsed:
        images = [thumbnail(f, next(grids)) for f in frames]
        whole = np.concatenate(images)
        average, difference = hashes(whole)
        out.append((whole.tobytes(), f"{frames[0].width}x{sum(f.height for f in frames)}:{len(frames)}:{average:016x}:{difference:016x}"))
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT or (UNIT if not data else 0))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as JPEG, reads it back and returns the digests of SCHEMA, a row per document.

    A null or empty text is 576 bytes of 255. Equal texts get equal values; repeated rows and null ids give a row
    each; an empty table gives an empty result; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                plain = [(t or "").encode(errors="replace") for t in texts[a:b]]
                media = [store(padded(x)) for x in plain]
                back = read_back(media)
                yield record({
                    "doc_id": ids.slice(a, b - a), "n_bytes": [len(x) for x in plain], "payload_bytes": [len(p) for p, _ in back],
                    "payload_sha256": [hashlib.sha256(p).hexdigest() for p, _ in back], "tail_crc32": [zlib.crc32(p[-32:]) for p, _ in back],
                    "media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media], "feature": [f for _, f in back],
                }, SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def thumbnails(images: DataFrame, id_col: str = "image_id", content_col: str = "content") -> DataFrame:
    """(id, width, height, thumbnail, average_hash, difference_hash, error) of binary images.

    Null or undecodable content gives nulls and an error text; nothing is dropped.
    """
    schema = pa.schema([("id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("thumbnail", pa.binary()), ("average_hash", pa.string()), ("difference_hash", pa.string()), ("error", pa.string())])

    def one(content: bytes | None) -> tuple:
        try:
            frame = parse(content or b"", 0)[0]
            image = thumbnail(frame, decode_dc([frame])[0])
        except JpegError as e:
            return None, None, None, None, None, str(e)
        average, difference = hashes(image)
        return frame.width, frame.height, image.tobytes(), f"{average:016x}", f"{difference:016x}", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(c) for c in batch.column(1).to_pylist()]
            yield record({"id": batch.column(0)} | {f.name: [r[k] for r in rows] for k, f in enumerate(list(schema)[1:])}, schema)

    rows = images.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).cast("binary").alias("content"))
    return map_batches(rows, run, "id long, width int, height int, thumbnail binary, average_hash string, difference_hash string, error string")

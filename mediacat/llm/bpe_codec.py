"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts every text into chunks at places that its content settles. Equal texts are encoded once. Chunks that
several of the different texts hold are encoded once and joined back; the rest is encoded in place. At every join the encoded chunk is trusted only between
two of its places where a blank follows a visible character (pre-tokens always part there) and where its own tokens
part too; what lies before, after and between is encoded again. A chunk whose tokens do not decode to the text it
stands for is not used. So the ids are those of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import Scratch, map_batches, record, text_groups
from mediacat.llm.pieces import Encoder, encoder
from mediacat.operators.joins import spread_join

#: Characters under the rolling hash, bits that must be 0 at a cut, and least characters of a chunk.
WINDOW, CUT_BITS, LEAST = 16, 8, 64
#: Texts to encode, or shared chunks, up to which their list is broadcast (24 bytes each).
MOST_BROADCAST = 500_000
#: Stands for a null id where rows are looked up by id and text; one of the same text with that id gives the same tokens.
NO_ID = -1
#: A blank after a visible ASCII character.
PART = re.compile("(?<=[!-~]) ")
SCHEMA = pa.schema([("key", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DDL = "key binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def chunks_of(text: str) -> tuple[np.ndarray, list[int]]:
    """Bounds of the chunks of a text (n + 1 numbers) and 64 bits of a cryptographic hash of each."""
    h = np.frombuffer(text.encode("utf-32-le", errors="replace"), np.uint32)
    n, bounds = len(h), [0]
    if n >= WINDOW:
        h = h * np.uint32(0x9E3779B1)
        for k in (1, 2, 4, 8):  # hashes of 2, 4, 8 and 16 characters from each place
            h = (h[:-k] ^ h[:-k] >> np.uint32(15)) * np.uint32(0x85EBCA6B) + h[k:]
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        for p in (np.flatnonzero(h < np.uint32(1 << 32 - CUT_BITS)) + WINDOW).tolist():
            if p - bounds[-1] >= LEAST:  # the next place at least LEAST characters on
                bounds.append(p)
    if bounds[-1] < n:
        bounds.append(n)
    parts = [text[a:b].encode(errors="replace") for a, b in zip(bounds, bounds[1:], strict=False)]
    return np.array(bounds), [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) for p in parts]


class Codec:
    """Encodes with known chunks, and decodes."""

    def __init__(self, enc: Encoder) -> None:
        self.enc = enc
        byte_of = {c: b for b, c in enumerate(enc.alphabet)}
        size = max([*enc.vocab.values(), *enc.library.get_added_tokens_decoder()]) + 1
        self.bytes = [b""] * size
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"  # of ids on their way from task to task
        for token, i in enc.vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for i, token in enc.library.get_added_tokens_decoder().items():
            self.bytes[i] = token.content.encode()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def trusted(self, part: str, ids: np.ndarray) -> tuple[int, int, np.ndarray] | None:
        """First and last agreed place in a chunk's text, and its ids between them; None if there are not two."""
        sizes = np.fromiter((len(self.bytes[i]) for i in ids.tolist()), np.int64, len(ids))
        ends = np.append(0, np.cumsum(sizes))
        if ends[-1] != len(part.encode()) or self.decode(ids) != part.encode():
            return None
        places = [m.start() for m in PART.finditer(part)]
        plain = part.isascii()

        def agreed(order: list[int]) -> tuple[int, int] | None:
            for p in order:  # on to the next place until the chunk's tokens part there too
                q = p if plain else len(part[:p].encode())
                k = int(np.searchsorted(ends, q))
                if ends[k] == q:
                    return p, k
            return None

        low, high = agreed(places), agreed(places[::-1])
        if low is None or high is None or low[0] >= high[0]:
            return None
        return low[0], high[0], ids[low[1] : high[1]]

    def encode(self, texts: list[str | None], plans: list[list[tuple[int, int, np.ndarray]]]) -> list[np.ndarray]:
        """Ids of each text; plans: (start, stop, ids of text[start:stop] encoded alone), in order."""
        windows: list[str] = []
        parts: list[list[int | np.ndarray]] = []
        for text, plan in zip(texts, plans, strict=True):
            text, at, own = text or "", 0, []
            for start, stop, ids in plan:
                if got := self.trusted(text[start:stop], ids):
                    own += [len(windows), got[2]]
                    windows.append(text[at : start + got[0]])
                    at = start + got[1]
            own.append(len(windows))
            windows.append(text[at:])
            parts.append(own)
        again = self.enc.encode(windows)
        return [np.concatenate([again[p] if isinstance(p, int) else p for p in own]).astype("<u4") for own in parts]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(encoder(path))
    return _CODECS[path]


def find_chunks(rows: DataFrame) -> DataFrame:
    """(doc_id, key, start, stop, chunk) of every chunk of every row (doc_id, key, text); a text without characters has one
    row without a chunk, so that every row of the input has one that starts at 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("chunk", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, name = chunks_of(text) if text else (np.zeros(2, np.int64), [None])
                for column, values in zip(out, ([doc_id] * len(name), [key] * len(name), at[:-1].tolist(), at[1:].tolist(), name), strict=True):
                    column += values
            yield record(dict(zip(schema.names, out, strict=True)), schema)

    return map_batches(rows, run, "doc_id long, key binary, start int, stop int, chunk long")


def looked_up(rows: DataFrame, few: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """rows (at, key, text) joined with few, which has a row (at, key, ...) for a text, and with what more has for it. If few
    is small, its keys are broadcast first, so that no other text is shuffled. The join sorts, so that it can spill."""
    if few.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(few.select("at", "key")), ["at", "key"], "left_semi")
    if more is not None:
        few = few.join(more.hint("merge"), ["at", "key"], "left")
    return rows.join(few.hint("merge"), ["at", "key"])


def encode_shared(rows: DataFrame, owners: DataFrame, path: str) -> DataFrame:
    """(chunk, ids): every shared chunk encoded alone, from the text that owns it."""
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_codec = codec(path)
        enc = own_codec.enc
        for batch in batches:
            names, parts = [], []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x in own:
                    names.append(x["chunk"])
                    parts.append(text[x["start"] : x["stop"]])
            for a, b in text_groups(parts):
                yield record({"chunk": names[a:b], "ids": [x.astype(own_codec.dtype).tobytes() for x in enc.encode(parts[a:b])]}, schema)

    return map_batches(looked_up(rows, owners).select("text", "own"), run, "chunk long, ids binary").dropDuplicates(["chunk"])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, then decoded again.

    A null or empty text has no tokens. Repeated rows and null ids give a row each; an empty table gives an empty
    result; other columns are ignored. Texts are read for their chunks, for the shared chunks and, with and
    without shared chunks, for the whole ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    at = F.coalesce("doc_id", F.lit(NO_ID)).alias("at")
    with Scratch(docs.sparkSession) as s:
        chunks = s.cut(find_chunks(rows.select("doc_id", "key", "text")), "chunks")
        texts = s.cut(chunks.filter("start = 0").groupBy("key").agg(F.min(at).alias("at")), "texts")
        place = F.xxhash64("key", "start")  # one number a place; equal ones of two places cost a reuse, nothing else
        shared = chunks.filter("chunk is not null").groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        shared = s.cut(shared.filter("first != last").select("chunk"), "shared")
        places = chunks.select("doc_id", "key", "start", "stop", "chunk")
        if shared.count() <= MOST_BROADCAST:  # so that chunks of one text only are not shuffled
            places = places.join(F.broadcast(shared), "chunk", "left_semi")
        else:
            places = spread_join(places, shared, ["chunk"], ["key", "start"])
        places = s.cut(places.groupBy("key", "start", "stop", "chunk").agg(F.min(at).alias("at")), "places")
        own = places.groupBy("chunk").agg(F.min(F.struct("key", "start", "stop", "at")).alias("own")).select("chunk", "own.*")
        owners = s.cut(own.groupBy("at", "key").agg(F.collect_list(F.struct("start", "stop", "chunk")).alias("own")), "owners")
        rows = rows.select(at, "key", "text")
        encoded = s.cut(encode_shared(rows, owners, path), "encoded")
        plan = spread_join(places, encoded, ["chunk"], ["key", "start"])  # the least id of a place is that of its text
        plan = plan.groupBy("at", "key").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "ids"))).alias("plan"))
        sharing = s.cut(places.select("at", "key").distinct(), "sharing")
        alone = s.cut(texts.join(sharing, ["at", "key"], "left_anti"), "alone")
        if alone.count() <= MOST_BROADCAST:  # so that texts that share no chunk are encoded where they are read
            single = rows.join(F.broadcast(alone.select("at", "key")), ["at", "key"], "left_semi")
            whole = looked_up(rows, sharing, plan).unionByName(single, allowMissingColumns=True)
        else:
            whole = looked_up(rows, texts, plan)
        done = s.cut(coded(whole, path), "coded")
        ids = chunks.filter("start = 0").select("doc_id", "key")
        return s.keep(spread_join(ids, done, ["key"], ["doc_id"]).drop("key"), "round-trip")


def coded(rows: DataFrame, path: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each text of rows (key, text, plan), with the chunks of its plan reused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                plans = [[(x["start"], x["stop"], np.frombuffer(x["ids"], own.dtype)) for x in p or ()] for p in batch.column(2).slice(a, b - a).to_pylist()]
                ids = own.encode(texts[a:b], plans)
                back = [own.decode(x).decode("utf-8", errors="replace").encode() for x in ids]
                yield record({"key": keys.slice(a, b - a), "n_tokens": [len(x) for x in ids], "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]}, SCHEMA)

    return map_batches(rows.select("key", "text", "plan"), run, DDL).dropDuplicates(["key"])

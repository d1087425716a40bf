"""Sum-of-squares packing of token pieces into sequences of fixed length.

Documents longer than a sequence are cut so that only their first piece may be shorter; full pieces fill a sequence
each. The rest is dealt at random into groups of bounded size, and every group is packed by the sum-of-squares rule:
a piece goes where the sum over all gaps of the squared number of open sequences with that gap becomes smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import Scratch, map_batches, record
from mediacat.llm.pieces import encoder

#: Pieces in a group on average; a task holds one group.
GROUP_ROWS = 100_000
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    head = n % capacity
    bounds = ([0] if head else []) + list(range(head, n, capacity))
    return [(a, b - a) for a, b in zip(bounds, [*bounds[1:], n], strict=True)]


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in PIECES}
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    for name, value in zip(out, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        out[name].append(value)
            yield record(out, PIECES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    Moving a bin from gap g to g - s changes the sum by 2 (count[g - s] - count[g] + 1); closed bins do not count. Of
    equal changes the smallest gap that takes the piece wins. A new bin is opened only where no open one takes the
    piece: with lengths in falling order this needs about 1 % fewer bins than letting a new bin compete.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    far = np.int64(1 << 60)
    for i, s in enumerate(lengths.tolist()):
        here = count[s:capacity]  # gaps s .. capacity - 1
        change = np.where(here > 0, 2 * (count[: capacity - s] - here + 1), far)
        if len(change) and here[0]:
            change[0] = 1 - 2 * here[0]  # the bin is full afterwards
        best = int(change.argmin()) if len(change) else -1
        if best < 0 or change[best] == far:
            gap, b = capacity, used
            used += 1
        else:
            gap = s + best
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap - s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces with sequence_id and offset added: every sequence is filled from 0 without gaps, to capacity at most.

    Repeated rows and null ids are pieces like others; an empty table gives an empty result.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = pieces.withColumn("row", F.monotonically_increasing_id())
    full = rows.filter(F.col("length") == capacity).select(*names, (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_rows))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(part["length"].to_numpy(), capacity)
        out = part[names].copy()
        out["sequence_id"] = (int(part["grp"].iloc[0]) << 32 | bins) * 2 + 1
        out["offset"] = offsets
        return out

    placed = rest.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("grp").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document.

    A null or empty text is the end token alone.
    """
    with Scratch(docs.sparkSession) as s:
        return s.keep(pack(s.cut(pieces_of(docs, path, end_id, capacity), "pieces"), capacity, group_rows), "packed")

"""Product codes of vectors, the nearest codebook entry found by VA-file filtering, in whole numbers.

The coordinates of a codebook's entries are quantised to a few bits: cells of equally many entries with their smallest and
largest value. For every part of a vector, tables hold its least and greatest squared distance to each cell of each
coordinate; sums looked up in them bound its distance to every entry. Entries whose lower bound exceeds the smallest upper
bound are out; the others are compared by their integer distances. Codebooks are learned from all rows: tasks return sums,
the driver only gets one row for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import Scratch, map_batches, record
from mediacat.llm.vectors import group_sums, matrix, totals, whole_vectors
from mediacat.operators.joins import spread_join

#: Bits of a cell.
BITS = 3
#: Vectors whose bounds are held at once, and labels up to which their sums are broadcast (16 bytes each).
ROWS, MOST_BROADCAST = 4096, 500_000
SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
CODES = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


class VAFile:
    """Entries (rows of whole numbers) and the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        n, width = entries.shape
        cells = min(1 << bits, n)
        self.entries, self.cell = entries, np.empty((n, width), np.int64)
        self.low, self.high = np.empty((cells, width), np.int64), np.empty((cells, width), np.int64)
        for i in range(width):
            order = np.argsort(entries[:, i], kind="stable")
            begin = np.arange(cells) * n // cells
            value = entries[order, i]
            self.low[:, i], self.high[:, i] = value[begin], value[np.append(begin[1:], n) - 1]
            self.cell[order, i] = np.repeat(np.arange(cells), np.diff(np.append(begin, n)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each row (ties: the lower index), its squared distance, and how many distances were computed."""
        below, above = self.low[None] - x[:, None], x[:, None] - self.high[None]  # row, cell, coordinate
        near, far = np.maximum(np.maximum(below, above), 0) ** 2, np.maximum(np.abs(below), np.abs(above)) ** 2
        lower = sum(near[:, self.cell[:, i], i] for i in range(x.shape[1]))
        upper = sum(far[:, self.cell[:, i], i] for i in range(x.shape[1]))
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        distance = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(distance, np.flatnonzero(np.diff(row, prepend=-1)))
        hit = np.flatnonzero(distance == least[row])
        return entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]], least, len(row)


def encode(x: np.ndarray, files: list[VAFile]) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each row and part, and the squared distances summed over parts."""
    width = x.shape[1] // len(files)
    codes, error = np.empty((len(x), len(files)), np.int64), np.zeros(len(x), np.int64)
    for begin in range(0, len(x), ROWS):
        some = slice(begin, begin + ROWS)
        for p, f in enumerate(files):
            codes[some, p], distance, _ = f.nearest(x[some, p * width : (p + 1) * width])
            error[some] += distance
    return codes, error


def part_sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """For each task, part and entry in use the count and sum of its parts; rows (x)."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VAFile(b) for b in books]
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * width)
            codes, _ = encode(x, files)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=k)
                sums[p] += group_sums(codes[:, p], x[:, p * width : (p + 1) * width], k)
        part, entry = np.nonzero(n)
        yield record({"part": part, "entry": entry, "n": n[part, entry], "sums": list(sums[part, entry])}, SUMS)

    return map_batches(rows.select("x"), run, "part int, entry int, n long, sums array<long>")


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of rows (vec_id, label, x)."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VAFile(b) for b in books]
        for batch in batches:
            codes, error = encode(matrix(batch.column(2), parts * width), files)
            yield record({"vec_id": batch.column(0), "label": batch.column(1), "code": [c.tobytes().hex() for c in codes.astype(np.uint8)], "error": error}, CODES)

    return map_batches(rows.select("vec_id", "label", "x"), run, "vec_id long, label string, code string, error long")


def product_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, size: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector of `size` finite components.

    Components become floor(256 * x). Codebooks start as the parts of the `entries` smallest ids (of equal ids the smaller
    vector first), at most 256. Rows with a null id are coded but start no entry; with fewer rows codebooks are smaller, and
    without any the result is empty. Repeated rows are rows of their own, null labels one label. Other columns are
    ignored.
    """
    spark, width = vectors.sparkSession, size // parts
    rows = whole_vectors(vectors, vec_col, size, vec_id=F.col(id_col).cast("long"), label=F.col(label_col).cast("string"))
    start = rows.filter("vec_id IS NOT NULL").orderBy("vec_id", "x").select("x").limit(entries).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = np.array([r["x"] for r in start], np.int64).reshape(-1, parts, width).swapaxes(0, 1).copy()
    for _ in range(rounds):
        with Scratch(spark) as s:
            sums = s.cut(part_sums(rows, books), "sums")
            n = {(r["part"], r["entry"]): r["n"] for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n")).collect()}  # parts * entries rows at most
            for r in totals(sums, "part", "entry").collect():
                books[r["part"], r["entry"], r["i"]] = int(r["total"]) // n[r["part"], r["entry"]]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = Scratch(spark).keep(coded(rows, books), "codes").withColumn("key", F.struct("label"))
    labels = out.groupBy("key").agg(F.sum("error").alias("label_error"))
    joined = out.join(F.broadcast(labels), "key") if labels.count() <= MOST_BROADCAST else spread_join(out, labels, ["key"], ["vec_id"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

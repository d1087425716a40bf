"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are ordered by their nearest pivot and id and cut into blocks, each with a forward index (its vectors) and the
largest and smallest value of every component, the terms. The summed term maxima of a query over a block bound all its
scores there. First the best block of every query is found from the bounds alone and scored, which gives a lower limit
of its k-th score. Then chunks of blocks meet groups of queries: each query takes the chunk's blocks in falling order of
bound and scores them through the forward index until a bound falls below its k-th score so far. A block whose bound
equals it is passed over only if all its ids are larger, since ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacat.llm.common import Scratch, map_batches, record
from mediacat.llm.vectors import matrix, products, whole_vectors
from mediacat.operators.joins import spread_join

#: Rows of a block, blocks of a chunk and blocks of queries in a group (the last two are what a task holds, 4 bytes a
#: component), vectors that all others are ordered by.
BLOCK, CHUNK, GROUP, PIVOTS = 128, 128, 32, 64
LOWEST = np.iinfo(np.int64).min
BLOCK_DDL = "ids array<long>, places array<long>, x array<int>, low array<int>, high array<int>"
BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("x", pa.list_(pa.int32())), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])
HITS = pa.schema([("place", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("scored", pa.int64())])
HITS_DDL = "place long, query_id long, vec_id long, score long, scored long"


def nearest_pivot(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (place, vec_id, x) with the number of the nearest pivot."""
    schema = pa.schema([("place", pa.int64()), ("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("pivot", pa.int32())])
    half = (pivots * pivots).sum(axis=1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = (products(matrix(batch.column(2), pivots.shape[1]), pivots) - half).argmax(axis=1)
            yield record({"place": batch.column(0), "vec_id": batch.column(1), "x": batch.column(2), "pivot": pivot}, schema)

    return map_batches(rows.select("place", "vec_id", "x"), run, "place long, vec_id long, x array<int>, pivot int")


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """Blocks (block, ids, places, x, low, high) of rows (place, vec_id, x, pivot): ranges of (pivot, vec_id, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(part: pa.Table) -> pa.RecordBatch:
            x = matrix(part.column("x").combine_chunks(), size)
            one = {"ids": [part.column("vec_id").to_numpy()], "places": [part.column("place").to_numpy()], "x": [x.ravel().astype(np.int32)], "low": [x.min(axis=0).astype(np.int32)], "high": [x.max(axis=0).astype(np.int32)]}
            return record(one, BLOCKS)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                part = pa.Table.from_batches(held)
                yield cut(part.slice(0, BLOCK))
                held = part.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield cut(pa.Table.from_batches(held))

    rows = rows.repartitionByRange("pivot", "vec_id", "place").sortWithinPartitions("pivot", "vec_id", "place")
    return rows.select("vec_id", "place", "x").mapInArrow(run, BLOCK_DDL).withColumn("block", F.monotonically_increasing_id())


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest possible score of each query (row) in each block (column): its positive components meet the block's
    maxima, its negative ones the minima."""
    return products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)


class Blocks:
    """Blocks that a task holds."""

    def __init__(self, part: pa.Table, size: int) -> None:
        self.n = part.num_rows
        self.low, self.high = (matrix(part.column(c).combine_chunks(), size) for c in ("low", "high"))
        self.block = part.column("block").to_numpy()
        self.ids, self.places = (part.column(c).to_pylist() if c in part.column_names else [] for c in ("ids", "places"))
        self.x = [np.array(x, np.int64).reshape(-1, size) for x in part.column("x").to_pylist()] if "x" in part.column_names else []
        self.least = np.array([min(i) for i in self.ids], np.int64)


def best_of(found: list[tuple[np.ndarray, ...]], k: int, n: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The k best (query, score, id) of each of n queries in order, and score and id of its k-th (LOWEST and -1 if it has fewer)."""
    query, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    keep = rank < k
    limit, least = np.full(n, LOWEST), np.full(n, -1)
    kth = rank == k - 1
    limit[query[kth]], least[query[kth]] = score[kth], ids[kth]
    return (query[keep], score[keep], ids[keep]), limit, least


def search(x: np.ndarray, places: np.ndarray, floor: np.ndarray, blocks: Blocks, k: int) -> tuple[tuple[np.ndarray, ...], int]:
    """The k best (query, score, id) in these blocks of each query, leaving out scores below `floor`, a lower limit of its
    k-th score anywhere; and how many blocks were scored for a query. Queries take their next blocks in steps that
    double, all queries that want a block at once."""
    n = len(x)
    bound = bounds(x, blocks.low, blocks.high)
    order = np.argsort(-bound, axis=1, kind="stable")
    empty = np.zeros(0, np.int64)
    top, limit, last = (empty, empty, empty), np.full(n, LOWEST), np.full(n, -1)
    begin, step, scored = 0, 1, 0
    going = np.arange(n)
    while begin < blocks.n and len(going):
        want = order[going, begin : begin + step]
        high = np.take_along_axis(bound[going], want, axis=1)
        lim, floors = limit[going, None], floor[going, None]
        hope = (high >= floors) & ((high > lim) | (high == lim) & (blocks.least[want] < last[going, None]))
        row, col = np.nonzero(hope)
        found = [top]
        by_block = np.argsort(want[row, col], kind="stable")
        row, wanted = row[by_block], want[row, col][by_block]
        scored += len(row)
        starts = np.flatnonzero(np.diff(wanted, prepend=-1))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(row)).tolist(), strict=False):
            q, j = going[row[a:b]], int(wanted[a])
            score = products(x[q], blocks.x[j])
            good = (score >= np.maximum(limit[q], floor[q])[:, None]) & (places[q][:, None] != np.array(blocks.places[j])[None])
            i, c = np.nonzero(good)
            found.append((q[i], score[i, c], np.array(blocks.ids[j], np.int64)[c]))
        top, limit, last = best_of(found, k, n)
        # bounds fall along the order, so a query ends where the next one cannot reach it; at equality ids decide
        begin, step = begin + step, step * 2
        if begin < blocks.n:
            ahead = bound[going, order[going, begin]]
            going = going[ahead >= np.maximum(limit[going], floor[going])]
    return top, scored


def meetings(blocks: DataFrame, queries: DataFrame, n_chunks: int, n_groups: int) -> tuple[DataFrame, DataFrame]:
    """Blocks and query blocks dealt by hash so that each chunk meets each group once, under the key (chunk, grp)."""
    chunk, grp = F.pmod(F.xxhash64("block", F.lit(1)), F.lit(n_chunks)).cast("int"), F.pmod(F.xxhash64("block", F.lit(2)), F.lit(n_groups)).cast("int")
    one = blocks.withColumn("chunk", chunk).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    two = queries.withColumn("grp", grp).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    return one, two


def flat(part: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, places and ids of the queries of several query blocks."""
    x = [np.array(v, np.int64).reshape(-1, size) for v in part.column("x").to_pylist()]
    return np.concatenate(x), np.concatenate([np.array(v, np.int64) for v in part.column("places").to_pylist()]), np.concatenate([np.array(v, np.int64) for v in part.column("ids").to_pylist()])


def best_blocks(blocks: DataFrame, queries: DataFrame, size: int, n_chunks: int, n_groups: int) -> DataFrame:
    """(place, block) of each query: the block with its largest bound, from the summaries alone."""
    schema = pa.schema([("place", pa.int64()), ("block", pa.int64()), ("bound", pa.int64())])

    def run(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return schema.empty_table()
        x, places, _ = flat(theirs, size)
        held = Blocks(mine, size)
        bound = bounds(x, held.low, held.high)
        best = bound.argmax(axis=1)
        return pa.Table.from_batches([record({"place": places, "block": held.block[best], "bound": bound[np.arange(len(x)), best]}, schema)])

    one, two = meetings(blocks.select("block", "low", "high"), queries.select("block", "ids", "places", "x"), n_chunks, n_groups)
    rows = one.groupBy("chunk", "grp").cogroup(two.groupBy("chunk", "grp")).applyInArrow(run, "place long, block long, bound long")
    return rows.groupBy("place").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))


def first_limits(best: DataFrame, queries: DataFrame, blocks: DataFrame, size: int, k: int) -> DataFrame:
    """(place, floor): the k-th score of each query in its best block, or no row if that has too few. Many queries may want
    one block, so the block goes to many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("place", pa.int64()), ("floor", pa.int64())])
        for batch in batches:
            x = matrix(batch.column(1), size)
            place, floor = batch.column(0).to_numpy(), np.full(len(x), LOWEST)
            for i, (others, forward) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                score = products(x[i : i + 1], np.array(forward, np.int64).reshape(-1, size))[0][np.array(others) != place[i]]
                if len(score) >= k:
                    floor[i] = np.partition(score, len(score) - k)[len(score) - k]
            good = floor > LOWEST
            yield record({"place": place[good], "floor": floor[good]}, schema)

    one = queries.select(F.explode(F.arrays_zip("places", F.sequence(F.lit(0), F.size("ids") - 1).alias("i"))).alias("q"), "x")
    one = one.select(F.col("q.places").alias("place"), F.slice("x", F.col("q.i") * size + 1, F.lit(size)).alias("x")).join(best, "place")
    pairs = spread_join(one, blocks.select("block", "places", F.col("x").alias("forward")), ["block"], ["place"])
    return map_batches(pairs.select("place", "x", "places", "forward"), run, "place long, floor long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score and scored of the k best rows by inner product for each row whose id `every` divides.

    Components become floor(256 * x). A query's own row is no candidate; fewer candidates give fewer rows. Ties go to the
    smaller id. Of repeated rows each is a query and a candidate of its own. Rows with a null id take no part, missing
    components of shorter vectors count as 0, an empty table gives an empty result, other columns are ignored. scored is
    the number of blocks that were scored in the chunk where the row was found, for all queries there.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as s:
        rows = whole_vectors(vectors, vec_col, None, vec_id=F.col(id_col).cast("long")).filter("vec_id IS NOT NULL")
        rows = s.cut(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
        count, most, asked = rows.agg(F.count("*"), F.max(F.size("x")), F.count_if(F.col("vec_id") % every == 0)).first()
        if not count or not asked:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, scored long")
        size = max(1, most)
        picked = rows.orderBy(F.xxhash64("vec_id", "x"), "place").select("x").limit(PIVOTS).collect()
        pivots = np.array([r["x"] + [0] * (size - len(r["x"])) for r in picked], np.int64).reshape(-1, size)
        rows = nearest_pivot(rows, pivots)
        blocks = s.cut(blocks_of(rows, size), "blocks")
        queries = s.cut(blocks_of(rows.filter(F.col("vec_id") % every == 0), size), "queries")
        n_chunks, n_groups = math.ceil(blocks.count() / CHUNK), math.ceil(queries.count() / GROUP)
        best = s.cut(best_blocks(blocks, queries, size, n_chunks, n_groups), "best")
        floors = s.cut(first_limits(best, queries, blocks, size, k), "floors")
        listed = queries.select("block", F.posexplode("places").alias("i", "place")).join(floors, "place").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("place", "floor"))).alias("floors"))  # a block's rows
        queries = s.cut(queries.join(listed, "block", "left"), "queries")

        def run(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
            if not mine.num_rows or not theirs.num_rows:
                return HITS.empty_table()
            x, places, ids = flat(theirs, size)
            known = {p: f for some in theirs.column("floors").to_pylist() for p, f in some or ()}
            floor = np.array([known.get(p, LOWEST) for p in places.tolist()], np.int64)
            (q, score, vec), scored = search(x, places, floor, Blocks(mine, size), k)
            return pa.Table.from_batches([record({"place": places[q], "query_id": ids[q], "vec_id": vec, "score": score, "scored": np.full(len(q), scored)}, HITS)])

        one, two = meetings(blocks.select("block", "ids", "places", "x", "low", "high"), queries.select("block", "ids", "places", "x", "floors"), n_chunks, n_groups)
        hits = one.groupBy("chunk", "grp").cogroup(two.groupBy("chunk", "grp")).applyInArrow(run, HITS_DDL)
        rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
        return s.keep(hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score", "scored"), "top")

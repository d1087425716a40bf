"""Near duplicates by a chosen-path set similarity join over word shingles.

Texts with equal shingle sets form a class; one row stands for each. A class has a vector of minwise hashes. The root of
every tree has coordinates of its own, further nodes pick theirs at random, and a class goes to the child named by its
own hash there, so similar classes share paths. Nodes of few classes, and nodes whose classes are alike (branching would not part them), are compared
exhaustively; the others branch again. Independent trees repeat this until the target recall is met. Shortcuts that
lose no component: links to random classes of each node, confirmed first, join most copies; later only pairs whose
ends are not yet in one component are compared, and only in the first compared root that both share. Every link is
confirmed on full shingle sets; a shingle is 128 bits mixed of its words' cryptographic hashes.

Recall of the branching for a pair of similarity 0.8, measured over random pairs (tests): all of 20,000 where roots are
compared, at least 0.9999 at every deeper level.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import Scratch, map_batches, record, text_groups
from mediacat.llm.components import connected_components
from mediacat.llm.words import bytes_of, distinct, joined, mix
from mediacat.operators.joins import spread_join

#: Coordinates of a class's minwise vector, those that trees branch on, and bits kept of each for estimates.
WIDTH, PATHS = 128, 64
#: Children that a node opens, and levels below the roots.
BRANCH, DEPTH = 2, 4
#: Classes that a node may hold to be compared exhaustively, and classes in a block of larger leaves. A larger node
#: counts as alike if this share of its classes is near its pivot.
ALIKE = 0.2
SMALL, BLOCK = 64, 512
#: Random classes of each root that the others are linked to first; roots that hold the same classes pick the same.
STARS = 3
#: Shingles up to which both numbers of each are compared.
FEW_SHINGLES = 64
#: Rows of leaves that a task compares at once.
COMPARE_ROWS, COMPARE_BYTES = 8192, 64_000_000
#: Edges that one task may contract at the end of connected components (at most 60 MB in Python).
FEW_EDGES = 100_000
#: Ids up to which the list of needed documents, and nodes up to which a table of nodes, is broadcast (32 bytes each).
MOST_BROADCAST = 500_000
#: Nodes up to which their pivots are broadcast with their sketches (600 bytes a node).
MOST_PIVOTS = 20_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64)


def survival(similarity: float, depth: int, branch: int = BRANCH) -> float:
    """Chance that two sets of this similarity share a leaf of one tree."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** branch
    return p


def trees_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def word_names(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each word: a cryptographic hash, computed once for each distinct word."""
    code, _, first, other = distinct(data, begin, size)

    def digests(rows: np.ndarray) -> np.ndarray:
        found = b"".join(hashlib.blake2b(bytes_of(data, b, n), digest_size=16).digest() for b, n in zip(begin[rows].tolist(), size[rows].tolist(), strict=True))
        return np.frombuffer(found, np.uint64).reshape(-1, 2)

    out = digests(first)[code]
    out[other] = digests(other)
    return out


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as sorted rows of two 64-bit numbers; fewer words make one shingle, none
    make none."""
    out: list[np.ndarray] = []
    for a, b in text_groups(texts):
        part = [(t or "").encode(errors="replace").translate(LOWER) for t in texts[a:b]]
        data, ends = joined(part)
        space = IS_SPACE[data[: ends[-1] + 1]]
        space[ends] = True
        edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
        begin, stop = edge[::2], edge[1::2]
        first = np.searchsorted(begin, np.append(0, ends + 1))
        word = word_names(data, begin, stop - begin)
        n = max(0, len(word) - k + 1)
        wide = np.zeros((n, 2), np.uint64)
        for i in range(k):
            wide = chained(wide, word[i : i + n])
        for row in range(len(part)):
            lo, hi = first[row], first[row + 1]
            if hi - lo >= k:
                x = wide[lo : hi - k + 1]
                x = x[np.argsort(x[:, 0])]
                if (x[1:, 0] == x[:-1, 0]).any():
                    x = x[np.lexsort((x[:, 1], x[:, 0]))]
                    x = x[np.append(True, (x[1:] != x[:-1]).any(axis=1))]
                out.append(x)
            else:
                h = np.full((min(1, hi - lo), 2), hi - lo, np.uint64)
                for i in range(lo, hi):
                    h = chained(h, word[i : i + 1])
                out.append(h)
    return out


def chained(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((h ^ (h >> np.uint64(31))) * MIX + word)


def set_id(x: np.ndarray) -> bytes | None:
    return hashlib.md5(x.tobytes()).digest() if len(x) else None


def minwise(sets: list[np.ndarray]) -> tuple[list[np.ndarray | None], list[bytes | None]]:
    """Of each set the first PATHS minwise hashes, and 16 bits of each of all WIDTH (None if it is empty)."""
    full = [x for x in sets if len(x)]
    if not full:
        return [None] * len(sets), [None] * len(sets)
    flat = np.concatenate([x[:, 0] for x in full])
    at = np.cumsum([0, *map(len, full[:-1])])
    out = np.empty((len(full), WIDTH), np.int32)
    for i in range(WIDTH):
        out[:, i] = np.minimum.reduceat((flat * FACTORS[i] + SHIFTS[i]) >> np.uint64(33), at).astype(np.int32)
    paths, sketch = iter(out[:, :PATHS]), iter((out & 0xFFFF).astype(np.uint16))
    return [next(paths) if len(x) else None for x in sets], [next(sketch).tobytes() if len(x) else None for x in sets]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig, sketch, key) of every row (doc_id, text, key)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("sig", pa.list_(pa.int32())), ("sketch", pa.binary()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            sig, sketch = minwise(sets)
            yield record({"doc_id": batch.column(0), "n_shingles": [len(x) for x in sets], "set_id": [set_id(x) for x in sets], "sig": sig, "sketch": sketch, "key": batch.column(2)}, schema)

    return map_batches(docs.select("doc_id", "text", "key"), run, "doc_id long, n_shingles long, set_id binary, sig array<int>, sketch binary, key binary")


def full_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(set_id, side, items) for the classes in needed (doc_id, set_id, side), from the texts of their representatives."""
    schema = pa.schema([("set_id", pa.binary()), ("side", pa.int32()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, sides, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = [(w, s, packed(x)) for w, s, x in zip(wanted, sides, shingle_sets(texts, k), strict=True) if set_id(x) == w]
            yield record({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)

    few = needed.count() <= MOST_BROADCAST
    rows = docs.join(F.broadcast(needed) if few else needed, "doc_id").select("set_id", "side", "text")
    return map_batches(rows, run, "set_id binary, side int, items binary").dropDuplicates(["set_id"])


def packed(x: np.ndarray) -> bytes:
    """A set for comparison: both numbers of every shingle of a small set, one of a larger one, where a false link would need
    dozens of equal numbers at once."""
    return b"2" + x.tobytes() if len(x) <= FEW_SHINGLES else b"1" + np.ascontiguousarray(x[:, 0]).tobytes()


def alike(x: bytes, y: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union of two packed sets."""
    a, b = (np.frombuffer(s, np.uint64, offset=1).reshape(-1, int(s[:1])) for s in (x, y))
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    width = min(a.shape[1], b.shape[1])
    both = int((b[np.minimum(np.searchsorted(b[:, 0], a[:, 0]), len(b) - 1), :width] == a[:, :width]).all(axis=1).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, s: Scratch) -> DataFrame:
    """The pairs (src, dst) of classes with 100 * intersection >= percent * union of their full sets. A set is only sent to
    the side of the join where it stands. One src may have very many pairs: both sides of each join are shuffled as they
    are written, so that Spark can split them."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("set_id"), F.lit(1).alias("side")), F.struct(F.col("dst").alias("set_id"), F.lit(2).alias("side")))).alias("e")).select("e.*")
    ends = ends.groupBy("set_id").agg(F.bit_or("side").alias("side"))
    needed = s.cut(classes.select("set_id", "doc_id").join(ends, "set_id"), "needed")
    sets = s.cut(full_sets(docs, needed, k), "sets")
    schema = pa.schema([("src", pa.binary()), ("dst", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = [i for i in range(len(src)) if alike(x[i], y[i], percent)]
            yield record({"src": [src[i] for i in keep], "dst": [dst[i] for i in keep]}, schema)

    one = sets.filter("side & 1 > 0").select(F.col("set_id").alias("src"), F.col("items").alias("x"))
    two = sets.filter("side & 2 > 0").select(F.col("set_id").alias("dst"), F.col("items").alias("y"))
    rows = pairs.join(one, "src").join(two, "dst")
    return map_batches(rows.select("src", "dst", "x", "y"), run, "src binary, dst binary")


def grid(column: pa.ChunkedArray) -> np.ndarray:
    """A row of 16-bit numbers for each sketch."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, WIDTH)


def near_pairs(rows: DataFrame, least: int) -> DataFrame:
    """Of (src, dst, x, y, ...) the rows whose sketches x and y agree in `least` coordinates, as (src, dst)."""
    schema = pa.schema([("src", pa.binary()), ("dst", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array((grid(batch.column(2)) == grid(batch.column(3))).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], schema=schema)

    return rows.select("src", "dst", "x", "y").mapInArrow(run, "src binary, dst binary")


LEAF = pa.schema([("cell", pa.int64()), ("root", pa.int64()), ("roots", pa.list_(pa.int64())), ("set_id", pa.binary()), ("component", pa.binary()), ("sketch", pa.binary()), ("dst", pa.binary())])
LEAF_DDL = "cell long, root long, roots array<long>, set_id binary, component binary, sketch binary, dst binary"


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of complete cells from batches that are sorted by cell."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= COMPARE_ROWS or size >= COMPARE_BYTES:
            part = pa.Table.from_batches(held)
            cell = part.column("cell").to_numpy()
            whole = int(np.searchsorted(cell, cell[-1]))
            if whole:
                yield part.slice(0, whole)
                held = part.slice(whole).to_batches()
                rows, size = rows - whole, sum(x.nbytes for x in held)
    if rows:
        yield pa.Table.from_batches(held)


def candidates(part: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one cell, two and two, that agree in `least` coordinates and lie in different components.

    A row is compared with those 1, 2, ... places on as long as the cell lasts, for all cells at once. A pair counts only
    where `root` is the first of the roots that both have at one place; below the roots all are 0 and it always counts.
    """
    cell, root = part.column("cell").to_numpy(), part.column("root").to_numpy()
    roots = part.column("roots").combine_chunks().flatten().to_numpy().reshape(len(cell), -1)
    group = part.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
    sketch = grid(part.column("sketch"))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, len(cell)):
        same = cell[:-d] == cell[d:]
        if not same.any():
            break
        at = np.flatnonzero(same & (group[:-d] != group[d:]))
        for i in np.array_split(at, len(at) // 20_000 + 1):
            if len(i):
                both = (roots[i] == roots[i + d]) & (roots[i] != 0)
                i = i[roots[i, both.argmax(axis=1)] == root[i]]
            near = i[(sketch[i] == sketch[i + d]).sum(axis=1) >= least]
            left.append(near)
            right.append(near + d)
    return np.concatenate(left), np.concatenate(right)


def by_cell(leaves: DataFrame) -> DataFrame:
    return leaves.repartition("cell").sortWithinPartitions("cell")


def compare(leaves: DataFrame, least: int) -> DataFrame:
    """Candidate pairs of cells (cell, root, roots, set_id, component, sketch), as rows with set_id and dst.

    A cell with more than two pairs a row gives none; instead its rows that have a partner are returned, without dst,
    for `confirm_dense`. So the result has at most twice the rows of the leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_cells(batches):
            left, right = candidates(part, least)
            _, code = np.unique(part.column("cell").to_numpy(), return_inverse=True)
            dense = np.bincount(code[left], minlength=len(code)) > 2 * np.bincount(code, minlength=len(code))
            few = ~dense[code[left]]
            ids = part.column("set_id").combine_chunks()
            n = int(few.sum())
            empty = {f.name: pa.nulls(n, f.type) for f in LEAF}
            yield pa.RecordBatch.from_arrays(list((empty | {"set_id": ids.take(pa.array(left[few])), "dst": ids.take(pa.array(right[few]))}).values()), schema=LEAF)
            rows = np.unique(np.concatenate([left[~few], right[~few]]))
            if len(rows):
                kept = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), f.type) if f.name == "dst" else kept.column(f.name).combine_chunks().cast(f.type) for f in LEAF], schema=LEAF)

    return by_cell(leaves.select("cell", "root", "roots", "set_id", "component", "sketch")).mapInArrow(run, LEAF_DDL)


def confirm_dense(dense: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, least: int, s: Scratch) -> DataFrame:
    """Links (src, dst) in cells of many alike classes, confirmed on full sets inside the task; of links within one cell
    only those that join components further are returned."""
    needed = s.cut(classes.select("set_id", "doc_id", F.lit(3).alias("side")).join(dense.select("set_id").distinct(), "set_id"), "needed")
    sets = s.cut(full_sets(docs, needed, k), "sets")
    schema = pa.schema([("src", pa.binary()), ("dst", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_cells(batches):
            left, right = candidates(part, least)
            ids, items = part.column("set_id").to_pylist(), part.column("items").to_pylist()
            up: dict[object, object] = {}

            def root(x: object) -> object:
                while (y := up.get(x, x)) != x:
                    up[x] = x = up.get(y, y)
                return x

            cell, group = part.column("cell").to_pylist(), part.column("component").to_pylist()
            src, dst = [], []
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                a, b = root((cell[i], group[i])), root((cell[j], group[j]))
                if a != b and alike(items[i], items[j], percent):
                    up[a] = b
                    src.append(ids[i])
                    dst.append(ids[j])
            yield record({"src": src, "dst": dst}, schema)

    return by_cell(dense.join(sets.drop("side"), "set_id").select("cell", "root", "roots", "set_id", "component", "sketch", "items")).mapInArrow(run, "src binary, dst binary")


def in_one_task(edges: DataFrame) -> DataFrame:
    """(src, to) of few edges (src, dst): each vertex with the smallest of its component, if that is another."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[object, object] = {}

        def root(x: object) -> object:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((root(a), root(b)))
                up[high] = low
            ids = batch.column(0).type
        moved = [(x, y) for x in list(up) if (y := root(x)) != x]
        if moved:
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in moved], type=ids) for i in (0, 1)], names=["src", "to"])

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, f"src {kind}, to {kind}")


def children(rows: DataFrame, level: int, *carried: str) -> DataFrame:
    """(node, slot, set_id, sig) -> a row for each child. Roots (level 0) take BRANCH coordinates by their slot, which no
    other root takes; other nodes pick BRANCH different ones by their own hash. Columns named in carried stay."""
    if level == 0:
        picks = [F.pmod(F.col("slot") * BRANCH + j, F.lit(PATHS)) for j in range(BRANCH)]
    else:
        first = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(PATHS))
        picks = [first] + [(first + 1 + (j - 1) * ((PATHS - 1) // (BRANCH - 1)) + F.pmod(F.xxhash64("node", F.lit(level), F.lit(j)), F.lit((PATHS - 1) // (BRANCH - 1)))) % PATHS for j in range(1, BRANCH)]
    names = [F.struct(F.xxhash64("node", F.lit(level), p, F.get("sig", p.cast("int"))).alias("node"), (F.col("slot") * BRANCH + j).alias("slot")) for j, p in enumerate(picks)]
    return rows.select(F.explode(F.array(*names)).alias("c"), "set_id", *carried).select("c.node", "c.slot", "set_id", *carried)


def by_node(rows: DataFrame, table: DataFrame, s: Scratch | None, how: str = "inner", most: int | None = None) -> DataFrame:
    """rows joined with a table (node, ...). The table is written and its nodes counted: up to `most` (MOST_BROADCAST) it is
    broadcast; beyond that, or without a place to write to, the rows of a node are dealt over many tasks."""
    if s is not None:
        table = s.cut(table, "nodes")
        if table.count() <= (MOST_BROADCAST if most is None else most):
            return rows.join(F.broadcast(table), "node", how)
    return spread_join(rows, table, ["node"], ["set_id"], how)


def with_components(tree: DataFrame, joined: DataFrame, s: Scratch) -> DataFrame:
    """tree with `component` of each class and size `n` of its node, without nodes of one component."""
    known = tree.join(joined.withColumnRenamed("id", "set_id"), "set_id", "left").select("node", "slot", "set_id", F.coalesce("component", "set_id").alias("component"))
    sizes = known.groupBy("node").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return by_node(known, sizes.select("node", "n"), s)


def pivot_pairs(tree: DataFrame, salts: list[int], s: Scratch) -> DataFrame:
    """(node, src, dst, x, y) of (node, set_id, sketch): each class, dst, with the classes src that hashes pick in its node,
    and their sketches, which the rows bring along. A large node's rows are dealt over many tasks."""
    pick = tree.groupBy("node").agg(F.count("*").alias("n"), F.array_distinct(F.array(*[F.min_by(F.struct("set_id", "sketch"), F.xxhash64("set_id", F.lit(i))) for i in salts])).alias("picks"))
    rows = by_node(tree.select("node", "set_id", "sketch"), pick.filter("n > 1").select("node", "picks"), s, most=MOST_PIVOTS)
    rows = rows.select("node", F.explode("picks").alias("p"), F.col("set_id").alias("dst"), F.col("sketch").alias("y")).filter("p.set_id <> dst")
    return rows.select("node", F.col("p.set_id").alias("src"), "dst", F.col("p.sketch").alias("x"), "y")


def alike_nodes(known: DataFrame, classes: DataFrame, least: int, s: Scratch) -> DataFrame:
    """Nodes of more than SMALL classes of which a share of ALIKE agrees with a pivot in `least` coordinates, by a
    sample of every eighth class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("near", pa.int32())])
        for batch in batches:
            yield record({"node": batch.column(0), "near": ((grid(batch.column(1)) == grid(batch.column(2))).sum(axis=1) >= least).astype(np.int32)}, schema)

    sample = known.filter((F.col("n") > SMALL) & (F.xxhash64("set_id", "node") % 8 == 0))
    sample = s.cut(sample.select("node", "set_id").join(classes.select("set_id", "sketch"), "set_id"), "sample")
    near = pivot_pairs(sample, [-1], s).select("node", "x", "y").mapInArrow(run, "node long, near int")
    return near.groupBy("node").agg(F.avg("near").alias("share")).filter(F.col("share") >= ALIKE).select("node", F.lit(True).alias("alike"))


def linked_rows(docs: DataFrame, k: int, percent: int, recall: float, s: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id and key of every row (doc_id, text, key)."""
    rows = s.cut(signatures(docs, k), "signatures")
    usable = rows.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = s.cut(usable.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), "classes")
    similarity = percent / 100
    trees = trees_for(recall, similarity)
    least = max(1, math.floor(WIDTH * similarity - 4.2 * math.sqrt(WIDTH * similarity * (1 - similarity))))

    roots = classes.select("set_id", "sig", "sketch", F.lit(0).cast("long").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("slot"))
    shared = s.cut(children(roots, 0).groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"), "shared")
    n_shared = shared.count()
    if not n_shared:  # no two classes meet
        return rows.select("doc_id", "n_shingles", "set_id", "key").join(classes.select("set_id", F.col("doc_id").alias("least")), "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"), "key")
    tree = children(roots, 0, "sketch")
    tree = tree.join(F.broadcast(shared), "node") if n_shared <= MOST_BROADCAST else spread_join(tree, shared, ["node"], ["set_id"])

    stars = s.cut(near_pairs(pivot_pairs(tree, list(range(STARS)), s), least).distinct(), "stars")
    links = s.cut(confirmed(stars, docs, classes, k, percent, s), "links")
    joined = s.cut(connected_components(links, s, spread=False, finish=in_one_task, few=FEW_EDGES), "joined")

    leaves = None
    for level in range(1, DEPTH + 1):
        known = s.cut(with_components(tree, joined, s), "level")
        most = known.agg(F.max("n")).first()[0]
        if most is None:
            break
        last = level == DEPTH or most <= SMALL
        if last:
            known = known.withColumn("leaf", F.lit(True))
        else:
            known = by_node(known, alike_nodes(known, classes, math.floor(0.7 * least), s), s, "left").withColumn("leaf", (F.col("n") <= SMALL) | F.coalesce("alike", F.lit(False)))
        leaf = known.filter("leaf")
        if level == 1:  # all pairs of these roots are compared, so one of the roots that a pair shares is enough
            own = leaf.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), "node"))).alias("own"))
            shared_roots = F.transform(F.sequence(F.lit(0), F.lit(trees * BRANCH - 1)), lambda i: F.coalesce(F.try_element_at("own", i), F.lit(0)))
            leaf = s.cut(leaf.join(own.select("set_id", shared_roots.alias("roots")), "set_id").withColumn("root", F.col("node")), "leaf")
        else:
            leaf = leaf.withColumn("roots", F.array_repeat(F.lit(0).cast("long"), trees * BRANCH)).withColumn("root", F.lit(0).cast("long"))
        part = s.cut(cells(leaf, most > BLOCK, s), "leaves")
        leaves = part if leaves is None else leaves.unionByName(part)
        if last:
            break
        big = known.filter(~F.col("leaf")).select("node", "slot", "set_id").join(classes.select("set_id", "sig"), "set_id")
        tree = children(big, level)
    if leaves is not None:
        found = s.cut(compare(leaves.join(classes.select("set_id", "sketch"), "set_id"), least), "pairs")
        pairs = found.filter("dst is not null").select(F.least("set_id", "dst").alias("src"), F.greatest("set_id", "dst").alias("dst")).distinct()
        links = links.unionByName(confirmed(s.cut(pairs, "pairs"), docs, classes, k, percent, s))
        dense = found.filter("dst is null")
        if not dense.isEmpty():
            links = links.unionByName(confirm_dense(dense, docs, classes, k, percent, least, s))
    linked = s.cut(connected_components(links, s, spread=False, finish=in_one_task, few=FEW_EDGES), "linked")

    owner = classes.join(linked, F.col("set_id") == F.col("id")).groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = spread_join(linked, owner, ["component"], ["id"]).select(F.col("id").alias("set_id"), "least")
    known = classes.select("set_id", "doc_id").join(linked, "set_id", "left").select("set_id", F.coalesce("least", "doc_id").alias("least"))
    out = spread_join(rows.select("doc_id", "n_shingles", "set_id", "key"), known, ["set_id"], ["doc_id"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"), "key")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"))


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, recall: float = 1 - 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id) of every row.

    Rows with no word link to nothing. Rows with a null id link to nothing, have a null component and are kept.
    Repeated rows share a class; rows that share an id share its component only if their sets are linked. An empty
    table gives an empty result; other columns are ignored. recall is what the number of trees is reckoned from.
    """
    with Scratch(docs.sparkSession) as s:
        rows = linked_rows(keyed(docs, id_col, text_col), k, percent, recall, s)
        return s.keep(rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "near")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = 1 - 1e-6) -> DataFrame:
    """The rows of docs, with all their columns, that are alone in their component or have its smallest id.

    Of rows of one id in one component one stays. A row goes by its id and text, so another text under the same id is
    judged by itself. Rows without id or words stay.
    """
    with Scratch(docs.sparkSession) as s:
        found = s.cut(linked_rows(keyed(docs), k, percent, recall, s).filter("n_shingles > 0 and doc_id is not null"), "near")
        kept = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
        kept = s.cut(kept.filter("n > 1"), "twice")  # one id more than once in its component
        others = found.join(kept.select("doc_id", "first"), "doc_id").filter("doc_id = component_id and key <> first")
        gone = s.keep(found.filter("doc_id <> component_id").select("doc_id", "key").unionByName(others.select("doc_id", "key")).distinct(), "gone")
        again = s.keep(kept.select("doc_id", "first"), "again")
    few = gone.count() <= MOST_BROADCAST
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    left = docs.join(F.broadcast(gone) if few else gone, (docs["doc_id"].cast("long") == gone["_id"]) & (key == gone["_key"]), "left_anti")
    if again.isEmpty():
        return left
    same = (left["doc_id"].cast("long") == again["doc_id"]) & (F.unhex(F.md5(F.coalesce(left["text"], F.lit("")))) == again["first"])
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def cells(leaf: DataFrame, large: bool = True, s: Scratch | None = None) -> DataFrame:
    """Leaves (node, n, root, roots, set_id, component) as cells. The classes of a leaf of more than BLOCK are dealt into
    blocks, those of its largest component apart from the others, and every pair of blocks that may hold different
    components becomes a cell. So no task holds more than two blocks of a leaf, and a family that is joined already is
    copied once for each block of classes outside it."""
    names = ["root", "roots", "set_id", "component"]
    if not large:
        return leaf.select(F.col("node").alias("cell"), *names)
    crowd = leaf.filter(F.col("n") > BLOCK)
    sizes = crowd.groupBy("node", "component").agg(F.count("*").alias("m"))
    main = sizes.groupBy("node").agg(F.max(F.struct("m", "component")).alias("main"))
    rows = by_node(crowd, main, s)
    others, inner = (F.ceil(c / BLOCK).cast("int") for c in (F.col("n") - F.col("main.m"), F.col("main.m")))
    inside = F.col("component") == F.col("main.component")
    own = F.when(inside, others + F.pmod(F.xxhash64("set_id", F.lit(5)), inner)).otherwise(F.pmod(F.xxhash64("set_id", F.lit(5)), others)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others + F.when(inside, 0).otherwise(inner) - 1)))
    dealt = rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *names)
    return leaf.filter(F.col("n") <= BLOCK).select(F.col("node").alias("cell"), *names).unionByName(dealt)

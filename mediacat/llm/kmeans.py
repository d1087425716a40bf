"""Centroid clustering by sort-means, in whole numbers.

Every round orders, for each centroid, the others by their distance from it. A vector starts at its previous centroid and
walks that order; it stops at the first one strictly farther from the previous centroid than twice the vector's own
distance to it, since by the triangle inequality none from there on can be nearer or as near. A round is one pass: it
writes the vectors with their new assignment and, beside them, the sums of each task; the driver only gets the sums of
each cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import Scratch, map_batches, record
from mediacat.llm.vectors import group_sums, matrix, products, totals, whole_vectors

SCHEMA = pa.schema([("is_sum", pa.bool_()), ("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
DDL = "is_sum boolean, vec_id long, x array<int>, cluster int, distance long, n long, sums array<long>"


def sort_means(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many distances were computed."""
    norm, norms = (x * x).sum(axis=1), (centroids * centroids).sum(axis=1)
    between = norms[:, None] - 2 * products(centroids, centroids) + norms[None, :]
    cluster, distance = previous.copy(), np.empty(len(x), np.int64)
    computed = 0
    for a in np.unique(previous).tolist():
        rows = np.flatnonzero(previous == a)
        own = norm[rows] - 2 * products(x[rows], centroids[a : a + 1])[:, 0] + norms[a]
        order = np.argsort(-own, kind="stable")  # those that walk farthest come first
        rows, own = rows[order], own[order]
        best, at = own.copy(), np.full(len(rows), a, previous.dtype)
        others = np.argsort(between[a], kind="stable")
        others = others[others != a]
        walking = np.searchsorted(-4 * own, -between[a, others], side="right")  # rows with between <= 4 * own
        computed += len(rows) + int(walking.sum())
        for j, m in zip(others.tolist(), walking.tolist(), strict=True):
            if m == 0:
                break
            d = norm[rows[:m]] - 2 * products(x[rows[:m]], centroids[j : j + 1])[:, 0] + norms[j]
            nearer = (d < best[:m]) | (d == best[:m]) & (j < at[:m])
            best[:m][nearer] = d[nearer]
            at[:m][nearer] = j
        cluster[rows], distance[rows] = at, best
    return cluster, distance, computed


def assigned(rows: DataFrame, centroids: np.ndarray, last: bool) -> DataFrame:
    """rows (vec_id, x, cluster) with new clusters and distances (the last time without x), and for each task and cluster a
    row of sums."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x = matrix(batch.column(1), size)
            cluster, distance, _ = sort_means(x, batch.column(2).to_numpy(), centroids)
            n += np.bincount(cluster, minlength=k)
            np.add.at(far, cluster, distance)
            sums += group_sums(cluster, x, k)
            none = [None] * len(x)
            yield record({"is_sum": [False] * len(x), "vec_id": batch.column(0), "x": none if last else batch.column(1), "cluster": cluster, "distance": distance, "n": none, "sums": none}, SCHEMA)
        full = np.flatnonzero(n)
        none = [None] * len(full)
        yield record({"is_sum": [True] * len(full), "vec_id": none, "x": none, "cluster": full, "distance": far[full], "n": n[full], "sums": list(sums[full])}, SCHEMA)

    return map_batches(rows.select("vec_id", "x", "cluster"), run, DDL)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of `size` finite components.

    Components become floor(256 * x). Centroids start as the k vectors with the smallest sha256 of `seed:id`; of equal ids
    the smaller vector comes first. Rows with a null id are clustered but start no centroid; if fewer rows have an id,
    there are fewer centroids, and without any the result is empty. Repeated rows are rows of their own. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, vec_col, size, vec_id=F.col(id_col).cast("long"))
    named = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    start = rows.filter("vec_id IS NOT NULL").orderBy(F.sha2(named, 256), "x").select("x").limit(k).collect()
    centroids = np.array([r["x"] for r in start], np.int64).reshape(-1, size)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = rows.withColumn("cluster", F.lit(0))
    with Scratch(spark) as s:
        for turn in range(rounds + 1):
            last = turn == rounds
            done = (s.keep if last else s.cut)(assigned(rows, centroids, last), "clustered", by=["is_sum"])
            rows = done.filter("NOT is_sum").select("vec_id", "x", "cluster", "distance")
            sums = done.filter("is_sum")
            stats = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance")).collect()  # k rows at most
            if not last:
                n = {r["cluster"]: r["n"] for r in stats}
                for r in totals(sums, "cluster").collect():  # k * size rows at most
                    centroids[r["cluster"], r["i"]] = int(r["total"]) // n[r["cluster"]]
    inertia = sum(r["distance"] for r in stats)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    stats = spark.createDataFrame([(r["cluster"], r["distance"], inertia, digest[r["cluster"]]) for r in stats], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

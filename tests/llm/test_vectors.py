"""Clustering, product codes and top-k of vectors against brute force in plain integers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from mediacat.llm import kmeans, topk, vacodes, vectors

DDL = "vec_id long, embedding array<double>, label int, cluster int, x string, place string"


def vector_rows(seed, size, n):
    """Clusters, ties, repeated rows and ids, nulls, odd lengths, columns with the operators' own names."""
    rng = random.Random(seed)
    centers = [[rng.uniform(-2, 2) for _ in range(size)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centers)], i % 3 or None) for i in range(n)]
    rows += [(n + i, [0.25] * size, 1) for i in range(n // 3)]  # one hot vector
    rows += [(i, [float(rng.randrange(-1, 2)) for _ in range(size)], 2) for i in range(2 * n, 2 * n + 40)]  # many ties
    rows += rows[:5] + [(3, [0.5] * size, 7), (None, [0.1] * size, 7)]
    rows += [(9000, None, 1), (9001, [math.nan] * size, 1), (9002, [math.inf] + [0.0] * (size - 1), 1), (9003, [None] + [0.0] * (size - 1), 1), (9004, [], 1), (9005, [1.5] * (size - 1), None), (9006, [-1 / 300] * size, None)]
    rng.shuffle(rows)
    return [(*r, 5, "x", "y") for r in rows]


def whole(v):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(256 * c) for c in v]


def far(a, b):
    return sum((p - q) ** 2 for p, q in zip(a, b, strict=True))


def nearest(x, centers):
    return min((far(x, c), j) for j, c in enumerate(centers))


def means(centers, given):
    """given: (number of center, vector)."""
    groups = defaultdict(list)
    for j, x in given:
        groups[j].append(x)
    return [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else old for j, old in enumerate(centers)]


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("k", "n"), [(7, 120), (400, 60)])
def test_clusters(spark, k, n):
    rows = vector_rows(1, 8, n)
    good = [(i, x) for i, v, *_ in rows if (x := whole(v)) is not None and len(x) == 8]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in good if i is not None)
    centers = [x for _, x in start[:k]]
    for _ in range(3):
        centers = means(centers, [(nearest(x, centers)[1], x) for _, x in good])
    end = [(i, *nearest(x, centers)[::-1]) for i, x in good]
    inertia = defaultdict(int)
    for _, j, d in end:
        inertia[j] += d
    want = [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, j, d in end]
    same(kmeans.cluster(spark.createDataFrame(rows, DDL).repartition(3), k=k, rounds=3, size=8).collect(), want)


def test_sort_means_skips_and_agrees():
    rng = np.random.default_rng(2)
    centers = rng.integers(-500, 500, (40, 16))
    x = centers[rng.integers(0, 40, 3000)] + rng.integers(-30, 30, (3000, 16))
    x[:40], centers[5] = centers, centers[9]
    previous = rng.integers(0, 40, 3000).astype(np.int32)
    every = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    cluster, distance, _ = kmeans.sort_means(x, previous, centers)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    again, _, computed = kmeans.sort_means(x, cluster, centers)
    assert (again == cluster).all() and computed < 0.2 * every.size


def test_codes(spark):
    rows = vector_rows(3, 8, 150)
    good = [(i, x, label) for i, v, label, *_ in rows if (x := whole(v)) is not None and len(x) == 8]
    start = sorted((i, x) for i, x, _ in good if i is not None)[:20]
    cut = lambda x: [x[2 * p : 2 * p + 2] for p in range(4)]
    books = [[cut(x)[p] for _, x in start] for p in range(4)]
    for _ in range(2):
        books = [means(b, [(nearest(cut(x)[p], b)[1], cut(x)[p]) for _, x, _ in good]) for p, b in enumerate(books)]
    end, by_label = [], defaultdict(int)
    for i, x, label in good:
        found = [nearest(part, b) for part, b in zip(cut(x), books, strict=True)]
        end.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by_label[label] += end[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    want = [(i, code, error, by_label[label], digest) for i, code, error, label in end]
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    same(vacodes.product_codes(docs, parts=4, entries=20, size=8).collect(), want)
    vacodes.MOST_BROADCAST, before = 0, vacodes.MOST_BROADCAST
    try:
        same(vacodes.product_codes(docs, parts=4, entries=20, size=8).collect(), want)
    finally:
        vacodes.MOST_BROADCAST = before


@pytest.mark.parametrize("n", [1, 3, 64, 200])
def test_va_file_filters_and_agrees(n):
    rng = np.random.default_rng(n)
    entries, x = rng.integers(-300, 300, (n, 4)), rng.integers(-400, 400, (2000, 4))
    entries[n // 2] = entries[0]
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    entry, distance, computed = vacodes.VAFile(entries).nearest(x)
    assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert n < 64 or computed < 0.25 * every.size


@pytest.mark.parametrize(("block", "chunk", "group"), [(4, 3, 1), (128, 128, 32)])
def test_top_k(spark, monkeypatch, block, chunk, group):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("GROUP", group), ("PIVOTS", 8)):
        monkeypatch.setattr(topk, name, value)
    rows = vector_rows(4, 8, 160)
    good = [(i, x + [0] * (8 - len(x))) for i, v, *_ in rows if i is not None and (x := whole(v)) is not None]
    want = []
    for a, (i, x) in enumerate(good):
        if i % 10 == 0:
            found = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j) for b, (j, y) in enumerate(good) if a != b)
            want += [(i, r, j, -s) for r, (s, j) in enumerate(found[:5], 1)]
    same(topk.top_k(spark.createDataFrame(rows, DDL).repartition(3), every=10).drop("scored").collect(), want)


def test_search_leaves_blocks_out():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.integers(-300, 300, (50, 16)), 20, axis=0) + rng.integers(-9, 9, (1000, 16))
    part = topk.pa.Table.from_pylist([{"block": b, "ids": list(range(20 * b, 20 * b + 20)), "places": list(range(20 * b, 20 * b + 20)), "x": x[20 * b : 20 * b + 20].ravel().tolist(), "low": x[20 * b : 20 * b + 20].min(axis=0).tolist(), "high": x[20 * b : 20 * b + 20].max(axis=0).tolist()} for b in range(50)])
    part = part.set_column(part.column_names.index("x"), "x", part.column("x").cast(topk.pa.list_(topk.pa.int32())))
    queries = x[::25]
    (q, score, ids), scored = topk.search(queries, np.arange(0, 1000, 25), np.full(40, topk.LOWEST), topk.Blocks(part, 16), 5)
    every = queries @ x.T
    every[np.arange(40), np.arange(0, 1000, 25)] = topk.LOWEST + 1
    want = np.argsort(-every, axis=1, kind="stable")[:, :5]
    assert (ids.reshape(40, 5) == want).all() and (score.reshape(40, 5) == np.take_along_axis(every, want, axis=1)).all()
    assert scored < 0.2 * 40 * 50


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([], DDL)
    two = spark.createDataFrame([(0, [1.0] * 64, None, 1, "", ""), (50, [2.0] * 64, None, 1, "", "")], DDL)
    odd = spark.createDataFrame([(None, [1.0] * 64, None, 1, "", ""), (1, None, 1, 1, "", "")], DDL)
    for run in (kmeans.cluster, vacodes.product_codes, topk.top_k):
        assert run(none).count() == run(odd).count() == 0
        assert run(none).columns == run(two).columns
    assert [r["cluster"] for r in kmeans.cluster(two).orderBy("vec_id").collect()] == ([0, 1] if hashlib.sha256(b"2:0").hexdigest() < hashlib.sha256(b"2:50").hexdigest() else [1, 0])
    assert [tuple(r)[:4] for r in vacodes.product_codes(two).orderBy("vec_id").collect()] == [(0, "00" * 16, 0, 0), (50, "01" * 16, 0, 0)]
    assert [tuple(r)[:4] for r in topk.top_k(two).orderBy("query_id").collect()] == [(0, 1, 50, 64 * 256 * 512), (50, 1, 0, 64 * 256 * 512)]


def test_large_components():
    a = np.array([[vectors.MOST - 1, -vectors.MOST], [1, 2]])
    assert vectors.products(a, a).tolist() == [[sum(p * q for p, q in zip(x, y, strict=True)) for y in a.tolist()] for x in a.tolist()]

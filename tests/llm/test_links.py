"""Near duplicates, components, URL filters and revisits against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediacat.llm import neardup, revisit, urls
from mediacat.llm.common import Scratch, shared_dir
from mediacat.llm.components import connected_components
from mediacat.llm.queries import URL_RULES, op8_url_filters


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.mark.parametrize("few", [0, 25, 10_000])
def test_components(spark, few):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(60)]
    star = [(199, 100 + i) for i in range(40)]
    mixed = [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(60)]
    edges = [*path, *star, *mixed, (301, 301), (302, 303), (303, 302), (302, 303), (None, 304), (305, None)]
    groups = Groups()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            groups.join(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark), finish=neardup.in_one_task, few=few).collect()}
    assert got == {x: groups.find(x) for x in groups.up}
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark), finish=neardup.in_one_task, few=few).count() == 0


def brute_near(texts, ids, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    groups = Groups()
    for i in range(len(texts)):
        for j in range(i):
            if ids[i] is not None and ids[j] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                groups.join(ids[i], ids[j])
    return [(i, len(s), i if i is None else groups.find(i)) for i, s in zip(ids, sets, strict=True)]


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(4))
    texts = []
    line = " ".join(word() for _ in range(20))
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            other = list(base)
            for _ in range(rng.randrange(0, 4)):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other).upper() if rng.random() < 0.2 else " ".join(other))
    hot = [word() for _ in range(200)]
    for i in range(60):
        other = list(hot)
        other[i * 3] = word()
        texts.append(" ".join(other))
    texts += [f"{line} {' '.join(word() for _ in range(30))}" for _ in range(30)]
    return [*texts, texts[0], texts[0], None, "", " \n", "a", "A", "a b c", "a b c d e", "long " * 30_000]


@pytest.mark.parametrize(("small", "block", "most"), [(64, 512, 10**6), (3, 8, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small, block, most):
    for name, value in (("SMALL", small), ("BLOCK", block), ("MOST_BROADCAST", most)):
        monkeypatch.setattr(neardup, name, value)
    texts = corpus()
    ids = [1000 - i for i in range(len(texts))]
    ids[7] = None
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, set_id string, component_id int").repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(brute_near(texts, ids, 4, 80), key=repr)


def test_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*(f"x{j}" for j in range(9 * i)), *words[9 * i :]]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert [(i, got[i]) for i in range(20)] == [(i, c) for i, _, c in brute_near(texts, list(range(20)), 4, 80)]


def test_words_of_equal_polynomial_hashes_are_not_linked(spark):
    def doubled(times, a, b):
        text = a
        for _ in range(times):
            text += text.translate(str.maketrans(a + b, b + a))
        return text

    texts = [f"x y z {doubled(n, *order)}" for n in (10, 12) for order in ("ae", "ea")]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i) for i in range(4)]


def test_words_of_equal_chained_names_are_not_linked(spark):
    """Words of 16 bytes whose chained 64-bit mixes are equal: for any first half there is such a second half."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh0123!.>-") for _ in range(n))
    texts = ["x y z i-eqh524:yng5by1", "x y z !m3.girer5tfi>-="] + [f"x y z {text(n)}" for n in (16, 24, 64, 65) for _ in range(20)]
    shingles = neardup.shingle_sets(texts, 4)
    assert len({x.tobytes() for x in shingles}) == len({x[0, 0] for x in shingles}) == len({x[0, 1] for x in shingles}) == len(texts)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)


def test_links_are_confirmed_on_both_numbers_of_a_shingle():
    x = np.arange(40, dtype=np.uint64).reshape(-1, 2)
    y = x.copy()
    y[:, 1] += np.uint64(1)
    assert neardup.alike(neardup.packed(x), neardup.packed(x), 80) and not neardup.alike(neardup.packed(x), neardup.packed(y), 80)
    large = np.arange(400, dtype=np.uint64).reshape(-1, 2)
    for cut in (161, 160, 159, 60, 50):  # across the size up to which both numbers are kept
        one, two = neardup.packed(large), neardup.packed(large[:cut])
        assert neardup.alike(one, two, 80) == neardup.alike(two, one, 80) == (100 * cut >= 80 * 200)
        assert neardup.alike(neardup.packed(large[:70]), neardup.packed(large[: min(cut, 60)]), 80) == (min(cut, 60) >= 56)


def test_recall_of_the_branching(spark):
    """Pairs whose coordinates agree with chance 0.8: the share that some node of a level holds together."""
    rng, n = np.random.default_rng(4), 20_000
    one = rng.integers(0, 2**31, (n, neardup.PATHS))
    two = np.where(rng.random(one.shape) < 0.8, one, rng.integers(0, 2**31, one.shape))
    rows = [(2 * i + k, x.tolist()) for i in range(n) for k, x in enumerate((one[i], two[i]))]
    sets = spark.createDataFrame(rows, "set_id long, sig array<int>")
    trees = neardup.trees_for(1 - 1e-6, 0.8)
    tree = sets.select("set_id", "sig", F.lit(0).cast("long").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("slot"))
    recall = []
    s = Scratch(spark)
    for level in range(neardup.DEPTH):
        tree = s.cut(neardup.children(tree, level), "recall")
        met = tree.groupBy("node", (F.floor(F.col("set_id") / 2)).alias("pair")).agg(F.count_distinct("set_id").alias("ends")).filter("ends = 2").select("pair").distinct().count()
        recall.append(met / n)
        tree = tree.join(sets, "set_id")
    assert recall[0] == 1.0 and min(recall) >= 0.9999, recall


def test_large_leaf_is_not_squared(spark):
    """One family that is joined but for one class is copied once, whatever its size; all pairs across components meet."""
    n = 5 * neardup.BLOCK
    rows = [(1, n, 0, [0], i.to_bytes(4, "big"), b"a" if i else b"b") for i in range(n)] + [(2, 40, 0, [0], b"x", b"y")]
    leaf = spark.createDataFrame(rows, "node long, n long, root long, roots array<long>, set_id binary, component binary")
    got = neardup.cells(leaf)
    assert got.count() == (n - 1) + (1 + 5) + 1  # the lone class meets its own block and five others
    mixed = [(1, n, 0, [0], i.to_bytes(4, "big"), b"abc"[i % 3 : i % 3 + 1]) for i in range(n)]
    cells_of = neardup.cells(spark.createDataFrame(mixed, leaf.schema)).groupBy("set_id").agg(F.collect_set("cell").alias("cells")).collect()
    where = {int.from_bytes(r["set_id"], "big"): set(r["cells"]) for r in cells_of}
    rng = random.Random(2)
    assert all(where[a] & where[b] for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(3000)) if a % 3 != b % 3)


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    before = set(Path(shared_dir(spark)).glob("scratch-*"))
    neardup.near_duplicates(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")).count()
    assert set(Path(shared_dir(spark)).glob("scratch-*")) == before


def test_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base), (5, base + " z"), (5, "another text that stands alone here"), (1, base + " y"), (7, "q w e r t y"), (7, "q w e r t y")]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(map(tuple, kept))
    assert (5, "another text that stands alone here") in got and (7, "q w e r t y") in got and len(got) == 3 and got[0][0] == 1


def test_keep_first(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(5, base, "a"), (3, base + " z", "b"), (3, base + " z", "c"), (9, "other text of some words here", "d"), (None, base, "e"), (7, "", "f"), (8, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([3, 9, None, 7, 8], key=repr)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.keep_first(docs.limit(0)).count() == 0


def test_recall_parameters():
    assert neardup.survival(0.8, 1) == pytest.approx(0.96)
    n = neardup.trees_for(1 - 1e-6, 0.8)
    assert (1 - neardup.survival(0.8, neardup.DEPTH)) ** n <= 1e-6
    sets = neardup.shingle_sets(["a b c d e", "A B c D e", "a b"], 4)
    assert len(sets[0]) == 2 and np.array_equal(sets[0], sets[1]) and len(sets[2]) == 1


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def link(url):
    return f'<html><head><LINK Rel="canonical" data-x=1 HREF="{url}"></head></html>'


PAGES = [
    ("http://a.example.com/en/1", ""), ("https://a.example.com/en/7", ""), ("https://EXAMPLE.com/en/77?q=/de/", ""), ("https://x.net/de/8", ""), ("https://b.example.net/de/8", ""), ("https://x.netx/de/8", ""), ("https://x.org/es/", ""), ("https://x.org/ES/", ""),
    (None, ""), ("no scheme", ""), ("", ""), ("http://", ""), ("http://com/en/", ""), ("http://com?x=/en/", ""), ("x://y://z.com/en/", ""),
    ("http://alias.test/a", link("https://a.example.com/en/1#top")), ("http://second.test/b", '<meta http-equiv="refresh" content="0; url=http://alias.test/a">'), ("http://third.test/c", link("//second.test/b")), ("http://saved.test/d", link("https://a.example.com/en/7")),
    ("http://both.test/e", link("http://alias.test/a2") + link("https://a.example.com/en/7")), ("http://alias.test/a2", link("/a3")), ("http://alias.test/a3", link("http://x.org/es/1")), ("http://free.test/", link("http://free.test/other")), ("http://rel.test/x/y", link("z")), ("http://rel.test/x/z", link("http://x.net/de/?a&amp;b")),
]


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(PAGES)] + [(0, PAGES[0][0], None, "x")], "page_id long, url string, html string, rule string").repartition(3)
    rows = urls.filter_urls(pages, URL_RULES).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(PAGES) + 1
    for i, (u, _) in enumerate(PAGES):
        assert (got[i]["host"], got[i]["path"]) == brute_host_path(u), u
        fits = [r for r in URL_RULES if (got[i]["host"] == r.host or got[i]["host"].endswith("." + r.host)) and got[i]["path"].startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert got[i]["rule"] == (best.name if best else None)
        if best:
            assert got[i]["verdict"] == best.verdict
    verdict = {PAGES[i][0]: got[i]["verdict"] for i in got}
    assert [verdict[f"http://{x}"] for x in ("alias.test/a", "second.test/b", "third.test/c")] == ["block"] * 3
    assert [verdict[f"http://{x}"] for x in ("saved.test/d", "both.test/e", "alias.test/a2", "alias.test/a3", "free.test/")] == ["allow"] * 5
    assert verdict["http://rel.test/x/y"] == "block" and verdict[None] == "allow"
    extra = spark.createDataFrame([("http://free.test/", "http://x.org/es/9")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, URL_RULES, extra).collect()}[PAGES.index(("http://free.test/", link("http://free.test/other")))] == "block"
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    """The word of each rule, written out here: alone, on a subdomain, and where a longer rule overrules it."""
    want = {
        "http://com/en/": ("com/en/", "block"), "http://x.example.com/en/6": ("com/en/", "block"), "http://x.example.com/en/77": ("example.com/en/7", "allow"), "http://net/de/": ("net/de/", "allow"), "http://x.net/de/8": ("net/de/", "allow"), "http://x.example.net/de/7": ("net/de/", "allow"),
        "http://x.example.net/de/81": ("example.net/de/8", "block"), "http://x.org/es/": ("org/es/", "block"), "http://x.org/en/": (None, "allow"),
    }
    spark.createDataFrame([(i, u, "") for i, u in enumerate(want)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op8_url_filters(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_propagation_over_hubs_chains_and_a_giant_component(spark):
    """100,000 edges: a hub, long chains and a giant random component, against union-find."""
    rng = random.Random(5)
    name = lambda i: f"http://h{i % 997}.test/p{i}"
    edges = [(0, i) for i in range(1, 30_000)]  # hub
    edges += [(i, i + 1) for i in range(100_000, 101_500)] + [(i, i + 1) for i in range(102_000, 102_300)]  # chains
    edges += [(200_000 + rng.randrange(30_000), 200_000 + rng.randrange(30_000)) for _ in range(68_200)]  # giant
    groups = Groups()
    for a, b in edges:
        if a != b:
            groups.join(a, b)
    blocked, allowed = {7: "http://x.org/es/a", 100_900: "http://y.com/en/1", 200_001: "http://z.net/de/"}, {100_901: "http://example.com/en/7"}
    seeds = blocked | allowed
    links = [(name(a), name(b)) for a, b in edges] + [(name(i), u) for i, u in seeds.items()]
    decided = {}
    for i in blocked:
        decided[groups.find(i)] = "block"
    for i in allowed:
        decided[groups.find(i)] = "allow"
    ids = sorted({*rng.sample(range(30_000), 200), *range(100_000, 101_500, 50), *range(102_000, 102_300, 50), *rng.sample(range(200_000, 230_000), 200)})
    pages = spark.createDataFrame([(i, name(i), "") for i in ids], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, URL_RULES, spark.createDataFrame(links, "src string, dst string")).collect()}
    assert len(edges) >= 100_000 - 1 and got == {i: decided.get(groups.find(i), "allow") for i in ids}
    assert set(got.values()) == {"allow", "block"}


CAPTURES = "record_id long, url string, ts long, status int, headers map<string,string>, digest string"


def brute_revisits(rows, canonical):
    out = {}
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for rid, _, ts, status, headers, digest in rows:
        key = canonical[rid]
        if status == 200:
            out[rid] = ("full", rid, digest, low(headers) if headers is not None else None)
        elif status != 304:
            out[rid] = ("other", None, None, None)
        else:
            old = max((r for r in rows if r[3] == 200 and key is not None and ts is not None and r[2] is not None and canonical[r[0]] == key and r[2] < ts), key=lambda r: (r[2], r[0]), default=None)
            if old is None:
                out[rid] = ("orphan", None, None, None)
                continue
            a, b = low(headers), low(old[4])
            state = "unvalidated"
            if "etag" in a and "etag" in b:
                state = "resolved" if re.sub("^[Ww]/", "", a["etag"].strip()) == re.sub("^[Ww]/", "", b["etag"].strip()) else "mismatch"
            elif "last-modified" in a and "last-modified" in b:
                state = "resolved" if a["last-modified"] == b["last-modified"] else "mismatch"
            merged = b | {k: v for k, v in a.items() if k not in revisit.KEPT_HEADERS}
            out[rid] = (state, old[0], old[5], merged) if state != "mismatch" else (state, None, None, None)
    return out


@pytest.mark.parametrize("blocks", [1, 4, 64])
def test_revisits_equal_brute_force(spark, blocks):
    rng = random.Random(11)
    sites = ["http://www.A.com/x/", "https://a.com/x?utm_source=q#f", "https://a.com/x?b=2&a=1", "http://a.com:80/x?a=1&b=2&ref=z", "http://b.org", "bad", None, "https://b.org/"]
    rows = []
    for i in range(400):
        status = rng.choice([200, 304, 304, 404])
        tags = {"ETag": rng.choice(['"1"', 'W/"1"', '"2"']), "Last-Modified": rng.choice(["x", "y"]), "Content-Type": f"t{i}", "Age": str(i)}
        headers = {k: v for k, v in tags.items() if rng.random() < 0.7}
        rows.append((i, sites[0] if rng.random() < 0.4 else rng.choice(sites), rng.randrange(60), status, headers, f"d{i}" if status == 200 else None))
    rows += [(400, sites[0], None, 304, {}, None), (401, sites[0], 100, 304, None, None), (402, sites[0], 99, 200, None, "n"), (403, sites[0], 50, None, {}, None)]
    df = spark.createDataFrame(rows, CAPTURES).withColumn("state", F.lit("x")).withColumn("key", F.lit(1)).repartition(4)
    canonical = {r["record_id"]: r["c"] for r in df.select("record_id", revisit.canonical(F.col("url")).alias("c")).collect()}
    assert canonical[next(r[0] for r in rows if r[1] == sites[2])] == canonical[next(r[0] for r in rows if r[1] == sites[3])] == "a.com/x?a=1&b=2"
    got = {r["record_id"]: (r["state"], r["source_id"], r["digest"], r["headers"]) for r in revisit.resolve_revisits(df, blocks).collect()}
    want = brute_revisits(rows, canonical)
    for k, v in want.items():
        state, source, digest, headers = got[k]
        assert (state, source, digest) == v[:3], k
        assert (headers or {}) == (v[3] or {}), k
    assert len(got) == len(rows)


def test_revisits_empty_and_repeated(spark):
    none = spark.createDataFrame([], CAPTURES)
    assert revisit.resolve_revisits(none).count() == 0
    rows = [(1, "http://a.b/", 1, 200, {}, "d"), (2, "http://a.b", 2, 304, {}, None), (2, "http://a.b", 2, 304, {}, None), (None, "http://a.b", 3, 304, {}, None)]
    got = sorted(((r["record_id"], r["state"], r["source_id"]) for r in revisit.resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()), key=repr)
    assert got == sorted([(1, "full", 1), (2, "unvalidated", 1), (2, "unvalidated", 1), (None, "unvalidated", 1)], key=repr)

"""The pipeline on a small corpus: every stage against brute force on its own input."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from mediacat.llm import quality
from mediacat.llm.common import Scratch

from test_links import brute_near
from test_text_operators import brute_rules, check_packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for i in range(120):
        text = prose(rng.randrange(80, 400))
        rows.append((" ".join(text), 1))
        if i % 6 == 0:
            text[5] = "changed"
            rows.append((" ".join(text), 1))
        if i % 10 == 0:
            rows.append((rows[-1][0], 1))
        if i % 5 == 0:
            rows.append((" ".join(w + "%%%" for w in prose(120)), 0))
        if i % 9 == 0:
            rows.append((" ".join(prose(20)), 1))
    rows += [(None, 1), ("", 1), ("loop again and " * 100, 0)]
    root = tmp_path_factory.mktemp("sf")
    ddl = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _gone long"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), False, 1) for i, (t, _) in enumerate(rows)], ddl).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(rows) if i % 3], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root), rows


def test_stages(spark, folder):
    root, rows = folder
    cut = Scratch(spark).cut
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near duplicates", "packing"]
    good, clean, first, pack = (f for _, f in corpus_pipeline.STAGES)
    one = cut(good(spark, docs, root), "one")
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    assert one.columns == columns and set(texts) == {r["doc_id"] for r in quality.score(docs, spark.read.parquet(f"{root}/labels.parquet")).filter("kept").collect()}
    junk = {i for i, (t, _) in enumerate(rows) if "%%%" in (t or "")}
    assert {i for i, (_, q) in enumerate(rows) if q} <= set(texts) and len(junk & set(texts)) <= 0.7 * len(junk)  # few labels: a wide margin
    two = cut(clean(spark, one, root), "two")
    kept = {r["doc_id"] for r in two.collect()}
    assert two.columns == columns and kept == {i for i, t in texts.items() if brute_rules(t)[-1]}
    three = cut(first(spark, two, root), "three")
    ids = sorted(kept)
    want = {i for i, _, c in brute_near([rows[i][0] for i in ids], ids, 5, 80) if i == c}
    assert three.columns == columns and sorted(r["doc_id"] for r in three.collect()) == sorted(want)
    packed = pack(spark, three, root).collect()
    check_packing(packed, {i: rows[i][0] for i in want}, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 1024)
    again = corpus_pipeline.run(spark, root).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, again)) == sorted(map(key, packed))


def test_empty_tables(spark, folder, tmp_path):
    root, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert corpus_pipeline.ORACLE_SQL is None and set(entry.oracle_sql()) <= names

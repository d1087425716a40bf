"""Listings, copies, tags and names: files on disk, a tool that is played by a script, tasks that fail."""

from __future__ import annotations

import json
import os
import random
import stat
import subprocess
import sys
import time

import pytest
from pyspark.sql import Observation, Row
from pyspark.sql import functions as F

from mediacat.operators import naming, registry
from mediacat.sources import content, copies, scratch, tagtool, tree

FAKE = '''#!{python}
import json, os, sys, time
log = os.environ.get("FAKE_LOG") or {log!r}
with open(log, "a") as f:
    f.write("start %d\\n" % os.getpid())
args = []
for line in sys.stdin:
    line = line.rstrip("\\n")
    if line.startswith("-execute"):
        path = args[-1] if args else ""
        if os.path.exists(path + ".crash"):
            os.remove(path + ".crash")
            sys.exit(3)
        with open(log, "a") as f:
            f.write(json.dumps(args) + "\\n")
        if "-json" in args:
            print(json.dumps([{{"SourceFile": path, "CreateDate": "2011:02:03 04:05:06", "TrackCreateDate": 5}}]) if "none" not in path else "no file")
        elif "bad" in path:
            print("Error: not writable - " + path)
        print("{{ready%s}}" % line[len("-execute"):], flush=True)
        args = []
    elif line == "False" and args == ["-stay_open"]:
        break
    else:
        args.append(line)
'''


@pytest.fixture
def tool(tmp_path):
    path, log = tmp_path / "tool.py", tmp_path / "log"
    path.write_text(FAKE.format(python=sys.executable, log=str(log)))
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    log.write_text("")
    return str(path), lambda: [x for x in log.read_text().splitlines()]


def touch(root, names, data=b"x"):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


# -- listing ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("folders", [1, 200])
def test_deep_tree_and_full_folder(spark, tmp_path, folders):
    root = str(tmp_path / "in")
    deep = "/".join(f"d{i}" for i in range(12 if folders == 1 else 50))
    names = [*(f"full/_f{i}" for i in range(3000)), f"{deep}/.last", *(f"a=b {i}/c%20[1]/x.jpg" for i in range(30)), "top"]
    touch(root, names)
    os.symlink(root, os.path.join(root, "loop"))
    got = {r["rel_path"]: r for r in tree.read_tree(spark, root, folders).collect()}
    assert set(got) == {*names, "loop"} and got["top"]["size"] == 1 and got["top"]["mtime_ns"] == os.stat(os.path.join(root, "top")).st_mtime_ns


def test_listing_needs_no_walk_on_the_driver(spark, tmp_path, monkeypatch):
    touch(str(tmp_path), ["a/b/c", "d"])
    for name in ("walk", "scandir", "listdir"):
        monkeypatch.setattr(os, name, lambda *a, **k: pytest.fail("the driver lists files"))
    assert tree.read_tree(spark, str(tmp_path)).count() == 2


# -- copies -----------------------------------------------------------------------------------------------------------


def files_below(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if ".mediacat" not in d)


def test_copies_are_made_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "o [1]")
    touch(source, [f"f{i}" for i in range(20)])
    rows = spark.createDataFrame([(f"f{i}", f"Library/{i % 3}/g{i}") for i in range(20)] + [("lost", "Library/lost")], "src_path string, dst_path string").repartition(3)
    seen, none = Observation(), Observation()
    out = copies.copy_files(rows, source, target, seen)
    assert seen.get == {"files": 21, "failed": 1}
    assert out.count() == 21 and [r["dst_path"] for r in out.filter("error is not null").collect()] == ["Library/lost"]
    assert files_below(target) == sorted(f"Library/{i % 3}/g{i}" for i in range(20))
    touch(target, ["Library/0/g0"], b"changed")
    assert out.count() == 21 and open(os.path.join(target, "Library/0/g0"), "rb").read() == b"changed"
    assert copies.copy_files(rows.limit(0), source, str(tmp_path / "none"), none).count() == 0 and none.get == {"files": 0, "failed": 0}


def test_failed_copies_leave_nothing(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    touch(source, [f"f{i}" for i in range(20)])
    rows = spark.createDataFrame([(f"f{i}", f"g{i}") for i in range(20)], "src_path string, dst_path string").coalesce(1)
    broken = rows.withColumn("dst_path", F.when(F.col("src_path") == "f19", F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("dst_path")))
    with pytest.raises(Exception, match="boom"):
        copies.copy_files(broken, source, target)
    assert [f for _, _, f in os.walk(target) if f] == []


def test_only_committed_attempts_count(tmp_path):
    touch(str(tmp_path / "in"), ["a"])
    stage = str(tmp_path / "stage")
    os.makedirs(stage)
    writer = copies.CopyWriter({"source": str(tmp_path / "in"), "stage": stage})
    rows = [Row(src_path="a", dst_path="b")]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([kept, None])
    assert json.load(open(os.path.join(stage, "_committed")))["attempts"] == [kept.attempt] and lost.attempt != kept.attempt
    writer.abort([kept])
    assert not os.path.exists(stage)


# -- tags -------------------------------------------------------------------------------------------------------------


def tag_rows(spark, names):
    return spark.createDataFrame([(n, i, t, op, v) for n in names for i, (t, op, v) in enumerate([("CreateDate", "=", "2020:01:01"), ("XMP:Subject", "+=", "Ann"), ("XMP:Description", "=", "two\nlines \\ $x")])], "dst_path string, ord int, tag string, op string, value string")


def written(log):
    return [json.loads(x) for x in log() if x.startswith("[")]


def test_tags_are_written_in_batches(spark, tmp_path, tool):
    path, log = tool
    names = [f"Library/p{i}.jpg" for i in range(30)] + ["Library/bad.jpg"]
    out = tagtool.write_tags(tag_rows(spark, names).repartition(3), str(tmp_path), str(tmp_path / "j [1]"), size=4, tool=path, buckets=4)
    got = {r["dst_path"]: r["error"] for r in out.collect()}
    assert set(got) == set(names) and {n for n, e in got.items() if e} == {"Library/bad.jpg"}
    sent = written(log)
    assert sorted(a[-1] for a in sent) == sorted(os.path.join(tmp_path, n) for n in names)
    assert sent[0][:-1] == ["-CreateDate=2020:01:01", "-XMP:Subject+=Ann", "#[CSTR]-XMP:Description=two\\nlines \\\\ \\$x"]
    assert sum(x.startswith("start") for x in log()) <= 4
    first = tagtool.last_run(str(tmp_path / "j [1]"))
    assert first["failed"] == 1 and first["batches"] >= len(names) / 4
    assert tagtool.write_tags(tag_rows(spark, names), str(tmp_path), str(tmp_path / "j [1]"), size=4, tool=path, buckets=4).count() == len(names)
    assert len(written(log)) == len(names)  # the same journal: nothing is sent again
    assert tagtool.last_run(str(tmp_path / "j [1]")) == {"batches": 0, "failed": 0}


def test_a_task_that_fails_sends_no_answered_batch_again(tmp_path, tool):
    path, log = tool
    writer = tagtool.TagWriter({"root": str(tmp_path), "journal": str(tmp_path / "journal"), "tool": path})
    rows = [Row(bucket=0, batch=i // 2, dst_path=f"p{i}", args=["-A=1"]) for i in range(6)]
    (tmp_path / "p3.crash").write_text("")  # the tool dies at the second batch
    with pytest.raises(tagtool.ToolError):
        writer.write(iter(rows))
    done = writer.write(iter(rows))
    assert done.batches == 2 and done.failed == 0
    sent = [os.path.basename(a[-1]) for a in written(log)]
    assert sent.count("p0") == sent.count("p1") == 1 and {"p2", "p3", "p4", "p5"} <= set(sent)
    writer.commit([done, None])
    assert json.load(open(tmp_path / "journal/_committed")) == {"batches": 2, "failed": 0}


def test_missing_tool(spark, tmp_path):
    out = tagtool.write_tags(tag_rows(spark, ["a", "b"]), str(tmp_path), str(tmp_path / "journal"), tool="no-such-tool")
    assert {tuple(r) for r in out.collect()} == {("a", tagtool.NO_TOOL), ("b", tagtool.NO_TOOL)}
    got = tagtool.exif_tags(spark.createDataFrame([("a",)], "rel_path string"), str(tmp_path), tool="no-such-tool").collect()
    assert [tuple(r) for r in got] == [("a", None, None, None, None)]


def test_tags_are_read_by_one_process_a_task(spark, tmp_path, tool):
    path, log = tool
    files = spark.createDataFrame([(f"p{i}.jpg",) for i in range(50)] + [("none.jpg",)], "rel_path string").coalesce(2)
    got = {r["rel_path"]: (r["date_time_original"], r["create_date"], r["track_create_date"]) for r in tagtool.exif_tags(files, str(tmp_path), path, batch=7).collect()}
    assert len(got) == 51 and got.pop("none.jpg") == (None, None, None) and set(got.values()) == {(None, "2011:02:03 04:05:06", None)}
    assert sum(x.startswith("start") for x in log()) == 2


# -- names ------------------------------------------------------------------------------------------------------------


def greedy(rows, held):
    """Every folder's names in walk order, one by one."""
    taken, out = set(held), {}
    for src, hash_, dst, name in sorted(rows, key=lambda r: r[0].split("/")):
        head, dot, ext = name.rpartition(".") if "." in name else (name, "", "")
        pick, n = name, 1
        if (dst, pick) in taken and hash_:
            pick = f"{head}-{hash_[:8]}{dot}{ext}"
        while (dst, pick) in taken:
            pick = f"{head}-{n}{dot}{ext}"
            n += 1
        taken.add((dst, pick))
        out[src] = f"{dst}/{pick}"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows, held = [], {("Library", "x-2.jpg"), ("Library", "y.png"), ("Library", "lone")}
    for i in range(260):
        head = rng.choice(["x", "y", "IMG", ".hid", "n"]) + "".join(rng.choice(["-1", "-2", "-12", "-aaaaaaaa", "-0b", ""]) for _ in range(rng.randrange(3)))
        hash_ = rng.choice([None, "", "aaaaaaaa1", "bbbbbbbb2", "0b", f"{i:08x}ff", f"{i:08x}ff"])
        rows.append((f"{rng.randrange(9)}/{rng.choice('abc-')}{i}/{head}{rng.choice(['.jpg', '.png', '', '.a.jpg'])}", hash_, rng.choice([None, "Trip"])))
    df = spark.createDataFrame([(*r, "unknown") for r in rows], "src_path string, hash string, final_album string, kind string").repartition(3)
    existing = spark.createDataFrame(sorted(held), "dst_dir string, name string")
    got = {r["src_path"]: r["dst_path"] for r in naming.output_manifest(df, existing).collect()}
    want = greedy([(s, h, "Albums/Trip" if a else "Library", s.rpartition("/")[2]) for s, h, a in rows], held)
    assert got == want


def test_one_clash_in_a_folder_stays_small(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    place = naming.place_group

    def counting(part):
        seen.add(len(part))
        return place(part)

    monkeypatch.setattr(naming, "place_group", counting)
    rows = spark.range(50_000).selectExpr("format_string('a/IMG-%d.jpg', id) AS src_path", "sha2(cast(id AS string), 256) AS hash", "CAST(NULL AS STRING) AS final_album", "'unknown' AS kind")
    more = spark.createDataFrame([("b/IMG-7.jpg", "f" * 64, None, "unknown"), ("c/IMG-3.jpg", None, None, "unknown"), ("d/IMG-3-1.jpg", None, None, "unknown")], rows.schema)
    got = {r["src_path"]: r["final_name"] for r in naming.output_manifest(rows.unionByName(more)).filter("src_path LIKE '_/IMG-3%' OR src_path LIKE '_/IMG-7.jpg'").collect()}
    assert (got["b/IMG-7.jpg"], got["c/IMG-3.jpg"], got["d/IMG-3-1.jpg"], got["a/IMG-3.jpg"], got["a/IMG-7.jpg"]) == ("IMG-7-ffffffff.jpg", "IMG-3-1.jpg", "IMG-3-1-1.jpg", "IMG-3.jpg", "IMG-7.jpg")
    assert 0 < seen.value < 10


def test_too_many_names(spark, monkeypatch):
    monkeypatch.setattr(naming, "MOST_SUFFIXES", 3)
    rows = spark.range(5).selectExpr("format_string('%d/x.jpg', id) AS src_path", "CAST(NULL AS STRING) AS hash", "CAST(NULL AS STRING) AS final_album", "'unknown' AS kind")
    with pytest.raises(Exception, match="too many name collisions"):
        naming.output_manifest(rows).collect()
    assert naming.output_manifest(rows.limit(4)).count() == 4


# -- groups of equal size ---------------------------------------------------------------------------------------------


def test_only_files_of_equal_size_and_ends_are_hashed_whole(spark, tmp_path):
    files = {"lone": b"a" * 5000, "e1": b"", "e2": b"", "s1": b"a" * 9000 + b"1", "s2": b"a" * 9000 + b"2", "t1": b"b" + b"c" * 9999, "t2": b"b" + b"c" * 9999, "m1": b"d" * 4500 + b"1" + b"d" * 5499, "m2": b"d" * 4500 + b"2" + b"d" * 5499}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    hashed = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def whole(paths):
        hashed.add(len(paths))
        return paths.map(lambda p: str(hash(open(f"{tmp_path}/{p}", "rb").read())) if p != "gone" else None)

    rows = spark.createDataFrame([(n, len(d)) for n, d in files.items()] + [("gone", 0), ("n1", None)], "rel_path string, size long").coalesce(1)
    out = registry.size_groups(rows, whole(F.col("rel_path")), content.edge_hash(str(tmp_path), F.col("rel_path"), 4096))
    groups = {}
    for r in out.collect():
        groups.setdefault(r["grp"], set()).add(r["rel_path"])
    assert sorted(map(sorted, groups.values())) == [["e1", "e2"], ["gone"], ["lone"], ["m1"], ["m2"], ["n1"], ["s1"], ["s2"], ["t1", "t2"]]
    assert hashed.value == 6
    assert "Window" not in registry.size_groups(rows, F.col("rel_path"))._jdf.queryExecution().toString()


def test_kept_tables_go_when_the_session_has_stopped(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from mediacat.sources.scratch import Scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
print(Scratch(spark).keep(spark.range(3), "kept").count())
spark.stop()
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120).stdout.strip() == "3"
    for _ in range(50):
        if not list(tmp_path.glob("kept-*")):
            break
        time.sleep(0.2)
    assert list(tmp_path.glob("kept-*")) == []
    assert scratch.local_uri("/a [b]") == "file:///a \\[b\\]"

"""Listings of file trees, made in tasks: names that start with '_' or '.' are files like others."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from mediacat.sources.scratch import Scratch

TREE_DDL = "rel_path string, size bigint, mtime_ns bigint"
#: Folders that a task lists in one round before it hands back those it has found; names in a batch.
FOLDERS, NAMES = 200, 10_000


def list_folders(spark: SparkSession, frontier: DataFrame, root: str, folders: int) -> DataFrame:
    """(rel_path, listed): the entries of the folders in frontier (rel_path) and of folders below them, up to `folders` a task.
    listed is true for files; false for folders whose entries are still to be listed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            waiting, done = deque(part["rel_path"]), 0
            paths: list[str] = []
            while waiting and done < max(folders, len(part)):
                folder, done = waiting.popleft(), done + 1
                try:
                    with os.scandir(os.path.join(root, folder)) as entries:
                        for entry in entries:
                            path = os.path.normpath(os.path.join(folder, entry.name))
                            if entry.is_dir(follow_symlinks=False):
                                waiting.append(path)
                            else:
                                paths.append(path)
                                if len(paths) == NAMES:
                                    yield pd.DataFrame({"rel_path": paths, "listed": True})
                                    paths = []
                except OSError:
                    continue
            if paths or waiting:
                yield pd.DataFrame({"rel_path": [*paths, *waiting], "listed": [True] * len(paths) + [False] * len(waiting)})

    return frontier.mapInPandas(run, "rel_path string, listed boolean")


def with_stats(files: DataFrame, root: str) -> DataFrame:
    """files (rel_path) with size and mtime_ns; those that are gone or cannot be read are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path in part["rel_path"]:
                try:
                    stat = os.stat(os.path.join(root, path), follow_symlinks=False)
                except OSError:
                    continue
                rows.append((path, stat.st_size, stat.st_mtime_ns))
            if rows:
                yield pd.DataFrame(rows, columns=["rel_path", "size", "mtime_ns"])

    return files.mapInPandas(run, TREE_DDL)


def read_tree(spark: SparkSession, root: str, folders: int = FOLDERS) -> DataFrame:
    """(rel_path, size, mtime_ns) of all files below a folder that driver and executors see.

    Rounds of tasks list the folders that are known so far and go on into those they find; what a task leaves over is dealt
    anew, so the driver only sees how many folders are left, and a deep or lopsided tree takes few rounds. Names are dealt
    out again before files are asked for size and time, so a folder of very many files keeps no task busy alone. Links to
    folders are not followed, unreadable places are passed over, a missing root is an empty table.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as s:
        frontier, found = spark.createDataFrame([(".",)], "rel_path string"), []
        while True:
            level = s.cut(list_folders(spark, frontier, root, folders), "names", by=["listed"])
            found.append(level.filter("listed").select("rel_path"))
            left = level.filter("NOT listed").select("rel_path")
            n = left.count()
            if not n:
                break
            frontier = left.repartition(max(1, min(tasks, n)), "rel_path")
        files = reduce(DataFrame.unionByName, found).repartition(tasks, "rel_path")
        return s.keep(with_stats(files, root), "tree")

"""Small stores on the driver (custom patterns, exclusions) and the hash cache as a table."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from mediacat.functions.dates import CustomPattern
from mediacat.sources.scratch import delete

CACHE_DDL = "path string, size bigint, mtime_ns bigint, hash string"


def load_patterns(path: str) -> list[CustomPattern]:
    """Patterns in order; a missing file is empty, a malformed one an error."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [CustomPattern(x.get("regex", ""), x.get("layout", "")) for x in json.load(f) or []]


def save_patterns(path: str, patterns: list[CustomPattern]) -> None:
    _write(path, [{"regex": p.regex, "layout": p.layout} for p in patterns])


def load_exclusions(path: str) -> set[str]:
    """Base names; blanks are dropped, a missing file is empty."""
    if not os.path.exists(path):
        return set()
    with open(path, encoding="utf-8") as f:
        return {x for x in json.load(f) or [] if x}


def save_exclusions(path: str, names: set[str]) -> None:
    _write(path, sorted(n for n in names if n))


def _write(path: str, value: object) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(part, path)


def exclusions_table(spark: SparkSession, names: set[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(names)], "base string")


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the hash cache, the newest that has a commit record; a cache without one is empty."""
    found = _versions(spark, path)
    return spark.read.schema(CACHE_DDL).parquet(_folder(path, found[-1])) if found else spark.createDataFrame([], CACHE_DDL)


def save_cache(files: DataFrame, path: str, keep: int = 2) -> str:
    """Writes files (rel_path, size, mtime_ns, hash) as a new version below path and returns its folder.

    A version counts once its commit record exists, an empty file named by the version, so a cache is never replaced while
    it is read and a failed save is never read. Of older versions the newest keep - 1 stay, for those who still read them.
    """
    spark, version = files.sparkSession, time.time_ns()
    to = _folder(path, version)
    files.filter("hash is not null").selectExpr("rel_path AS path", "size", "mtime_ns", "hash").write.parquet(to)
    fs, record = _file_system(spark, _record(path, version))
    fs.createNewFile(record)
    for old in _versions(spark, path)[: -max(keep, 1)]:  # the record goes first, so that nobody starts to read the version
        delete(spark, _record(path, old))
        delete(spark, _folder(path, old))
    return to


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/version={version}"


def _record(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/_committed/{version}"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    fs, where = _file_system(spark, f"{path.rstrip('/')}/_committed")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(where)) if fs.exists(where) else []

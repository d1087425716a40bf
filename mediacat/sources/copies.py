"""Copies of files as a committed write: tasks stage them beside their target, a commit makes them count, tasks put them
in place."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from mediacat.sources.scratch import local_uri

STAGED_DDL = "dst_path string, staged string, error string"
OUTCOME_DDL = "dst_path string, error string"


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    copied: int
    failed: int


class CopyWriter(DataSourceWriter):
    """Every attempt of a task copies into a folder of its own and lists what it did there; only attempts that Spark commits
    are named in the commit record, so copies of a task that failed or ran twice are never put in place."""

    def __init__(self, options: dict[str, str]) -> None:
        self.source, self.stage = options["source"], options["stage"]

    def write(self, rows: Iterator[Row]) -> Staged:
        attempt = uuid.uuid4().hex
        own = os.path.join(self.stage, attempt)
        os.makedirs(own)
        copied = failed = 0
        with open(os.path.join(own, "list.json"), "w", encoding="utf-8") as out:
            for n, r in enumerate(rows):
                staged, error = os.path.join(attempt, str(n)), None
                try:
                    with open(os.path.join(self.source, r["src_path"]), "rb") as a, open(os.path.join(self.stage, staged), "xb") as b:
                        shutil.copyfileobj(a, b, 1 << 20)
                        b.flush()
                        os.fsync(b.fileno())
                    copied += 1
                except OSError as e:
                    error, failed = str(e), failed + 1
                out.write(json.dumps({"dst_path": r["dst_path"], "staged": staged, "error": error}, ensure_ascii=False) + "\n")
        return Staged(attempt, copied, failed)

    def commit(self, messages: list[Staged | None]) -> None:
        done = [m for m in messages if m is not None]
        part = os.path.join(self.stage, "_committed.part")
        with open(part, "w", encoding="utf-8") as f:
            json.dump({"attempts": [m.attempt for m in done], "copied": sum(m.copied for m in done), "failed": sum(m.failed for m in done)}, f)
        os.replace(part, os.path.join(self.stage, "_committed"))

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class CopySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mediacopies"

    def writer(self, schema, overwrite: bool) -> CopyWriter:
        return CopyWriter(dict(self.options))


def put_in_place(staged: DataFrame, stage: str, target: str) -> DataFrame:
    """Renames staged files (dst_path, staged, error) to their targets; a rename that was done before counts as done."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            errors = []
            for dst, name, error in part.itertuples(index=False):
                if error is None:
                    to = os.path.join(target, dst)
                    try:
                        os.makedirs(os.path.dirname(to), exist_ok=True)
                        os.replace(os.path.join(stage, name), to)
                    except FileNotFoundError as e:
                        error = None if os.path.exists(to) else str(e)
                    except OSError as e:
                        error = str(e)
                errors.append(error)
            yield pd.DataFrame({"dst_path": part["dst_path"], "error": pd.Series(errors, dtype=object, index=part.index)})

    return staged.select("dst_path", "staged", "error").mapInPandas(run, OUTCOME_DDL)


def copy_files(manifest: DataFrame, source: str, target: str, seen: Observation | None = None) -> DataFrame:
    """Copies manifest rows (src_path, dst_path) and returns the outcome (dst_path, error), a table that is written once, so
    reading it copies nothing again.

    If the job fails, nothing appears below target and its staged copies are removed. The stage is a hidden folder of
    target, so that putting a copy in place is a rename. Files that cannot be read come back with their error;
    modification times are not kept. `seen` gets the counts `files` and `failed` while the outcome is written.
    """
    spark = manifest.sparkSession
    spark.dataSource.register(CopySink)
    home = os.path.join(target, ".mediacat", uuid.uuid4().hex)
    stage = os.path.join(home, "stage")
    os.makedirs(stage)
    try:
        manifest.select("src_path", "dst_path").write.format("mediacopies").mode("append").options(source=source, stage=stage).save()
    except Exception:
        shutil.rmtree(home, ignore_errors=True)
        raise
    with open(os.path.join(stage, "_committed"), encoding="utf-8") as f:
        attempts = json.load(f)["attempts"]
    lists = [local_uri(os.path.join(stage, a, "list.json")) for a in attempts]
    staged = spark.read.schema(STAGED_DDL).json(lists) if lists else spark.createDataFrame([], STAGED_DDL)
    outcome = put_in_place(staged, stage, target)
    if seen is not None:
        outcome = outcome.observe(seen, F.count(F.lit(1)).alias("files"), F.count("error").alias("failed"))
    outcome.write.parquet(f"file://{os.path.abspath(home)}/outcome")
    shutil.rmtree(stage, ignore_errors=True)
    return spark.read.schema(OUTCOME_DDL).parquet(local_uri(os.path.join(home, "outcome")))

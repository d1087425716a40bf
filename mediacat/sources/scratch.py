"""Tables that a run writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import itertools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session, where driver and executors are one
    machine, may leave it unset; it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="mediacat-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Has the file system remove a folder when the driver's JVM ends, whether or not the session was stopped before."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def local_uri(path: str) -> str:
    """A folder that all machines see under this path, as Spark's readers want it: pattern characters of names are escaped."""
    return "file://" + re.sub(r"([\[\]{}*?\\])", r"\\\1", os.path.abspath(path))


class Scratch:
    """Tables that an operator writes to the shared folder on its way, so that lineage ends there and a lost executor costs
    no recomputation. Those of `cut` are deleted when the operator is done, those of `keep`, which the result still
    reads, when the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.number = itertools.count()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.root)

    def cut(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        return self._written(df, f"{self.root}/{name}-{next(self.number)}", by)

    def keep(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        kept = self._written(df, path, by)
        delete_at_exit(self.spark, path)
        return kept

    def _written(self, df: DataFrame, path: str, by: list[str] | None) -> DataFrame:
        """by: columns that the table's folders are named by, so that a filter on them reads only its own files."""
        df.write.parquet(path, partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(path)

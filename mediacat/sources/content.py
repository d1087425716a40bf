"""Bytes of files: hashes, heads and sidecar texts, read in tasks."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 1 << 20


def content_hash(root: str, path: Column) -> Column:
    """SHA-256 of a file in hex, read in chunks; null if it cannot be read."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        def one(rel: str | None) -> str | None:
            try:
                with open(os.path.join(root, rel), "rb") as f:
                    digest = hashlib.sha256()
                    while block := f.read(CHUNK):
                        digest.update(block)
                    return digest.hexdigest()
            except (OSError, TypeError):
                return None

        return paths.map(one)

    return run(path)


def edge_hash(root: str, path: Column, size: int = 4096) -> Column:
    """SHA-256 in hex of the first and last bytes of a file; null if it cannot be read."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        def one(rel: str | None) -> str | None:
            try:
                with open(os.path.join(root, rel), "rb") as f:
                    digest = hashlib.sha256(f.read(size))
                    f.seek(max(0, os.fstat(f.fileno()).st_size - size))
                    digest.update(f.read(size))
                    return digest.hexdigest()
            except (OSError, TypeError):
                return None

        return paths.map(one)

    return run(path)


def file_head(root: str, path: Column, size: int = 12) -> Column:
    """The first bytes of a file; null if it cannot be read."""

    @F.pandas_udf("binary")
    def run(paths: pd.Series) -> pd.Series:
        def one(rel: str | None) -> bytes | None:
            try:
                with open(os.path.join(root, rel), "rb") as f:
                    return f.read(size)
            except (OSError, TypeError):
                return None

        return paths.map(one)

    return run(path)


def file_text(root: str, path: Column) -> Column:
    """A file's text; null if it cannot be read or is not UTF-8."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        def one(rel: str | None) -> str | None:
            try:
                with open(os.path.join(root, rel), encoding="utf-8") as f:
                    return f.read()
            except (OSError, TypeError, UnicodeDecodeError):
                return None

        return paths.map(one)

    return run(path)

"""Helpers that several operators share: tables and bounded Arrow batches; scratch tables come from the catalog part."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mediacat.sources.scratch import Scratch, delete, shared_dir

__all__ = ["BATCH_CHARS", "Scratch", "delete", "map_batches", "record", "shared_dir", "table", "text_groups"]

#: Characters of text that one numpy pass inside a task works on.
BATCH_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_groups(texts: list[str | None], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` characters each (a longer text is a range of its own)."""
    begin = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """rows.mapInArrow(run) with `run` fed slices of at most BATCH_CHARS bytes (or one row), whatever Arrow batches hold."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * BATCH_CHARS // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    return rows.mapInArrow(lambda batches: run(sliced(batches)), ddl)


def record(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

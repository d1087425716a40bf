"""Summaries of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_counts() -> list[Column]:
    """Aggregates of media (album, sidecar_path): n_files, n_with_album, n_with_sidecar; also for `observe`."""
    return [
        F.count("*").alias("n_files"),
        F.count_if(F.coalesce("album", F.lit("")) != "").alias("n_with_album"),
        F.count_if(F.col("sidecar_path").isNotNull()).alias("n_with_sidecar"),
    ]


def scan_summary(media: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """One row: n_files, n_with_album, n_with_sidecar of media (album, sidecar_path); with a listing (rel_path) only
    sidecars that it holds count."""
    if listing is not None:
        known = listing.select(F.col("rel_path").alias("_path")).distinct().withColumn("_there", F.lit(True))
        media = media.join(known, F.col("sidecar_path") == F.col("_path"), "left").withColumn("sidecar_path", F.when(F.col("_there"), F.col("sidecar_path")))
    return media.agg(*scan_counts())

"""A corpus pipeline of four stages: quality, rules, near duplicates, packing.

The first three return the columns of their input, whatever their names. Rows with a null id are judged like others and
are never duplicates; null and empty texts pass the classifier (they weigh 0) and fail the rules; of repeated rows one
stays after the third stage; empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mediacat.llm import neardup, packing, quality, rules
from mediacat.llm.common import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that importance resampling against the labelled good ones leaves out."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the word rules or whose zstandard ratios lie outside their bands."""
    return rules.keep_clean(docs)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return neardup.keep_first(docs, k=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; the result has a row for each piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [("quality classifier", keep_good), ("quality rules", keep_clean), ("near duplicates", keep_first), ("packing", pack)]

#: SQL has neither Gumbel top-k over a fitted model, nor zstandard, nor tokenizers; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as s:
        for name, stage in STAGES[:-1]:
            docs = s.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return STAGES[-1][1](spark, docs, sf_dir)  # written when it returns, so the stages' tables can go

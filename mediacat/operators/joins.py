"""Joins that stay even where one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt over at least.
LEAST_SALTS = 32


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int | None = None) -> DataFrame:
    """rows.join(table, on, how), inner or left, with the rows of a key dealt over `salts` tasks by a hash of `by`;
    unless it is given, over as many as a shuffle of the session has.

    table should have few rows a key. It is first joined with the pairs of key and salt that occur in rows, so only keys
    that many rows have are copied, and never more often than rows have them. Null keys match nothing.
    """
    if salts is None:
        salts = max(LEAST_SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    wanted = dealt.select(*on, "_salt").distinct().join(table, on)
    return dealt.join(wanted, [*on, "_salt"], how).drop("_salt")

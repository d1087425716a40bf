"""Joins with the rows of hot keys dealt over many tasks."""

from __future__ import annotations

import pytest

from mediacat.operators import joins


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("salts", [None, 1, 7])
def test_dealt_join_equals_a_plain_one(spark, how, salts):
    rows = spark.createDataFrame([("hot" if i % 3 else None if i % 5 == 0 else f"k{i % 40}", i) for i in range(600)], "k string, i int")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4), ("unused", 5)], "k string, v int")
    got, want = joins.spread_join(rows, table, ["k"], ["i"], how, salts), rows.join(table, "k", how)
    assert sorted(map(str, got.select("k", "i", "v").collect())) == sorted(map(str, want.select("k", "i", "v").collect()))


def test_a_hot_key_is_dealt_over_as_many_tasks_as_a_shuffle_has(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        rows = spark.range(5000).selectExpr("1 AS k", "id")
        plan = joins.spread_join(rows, spark.createDataFrame([(1, 2)], "k int, v int"), ["k"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "pmod(xxhash64(id" in plan and ", 100)" in plan

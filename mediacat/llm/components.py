"""Connected components with DataFrame operations only.

Every round maps each vertex to the smallest of itself and its neighbours, by the vertex itself in even rounds and by a
hash of vertex and round in odd ones, and contracts the edges. Hubs are reduced by partial aggregates; long chains halve
in the odd rounds. Where one vertex or label has very many rows, they are dealt over many tasks: beforehand if `spread`
is set, else by Spark's own splitting of skewed join partitions, which keeps plans short. Rounds are cut through the
shared folder; the driver only learns how many edges are left. Contraction leaves a long tail of rounds over ever fewer
edges; a caller may give a function that ends it in one go once at most `few` edges are left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import Scratch
from mediacat.operators.joins import spread_join


def connected_components(edges: DataFrame, scratch: Scratch, spread: bool = True, finish: Callable[[DataFrame], DataFrame] | None = None, few: int = 0, most_rounds: int = 200) -> DataFrame:
    """edges (src, dst) of one orderable type -> (id, component), component being the smallest id of the component.

    Loops, repeated edges and edges with a null end count for nothing; ids that have no other edge are not returned.
    The result reads tables of `scratch`. `finish` turns edges into (src, to): each vertex with one vertex of its component,
    the same for all, or no row for that one itself.
    """
    def join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str) -> DataFrame:
        return spread_join(rows, table, [key], [by], how) if spread else rows.join(table, key, how)

    left = edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    left = scratch.cut(left.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    label = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("at", F.col("id"))
    for turn in range(most_rounds):
        n = left.count()
        if n and n <= few and finish is not None:
            step = scratch.cut(finish(left), "step")
            label = scratch.cut(join(label, step.withColumnRenamed("src", "at"), "at", "id", "left").select("id", F.coalesce("to", "at").alias("at")), "label")
            break
        if not n:
            break
        key = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, turn=turn: F.xxhash64(c, F.lit(turn)))
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = both.groupBy("src").agg(F.min(F.struct(key("dst").alias("k"), F.col("dst").alias("v"))).alias("m"))
        step = scratch.cut(near.filter(F.col("m.k") < key("src")).select("src", F.col("m.v").alias("to")), "step")
        left = join(left, step, "src", "dst", "left").select(F.coalesce("to", "src").alias("src"), "dst")
        left = join(left, step.withColumnRenamed("src", "dst"), "dst", "src", "left").select("src", F.coalesce("to", "dst").alias("dst"))
        left = scratch.cut(left.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
        label = scratch.cut(join(label, step.withColumnRenamed("src", "at"), "at", "id", "left").select("id", F.coalesce("to", "at").alias("at")), "label")
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    least = label.groupBy("at").agg(F.min("id").alias("component"))
    return join(label, least, "at", "id", "inner").select("id", "component")

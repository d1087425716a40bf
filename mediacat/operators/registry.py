"""Content registry: one row for each distinct content, and the merge of duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.names import walk_order
from mediacat.operators.joins import spread_join
from mediacat.sources.scratch import Scratch


def content_key(content_hash: Column, path: Column) -> Column:
    """The hash, or a key of its own for a file that could not be hashed."""
    return F.coalesce(content_hash, F.concat(F.lit("nohash:"), path))


def register(files: DataFrame) -> DataFrame:
    """files (rel_path, sidecar_path, album, size, hash) -> one row a content: key, hash, src_path, json_path, albums, size, n_files.

    The first file in walk order survives with its own sidecar; sidecars of later ones are lost. Albums are united and
    sorted; a null album adds none.
    """
    order = walk_order(F.col("rel_path"))
    return files.groupBy(content_key(F.col("hash"), F.col("rel_path")).alias("key")).agg(
        F.min_by(F.struct("hash", F.col("rel_path").alias("src_path"), F.col("sidecar_path").alias("json_path")), order).alias("first"),
        F.max_by("size", order).alias("size"), F.array_sort(F.collect_set("album")).alias("albums"), F.count("*").alias("n_files"),
    ).select("key", "first.*", "albums", "size", "n_files")


def cached_hashes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (rel_path, size, mtime_ns) with `hash` from a cache (path, size, mtime_ns, hash): only where path, size and
    time agree and the cached hash is not empty."""
    good = cache.filter(F.coalesce(F.col("hash"), F.lit("")) != "").select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"), "hash")
    good = good.groupBy("_p", "_s", "_m").agg(F.min("hash").alias("hash"))
    return files.join(good, (F.col("rel_path") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.col("mtime_ns") == F.col("_m")), "left").drop("_p", "_s", "_m")


def hash_files(files: DataFrame, cache: DataFrame, hasher: Column) -> DataFrame:
    """As cached_hashes, with misses hashed by `hasher`; hits never reach it, since the two parts are separate plans."""
    found = cached_hashes(files, cache)
    return found.filter("hash is not null").unionByName(found.filter("hash is null").drop("hash").withColumn("hash", hasher))


def shared(files: DataFrame, keys: list[str]) -> DataFrame:
    """files with `is_shared`: whether another row has the same keys, null keys being equal. The rows of a key are counted by
    partial aggregates and dealt over many tasks."""
    bound = [f"_{k}" for k in keys]
    dealt = files.withColumns({f"_{k}": F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys})
    twice = dealt.groupBy(*bound).agg(F.count("*").alias("n")).filter("n > 1").select(*bound, F.lit(True).alias("is_shared"))
    return spread_join(dealt, twice, bound, ["rel_path"], "left").drop(*bound).withColumn("is_shared", F.coalesce("is_shared", F.lit(False)))


def size_groups(files: DataFrame, hasher: Column, sketch: Column | None = None) -> DataFrame:
    """files (rel_path, size) with `grp`. Files of a size of their own are never read; with a sketch (a hash of a few bytes, such
    as `content.edge_hash`) those of a size and sketch of their own are not hashed whole either; the others share a group
    by hash."""
    columns = files.columns
    sized = shared(files, ["size"])
    lone = sized.filter("NOT is_shared").withColumn("grp", F.concat(F.lit("size:"), F.col("size").cast("string")))
    rest = sized.filter("is_shared").drop("is_shared")
    parts = [lone.select(*columns, "grp")]
    if sketch is not None:
        with Scratch(files.sparkSession) as s:
            rest = shared(s.keep(rest.withColumn("sketch", sketch), "sketches"), ["size", "sketch"])  # written, so that a file is read once for it
        parts.append(rest.filter("NOT is_shared").withColumn("grp", F.concat_ws(":", F.lit("part"), "size", "sketch", F.when(F.col("sketch").isNull(), F.col("rel_path")))).select(*columns, "grp"))
        rest = rest.filter("is_shared")
    parts.append(rest.withColumn("grp", F.coalesce(hasher, F.concat(F.lit("nohash:"), F.col("rel_path")))).select(*columns, "grp"))
    return reduce(DataFrame.unionByName, parts)


def merge_duplicates(photos: DataFrame) -> DataFrame:
    """photos (grp, src_path, date_accuracy, albums) -> the best row a group with the albums of all.

    Best is the lowest accuracy rank, then the shortest path in bytes, then walk order.
    """
    rank = F.struct("date_accuracy", F.octet_length("src_path"), walk_order(F.col("src_path")))
    rest = [c for c in photos.columns if c not in ("grp", "albums")]
    out = photos.groupBy("grp").agg(F.min_by(F.struct(*rest), rank).alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("albums")))).alias("albums"))
    return out.select("grp", "best.*", "albums")

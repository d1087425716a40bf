"""Date proposals and their review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions import dates as D
from mediacat.functions import names as N


def excluded_flag(files: DataFrame, exclusions: DataFrame | None, path_col: str = "src_path") -> DataFrame:
    """files with `excluded`: whether the base name is in exclusions (base)."""
    if exclusions is None:
        return files.withColumn("excluded", F.lit(False))
    known = exclusions.filter("base != ''").select(F.col("base").alias("_base")).distinct().withColumn("_hit", F.lit(True))
    return files.join(known, N.base_name(F.col(path_col)) == F.col("_base"), "left").withColumn("excluded", F.coalesce("_hit", F.lit(False))).drop("_base", "_hit")


def propose_dates(photos: DataFrame, sidecars: DataFrame, as_of_year: int, patterns: list[D.CustomPattern] | None = None, exclusions: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """photos (src_path, json_path) with meta, sidecar_time, name_time, tag_time, proposed and accuracy added.

    sidecars (json_path, meta struct) are parsed once each and joined. tags (rel_path and four tag texts) are only asked
    for photos that neither sidecar nor name dates: the two parts are separate plans.
    """
    rows = excluded_flag(photos, exclusions)
    meta = sidecars.select(F.col("json_path").alias("_json"), "meta")
    rows = rows.join(meta, F.col("json_path") == F.col("_json"), "left").drop("_json")
    rows = rows.withColumn("sidecar_time", F.timestamp_seconds(F.coalesce("meta.taken_epoch", "meta.creation_epoch")))
    rows = rows.withColumn("name_time", D.best_name_date(N.base_name(F.col("src_path")), patterns or [], F.col("excluded")))
    none = F.lit(None).cast("timestamp")
    if tags is None:
        rows = rows.withColumn("tag_time", none)
    else:
        known = F.col("sidecar_time").isNotNull() | F.col("name_time").isNotNull()
        found = tags.select(F.col("rel_path").alias("_path"), D.first_tag_date(*[F.col(c) for c in ("date_time_original", "create_date", "media_create_date", "track_create_date")]).alias("tag_time"))
        rows = rows.filter(known).withColumn("tag_time", none).unionByName(rows.filter(~known).join(found, F.col("src_path") == F.col("_path"), "left").drop("_path"))
    best = D.best_date(F.col("sidecar_time"), F.col("name_time"), F.col("tag_time"), as_of_year)
    return rows.withColumn("_best", best).withColumn("proposed", F.col("_best.ts")).withColumn("accuracy", F.col("_best.accuracy")).drop("_best")


def apply_dates(proposals: DataFrame) -> DataFrame:
    """taken (to the second) and date_accuracy from the proposals; no date leaves taken null."""
    return proposals.withColumn("taken", F.when(F.col("accuracy") != D.NO_DATE, F.date_trunc("second", "proposed"))).withColumn("date_accuracy", F.col("accuracy"))


def unknown_dates(proposals: DataFrame) -> DataFrame:
    """Neither a sidecar nor a name date; photos dated only by tags count."""
    return proposals.filter("sidecar_time is null and name_time is null")


def review(proposals: DataFrame, as_of_year: int) -> DataFrame:
    """(review, n) of the classes of D.review_class."""
    kind = D.review_class(F.col("sidecar_time"), F.col("name_time"), F.col("tag_time"), as_of_year)
    return proposals.select(kind.alias("review")).filter("review is not null").groupBy("review").agg(F.count("*").alias("n"))


def unknown_groups(rows: DataFrame, path_col: str = "src_path", top: int = 50) -> DataFrame:
    """(shape, n, examples): the `top` most frequent name shapes with their first three names in walk order.

    Examples are kept as the three smallest of each partial result, so a hot shape never gathers all its names.
    """
    base = N.base_name(F.col(path_col))
    named = rows.select(N.name_shape(base).alias("shape"), N.walk_order(F.col(path_col)).alias("walk"), base.alias("base"))
    counted = named.groupBy("shape").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(top)
    first = named.join(F.broadcast(counted), "shape").withColumn("r", F.row_number().over(Window.partitionBy("shape").orderBy("walk", "base"))).filter("r <= 3")
    return first.groupBy("shape", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "base"))), lambda x: x["base"]).alias("examples")).orderBy(F.desc("n"), "shape")


def preview_pattern(rows: DataFrame, pattern: D.CustomPattern, path_col: str = "src_path") -> DataFrame:
    """(base, matched, date): what a custom pattern finds in each name; date is null where the match does not parse."""
    base = N.base_name(F.col(path_col))
    return rows.select(base.alias("base"), pattern.target(base).isNotNull().alias("matched"), D.rfc3339(pattern.date(base)).alias("date"))

"""A whole run over a file tree: scan, match, register, date, merge, assign albums, plan the output."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mediacat.functions import names as N
from mediacat.functions.dates import CustomPattern
from mediacat.functions.sidecars import sidecar, title
from mediacat.operators import albums as A
from mediacat.operators import dating, naming, registry
from mediacat.operators.matching import match_sidecars
from mediacat.operators.reports import scan_counts
from mediacat.sources import content, copies, stores, tagtool
from mediacat.sources.scratch import Scratch
from mediacat.sources.tree import read_tree


@dataclass
class Settings:
    """What a user chooses for a run."""

    as_of_year: int
    only_extensions: list[str] = field(default_factory=list)
    patterns: list[CustomPattern] = field(default_factory=list)
    exclusions: set[str] = field(default_factory=set)
    album_spec: str | None = None
    tag_batch: int = 25
    read_tags: bool = False


@dataclass
class Catalog:
    """The tables of a run; nothing is written until `apply`. counts: the scan summary, taken while media was written."""

    media: DataFrame
    proposals: DataFrame
    photos: DataFrame
    manifest: DataFrame
    tags: DataFrame
    counts: dict[str, int]


def scan(spark: SparkSession, root: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(media, sidecars): media files with sidecar and album; sidecars with title and metadata."""
    listing = read_tree(spark, root)
    raw = listing.filter(N.is_sidecar(F.col("rel_path"))).select(F.col("rel_path").alias("json_path"), content.file_text(root, F.col("rel_path")).alias("raw"))
    sidecars = raw.select("json_path", title(F.col("raw")).alias("title"), sidecar(F.col("raw")).alias("meta"))
    media = listing.filter(N.is_media(F.col("rel_path")) & N.in_extensions(F.col("rel_path"), settings.only_extensions))
    matched = match_sidecars(media, sidecars.select("json_path", "title"))
    return matched.withColumn("album", N.album_of(F.col("rel_path"))), sidecars.select("json_path", "meta")


def dates_only(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    """A date proposal for every media file; nothing is hashed, duplicates stay."""
    media, sidecars = scan(spark, root, settings)
    photos = media.select(F.col("rel_path").alias("src_path"), F.col("sidecar_path").alias("json_path"))
    return _propose(spark, root, photos, sidecars, settings)


def _propose(spark: SparkSession, root: str, photos: DataFrame, sidecars: DataFrame, settings: Settings) -> DataFrame:
    excluded = stores.exclusions_table(spark, settings.exclusions) if settings.exclusions else None
    tags = tagtool.exif_tags(photos.select(F.col("src_path").alias("rel_path")), root) if settings.read_tags else None
    return dating.propose_dates(photos, sidecars, settings.as_of_year, settings.patterns, excluded, tags)


def catalog(spark: SparkSession, root: str, settings: Settings, cache: DataFrame | None = None, target: str = "") -> Catalog:
    media, sidecars = scan(spark, root, settings)
    cache = cache if cache is not None else spark.createDataFrame([], stores.CACHE_DDL)
    seen = Observation()
    with Scratch(spark) as s:  # written, since cache, registry and review read it and no file should be hashed twice
        hashed = registry.hash_files(media, cache, content.content_hash(root, F.col("rel_path")))
        hashed = s.keep(hashed.observe(seen, *scan_counts()), "hashed")
    unique = registry.register(hashed)
    proposals = _propose(spark, root, unique, sidecars, settings)
    dated = dating.apply_dates(proposals).withColumn("grp", registry.content_key(F.col("hash"), F.col("src_path")))
    merged = registry.merge_duplicates(dated.select("grp", "src_path", "hash", "json_path", "size", "meta", "taken", "date_accuracy", "albums"))
    albums = [r["album"] for r in A.distinct_albums(merged).collect()] if settings.album_spec else []  # names of albums, for the selection
    photos = A.assign_albums(merged, A.select_albums(albums, settings.album_spec)).withColumn("kind", N.file_kind(content.file_head(root, F.col("src_path"))))
    manifest = naming.output_manifest(photos.select("src_path", "hash", "final_album", "kind"), root=target)
    entries = manifest.join(photos.select("src_path", "kind", entry_meta()), "src_path").select("dst_path", "kind", "meta")
    return Catalog(hashed, proposals, photos, manifest, naming.tag_manifest(entries), seen.get)


def entry_meta():
    """Metadata struct for tags: the applied date, and the sidecar's other fields."""
    m = F.col("meta")
    blank = F.lit("")
    return F.struct(
        F.col("taken").alias("taken"), F.timestamp_seconds(m["creation_epoch"]).alias("creation"), m["geo"].alias("geo"), F.coalesce(m["description"], blank).alias("description"),
        F.coalesce(m["favorited"], F.lit(False)).alias("favorited"), m["people"].alias("people"), F.coalesce(m["url"], blank).alias("url"), F.coalesce(m["app_source"], blank).alias("app_source"), m["origin"].alias("origin"),
    ).alias("meta")


def apply(found: Catalog, source: str, target: str, dry_run: bool = True, confirm: str = "", seen: Observation | None = None) -> DataFrame:
    """The copies to make (dry run), or the outcome of making them; a real run needs confirm='APPLY' in any case. A real run's
    counts, `files` and `failed`, go to `seen`."""
    if dry_run:
        return found.manifest.select("dst_path", F.lit(None).cast("string").alias("error"))
    if confirm.strip().upper() != "APPLY":
        raise PermissionError("a real run needs confirm='APPLY'")
    return copies.copy_files(found.manifest, source, target, seen)


def apply_tags(found: Catalog, copied: DataFrame, target: str, journal: str, settings: Settings) -> DataFrame:
    """Writes the tags of the files that `apply` has copied without an error, in batches of settings.tag_batch, and returns
    (dst_path, error); see tagtool.write_tags. Counts of the run: tagtool.last_run."""
    good = copied.filter("error IS NULL").select("dst_path")
    return tagtool.write_tags(found.tags.join(good, "dst_path"), target, journal, settings.tag_batch)


def parse_index_list(text: str, n: int) -> list[int]:
    """Positions from 1 in a comma list that may start with the word exclude; those out of range are passed over, others
    than numbers are an error."""
    items = [x.strip() for x in text.lower().replace("exclude", "").split(",")]
    return [i for i in (int(x) for x in items if x) if 1 <= i <= n]

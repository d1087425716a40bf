"""Tags that a catalog entry's metadata asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.dates import tag_time
from mediacat.functions.names import extension_fits, is_video, is_writable, trimmed


#: Prefix of origin labels unless a caller chooses another.
ORIGIN = "origin:"


def origin_label(origin: Column, prefix: str) -> Column:
    """The prefix and the ordered parts of an origin struct; empty if there are none."""
    def named(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label + "="), value))

    parts = F.array_compact(F.array(
        F.when(origin["from_shared_album"], "fromSharedAlbum"), F.when(origin["web_upload"], "webUpload"), F.when(origin["mobile_upload"], "mobileUpload"),
        named("composition", origin["composition"]), named("deviceType", origin["device_type"]), named("deviceFolder", origin["device_folder"]),
    ))
    return F.when(F.size(parts) > 0, F.concat(F.lit(prefix), F.array_join(parts, ","))).otherwise("")


def has_writable_meta(meta: Column) -> Column:
    """Whether anything in a metadata struct can be written; spans of a place and absent flags do not count."""
    some = lambda c: F.coalesce(c != "", F.lit(False))
    return meta["taken"].isNotNull() | meta["creation"].isNotNull() | meta["geo"].isNotNull() | some(meta["description"]) | F.coalesce(meta["favorited"], F.lit(False)) | F.coalesce(F.size(meta["people"]) > 0, F.lit(False)) | some(meta["url"]) | some(meta["app_source"]) | (origin_label(meta["origin"], "") != "")


def tag_list(meta: Column, ext: Column, kind: Column, label_prefix: str = ORIGIN) -> Column:
    """Array of (tag, op, value) for a file of an extension (lower case, with dot) and sniffed kind; empty if the
    extension is not writable, does not fit the kind, or nothing is to be written."""

    def tag(name: str, value: Column, when: Column, op: str = "=") -> Column:
        return F.when(when, F.struct(F.lit(name).alias("tag"), F.lit(op).alias("op"), value.alias("value")))

    some = lambda c: F.coalesce(c != "", F.lit(False))
    taken, creation, geo = meta["taken"], meta["creation"], meta["geo"]
    video = taken.isNotNull() & is_video(ext)
    number = lambda c: F.format_string("%f", c)
    label = origin_label(meta["origin"], label_prefix)
    first = F.array(
        tag("DateTimeOriginal", tag_time(taken), taken.isNotNull()), tag("CreateDate", tag_time(taken), taken.isNotNull()), tag("MediaCreateDate", tag_time(taken), video), tag("TrackCreateDate", tag_time(taken), video),
        tag("XMP:CreateDate", tag_time(creation), creation.isNotNull()), *[tag(f"GPS{n}", number(geo[c]), geo.isNotNull()) for n, c in (("Latitude", "lat"), ("Longitude", "lon"), ("Altitude", "alt"))],
        tag("ImageDescription", meta["description"], some(meta["description"])), tag("XMP:Description", meta["description"], some(meta["description"])), tag("XMP:Rating", F.lit("5"), F.coalesce(meta["favorited"], F.lit(False))),
    )
    named = F.filter(F.coalesce(meta["people"], F.array().cast("array<string>")), lambda n: trimmed(n) != "")
    people = F.flatten(F.transform(named, lambda n: F.array(*[F.struct(F.lit(t).alias("tag"), F.lit("+=").alias("op"), n.alias("value")) for t in ("XMP:PersonInImage", "XMP:Subject")])))
    last = F.array(tag("XMP:Source", meta["url"], some(meta["url"])), tag("XMP:CreatorTool", meta["app_source"], some(meta["app_source"])), tag("XMP:Label", label, label != ""))
    tags = F.concat(F.array_compact(first), people, F.array_compact(last))
    return F.when(is_writable(ext) & extension_fits(ext, kind), tags).otherwise(F.slice(tags, 1, 0))

"""JSON sidecars as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.dates import epoch_of
from mediacat.functions.names import bound, trimmed

# The parts of a sidecar that are read.
SIDECAR_DDL = """title STRING, description STRING, favorited BOOLEAN, url STRING,
 photoTakenTime STRUCT<timestamp: STRING>, creationTime STRUCT<timestamp: STRING>,
 geoData STRUCT<latitude: DOUBLE, longitude: DOUBLE, altitude: DOUBLE, latitudeSpan: DOUBLE, longitudeSpan: DOUBLE>,
 people ARRAY<STRUCT<name: STRING>>, appSource STRUCT<androidPackageName: STRING>,
 googlePhotosOrigin STRUCT<composition: STRUCT<type: STRING>, fromSharedAlbum: MAP<STRING,STRING>,
  mobileUpload: STRUCT<deviceFolder: STRUCT<localFolderName: STRING>, deviceType: STRING>, webUpload: MAP<STRING,STRING>>,
 _corrupt STRING"""
TEXT_FIELDS = ("title", "description", "url")


def _json(raw: Column) -> Column:
    return F.from_json(raw, SIDECAR_DDL, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})


def title(raw: Column) -> Column:
    """Title of a sidecar; null if it is missing, empty or not a text, or the record is malformed."""
    text = lambda found: F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.try_variant_get(found, "$", "string"), F.lit("")))
    return bound(F.try_variant_get(F.try_parse_json(raw), "$.title", "variant"), text)


def sidecar(raw: Column) -> Column:
    """Struct of a sidecar's metadata; null for malformed records. A bare null is an empty record.

    taken_epoch and creation_epoch are seconds or null; geo is null unless latitude, longitude or altitude differs from
    0; people are trimmed, blanks dropped, order and repeats kept. A text field that holds no text makes the record
    malformed. Keys are compared with case. A record is read once by each of the two parsers.
    """

    def parsed(raw: Column) -> Column:
        return bound(F.try_parse_json(raw), lambda v: bound(_json(F.when(F.coalesce(F.is_variant_null(v), F.lit(False)), F.lit("{}")).otherwise(raw)), lambda j: _metadata(v, j)))

    return bound(raw, parsed)


def _metadata(variant: Column, j: Column) -> Column:
    """The struct, from a record as a variant and as the parts of SIDECAR_DDL."""
    odd = F.lit(False)
    for name in TEXT_FIELDS:
        kind = F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant"))
        odd = odd | ~F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
    text = lambda c: F.coalesce(trimmed(c), F.lit(""))
    geo, origin = j["geoData"], j["googlePhotosOrigin"]
    device, local = text(origin["mobileUpload"]["deviceType"]), text(origin["mobileUpload"]["deviceFolder"]["localFolderName"])
    zero = lambda n: F.coalesce(geo[n], F.lit(0.0))
    people = F.filter(F.transform(j["people"], lambda p: text(p["name"])), lambda n: n != "")
    out = F.struct(
        epoch_of(F.try_variant_get(variant, "$.photoTakenTime.timestamp", "variant")).alias("taken_epoch"), epoch_of(F.try_variant_get(variant, "$.creationTime.timestamp", "variant")).alias("creation_epoch"),
        F.when((zero("latitude") != 0) | (zero("longitude") != 0) | (zero("altitude") != 0), F.struct(*[zero(n).alias(a) for n, a in (("latitude", "lat"), ("longitude", "lon"), ("altitude", "alt"), ("latitudeSpan", "lat_span"), ("longitudeSpan", "lon_span"))])).alias("geo"),
        text(j["description"]).alias("description"), F.coalesce(j["favorited"], F.lit(False)).alias("favorited"), F.coalesce(people, F.array().cast("array<string>")).alias("people"), text(j["url"]).alias("url"), text(j["appSource"]["androidPackageName"]).alias("app_source"),
        F.struct(origin["fromSharedAlbum"].isNotNull().alias("from_shared_album"), origin["webUpload"].isNotNull().alias("web_upload"), ((device != "") | (local != "")).alias("mobile_upload"), text(origin["composition"]["type"]).alias("composition"), device.alias("device_type"), local.alias("device_folder")).alias("origin"),
    )
    return F.when(variant.isNotNull() & j["_corrupt"].isNull() & ~odd, out)

"""Registered queries: every catalog operator over derivations of the supplied tables.

Names, paths and sidecars are derived from the tables by expressions that Spark and the oracle read alike; what the
operators do with them is built from the package here and written out independently in SQL in `oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.functions import dates as D
from mediacat.functions import names as N
from mediacat.functions import tags as T
from mediacat.functions.sidecars import sidecar
from mediacat.operators import albums, dating, naming, registry, reports
from mediacat.operators.matching import match_sidecars

AS_OF = 2024
YMD = "CAST(2000 + doc_id % 25 AS STRING) || lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0') || lpad(CAST(1 + doc_id % 31 AS STRING), 2, '0')"
DASHED = "CAST(2000 + doc_id % 25 AS STRING) || '-' || lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + doc_id % 31 AS STRING), 2, '0')"
HMS = "lpad(CAST(doc_id % 24 AS STRING), 2, '0') || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || lpad(CAST(doc_id * 7 % 60 AS STRING), 2, '0')"
NAME = f"""CASE doc_id % 11
 WHEN 0 THEN 'IMG_' || {YMD} || '_' || {HMS} || '.jpg' WHEN 1 THEN 'Screenshot_' || {YMD} || '-' || {HMS} || '.png'
 WHEN 2 THEN 'signal-' || {DASHED} || '-' || {HMS} || '.jpg' WHEN 3 THEN 'IMG-' || {YMD} || '-WA' || lpad(CAST(doc_id % 10000 AS STRING), 4, '0') || '.jpg'
 WHEN 4 THEN 'Snapchat-' || CAST(1500000000 + doc_id AS STRING) || '.mp4' WHEN 5 THEN {YMD} || {HMS} || '123.jpg'
 WHEN 6 THEN 'holiday photo-' || CAST(doc_id AS STRING) || '.JPEG' WHEN 7 THEN 'VID_' || {YMD} || '_' || {HMS} || '.mov'
 WHEN 8 THEN 'DSC' || lpad(CAST(doc_id AS STRING), 5, '0') || '.heic' WHEN 9 THEN 'pxl_3' || substr({YMD}, 2) || '_' || {HMS} || '123.mp' ELSE 'notes ' || CAST(doc_id AS STRING) || '.txt' END"""
PATH = f"source || '/' || lang || '/' || {NAME}"
ALBUM_PATH = """CASE doc_id % 6 WHEN 0 THEN 'Google Photos/' || source || '/a.jpg' WHEN 1 THEN 'x/google photos/Albums/' || source || '/a.jpg' WHEN 2 THEN 'Google Photos/Photos from 2019/a.jpg'
 WHEN 3 THEN source || '/' || lang || '.jpg' WHEN 4 THEN 'a' || CAST(doc_id AS STRING) || '.jpg' ELSE 'Google Photos/Albums/' || lang || '.jpg' END"""
KEY_NAME = """CASE doc_id % 5 WHEN 0 THEN 'IMG ' || CAST(doc_id AS STRING) || '(2).jpg' WHEN 1 THEN 'b' || CAST(doc_id AS STRING) || '.jpg(3)' WHEN 2 THEN lang || '..' WHEN 3 THEN '.hidden' || CAST(doc_id AS STRING) ELSE 'c.' || source || '.mp4' END"""
KEY_JSON = """CASE doc_id % 6 WHEN 0 THEN 'IMG ' || CAST(doc_id AS STRING) || '.jpg.supplemental-metadata(1).json' WHEN 1 THEN 'b.jpg.SUPPL.json' WHEN 2 THEN lang || '.metadata.json' WHEN 3 THEN 'd' || CAST(doc_id AS STRING) || '(4).json' WHEN 4 THEN 'e.JSON' ELSE source || '...json' END"""
MEDIA_PATH = """source || '/' || CASE doc_id % 9 WHEN 0 THEN 'P' || CAST(doc_id AS STRING) || '.jpg' WHEN 1 THEN 'P' || CAST(doc_id AS STRING) || '-edited.jpg' WHEN 2 THEN 'M' || CAST(doc_id AS STRING) || '.MP'
 WHEN 3 THEN 'L' || CAST(doc_id AS STRING) || '.MP4' WHEN 4 THEN 'K' || CAST(doc_id AS STRING) || '(1).jpg' WHEN 5 THEN 'long_name_' || CAST(doc_id AS STRING) || '_cut.jpg' WHEN 6 THEN 'S' || CAST(doc_id AS STRING) || '.png' WHEN 7 THEN 'D' || CAST(doc_id % 40 AS STRING) || '.jpg' ELSE 'lost' || CAST(doc_id AS STRING) || '.gif' END"""
JSON_PATH = """CASE WHEN doc_id % 4 = 1 THEN 'other' ELSE source END || '/' || CASE doc_id % 9 WHEN 0 THEN 'P' || CAST(doc_id AS STRING) || '.jpg.json' WHEN 1 THEN 'x' || CAST(doc_id AS STRING) || '.json' WHEN 2 THEN 'y' || CAST(doc_id AS STRING) || '.json'
 WHEN 3 THEN 'L' || CAST(doc_id AS STRING) || '.HEIC.json' WHEN 4 THEN 'K' || CAST(doc_id AS STRING) || '(1).jpg.supplemental-metadata.json' WHEN 5 THEN 'trunc' || CAST(doc_id AS STRING) || '.json' WHEN 6 THEN 'z' || CAST(doc_id AS STRING) || '.json' WHEN 7 THEN 'D' || CAST(doc_id % 40 AS STRING) || '.jpg' || CASE WHEN doc_id % 2 = 0 THEN '(1)' ELSE '' END || '.json' ELSE 'metadata.json' END"""
JSON_TITLE = """CASE doc_id % 9 WHEN 0 THEN 'p' || CAST(doc_id AS STRING) || '.JPG' WHEN 1 THEN 'P' || CAST(doc_id AS STRING) || '.heic' WHEN 2 THEN 'm' || CAST(doc_id AS STRING) || '.mp.jpg'
 WHEN 3 THEN 'L' || CAST(doc_id AS STRING) || '.HEIC' WHEN 5 THEN 'long_name_' || CAST(doc_id AS STRING) || '_cut_off_here.jpg' WHEN 6 THEN 'S' || CAST(doc_id AS STRING) WHEN 7 THEN 'D' || CAST(doc_id % 40 AS STRING) || '.jpg' END"""
SIDECAR_JSON = """CASE WHEN event_id % 17 = 0 THEN '{"title": broken' ELSE '{"title":"t' || CAST(event_id AS STRING) || '","description":"  d' || CAST(event_id % 7 AS STRING) || ' ","favorited":' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END
 || ',"photoTakenTime":{"timestamp":"' || CAST(1500000000 + event_id AS STRING) || '"},"creationTime":{"timestamp":' || CAST(1600000000 + event_id AS STRING) || '},"geoData":{"latitude":' || CASE WHEN event_id % 4 = 0 THEN '0.0' ELSE CAST(event_id % 80 AS STRING) || '.5' END
 || ',"longitude":0.0,"altitude":0.0,"latitudeSpan":1.5},"people":[{"name":" Ann "},{"name":"  "},{"name":"' || event_type || '"}],"extra":' || props || '}' END"""
STAMP_JSON = """CASE event_id % 8 WHEN 0 THEN '"' || CAST(event_id AS STRING) || '"' WHEN 1 THEN '" 15 "' WHEN 2 THEN CAST(1500000000 + event_id AS STRING) WHEN 3 THEN '1.5e9' WHEN 4 THEN 'true' WHEN 5 THEN '"1.5e9"' WHEN 6 THEN 'null' ELSE '""' END"""
HEAD_HEX = """CASE doc_id % 9 WHEN 0 THEN 'FFD8FFE000104A4649460001' WHEN 1 THEN '89504E470D0A1A0A0000000D' WHEN 2 THEN '00000018667479706865696300' WHEN 3 THEN '52494646AABBCCDD57454250' WHEN 4 THEN '0000001866747970 6D696631' WHEN 5 THEN 'FFD8FFE0001' || '04A46494600' WHEN 6 THEN '00000018667479706865766300' WHEN 7 THEN 'FFD8FFE0001040' ELSE '474946383961000000000000' END"""
EXT = "CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.heif' ELSE '.gif' END"
SHOT = "source || '/' || lang || '/' || CASE WHEN doc_id % 5 = 0 THEN 'shot.JPEG' ELSE 'IMG_' || CAST(doc_id % 50 AS STRING) || '.jpeg' END"
PRIORITY = ["src3", "src1", "src9", "src7"]
SPEC = " 3, SRC1 ,2,src5,3, "
CUSTOM = [r"(?P<a_b>[0-9]{8})", r"[^[]([0-9]{8})", r"\pL+[_-](\d+)\.[[:alpha:]]+\z", r"(?i)img(?U).+(\d+)", r"\b(\w+?)\.(?:jpe?g|HEIC)$", r"(?s)\Q-\E(?P<x>[[:digit:]-]{3,}?)\x30"]
#: A layout, and how Spark writes a moment of the table that way (null parts of a day are lost).
LAYOUTS = [
    ("2006-01-02 15:04:05.000", "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')"), ("_2 Jan 2006 3:04:05pm", "concat(lpad(day(ts), 2, ' '), date_format(ts, ' MMM yyyy h:mm:ss'), lower(date_format(ts, 'a')))"), ("2006.002 15:4:5", "date_format(ts, 'yyyy.DDD H:m:s')"),
    ("Mon, 02 January 06 03:04 PM MST", "date_format(ts, \"EEE, dd MMMM yy hh:mm a 'UTC'\")"), ("2006-01-02T15:04:05-0700", "date_format(ts + INTERVAL 90 MINUTES, \"yyyy-MM-dd'T'HH:mm:ss.SS'+0130'\")"), ("1/2/06,3PM", "date_format(ts, 'M/d/yy,ha')"), ("2006-01-02", "concat(date_format(ts, 'yyyy-MM-dd'), 'x')"),
]
PREVIEW = D.CustomPattern(r"VID_(\d{8}_\d{6})", "20060102_150405")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def named(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.expr(PATH).alias("src_path"), F.expr(NAME).alias("name"))


def q01_media_filter(spark, d):
    rows = named(spark, d)
    return rows.filter(N.is_media(F.col("src_path")) & N.in_extensions(F.col("src_path"), ["JPG", " .mov", ""])).select("doc_id", "name")


def q02_scan_summary(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit(True).alias("labelled")).distinct()
    rows = docs(spark, d).select("doc_id", F.expr("CASE WHEN doc_id % 4 <> 0 THEN source END").alias("album")).join(labels, "doc_id", "left")
    return reports.scan_summary(rows.select("album", F.when(F.col("labelled"), F.col("doc_id").cast("string")).alias("sidecar_path")))


def q03_detect_album(spark, d):
    return docs(spark, d).select("doc_id", N.album_of(F.expr(ALBUM_PATH)).alias("album"))


def q04_strip_keys(spark, d):
    rows = docs(spark, d).select("doc_id", F.expr(KEY_NAME).alias("name"), F.expr(KEY_JSON).alias("json"))
    return rows.select("doc_id", N.stem(F.col("name")).alias("stem"), N.without_index(F.col("name")).alias("bare"), N.sidecar_key(F.col("json")).alias("json_key"), F.array_join(N.media_keys(F.col("name")), "|").alias("keys"))


def matched(spark, d):
    rows = docs(spark, d)
    media = rows.select(F.expr(MEDIA_PATH).alias("rel_path")).distinct()
    sidecars = rows.filter("doc_id % 13 <> 0").select(F.expr(JSON_PATH).alias("json_path"), F.expr(JSON_TITLE).alias("title")).dropDuplicates(["json_path"])
    return match_sidecars(media, sidecars)


def q05_sidecar_title_join(spark, d):
    return matched(spark, d).filter("rule <= 3").select("rel_path", "sidecar_path")


def q06_sidecar_cascade(spark, d):
    return matched(spark, d).select("rel_path", "sidecar_path", "rule")


def content(spark, d):
    path = "source || '/' || lpad(CAST(doc_id AS STRING), 9, '0') || '.jpg'"
    return docs(spark, d).select(F.expr(path).alias("rel_path"), F.lit(None).cast("string").alias("sidecar_path"), F.col("source").alias("album"), F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 50 != 0, F.sha2("text", 256)).alias("hash"))


def q07_content_registry(spark, d):
    got = registry.register(content(spark, d))
    return got.select("key", "src_path", F.array_join("albums", ",").alias("albums"), "size", "n_files")


def q08_size_groups(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("rel_path"), F.octet_length("text").cast("long").alias("size"), "text")
    return registry.size_groups(rows, F.sha2("text", 256)).groupBy("grp").agg(F.count("*").alias("n"))


def q09_hash_cache(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("rel_path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns"), "text")
    cache = docs(spark, d).select(
        F.col("doc_id").cast("string").alias("path"), F.expr("CASE WHEN doc_id % 5 = 1 THEN n_chars + 1 ELSE n_chars END").alias("size"),
        F.expr("CASE WHEN doc_id % 5 = 2 THEN 0 ELSE doc_id * 1000 END").alias("mtime_ns"), F.expr("CASE WHEN doc_id % 5 = 3 THEN '' ELSE 'cached' || CAST(doc_id AS STRING) END").alias("hash"),
    )
    return registry.hash_files(rows, cache, F.sha2("text", 256)).select("rel_path", "hash")


def q10_merge_best(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs(spark, d).join(labels, "doc_id", "left").select(
        F.sha2("text", 256).alias("grp"), F.expr("source || '/' || CAST(doc_id AS STRING) || '.jpg'").alias("src_path"), F.coalesce(F.col("quality") + 1, F.lit(99)).alias("date_accuracy"), F.array("source").alias("albums"))
    return registry.merge_duplicates(rows).select("grp", "src_path", "date_accuracy", F.array_join("albums", ",").alias("albums"))


def q11_sidecar_json(spark, d):
    m = spark.read.parquet(f"{d}/events.parquet").select("event_id", sidecar(F.expr(SIDECAR_JSON)).alias("m"))
    return m.select("event_id", "m.taken_epoch", "m.creation_epoch", "m.description", "m.favorited", F.col("m.geo.lat").alias("lat"), F.col("m.geo.lat_span").alias("lat_span"), F.array_join("m.people", ",").alias("people"))


def q12_timestamp_coerce(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", D.epoch_of(F.try_parse_json(F.expr(STAMP_JSON))).alias("epoch"))


def q13_filename_date(spark, d):
    return named(spark, d).select("doc_id", F.unix_timestamp(D.name_date(F.col("name"))).alias("epoch"))


def proposals(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").filter("event_id % 3 <> 0").select(F.col("event_id").alias("doc_id"), F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("taken_epoch"), F.lit(None).cast("long").alias("creation_epoch")).alias("meta"))
    sidecars = events.select(F.concat(F.lit("j"), F.col("doc_id").cast("string")).alias("json_path"), "meta")
    photos = named(spark, d).select("doc_id", "src_path", F.concat(F.lit("j"), F.col("doc_id").cast("string")).alias("json_path"))
    tags = named(spark, d).filter("doc_id % 2 = 0").select(F.col("src_path").alias("rel_path"), F.expr("CASE WHEN doc_id % 4 = 0 THEN '0000-00-00T00:00:00' ELSE '2011:02:03 04:05:06' END").alias("date_time_original"), F.lit("2012-03-04T05:06:07+0200").alias("create_date"), *[F.lit(None).cast("string").alias(c) for c in ("media_create_date", "track_create_date")])
    return dating.propose_dates(photos, sidecars, AS_OF, tags=tags)


def q14_best_date(spark, d):
    return proposals(spark, d).select("doc_id", F.unix_timestamp("proposed").alias("epoch"), "accuracy")


def q15_date_review(spark, d):
    return dating.review(proposals(spark, d), AS_OF)


def q16_unknown_groups(spark, d):
    return dating.unknown_groups(named(spark, d)).select("shape", "n", F.array_join("examples", "|").alias("examples"))


def q17_pattern_preview(spark, d):
    return dating.preview_pattern(named(spark, d), PREVIEW)


def q18_exclusions(spark, d):
    names = named(spark, d).filter("doc_id % 11 = 6 AND doc_id % 2 = 0").select(F.col("name").alias("base"))
    return dating.excluded_flag(named(spark, d), names).select("doc_id", "excluded")


def q19_distinct_albums(spark, d):
    return albums.distinct_albums(registry.register(content(spark, d)))


def q20_album_select(spark, d):
    return albums.selected_albums(q19_distinct_albums(spark, d), SPEC)


def q21_final_album(spark, d):
    return albums.assign_albums(registry.register(content(spark, d)), PRIORITY).select("key", "final_album")


def q22_album_summary(spark, d):
    return albums.album_summary(q21_final_album(spark, d))


def q23_file_kind(spark, d):
    rows = docs(spark, d).select("doc_id", F.unhex(F.expr(f"replace({HEAD_HEX}, ' ', '')")).alias("head"), F.expr(EXT).alias("ext"))
    rows = rows.withColumn("kind", N.file_kind(F.col("head")))
    return rows.select("doc_id", "kind", N.kind_extension(F.col("kind")).alias("usual"), N.extension_fits(F.col("ext"), F.col("kind")).alias("fits"))


def q24_output_path(spark, d):
    rows = docs(spark, d).select(F.expr(f"lpad(CAST(doc_id AS STRING), 9, '0') || '/' || {SHOT}").alias("src_path"), F.when(F.col("doc_id") % 7 != 0, F.sha2("text", 256)).alias("hash"), F.expr("CASE WHEN doc_id % 3 <> 0 THEN source END").alias("final_album"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'jpeg' ELSE 'unknown' END").alias("kind"))
    return naming.output_manifest(rows).select("src_path", "dst_path")


def entries(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    origin = F.struct((F.col("event_id") % 2 == 0).alias("from_shared_album"), (F.col("event_id") % 3 == 0).alias("web_upload"), (F.col("event_id") % 5 == 0).alias("mobile_upload"), F.expr("CASE WHEN event_id % 7 = 0 THEN 'COLLAGE' ELSE '' END").alias("composition"), F.expr("CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END").alias("device_type"), F.lit("").alias("device_folder"))
    meta = F.struct(
        F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp")).alias("taken"), F.when(F.col("event_id") % 6 == 0, F.col("ts").cast("timestamp")).alias("creation"),
        F.when(F.col("event_id") % 5 == 1, F.struct((F.col("event_id") % 90 + 0.25).cast("double").alias("lat"), F.lit(-0.5).alias("lon"), F.lit(12.0).alias("alt"))).alias("geo"), F.expr("CASE WHEN event_id % 8 = 0 THEN event_type ELSE '' END").alias("description"),
        (F.col("event_id") % 9 == 0).alias("favorited"), F.when(F.col("event_id") % 10 == 0, F.array(F.lit("Ann"), F.lit("  "))).otherwise(F.array().cast("array<string>")).alias("people"), F.lit("").alias("url"), F.expr("CASE WHEN event_id % 12 = 0 THEN 'app' ELSE '' END").alias("app_source"), origin.alias("origin"),
    )
    return e.select("event_id", F.expr("'Library/' || CAST(event_id AS STRING) || CASE event_id % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' WHEN 3 THEN '.txt' ELSE '.heic' END").alias("dst_path"), F.expr("CASE WHEN event_id % 10 = 2 THEN 'jpeg' ELSE 'unknown' END").alias("kind"), meta.alias("meta"))


def q25_tag_manifest(spark, d):
    return naming.tag_manifest(entries(spark, d))


def q26_origin_label(spark, d):
    return entries(spark, d).select("event_id", T.origin_label(F.col("meta.origin"), T.ORIGIN).alias("label"))


def q27_writable_meta(spark, d):
    return entries(spark, d).select("event_id", T.has_writable_meta(F.col("meta")).alias("writable"))


def q28_custom_patterns(spark, d):
    rows = named(spark, d)
    return rows.select("doc_id", *[F.coalesce(p.target(F.col("name")), F.lit("-")).alias(f"p{i}") for i, p in enumerate(map(D.CustomPattern, CUSTOM, CUSTOM), 1)])


def q29_layouts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    kind = F.pmod("event_id", F.lit(len(LAYOUTS)))
    text, epoch = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    for i, (layout, written) in enumerate(LAYOUTS):
        text = F.when(kind == i, F.expr(written)).otherwise(text)
    rows = e.withColumn("text", text)
    for i, (layout, _) in enumerate(LAYOUTS):
        epoch = F.when(kind == i, D.layout_date(F.col("text"), layout)).otherwise(epoch)
    return rows.select("event_id", F.unix_micros(epoch).alias("micros"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "q" and k[1:3].isdigit()}

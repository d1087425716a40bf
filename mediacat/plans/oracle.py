"""The same queries as `queries` in SQL, written independently of the package's operators."""

from __future__ import annotations

from mediacat.plans import queries as Q

NAMED = f"SELECT doc_id, {Q.PATH} AS src_path, {Q.NAME} AS name FROM documents"
CONTENT = "SELECT doc_id, source || '/' || lpad(CAST(doc_id AS STRING), 9, '0') || '.jpg' AS rel_path, source AS album, CAST(octet_length(encode(text)) AS BIGINT) AS size, CASE WHEN doc_id % 50 <> 0 THEN sha256(text) END AS hash FROM documents"
REGISTRY = f"SELECT coalesce(hash, 'nohash:' || rel_path) AS key, arg_min(rel_path, string_split(rel_path, '/')) AS src_path, list_sort(list(DISTINCT album)) AS albums, arg_max(size, string_split(rel_path, '/')) AS size, count(*) AS n_files FROM ({CONTENT}) GROUP BY 1"
NAME_DATE = r"""coalesce(
 try_strptime(nullif(regexp_extract(name, '(20|19|18)\d{2}(0[1-9]|1[0-2])[0-3]\d-\d{6}'), ''), '%Y%m%d-%H%M%S'),
 try_strptime(nullif(regexp_extract(name, '(20|19|18)\d{2}(0[1-9]|1[0-2])[0-3]\d_\d{6}'), ''), '%Y%m%d_%H%M%S'),
 try_strptime(nullif(regexp_extract(name, '(20|19|18)\d{2}-(0[1-9]|1[0-2])-[0-3]\d-\d{2}-\d{2}-\d{2}'), ''), '%Y-%m-%d-%H-%M-%S'),
 try_strptime(nullif(regexp_extract(name, '(20|19|18)\d{2}-(0[1-9]|1[0-2])-[0-3]\d-\d{6}'), ''), '%Y-%m-%d-%H%M%S'),
 try_strptime(nullif(substr(regexp_extract(name, '(20|19|18)\d{2}(0[1-9]|1[0-2])[0-3]\d\d{7,}'), 1, 14), ''), '%Y%m%d%H%M%S'),
 try_strptime(nullif(regexp_extract(name, '(20|19|18)\d{2}_(0[1-9]|1[0-2])_[0-3]\d_\d{2}_\d{2}_\d{2}'), ''), '%Y_%m_%d_%H_%M_%S'),
 try_strptime(nullif(regexp_extract(name, '(?i)(IMG|VID)-(\d{8})-WA\d+', 2), ''), '%Y%m%d'),
 make_timestamp(1000000 * try_cast(nullif(regexp_extract(name, '(?i)Snapchat-(\d{10})', 1), '') AS BIGINT)),
 CASE WHEN regexp_matches(name, 'PXL_\d{8}_\d{6}') THEN try_strptime(regexp_extract(name, 'PXL_(\d{8}_\d{6})', 1), '%Y%m%d_%H%M%S') END,
 try_strptime(nullif(substr(regexp_extract(name, '(?i)PXL_(\d{8}_\d{9})', 1), 1, 15), ''), '%Y%m%d_%H%M%S'),
 CASE WHEN regexp_matches(name, 'IMG_\d{8}_\d{6}') THEN try_strptime(regexp_extract(name, 'IMG_(\d{8}_\d{6})', 1), '%Y%m%d_%H%M%S') END)"""
PROPOSALS = f"""SELECT n.doc_id, date_trunc('second', e.ts) AS json_time, n.name_time,
 CASE WHEN e.ts IS NULL AND n.name_time IS NULL AND n.doc_id % 2 = 0 THEN CASE WHEN n.doc_id % 4 = 0 THEN TIMESTAMP '2012-03-04 03:06:07' ELSE TIMESTAMP '2011-02-03 04:05:06' END END AS tag_time
 FROM (SELECT doc_id, {NAME_DATE} AS name_time FROM ({NAMED})) n LEFT JOIN (SELECT * FROM events WHERE event_id % 3 <> 0) e ON e.event_id = n.doc_id"""
EARLIER = f"name_time < json_time AND year(name_time) BETWEEN 1990 AND {Q.AS_OF + 1}"
CASCADE = rf"""
WITH media AS (SELECT DISTINCT {Q.MEDIA_PATH} AS rel_path FROM documents),
side AS (SELECT DISTINCT {Q.JSON_PATH} AS json_path, {Q.JSON_TITLE} AS title FROM documents WHERE doc_id % 13 <> 0),
s AS (SELECT json_path, regexp_extract(json_path, '[^/]*$') AS jb, lower(title) AS title FROM side WHERE regexp_matches(lower(json_path), '\.json$') AND json_path NOT LIKE '%/metadata.json'),
m AS (
  SELECT rel_path, regexp_extract(rel_path, '[^/]*$') AS b, regexp_replace(rel_path, '/[^/]*$', '') AS dir FROM media),
mm AS (SELECT *, regexp_replace(b, '\.[^.]*$', '') AS st, lower(regexp_extract(b, '\.[^.]*$')) AS ext FROM m),
title_probe AS (
  SELECT rel_path, 1 AS rule, 0 AS ord, lower(b) AS k, b AS base FROM mm UNION ALL SELECT rel_path, 2, 0, lower(st), st FROM mm
  UNION ALL SELECT rel_path, 3, o, lower(b) || e, b || e FROM mm, (VALUES (0, '.jpg'), (1, '.jpeg')) v(o, e) WHERE ext = '.mp'
  UNION ALL SELECT rel_path, 4, o, lower(st) || e, lower(st) || e FROM mm, (VALUES (0, '.heic'), (1, '.jpg'), (2, '.jpeg'), (3, '.png')) v(o, e) WHERE ext IN ('.mp4', '.mov')),
key_probe AS (
  SELECT rel_path, 5 AS rule, o AS ord, k, b AS base FROM (SELECT rel_path, b, 0 AS o, b AS k FROM mm UNION ALL SELECT rel_path, b, 1, st FROM mm UNION ALL SELECT rel_path, b, 2, regexp_replace(b, '\(\d+\)$', '') FROM mm UNION ALL SELECT rel_path, b, 3, regexp_replace(st, '\(\d+\)$', '') FROM mm)),
keyed AS (
  SELECT json_path, jb, CASE WHEN regexp_matches(lower(k), '\.supp') THEN regexp_replace(k, '(?i)\.supp.*$', '') ELSE regexp_replace(k, '(?i)\.meta.*$', '') END AS k
  FROM (SELECT json_path, jb, regexp_replace(regexp_replace(regexp_replace(jb, '\.json$', ''), '\.+$', ''), '\(\d+\)$', '') AS k FROM s WHERE jb LIKE '%.json')),
hits AS (
  SELECT p.rel_path, rule, ord, 0 AS short, base, json_path, jb FROM title_probe p JOIN s ON s.title = p.k
  UNION ALL SELECT p.rel_path, rule, ord, 0, base, json_path, jb FROM key_probe p JOIN keyed ON keyed.k = p.k
  UNION ALL SELECT rel_path, 6, 0, length(title) - length(ext), NULL, json_path, jb FROM mm JOIN s ON regexp_replace(s.json_path, '/[^/]*$', '') = dir AND ext <> '' AND ends_with(s.title, ext) AND starts_with(substr(s.title, 1, length(title) - length(ext)), lower(st))
  UNION ALL SELECT rel_path, 7, 0, 0, b, json_path, jb FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(st)), '\(\d+\)$', ''), '(-edited|-collage|-color_pop|-photo_frame|-overlayed)$', '') AS nb FROM mm) a
    JOIN (SELECT *, regexp_replace(regexp_replace(regexp_replace(title, '\.[^.]*$', ''), '\(\d+\)$', ''), '(-edited|-collage|-color_pop|-photo_frame|-overlayed)$', '') AS ns FROM s WHERE title IS NOT NULL) c ON nb = ns AND nb <> ''),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY rule, ord, short, CASE WHEN base IS NULL OR (starts_with(jb, base) AND regexp_matches(substr(jb, length(base) + 1), '^(\(\d+\))?(\.supplemental-metadata|\.metadata)?\.json$')) THEN 0 ELSE 1 END, string_split(json_path, '/')) AS r FROM hits)
"""
ENTRIES = """SELECT event_id, 'Library/' || CAST(event_id AS STRING) || CASE event_id % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' WHEN 3 THEN '.txt' ELSE '.heic' END AS dst_path,
 event_id % 5 IN (0, 1, 4) OR (event_id % 5 = 2 AND event_id % 10 <> 2) AS fits, event_id % 5 = 0 AS video, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') || '+00:00' END AS taken, CASE WHEN event_id % 6 = 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') || '+00:00' END AS creation,
 CASE WHEN event_id % 5 = 1 THEN printf('%.6f', event_id % 90 + 0.25) END AS lat, CASE WHEN event_id % 8 = 0 THEN event_type ELSE '' END AS description, event_id % 9 = 0 AS favorited, event_id % 10 = 0 AS ann, CASE WHEN event_id % 12 = 0 THEN 'app' ELSE '' END AS app,
 array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN 'fromSharedAlbum' END, CASE WHEN event_id % 3 = 0 THEN 'webUpload' END, CASE WHEN event_id % 5 = 0 THEN 'mobileUpload' END, CASE WHEN event_id % 7 = 0 THEN 'composition=COLLAGE' END, CASE WHEN event_id % 5 = 0 THEN 'deviceType=' || event_type END], lambda x: x IS NOT NULL), ',') AS parts FROM events"""
LABEL = "CASE WHEN parts <> '' THEN 'origin:' || parts ELSE '' END"
TAGS = f"""list_filter([
 CASE WHEN taken IS NOT NULL THEN {{'tag': 'DateTimeOriginal', 'op': '=', 'value': taken}} END, CASE WHEN taken IS NOT NULL THEN {{'tag': 'CreateDate', 'op': '=', 'value': taken}} END,
 CASE WHEN taken IS NOT NULL AND video THEN {{'tag': 'MediaCreateDate', 'op': '=', 'value': taken}} END, CASE WHEN taken IS NOT NULL AND video THEN {{'tag': 'TrackCreateDate', 'op': '=', 'value': taken}} END,
 CASE WHEN creation IS NOT NULL THEN {{'tag': 'XMP:CreateDate', 'op': '=', 'value': creation}} END, CASE WHEN lat IS NOT NULL THEN {{'tag': 'GPSLatitude', 'op': '=', 'value': lat}} END,
 CASE WHEN lat IS NOT NULL THEN {{'tag': 'GPSLongitude', 'op': '=', 'value': '-0.500000'}} END, CASE WHEN lat IS NOT NULL THEN {{'tag': 'GPSAltitude', 'op': '=', 'value': '12.000000'}} END,
 CASE WHEN description <> '' THEN {{'tag': 'ImageDescription', 'op': '=', 'value': description}} END, CASE WHEN description <> '' THEN {{'tag': 'XMP:Description', 'op': '=', 'value': description}} END, CASE WHEN favorited THEN {{'tag': 'XMP:Rating', 'op': '=', 'value': '5'}} END,
 CASE WHEN ann THEN {{'tag': 'XMP:PersonInImage', 'op': '+=', 'value': 'Ann'}} END, CASE WHEN ann THEN {{'tag': 'XMP:Subject', 'op': '+=', 'value': 'Ann'}} END, CASE WHEN app <> '' THEN {{'tag': 'XMP:CreatorTool', 'op': '=', 'value': app}} END,
 CASE WHEN parts <> '' THEN {{'tag': 'XMP:Label', 'op': '=', 'value': {LABEL}}} END], lambda x: x IS NOT NULL)"""
PRIORITY = "[" + ", ".join(f"'{p}'" for p in Q.PRIORITY) + "]"
FINAL = f"SELECT key, list_filter({PRIORITY}, lambda p: list_contains(albums, p))[1] AS final_album FROM ({REGISTRY})"
KIND = """CASE WHEN length(h) < 24 THEN 'unknown' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png'
 WHEN substr(h, 9, 8) = '66747970' AND substr(h, 17, 8) IN ('68656963', '68656978', '68656966', '68657663', '6865696D', '68656973') THEN 'heic' WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'webp' ELSE 'unknown' END"""

ORACLE = {
    "q01_media_filter": f"SELECT doc_id, name FROM ({NAMED}) WHERE ends_with(lower(name), '.jpg') OR ends_with(lower(name), '.mov')",
    "q02_scan_summary": "SELECT count(*) AS n_files, count(*) FILTER (doc_id % 4 <> 0) AS n_with_album, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS n_with_sidecar FROM documents",
    "q03_detect_album": f"""WITH p AS (SELECT doc_id, string_split({Q.ALBUM_PATH}, '/') AS s FROM documents), a AS (SELECT *, coalesce(list_position(list_transform(s, lambda x: lower(x)), 'google photos'), 0) AS pos FROM p),
 n AS (SELECT doc_id, CASE WHEN pos > 0 THEN CASE WHEN lower(s[pos + 1]) = 'albums' AND len(s) >= pos + 2 THEN s[pos + 2] ELSE s[pos + 1] END WHEN len(s) > 1 THEN s[1] END AS album FROM a)
 SELECT doc_id, CASE WHEN album NOT LIKE 'Photos from%' THEN album END AS album FROM n""",
    "q04_strip_keys": rf"""WITH b AS (SELECT doc_id, {Q.KEY_NAME} AS name, {Q.KEY_JSON} AS json FROM documents),
 c AS (SELECT *, regexp_replace(name, '\.+$', '') AS bare2, regexp_replace(regexp_replace(regexp_replace(json, '\.json$', ''), '\.+$', ''), '\(\d+\)$', '') AS k FROM b),
 e AS (SELECT *, regexp_replace(bare2, '\.[^.]*$', '') AS st FROM c),
 f AS (SELECT *, list_filter(list_transform([bare2, st, regexp_replace(bare2, '\(\d+\)$', ''), regexp_replace(st, '\(\d+\)$', '')], lambda x: trim(x)), lambda x: x <> '') AS ks FROM e)
 SELECT doc_id, regexp_replace(name, '\.[^.]*$', '') AS stem, regexp_replace(name, '\(\d+\)$', '') AS bare,
  CASE WHEN json LIKE '%.json' THEN CASE WHEN regexp_matches(lower(k), '\.supp') THEN regexp_replace(k, '(?i)\.supp.*$', '') ELSE regexp_replace(k, '(?i)\.meta.*$', '') END END AS json_key,
  array_to_string([ks[i] FOR i IN range(1, len(ks) + 1) IF list_position(ks, ks[i]) = i], '|') AS keys FROM f""",
    "q05_sidecar_title_join": CASCADE + "SELECT rel_path, json_path AS sidecar_path FROM ranked WHERE r = 1 AND rule <= 3",
    "q06_sidecar_cascade": CASCADE + "SELECT media.rel_path, json_path AS sidecar_path, rule FROM media LEFT JOIN (SELECT * FROM ranked WHERE r = 1) b ON b.rel_path = media.rel_path",
    "q07_content_registry": f"SELECT key, src_path, array_to_string(albums, ',') AS albums, size, n_files FROM ({REGISTRY})",
    "q08_size_groups": "WITH s AS (SELECT text, octet_length(encode(text)) AS size FROM documents), g AS (SELECT *, count(*) OVER (PARTITION BY size) AS k FROM s) SELECT CASE WHEN k = 1 THEN 'size:' || size ELSE sha256(text) END AS grp, count(*) AS n FROM g GROUP BY 1",
    "q09_hash_cache": "SELECT CAST(doc_id AS VARCHAR) AS rel_path, CASE WHEN doc_id % 5 IN (0, 4) OR (doc_id % 5 = 2 AND doc_id = 0) THEN 'cached' || doc_id ELSE sha256(text) END AS hash FROM documents",
    "q10_merge_best": """WITH r AS (SELECT sha256(text) AS grp, source || '/' || doc_id || '.jpg' AS src_path, coalesce(q + 1, 99) AS acc, source FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) USING (doc_id))
 SELECT grp, arg_min(src_path, {'a': acc, 'b': octet_length(encode(src_path)), 'c': string_split(src_path, '/')}) AS src_path, min(acc) AS date_accuracy, array_to_string(list_sort(list(DISTINCT source)), ',') AS albums FROM r GROUP BY grp""",
    "q11_sidecar_json": """SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN 1500000000 + event_id END AS taken_epoch, CASE WHEN event_id % 17 <> 0 THEN 1600000000 + event_id END AS creation_epoch, CASE WHEN event_id % 17 <> 0 THEN 'd' || (event_id % 7) END AS description,
 CASE WHEN event_id % 17 <> 0 THEN event_id % 3 = 0 END AS favorited, CASE WHEN event_id % 17 <> 0 AND event_id % 4 <> 0 THEN event_id % 80 + 0.5::DOUBLE END AS lat, CASE WHEN event_id % 17 <> 0 AND event_id % 4 <> 0 THEN 1.5::DOUBLE END AS lat_span, CASE WHEN event_id % 17 <> 0 THEN 'Ann,' || event_type END AS people FROM events""",
    "q12_timestamp_coerce": rf"SELECT event_id, CASE json_type(j) WHEN 'VARCHAR' THEN CASE WHEN regexp_matches(trim(j ->> '$'), '^[+-]?\d+$') THEN try_cast(trim(j ->> '$') AS BIGINT) END WHEN 'UBIGINT' THEN CAST(j AS BIGINT) WHEN 'BIGINT' THEN CAST(j AS BIGINT) WHEN 'DOUBLE' THEN CAST(trunc(CAST(j AS DOUBLE)) AS BIGINT) END AS epoch FROM (SELECT event_id, CAST({Q.STAMP_JSON} AS JSON) AS j FROM events)",
    "q13_filename_date": f"SELECT doc_id, CAST(epoch({NAME_DATE}) AS BIGINT) AS epoch FROM ({NAMED})",
    "q14_best_date": f"SELECT doc_id, CAST(epoch(CASE WHEN json_time IS NOT NULL AND NOT coalesce({EARLIER}, false) THEN json_time ELSE coalesce(name_time, tag_time) END) AS BIGINT) AS epoch, CASE WHEN json_time IS NOT NULL AND NOT coalesce({EARLIER}, false) THEN 1 WHEN name_time IS NOT NULL THEN 2 WHEN tag_time IS NOT NULL THEN 3 ELSE 99 END AS accuracy FROM ({PROPOSALS})",
    "q15_date_review": f"SELECT CASE WHEN json_time IS NOT NULL THEN CASE WHEN {EARLIER} THEN 'override' END WHEN name_time IS NOT NULL THEN 'name_only' WHEN tag_time IS NOT NULL THEN 'tags_only' ELSE 'unknown' END AS review, count(*) AS n FROM ({PROPOSALS}) GROUP BY 1 HAVING review IS NOT NULL",
    "q16_unknown_groups": f"""WITH s AS (SELECT translate(regexp_replace(name, '[0-9]+', '#', 'g'), ' -.ABCDEFGHIJKLMNOPQRSTUVWXYZ', '___abcdefghijklmnopqrstuvwxyz') AS shape, name, src_path FROM ({NAMED})), r AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY string_split(src_path, '/')) AS r, count(*) OVER (PARTITION BY shape) AS n FROM s)
 SELECT shape, n, string_agg(name, '|' ORDER BY r) AS examples FROM r WHERE r <= 3 GROUP BY shape, n ORDER BY n DESC, shape LIMIT 50""",
    "q17_pattern_preview": rf"SELECT name AS base, regexp_matches(name, 'VID_\d{{8}}_\d{{6}}') AS matched, strftime(try_strptime(nullif(regexp_extract(name, 'VID_(\d{{8}}_\d{{6}})', 1), ''), '%Y%m%d_%H%M%S'), '%Y-%m-%dT%H:%M:%SZ') AS date FROM ({NAMED})",
    "q18_exclusions": "SELECT doc_id, doc_id % 11 = 6 AND doc_id % 2 = 0 AS excluded FROM documents",
    "q19_distinct_albums": "SELECT DISTINCT source AS album FROM documents",
    "q20_album_select": "WITH a AS (SELECT album, row_number() OVER (ORDER BY album) AS i FROM (SELECT DISTINCT source AS album FROM documents)), w(ord, i, name) AS (VALUES (1, 3, NULL), (2, NULL, 'src1'), (3, 2, NULL), (4, NULL, 'src5')), p AS (SELECT min(w.ord) AS o, album FROM w JOIN a ON a.i = w.i OR a.album = w.name GROUP BY album) SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS ord, album FROM p",
    "q21_final_album": FINAL,
    "q22_album_summary": f"SELECT coalesce(final_album, '(library)') AS album, count(*) AS n FROM ({FINAL}) GROUP BY 1",
    "q23_file_kind": f"""SELECT doc_id, kind, CASE kind WHEN 'jpeg' THEN '.jpg' WHEN 'png' THEN '.png' WHEN 'heic' THEN '.heic' WHEN 'webp' THEN '.webp' END AS usual, kind = 'unknown' OR doc_id % 4 = 3 OR kind = CASE doc_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'heic' END AS fits
 FROM (SELECT doc_id, {KIND} AS kind FROM (SELECT doc_id, replace({Q.HEAD_HEX}, ' ', '') AS h FROM documents))""",
    "q24_output_path": f"""WITH r AS (SELECT lpad(CAST(doc_id AS STRING), 9, '0') || '/' || {Q.SHOT} AS src_path, CASE WHEN doc_id % 7 <> 0 THEN substr(sha256(text), 1, 8) END AS h8, CASE WHEN doc_id % 3 <> 0 THEN 'Albums/' || source ELSE 'Library' END AS dir,
  CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'shot.JPEG.jpg' ELSE 'shot.JPEG' END ELSE 'IMG_' || (doc_id % 50) || CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.jpeg' END END AS name FROM documents),
 a AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY string_split(src_path, '/')) AS r FROM r),
 b AS (SELECT *, CASE WHEN r > 1 AND h8 IS NOT NULL THEN row_number() OVER (PARTITION BY dir, name, h8, r > 1 ORDER BY string_split(src_path, '/')) END AS k FROM a),
 c AS (SELECT *, CASE WHEN r > 1 AND coalesce(k, 2) > 1 THEN row_number() OVER (PARTITION BY dir, name, r > 1 AND coalesce(k, 2) > 1 ORDER BY string_split(src_path, '/')) END AS q FROM b)
 SELECT src_path, dir || '/' || regexp_replace(name, '\\.[^.]*$', '') || CASE WHEN r = 1 THEN '' WHEN q IS NULL THEN '-' || h8 ELSE '-' || q END || regexp_extract(name, '\\.[^.]*$') AS dst_path FROM c""",
    "q25_tag_manifest": f"SELECT dst_path, CAST(i - 1 AS INTEGER) AS ord, tags[i].tag AS tag, tags[i].op AS op, tags[i].value AS value FROM (SELECT dst_path, tags, unnest(range(1, len(tags) + 1)) AS i FROM (SELECT dst_path, {TAGS} AS tags FROM ({ENTRIES}) WHERE fits))",
    "q26_origin_label": f"SELECT event_id, {LABEL} AS label FROM ({ENTRIES})",
    "q27_writable_meta": f"SELECT event_id, taken IS NOT NULL OR creation IS NOT NULL OR lat IS NOT NULL OR description <> '' OR favorited OR ann OR app <> '' OR parts <> '' AS writable FROM ({ENTRIES})",
    "q28_custom_patterns": "SELECT doc_id, " + ", ".join(f"CASE WHEN regexp_matches(name, '{p}') THEN regexp_extract(name, '{p}', 1) ELSE '-' END AS p{i}" for i, p in enumerate(Q.CUSTOM, 1)) + f" FROM ({NAMED})",
    "q29_layouts": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN epoch_us(ts) // 1000 * 1000 WHEN 1 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 3 THEN epoch_us(ts) // 60000000 * 60000000 WHEN 4 THEN epoch_us(ts) // 10000 * 10000 WHEN 5 THEN epoch_us(ts) // 3600000000 * 3600000000 END AS micros FROM events",
}

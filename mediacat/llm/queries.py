"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import bpe_codec, jpeg, kmeans, neardup, packing, quality, revisit, rules, token_counts, topk, toxicity, urls, vacodes
from mediacat.llm.common import table

URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page: its full response, and a later one that a server answers with 304.

    Every seventh page has changed its entity tag by then; every fifth sends only a date; every eleventh page was not
    stored at first.
    """
    tag, date = F.md5(F.coalesce("html", F.lit(""))), F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))
    stored = F.create_map(F.lit("ETag"), F.concat(F.lit('"'), tag, F.lit('"')), F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"))
    fresh = F.when(F.col("page_id") % 5 == 0, F.create_map(F.lit("last-modified"), date, F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-type"), F.lit("text/plain")))
    tagged = F.concat(F.lit('W/"'), F.when(F.col("page_id") % 7 == 0, F.lit("changed")).otherwise(tag), F.lit('"'))
    fresh = fresh.otherwise(F.create_map(F.lit("etag"), tagged, F.lit("date"), F.lit("later"), F.lit("content-length"), F.lit("0")))
    first = pages.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status"), stored.alias("headers"), tag.alias("digest"))
    later = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + 1_000_000_000).alias("ts"), F.lit(304).alias("status"), fresh.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return first.unionByName(later)


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = revisit.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return got.select("record_id", "state", "source_id", "digest", text.alias("headers"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_jpeg_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op12_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vacodes.product_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50).drop("scored")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_importance_resampling, op4_compression_bands, op5_revisit_resolution, op6_minhash_dedup, op7_jpeg_thumbnails, op8_url_filters, op9_sum_of_squares_packing, op10_bpe_round_trip, op11_sort_means, op12_va_codes, op13_block_top_k)}


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, 'day ' || (page_id % 1000) AS date,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '^www\.', ''), ':(80|443)?$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_\w+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)'))) AS args FROM p),
k AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS key FROM q),
source AS (SELECT key, arg_max(page_id, page_id) AS src FROM k WHERE page_id % 11 <> 0 AND key IS NOT NULL GROUP BY key),
later AS (
  SELECT k.page_id, k.tag, k.date, s.page_id AS src, s.tag AS old_tag, s.date AS old_date,
    CASE WHEN s.page_id IS NULL THEN 'orphan' WHEN k.page_id % 5 = 0 THEN CASE WHEN k.date = s.date THEN 'resolved' ELSE 'mismatch' END
      WHEN (CASE WHEN k.page_id % 7 = 0 THEN 'changed' ELSE k.tag END) = s.tag THEN 'resolved' ELSE 'mismatch' END AS state
  FROM k LEFT JOIN source USING (key) LEFT JOIN k AS s ON s.page_id = source.src)
SELECT 2 * page_id AS record_id, CASE WHEN page_id % 11 = 0 THEN 'other' ELSE 'full' END AS state, CASE WHEN page_id % 11 <> 0 THEN 2 * page_id END AS source_id,
  CASE WHEN page_id % 11 <> 0 THEN tag END AS digest, CASE WHEN page_id % 11 <> 0 THEN 'cache-control=max-age=60;content-type=text/html;etag="' || tag || '";last-modified=' || date END AS headers FROM k
UNION ALL
SELECT 2 * page_id + 1, state, CASE WHEN state = 'resolved' THEN 2 * src END, CASE WHEN state = 'resolved' THEN old_tag END,
  CASE WHEN state <> 'resolved' THEN NULL WHEN page_id % 5 = 0 THEN 'cache-control=max-age=600;content-type=text/html;etag="' || old_tag || '";last-modified=' || date
    ELSE 'cache-control=max-age=60;content-type=text/html;date=later;etag=W/"' || tag || '";last-modified=' || old_date END
FROM later
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
walk AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT walk.x, links.y FROM walk JOIN links ON walk.y = links.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT x, min(y) AS component_id FROM walk GROUP BY x) c ON c.x = s.doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
link AS (
  SELECT url, replace(CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END, '&amp;', '&') AS goal FROM tags),
full_link AS (
  SELECT url AS src, CASE WHEN position('://' IN goal) > 0 THEN goal WHEN goal LIKE '//%' THEN regexp_extract(url, '^(.*?)://', 1) || ':' || goal
    WHEN goal LIKE '/%' THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || goal END AS dst FROM link WHERE goal <> ''),
address AS (SELECT url FROM pages UNION SELECT dst FROM full_link),
cutoff AS (SELECT url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM address),
parts AS (
  SELECT url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM cutoff),
rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
judged AS (
  SELECT p.url, p.host, p.path, CASE WHEN p.host <> '' THEN p.host || CASE WHEN p.tail = '' THEN '/' ELSE p.tail END END AS key,
    arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path) GROUP BY ALL),
edge AS (SELECT a.key AS x, b.key AS y FROM full_link f JOIN judged a ON a.url = f.src JOIN judged b ON b.url = f.dst WHERE a.key IS NOT NULL AND b.key IS NOT NULL),
both_ways AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
walk AS (SELECT x, y FROM both_ways UNION SELECT w.x, b.y FROM walk w JOIN both_ways b ON w.y = b.x),
passed AS (SELECT w.x AS key, CASE WHEN bool_or(j.verdict = 'allow') THEN 'allow' WHEN bool_or(j.verdict = 'block') THEN 'block' END AS verdict FROM walk w JOIN judged j ON j.key = w.y GROUP BY w.x)
SELECT pages.page_id, j.host, j.path, j.rule, coalesce(j.verdict, passed.verdict, 'allow') AS verdict
FROM pages JOIN judged j ON j.url IS NOT DISTINCT FROM pages.url LEFT JOIN passed ON passed.key = j.key
"""


GOOD_VECTORS = r"""SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"""


def _floors(n: int, by: str) -> str:
    """The list of the floored means of v[1] to v[n] over rows; whole numbers only."""
    return "[" + ", ".join(f"(sum(v[{i}])::BIGINT - (sum(v[{i}])::BIGINT % count(*) + count(*)) % count(*)) // count(*)" for i in range(1, n + 1)) + f"] AS c, {by}"


def op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round as a join of all vectors with all centroids."""
    steps = [f"v AS MATERIALIZED (SELECT vec_id, x AS v, row_number() OVER () AS rn FROM ({GOOD_VECTORS}))", f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v AS c FROM v WHERE vec_id IS NOT NULL QUALIFY k < {k})"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT rn, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(k, (d, k)) AS k FROM (SELECT v.*, k, CAST(list_sum([(v.v[i] - c.c[i]) * (v.v[i] - c.c[i]) FOR i IN range(1, 65)]) AS BIGINT) AS d FROM v, c{i} c) GROUP BY rn)")
        if i < rounds:
            steps.append(f"m{i} AS MATERIALIZED (SELECT {_floors(64, 'k')} FROM a{i} GROUP BY k)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (k))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)"""


def op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Each round as a join of all parts with all entries of their codebook."""
    width = 64 // parts
    steps = [f"v AS MATERIALIZED (SELECT *, row_number() OVER () AS rn FROM ({GOOD_VECTORS}))", f"p AS MATERIALIZED (SELECT rn, p, x[{width} * p + 1:{width} * p + {width}] AS v FROM v, range({parts}) t(p))"]
    steps.append(f"c0 AS MATERIALIZED (SELECT p, e, v AS c FROM p JOIN (SELECT rn, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v WHERE vec_id IS NOT NULL QUALIFY e < {entries}) USING (rn))")
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT rn, p, any_value(v) AS v, min(d) AS d, arg_min(e, (d, e)) AS e FROM (SELECT p.*, e, {' + '.join(f'(v[{j}] - c[{j}]) * (v[{j}] - c[{j}])' for j in range(1, width + 1))} AS d FROM p JOIN c{i} USING (p)) GROUP BY rn, p)")
        if i < rounds:
            steps.append(f"m{i} AS MATERIALIZED (SELECT {_floors(width, 'p, e')} FROM a{i} GROUP BY p, e)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (p, e))")
    return "WITH " + ",\n".join(steps) + f""",
r AS (SELECT rn, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rn),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN r USING (rn), h"""


OP13_SQL = r"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rn, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rn <> c.rn)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_sort_means": op11_sql(), "op12_va_codes": op12_sql(), "op13_block_top_k": OP13_SQL, "op5_revisit_resolution": OP5_SQL, "op6_minhash_dedup": OP6_SQL, "op8_url_filters": OP8_SQL}

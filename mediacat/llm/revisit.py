"""Not-modified revisits: an as-of join by canonical address to the latest earlier full response.

A capture with status 304 has no body; it stands for the latest strictly earlier full response (status 200) of the
same canonical address, if its validators agree. Time is dealt into blocks by quantiles: within a block a window finds
the latest full response, across blocks a window over one row a block carries it on, so an address that holds a third
of all captures is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.llm.common import Scratch
from mediacat.llm.urls import UPPER, LOWER, after_scheme, host_of, path_of

#: Blocks of time for a whole table; the driver holds so many bounds.
BLOCKS = 256
#: Headers of a not-modified response that must not replace stored ones: they describe a body that it does not have.
KEPT_HEADERS = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "transfer-encoding", "trailer", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "upgrade")
TRACKING = r"(?i)\A(utm_\w+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|\z)"


def canonical(url: Column) -> Column:
    """Host in lower case without 'www.' and default port, path without trailing slash, sorted query without tracking
    parameters; no scheme, no fragment. Null if there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"\Awww\.", ""), r":(80|443)?\z", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(after_scheme(url), r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def header(headers: Column, name: str) -> Column:
    """First value of a header whose name is compared without case."""
    return F.get(F.filter(F.map_values(F.map_filter(headers, lambda k, v: F.translate(k, UPPER, LOWER) == name)), lambda v: v.isNotNull()), 0)


def weak(tag: Column) -> Column:
    """Entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), r"\A[Ww]/", "")


def validated(revisit: Column, stored: Column) -> Column:
    """How a revisit's validators agree with the stored headers: the entity tag decides, else the date, else nothing does."""
    tag, old_tag = header(revisit, "etag"), header(stored, "etag")
    date, old_date = header(revisit, "last-modified"), header(stored, "last-modified")
    return (
        F.when(tag.isNotNull() & old_tag.isNotNull(), F.when(weak(tag) == weak(old_tag), "etag").otherwise("mismatch"))
        .when(date.isNotNull() & old_date.isNotNull(), F.when(F.trim(date) == F.trim(old_date), "last-modified").otherwise("mismatch")).otherwise("unvalidated")
    )


def lowered(headers: Column) -> Column:
    """Headers with lower-case names; of names that clash the first stays."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.translate(e["key"], UPPER, LOWER).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.get(F.filter(pairs, lambda e: e["key"] == n), 0)))


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers, replaced and extended by those that a not-modified response may set."""
    allowed = F.map_filter(lowered(fresh), lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(lowered(stored), lambda k, v: ~F.array_contains(F.coalesce(F.map_keys(allowed), F.array().cast("array<string>")), k)), F.coalesce(allowed, F.create_map().cast("map<string,string>")))


def latest_earlier(full: DataFrame, asked: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """For each distinct (key, ts) in asked, `full` of the latest row of (key, ts, full) with an earlier ts; null if none.

    full has one row a (key, ts). Of rows of one key at one time none is earlier than another.
    """
    both = Scratch(full.sparkSession).keep(asked.distinct().join(full, ["key", "ts"], "full"), "asof")
    shares = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(both.approxQuantile("ts", shares, 0.5 / blocks))) if shares and not both.isEmpty() else []
    block = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]).cast("array<double>"), lambda b: F.col("ts") > b)) if bounds else F.lit(0)
    rows = both.withColumn("block", block)
    inside = Window.partitionBy("key", "block").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("here", F.last("full", ignorenulls=True).over(inside))
    each = rows.groupBy("key", "block").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.col("ts"))).alias("latest"))
    carry = each.withColumn("before", F.last("latest", ignorenulls=True).over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(carry.select("key", "block", "before"), ["key", "block"], "left")
    return rows.select("key", "ts", F.coalesce("here", "before").alias("full"))


def resolve_revisits(captures: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """captures (record_id, url, ts long, status int, headers map, digest) -> record_id, state, source_id, digest, headers.

    state: full (status 200; source is the row itself), resolved (304 whose validators agree), unvalidated (304 with an
    earlier full response but no validator on both sides; resolved all the same), mismatch, orphan (304 without an
    earlier full response, without address or without time) or other (any other status). source_id, digest and merged
    headers are set for full, resolved and unvalidated. Of full responses at the same time the largest record_id is
    the source. Repeated rows give a row each; null record ids are kept; an empty table gives an empty result.
    """
    names = ["record_id", "ts", "status", "headers", "digest"]
    rows = captures.select(*names, canonical(F.col("url")).alias("key"))
    usable = rows.filter(F.col("key").isNotNull() & F.col("ts").isNotNull())
    full = usable.filter("status = 200").groupBy("key", "ts").agg(F.max_by(F.struct("record_id", "digest", "headers"), F.coalesce("record_id", F.lit(-(2**63)))).alias("full"))
    asked = usable.filter("status = 304").select("key", "ts")
    found = latest_earlier(full, asked, blocks)
    own = rows.filter(~F.col("status").eqNullSafe(F.lit(304))).withColumn("full", F.lit(None).cast(full.schema["full"].dataType))
    back = rows.filter("status = 304").join(found, ["key", "ts"], "left").select(*own.columns)
    agree = F.when(F.col("full").isNull(), "orphan").otherwise(validated(F.col("headers"), F.col("full.headers")))
    state = F.when(F.col("status") == 200, "full").when(F.col("status") == 304, F.when(agree.isin("etag", "last-modified"), "resolved").otherwise(agree)).otherwise("other")
    out = own.unionByName(back).withColumn("state", state)
    good = F.col("state").isin("resolved", "unvalidated")
    return out.select(
        "record_id", "state", F.when(good, F.col("full.record_id")).when(F.col("state") == "full", F.col("record_id")).alias("source_id"),
        F.when(good, F.col("full.digest")).when(F.col("state") == "full", F.col("digest")).alias("digest"),
        F.when(good, merged(F.col("full.headers"), F.col("headers"))).when(F.col("state") == "full", lowered(F.col("headers"))).alias("headers"),
    )

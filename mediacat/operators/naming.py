"""Output plan: target folders, names without collisions, copy and tag manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions import names as N
from mediacat.functions import tags as T
from mediacat.operators.joins import spread_join
from mediacat.sources.scratch import Scratch


class CollisionError(RuntimeError):
    pass


MOST_SUFFIXES = 9_999


def place_group(part: pd.DataFrame) -> pd.DataFrame:
    """Greedy in walk order: the name, then name-hash8, then name-1 and so on, the first that nothing occupies.

    Rows without a source are names that the target folder already holds.
    """
    part = part.sort_values("walk", kind="stable")
    taken = set(part.loc[part["src_path"].isna(), "name"])
    names = []
    next_free: dict[str, int] = {}
    for src, name, key in zip(part["src_path"], part["name"], part["hash"], strict=True):
        if pd.isna(src):
            names.append(None)
            continue
        dot = name.rfind(".")
        head, ext = (name[:dot], name[dot:]) if dot >= 0 else (name, "")
        pick = name
        if pick in taken and isinstance(key, str) and key:
            pick = f"{head}-{key[:8]}{ext}"
        n = next_free.get(name, 1)
        while pick in taken:
            if n > MOST_SUFFIXES:
                raise CollisionError(f"too many name collisions for {name}")
            pick = f"{head}-{n}{ext}"
            n += 1
            next_free[name] = n
        taken.add(pick)
        names.append(pick)
    return part.assign(final_name=names)[["src_path", "dst_dir", "final_name"]].dropna(subset=["src_path"])


def candidate_names(members: DataFrame) -> DataFrame:
    """(dst_dir, name, other): every name that rows (dst_dir, name, hash, n_taken) of a name may be moved to: its hash form, and
    as many numbers as rows may need plus those that are known to be taken."""
    head, ext = N.stem(F.col("name")), N.extension(F.col("name"))
    tag = F.when(F.coalesce("hash", F.lit("")) != "", F.substr("hash", F.lit(1), F.lit(8)))
    tagged = members.groupBy("dst_dir", "name", tag.alias("tag")).agg(F.count("*").alias("n"), F.max("n_taken").alias("n_taken"))
    by_hash = tagged.filter("tag is not null").select("dst_dir", "name", F.concat(head, F.lit("-"), F.col("tag"), ext).alias("other"))
    numbers = tagged.groupBy("dst_dir", "name").agg(F.sum(F.when(F.col("tag").isNull(), F.col("n")).otherwise(F.col("n") - 1)).alias("n"), F.max("n_taken").alias("n_taken"))
    most = F.least(F.col("n") + F.col("n_taken"), F.lit(MOST_SUFFIXES)).cast("int")
    numbers = numbers.withColumn("most", most).filter("most > 0").withColumn("k", F.explode(F.sequence(F.lit(1), "most"))).select("dst_dir", "name", F.concat(head, F.lit("-"), F.col("k").cast("string"), ext).alias("other"))
    return by_hash.unionByName(numbers).distinct()


def rivals(rows: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Names (dst_dir, name) whose rows may have to move, and the links (dst_dir, name, other), if any, from such a name to
    another that exists and that its rows may be moved to.

    A name can only be met from the name without its last suffix, so where no two such names exist nothing is looked up. It
    starts with names that stand twice. A name that rows of another may take joins it, and with it the names that its own
    rows may be moved to, until nothing joins; numbers that are taken let the next ones come into question. Hashes are hex.
    """
    names = rows.select("dst_dir", "name").groupBy("dst_dir", "name").agg(F.count("*").alias("n"))
    known, links, n_links = s.cut(names.filter("n > 1").select("dst_dir", "name"), "rivals"), None, 0
    bare = F.regexp_replace(N.stem(F.col("name")), r"-[^-]{1,8}\z", "")
    pairs = names.select("dst_dir", F.col("name").alias("other"), F.concat(bare, N.extension(F.col("name"))).alias("name")).filter("name <> other")
    pairs = s.cut(pairs.join(names.select("dst_dir", "name"), ["dst_dir", "name"]), "pairs")
    if pairs.isEmpty():
        return known, None
    above = pairs.select("dst_dir", "name").distinct()
    while True:
        members = rows.filter("src_path is not null").select("dst_dir", "name", "hash", "src_path")
        members = spread_join(members, known.join(above, ["dst_dir", "name"]), ["dst_dir", "name"], ["src_path"])
        if links is None:
            members = members.withColumn("n_taken", F.lit(0))
        else:
            taken = links.groupBy("dst_dir", "name").agg(F.count("*").alias("n_taken"))
            members = members.join(taken, ["dst_dir", "name"], "left").withColumn("n_taken", F.coalesce("n_taken", F.lit(0)))
        found = s.cut(candidate_names(members).join(pairs, ["dst_dir", "name", "other"]), "links")
        n = found.count()
        if n == n_links:  # links only grow, and names join by links alone
            return known, links
        links, n_links = found, n
        known = s.cut(known.unionByName(links.select("dst_dir", F.col("other").alias("name"))).distinct(), "rivals")


def with_tops(links: DataFrame, s: Scratch) -> DataFrame:
    """(dst_dir, name, top) of every linked name: the name at the top of its chain of links. A name is linked from one other
    at most, that without its last suffix."""
    up = links.select("dst_dir", F.col("other").alias("name"), F.col("name").alias("top"))
    ends = links.select("dst_dir", "name", F.col("name").alias("top")).distinct()
    up = s.cut(up.unionByName(ends.join(up.select("dst_dir", "name"), ["dst_dir", "name"], "left_anti")), "tops")
    while True:  # each round doubles the length of chain that is followed
        above = up.select("dst_dir", F.col("name").alias("top"), F.col("top").alias("above"))
        up = s.cut(up.join(above, ["dst_dir", "top"], "left").select("dst_dir", "name", F.coalesce("above", "top").alias("above"), "top"), "tops")
        if up.filter("above <> top").isEmpty():
            return up.select("dst_dir", "name", "top")
        up = up.select("dst_dir", "name", F.col("above").alias("top"))


def ranked_names(rows: DataFrame) -> DataFrame:
    """Final names of rows (src_path, hash, dst_dir, name, walk_path, old) whose name no other name's rows can meet: in walk
    order the first keeps it, unless the folder holds it already (old), then the first of each hash gets its hash form,
    the others the numbers from 1 on. The same names as `place_group` gives, by windows that may spill."""
    walk = N.walk_order(F.col("walk_path"))
    over = lambda *keys: F.row_number().over(Window.partitionBy("dst_dir", "name", *keys).orderBy(walk))
    rows = rows.withColumn("stays", ~F.col("old") & (over() == 1)).withColumn("tag", F.when(F.coalesce("hash", F.lit("")) != "", F.substr("hash", F.lit(1), F.lit(8))))
    rows = rows.withColumn("by_hash", ~F.col("stays") & F.col("tag").isNotNull() & (over("stays", "tag") == 1))
    rows = rows.withColumn("number", over("stays", "by_hash"))
    number = F.when(F.col("number") <= MOST_SUFFIXES, F.col("number").cast("string")).otherwise(F.raise_error(F.concat(F.lit("too many name collisions for "), F.col("name"))).cast("string"))
    suffix = F.when(F.col("by_hash"), F.col("tag")).otherwise(number)
    final = F.when(F.col("stays"), F.col("name")).otherwise(F.concat(N.stem(F.col("name")), F.lit("-"), suffix, N.extension(F.col("name"))))
    return rows.select("src_path", "dst_dir", final.alias("final_name"))


def output_manifest(photos: DataFrame, existing: DataFrame | None = None, root: str = "") -> DataFrame:
    """photos (src_path, hash, final_album, kind) -> src_path, dst_dir, final_name, dst_path.

    Names that stand once in their folder and that no other name's rows may be moved to are kept. Those that stand twice
    but meet no other name get suffixes by rank. What is left are chains of names that can take each other's place (x.jpg,
    x-1.jpg): they are placed in walk order, a chain at a time. existing: (dst_dir, name) that are occupied already.
    """
    prefix = root.rstrip("/") + "/" if root else ""
    album = F.when(N.trimmed(F.coalesce("final_album", F.lit(""))) != "", F.concat(F.lit(prefix + "Albums/"), N.folder_name(F.col("final_album")))).otherwise(prefix + "Library")
    base = N.base_name(F.col("src_path"))
    rows = photos.select("src_path", "hash", album.alias("dst_dir"), N.corrected_name(base, F.col("kind")).alias("name"), F.col("src_path").alias("walk_path"))
    if existing is not None:
        rows = rows.unionByName(existing.select(F.lit(None).cast("string").alias("src_path"), F.lit(None).cast("string").alias("hash"), "dst_dir", "name", F.lit("").alias("walk_path")))
    with Scratch(photos.sparkSession) as s:
        rows = s.keep(rows, "names")
        known, links = rivals(rows, s)
        tops = with_tops(links, s) if links is not None else known.sparkSession.createDataFrame([], "dst_dir string, name string, top string")
        short = spread_join(rows.filter(F.length("hash").between(1, 7)).select("dst_dir", "name", "src_path"), known, ["dst_dir", "name"], ["src_path"]).select("dst_dir", "name").distinct()
        tops = tops.unionByName(short.join(tops, ["dst_dir", "name"], "left_anti").withColumn("top", F.col("name")))  # a short hash may look like a number
        held = rows.filter("src_path is null").select("dst_dir", "name").distinct().withColumn("old", F.lit(True))
        judged = known.join(tops, ["dst_dir", "name"], "left").join(held, ["dst_dir", "name"], "left")
        judged = s.keep(judged.select("dst_dir", "name", "top", F.coalesce("old", F.lit(False)).alias("old"), F.lit(True).alias("rival")), "rivals")
    found = spread_join(rows, judged, ["dst_dir", "name"], ["walk_path"], "left")
    lone = found.filter("rival is null and src_path is not null").select("src_path", "dst_dir", F.col("name").alias("final_name"))
    ranked = ranked_names(found.filter("rival and top is null and src_path is not null"))
    chains = found.filter("top is not null").select("src_path", "hash", "dst_dir", "name", "top", F.array_join(N.walk_order(F.col("walk_path")), "\u0000").alias("walk"))
    placed = chains.groupBy("dst_dir", "top").applyInPandas(place_group, "src_path string, dst_dir string, final_name string")
    return lone.unionByName(ranked).unionByName(placed).withColumn("dst_path", F.concat("dst_dir", F.lit("/"), "final_name"))


def tag_manifest(entries: DataFrame, label_prefix: str = T.ORIGIN) -> DataFrame:
    """entries (dst_path, kind, meta) -> dst_path, ord, tag, op, value: a row for each tag to write."""
    ext = F.lower(N.extension(N.base_name(F.col("dst_path"))))
    rows = entries.select("dst_path", F.posexplode(T.tag_list(F.col("meta"), ext, F.col("kind"), label_prefix)).alias("ord", "t"))
    return rows.select("dst_path", "ord", "t.tag", "t.op", "t.value")


def tag_batches(entries: DataFrame, size: int = 25, buckets: int = 64) -> DataFrame:
    """entries (dst_path, meta) that have something to write, with `bucket` and `batch` numbers of at most `size` rows.

    Batches are numbered within hash buckets, so that no window holds the whole table.
    """
    size = max(1, size)
    good = entries.filter(T.has_writable_meta(F.col("meta"))).withColumn("bucket", F.pmod(F.xxhash64("dst_path"), F.lit(buckets)))
    row = F.row_number().over(Window.partitionBy("bucket").orderBy("dst_path"))
    return good.withColumn("batch", F.floor((row - 1) / size))

"""Which sidecar belongs to which media file: seven ranked rules as equi-joins.

Every media file asks for keys, every sidecar offers keys of three kinds (title, filename key, normalized title), which
hold over all folders. The best offer by rule, then by the position of the asked key, then by whether the sidecar's
name fits, then by walk order, wins. The prefix rule holds within a folder, for files that no stronger rule settles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions import names as N
from mediacat.sources.scratch import Scratch


def sidecar_index(sidecars: DataFrame) -> DataFrame:
    """(kind, key, fit, json_path): of sidecars (json_path, title) that offer a key the first by walk order, and the first of
    those whose file name fits a base name `fit`; fit is empty for the former. A null title is only in the key index."""
    rows = sidecars.filter(N.is_sidecar(F.col("json_path"))).select("json_path", N.base_name(F.col("json_path")).alias("json_base"), "title")
    title = F.lower("title")
    entry = lambda kind, key: F.when(key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    normal = N.normal_base(N.stem(F.col("title")))
    offers = F.array(entry("title", title), entry("name", N.sidecar_key(F.col("json_base"))), entry("normal", F.when(normal != "", normal)))
    fits = F.array_union(F.array(F.lit("")), N.bases_of_sidecar(F.col("json_base")))
    rows = rows.select(F.explode(F.array_compact(offers)).alias("o"), "json_path", fits.alias("fits")).select("o.*", "json_path", F.explode("fits").alias("fit"))
    return rows.groupBy("kind", "key", "fit").agg(F.min_by("json_path", N.walk_order(F.col("json_path"))).alias("json_path"))


def probes(path: Column) -> Column:
    """Array of (kind, key, rule, ord, base) that a media file asks for; base is what the sidecar's name should start with."""
    base = N.base_name(path)
    low, low_stem, ext = F.lower(base), F.lower(N.stem(base)), F.lower(N.extension(base))

    def ask(kind: str, key: Column, rule: int, ord: int, own: Column, when: Column | None = None) -> Column:
        row = F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(rule).alias("rule"), F.lit(ord).alias("ord"), own.alias("base"))
        return row if when is None else F.when(when, row)

    motion, live = ext == ".mp", ext.isin(".mp4", ".mov")
    fixed = [ask("title", low, 1, 0, base), ask("title", low_stem, 2, 0, N.stem(base), low_stem != "")]
    fixed += [ask("title", F.concat(low, F.lit(e)), 3, i, F.concat(base, F.lit(e)), motion) for i, e in enumerate((".jpg", ".jpeg"))]
    fixed += [ask("title", F.concat(low_stem, F.lit(e)), 4, i, F.concat(low_stem, F.lit(e)), live) for i, e in enumerate((".heic", ".jpg", ".jpeg", ".png"))]
    normal = N.normal_base(N.stem(base))
    fixed += [ask("normal", normal, 7, 0, base, normal != "")]
    keys = F.transform(N.media_keys(base), lambda k, i: F.struct(F.lit("name").alias("kind"), k.alias("key"), F.lit(5).alias("rule"), i.alias("ord"), base.alias("base")))
    return F.concat(F.array_compact(F.array(*fixed)), keys)


def match_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """media (rel_path) with sidecar_path and rule added; null where no rule finds one.

    A file asks for each key twice, for the first offer and for the first whose name fits, and each has one answer at
    most. So the join is no larger than twice the asked keys. Its sides are shuffled as they are, so that Spark can split a
    key that many files ask for; the offers are written before, what each file found after it, so each part of the
    plan runs once.
    """
    with Scratch(media.sparkSession) as s:
        index = s.cut(sidecar_index(sidecars), "index")
        asked = media.select("rel_path", F.explode(probes(F.col("rel_path"))).alias("p")).select("rel_path", "p.*")
        asked = asked.withColumn("fit", F.explode(F.array_distinct(F.array(F.lit(""), "base")))).drop("base")
        rank = F.struct("rule", "ord", (F.col("fit") == "").alias("misfit"), N.walk_order(F.col("json_path")).alias("walk"))
        best = asked.join(index, ["kind", "key", "fit"]).groupBy("rel_path").agg(F.min_by(F.struct("json_path", "rule"), rank).alias("_best"))
        found = s.keep(media.join(best, "rel_path", "left").select(*[media[c] for c in media.columns], "_best"), "found")
    open_ones = found.filter("_best is null or _best.rule > 6")
    short = prefix_matches(open_ones.select("rel_path").distinct(), sidecars)
    closed = found.filter("_best.rule <= 6").select(*media.columns, F.col("_best.json_path").alias("sidecar_path"), F.col("_best.rule").alias("rule"))
    rest = open_ones.join(short, "rel_path", "left")
    path = F.coalesce("short_path", "_best.json_path")
    return closed.unionByName(rest.select(*media.columns, path.alias("sidecar_path"), F.when(F.col("short_path").isNotNull(), 6).otherwise(F.col("_best.rule")).alias("rule")))


def prefix_matches(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(rel_path, short_path): the sidecar of the same folder whose title ends with the file's extension and begins with its
    stem; the shortest title wins, then walk order.

    Titles are cut to the lengths that stems of the same folder and extension have, and joined with the stems by value.
    """
    base = N.base_name(F.col("rel_path"))
    stems = media.select("rel_path", N.folder(F.col("rel_path")).alias("folder"), F.lower(N.extension(base)).alias("ext"), F.lower(N.stem(base)).alias("part")).filter("ext <> ''")
    with Scratch(media.sparkSession) as s:
        lengths = s.keep(stems.groupBy("folder", "ext").agg(F.collect_set(F.length("part")).alias("lengths")), "lengths")  # file names are short
    title = F.lower("title")
    offers = sidecars.filter(N.is_sidecar(F.col("json_path")) & F.col("title").isNotNull()).select("json_path", N.folder(F.col("json_path")).alias("folder"), F.lower(N.extension(title)).alias("ext"), title.alias("title"))
    offers = offers.join(lengths, ["folder", "ext"]).withColumn("stem", F.substr("title", F.lit(1), F.length("title") - F.length("ext")))
    cut = offers.select("folder", "ext", "json_path", "stem", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("stem"))
    rank = F.struct(F.octet_length("stem"), N.walk_order(F.col("json_path")))
    best = cut.groupBy("folder", "ext", F.substr("stem", F.lit(1), F.col("n")).alias("part")).agg(F.min_by("json_path", rank).alias("short_path"))
    return stems.join(best, ["folder", "ext", "part"]).select("rel_path", "short_path")

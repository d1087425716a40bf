"""URL filter rules, and block decisions that redirects and canonical links pass on to aliases.

DataFrame functions only. Pages whose addresses are joined by redirects or canonical links form components; an address
without a rule of its own is allowed if its component holds an explicitly allowed address, else blocked if it holds a
blocked one, else allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import Scratch
from mediacat.llm.components import connected_components
from mediacat.operators.joins import spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first '://'; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """Address without scheme and fragment, host in lower case; null where there is no host."""
    rest = F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Number of the longest rule that fits host and path; null if none does. Of equally long rules an allowing one comes
    first. The columns are repeated for each rule, so they should be plain ones."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), rules[i].verdict != "allow", rules[i].name))
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
    return F.coalesce(*[F.when(fits(rules[i]), F.lit(i)) for i in order], F.lit(None).cast("int"))


def of_rule(number: Column, values: list[str]) -> Column:
    """The value of a rule by its number; null for none."""
    return F.get(F.array(*[F.lit(v) for v in values]).cast("array<string>"), number)


def html_edges(pages: DataFrame, s: Scratch) -> DataFrame:
    """(src, dst) addresses: from each page to its canonical link and to where a refresh sends the reader. Each step is
    written, so that none of its long expressions is repeated inside the next one."""
    tag = F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1)))
    tags = pages.filter(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", tag.alias("tag"))
    canonical = F.col("tag").rlike(r"(?is)\A<link\b.*\brel\s*=\s*[\"']?canonical\b")
    refresh = F.col("tag").rlike(r"(?is)\A<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b")
    to = F.when(canonical, F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)).when(refresh, F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    links = s.cut(tags.select("url", to.alias("to")), "targets").filter("to != ''")
    links = s.cut(links.select("url", F.regexp_replace("to", "&amp;", "&").alias("to"), path_of(F.col("url")).alias("path")), "links")
    scheme, site = F.regexp_extract("url", r"\A(.*?)://", 1), F.regexp_extract("url", r"\A(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("path", r"\A(.*/)", 1)
    full = (
        F.when(F.col("to").contains("://"), F.col("to")).when(F.startswith("to", F.lit("//")), F.concat(scheme, F.lit(":"), F.col("to"))).when(F.startswith("to", F.lit("/")), F.concat(site, F.col("to")))
        .when(F.col("to").rlike(r"\A[?#]"), F.concat(F.regexp_extract("url", r"\A([^?#]*)", 1), F.col("to"))).otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), F.col("to")))
    )
    return s.cut(links.select(F.col("url").alias("src"), full.alias("dst")), "addresses")


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url, html).

    redirects: further (src, dst) addresses. A null url or one without '://' has an empty host and path and no alias,
    and is allowed unless a rule fits. Repeated rows get equal values; an empty table gives an empty result; other
    columns are ignored. Rules are compiled into one expression, so they should be hundreds at most.
    """
    verdicts = [r.verdict for r in rules]
    with Scratch(pages.sparkSession) as s:
        edges = html_edges(pages, s)
        if redirects is not None:
            edges = edges.unionByName(redirects.select("src", "dst"))
        edges = s.cut(edges.select(key_of(F.col("src")).alias("src"), key_of(F.col("dst")).alias("dst")), "keys")
        known = connected_components(edges, s)
        own = F.concat(F.lit("x://"), F.col("id"))
        known = s.cut(known.select("id", "component", host_of(own).alias("host"), path_of(own).alias("path")), "known")
        known = known.select("id", "component", of_rule(rule_of(F.col("host"), F.col("path"), rules), verdicts).alias("own"))
        decided = known.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allow"), F.max(F.col("own") == "block").alias("block"))
        decided = decided.select("component", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("passed")).filter(F.col("passed").isNotNull())
        alias = s.keep(spread_join(known, decided, ["component"], ["id"]).select(F.col("id").alias("key"), "passed"), "alias")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    rows = spread_join(rows, alias, ["key"], ["page_id"], "left")
    return rows.select("page_id", "host", "path", of_rule(F.col("fit"), [r.name for r in rules]).alias("rule"), F.coalesce(of_rule(F.col("fit"), verdicts), "passed", F.lit("allow")).alias("verdict"))

"""Capture dates from file names, sidecars and tags.

The session time zone plays the local zone. Everything here is built of SQL expressions; user patterns are compiled to
expressions as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.layouts import layout_timestamp
from mediacat.functions.names import bound, trimmed
from mediacat.functions.patterns import PatternError, compiles, to_java

# Accuracy ranks, lower is better.
FROM_SIDECAR, FROM_NAME, FROM_TAGS, NO_DATE = 1, 2, 3, 99

@dataclass(frozen=True)
class NamePattern:
    """A regular expression, how to parse its match, and a literal that must stand in the match in this very case."""

    regex: str
    layout: str
    literal: str = ""


# The built-in name patterns in order; the first whose leftmost match parses wins.
NAME_PATTERNS = (
    NamePattern("(20|19|18)[0-9]{2}(0[1-9]|1[0-2])[0-3][0-9]-[0-9]{6}", "yyyyMMdd-HHmmss"),
    NamePattern("(20|19|18)[0-9]{2}(0[1-9]|1[0-2])[0-3][0-9]_[0-9]{6}", "yyyyMMdd_HHmmss"),
    NamePattern("(20|19|18)[0-9]{2}-(0[1-9]|1[0-2])-[0-3][0-9]-[0-9]{2}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd-HH-mm-ss"),
    NamePattern("(20|19|18)[0-9]{2}-(0[1-9]|1[0-2])-[0-3][0-9]-[0-9]{6}", "yyyy-MM-dd-HHmmss"),
    NamePattern("(20|19|18)[0-9]{2}(0[1-9]|1[0-2])[0-3][0-9][0-9]{7,}", "first14"),
    NamePattern("(20|19|18)[0-9]{2}_(0[1-9]|1[0-2])_[0-3][0-9]_[0-9]{2}_[0-9]{2}_[0-9]{2}", "yyyy_MM_dd_HH_mm_ss"),
    NamePattern("(IMG|VID)-[0-9]{8}-WA[0-9]+", "whatsapp"),
    NamePattern("Snapchat-([0-9]{10})", "seconds"),
    NamePattern("PXL_[0-9]{8}_[0-9]{6}", "yyyyMMdd_HHmmss", "PXL_"),
    NamePattern("PXL_[0-9]{8}_[0-9]{9}", "pixel"),
    NamePattern("(IMG|VID)_[0-9]{8}_[0-9]{6}", "yyyyMMdd_HHmmss", "IMG_"),
)


def parsed(text: Column, layout: str) -> Column:
    return F.try_to_timestamp(text, F.lit(layout))


def _value(match: Column, p: NamePattern) -> Column:
    if p.layout == "first14":
        return parsed(F.substr(match, F.lit(1), F.lit(14)), "yyyyMMddHHmmss")
    if p.layout == "whatsapp":
        return parsed(F.substr(match, F.lit(5), F.lit(8)), "yyyyMMdd")
    if p.layout == "seconds":
        return F.timestamp_seconds(F.substr(match, F.lit(10), F.lit(10)).try_cast("bigint"))
    if p.layout == "pixel":
        return parsed(F.substr(match, F.lit(5), F.lit(15)), "yyyyMMdd_HHmmss")
    body = F.substr(match, F.lit(len(p.literal) + 1)) if p.literal else match
    value = parsed(body, p.layout)
    return F.when(F.startswith(match, F.lit(p.literal)), value) if p.literal else value


def name_date(name: Column) -> Column:
    """Date that a file name holds, by the built-in patterns; null for none."""
    return F.coalesce(*[_value(F.regexp_substr(name, F.lit("(?i)" + p.regex)), p) for p in NAME_PATTERNS])


def layout_date(text: Column, layout: str) -> Column:
    """A text by a layout given by example, or by UNIX or UNIXMS (any case); null if it does not parse whole."""
    kind = layout.strip().upper()
    if kind in ("UNIX", "UNIXMS"):
        n = F.when(trimmed(text).rlike(r"\A[+-]?[0-9]+\z"), trimmed(text).try_cast("bigint"))
        return F.timestamp_seconds(n) if kind == "UNIX" else F.timestamp_millis(n)
    return layout_timestamp(text, layout)


@dataclass(frozen=True)
class CustomPattern:
    """A user's pattern, in RE2 syntax, and the layout of what it finds."""

    regex: str
    layout: str

    def usable(self) -> bool:
        """Blank entries and those that are not RE2 syntax or that the JVM does not compile are passed over."""
        if not self.regex.strip() or not self.layout.strip():
            return False
        try:
            return compiles(to_java(self.regex)[0])
        except PatternError:
            return False

    def target(self, name: Column) -> Column:
        """The first group if there is one, else the whole match; null without a match."""
        java, groups = to_java(self.regex)
        return F.when(name.rlike(java), F.regexp_extract(name, java, min(groups, 1)))

    def date(self, name: Column) -> Column:
        return layout_date(self.target(name), self.layout)


def custom_date(name: Column, patterns: list[CustomPattern]) -> Column:
    good = [p.date(name) for p in patterns if p.usable()]
    return F.coalesce(*good) if good else F.lit(None).cast("timestamp")


def best_name_date(name: Column, patterns: list[CustomPattern], excluded: Column) -> Column:
    """Custom patterns first, then the built-in ones; none at all for excluded names.

    The name is bound, so that the long expression is not compiled again wherever the date is used.
    """
    found = bound(name, lambda n: F.coalesce(custom_date(n, patterns), name_date(n)))
    return F.when(~F.coalesce(excluded, F.lit(False)), found)


def epoch_of(value: Column) -> Column:
    """Seconds of a JSON timestamp (variant): text of a whole number, or a number, cut off; null for anything else."""
    return bound(value, _epoch)


def _epoch(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    text = trimmed(F.try_variant_get(value, "$", "string"))
    whole = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))
    number = F.try_variant_get(value, "$", "double")
    return F.when(kind == "STRING", whole).when(kind.rlike("BIGINT|DOUBLE|DECIMAL|FLOAT"), F.when(F.abs(number) < 9.2e18, number.cast("bigint")))


def tag_date(text: Column) -> Column:
    """Date of a tag in one of three shapes: with its own offset, else in UTC; null for blanks and zero dates.
    A fraction of a second may follow the seconds and is cut off."""
    clean = trimmed(text)
    good = F.when((clean != "") & ~F.contains(clean, F.lit("0000-00-00")), F.regexp_replace(clean, r"(:[0-9]{2})[.,][0-9]+", "$1"))
    dashed = parsed(good, "yyyy-MM-dd'T'HH:mm:ssxx")
    plain = parsed(F.concat(good, F.lit("Z")), "yyyy-MM-dd'T'HH:mm:ssX")
    colons = parsed(F.concat(good, F.lit("Z")), "yyyy:MM:dd HH:mm:ssX")
    return F.coalesce(dashed, plain, colons)


def first_tag_date(*tags: Column) -> Column:
    return F.coalesce(*[tag_date(t) for t in tags])


def reasonable(when: Column, as_of_year: int) -> Column:
    return F.coalesce(F.year(when).between(1990, as_of_year + 1), F.lit(False))


def overrides(name_time: Column, sidecar_time: Column, as_of_year: int) -> Column:
    """Whether a name's date replaces the sidecar's: it is earlier and of a reasonable year."""
    return F.coalesce(name_time < sidecar_time, F.lit(False)) & reasonable(name_time, as_of_year)


def best_date(sidecar: Column, name: Column, tags: Column, as_of_year: int) -> Column:
    """Struct (ts, accuracy) of the date to use."""

    def pick(ts: Column, accuracy: int) -> Column:
        return F.struct(ts.alias("ts"), F.lit(accuracy).alias("accuracy"))

    return (
        F.when(sidecar.isNotNull() & name.isNotNull() & overrides(name, sidecar, as_of_year), pick(name, FROM_NAME)).when(sidecar.isNotNull(), pick(sidecar, FROM_SIDECAR))
        .when(name.isNotNull(), pick(name, FROM_NAME)).when(tags.isNotNull(), pick(tags, FROM_TAGS)).otherwise(pick(F.lit(None).cast("timestamp"), NO_DATE))
    )


def review_class(sidecar: Column, name: Column, tags: Column, as_of_year: int) -> Column:
    """override, name_only, tags_only, unknown, or null for a row that its sidecar dates."""
    return (
        F.when(sidecar.isNotNull() & name.isNotNull() & overrides(name, sidecar, as_of_year), "override").when(sidecar.isNull() & name.isNotNull(), "name_only")
        .when(sidecar.isNull() & tags.isNotNull(), "tags_only").when(sidecar.isNull(), "unknown")
    )


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def tag_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy:MM:dd HH:mm:ssxxx")

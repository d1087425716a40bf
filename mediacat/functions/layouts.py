"""Dates by layouts that show how one moment would be written: 2006-01-02 15:04:05.

A layout becomes one regular expression; its groups are turned into numbers, checked and put together.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
TWO, ONE_OR_TWO = "([0-9]{2})", "([0-9]{1,2}+)"
ZONE_NAME = "(ChST|MeST|WITA|GMT[+-][0-9]{1,2}+|[+-][0-9]{2}|[A-Z]{3}(?![A-Z])|[A-Z]{3}T(?![A-Z])|[A-Z]{4}T(?![A-Z]))"


def any_of(names: tuple[str, ...], size: int | None = None) -> str:
    return "(?i:(" + "|".join(n[:size] for n in names) + "))"


# Elements of layouts, what they match, and what the match means.
ELEMENTS: dict[str, tuple[str, str]] = {
    "January": (any_of(MONTHS), "month name"), "Jan": (any_of(MONTHS, 3), "month name"), "Monday": (any_of(DAYS), "day name"), "Mon": (any_of(DAYS, 3), "day name"),
    "2006": ("([0-9]{4})", "year"), "06": (TWO, "short year"), "01": (TWO, "month"), "1": (ONE_OR_TWO, "month"), "02": (TWO, "day"), "_2": (" ?" + ONE_OR_TWO, "day"), "2": (ONE_OR_TWO, "day"),
    "002": ("([0-9]{3})", "day of year"), "__2": (" {0,2}([0-9]{1,3}+)", "day of year"), "15": (ONE_OR_TWO, "hour"), "03": (TWO, "hour of 12"), "3": (ONE_OR_TWO, "hour of 12"),
    "04": (TWO, "minute"), "4": (ONE_OR_TWO, "minute"), "05": (TWO, "second"), "5": (ONE_OR_TWO, "second"), "PM": ("(AM|PM)", "half"), "pm": ("(am|pm)", "half"), "MST": (ZONE_NAME, "zone name"),
    "Z070000": ("(Z|[+-][0-9]{6})", "offset"), "Z07:00:00": ("(Z|[+-][0-9]{2}:[0-9]{2}:[0-9]{2})", "offset"), "Z0700": ("(Z|[+-][0-9]{4})", "offset"), "Z07:00": ("(Z|[+-][0-9]{2}:[0-9]{2})", "offset"), "Z07": ("(Z|[+-][0-9]{2})", "offset"),
    "-070000": ("([+-][0-9]{6})", "offset"), "-07:00:00": ("([+-][0-9]{2}:[0-9]{2}:[0-9]{2})", "offset"), "-0700": ("([+-][0-9]{4})", "offset"), "-07:00": ("([+-][0-9]{2}:[0-9]{2})", "offset"), "-07": ("([+-][0-9]{2})", "offset"),
}
ELEMENT = re.compile("|".join(
    re.escape(e) + {"Jan": "(?![a-z])", "Mon": "(?![a-z])", "_2": "(?!006)"}.get(e, "") for e in sorted(ELEMENTS, key=len, reverse=True)
) + r"|[.,](?:0+|9+)(?![0-9])")


@dataclass(frozen=True)
class Layout:
    regex: str
    parts: tuple[str, ...]  # what each group means


@functools.lru_cache(maxsize=1024)
def compiled(layout: str) -> Layout:
    """Regular expression and meaning of the groups of a layout."""
    out, parts, at = [], [], 0
    found = list(ELEMENT.finditer(layout))
    for i, m in enumerate(found):
        out.append(plain(layout[at : m.start()]))
        at = m.end()
        if m[0][0] in ".,":
            out.append(f"[.,]([0-9]{{{len(m[0]) - 1}}})" if m[0][1] == "0" else "(?:[.,]([0-9]++))?")
            parts.append("fraction")
            continue
        regex, meaning = ELEMENTS[m[0]]
        out.append(regex)
        parts.append(meaning)
        if meaning == "second" and not (i + 1 < len(found) and found[i + 1][0][0] in ".,"):
            out.append("(?:[.,]([0-9]++))?")  # a fraction may follow seconds where the layout shows none
            parts.append("fraction")
    out.append(plain(layout[at:]))
    return Layout(r"\A" + "".join(out) + r"\z", tuple(parts))


def plain(text: str) -> str:
    """Text of a layout that stands for itself; a run of spaces stands for any run of them, or for none at the end."""
    return "".join(r"(?: +|\z)" if run.isspace() and run[0] == " " else re.escape(run) for run in re.findall(r" +|[^ ]+", text))


def layout_timestamp(text: Column, layout: str) -> Column:
    """The moment that a text gives by a layout, in the session's time zone unless the text names an offset or zone; null if
    it does not match whole or is no date. What the layout does not show is taken from the start of the year 0."""
    c = compiled(layout)
    group: Callable[[int], Column] = lambda i: F.regexp_extract(text, c.regex, i + 1)
    last = {meaning: group(i) for i, meaning in enumerate(c.parts)}  # of an element that stands twice the last one counts
    number = lambda meaning: last[meaning].try_cast("int") if meaning in last else None
    or_lit = lambda value, default: F.lit(default) if value is None else value
    checks: list[Column] = [text.rlike(c.regex)]

    order = [p for p in c.parts if p in ("year", "short year")]
    year = number(order[-1]) if order else None
    if order and order[-1] == "short year":
        year = F.when(year >= 69, year + 1900).otherwise(year + 2000)
    order = [p for p in c.parts if p in ("month", "month name")]
    month = number(order[-1]) if order else None
    if order and order[-1] == "month name":
        short = F.lower(F.substr(last["month name"], F.lit(1), F.lit(3)))
        month = F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), short).cast("int")
    day = number("day")
    if (of_year := number("day of year")) is not None:
        date = F.date_add(F.make_date(or_lit(year, 0), F.lit(1), F.lit(1)), of_year - 1)
        checks += [of_year >= 1, F.year(date) == or_lit(year, 0), *([] if month is None else [F.month(date) == month]), *([] if day is None else [F.day(date) == day])]
        month, day = F.month(date), F.day(date)
    order = [p for p in c.parts if p in ("hour", "hour of 12")]
    hour = number(order[-1]) if order else None
    if hour is not None:
        checks.append(hour <= (12 if order[-1] == "hour of 12" else 23))
    if "half" in last:
        hour = or_lit(hour, 0)
        after = F.lower(last["half"]) == "pm"
        hour = F.when(after & (hour < 12), hour + 12).when(~after & (hour == 12), 0).otherwise(hour)
    minute, second = number("minute"), number("second")
    checks += [x <= 59 for x in (minute, second) if x is not None]
    seconds = or_lit(second, 0).cast("decimal(16,6)")
    if "fraction" in last:
        seconds = seconds + F.rpad(F.substr(last["fraction"], F.lit(1), F.lit(6)), 6, "0").cast("decimal(16,6)") / F.lit(1_000_000)
    fields = [or_lit(year, 0), or_lit(month, 1), or_lit(day, 1), or_lit(hour, 0), or_lit(minute, 0), seconds.cast("decimal(16,6)")]
    local, utc = F.try_make_timestamp(*fields), F.try_make_timestamp(*fields, F.lit("UTC"))
    moved = lambda offset: F.timestamp_micros(F.unix_micros(utc) - offset.cast("bigint") * 1_000_000)
    value = local
    if "zone name" in last:
        name = last["zone name"]
        hours = F.regexp_extract(name, r"([+-][0-9]+)\z", 1).try_cast("int")
        checks.append(hours.isNull() | hours.between(-23, 23))
        value = F.when(F.date_format(local, "zzz") == name, local).otherwise(moved(F.when(F.startswith(name, F.lit("GMT")), F.coalesce(hours, F.lit(0)) * 3600).otherwise(0)))
    if "offset" in last:
        digits = F.regexp_replace(last["offset"], "[^0-9]", "")
        h, m, s = (F.coalesce(F.substr(digits, F.lit(i), F.lit(2)).try_cast("int"), F.lit(0)) for i in (1, 3, 5))
        checks += [h <= 24, m <= 60, s <= 60]
        value = moved((h * 3600 + m * 60 + s) * F.when(F.startswith(last["offset"], F.lit("-")), -1).otherwise(1))
    good = checks[0]
    for check in checks[1:]:
        good = good & check
    return F.when(good, value)

"""Albums: listing, selection by priority, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.names import trimmed

LIBRARY = "(library)"


class SelectionError(ValueError):
    pass


def distinct_albums(photos: DataFrame) -> DataFrame:
    """(album) of all photos (albums), sorted by bytes."""
    return photos.select(F.explode("albums").alias("album")).filter("album != ''").distinct().orderBy("album")


def select_albums(albums: list[str], spec: str | None) -> list[str]:
    """Albums in order of priority: blank selects none, 'all' all, else a comma list of positions from 1 or names in any
    case. A number is always a position; repeats count once; of names alike without case the last one is meant."""
    text = (spec or "").strip()
    if not text:
        return []
    if text.lower() == "all":
        return list(albums)
    by_name = {name.lower(): name for name in albums}
    picked: dict[str, None] = {}
    for item in filter(None, (part.strip() for part in text.split(","))):
        try:
            place = int(item) if item.lstrip("+-").isdecimal() and item.isascii() else None
        except ValueError:
            place = None
        if place is not None:
            if not 1 <= place <= len(albums):
                raise SelectionError(f"album index out of range: {place}")
            picked[albums[place - 1]] = None
        elif item.lower() in by_name:
            picked[by_name[item.lower()]] = None
        else:
            raise SelectionError(f"unknown album name: {item}")
    return list(picked)


def selected_albums(albums: DataFrame, spec: str | None) -> DataFrame:
    """(ord, album): `select_albums` over a table (album) of distinct names. The user's items are joined with the albums that
    they name, so the driver sees no album; an item that names none fails the query."""
    text, ddl = (spec or "").strip(), "ord int, place int, key string"
    if text.lower() == "all":
        return albums.select(F.row_number().over(Window.orderBy("album")).alias("ord"), "album")
    items = [p.strip() for p in text.split(",") if p.strip()]
    places = [int(p) if p.lstrip("+-").isdecimal() and p.isascii() else None for p in items]
    asked = albums.sparkSession.createDataFrame([(i, n, None if n is not None else p.lower()) for i, (n, p) in enumerate(zip(places, items, strict=True))], ddl)
    first = albums.orderBy("album").limit(max([0, *(n for n in places if n is not None)]))  # no further than the user's largest number
    first = first.select(F.row_number().over(Window.orderBy("album")).alias("place"), F.col("album").alias("by_place"))
    named = albums.groupBy(F.lower("album").alias("key")).agg(F.max("album").alias("by_name"))
    found = asked.join(first, "place", "left").join(named, "key", "left")
    missing = F.raise_error(F.concat(F.lit("no such album: "), F.coalesce("key", F.col("place").cast("string")))).cast("string")
    picked = found.select("ord", F.coalesce("by_place", "by_name", missing).alias("album")).groupBy("album").agg(F.min("ord").alias("at"))
    return picked.select(F.row_number().over(Window.orderBy("at")).alias("ord"), "album")


def final_album(albums: Column, priority: list[str]) -> Column:
    """The first selected album that a photo has; null for none."""
    if not priority:
        return F.lit(None).cast("string")
    return F.get(F.filter(F.array(*[F.lit(p) for p in priority]), lambda p: F.array_contains(albums, p)), F.lit(0))


def assign_albums(photos: DataFrame, priority: list[str]) -> DataFrame:
    return photos.withColumn("final_album", final_album(F.col("albums"), priority))


def album_summary(photos: DataFrame) -> DataFrame:
    """(album, n) by trimmed final album; blank ones are the library."""
    name = F.coalesce(F.nullif(trimmed(F.col("final_album")), F.lit("")), F.lit(LIBRARY))
    return photos.groupBy(name.alias("album")).agg(F.count("*").alias("n"))

"""File names, paths and file kinds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Media suffixes, edit suffixes, video and writable extensions.
MEDIA_SUFFIXES = ("jpg", "jpeg", "png", "heic", "mp4", "mov", "m4v", "gif", "webp", "dng", "nef", "mp", "mv", "mp~2", "mp~3")
EDIT_SUFFIXES = ("-edited", "-collage", "-color_pop", "-photo_frame", "-overlayed")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".m4v", ".mp", ".mv", ".mp~2", ".mp~3")
WRITABLE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".gif", ".webp", ".dng", ".nef", *VIDEO_EXTENSIONS)
HEIC_BRANDS = ("heic", "heix", "heif", "hevc", "heim", "heis")


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once a row however often `use` names it.

    A column that is used twice is else written twice into the plan, and where that grows too long to be compiled, every
    copy is run: nested ones many times over.
    """
    return F.get(F.transform(F.array(x), lambda v: use(v)), 0)


def trimmed(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def folder(path: Column) -> Column:
    """Everything before the last slash; '.' where there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def extension(name: Column) -> Column:
    """From the last dot of the name on, dot included; empty without one."""
    return F.regexp_extract(name, r"(\.[^./]*)\z", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*\z", "")


def without_index(name: Column) -> Column:
    """Without a trailing (digits)."""
    return F.regexp_replace(name, r"\([0-9]+\)\z", "")


def walk_order(path: Column) -> Column:
    """Sorts as a directory walk visits: by name on each level."""
    return F.split(path, "/")


def is_media(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(MEDIA_SUFFIXES) + r")\z")


def is_sidecar(path: Column) -> Column:
    return F.lower(path).rlike(r"\.json\z") & (base_name(path) != "metadata.json")


def in_extensions(path: Column, only: list[str]) -> Column:
    """Extension in a list given with or without dots, in any case; blank entries count for nothing, and an empty list
    filters nothing."""
    wanted = {x if x.startswith(".") else f".{x}" for x in (y.strip().lower() for y in only) if x}
    return F.lower(extension(base_name(path))).isin(*sorted(wanted)) if wanted else F.lit(True)


def album_of(path: Column, marker: str = "google photos") -> Column:
    """Album that a path implies; null for none.

    After the first segment equal to the marker (without case): the next segment, or the one after it if the next is
    'Albums' and one follows. Without a marker: the first segment of a path with folders. Names that start with
    'Photos from' are none.
    """
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, F.lower), marker).cast("int")  # 1-based: the 0-based next segment
    after, second = F.get(parts, at), F.get(parts, at + 1)
    picked = F.when((F.lower(after) == "albums") & second.isNotNull(), second).otherwise(after)
    name = F.when(at > 0, picked).when(F.size(parts) > 1, F.get(parts, F.lit(0)))
    return F.when(~F.startswith(name, F.lit("Photos from")) & (name != ""), name)


def sidecar_key(name: Column) -> Column:
    """Key of a sidecar's file name; null unless it ends with '.json' in lower case. The index goes before the cut."""
    key = without_index(F.regexp_replace(F.regexp_replace(name, r"\.json\z", ""), r"\.+\z", ""))
    cut = F.when(F.lower(key).contains(".supp"), F.regexp_replace(key, r"(?is)\.supp.*\z", "")).otherwise(F.regexp_replace(key, r"(?is)\.meta.*\z", ""))
    return F.when(F.endswith(name, F.lit(".json")), cut)


def media_keys(name: Column) -> Column:
    """Keys of a media name in order: name and stem, then both without index; trimmed, not empty, first ones only."""
    bare = F.regexp_replace(name, r"\.+\z", "")
    keys = F.array(bare, stem(bare), without_index(bare), without_index(stem(bare)))
    return F.array_distinct(F.filter(F.transform(keys, trimmed), lambda k: k != ""))


def normal_base(name: Column) -> Column:
    """Lower case, without index and one edit suffix."""
    plain = without_index(F.lower(trimmed(name)))
    return trimmed(F.regexp_replace(plain, "(" + "|".join(EDIT_SUFFIXES) + r")\z", ""))


def names_sidecar_of(json_name: Column, base: Column) -> Column:
    """Whether a sidecar's name is the base, an optional (n), an optional metadata suffix and '.json'."""
    rest = F.substr(json_name, F.length(base) + 1)
    return (base != "") & F.startswith(json_name, base) & rest.rlike(r"\A(\([0-9]+\))?(\.supplemental-metadata|\.metadata)?\.json\z")


def bases_of_sidecar(json_name: Column) -> Column:
    """All bases that `names_sidecar_of` accepts for a sidecar's name."""
    bare = F.when(F.endswith(json_name, F.lit(".json")), F.regexp_replace(json_name, r"\.json\z", ""))
    plain = F.regexp_replace(bare, r"(\.supplemental-metadata|\.metadata)\z", "")
    return F.array_distinct(F.filter(F.array(bare, plain, without_index(bare), without_index(plain)), lambda b: b != ""))


def name_shape(name: Column) -> Column:
    """Digit runs as #, separators as _, ASCII letters in lower case."""
    return F.translate(F.regexp_replace(name, "[0-9]+", "#"), " -." + UPPER, "___" + LOWER)


def folder_name(name: Column) -> Column:
    """Fit for a folder: separators replaced, 'Untitled' if blank."""
    safe = F.translate(trimmed(name), "/", "_")
    return F.when(F.coalesce(safe, F.lit("")) == "", "Untitled").otherwise(safe)


def file_kind(head: Column) -> Column:
    """Kind by the first 12 bytes: jpeg, png, heic, webp or unknown (also if there are fewer)."""
    h = F.hex(F.substr(head, F.lit(1), F.lit(12)))
    brand = F.substr(h, F.lit(17), F.lit(8)).isin(*[b.encode().hex().upper() for b in HEIC_BRANDS])
    ftyp, riff, webp = (x.encode().hex().upper() for x in ("ftyp", "RIFF", "WEBP"))
    kind = (
        F.when(F.startswith(h, F.lit("FFD8FF")), "jpeg").when(F.startswith(h, F.lit("89504E470D0A1A0A")), "png")
        .when((F.substr(h, F.lit(9), F.lit(8)) == ftyp) & brand, "heic").when(F.startswith(h, F.lit(riff)) & (F.substr(h, F.lit(17), F.lit(8)) == webp), "webp")
    )
    return F.when(F.length(head) >= 12, F.coalesce(kind, F.lit("unknown"))).otherwise("unknown")


def kind_extension(kind: Column) -> Column:
    """Usual extension of a kind; null for unknown ones."""
    return F.when(kind == "jpeg", ".jpg").when(kind == "png", ".png").when(kind == "heic", ".heic").when(kind == "webp", ".webp")


def extension_fits(ext: Column, kind: Column) -> Column:
    """Whether a lower-case extension agrees with a sniffed kind; only jpeg, png and heic extensions are checked."""
    wanted = F.when(ext.isin(".jpg", ".jpeg"), "jpeg").when(ext == ".png", "png").when(ext.isin(".heic", ".heif"), "heic")
    return wanted.isNull() | (kind == "unknown") | (kind == wanted)


def is_video(ext: Column) -> Column:
    return ext.isin(*VIDEO_EXTENSIONS)


def is_writable(ext: Column) -> Column:
    return ext.isin(*WRITABLE_EXTENSIONS)


def corrected_name(name: Column, kind: Column) -> Column:
    """Name with the usual extension of its sniffed kind. Only an extension in lower case is taken off first."""
    ext, wanted = F.lower(extension(name)), kind_extension(kind)
    bare = F.when((ext != "") & F.endswith(name, ext), F.substr(name, F.lit(1), F.length(name) - F.length(ext))).otherwise(name)
    return F.when(wanted.isNull() | (wanted == ext), name).otherwise(F.concat(bare, wanted))

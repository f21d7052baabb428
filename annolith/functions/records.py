"""Which feature of a record holds its picture: by name, else by what its bytes begin with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which records hold pictures, in order of preference, and names of files.
PICTURE_KEYS = ("image/encoded", "image", "image_raw", "jpeg", "png", "encoded")
FILE_KEYS = ("image/filename", "filename", "file_name", "image/name")
# What files of pictures begin with: JPEG, PNG, GIF, BMP, TIFF of both byte orders.
HEADS = ("FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961", "424D", "49492A00", "4D4D002A")


def is_picture(data: Column) -> Column:
    """Whether bytes begin as a JPEG, PNG, GIF, BMP, TIFF or WebP file does."""
    head = F.hex(F.substring(data, 1, 12))
    webp = head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe(F.lit("57454250"))
    found = webp
    for h in HEADS:
        found = found | head.startswith(h)
    return F.coalesce(found, F.lit(False))


def picture(features: Column, wanted: str | None = None, keys: Sequence[str] = PICTURE_KEYS) -> Column:
    """struct<key, data> of a map of byte features; null without one.

    With ``wanted`` only that name counts. Else the first of ``keys`` that is there, whatever its bytes; else the first other feature, in
    the map's order, whose bytes begin as a picture's; names of files never count.
    """
    entry = lambda k: F.when(F.try_element_at(features, F.lit(k)).isNotNull(), F.struct(F.lit(k).alias("key"), F.try_element_at(features, F.lit(k)).alias("data")))
    if wanted:
        return entry(wanted)
    other = F.filter(F.map_entries(features), lambda e: ~e["key"].isin(*FILE_KEYS) & is_picture(e["value"]))
    first = F.get(other, F.lit(0))
    return F.coalesce(*[entry(k) for k in keys], F.when(first.isNotNull(), F.struct(first["key"].alias("key"), first["value"].alias("data"))))


def file_name(features: Column) -> Column:
    """The text of the first of the names of files that is there; bytes that aren't text are left out."""
    found = F.coalesce(*[F.try_element_at(features, F.lit(k)) for k in FILE_KEYS])
    return F.replace(F.make_valid_utf8(found.cast("string")), F.lit("�"), F.lit(""))


def stem_of(features: Column, number: Column) -> Column:
    """What the record's picture is called: its file name without folder and ending, else a name from its number."""
    base = F.regexp_extract(file_name(features), r"([^/]*?)(?:\.[^./]*)?/*$", 1)
    return F.when(F.coalesce(base, F.lit("")) != "", base).otherwise(F.concat(F.lit("image_"), F.lpad(number.cast("string"), F.greatest(F.lit(6), F.length(number.cast("string"))), "0")))

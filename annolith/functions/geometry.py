"""Geometry of boxes and points as Spark columns (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micro(c: Column) -> Column:
    """Millionths, halves up, as a long: comparable across engines."""
    return F.floor(c * 1000000 + 0.5).cast("long")


def clamp(v: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo) if not isinstance(lo, Column) else lo, F.least(F.lit(hi) if not isinstance(hi, Column) else hi, v))


def clamp01(v: Column) -> Column:
    return clamp(v, 0.0, 1.0)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two corner boxes share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def area(a: tuple[Column, ...]) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of corner boxes; 0 if the union is empty."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def turn_point(angle: int, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """A pixel point of a w x h image after a clockwise right-angle turn."""
    return {0: (x, y), 90: (h - y, x), 180: (w - x, h - y), 270: (y, w - x)}[angle]


def turn_size(angle: int, w: Column, h: Column) -> tuple[Column, Column]:
    return (h, w) if angle in (90, 270) else (w, h)


def ratio_near(ratio: Column, target: float, tolerance: float = 0.01) -> Column:
    return F.abs(ratio - target) / target <= tolerance


def align_up(n: Column, stride: int) -> Column:
    return (F.ceil(n / stride) * stride).cast("int")


def fit_inside(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Size with the longer side at most ``most``, halves to even, at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    side = lambda v: F.greatest(F.lit(1), F.rint(v * scale).cast("int"))
    return side(w), side(h)


def readable_bytes(n: Column) -> Column:
    """1536 -> 1.5 KB, tenths with halves up."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        tenths = F.floor(n * 10 / F.lit(float(1024**k)) + 0.5)
        out = F.when(n >= 1024**k, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def resize_plan(width: Column, height: Column, ending: Column, most: int, as_jpeg: bool = False) -> Column:
    """struct<resize, width, height, ending, unchanged>: a picture's size with its longer side at most ``most`` (halves to even, at least 1), the ending it gets, and whether nothing is to do.

    HEIC and HEIF become jpg, with ``as_jpeg`` all do. Null sizes give null.
    """
    longer = F.greatest(width, height)
    needs = longer > most
    scale = F.when(needs, longer / F.lit(float(most))).otherwise(1.0)
    side = lambda v: F.greatest(F.lit(1), F.rint(v / scale).cast("int"))
    old = F.lower(ending)
    new = F.when(old.isin("heic", "heif") | F.lit(as_jpeg), "jpg").otherwise(old)
    got = F.struct(needs.alias("resize"), side(width).alias("width"), side(height).alias("height"), new.alias("ending"), (~needs & (new == old)).alias("unchanged"))
    return F.when(width.isNotNull() & height.isNotNull(), got)


def cut_height(height: Column, cut: int) -> Column:
    """What is left of a frame's height without ``cut`` rows above and below; null if that is nothing."""
    return F.when(height > 2 * cut, height - 2 * cut)

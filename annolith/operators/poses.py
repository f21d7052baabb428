"""Poses of images: what boxes' operators do to a box, done to its keypoints, too.

A pose row is a box row (see :mod:`.boxes`) with ``kpts``, an array of struct<x, y, v> in shares of
the image. A point counts if it is seen and not at the origin; other points become zeros. All
operators are projections, joins on image_id and one grouping by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import keypoints as kp
from .boxes import BOX, corners

KEYS = ("image_id", "obj_idx", "class_id")
Move = Callable[[Column, Column], tuple[Column, Column]]


def _sized(poses: DataFrame, images: DataFrame) -> DataFrame:
    return poses.join(images.select("image_id", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")), "image_id")


def moved(kpts: Column, to: Move, keep: Callable[[Column, Column], Column] | None = None, otherwise: Callable[[Column], Column] | None = None) -> Column:
    """Valid points at their new places, as shares held to 0..1. Invalid points, and those that ``keep`` (of the new place) refuses, are zeros."""
    lost = otherwise or (lambda p: kp.ZERO())

    def one(p: Column) -> Column:
        x, y = to(p["x"], p["y"])
        there = kp.point(g.clamp01(x), g.clamp01(y), p["v"])
        return F.when(~kp.valid(p), lost(p)).when(keep(x, y), there).otherwise(kp.ZERO()) if keep else F.when(kp.valid(p), there).otherwise(lost(p))

    return F.transform(kpts, one)


def _inside(x: Column, y: Column) -> Column:
    return (x >= 0) & (x <= 1) & (y >= 0) & (y <= 1)


def _box_of(left: Column, top: Column, right: Column, bottom: Column, w: Column, h: Column) -> list[Column]:
    """Shares of a corner box in pixels on a canvas."""
    new = [(left + right) / 2 / w, (top + bottom) / 2 / h, (right - left) / w, (bottom - top) / h]
    return [g.clamp01(v).alias(c) for v, c in zip(new, BOX, strict=True)]


def envelope(poses: DataFrame, images: DataFrame, least_side: float = 0.0) -> DataFrame:
    """Per image the pixel box around boxes and valid points, within the image. A box with a side under
    ``least_side`` pixels doesn't count, nor do its points; negative sides are turned round."""
    j = _sized(poses, images)
    W, H = F.col("width"), F.col("height")
    if least_side:
        j = j.where(F.least(F.col("w") * W, F.col("h") * H) >= least_side)
    x1, y1, x2, y2 = corners()
    at = [g.clamp(v, 0.0, m) for v, m in zip((F.least(x1, x2) * W, F.least(y1, y2) * H, F.greatest(x1, x2) * W, F.greatest(y1, y2) * H), (W, H, W, H), strict=True)]
    j = j.withColumns(dict(zip(("_x1", "_y1", "_x2", "_y2"), at, strict=True)))
    whole = (F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1"))
    seen = F.filter("kpts", kp.valid)

    def values(name: str, size: Column, lo: str, hi: str) -> Column:
        box = F.when(whole, F.array(F.col(lo), F.col(hi))).otherwise(F.array().cast("array<double>"))
        return F.concat(box, F.transform(seen, lambda p: g.clamp(p[name] * size, 0.0, size)))

    j = j.withColumns({"_xs": values("x", W, "_x1", "_x2"), "_ys": values("y", H, "_y1", "_y2")})
    out = j.groupBy("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).agg(
        F.min(F.array_min("_xs")).alias("min_x"), F.min(F.array_min("_ys")).alias("min_y"), F.max(F.array_max("_xs")).alias("max_x"), F.max(F.array_max("_ys")).alias("max_y")
    )
    return out.where("min_x is not null")


def rewrite_for_crop(poses: DataFrame, crops: DataFrame) -> DataFrame:
    """Poses in their image's crop: the box is cut to it and dropped if nothing is left; an invalid point keeps its visibility at the origin."""
    j = poses.join(crops, "image_id")
    cw, ch = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    side = lambda v, size, start, length: g.clamp(g.clamp(v * F.col(size), 0.0, F.col(size).cast("double")) - F.col(start), 0.0, length.cast("double"))
    x1, y1, x2, y2 = corners()
    j = j.withColumns({"_x1": side(x1, "width", "left", cw), "_y1": side(y1, "height", "top", ch), "_x2": side(x2, "width", "left", cw), "_y2": side(y2, "height", "top", ch)})
    j = j.where((F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1")))
    to = lambda x, y: ((x * F.col("width") - F.col("left")) / cw, (y * F.col("height") - F.col("top")) / ch)
    points = moved(F.col("kpts"), to, otherwise=lambda p: kp.point(0, 0, p["v"]))
    return j.select(*KEYS, *_box_of(*[F.col(c) for c in ("_x1", "_y1", "_x2", "_y2")], cw, ch), points.alias("kpts"))


def recentre_for_crop(poses: DataFrame, crops: DataFrame, least_side: float = 24.0) -> DataFrame:
    """Poses in their image's crop by centre and size, each share held to 0..1. A box with a side under
    ``least_side`` pixels stays only if all of it is in the crop."""
    j = poses.join(crops, "image_id")
    cw, ch = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    w, h, eps = F.col("w") * F.col("width"), F.col("h") * F.col("height"), 1e-6
    x1, y1, x2, y2 = corners()
    px = [F.least(x1, x2) * F.col("width"), F.least(y1, y2) * F.col("height"), F.greatest(x1, x2) * F.col("width"), F.greatest(y1, y2) * F.col("height")]
    within = (px[0] >= F.col("left") - eps) & (px[1] >= F.col("top") - eps) & (px[2] <= F.col("right") + eps) & (px[3] <= F.col("bottom") + eps)
    j = j.where((F.least(w, h) >= least_side) | within)
    to = lambda x, y: ((x * F.col("width") - F.col("left")) / cw, (y * F.col("height") - F.col("top")) / ch)
    cx, cy = to(F.col("cx"), F.col("cy"))
    new = [g.clamp01(v).alias(c) for v, c in zip((cx, cy, w / cw, h / ch), BOX, strict=True)]
    return j.select(*KEYS, *new, moved(F.col("kpts"), to).alias("kpts"))


def large_enough(crops: DataFrame, least: int = 160) -> DataFrame:
    """Crops whose longer side has at least ``least`` pixels."""
    return crops.where(F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")) >= least)


def _cut_to_canvas(j: DataFrame, xs: list[Column], ys: list[Column], w: Column, h: Column) -> DataFrame:
    """Add the box around points, cut to the canvas; rows without one go."""
    j = j.withColumns({"_l": F.greatest(F.lit(0.0), F.least(*xs)), "_t": F.greatest(F.lit(0.0), F.least(*ys)), "_r": F.least(w, F.greatest(*xs)), "_b": F.least(h, F.greatest(*ys))})
    return j.where((F.col("_r") > F.col("_l")) & (F.col("_b") > F.col("_t")))


def _turned_copy(angle: int) -> Column:
    """struct<cx, cy, w, h, kpts, angle> of a sized pose after a clockwise right-angle turn, cut to the new canvas; null if no box is left."""
    W, H = F.col("width"), F.col("height")
    x1, y1, x2, y2 = corners()
    (ax, ay), (bx, by), (nw, nh) = g.turn_point(angle, x1 * W, y1 * H, W, H), g.turn_point(angle, x2 * W, y2 * H, W, H), g.turn_size(angle, W, H)
    left, top, right, bottom = F.greatest(F.lit(0.0), F.least(ax, bx)), F.greatest(F.lit(0.0), F.least(ay, by)), F.least(nw, F.greatest(ax, bx)), F.least(nh, F.greatest(ay, by))

    def to(x: Column, y: Column) -> tuple[Column, Column]:
        px, py = g.turn_point(angle, x * W, y * H, W, H)
        return px / nw, py / nh

    copy = F.struct(*_box_of(left, top, right, bottom, nw, nh), moved(F.col("kpts"), to, _inside).alias("kpts"), F.lit(angle).alias("angle"))
    return F.when((right > left) & (bottom > top), copy)


def turn(poses: DataFrame, images: DataFrame, angle: int) -> DataFrame:
    """Poses after a clockwise right-angle turn, cut to the new canvas; points off the canvas are zeros."""
    return turns(poses, images, [angle]).drop("angle")


def turns(poses: DataFrame, images: DataFrame, angles: list[int]) -> DataFrame:
    """One copy per distinct right angle, with ``angle``; others raise ValueError. Poses meet their images once, whatever the number of angles."""
    wanted = list(dict.fromkeys(angles))
    if not wanted or set(wanted) - {90, 180, 270}:
        raise ValueError("angles must be some of 90, 180 and 270")
    return _sized(poses, images).select(*KEYS, F.inline(F.array(*map(_turned_copy, wanted)))).where("angle is not null")


def parse_angles(text: str) -> list[int]:
    """Right angles of a list like ``90, 270``, each once, in order; blanks between commas don't count. Others, and none, raise ValueError."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if not parts or not all(p.isdecimal() and int(p) in (90, 180, 270) for p in parts):
        raise ValueError(f"not right angles: {text!r}")
    return list(dict.fromkeys(int(p) for p in parts))


def extend_with_flip(poses: DataFrame, images: DataFrame) -> DataFrame:
    """Each pose twice on a canvas of double width (portrait) or height: as it is, and mirrored in the other half.
    Only points that are all zeros stay so."""
    j = _sized(poses, images).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    tall, half = F.col("height") > F.col("width"), F.col("copy") * 0.5
    place = lambda x, y: (F.when(tall, x * 0.5 + half).otherwise(x), F.when(tall, y).otherwise(y * 0.5 + half))
    cx, cy = place(F.when(F.col("copy") == 1, 1 - F.col("cx")).otherwise(F.col("cx")), F.col("cy"))
    size = (F.when(tall, F.col("w") * 0.5).otherwise(F.col("w")), F.when(tall, F.col("h")).otherwise(F.col("h") * 0.5))

    def one(p: Column) -> Column:
        x, y = place(p["x"], p["y"])
        return F.when((p["x"] == 0) & (p["y"] == 0) & (p["v"] == 0), kp.ZERO()).otherwise(kp.point(g.clamp01(x), g.clamp01(y), p["v"]))

    points = F.transform(F.when(F.col("copy") == 1, kp.mirrored(F.col("kpts"))).otherwise(F.col("kpts")), one)
    return j.select(*KEYS, "copy", *[g.clamp01(v).alias(c) for v, c in zip((cx, cy, *size), BOX, strict=True)], points.alias("kpts"))


# --- mosaics ---------------------------------------------------------------------------------
def place_on_mosaic(poses: DataFrame, placements: DataFrame, least_side: float = 20.0) -> DataFrame:
    """Poses of images that are tiles of a mosaic: turned, flipped, scaled, moved, then scaled with the mosaic.

    placements: image_id, width, height (of the image), rotation (0; 90 to the left; 270 to the right), flip, scale (of the tile),
    left, top (of the tile), scale_x, scale_y (of the mosaic), mosaic_w, mosaic_h, and any key columns, which are kept.
    Boxes with a side under ``least_side`` pixels are dropped; only points that are all zeros stay so.
    """
    extra = [c for c in placements.columns if c not in ("image_id", "width", "height", "rotation", "flip", "scale", "left", "top", "scale_x", "scale_y", "mosaic_w", "mosaic_h")]
    j = poses.join(placements, "image_id")
    W, H = F.col("width").cast("double"), F.col("height").cast("double")
    left, right = F.col("rotation") == 90, F.col("rotation") == 270
    tw, th = F.when(left | right, H).otherwise(W), F.when(left | right, W).otherwise(H)

    def share(x: Column, y: Column) -> tuple[Column, Column]:
        """Of the turned tile, before the flip."""
        px, py = x * W, y * H
        return F.when(left, py).when(right, H - py).otherwise(px) / tw, F.when(left, W - px).when(right, px).otherwise(py) / th

    def place(x: Column, y: Column) -> tuple[Column, Column]:
        x = F.when(F.col("flip"), 1 - x).otherwise(x)
        return (x * tw * F.col("scale") + F.col("left")) * F.col("scale_x") / F.col("mosaic_w"), (y * th * F.col("scale") + F.col("top")) * F.col("scale_y") / F.col("mosaic_h")

    w, h = F.col("w") * W, F.col("h") * H
    pw, ph = F.when(left | right, h).otherwise(w) * F.col("scale") * F.col("scale_x"), F.when(left | right, w).otherwise(h) * F.col("scale") * F.col("scale_y")
    j = j.withColumns({"_pw": pw, "_ph": ph}).where((F.col("_pw") >= least_side) & (F.col("_ph") >= least_side))
    cx, cy = place(*share(F.col("cx"), F.col("cy")))
    nothing = lambda p: (p["x"] == 0) & (p["y"] == 0) & (p["v"] == 0)

    def one(p: Column) -> Column:
        x, y = place(*share(p["x"], p["y"]))
        return F.when(nothing(p), kp.ZERO()).otherwise(kp.point(g.clamp01(x), g.clamp01(y), p["v"]))

    partner = F.array(*[F.lit(k) for k in kp.MIRROR])
    swapped = F.when(F.col("flip") & (F.size("kpts") == 17), F.transform("kpts", lambda p, i: F.get("kpts", F.get(partner, i)))).otherwise(F.col("kpts"))
    box = [g.clamp01(v).alias(c) for v, c in zip((cx, cy, F.col("_pw") / F.col("mosaic_w"), F.col("_ph") / F.col("mosaic_h")), BOX, strict=True)]
    return j.select(*KEYS, *extra, *box, F.transform(swapped, one).alias("kpts"))


# --- tilted heads ----------------------------------------------------------------------------
def tilt_wanted(poses: DataFrame, images: DataFrame, below: float = 15.0) -> DataFrame:
    """Poses with valid nose and eyes, and ``tilt``: degrees of the line between the eyes, from 0 to 90, under ``below``."""
    j = _sized(poses, images)
    tilt = F.abs(kp.eye_tilt(F.col("kpts"), F.col("width"), F.col("height")))
    ready = kp.valid(F.get("kpts", 0)) & kp.valid(F.get("kpts", 1)) & kp.valid(F.get("kpts", 2))
    return j.withColumn("tilt", F.when(tilt > 90, 180 - tilt).otherwise(tilt)).where(ready & (F.col("tilt") < below)).drop("width", "height")


def tilt_canvas(turned: DataFrame, crop: bool = True) -> DataFrame:
    """turned: image_id, width, height, angle (radians, clockwise), centre_x, centre_y (pixels).

    Adds the cosine and sine, the offset that brings the turned image to whole pixels from 0, the crop
    (a third of the added width on either side, half of the added height) and the size that is left.
    """
    t = turned.withColumns({"cos": F.cos("angle"), "sin": F.sin("angle")})
    at = [_turned(x, y) for x in (F.lit(0.0), F.col("width")) for y in (F.lit(0.0), F.col("height"))]
    xs, ys = [a for a, _ in at], [b for _, b in at]
    low_x, low_y = F.floor(F.least(*xs)), F.floor(F.least(*ys))
    t = t.withColumns({"_x0": low_x, "_y0": low_y, "_w": F.ceil(F.greatest(*xs)) - low_x, "_h": F.ceil(F.greatest(*ys)) - low_y})
    third = lambda size, old, part: g.clamp(F.rint(F.greatest(F.lit(0), F.col(size) - F.col(old)) / part).cast("long"), F.lit(0), F.floor((F.col(size) - 1) / 2)) if crop else F.lit(0)
    t = t.withColumns({"crop_x": third("_w", "width", 3.0), "crop_y": third("_h", "height", 2.0)})
    t = t.withColumns({"offset_x": -F.col("_x0") - F.col("crop_x"), "offset_y": -F.col("_y0") - F.col("crop_y"), "out_w": F.col("_w") - 2 * F.col("crop_x"), "out_h": F.col("_h") - 2 * F.col("crop_y")})
    return t.drop("_x0", "_y0", "_w", "_h")


def _turned(x: Column, y: Column) -> tuple[Column, Column]:
    dx, dy = x - F.col("centre_x"), y - F.col("centre_y")
    return F.col("centre_x") + F.col("cos") * dx - F.col("sin") * dy, F.col("centre_y") + F.col("sin") * dx + F.col("cos") * dy


def tilted(poses: DataFrame, canvas: DataFrame) -> DataFrame:
    """Poses on the canvas of :func:`tilt_canvas`: the box around the turned box, cut to the canvas; points off it are zeros."""
    j = poses.join(canvas, "image_id")
    W, H = F.col("width").cast("double"), F.col("height").cast("double")
    ow, oh = F.col("out_w").cast("double"), F.col("out_h").cast("double")

    def to(x: Column, y: Column) -> tuple[Column, Column]:
        px, py = _turned(x * W, y * H)
        return px + F.col("offset_x"), py + F.col("offset_y")

    x1, y1, x2, y2 = corners()
    at = [to(x, y) for x in (x1, x2) for y in (y1, y2)]
    j = _cut_to_canvas(j, [a for a, _ in at], [b for _, b in at], ow, oh)

    def share(x: Column, y: Column) -> tuple[Column, Column]:
        px, py = to(x, y)
        return px / ow, py / oh

    return j.select(*KEYS, *_box_of(*[F.col(c) for c in ("_l", "_t", "_r", "_b")], ow, oh), moved(F.col("kpts"), share, _inside).alias("kpts"))


# --- portraits -------------------------------------------------------------------------------
def face_sizes(poses: DataFrame, images: DataFrame) -> DataFrame:
    """Per pose the mean of the five face points in pixels (null unless all are seen), and the face's diameter:
    1.32 times the distance of the ears, else 1.44 times the largest among nose and eyes; null without either."""
    j = _sized(poses, images)
    p = lambda k: F.get("kpts", k)
    seen = lambda k: p(k)["v"] > 0
    apart = lambda a, b: g.distance(p(a)["x"] * F.col("width"), p(a)["y"] * F.col("height"), p(b)["x"] * F.col("width"), p(b)["y"] * F.col("height"))
    all_seen = seen(0) & seen(1) & seen(2) & seen(3) & seen(4)
    mean = lambda name, size: F.when(all_seen, (p(0)[name] * F.col(size) + p(1)[name] * F.col(size) + p(2)[name] * F.col(size) + p(3)[name] * F.col(size) + p(4)[name] * F.col(size)) / 5)
    widest = F.greatest(*[F.when(seen(a) & seen(b), apart(a, b)) for a, b in ((0, 1), (0, 2), (1, 2))])
    across = F.when(seen(3) & seen(4), apart(3, 4) * 1.32).otherwise(F.when(widest > 0, widest * 1.44))
    return j.select(*KEYS, "width", "height", mean("x", "width").alias("face_x"), mean("y", "height").alias("face_y"), F.when(F.size("kpts") >= 5, across).alias("diameter"))


def _step(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of a struct of the values. A lambda's variable is worked out once, and its expression stands in the plan once, however often it is used."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), F.lit(0))


def portrait_crop(faces: DataFrame, aspect: float, widths: float | None = None) -> DataFrame:
    """A crop of ``aspect`` (width to height) around each face's middle, moved inside the image; ``widths`` face diameters wide, or as large as fits.

    Rows without a middle, or whose crop would be under a pixel, are left out; a crop that is too large is made smaller. What is
    worked out goes from step to step as a struct: as columns under filters, each step would be written out in the next as often as it is used.
    """
    sizes = ("W", "H")
    given = {"W": F.col("width"), "H": F.col("height"), "x": F.col("face_x"), "y": F.col("face_y"), "diameter": F.col("diameter")}

    def span(centre: Column, half: Column, size: Column) -> Column:
        def inside(r: Column) -> Column:
            lo, hi, size = F.greatest(r["lo"], F.lit(0.0)), F.when(r["lo"] < 0, r["hi"] - r["lo"]).otherwise(r["hi"]), r["size"]
            return F.struct(F.greatest(F.lit(0.0), F.when(hi > size, lo - (hi - size)).otherwise(lo)).alias("lo"), F.least(size, hi).alias("hi"))

        return _step({"lo": centre - half, "hi": centre + half, "size": size}, inside)

    def middle(f: Column) -> Column:
        at = {"cx": g.clamp(f["x"], 0.0, f["W"] - 1), "cy": g.clamp(f["y"], 0.0, f["H"] - 1), "diameter": f["diameter"]}
        return F.when(f["x"].isNotNull() & (f["W"] > 1) & (f["H"] > 1), _step({**{c: f[c] for c in sizes}, **at}, room))

    def room(f: Column) -> Column:
        x, y = F.least(f["cx"], f["W"] - f["cx"]), F.least(f["cy"], f["H"] - f["cy"])
        most = F.least(x, y * aspect)
        half = most if widths is None else F.coalesce(f["diameter"] * widths / 2, most)
        return F.when((x > 0) & (y > 0), _step({**{c: f[c] for c in (*sizes, "cx", "cy", "diameter")}, "half": half}, fitting))

    def fitting(f: Column) -> Column:
        half = f["half"]
        if widths is not None:
            fit = F.least(f["W"] / (half * 2), f["H"] / (half / aspect * 2))
            half = F.when(f["diameter"].isNotNull() & (fit < 1), half * fit).otherwise(half)
        return F.when(f["half"] >= 1, _step({**{c: f[c] for c in (*sizes, "cx", "cy")}, "half": half}, spans))

    def spans(f: Column) -> Column:
        return _step({**{c: f[c] for c in sizes}, "x": span(f["cx"], f["half"], f["W"]), "y": span(f["cy"], f["half"] / aspect, f["H"])}, whole)

    def whole(f: Column) -> Column:
        rounded = lambda c: F.rint(c).cast("int")
        x, y = f["x"], f["y"]
        left, top = rounded(x["lo"]), rounded(y["lo"])
        right, bottom = F.greatest(left + 1, F.least(rounded(x["hi"]), f["W"].cast("int"))), F.greatest(top + 1, F.least(rounded(y["hi"]), f["H"].cast("int")))
        return F.when((x["hi"] - x["lo"] >= 1) & (y["hi"] - y["lo"] >= 1), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))

    return faces.select(*KEYS, _step(given, middle).alias("_crop")).where("_crop is not null").select(*KEYS, "_crop.*")


def pair_costs(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, a_idx, b_idx and cost of each pair of poses of one image: 0.6 of the mean distance of points, weighed by the
    smaller visibility, 0.3 of the centres' distance, both in diagonals, 0.1 of what the IoU lacks; without points that both see 0.75 and 0.25 of the last two."""
    l, r = a.alias("l"), b.alias("r")
    j = l.join(r, F.col("l.image_id") == F.col("r.image_id"))
    centre = g.distance(F.col("l.cx"), F.col("l.cy"), F.col("r.cx"), F.col("r.cy")) / F.sqrt(F.lit(2.0))
    lacks = 1 - g.iou(corners("l."), corners("r."))
    n = F.least(F.size("l.kpts"), F.size("r.kpts"))
    both = F.zip_with(F.slice("l.kpts", F.lit(1), n), F.slice("r.kpts", F.lit(1), n), lambda p, q: F.struct(F.least(p["v"], q["v"]).alias("w"), g.distance(p["x"], p["y"], q["x"], q["y"]).alias("d")))
    used = F.filter(both, lambda s: s["w"] > 0)
    total = lambda f: F.aggregate(used, F.lit(0.0), lambda acc, s: acc + f(s))
    points = F.try_divide(total(lambda s: s["d"] * s["w"]), total(lambda s: s["w"])) / F.sqrt(F.lit(2.0))
    j = j.select(F.col("l.image_id").alias("image_id"), F.col("l.obj_idx").alias("a_idx"), F.col("r.obj_idx").alias("b_idx"), points.alias("_p"), centre.alias("_c"), lacks.alias("_i"))
    cost = F.when(F.col("_p").isNull(), 0.75 * F.col("_c") + 0.25 * F.col("_i")).otherwise(0.6 * F.col("_p") + 0.3 * F.col("_c") + 0.1 * F.col("_i"))
    return j.select("image_id", "a_idx", "b_idx", cost.alias("cost"))

"""Boxes of images: envelopes, crops, turns, flips.

A box row has image_id, obj_idx, class_id, cx, cy, w, h (shares of the image) and score; an
image row has image_id, width, height and source. All operators are projections, joins on
image_id and one grouping by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

BOX = ("cx", "cy", "w", "h")


def corners(prefix: str = "") -> tuple[Column, ...]:
    return g.corners(*[F.col(f"{prefix}{c}") for c in BOX])


def with_corners(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns(dict(zip(("x1", "y1", "x2", "y2"), corners(), strict=True)))


def pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of boxes of one image, in object order, with their IoU."""
    a, b = boxes.alias("a"), boxes.alias("b")
    both = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.obj_idx") < F.col("b.obj_idx")))
    return both.select("a.image_id", F.col("a.obj_idx").alias("a_idx"), F.col("b.obj_idx").alias("b_idx"), g.iou(corners("a."), corners("b.")).alias("iou"))


def envelope(boxes: DataFrame, images: DataFrame, least_side: float = 0.0) -> DataFrame:
    """Per image the pixel box around all its boxes, within the image. Boxes with a side under ``least_side`` pixels don't count."""
    joined = boxes.join(images.select("image_id", "width", "height"), "image_id")
    w, h = F.abs(F.col("w")) * F.col("width"), F.abs(F.col("h")) * F.col("height")
    joined = joined.where(F.least(w, h) >= least_side) if least_side else joined
    px = [c * F.col(s) for c, s in zip(corners(), ("width", "height") * 2, strict=True)]
    lim = [F.col(s) for s in ("width", "height") * 2]
    at = [g.clamp(p, 0.0, m.cast("double")) for p, m in zip(px, lim, strict=True)]
    return joined.groupBy("image_id", "width", "height").agg(F.min(at[0]).alias("min_x"), F.min(at[1]).alias("min_y"), F.max(at[2]).alias("max_x"), F.max(at[3]).alias("max_y"))


def margin_crop(envelopes: DataFrame, margin: int = 20) -> DataFrame:
    """Whole-pixel crop with a margin, inside the image and at least a pixel wide and high."""
    m = max(0, margin)
    left = F.greatest(F.lit(0.0), F.col("min_x") - m).cast("int")
    top = F.greatest(F.lit(0.0), F.col("min_y") - m).cast("int")
    right = F.least(F.col("width").cast("double"), F.col("max_x") + m).cast("int")
    bottom = F.least(F.col("height").cast("double"), F.col("max_y") + m).cast("int")
    out = envelopes.select("image_id", "width", "height", F.least(left, F.col("width") - 1).alias("left"), F.least(top, F.col("height") - 1).alias("top"), right.alias("right"), bottom.alias("bottom"))
    return out.withColumns({"right": F.greatest(F.col("right"), F.col("left") + 1), "bottom": F.greatest(F.col("bottom"), F.col("top") + 1)})


def rewrite_for_crop(boxes: DataFrame, crops: DataFrame) -> DataFrame:
    """Boxes in their image's crop: cut to it, dropped if nothing is left, as shares of the crop."""
    j = boxes.join(crops, "image_id")
    side = lambda v, size, start, end: g.clamp(g.clamp(v * F.col(size), 0.0, F.col(size).cast("double")) - F.col(start), 0.0, (F.col(end) - F.col(start)).cast("double"))
    x1, y1, x2, y2 = corners()
    j = j.withColumns({"_x1": side(x1, "width", "left", "right"), "_x2": side(x2, "width", "left", "right"), "_y1": side(y1, "height", "top", "bottom"), "_y2": side(y2, "height", "top", "bottom")})
    j = j.where((F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1")))
    cw, ch = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    new = [(F.col("_x1") + F.col("_x2")) / 2 / cw, (F.col("_y1") + F.col("_y2")) / 2 / ch, (F.col("_x2") - F.col("_x1")) / cw, (F.col("_y2") - F.col("_y1")) / ch]
    return j.select("image_id", "obj_idx", "class_id", *[g.clamp01(v).alias(c) for v, c in zip(new, BOX, strict=True)])


def recentre_for_crop(boxes: DataFrame, crops: DataFrame) -> DataFrame:
    """Boxes in their image's crop by centre and size; each share is held to 0..1, nothing is dropped."""
    j = boxes.join(crops, "image_id")
    cw, ch = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    new = [(F.col("cx") * F.col("width") - F.col("left")) / cw, (F.col("cy") * F.col("height") - F.col("top")) / ch, F.col("w") * F.col("width") / cw, F.col("h") * F.col("height") / ch]
    return j.select("image_id", "obj_idx", "class_id", *[g.clamp01(v).alias(c) for v, c in zip(new, BOX, strict=True)])


# --- crops of fixed ratios -------------------------------------------------------------------
#: Ratios tried after squares, in pairs; of a pair the smaller crop is taken.
LADDER = [((1, 2), (2, 1)), ((3, 4), (4, 3)), ((2, 3), (3, 2))]


def _candidates() -> list[tuple[int, int, bool, int, int]]:
    """Crops to try: number, place in the ladder, whether around the padded envelope, ratio (0: the largest square)."""
    rows = [(0, True, 1, 1), (1, False, 0, 0)]
    for padded in (True, False):
        rows += [(len(LADDER) * (not padded) + k + 2, padded, a, b) for k, pair in enumerate(LADDER) for a, b in pair]
    return [(i, *r) for i, r in enumerate(rows)]


def _span(df: DataFrame, lo: str, hi: str, size: str, limit: str, out: str) -> DataFrame:
    """Add where a span of a size begins around lo..hi, as central as 0..limit allows; ``out``_ok says whether it fits."""
    df = df.withColumns({"_first": F.greatest(F.lit(0.0), F.col(hi) - F.col(size)), "_last": F.least(F.col(lo), F.col(limit) - F.col(size))})
    near = (F.col("_first") > F.col("_last")) & (F.col("_first") - F.col("_last") <= 1e-6)
    df = df.withColumn("_first", F.when(near, F.col("_last")).otherwise(F.col("_first")))
    middle = (F.col(lo) + F.col(hi)) / 2 - F.col(size) / 2
    return df.withColumns({f"{out}_ok": F.col("_first") <= F.col("_last"), out: F.greatest("_first", F.least(F.col("_last"), middle))}).drop("_first", "_last")


def _with_crop(e: DataFrame, padding: float) -> DataFrame:
    """Add the crop (left, top, right, bottom) of the candidate ``_c`` (step, padded, a, b), and whether it ``fits``."""
    raw = ("min_x", "min_y", "max_x", "max_y")
    square, padded = F.col("_c.a") == 0, F.col("_c.padded")
    bw, bh = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    lim = [F.col("width").cast("double"), F.col("height").cast("double")] * 2
    wide = [g.clamp(F.col(c) + s * d * padding, 0.0, m) for c, s, d, m in zip(raw, (-1, -1, 1, 1), (bw, bh) * 2, lim, strict=True)]
    e = e.withColumns({n: F.when(padded & (bw > 0) & (bh > 0), v).otherwise(F.col(c)) for n, v, c in zip(("_x1", "_y1", "_x2", "_y2"), wide, raw, strict=True)})
    e = e.withColumns({"_rw": F.col("_x2") - F.col("_x1"), "_rh": F.col("_y2") - F.col("_y1"), "_side": F.least("width", "height").cast("double"), "_ratio": F.when(square, 1.0).otherwise(F.col("_c.a") / F.greatest(F.lit(1), F.col("_c.b")))})
    e = e.withColumn("_w0", F.greatest(F.col("_rw"), F.col("_rh") * F.col("_ratio")))
    low = F.col("_w0") / F.col("_ratio") < F.col("_rh")
    e = e.withColumns({
        "_tw": F.when(square, F.col("_side")).when(low, F.col("_rh") * F.col("_ratio")).otherwise(F.col("_w0")),
        "_th": F.when(square, F.col("_side")).when(low, F.col("_rh")).otherwise(F.col("_w0") / F.col("_ratio")),
        "fits": F.when(square, (F.col("_rw") <= F.col("_side")) & (F.col("_rh") <= F.col("_side"))).otherwise((F.col("_rw") > 0) & (F.col("_rh") > 0)),
    })
    e = _span(_span(e, "_x1", "_x2", "_tw", "width", "_fx"), "_y1", "_y2", "_th", "height", "_fy")
    e = e.withColumns({"left": g.clamp(F.floor("_fx").cast("int"), F.lit(0), F.col("width") - 1), "top": g.clamp(F.floor("_fy").cast("int"), F.lit(0), F.col("height") - 1)})
    e = e.withColumns({"right": g.clamp(F.ceil(F.col("_fx") + F.col("_tw")).cast("int"), F.col("left") + 1, F.col("width")), "bottom": g.clamp(F.ceil(F.col("_fy") + F.col("_th")).cast("int"), F.col("top") + 1, F.col("height"))})
    return e.withColumn("fits", F.col("fits") & (F.col("_tw") > 0) & (F.col("_th") > 0) & (F.col("_tw") <= F.col("width")) & (F.col("_th") <= F.col("height")) & F.col("_fx_ok") & F.col("_fy_ok"))


#: A candidate's place in the order is one number: step, then area (44 bits), then its number (4 bits).
_AREA, _NTH = 1 << 44, 1 << 4


def ratio_crop(envelopes: DataFrame, padding: float = 0.2) -> DataFrame:
    """The first crop that fits: a square around the padded envelope, the image's largest square, a
    ratio of the ladder around the padded, then around the bare envelope. ``ratio`` is null if none does.

    An image becomes a row per candidate, of which one number goes into a minimum, so all of it is generated code; the crop of the
    candidate that wins is worked out again. Images have fewer than 2 ** 44 pixels.
    """
    keys = ("image_id", "width", "height", "min_x", "min_y", "max_x", "max_y")
    table = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(s).alias("step"), F.lit(p).alias("padded"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, s, p, a, b in _candidates()])
    tried = _with_crop(envelopes.select(*keys, F.explode(table).alias("_c")), padding)
    area = (F.col("right") - F.col("left")).cast("long") * (F.col("bottom") - F.col("top"))
    place = (F.col("_c.step").cast("long") * _AREA + area) * _NTH + F.col("_c.nth")
    best = tried.groupBy(*keys).agg(F.min(F.when(F.col("fits"), place)).alias("_best"))
    won = _with_crop(best.withColumn("_c", F.get(table, (F.col("_best") % _NTH).cast("int"))), padding)
    a, b = F.greatest(F.lit(1), F.col("_c.a")), F.greatest(F.lit(1), F.col("_c.b"))
    have = F.col("_best").isNotNull()
    ratio = F.when(have, F.concat_ws(":", a.cast("string"), b.cast("string")))
    return won.select("image_id", "width", "height", *[F.when(have, F.col(c)).alias(c) for c in ("left", "top", "right", "bottom")], ratio.alias("ratio"), F.when(have, a).alias("_a"), F.when(have, b).alias("_b"))


def even_ratio_crop(crops: DataFrame) -> DataFrame:
    """Shrink a ratio crop to an even multiple of its ratio, about its centre (halves to even)."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    unit = F.floor(F.least(w / F.col("_a"), h / F.col("_b")))
    unit = unit - unit % 2
    nw, nh = (unit * F.col("_a")).cast("int"), (unit * F.col("_b")).cast("int")
    left = g.clamp(F.rint((F.col("left") + F.col("right")) / 2 - nw / 2).cast("int"), F.lit(0), F.col("width") - nw)
    top = g.clamp(F.rint((F.col("top") + F.col("bottom")) / 2 - nh / 2).cast("int"), F.lit(0), F.col("height") - nh)
    use = F.col("ratio").isNotNull() & (w > 1) & (h > 1) & (unit >= 1)
    out = crops.withColumns({"_l": left, "_t": top, "_nw": nw, "_nh": nh, "_use": F.coalesce(use, F.lit(False))})
    pick = lambda new, old: F.when(F.col("_use"), new).otherwise(F.col(old)).alias(old)
    return out.select("image_id", "width", "height", pick(F.col("_l"), "left"), pick(F.col("_t"), "top"), pick(F.col("_l") + F.col("_nw"), "right"), pick(F.col("_t") + F.col("_nh"), "bottom"), "ratio")


# --- turns, flips, filters -------------------------------------------------------------------
def turn(boxes: DataFrame, images: DataFrame, angle: int) -> DataFrame:
    """Boxes after a clockwise right-angle turn, cut to the new canvas; empty ones are dropped."""
    j = boxes.join(images.select("image_id", "width", "height"), "image_id")
    W, H = F.col("width").cast("double"), F.col("height").cast("double")
    x1, y1, x2, y2 = corners()
    ax, ay = g.turn_point(angle, x1 * W, y1 * H, W, H)
    bx, by = g.turn_point(angle, x2 * W, y2 * H, W, H)
    nw, nh = g.turn_size(angle, W, H)
    j = j.withColumns({"_l": g.clamp(F.least(ax, bx), 0.0, nw), "_t": g.clamp(F.least(ay, by), 0.0, nh), "_r": g.clamp(F.greatest(ax, bx), 0.0, nw), "_b": g.clamp(F.greatest(ay, by), 0.0, nh)})
    j = j.where((F.col("_r") > F.col("_l")) & (F.col("_b") > F.col("_t")))
    new = [(F.col("_l") + F.col("_r")) / 2 / nw, (F.col("_t") + F.col("_b")) / 2 / nh, (F.col("_r") - F.col("_l")) / nw, (F.col("_b") - F.col("_t")) / nh]
    return j.select("image_id", "obj_idx", "class_id", *[g.clamp01(v).alias(c) for v, c in zip(new, BOX, strict=True)])


def extend_with_flip(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Each box twice on a canvas of double width (portrait) or height: as it is, and mirrored in the other half."""
    j = boxes.join(images.select("image_id", "width", "height"), "image_id")
    tall = F.col("height") > F.col("width")
    j = j.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    x = F.when(F.col("copy") == 1, 1 - F.col("cx")).otherwise(F.col("cx"))
    half = F.col("copy") * 0.5
    return j.select(
        "image_id", "obj_idx", "class_id", "copy",
        F.when(tall, x * 0.5 + half).otherwise(x).alias("cx"), F.when(tall, F.col("cy")).otherwise(F.col("cy") * 0.5 + half).alias("cy"),
        F.when(tall, F.col("w") * 0.5).otherwise(F.col("w")).alias("w"), F.when(tall, F.col("h")).otherwise(F.col("h") * 0.5).alias("h"),
    )


def drop_small(boxes: DataFrame, images: DataFrame, least: float = 20.0) -> DataFrame:
    """Boxes with both sides of at least ``least`` pixels; 0 keeps all."""
    j = boxes.join(images.select("image_id", "width", "height"), "image_id")
    return j.where((F.col("w") * F.col("width") >= least) & (F.col("h") * F.col("height") >= least)) if least > 0 else j


def largest(boxes: DataFrame, count: int = 1, class_id: int | None = 0) -> DataFrame:
    """The ``count`` largest boxes of each image by area, first in order among equals, with ``place``."""
    from pyspark.sql import Window

    b = boxes.where(F.col("class_id") == class_id) if class_id is not None else boxes
    w = Window.partitionBy("image_id").orderBy((F.col("w") * F.col("h")).desc(), "obj_idx")
    return b.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)


def exported_box(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Pixel boxes left, top, width, height inside the image, and their area; empty ones are dropped."""
    j = boxes.join(images.select("image_id", "width", "height"), "image_id")
    x1, y1, x2, y2 = corners()
    W, H = F.col("width").cast("double"), F.col("height").cast("double")
    j = j.withColumns({"_x1": g.clamp(x1 * W, 0.0, W), "_y1": g.clamp(y1 * H, 0.0, H), "_x2": g.clamp(x2 * W, 0.0, W), "_y2": g.clamp(y2 * H, 0.0, H)})
    j = j.where((F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1")))
    bw, bh = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    return j.select("image_id", "obj_idx", "class_id", F.col("_x1").alias("left"), F.col("_y1").alias("top"), bw.alias("box_w"), bh.alias("box_h"), (bw * bh).alias("area"))

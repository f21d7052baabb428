"""Labels of mosaics: masks to boxes, tiles of one image beside itself, tiles of several images in a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import keypoints as kp
from ..functions import masks as mk
from . import layout
from .boxes import BOX, corners
from .poses import KEYS


def boxes_of_masks(masks: DataFrame, down: bool = False) -> DataFrame:
    """image_id, obj_idx, class_id, cx, cy, w, h, score of masks (image_id, obj_idx, class_id, score, width, height, runs).

    A mask without a pixel, and one without runs or a size, leaves no row. A null class is 0, a null score 1.
    """
    found = masks.withColumn("_e", mk.extent(F.col("width"), F.col("height"), F.col("runs"), down)).where(F.col("_e").isNotNull())
    return found.select("image_id", "obj_idx", F.coalesce("class_id", F.lit(0)).alias("class_id"), *mk.box(F.col("width"), F.col("height"), F.col("_e")), F.coalesce("score", F.lit(1.0)).alias("score"))


def placements(images: DataFrame, factor: float = 0.7, most: int | None = None) -> DataFrame:
    """The tiles of :func:`layout.self_mosaic`, after the image itself as step 0, with the canvas's size after it is brought to ``most`` (out_w, out_h).

    images: image_id, width, height.
    """
    if factor <= 0 or (most is not None and most <= 0):
        raise ValueError("factor and most must be positive")
    tiles = layout.self_mosaic(images, factor).withColumn("step", (F.col("step") + 1).cast("int"))
    # Each image has a first tile, since what is added has a pixel at least.
    canvas = tiles.where("step = 1").select("image_id", "canvas_w", "canvas_h")
    own = images.select("image_id", F.col("width").alias("tile_w"), F.col("height").alias("tile_h")).join(canvas, "image_id")
    own = own.withColumns({"step": F.lit(0), "x": F.lit(0), "y": F.lit(0), "rotation": F.lit(0), "flip": F.lit(False)})
    out = tiles.unionByName(own.select(*tiles.columns))
    if most is None:
        return out.withColumns({"out_w": F.col("canvas_w"), "out_h": F.col("canvas_h")})
    scale = most / F.greatest("canvas_w", "canvas_h")
    side = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) * scale).cast("int"))
    return out.withColumns({"out_w": side("canvas_w"), "out_h": side("canvas_h")})


def self_mosaic_labels(poses: DataFrame, images: DataFrame, factor: float = 0.7, most: int | None = None, least_side: float = 0.0) -> DataFrame:
    """Poses of each image on its mosaic (step, image_id, obj_idx, class_id, box, kpts): mirrored, turned, scaled, moved.

    A box is cut to the canvas and goes if nothing or less than ``least_side`` pixels of a side are left. From the first tile
    without a label on, the image has no further tiles. Points stay in the canvas and keep their visibility; only those that are all zeros stay
    so; left and right change names with a mirrored body of 17 points. Poses of images without a size have no place.
    """
    sized = images.select("image_id", "width", "height")
    j = poses.join(placements(sized, factor, most).join(sized, "image_id"), "image_id")
    W, H, ow, oh = (F.col(c).cast("double") for c in ("width", "height", "out_w", "out_h"))
    quarter, three = F.col("rotation") == 90, F.col("rotation") == 270
    sx, sy = F.col("tile_w") / F.when(quarter | three, H).otherwise(W), F.col("tile_h") / F.when(quarter | three, W).otherwise(H)

    def to(x: Column, y: Column) -> tuple[Column, Column]:
        """Pixels of the result."""
        x, y = F.when(F.col("flip"), W - x * W).otherwise(x * W), y * H
        px, py = F.when(quarter, y).when(three, H - y).otherwise(x), F.when(quarter, W - x).when(three, x).otherwise(y)
        return (F.col("x") + px * sx) * (ow / F.col("canvas_w")), (F.col("y") + py * sy) * (oh / F.col("canvas_h"))

    x1, y1, x2, y2 = corners()
    (ax, ay), (bx, by) = to(x1, y1), to(x2, y2)
    j = j.withColumns({"_l": F.greatest(F.lit(0.0), F.least(ax, bx)), "_t": F.greatest(F.lit(0.0), F.least(ay, by)), "_r": F.least(ow, F.greatest(ax, bx)), "_b": F.least(oh, F.greatest(ay, by))})
    j = j.where((F.col("_r") > F.col("_l")) & (F.col("_b") > F.col("_t")))
    if least_side > 0:
        j = j.where((F.col("_r") - F.col("_l") >= least_side) & (F.col("_b") - F.col("_t") >= least_side))
    new = [(F.col("_l") + F.col("_r")) / 2 / ow, (F.col("_t") + F.col("_b")) / 2 / oh, (F.col("_r") - F.col("_l")) / ow, (F.col("_b") - F.col("_t")) / oh]

    def one(p: Column) -> Column:
        x, y = to(p["x"], p["y"])
        nothing = (p["x"] == 0) & (p["y"] == 0) & (p["v"] == 0)
        return F.when(nothing, kp.ZERO()).otherwise(kp.point(g.clamp01(x / ow), g.clamp01(y / oh), p["v"]))

    partner = F.array(*[F.lit(k) for k in kp.MIRROR])
    named = F.when(F.col("flip") & (F.size("kpts") == 17), F.transform("kpts", lambda p, i: F.get("kpts", F.get(partner, i)))).otherwise(F.col("kpts"))
    rows = j.select("step", *KEYS, *[g.clamp01(v).alias(c) for v, c in zip(new, BOX, strict=True)], F.transform(named, one).alias("kpts"))
    # At most six steps an image.
    have = rows.groupBy("image_id").agg(F.collect_set("step").alias("_have"))
    run = F.aggregate(F.array_sort("_have"), F.lit(0), lambda n, k: F.when(k == n, n + 1).otherwise(n))
    return rows.join(have.select("image_id", run.alias("_used")), "image_id").where(F.col("step") < F.col("_used")).select(*rows.columns)


def grid_labels(poses: DataFrame, slots: DataFrame, columns: int) -> DataFrame:
    """Poses of images in a grid of equal tiles: turned to the right, brought to the tile's size by its ratio, padded, moved.

    slots: mosaic_id, slot (row by row), image_id, width, height, rotation (0, 90, 180, 270). A tile is as large as the widest and the highest turned image of
    its mosaic. Result: mosaic_id, slot, image_id, obj_idx, class_id, box, kpts, mosaic_w, mosaic_h. Points that aren't valid, or off the turned image, are
    zeros; a box that is empty after the turn goes. An image may stand in several slots.
    """
    turned = F.col("rotation").isin(90, 270)
    tw, th = F.when(turned, F.col("height")).otherwise(F.col("width")), F.when(turned, F.col("width")).otherwise(F.col("height"))
    whole = Window.partitionBy("mosaic_id")
    s = slots.withColumns({"_rw": tw, "_rh": th})
    s = s.withColumns({"_tw": F.max("_rw").over(whole), "_th": F.max("_rh").over(whole), "_rows": F.ceil((F.max("slot").over(whole) + 1) / columns).cast("int")})
    s = s.withColumn("_fit", layout.tile_fit(F.col("_rw").cast("double"), F.col("_rh").cast("double"), F.col("_tw"), F.col("_th")))
    s = s.withColumns({"mosaic_w": F.col("_tw") * columns, "mosaic_h": F.col("_th") * F.col("_rows"), "_x": (F.col("slot") % columns) * F.col("_tw"), "_y": F.floor(F.col("slot") / columns) * F.col("_th")})
    j = poses.join(s, "image_id")
    W, H, rw, rh = (F.col(c).cast("double") for c in ("width", "height", "_rw", "_rh"))
    pick = lambda at: tuple(F.when(F.col("rotation") == 90, at[90][i]).when(F.col("rotation") == 180, at[180][i]).when(F.col("rotation") == 270, at[270][i]).otherwise(at[0][i]) for i in (0, 1))
    on_turned = lambda x, y: pick({a: g.turn_point(a, x * W, y * H, W, H) for a in (0, 90, 180, 270)})
    x1, y1, x2, y2 = corners()
    (ax, ay), (bx, by) = on_turned(x1, y1), on_turned(x2, y2)
    j = j.withColumns({"_l": g.clamp(F.least(ax, bx), 0.0, rw), "_t": g.clamp(F.least(ay, by), 0.0, rh), "_r": g.clamp(F.greatest(ax, bx), 0.0, rw), "_b": g.clamp(F.greatest(ay, by), 0.0, rh)})
    straight = F.col("rotation") == 0
    j = j.where(straight | ((F.col("_r") > F.col("_l")) & (F.col("_b") > F.col("_t"))))
    # Without a turn each share is held to 0..1 by itself, else the box is cut to the image.
    shares = [F.when(straight, F.col(c)).otherwise(v) for c, v in zip(BOX, ((F.col("_l") + F.col("_r")) / 2 / rw, (F.col("_t") + F.col("_b")) / 2 / rh, (F.col("_r") - F.col("_l")) / rw, (F.col("_b") - F.col("_t")) / rh), strict=True)]
    j = j.withColumns(dict(zip(("_cx", "_cy", "_w", "_h"), [g.clamp01(v) for v in shares], strict=True))).where("_w > 0 AND _h > 0")
    kx, ky = F.col("_fit.new_w") / rw, F.col("_fit.new_h") / rh
    on_tile = lambda x, y: ((x * rw * kx + F.col("_fit.pad_x")) / F.col("_tw"), (y * rh * ky + F.col("_fit.pad_y")) / F.col("_th"))
    on_grid = lambda x, y: ((g.clamp01(x) * F.col("_tw") + F.col("_x")) / F.col("mosaic_w"), (g.clamp01(y) * F.col("_th") + F.col("_y")) / F.col("mosaic_h"))
    cx, cy = on_grid(*on_tile(F.col("_cx"), F.col("_cy")))
    size = [g.clamp01(F.col(c) * r * k / F.col(t)) * F.col(t) / F.col(m) for c, r, k, t, m in (("_w", rw, kx, "_tw", "mosaic_w"), ("_h", rh, ky, "_th", "mosaic_h"))]

    def one(p: Column) -> Column:
        px, py = on_turned(p["x"], p["y"])
        x, y = px / rw, py / rh
        held = (F.when(straight, g.clamp01(x)).otherwise(x), F.when(straight, g.clamp01(y)).otherwise(y))
        off = ~straight & ((x < 0) | (x > 1) | (y < 0) | (y > 1))
        mx, my = on_grid(*on_tile(*held))
        return F.when(~kp.valid(p) | off | ((held[0] == 0) & (held[1] == 0)), kp.ZERO()).otherwise(kp.point(g.clamp01(mx), g.clamp01(my), p["v"]))

    return j.select("mosaic_id", "slot", *KEYS, *[g.clamp01(v).alias(c) for v, c in zip((cx, cy, *size), BOX, strict=True)], F.transform("kpts", one).alias("kpts"), "mosaic_w", "mosaic_h")

"""Mosaics and tiles: where images go, from their sizes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import ranks


def shape_class(w: Column, h: Column) -> Column:
    return F.when(F.least(w, h) / F.greatest(w, h) > 0.8, "square").when(h > w, "portrait").otherwise("landscape")


def bucket(w: Column, h: Column, small: int = 224, medium: int = 384) -> Column:
    """Eight kinds of image by ratio and longer side."""
    r, m = w / h, F.greatest(w, h)
    near = lambda *targets: [g.ratio_near(r, t) for t in targets]
    (sq,), (p2, p3), (l2, l3), (p6,), (l6,) = near(1.0), near(0.5, 9 / 16), near(2.0, 16 / 9), near(2 / 3), near(3 / 2)
    return (
        F.when(sq & (m <= small), "square_small").when(sq & (m <= medium), "square_medium").when(sq, "square_large")
        .when(p2 | p3, "portrait_2").when(l2 | l3, "landscape_2").when(p6, "portrait_6").when(l6, "landscape_6").otherwise("rest")
    )


def seeded(key: Column, seed: int = 0) -> Column:
    """A number for a shuffled order that any engine can compute."""
    return (key + seed) * 2654435761 % 4294967296


def groups(images: DataFrame, by: str, size: int, key: str = "image_id", seed: int = 0) -> DataFrame:
    """Shuffled groups of ``size`` within ``by``; the last group is filled up from the start of the order."""
    n = ranks.numbered_within(images, by, [seeded(F.col(key), seed), key], "_no", 0, "_all")
    own = n.select(key, by, "_all", F.floor(F.col("_no") / size).alias("group_no"), (F.col("_no") % size).cast("int").alias("slot"), "_no")
    short = F.pmod(-F.col("_all"), F.lit(size))
    again = own.where(F.col("_no") < short).withColumn("_pos", F.col("_all") + F.col("_no"))
    # Fewer images than places: they come round again.
    rounds = F.ceil(short / F.col("_all"))
    again = own.where(short > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), (rounds - 1).cast("int")))).withColumn("_fill", F.col("_k") * F.col("_all") + F.col("_no")).where(F.col("_fill") < short)
    again = again.withColumn("_pos", F.col("_all") + F.col("_fill"))
    filled = again.select(key, by, F.floor(F.col("_pos") / size).alias("group_no"), (F.col("_pos") % size).cast("int").alias("slot"))
    return own.select(key, by, "group_no", "slot").unionByName(filled)


def grid(slots: DataFrame, columns: int) -> DataFrame:
    """Offsets and scales of images (mosaic_id, slot, width, height) in rows of ``columns``.

    A row takes the height of its first image; then rows are scaled to the width of the first row.
    """
    s = slots.withColumns({"row": F.floor(F.col("slot") / columns).cast("int"), "col": (F.col("slot") % columns).cast("int")})
    side = lambda v: F.greatest(F.lit(1), F.rint(v).cast("int"))
    row = Window.partitionBy("mosaic_id", "row").orderBy("col")
    whole = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_h", F.first("height").over(whole))
    s = s.withColumn("_w", F.when(F.col("height") == F.col("_h"), F.col("width")).otherwise(side(F.col("width") * (F.col("_h") / F.col("height")))))
    s = s.withColumn("_row_w", F.sum("_w").over(whole))
    all_ = Window.partitionBy("mosaic_id").orderBy("row", "col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_base", F.first("_row_w").over(all_))
    k = F.col("_base") / F.col("_row_w")
    same = F.col("_row_w") == F.col("_base")
    s = s.withColumns({"tile_w": F.when(same, F.col("_w")).otherwise(side(F.col("_w") * k)), "tile_h": F.when(same, F.col("_h")).otherwise(side(F.col("_h") * k))})
    x = F.coalesce(F.sum("tile_w").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    up = F.coalesce(F.sum(F.when(F.col("col") == 0, F.col("tile_h"))).over(Window.partitionBy("mosaic_id").orderBy("row").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumns({"x": x.cast("int"), "y": up.cast("int")}).select("mosaic_id", "slot", "x", "y", "tile_w", "tile_h")


def _placed(state: Column, step: Column) -> Column:
    """The state after one more tile in what is left of the canvas (a guillotine cut); unchanged if nothing is left."""
    sideways = step["rotation"].isin(90, 270)
    rw, rh = (F.when(sideways, state[a]).otherwise(state[b]).cast("double") for a, b in (("h", "w"), ("w", "h")))
    room_w, room_h = state["rem_w"], state["rem_h"]
    # Width and height that the tile has if it fills the other side.
    wide, tall = F.rint(rw * room_h / rh).cast("int"), F.rint(rh * room_w / rw).cast("int")
    cut = F.when(step["by_height"], wide <= room_w).otherwise(tall > room_h)
    tw = F.greatest(F.lit(1), F.least(room_w, F.when(cut, wide).otherwise(room_w)))
    th = F.greatest(F.lit(1), F.least(room_h, F.when(cut, room_h).otherwise(tall)))
    tile = F.struct(state["rem_x"].alias("x"), state["rem_y"].alias("y"), tw.alias("tile_w"), th.alias("tile_h"), step["rotation"].alias("rotation"), step["flip"].alias("flip"))
    after = F.struct(
        state["w"].alias("w"), state["h"].alias("h"),
        (state["rem_x"] + F.when(cut, tw).otherwise(0)).alias("rem_x"), (state["rem_y"] + F.when(cut, 0).otherwise(th)).alias("rem_y"),
        (room_w - F.when(cut, tw).otherwise(0)).alias("rem_w"), (room_h - F.when(cut, 0).otherwise(th)).alias("rem_h"),
        F.concat(state["tiles"], F.array(tile)).alias("tiles"),
    )
    return F.when((room_w > 0) & (room_h > 0), after).otherwise(state)


def self_mosaic(images: DataFrame, factor: float = 0.7) -> DataFrame:
    """Up to five turned and mirrored tiles beside (portrait) or below an image: one row per tile, with the canvas size. A fold over the five steps."""
    tall = F.col("height") >= F.col("width")
    extra = F.greatest(F.lit(1), (F.greatest("width", "height") * F.lit(factor)).cast("int"))
    start = F.struct(
        F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"),
        F.when(tall, F.col("width")).otherwise(0).cast("int").alias("rem_x"), F.when(tall, 0).otherwise(F.col("height")).cast("int").alias("rem_y"),
        F.when(tall, extra).otherwise(F.col("width")).cast("int").alias("rem_w"), F.when(tall, F.col("height")).otherwise(extra).cast("int").alias("rem_h"),
        F.expr("CAST(array() AS array<struct<x:int,y:int,tile_w:int,tile_h:int,rotation:int,flip:boolean>>)").alias("tiles"),
    )
    # Turn, mirror, and the side that is filled first in a portrait; the other in a landscape.
    steps = [(90, False, "width"), (0, True, "height"), (270, False, "width"), (0, False, "height"), (0, True, "height")]
    table = F.array(*[F.struct(F.lit(r).alias("rotation"), F.lit(f).alias("flip"), (tall == F.lit(side == "height")).alias("by_height")) for r, f, side in steps])
    sized = images.where("width > 0 AND height > 0").withColumns({"canvas_w": F.col("width") + F.when(tall, extra).otherwise(0), "canvas_h": F.col("height") + F.when(tall, 0).otherwise(extra)})
    tiles = F.aggregate(table, start, _placed, lambda state: state["tiles"])
    return sized.select("image_id", "canvas_w", "canvas_h", F.posexplode(tiles).alias("step", "t")).select("image_id", "canvas_w", "canvas_h", "step", "t.*")


def tile_fit(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """Size and padding of an image inside a tile, keeping its ratio (halves to even)."""
    s = F.least(tw / w, th / h)
    nw, nh = F.greatest(F.lit(1), F.rint(w * s).cast("int")), F.greatest(F.lit(1), F.rint(h * s).cast("int"))
    return F.struct(nw.alias("new_w"), nh.alias("new_h"), ((tw - nw) / 2).cast("int").alias("pad_x"), ((th - nh) / 2).cast("int").alias("pad_y"))

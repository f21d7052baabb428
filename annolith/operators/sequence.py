"""Frames of a sequence (seq_id, frame_index): windows by sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near_duplicates(frames: DataFrame, feature: str, most: float) -> DataFrame:
    """Frames whose feature differs from the last readable frame's by ``most`` at most."""
    w = Window.partitionBy("seq_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(feature, ignorenulls=True).over(w)
    return frames.withColumn("previous", before).where(F.abs(F.col(feature) - F.col("previous")) <= most)


def block_duplicates(frames: DataFrame, pixels: str, width: int, block: int, most: float) -> DataFrame:
    """Frames that differ from the one before by ``most`` at most in every square block: the largest of the blocks' mean differences.

    ``pixels``: an array of grey values, row by row. Frames of another size than the one before, and the first, aren't compared. Blocks are sums over
    slices of the array, so a frame stays one row.
    """
    w = Window.partitionBy("seq_id").orderBy("frame_index")
    both = frames.withColumn("_before", F.lag(pixels).over(w)).where((F.size("_before") == F.size(pixels)) & (F.size(pixels) > 0))
    both = both.select("seq_id", "frame_index", F.zip_with(pixels, "_before", lambda a, b: F.abs(a - b)).alias("_d"))
    rows = F.ceil(F.size("_d") / width).cast("int")
    starts = lambda n: F.sequence(F.lit(0), n - 1, F.lit(block))

    def mean(top: Column, left: Column) -> Column:
        """Of the block that begins there; blocks at the right and lower edges are smaller."""
        lines = F.sequence(top, F.least(top + block, rows) - 1)
        inside = F.flatten(F.transform(lines, lambda y: F.slice("_d", y * width + left + 1, F.least(F.lit(block), F.lit(width) - left))))
        sums = F.aggregate(inside, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n")))
        return sums["s"] / sums["n"]

    means = F.flatten(F.transform(starts(rows), lambda top: F.transform(starts(F.lit(width)), lambda left: mean(top, left))))
    return both.select("seq_id", "frame_index", F.array_max(means).alias("difference")).where(F.col("difference") <= most)


def in_range(frames: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Frames from ``start`` to ``end``, both included; an end beyond the last frame is the last frame."""
    return frames.where((F.col("frame_index") >= start) & (F.lit(True) if end is None else F.col("frame_index") <= end))


def from_the_end(rows: DataFrame, group: list[str], order: list, nth: int) -> DataFrame:
    """The nth row of each group from its end (0: the last); -1 keeps all."""
    if nth < 0:
        return rows
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == nth + 1).drop("_n")


def until_empty(pages: DataFrame, group: str, order: str, found: str, twice: int = 2) -> DataFrame:
    """Pages of each search up to the ``twice``-th empty one in a row, which is the last that is read."""
    w = Window.partitionBy(group).orderBy(order)
    none = (F.coalesce(F.col(found), F.lit(0)) == 0).cast("int")
    run = F.sum(none).over(w.rowsBetween(-(twice - 1), 0))
    ended = F.max((run == twice).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("_ended", ended).where(F.coalesce(F.col("_ended"), F.lit(0)) == 0).drop("_ended")


def size_changes(frames: DataFrame, feature: str) -> DataFrame:
    """Whether a frame's feature differs from the one before, and the sequence's first one."""
    w = Window.partitionBy("seq_id").orderBy("frame_index")
    return frames.withColumns({"changed": F.coalesce(F.lag(feature).over(w) != F.col(feature), F.lit(False)), "first_value": F.first(feature, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def every_nth(frames: DataFrame, skip: int) -> DataFrame:
    """Every (skip + 1)-th frame, with its number padded to the width of the sequence's length."""
    w = Window.partitionBy("seq_id")
    n = F.row_number().over(w.orderBy("frame_index"))
    out = frames.withColumns({"_n": n, "_all": F.count("*").over(w)}).where((F.col("_n") - 1) % (skip + 1) == 0)
    return out.withColumn("label", F.lpad(F.col("_n").cast("string"), F.length(F.col("_all").cast("string")), "0")).drop("_n", "_all")


def history(sources: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """For each target the ``depth`` newest source frames before it, newest first.

    Sources are numbered within their sequence and a target knows how many come before it, so the
    join is on equal numbers; its rows are at most ``depth`` per target.
    """
    both = sources.select("seq_id", "frame_index", F.lit(1).alias("_s"), F.lit(0).alias("_t")).unionByName(targets.select("seq_id", "frame_index", F.lit(0).alias("_s"), F.lit(1).alias("_t")))
    before = Window.partitionBy("seq_id").orderBy("frame_index").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    src = both.where("_s = 1").select("seq_id", F.col("frame_index").alias("source_index"), (F.col("_before") + 1).alias("_no"))
    tgt = both.where("_t = 1 and _before > 0").select("seq_id", F.col("frame_index").alias("target_index"), "_before")
    tgt = tgt.withColumn("_no", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_before") - (depth - 1)), F.col("_before"))))
    return tgt.join(src, ["seq_id", "_no"]).select("seq_id", "target_index", "source_index", (F.col("_before") - F.col("_no") + 1).cast("int").alias("place"))


def expected_history(targets: DataFrame, depth: int, own_only: bool = True) -> DataFrame:
    """Targets with ``work``: how many source frames each is expected to have, for a progress display. With ``own_only`` its place among the targets,
    ``depth`` at most, else ``depth``."""
    if not own_only:
        return targets.withColumn("work", F.lit(depth))
    nth = F.row_number().over(Window.partitionBy("seq_id").orderBy("frame_index"))
    return targets.withColumn("work", F.least(nth, F.lit(depth)))


def at_or_after(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (seq_id, at): the frame with that index, else the next larger."""
    both = frames.select("seq_id", F.col("frame_index").alias("k"), F.col("frame_index").alias("f"), F.lit(None).cast("long").alias("at")).unionByName(
        wanted.select("seq_id", F.col("at").alias("k"), F.lit(None).cast("long").alias("f"), F.col("at").cast("long").alias("at")), allowMissingColumns=True
    )
    w = Window.partitionBy("seq_id").orderBy("k").rangeBetween(0, Window.unboundedFollowing)
    return both.withColumn("frame_index", F.min("f").over(w)).where("at is not null and frame_index is not null").select("seq_id", "at", "frame_index")


def weight(gap: Column, back_error: Column, retried: Column, decay: float) -> Column:
    """How much a source frame counts: less by distance, tracking error and a retry."""
    w = F.exp(-F.greatest(F.lit(1.0), gap.cast("double")) / max(0.001, decay)) * (1.0 / (1.0 + F.greatest(F.lit(0.0), F.coalesce(back_error, F.lit(0.0))))) * F.when(retried, 0.85).otherwise(1.0)
    return F.greatest(F.lit(1e-6), w)


def fuse(candidates: DataFrame, keys: list[str], least: float = 0.002, factor: float = 2.5) -> DataFrame:
    """Weighted mean of candidate points (x, y, weight) per key; of three or more, those far from the median are left out."""
    mid = candidates.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile("x", F.lit(0.5)).alias("_mx"), F.percentile("y", F.lit(0.5)).alias("_my"))
    j = candidates.join(mid, keys).withColumn("_d", F.sqrt((F.col("x") - F.col("_mx")) * (F.col("x") - F.col("_mx")) + (F.col("y") - F.col("_my")) * (F.col("y") - F.col("_my"))))
    lim = j.groupBy(*keys).agg(F.greatest(F.lit(least), F.percentile("_d", F.lit(0.5)) * factor).alias("_lim"))
    keep = (F.col("_n") < 3) | (F.col("_d") <= F.col("_lim"))
    sums = j.join(lim, keys).groupBy(*keys).agg(
        F.sum(F.when(keep, F.col("x") * F.col("weight"))).alias("_sx"), F.sum(F.when(keep, F.col("y") * F.col("weight"))).alias("_sy"), F.sum(F.when(keep, F.col("weight"))).alias("_sw"), F.count_if(~keep).alias("rejected"),
    )
    return sums.select(*keys, (F.col("_sx") / F.col("_sw")).alias("x"), (F.col("_sy") / F.col("_sw")).alias("y"), "rejected")

"""Reports on data sets: what is wrong with images and label files, and the totals that tools end with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb

#: What :func:`check_dataset` looks for.
PROBLEMS = ("no_label_file", "no_image", "same_stem", "line", "class", "points", "box", "visibility")


def check_dataset(images: DataFrame, files: DataFrame, classes: int, points: int | None = None, dialect: str = "strict") -> DataFrame:
    """Everything that is wrong: problem, stem, line_no (null for files) and detail.

    images: stem; files: stem, raw. ``no_label_file`` and ``no_image``: a stem on one side only; ``same_stem``: several images with one; ``line``: a line that the
    dialect refuses; ``class``: not a whole number from 0 to ``classes`` - 1; ``points``: another number of keypoints than ``points``; ``box``: not within 0 to 1, or
    without width or height; ``visibility``: negative, or a point outside 0 to 1 that is seen. Stems that are null count as one name.
    """
    have, named = images.select("stem"), files.select("stem")
    other = lambda a, b: a.distinct().join(b.distinct().withColumnRenamed("stem", "_s"), F.col("stem").eqNullSafe(F.col("_s")), "left_anti")
    of_files = [
        other(have, named).select(F.lit("no_label_file").alias("problem"), "stem", F.lit("").alias("detail")),
        other(named, have).select(F.lit("no_image").alias("problem"), "stem", F.lit("").alias("detail")),
        have.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("same_stem").alias("problem"), "stem", F.col("n").cast("string").alias("detail")),
    ]
    p = lb.parsed_lines(files, dialect)
    share = lambda v: (v >= 0) & (v <= 1)
    fine = F.col("p.error").isNull()
    size = F.size("p.kpts")
    odd_point = F.exists("p.kpts", lambda k: (k["v"] < 0) | ((k["v"] > 0) & ~(share(k["x"]) & share(k["y"]))))
    whole = F.col("p.class_token").try_cast("int")
    box = share(F.col("p.cx")) & share(F.col("p.cy")) & share(F.col("p.w")) & share(F.col("p.h")) & (F.col("p.w") > 0) & (F.col("p.h") > 0)
    found = F.array(
        F.when(~fine, F.struct(F.lit("line").alias("problem"), F.col("p.error").alias("detail"))),
        F.when(fine & ~F.coalesce((whole >= 0) & (whole < classes), F.lit(False)), F.struct(F.lit("class").alias("problem"), F.col("p.class_token").alias("detail"))),
        F.when(fine & (size != points), F.struct(F.lit("points").alias("problem"), size.cast("string").alias("detail"))) if points is not None else F.lit(None),
        F.when(fine & ~F.coalesce(box, F.lit(False)), F.struct(F.lit("box").alias("problem"), F.concat_ws(" ", *[F.col(f"p.{c}").cast("string") for c in ("cx", "cy", "w", "h")]).alias("detail"))),
        F.when(fine & odd_point, F.struct(F.lit("visibility").alias("problem"), F.lit("").alias("detail"))),
    )
    of_lines = p.select("stem", "line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.problem", "stem", "line_no", "x.detail")
    out = of_lines
    for part in of_files:
        out = out.unionByName(part.select("problem", "stem", F.lit(None).cast("int").alias("line_no"), "detail"))
    return out


def totals(report: DataFrame, column: str = "problem", names: Sequence[str] = PROBLEMS) -> DataFrame:
    """How often each problem occurs, in their order, zeros kept."""
    from . import dataset as ds

    return ds.prefix_counts(report, column, list(names)).withColumnRenamed("prefix", column)


def cleanup_totals(images: DataFrame, labels: DataFrame, on: str = "stem") -> DataFrame:
    """One row: images, labels, pairs, labels that move away and labels that are made. Stems count once."""
    a = images.select(on).distinct().withColumn("_i", F.lit(1))
    b = labels.select(on).distinct().withColumn("_l", F.lit(1))
    both = a.join(b, on, "full")
    has = lambda c: F.col(c).isNotNull()
    return both.agg(
        F.count_if(has("_i")).alias("images"), F.count_if(has("_l")).alias("labels"), F.count_if(has("_i") & has("_l")).alias("pairs"), F.count_if(~has("_i")).alias("moved"), F.count_if(~has("_l")).alias("created")
    )


def byte_totals(files: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """One row: files, bytes before and after, bytes saved. A null ``after`` is a deleted file."""
    b, a = F.coalesce(F.sum(before), F.lit(0)), F.coalesce(F.sum(F.coalesce(F.col(after), F.lit(0))), F.lit(0))
    return files.agg(F.count("*").alias("files"), b.alias("before"), a.alias("after"), (b - a).alias("saved"), F.count_if(F.col(after).isNull()).alias("deleted"))


def merge_summary(counts: DataFrame) -> DataFrame:
    """The text of a merge as lines (pos, line). counts: source, train_images, val_images, train_instances, val_instances, one row a source."""
    from . import ranks

    # The words of the summary's lines.
    names = ("train_images", "val_images", "train_instances", "val_instances")
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    both = lambda kind: (F.coalesce(F.col(f"train_{kind}"), F.lit(0)) + F.coalesce(F.col(f"val_{kind}"), F.lit(0))).cast("string")
    said = lambda kind: [both(kind), F.lit(f" {kind} (train "), text(f"train_{kind}"), F.lit(", val "), text(f"val_{kind}"), F.lit(")")]
    sources = ranks.numbered(counts, ["source"], "_n", 1)
    lines = sources.select((F.col("_n") + 2).alias("pos"), F.concat(F.lit("- "), F.col("source"), F.lit(": "), *said("images"), F.lit("; "), *said("instances")).alias("line"))
    total = counts.agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in names])
    end = total.select((F.greatest(F.col("_n"), F.lit(1)) + 4).alias("pos"), F.concat(F.lit("Totals: "), *said("images"), F.lit("; "), *said("instances")).alias("line"))
    blank = total.select((F.greatest(F.col("_n"), F.lit(1)) + 3).alias("pos"), F.lit("").alias("line"))
    none = total.where("_n = 0").select(F.lit(3).cast("long").alias("pos"), F.lit("- None (no new sources merged)").alias("line"))
    head = counts.sparkSession.createDataFrame([(0, "# Merge Summary"), (1, ""), (2, "Sources merged:")], "pos long, line string")
    return head.unionByName(lines).unionByName(none).unionByName(blank).unionByName(end)

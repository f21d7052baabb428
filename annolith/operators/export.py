"""Export: nested documents per split, summaries, manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keypoints as kp
from . import boxes as bx
from . import ranks


def documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, split: str = "split") -> DataFrame:
    """One JSON text per split with images, annotations and categories, each in id order.

    images: split, id, file_name, width, height. annotations: split, id, image_id, category_id,
    left, top, box_w, box_h, area, kpts. A split's document is one value, so this is for export
    of data sets that a single file can hold.
    """
    img = images.groupBy(split).agg(F.array_sort(F.collect_list(F.struct("id", "file_name", "width", "height"))).alias("images"))
    flat = F.flatten(F.transform("kpts", lambda p: F.array(p["x"], p["y"], kp.exported_visibility(p["v"]).cast("double"))))
    seen = F.size(F.filter("kpts", lambda p: kp.exported_visibility(p["v"]) > 0))
    a = F.struct("id", "image_id", "category_id", F.array("left", "top", "box_w", "box_h").alias("bbox"), "area", F.lit(0).alias("iscrowd"), flat.alias("keypoints"), seen.alias("num_keypoints"))
    ann = annotations.groupBy(split).agg(F.array_sort(F.collect_list(a)).alias("annotations"))
    cat = categories.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("categories"))
    joined = img.join(ann, split, "left").crossJoin(F.broadcast(cat))
    doc = F.struct("images", F.col("annotations"), "categories")
    return joined.select(split, F.to_json(doc, {"pretty": "true"}).alias("document"))


#: What an export says of itself unless it is told otherwise.
INFO = {"description": "", "version": "1.0", "year": 0, "contributor": "", "date_created": ""}


def document_lines(images: DataFrame, annotations: DataFrame, categories: DataFrame, info: dict | None = None, licenses: list[dict] = (), split: str = "split") -> DataFrame:
    """The export of :func:`documents`, with info and licenses, as numbered lines (split, section, pos, line), whatever its size.

    A line is a bracket, or one image, annotation or category; its comma stands before it. Lines are numbered by ranges, so no task holds a split, and
    the lines of a split in order are one JSON text. images, annotations: as for :func:`documents`; a split without images has no document, and
    its annotations are left out.
    """
    spark = images.sparkSession
    splits = images.select(F.col(split).alias("split")).distinct()
    flat = F.flatten(F.transform("kpts", lambda p: F.array(p["x"], p["y"], kp.exported_visibility(p["v"]).cast("double"))))
    seen = F.size(F.filter("kpts", lambda p: kp.exported_visibility(p["v"]) > 0))
    image = F.struct("id", "file_name", "width", "height")
    note = F.struct("id", "image_id", "category_id", F.array("left", "top", "box_w", "box_h").alias("bbox"), "area", F.lit(0).alias("iscrowd"), flat.alias("keypoints"), seen.alias("num_keypoints"))
    kept = annotations.join(splits.select(F.col("split").alias("_split")), F.col(split).eqNullSafe(F.col("_split")), "left_semi")
    rows = images.select(F.col(split).alias("split"), F.lit(1).alias("section"), F.col("id").cast("long").alias("_id"), F.to_json(image).alias("json"))
    rows = rows.unionByName(kept.select(F.col(split).alias("split"), F.lit(2).alias("section"), F.col("id").cast("long").alias("_id"), F.to_json(note).alias("json")))
    one = categories.select(F.lit(3).alias("section"), F.col("category_id").cast("long").alias("_id"), F.to_json(F.struct("*")).alias("json"))
    rows = rows.unionByName(splits.join(one).select("split", "section", "_id", "json"))  # categories are the classes in use
    named = rows.withColumn("_key", F.to_json(F.struct("split", "section"), {"ignoreNullFields": "false"}))
    lines = ranks.numbered_within(named, "_key", ["_id", "json"], "pos", 1).select("split", "section", "pos", F.concat(F.when(F.col("pos") > 1, ",").otherwise(""), F.col("json")).alias("line"))
    head = f'{{"info": {json.dumps({**INFO, **(info or {})})}, "licenses": {json.dumps(list(licenses))}, "images": ['
    frame = spark.createDataFrame([(1, head), (2, '], "annotations": ['), (3, '], "categories": ['), (4, "]}")], "section int, line string")
    frame = splits.join(F.broadcast(frame)).select("split", "section", F.lit(0).cast("long").alias("pos"), "line")  # four rows
    return lines.unionByName(frame)


def write_documents(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """Write each split's lines in order, as text files in a folder of its own (``split=...``); one after the other by name they are its document."""
    n = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(n, "split", "section", "pos").sortWithinPartitions("split", "section", "pos")
    ordered.select("split", "line").write.partitionBy("split").mode("overwrite").text(path)


def summary(counts: DataFrame, dataset: str) -> DataFrame:
    """Lines of a table of images and objects by dataset, totals last."""
    cells = [F.col(dataset), F.col("images").cast("string"), F.col("objects").cast("string")]
    named = counts.withColumn(dataset, F.coalesce(dataset, F.lit("total")))
    return named.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def manifest(plan: DataFrame, source: str, target: str, action: str, dry_run: bool = False) -> DataFrame:
    """What to do to files, as rows; with ``dry_run`` nothing is to be done."""
    return plan.select(F.lit("none" if dry_run else action).alias("action"), F.col(source).alias("source"), F.col(target).alias("target"))


def flip_merge(normal: DataFrame, flipped: DataFrame, pairs: DataFrame) -> DataFrame:
    """Detections with their mirrored run's matches: boxes and points by confidence, the larger confidence; the rest as is.

    normal and flipped: image_id, obj_idx, class_id, cx, cy, w, h, score and, if they have them, kpts (array of struct<x, y, v>, v a confidence).
    pairs: image_id, a_idx, b_idx. A null score or v counts as 1. If both confidences are 0, a box or point is at zero. Points that one
    side has more are its own; null points give way to the other's.
    """
    n, f, p = normal.alias("n"), flipped.alias("f"), pairs.alias("p")
    j = n.join(p, (F.col("n.image_id") == F.col("p.image_id")) & (F.col("n.obj_idx") == F.col("p.a_idx")), "left")
    j = j.join(f, (F.col("f.image_id") == F.col("p.image_id")) & (F.col("f.obj_idx") == F.col("p.b_idx")), "left")
    lone = F.col("f.image_id").isNull()
    wn, wf = F.coalesce("n.score", F.lit(1.0)), F.coalesce("f.score", F.lit(1.0))
    weighted = lambda a, b, wa, wb: (a * wa + b * wb) / F.when(wa + wb > 0, wa + wb).otherwise(1.0)
    mix = lambda c: F.when(lone, F.col(f"n.{c}")).otherwise(weighted(F.col(f"n.{c}"), F.col(f"f.{c}"), wn, wf)).alias(c)
    score = F.when(lone & F.col("n.score").isNull(), F.lit(1.0)).when(lone, F.col("n.score")).otherwise(F.greatest(wn, wf))

    def point(a: Column, b: Column) -> Column:
        ca, cb = F.coalesce(a["v"], F.lit(1.0)), F.coalesce(b["v"], F.lit(1.0))
        both = kp.point(weighted(a["x"], b["x"], ca, cb), weighted(a["y"], b["y"], ca, cb), F.greatest(ca, cb))
        alone = lambda q, c: kp.point(q["x"], q["y"], c)
        return F.when(a.isNull(), alone(b, cb)).when(b.isNull(), alone(a, ca)).otherwise(both)

    posed = "kpts" in normal.columns and "kpts" in flipped.columns
    own = lambda c: F.transform(c, lambda q: kp.point(q["x"], q["y"], F.coalesce(q["v"], F.lit(1.0))))
    kpts = [F.when(lone | F.col("f.kpts").isNull(), own("n.kpts")).when(F.col("n.kpts").isNull(), own("f.kpts")).otherwise(F.zip_with("n.kpts", "f.kpts", point)).alias("kpts")] if posed else []
    merged = j.select("n.image_id", "n.class_id", *[mix(c) for c in bx.BOX], score.alias("score"), *kpts)
    rest = flipped.join(pairs.select("image_id", F.col("b_idx").alias("obj_idx")), ["image_id", "obj_idx"], "left_anti")
    return merged.unionByName(rest.select("image_id", "class_id", *bx.BOX, F.coalesce("score", F.lit(1.0)).alias("score"), *([own("kpts").alias("kpts")] if posed else [])))

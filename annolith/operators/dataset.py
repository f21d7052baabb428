"""Datasets as tables of images and label files: pairing, cleaning, splitting, numbering, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def orphan_labels(labels: DataFrame, images: DataFrame, on: str = "stem") -> DataFrame:
    """Label files without an image."""
    return labels.join(images.select(on), on, "left_anti")


def unlabelled(images: DataFrame, labels: DataFrame, on: str = "stem") -> DataFrame:
    """Images without a label file."""
    return images.join(labels.select(on), on, "left_anti")


def paired(images: DataFrame, labels: DataFrame, on: str = "stem") -> DataFrame:
    return images.join(labels.select(on), on, "left_semi")


def must_pair(images: DataFrame, labels: DataFrame, on: str = "stem") -> DataFrame:
    """Images with their labels; the job fails if one has none."""
    marked = images.join(labels.withColumn("_there", F.lit(True)), on, "left")
    checked = F.when(F.col("_there"), F.col(on)).otherwise(F.raise_error(F.concat(F.lit("no label file for "), F.col(on).cast("string"))).cast("string"))
    return marked.withColumn(on, checked.cast(images.schema[on].dataType)).drop("_there")


def cleanup_plan(images: DataFrame, labels: DataFrame, on: str = "stem") -> DataFrame:
    """What to do: move labels without an image, create empty ones for images without."""
    move = orphan_labels(labels, images, on).select(on, F.lit("move").alias("action"))
    return move.unionByName(unlabelled(images, labels, on).select(on, F.lit("create").alias("action")))


def line_count(raw: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: F.trim(x) != ""))


def split_every(images: DataFrame, dataset: str, order: str, least: int = 64, every: int = 8) -> DataFrame:
    """``split``: train, or val for every n-th eligible image. The count runs on across datasets in order;
    datasets with fewer than ``least`` images are train and aren't counted. ``ordinal`` is null for these.

    No task holds a dataset: the running number is that of :func:`ranks.numbered`.
    """
    size = images.groupBy(F.col(dataset).alias("_dataset")).agg(F.count("*").alias("_n"))
    sized = images.join(size, F.col(dataset).eqNullSafe(F.col("_dataset"))).drop("_dataset")
    counted = ranks.numbered(sized.where(F.col("_n") >= least), [dataset, order], "ordinal")
    out = counted.unionByName(sized.where(F.col("_n") < least).withColumn("ordinal", F.lit(None).cast("long")))
    return out.withColumn("split", F.when(F.col("ordinal") % every == 0, "val").otherwise("train")).drop("_n")


def counts(split: DataFrame, labels: DataFrame, dataset: str, on: str) -> DataFrame:
    """Images and objects by dataset and split, with totals (null)."""
    n = labels.groupBy(on).agg(F.count("*").alias("_objects"))
    return split.join(n, on, "left").rollup(dataset, "split").agg(F.count("*").alias("images"), F.coalesce(F.sum("_objects"), F.lit(0)).alias("objects"))


def rename_plan(images: DataFrame, order: str, start: int = 1, prefix: str = "") -> DataFrame:
    """New names: a running number in order, padded to the width of the last."""
    total = images.agg(F.count("*").alias("_total"))
    width = F.length((F.col("_total") + (start - 1)).cast("string"))
    named = ranks.numbered(images, [order], "_number", start).crossJoin(F.broadcast(total))
    return named.withColumn("new_name", F.concat(F.lit(prefix), F.lpad(F.col("_number").cast("string"), width, "0"))).drop("_total", "_number")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Running numbers from 1."""
    return ranks.numbered(rows, order, name)


def conflicts(plan: DataFrame, source: str, target: str, existing: DataFrame | None = None) -> DataFrame:
    """Targets that two sources want (``duplicate``), or that exist and aren't themselves moved away (``exists``).

    ``existing``: the names there are, in a column like ``target``; without it the sources are all there is.
    """
    twice = plan.groupBy(target).agg(F.count("*").alias("n")).where("n > 1").select(target, F.lit("duplicate").alias("problem"))
    if existing is None:
        return twice
    there = plan.select(target).distinct().join(existing.select(target), target, "left_semi")
    stay = there.join(plan.select(F.col(source).alias(target)), target, "left_anti")
    return twice.unionByName(stay.select(target, F.lit("exists").alias("problem")))


def unique_names(rows: DataFrame, name: str, order: list, out: str = "unique_name") -> DataFrame:
    """A name of its own for every row: the first keeps its name, the next with it gets _01, _02 and so on.

    A made name that some row has itself, or that two rows would get, goes on to numbers after the largest in use with its stem, so no two rows
    have one name, whatever names there are. Null names stay null.
    """
    numbered_name = lambda stem, n: F.concat(stem, F.lit("_"), F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), "0"))
    named = ranks.numbered_within(rows, name, order, "_copy", 0)
    made = named.withColumn(out, F.when((F.col("_copy") == 0) | F.col(name).isNull(), F.col(name)).otherwise(numbered_name(F.col(name), F.col("_copy"))))
    # Names that rows have by themselves, and those that a row's stem and number make: a second row with one of them has to move on.
    taken = rows.select(F.col(name).alias("_taken")).distinct()
    clash = (F.col("_copy") > 0) & F.col("_taken").isNotNull()
    checked = made.join(taken, F.col(out) == F.col("_taken"), "left").withColumn("_clash", clash)
    # The largest number in use after a stem: of its own copies, and of names like it.
    like = taken.select(F.regexp_extract("_taken", r"^(.*)_(\d{2,})$", 1).alias("_stem"), F.regexp_extract("_taken", r"^(.*)_(\d{2,})$", 2).try_cast("long").alias("_n")).where("_n is not null")
    like = like.unionByName(named.where("_copy > 0").select(F.col(name).alias("_stem"), F.col("_copy").cast("long").alias("_n"))).groupBy("_stem").agg(F.max("_n").alias("_most"))
    moving = checked.where("_clash").drop("_taken")
    moved = ranks.numbered_within(moving, name, order, "_again", 1).join(like, F.col(name) == F.col("_stem"))
    moved = moved.withColumn(out, numbered_name(F.col(name), F.col("_most") + F.col("_again")))
    columns = [*rows.columns, out]
    return checked.where("NOT _clash").select(*columns).unionByName(moved.select(*columns))


def numbered_by_prefix(rows: DataFrame, prefix: str, order: list, start: int = 0, out: str = "number") -> DataFrame:
    """A counter per prefix that runs on over all stages in the given order."""
    return ranks.numbered_within(rows, prefix, order, out, start)


def counts_of_all(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """How many rows have each name, in the names' order; names without rows have 0, null names don't count."""
    return prefix_counts(rows, column, names).withColumnRenamed("prefix", "name")


def key_histogram(rows: DataFrame, keys: str) -> DataFrame:
    """How many rows use each key of an array or map column."""
    kind = rows.schema[keys].dataType.typeName()
    used = F.map_keys(keys) if kind == "map" else F.array_distinct(keys)
    return rows.select(F.explode(used).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def coco_categories(used: DataFrame, points: int, names: list[str] | None = None, skeleton: list[tuple[int, int]] | None = None) -> DataFrame:
    """Categories of :func:`categories` with what an export adds: supercategory, and with ``points`` the points' names and, for 17, the skeleton.

    Without names 17 points have those of the body; names that don't fit the number are replaced by kp_0, kp_1 and so on.
    """
    from ..functions import keypoints as kp

    if not names and points == 17:
        names = kp.NAMES
    if names and len(names) != points:
        names = [f"kp_{k}" for k in range(points)]
    out = used.withColumn("supercategory", F.when(F.col("name") == "person", "person").otherwise("object"))
    if names:
        out = out.withColumn("keypoints", F.array(*[F.lit(n) for n in names]))
        if len(names) == 17:
            out = out.withColumn("skeleton", F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in skeleton or kp.EXPORTED_EDGES]))
    return out


def categories(boxes: DataFrame, names: list[str]) -> DataFrame:
    """Classes in use with ids from 1; a class without a name gets one from its number."""
    table = F.array(*[F.lit(n) for n in names])
    name = F.coalesce(F.get(table, F.col("class_id").cast("int")), F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    return boxes.select("class_id").distinct().select((F.col("class_id") + 1).alias("category_id"), name.alias("name"))


def prefix_counts(rows: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Counts for a fixed list of prefixes, in its order, zeros kept."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(i, p) for i, p in enumerate(prefixes)], "place int, prefix string")
    got = rows.groupBy(F.col(column).alias("prefix")).agg(F.count("*").alias("n"))
    return fixed.join(got, "prefix", "left").select("place", "prefix", F.coalesce("n", F.lit(0)).alias("n"))


def next_index(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """One more than the largest number that follows the prefix; 0 without any."""
    n = F.regexp_extract(F.col(column), rf"^{prefix}(\d+)", 1).try_cast("long")
    return names.agg(F.coalesce(F.max(n) + 1, F.lit(0)).alias("next_index"))


def until_enough(rows: DataFrame, order: list, success: str, wanted: int) -> DataFrame:
    """Rows in ``order`` up to that with which ``wanted`` successes (a 0/1 or boolean column, null: none) are reached; all, if there are fewer.

    The running sum is made range by range, so no task holds the table. ``successes`` counts those before a row.
    """
    if wanted < 0:
        raise ValueError("the wanted number must be at least 0")
    counted = ranks.with_sum_before(rows.withColumn("_one", F.col(success).cast("long")), order, "_one", "successes")
    return counted.where(F.col("successes") < wanted).drop("_one")


def ordered(rows: DataFrame, by: str = "name", name: str = "name") -> DataFrame:
    """Rows in one of the orders that tools walk in: ``name`` (by its bytes), ``lower`` (lower case, then its bytes), ``index`` (last number of the name's stem, then lower case; without one, left out)."""
    from ..functions import urls

    low = [F.lower(name), F.col(name)]
    if by == "index":
        return rows.withColumn("index", urls.last_number(urls.stem(F.col(name)))).where("index IS NOT NULL").orderBy("index", *low)
    if by not in ("name", "lower"):
        raise ValueError("by must be name, lower or index")
    return rows.orderBy(*(low if by == "lower" else [F.col(name)]))


# How many images a mosaic of each kind takes, and the kinds whose images are also kept as they are.
GROUP_SIZES = {"square_small": 9, "square_medium": 4, "square_large": 4, "portrait_2": 2, "landscape_2": 2, "portrait_6": 6, "landscape_6": 6, "rest": 4}
KEPT_KINDS = ("square_large", "portrait_6", "landscape_6", "rest")


def planned_outputs(images: DataFrame, kind: str = "kind") -> DataFrame:
    """Per kind, in order: images, mosaics (each group twice: straight and turned), images kept as they are, and outputs in all; zeros kept."""
    fixed = images.sparkSession.createDataFrame([(i, k, g, k in KEPT_KINDS) for i, (k, g) in enumerate(GROUP_SIZES.items())], "place int, kind string, _size int, _kept boolean")
    n = fixed.join(images.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("images")), "kind", "left").withColumn("images", F.coalesce("images", F.lit(0)))
    n = n.withColumns({"mosaics": F.ceil(F.col("images") / F.col("_size")) * 2, "kept": F.when(F.col("_kept"), F.col("images")).otherwise(0)})
    return n.select("place", "kind", "images", "mosaics", "kept", (F.col("mosaics") + F.col("kept")).alias("outputs"))


def people(detections: DataFrame, on: str = "image_id") -> DataFrame:
    """Detections of class 0 per image; a detection without a class counts as one. Images without any detection have no row."""
    return detections.groupBy(on).agg(F.count_if(F.coalesce(F.col("class_id"), F.lit(0)) == 0).alias("people"))

"""Scans of dataset folders: label files, image lists and headers, URL lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from . import opened

# File endings that count as images.
IMAGES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
IMAGES_BASIC = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
IMAGES_WIDE = (*IMAGES, "gif", "heic", "heif")
VIDEOS = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "mpg", "mpeg", "wmv")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The folders and files that a path or pattern names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return [f.getPath().toString() for f in found or ()]


def _list(deep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for folders in batches:
            for folder in folders["path"]:
                store, name = opened.at(folder)
                own = store.get_file_info(name)
                found = [own] if own.is_file else store.get_file_info(fs.FileSelector(name, recursive=deep))
                beside = folder[: len(folder) - len(name)] if folder.endswith(name) else ""
                for k in range(0, len(found), 10000):
                    part = [f for f in found[k : k + 10000] if not f.base_name.startswith((".", "_"))]
                    yield pd.DataFrame({"path": [beside + f.path for f in part], "bytes": [f.size or 0 for f in part], "folder": [not f.is_file for f in part]})

    return run


def _listing(spark: SparkSession, path: str, deep: bool) -> DataFrame:
    """path and bytes of all files, those of no bytes, too, which Spark's own readers pass over. Each folder below the named ones is a task's."""
    form = "path string, bytes long, folder boolean"
    roots = spark.createDataFrame([(p,) for p in _folders(spark, path)], "path string")
    top = roots.mapInPandas(_list(False), form)
    if not deep:
        return top.where("not folder").select("path", "bytes")
    below = top.where("folder").select("path").repartition("path").mapInPandas(_list(True), form)
    return top.unionByName(below).where("not folder").select("path", "bytes")


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """stem and raw text of each .txt file, the empty ones, too; line order is kept inside raw."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    # The address is written with percent signs.
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    empty = _listing(spark, path, False).where((F.col("bytes") == 0) & F.col("path").endswith(".txt"))
    return files.select(urls.stem(address).alias("stem"), F.col("value").alias("raw")).unionByName(empty.select(urls.stem(F.col("path")).alias("stem"), F.lit("").alias("raw")))


def listed(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGES) -> DataFrame:
    """stem, ending, path and bytes of files with one of the endings; contents aren't read."""
    files = _listing(spark, path, True)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(urls.stem(F.col("path")).alias("stem"), ending.alias("ending"), "path", "bytes").where(F.col("ending").isin(*endings))


def dataset_tree(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGES_WIDE) -> DataFrame:
    """Images under ``<dataset>/images/``: adds the dataset's name."""
    return listed(spark, path, endings).withColumn("dataset", F.regexp_extract("path", r"/([^/]+)/images/", 1)).where("dataset <> ''")


def datasets(spark: SparkSession, path: str, leave: str | None = None, endings: tuple[str, ...] = IMAGES_WIDE) -> tuple[DataFrame, DataFrame]:
    """Images and label files (dataset, stem, path) of the folders in ``path`` that have both images/ and labels/, but for the one named ``leave``."""
    files = _listing(spark, path, True)
    at = files.select("path", "bytes", F.regexp_extract("path", r"([^/]+)/(images|labels)/[^/]+$", 1).alias("dataset"), F.regexp_extract("path", r"([^/]+)/(images|labels)/[^/]+$", 2).alias("side"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ending"))
    at = at.where((F.col("dataset") != "") & (F.col("dataset") != F.lit(leave or "")))
    whole = at.groupBy("dataset").agg(F.count_distinct("side").alias("_n")).where("_n = 2").select("dataset")
    named = at.join(whole, "dataset", "left_semi").select("dataset", urls.stem(F.col("path")).alias("stem"), "path", "side", "ending")
    return named.where((F.col("side") == "images") & F.col("ending").isin(*endings)).drop("side", "ending"), named.where("side = 'labels' AND ending = 'txt'").drop("side", "ending")


def split_tree(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGES) -> tuple[DataFrame, DataFrame]:
    """Images and label files (split, stem, path) below images/<split>/ and labels/<split>/; a split that one side lacks is on the other alone."""
    files = _listing(spark, path, True)
    parts = files.select("path", F.regexp_extract("path", r"/(images|labels)/([^/]+)/[^/]+$", 1).alias("side"), F.regexp_extract("path", r"/(images|labels)/([^/]+)/[^/]+$", 2).alias("split"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ending"))
    side = lambda name, ends: parts.where((F.col("side") == name) & F.col("ending").isin(*ends)).select("split", urls.stem(F.col("path")).alias("stem"), "path")
    return side("images", endings), side("labels", ("txt",))


def frames(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGES) -> DataFrame:
    """stem, path and frame_index (the last number of the name) of images whose names have a number."""
    return listed(spark, path, endings).select("stem", "path", urls.last_number(F.col("stem")).alias("frame_index")).where("frame_index IS NOT NULL")


def videos(spark: SparkSession, path: str) -> DataFrame:
    """stem, ending, path and bytes of videos."""
    return listed(spark, path, VIDEOS)


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        got = []
        for path in files["path"]:
            store, name = opened.at(path)
            with store.open_input_file(name) as f:
                got.append(opened.image_size(f) or (None, None))
        yield files.assign(width=pd.array([w for w, _ in got], "Int32"), height=pd.array([h for _, h in got], "Int32"))


def images(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGES) -> DataFrame:
    """stem, path, width and height; files without a readable head have null sizes. Only heads are read."""
    return listed(spark, path, endings).select("stem", "path").mapInPandas(_sizes, "stem string, path string, width int, height int")


def any_images(spark: SparkSession, path: str) -> DataFrame:
    """All files, whatever their endings: stem, path, width, height and ``image``, false for those whose head is no picture's."""
    every = _listing(spark, path, True).select(urls.stem(F.col("path")).alias("stem"), "path")
    return every.mapInPandas(_sizes, "stem string, path string, width int, height int").withColumn("image", F.col("width").isNotNull())


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a URL list; blank lines and those that begin with # aren't URLs."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


#: Lines of a data set's description, at most.
CONFIG_LINES = 10_000


def dataset_config(spark: SparkSession, path: str) -> dict:
    """Keypoint shape, class names and keypoint names of a dataset description: one small YAML file. More than ``CONFIG_LINES`` lines raise ValueError."""
    import yaml

    lines = spark.read.text(path, wholetext=False).limit(CONFIG_LINES + 1).collect()
    if len(lines) > CONFIG_LINES:
        raise ValueError(f"{path} isn't one small file")
    got = yaml.safe_load("\n".join(r["value"] for r in lines)) or {}
    names = got.get("names") or []
    names = [names[k] for k in sorted(names)] if isinstance(names, dict) else list(names)
    points = got.get("kpt_names") or {}
    points = list(points.get(0, [])) if isinstance(points, dict) else list(points)
    return {"kpt_shape": got.get("kpt_shape"), "names": names, "kpt_names": points, "flip_idx": got.get("flip_idx")}

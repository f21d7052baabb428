"""Streams: addresses seen once, and frames that differ from the one before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_addresses(stream: DataFrame, column: str = "url", watermark: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each address once, over all runs that share a checkpoint. With an event-time column the state is bounded."""
    if watermark:
        return stream.withWatermark(watermark, delay).dropDuplicatesWithinWatermark([column])
    return stream.dropDuplicates([column])


def unseen(batch: DataFrame, seen: DataFrame, column: str = "url") -> DataFrame:
    """The same for a batch: addresses that no earlier run has written."""
    return batch.join(seen.select(column), column, "left_anti").dropDuplicates([column])


def changed_frames(stream: DataFrame, most: float) -> DataFrame:
    """Frames (seq_id, frame_index, feat) with ``duplicate``: whether the feature is within ``most`` of
    the frame before. State is one number per sequence; frames of a trigger are taken in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame_index")
        last = state.get[0] if state.exists else None
        out = []
        for index, feat in zip(rows["frame_index"], rows["feat"], strict=True):
            readable = feat is not None and feat == feat
            out.append((key[0], index, feat, bool(readable and last is not None and abs(feat - last) <= most)))
            last = feat if readable else last
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame(out, columns=["seq_id", "frame_index", "feat", "duplicate"])

    rows = stream.select(F.col("seq_id").cast("long"), F.col("frame_index").cast("long"), F.col("feat").cast("double"))
    return rows.groupBy("seq_id").applyInPandasWithState(run, "seq_id long, frame_index long, feat double, duplicate boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def seen_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses that :func:`note_new` has written to ``folder``, once each; none if there is no such folder yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "url string")
    return spark.read.schema("url string, batch long").parquet(folder).select("url").distinct()


def note_new(batch: DataFrame, folder: str, number: int, column: str = "url") -> DataFrame:
    """Append the addresses of a batch that no other batch has noted to ``folder`` (one subfolder a batch) and return them.

    A batch that is written again, with the same number, replaces what it wrote, so its addresses are noted once. For a stream:
    ``writeStream.foreachBatch(lambda batch, number: note_new(batch, folder, number))``. Null addresses aren't noted.
    """
    spark = batch.sparkSession
    before = seen_addresses(spark, folder)
    if before.columns and (known := _batches(spark, folder)):
        others = [f"{folder.rstrip('/')}/batch={n}" for n in known if n != number]
        before = spark.read.schema("url string").parquet(*others).distinct() if others else spark.createDataFrame([], "url string")
    new = batch.where(F.col(column).isNotNull()).select(F.col(column).alias("url")).distinct().join(before, "url", "left_anti")
    path = f"{folder.rstrip('/')}/batch={number}"
    new.write.mode("overwrite").parquet(path)
    return spark.read.schema("url string").parquet(path)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that have been written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/batch=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found or ()]

"""Running numbers over a whole table, or within groups of any size, without one task that holds them.

Rows are dealt into ranges of the order and sorted there; a range's row count is one row, and the sum over the
ranges before it is what its own numbers begin with. The sorted rows are checkpointed in the folder that all machines
share, so that counts and numbers see the same ranges even if an executor is lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Used only when the session has no checkpoint folder and Spark runs on one machine.
LOCAL_FOLDER = "/tmp/checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as written to ``spark.checkpoint.dir``. Raises on a cluster that names no such folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or LOCAL_FOLDER)
    return df.checkpoint()


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """Add the running number in ``order`` (long).

    Rows that tie stand in the order of their hash, so many of them still go to many ranges, and reruns agree;
    equal rows may take each other's place. Nulls come first. An empty table stays empty. Map columns have no hash
    and don't count in ties. Columns named ``_range``, ``_nth`` and ``_before`` are replaced.
    """
    return _placed(rows, order, name, start).drop("_range")


def _placed(rows: DataFrame, order: Sequence[str | Column], name: str, start: int) -> DataFrame:
    """Like :func:`numbered`, with ``_range``, the number of the range that a row lies in."""
    hashed = [f"`{f.name}`" for f in rows.schema if f.dataType.typeName() not in ("map", "variant")]
    keys = [*order, F.xxhash64(*hashed)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The lower 33 bits of this function number the rows of a partition.
    dealt = checkpointed(dealt.withColumns({"_range": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_before"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_before").over(earlier), F.lit(0)).alias("_before"))
    # One row per range.
    out = dealt.join(F.broadcast(before), "_range")
    return out.withColumn(name, F.col("_before") + F.col("_nth") + start).drop("_nth", "_before")


def numbered_within(rows: DataFrame, group: str, order: Sequence[str | Column], name: str, start: int = 1, size: str | None = None) -> DataFrame:
    """Like :func:`numbered`, beginning anew in each group; ``size`` names a column for the group's row count.

    A group may hold most rows: it lies in many ranges, and its first number and count are brought to each part of it by range and group, so
    no task gets the whole group. A null group is a group of its own.
    """
    every = _placed(rows, [group, *order], "_place", 0)
    parts = every.groupBy(F.col("_range").alias("_part"), F.col(group).alias("_group")).agg(F.min("_place").alias("_low"), F.count("*").alias("_rows"))
    whole = parts.groupBy(F.col("_group").alias("_of")).agg(F.min("_low").alias("_first"), F.sum("_rows").alias("_size"))
    known = parts.select("_part", "_group").join(whole, F.col("_group").eqNullSafe(F.col("_of"))).drop("_of")
    out = every.join(known, (F.col("_range") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_place") - F.col("_first") + start)
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_place", "_range", "_part", "_group", "_first", "_size")


def with_sum_before(rows: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` (null: 0) over all rows that come before in ``order``; see :func:`numbered`. No task holds the table."""
    placed = numbered(rows, order, "_place", 0)
    # Ranges anew, from the numbers: rows of a range are few, and their order is settled.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(placed.repartitionByRange(n, "_place").withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per range.
    return dealt.withColumn("_inside", inside).join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.col("_inside")).drop("_range", "_place", "_base", "_inside")

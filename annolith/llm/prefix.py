"""Ranks and running sums over a whole table without one task that holds it.

Rows are dealt into chunks. A chunk's sum is one row, so the sums of all chunks are few; the
exclusive running sum over these gives each chunk its base, and a window inside the chunk does
the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage


def bases(df: DataFrame, group: Sequence[str], chunk: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Per group and chunk: for each value, the sum over the group's earlier chunks."""
    sums = df.groupBy(*group, *chunk).agg(*[F.sum(v).alias(k) for k, v in values.items()])
    w = Window.partitionBy(*group).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, *chunk, *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in values])


def running(df: DataFrame, group: Sequence[str], chunk: Sequence[str], order: Sequence, values: dict[str, Column]) -> DataFrame:
    """Add, for each value, its sum over the rows of the group that come before.

    The order is by chunk, then by ``order``. Group and chunk columns must not be null. Rows that
    tie on everything may take each other's place, so they should be equal rows.
    """
    keys = [*group, *chunk]
    base = bases(df, group, chunk, values)
    base = base.select(*keys, *[F.col(k).alias(f"_base_{k}") for k in values])
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumns({f"_in_{k}": F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in values.items()})
    out = inside.join(base, keys)
    return out.withColumns({k: F.col(f"_base_{k}") + F.col(f"_in_{k}") for k in values}).drop(*[f"_{p}_{k}" for p in ("in", "base") for k in values])


def in_order(df: DataFrame, order: Sequence[Column], tag: str, chunk: str = "_chunk") -> DataFrame:
    """Deal the rows into ranges of ``order`` and note the range; the table is written, so it stays as dealt."""
    n = storage.partitions(df.sparkSession)
    return storage.materialize(df.repartitionByRange(n, *order).withColumn(chunk, F.spark_partition_id()), tag)


def bucket(column: Column, cuts: Sequence[float]) -> Column:
    """Number of cuts that are at most the value, by binary search; 0 for null."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(float(c)) for c in cuts])
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.get(table, at + s - 1) <= column, at + s).otherwise(at),
    )
    return F.when(column.isNull(), F.lit(0)).otherwise(found)

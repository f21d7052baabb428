"""Masks as run lengths: struct<width, height, runs>, pixels outside and inside in turn, outside first.

Runs go row by row, or column by column (``down``). Pixels after the last run are outside. No function here makes a row of a pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def extent(width: Column, height: Column, runs: Column, down: bool = False) -> Column:
    """struct<left, top, right, bottom>: first and last column and row with a pixel of the mask; null without one, or without a size.

    One fold over the runs: an inner run that ends in a later row than it begins reaches from edge to edge.
    """
    line = (height if down else width).cast("long")
    line = F.when(line > 0, line)
    acc = lambda at, inside, lo, hi, first, last: F.struct(at.alias("at"), inside.alias("inside"), lo.alias("lo"), hi.alias("hi"), first.alias("first"), last.alias("last"))
    none = F.lit(None).cast("long")

    def step(a: Column, run: Column) -> Column:
        n = run.cast("long")
        end = a["at"] + n - 1
        begin_line, end_line = F.floor(a["at"] / line), F.floor(end / line)
        one = begin_line == end_line
        lo, hi = F.when(one, a["at"] % line).otherwise(0), F.when(one, end % line).otherwise(line - 1)
        counts = a["inside"] & (n > 0)
        take = lambda f, name, value: F.when(counts, f(F.coalesce(a[name], value), value)).otherwise(a[name])
        return acc(a["at"] + n, ~a["inside"], take(F.least, "lo", lo), take(F.greatest, "hi", hi), take(F.least, "first", begin_line), take(F.greatest, "last", end_line))

    def finish(a: Column) -> Column:
        across, along = (a["first"], a["last"]), (a["lo"], a["hi"])
        (left, right), (top, bottom) = (across, along) if down else (along, across)
        return F.when((width > 0) & (height > 0) & a["lo"].isNotNull(), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))

    return F.aggregate(runs, acc(F.lit(0).cast("long"), F.lit(False), none, none, none, none), step, finish)


def area(runs: Column) -> Column:
    """Pixels inside."""
    return F.aggregate(F.filter(runs, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, n: a + n)


def box(width: Column, height: Column, found: Column) -> list[Column]:
    """cx, cy, w and h, as shares, of an extent: its last column and row are part of it."""
    w, h = width.cast("double"), height.cast("double")
    return [
        ((found["left"] + found["right"] + 1) / (2 * w)).alias("cx"), ((found["top"] + found["bottom"] + 1) / (2 * h)).alias("cy"),
        ((found["right"] - found["left"] + 1) / w).alias("w"), ((found["bottom"] - found["top"] + 1) / h).alias("h"),
    ]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def runs_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Runs, row by row, of masks as bytes (one a pixel) that are inside above a threshold (as a share of 255)."""
    for pixels, threshold in batches:
        out = []
        for p, t in zip(pixels, threshold, strict=True):
            if p is None:
                out.append(None)
                continue
            inside = np.frombuffer(p, np.uint8) > t * 255
            ends = np.flatnonzero(np.diff(inside)) + 1
            runs = np.diff(np.concatenate([[0], ends, [len(inside)]])) if len(inside) else np.zeros(0, int)
            out.append(([0, *runs.tolist()] if len(inside) and inside[0] else runs.tolist()))
        yield pd.Series(out)

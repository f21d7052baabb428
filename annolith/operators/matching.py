"""Match objects of one image with objects of another source.

All joins are on image_id, so candidates are bounded by what one image holds. Sequential rules
(each partner used once, in the order of the base rows) are folds over arrays in the JVM.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOLD = """aggregate(base, cast(array() as array<struct<pos:int,idx:int,score:double>>), (acc, b) ->
  concat(acc, transform(slice(array_sort(transform(
    filter(other, f -> NOT exists(acc, u -> u.idx = f.idx) AND ({fits})),
    f -> named_struct('key', {key}, 'idx', f.idx))), 1, 1),
  m -> named_struct('pos', b.pos, 'idx', m.idx, 'score', {score}))))"""


def _fold(pairs: DataFrame, fits: str, key: str, score: str) -> DataFrame:
    done = pairs.select("image_id", F.explode(F.expr(_FOLD.format(fits=fits, key=key, score=score))).alias("m"))
    return done.select("image_id", F.col("m.pos").alias("base_idx"), F.col("m.idx").alias("other_idx"), F.col("m.score").alias("score"))


def _lists(base: DataFrame, other: DataFrame, base_cols: list[str], other_cols: list[str]) -> DataFrame:
    a = base.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("obj_idx").cast("int").alias("pos"), *base_cols))).alias("base"))
    b = other.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("obj_idx").cast("int").alias("idx"), *other_cols))).alias("other"))
    return a.join(b, "image_id")


def with_unmatched(base: DataFrame, matches: DataFrame) -> DataFrame:
    """Every base row with its partner; those without one, or whose image has none at all, with null."""
    keys = base.select("image_id", F.col("obj_idx").cast("int").alias("base_idx"))
    return keys.join(matches, ["image_id", "base_idx"], "left")


def match_summary(base: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows, matched rows and the matches' mean score."""
    return with_unmatched(base, matches).agg(F.count("*").alias("base_rows"), F.count("other_idx").alias("matched"), F.avg("score").alias("mean_score"))


def nearest_once(base: DataFrame, other: DataFrame, most: float | None = None) -> DataFrame:
    """Each base row (image_id, obj_idx, x, y), in order, takes the nearest partner that is left; ties to the lower index."""
    d = "sqrt((b.x - f.x) * (b.x - f.x) + (b.y - f.y) * (b.y - f.y))"
    fits = "true" if most is None else f"{d} <= {float(most)}D"
    return _fold(_lists(base, other, ["x", "y"], ["x", "y"]), f"b.x IS NOT NULL AND f.x IS NOT NULL AND {fits}", d, "m.key")


def overlap_once(base: DataFrame, other: DataFrame, least_iou: float = 0.2, most: float = 0.05, iou_only: bool = False) -> DataFrame:
    """Each base row (corner box x1, y1, x2, y2), in order, takes the partner that is left with the largest
    IoU if that is at least ``least_iou``, else the one with the nearest centre within ``most``."""
    inter = "greatest(0D, least(b.x2, f.x2) - greatest(b.x1, f.x1)) * greatest(0D, least(b.y2, f.y2) - greatest(b.y1, f.y1))"
    iou = f"coalesce(try_divide({inter}, (b.x2 - b.x1) * (b.y2 - b.y1) + (f.x2 - f.x1) * (f.y2 - f.y1) - {inter}), 0D)"
    d = "sqrt(pow((b.x1 + b.x2) / 2 - (f.x1 + f.x2) / 2, 2) + pow((b.y1 + b.y2) / 2 - (f.y1 + f.y2) / 2, 2))"
    # Those that overlap enough come first, by IoU; the others follow by distance.
    key = f"named_struct('far', {iou} < {float(least_iou)}D, 'by', CASE WHEN {iou} >= {float(least_iou)}D THEN -{iou} ELSE {d} END)"
    fits = f"b.x1 IS NOT NULL AND f.x1 IS NOT NULL AND ({iou} >= {float(least_iou)}D" + (")" if iou_only else f" OR {d} <= {float(most)}D)")
    return _fold(_lists(base, other, ["x1", "y1", "x2", "y2"], ["x1", "y1", "x2", "y2"]), fits, key, "m.key.by")


def inside_once(base: DataFrame, other: DataFrame, least: float = 0.5) -> DataFrame:
    """Each base box (corners), in order, takes the partner (``kpts``) that is left with the largest share of
    valid points inside, then the larger number; a share of 0 never matches."""
    seen = "filter(f.kpts, k -> k.v > 0 AND NOT (k.x = 0 AND k.y = 0))"
    hit = f"size(filter({seen}, k -> k.x >= b.x1 AND k.x <= b.x2 AND k.y >= b.y1 AND k.y <= b.y2))"
    ratio = f"coalesce(try_divide({hit}, size({seen})), 0D)"
    return _fold(_lists(base, other, ["x1", "y1", "x2", "y2"], ["kpts"]), f"{ratio} > 0 AND {ratio} >= {float(least)}D", f"named_struct('r', -{ratio}, 'n', -{hit})", "-m.key.r")


def best_face(base: DataFrame, other: DataFrame, least_iou: float = 0.45, most: float = 0.05, apart: bool = False) -> DataFrame:
    """For each base row the partner with the largest IoU above ``least_iou``, else the nearest face centre
    closer than ``most``. A partner may serve several rows. Rows have corner boxes and face means fx, fy.
    With ``apart`` a row isn't its own partner: for tables joined with themselves."""
    from ..functions import geometry as g

    a, b = base.alias("a"), other.alias("b")
    box = lambda p: tuple(F.col(f"{p}.{c}") for c in ("x1", "y1", "x2", "y2"))
    both = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.obj_idx") != F.col("b.obj_idx") if apart else F.lit(True)))
    both = both.select("a.image_id", F.col("a.obj_idx").alias("base_idx"), F.col("b.obj_idx").alias("other_idx"), g.iou(box("a"), box("b")).alias("iou"), g.distance(F.col("a.fx"), F.col("a.fy"), F.col("b.fx"), F.col("b.fy")).alias("dist"))
    near = F.col("dist") < most
    best = both.groupBy("image_id", "base_idx").agg(
        F.max("iou").alias("best_iou"),
        F.max_by("other_idx", F.struct("iou", (-F.col("other_idx")).alias("i"))).alias("by_iou"),
        F.min_by("other_idx", F.when(near, F.struct("dist", "other_idx"))).alias("by_dist"),
    )
    pick = F.when(F.col("best_iou") > least_iou, F.col("by_iou")).otherwise(F.col("by_dist"))
    return best.select("image_id", "base_idx", pick.alias("other_idx"), F.when(F.col("best_iou") > least_iou, "iou").otherwise("distance").alias("rule")).where("other_idx is not null")


def suppress(boxes: DataFrame) -> DataFrame:
    """Boxes that stay when, by falling score in a class, each that overlaps one that stayed goes."""
    keep = """aggregate(items, slice(items, 1, 0), (acc, b) -> IF(exists(acc, k ->
        least(k.x2, b.x2) > greatest(k.x1, b.x1) AND least(k.y2, b.y2) > greatest(k.y1, b.y1)
        AND (k.x2 - k.x1) * (k.y2 - k.y1) > 0 AND (b.x2 - b.x1) * (b.y2 - b.y1) > 0), acc, concat(acc, array(b))))"""
    item = F.struct((-F.col("score")).alias("minus"), F.col("obj_idx"), *["x1", "y1", "x2", "y2"])
    lists = boxes.groupBy("image_id", "class_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return lists.select("image_id", "class_id", F.explode(F.expr(keep)).alias("b")).select("image_id", "class_id", F.col("b.obj_idx").alias("obj_idx"), (-F.col("b.minus")).alias("score"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each row and column once (successive shortest paths)."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in assignment(cost.T)]
    row_pot, col_pot = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        dist, via, seen = cost[i] - row_pot[i] - col_pot, np.full(m, -1), np.zeros(m, bool)
        while True:
            open_ = np.where(seen, np.inf, dist)
            j = int(np.argmin(open_))
            least = open_[j]
            seen[j] = True
            if owner[j] < 0:
                break
            k = owner[j]
            other = least + cost[k] - row_pot[k] - col_pot
            other = np.where(seen, np.inf, other)
            closer = other < dist
            dist, via = np.where(closer & ~seen, other, dist), np.where(closer & ~seen, j, via)
        done = seen & (owner >= 0)
        row_pot[owner[done]] += least - dist[done]
        row_pot[i] += least
        col_pot[seen] -= least - dist[seen]
        while True:
            p = via[j]
            owner[j] = owner[p] if p >= 0 else i
            if p < 0:
                break
            j = p
    return [(int(owner[j]), j) for j in np.flatnonzero(owner >= 0)]


def assign(costs: DataFrame, dummy: float = 0.65, most: float = 0.55) -> DataFrame:
    """Optimal pairs per image from (image_id, a_idx, b_idx, cost). Staying alone costs ``dummy``; pairs over ``most`` are dropped."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        a, b = np.unique(batch["a_idx"]), np.unique(batch["b_idx"])
        table = np.full((len(a), len(b) + len(a)), dummy)
        table[np.searchsorted(a, batch["a_idx"]), np.searchsorted(b, batch["b_idx"])] = batch["cost"]
        rows = [(batch["image_id"].iloc[0], int(a[i]), int(b[j]), float(table[i, j])) for i, j in assignment(table) if j < len(b) and table[i, j] <= most]
        return pd.DataFrame(rows, columns=["image_id", "a_idx", "b_idx", "cost"])

    return costs.select("image_id", "a_idx", "b_idx", "cost").groupBy("image_id").applyInPandas(run, "image_id long, a_idx long, b_idx long, cost double")



"""Masks, mosaic labels and merged runs, by brute force and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.functions import masks as mk
from annolith.operators import export
from annolith.operators import mosaics as mo

MASK = "image_id long, obj_idx int, class_id int, score double, width int, height int, runs array<int>"
POSE = "image_id long, obj_idx int, class_id int, cx double, cy double, w double, h double, kpts array<struct<x: double, y: double, v: double>>"


@pytest.mark.parametrize("down", [False, True])
def test_boxes_of_masks(spark, down):
    rng = np.random.default_rng(int(down))
    rows, want = [], {}
    for i in range(300):
        w, h = (int(x) for x in rng.integers(1, 9, 2))
        runs, left = [], w * h
        while left > 0 and rng.random() < 0.9:
            runs.append(int(min(left, rng.choice([0, 1, 2, w, 2 * w, 11]))))
            left -= runs[-1]
        flat = np.zeros(w * h, bool)
        at = 0
        for k, n in enumerate(runs):
            flat[at : at + n] = k % 2 == 1
            at += n
        m = flat.reshape(w, h).T if down else flat.reshape(h, w)
        rows.append((i, 0, None if i % 3 else 2, None if i % 2 else 0.5, w, h, runs))
        ys, xs = m.nonzero()
        if len(xs):
            want[i] = ((xs.min() + xs.max() + 1) / 2 / w, (ys.min() + ys.max() + 1) / 2 / h, (xs.max() - xs.min() + 1) / w, (ys.max() - ys.min() + 1) / h, 0 if i % 3 else 2, 1.0 if i % 2 else 0.5)
    rows += [(900, 0, 1, 1.0, 4, 4, None), (901, 0, 1, 1.0, 4, 4, []), (902, 0, 1, 1.0, None, 4, [1, 2])]
    df = spark.createDataFrame(rows, MASK)
    got = {r.image_id: (r.cx, r.cy, r.w, r.h, r.class_id, r.score) for r in mo.boxes_of_masks(df, down).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    areas = {r.image_id: r.n for r in df.select("image_id", mk.area(F.col("runs")).alias("n")).collect()}
    assert all(areas[r[0]] == sum(r[6][1::2]) for r in rows[:300])


def test_a_mask_of_many_pixels(spark):
    """Four thousand million pixels are three runs."""
    df = spark.createDataFrame([(1, 0, 0, 1.0, 65536, 65536, [65536 * 1000 + 7, 2, 65536 * 2000 - 2, 1])], MASK)
    r = mo.boxes_of_masks(df).first()
    assert (r.cx, r.w) == ((7 + 8 + 1) / 2 / 65536, 2 / 65536) and (r.cy, r.h) == ((1000 + 3000 + 1) / 2 / 65536, 2001 / 65536)


def test_runs_of_pixels(spark):
    given = [bytes([0, 200, 200, 0]), bytes([255, 0]), bytes([0, 0]), b"", None, bytes([128, 127])]
    df = spark.createDataFrame(list(enumerate(given)), "i int, p binary")
    got = [r.r for r in df.select("i", mk.runs_of("p", F.lit(0.5)).alias("r")).orderBy("i").collect()]
    assert got == [[1, 2, 1], [0, 1, 1], [2], [], None, [0, 1, 1]]


def test_tiles_end_with_the_first_without_a_label(spark):
    """A small box falls under the limit on the first small tile, so later tiles are left out though they'd hold it."""
    images = spark.createDataFrame([(1, 400, 400), (2, 400, 400), (3, 0, 5)], "image_id long, width int, height int")
    whole, tiny = (0.5, 0.5, 1.0, 1.0), (0.1, 0.1, 0.05, 0.05)
    k = [(0.25, 0.5, 2.0)] + [(0.0, 0.0, 0.0)] * 15 + [(0.0, 0.0, 1.0)]
    poses = spark.createDataFrame([(1, 0, 0, *whole, k), (1, 1, 1, *tiny, k[:1]), (2, 0, 0, *tiny, []), (3, 0, 0, *whole, []), (4, 0, 0, *whole, [])], POSE)
    rows = mo.self_mosaic_labels(poses, images, 0.5, least_side=15.0).collect()
    steps = {i: sorted({r.step for r in rows if r.image_id == i}) for i in (1, 2, 3, 4)}
    assert steps[1] == [0, 1, 2] and steps[2] == [0] and not steps[3] and not steps[4]
    own = {r.obj_idx: r for r in rows if (r.image_id, r.step) == (1, 0)}
    assert own[0].w == pytest.approx(400 / 600) and own[0].kpts[0].x == pytest.approx(100 / 600)
    mirrored = [r for r in rows if (r.image_id, r.step, r.obj_idx) == (1, 2, 0)][0]
    # Names change sides: the last point is the right ankle's, which was the left one's.
    assert mirrored.kpts[15].v == 1.0 and mirrored.kpts[16].v == 0.0 and mirrored.kpts[0].v == 2.0
    for wrong in ({"factor": 0}, {"most": 0}):
        with pytest.raises(ValueError):
            mo.self_mosaic_labels(poses, images, **wrong)


def test_grid_of_turned_images(spark):
    slots = spark.createDataFrame([(9, 0, 1, 100, 50, 0), (9, 1, 1, 100, 50, 90), (9, 2, 2, 40, 40, 180)], "mosaic_id long, slot int, image_id long, width int, height int, rotation int")
    poses = spark.createDataFrame([(1, 0, 0, 0.25, 0.5, 0.1, 0.2, [(0.25, 0.5, 2.0), (0.5, 0.5, 0.0)]), (2, 0, 1, 0.25, 0.25, 0.1, 0.1, []), (2, 1, 1, 0.0, 0.0, -0.1, 0.1, [])], POSE)
    got = {(r.slot, r.obj_idx): r for r in mo.grid_labels(poses, slots, 2).collect()}
    # Tiles of 100 x 100, two rows of two.
    # The box with a negative side is empty on a straight tile; turned, its corners change places.
    assert set(got) == {(0, 0), (1, 0), (2, 0), (2, 1)} and {(r.mosaic_w, r.mosaic_h) for r in got.values()} == {(200, 200)}
    assert (got[0, 0].cx, got[0, 0].cy, got[0, 0].w, got[0, 0].h) == pytest.approx((25 / 200, 50 / 200, 10 / 200, 10 / 200))
    assert (got[1, 0].cx, got[1, 0].cy) == pytest.approx((150 / 200, 25 / 200)) and tuple(got[1, 0].kpts[0]) == pytest.approx((0.75, 0.125, 2.0)) and tuple(got[1, 0].kpts[1]) == (0, 0, 0)
    assert (got[2, 0].cx, got[2, 0].cy) == pytest.approx((75 / 200, 175 / 200))


def test_merged_points(spark):
    n = spark.createDataFrame([(1, 0, 0, 0.2, 0.2, 0.1, 0.1, [(0.2, 0.2, 0.5), (0.4, 0.4, 0.0), (0.6, 0.6, None)]), (1, 1, 0, 0.9, 0.9, 0.1, 0.1, None), (2, 0, 3, 0.5, 0.5, 0.1, 0.1, [(0.1, 0.1, None)])], POSE).withColumn("score", F.when(F.col("obj_idx") == 0, 0.0).otherwise(0.6))
    f = spark.createDataFrame([(1, 0, 0, 0.4, 0.4, 0.1, 0.1, [(0.3, 0.3, 1.5), (0.8, 0.8, 0.0)]), (1, 1, 0, 0.5, 0.9, 0.1, 0.1, [(0.7, 0.7, 1.0)]), (1, 2, 5, 0.1, 0.1, 0.1, 0.1, [])], POSE).withColumn("score", F.when(F.col("obj_idx") == 0, 0.0).otherwise(F.lit(None)))
    pairs = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "image_id long, a_idx int, b_idx int")
    got = sorted(((r.image_id, round(r.cx, 6), r.score, [tuple(round(x, 6) for x in p) for p in r.kpts]) for r in export.flip_merge(n, f, pairs).collect()), key=str)
    assert got == [(1, 0.0, 0.0, [(0.275, 0.275, 1.5), (0.0, 0.0, 0.0), (0.6, 0.6, 1.0)]), (1, 0.1, 1.0, []), (1, 0.65, 1.0, [(0.7, 0.7, 1.0)]), (2, 0.5, 0.0, [(0.1, 0.1, 1.0)])]

"""Keypoints: arrays of struct<x, y, v>; a point's position in the array is its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, mirror partners (MIRROR) and edges (EDGES) of the 17-point body, and the joints (JOINTS) that the
# 16-point body shares with it (16-point index, 17-point index).
NAMES = [
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist",
    "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
]
MIRROR = [0, 2, 1, 4, 3, 6, 5, 8, 7, 10, 9, 12, 11, 14, 13, 16, 15]
EDGES = [(0, 1), (0, 2), (1, 3), (2, 4), (5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16)]
# The same body's edges as an export states them, counted from 1.
EXPORTED_EDGES = [(16, 14), (14, 12), (17, 15), (15, 13), (12, 13), (6, 12), (7, 13), (6, 7), (6, 8), (7, 9), (8, 10), (9, 11), (2, 3), (1, 2), (1, 3)]
JOINTS = [(0, 16), (1, 14), (2, 12), (3, 11), (4, 13), (5, 15), (10, 10), (11, 8), (12, 6), (13, 5), (14, 7), (15, 9)]


def point(x, y, v) -> Column:
    c = lambda k: (k if isinstance(k, Column) else F.lit(float(k))).cast("double")
    return F.struct(c(x).alias("x"), c(y).alias("y"), c(v).alias("v"))


ZERO = lambda: point(0.0, 0.0, 0.0)


def valid(p: Column) -> Column:
    """Seen, and not at the origin."""
    return (p["v"] > 0) & ~((p["x"] == 0) & (p["y"] == 0))


def binarize(p: Column, threshold: float = 0.4) -> Column:
    """Visibility from a confidence: 2 or 0 by the threshold; a point that isn't seen is zeroed."""
    v = F.when((p["v"] >= 0) & (p["v"] <= 1), F.when(p["v"] >= threshold, 2).otherwise(0)).otherwise(p["v"].cast("int"))
    v = F.greatest(v, F.lit(0))
    return F.when(v == 0, ZERO()).otherwise(point(p["x"], p["y"], v))


def exported_visibility(v: Column, threshold: float = 0.5) -> Column:
    """0, 1 or 2 for export: what isn't finite or positive is 0, a confidence is 2 or 0."""
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    out = F.when(~finite | (v <= 0), 0).when(v <= 1, F.when(v >= threshold, 2).otherwise(0)).otherwise(F.least(F.lit(2), F.greatest(F.lit(0), F.rint(v).cast("int"))))
    return F.coalesce(out, F.lit(0))


def from_confidence(x: Column, y: Column, confidence: Column, threshold: float) -> Column:
    """A point with 2 where the confidence suffices (absent: 1), else zeros."""
    return F.when(F.coalesce(confidence, F.lit(1.0)) >= threshold, point(x, y, 2)).otherwise(ZERO())


def pad(kpts: Column, count: int) -> Column:
    return F.slice(F.concat(kpts, F.array_repeat(ZERO(), count)), 1, count)


def face(kpts: Column) -> Column:
    return F.slice(kpts, 1, 5)


def face_envelope(kpts: Column) -> Column:
    """Corner box of the valid face points; null if it has no width or height."""
    seen = F.filter(face(kpts), valid)
    side = lambda f, name: f(F.transform(seen, lambda p: p[name]))
    box = F.struct(side(F.array_min, "x").alias("x1"), side(F.array_min, "y").alias("y1"), side(F.array_max, "x").alias("x2"), side(F.array_max, "y").alias("y2"))
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)


def face_middle(kpts: Column) -> Column:
    """Middle of the span of the valid face points; null without one."""
    seen = F.filter(face(kpts), valid)
    mid = lambda name: (F.array_min(F.transform(seen, lambda p: p[name])) + F.array_max(F.transform(seen, lambda p: p[name]))) / 2
    return F.when(F.size(seen) > 0, F.struct(mid("x").alias("x"), mid("y").alias("y")))


def face_mean(kpts: Column) -> Column:
    """Mean of the face points with v > 0; null without one."""
    seen = F.filter(face(kpts), lambda p: p["v"] > 0)
    total = lambda name: F.aggregate(seen, F.lit(0.0), lambda a, p: a + p[name])
    return F.when(F.size(seen) > 0, F.struct((total("x") / F.size(seen)).alias("x"), (total("y") / F.size(seen)).alias("y")))


def blend_face(kpts: Column, other: Column, weight: float) -> Column:
    """Face points of another source first: invalid there, zero; valid in both, a weighted mean with the other's v."""

    def merge(a: Column, b: Column) -> Column:
        both = point(a["x"] * (1 - weight) + b["x"] * weight, a["y"] * (1 - weight) + b["y"] * weight, b["v"])
        return F.when(~valid(b), ZERO()).when(~valid(a), point(b["x"], b["y"], b["v"])).otherwise(both)

    return F.concat(F.zip_with(face(kpts), face(other), merge), F.slice(kpts, 6, F.greatest(F.size(kpts), F.lit(0))))


def average_face(kpts: Column, other: Column) -> Column:
    """Means of the face points, visibility included; not seen in the other source, zero; not seen here, the other's."""

    def merge(a: Column, b: Column) -> Column:
        both = point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2, (a["v"] + b["v"]) / 2)
        return F.when(~(b["v"] > 0), ZERO()).when(~(a["v"] > 0), point(b["x"], b["y"], b["v"])).otherwise(both)

    return F.concat(F.zip_with(face(kpts), face(other), merge), F.slice(kpts, 6, F.greatest(F.size(kpts), F.lit(0))))


def copy_face(kpts: Column, other: Column) -> Column:
    """The other source's five face points as they are."""
    return F.concat(face(pad(other, 5)), F.slice(kpts, 6, F.greatest(F.size(kpts), F.lit(0))))


def copy_eyes_and_ears(kpts: Column, other: Column) -> Column:
    """Points 1 to 4 of the other source where they are valid."""
    return F.transform(kpts, lambda p, i: F.when((i >= 1) & (i <= 4) & valid(F.get(other, i)), F.get(other, i)).otherwise(p))


def replace_joints(kpts: Column, sixteen: Column) -> Column:
    """The twelve joints of a 16-point body, as they are, in a 17-point one."""
    source = [-1] * 17
    for a, b in JOINTS:
        source[b] = a
    table = F.array(*[F.lit(k) for k in source])
    return F.transform(kpts, lambda p, i: F.when(F.get(table, i) >= 0, F.get(sixteen, F.get(table, i))).otherwise(p))


def zero_outside(kpts: Column, box: tuple[Column, ...]) -> Column:
    inside = lambda p: (p["x"] >= box[0]) & (p["x"] <= box[2]) & (p["y"] >= box[1]) & (p["y"] <= box[3])
    return F.transform(kpts, lambda p: F.when(inside(p), p).otherwise(ZERO()))


def inside_counts(kpts: Column, box: tuple[Column, ...]) -> Column:
    """How many valid points lie in a corner box, how many there are, and the ratio (0 without any)."""
    seen = F.filter(kpts, valid)
    n = F.size(F.filter(seen, lambda p: (p["x"] >= box[0]) & (p["x"] <= box[2]) & (p["y"] >= box[1]) & (p["y"] <= box[3])))
    return F.struct(n.alias("inside"), F.size(seen).alias("valid"), F.coalesce(F.try_divide(n, F.size(seen)), F.lit(0.0)).alias("ratio"))


def mirrored(kpts: Column) -> Column:
    """Flip left and right; names change sides if the body has 17 points. Null points stay zero."""
    flip = lambda p: F.when((p["x"] == 0) & (p["y"] == 0) & (p["v"] == 0), ZERO()).otherwise(point(1.0 - p["x"], p["y"], p["v"]))
    partner = F.array(*[F.lit(k) for k in MIRROR])
    swapped = F.transform(kpts, lambda p, i: F.get(kpts, F.get(partner, i)))
    return F.transform(F.when(F.size(kpts) == 17, swapped).otherwise(kpts), flip)


def eye_tilt(kpts: Column, w: Column, h: Column) -> Column:
    """Degrees of the line from one eye to the other; 90 if they coincide."""
    dx = (F.get(kpts, 2)["x"] - F.get(kpts, 1)["x"]) * w
    dy = (F.get(kpts, 2)["y"] - F.get(kpts, 1)["y"]) * h
    return F.when((dx == 0) & (dy == 0), F.lit(90.0)).otherwise(F.degrees(F.atan2(dy, dx)))


def seen_point(kpts: Column, k: int, inside: bool = False) -> Column:
    """The k-th point if it is valid (and, with ``inside``, within the frame), else null."""
    p = F.get(kpts, k)
    ok = valid(p)
    if inside:
        ok = ok & (p["x"] >= 0) & (p["x"] <= 1) & (p["y"] >= 0) & (p["y"] <= 1)
    return F.when(ok, p)


def of_class(class_id: Column, changed: Column, kpts: Column, wanted: int = 0) -> Column:
    """Changed points for one class; other classes' (and null's) pass as they are."""
    return F.when(F.coalesce(class_id == wanted, F.lit(False)), changed).otherwise(kpts)


def edges(kpts: Column) -> Column:
    """Edges whose ends are both seen: array of struct<edge, x1, y1, x2, y2>."""
    table = F.array(*[F.struct(F.lit(i).alias("edge"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(EDGES)])
    seen = F.filter(table, lambda e: (F.get(kpts, e["a"])["v"] > 0) & (F.get(kpts, e["b"])["v"] > 0))
    at = lambda e, end, name: F.get(kpts, e[end])[name].alias
    return F.transform(seen, lambda e: F.struct(e["edge"].alias("edge"), at(e, "a", "x")("x1"), at(e, "a", "y")("y1"), at(e, "b", "x")("x2"), at(e, "b", "y")("y2")))

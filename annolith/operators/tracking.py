"""Points followed from one grey picture to another: gradient steps over a pyramid, with a check backwards.

A window around a point is brought to match the other picture by least squares on its gradients, coarse levels first. All points of a pair of
pictures take their steps together. From where a point arrives it is followed back: if it doesn't return, it isn't trusted. A point that fails
is tried again with a larger window and twice the tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .propagation import REASONS, Moved, Tracker


@dataclass(frozen=True)
class Search:
    """window: side in pixels; levels: halvings of the picture, at most; steps, least_step: when a level ends; tolerance: pixels by which the
    way back may miss; texture: the least eigenvalue a pixel that a window's gradients need."""

    window: int = 32
    levels: int = 3
    steps: int = 30
    least_step: float = 0.01
    tolerance: float = 1.5
    texture: float = 1e-4

    def __post_init__(self):
        if self.window <= 0 or self.tolerance < 0 or self.levels < 0 or self.steps <= 0:
            raise ValueError("window and steps must be positive, levels and tolerance at least 0")

    @property
    def second(self) -> Search:
        """For points that failed."""
        return Search(max(2, round(self.window * 1.5)), self.levels, self.steps, self.least_step, self.tolerance * 2, self.texture)


def halved(a: np.ndarray) -> np.ndarray:
    """Every second pixel of the picture smoothed with 1 4 6 4 1, edges mirrored."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    for axis in (0, 1):
        p = np.pad(a, [(2, 2) if i == axis else (0, 0) for i in (0, 1)], mode="reflect" if a.shape[axis] > 2 else "edge")
        n = a.shape[axis]
        a = sum(w * p.take(np.arange(i, i + n), axis) for i, w in enumerate(k))
    return a[::2, ::2]


def pyramid(a: np.ndarray, levels: int, window: int) -> list[np.ndarray]:
    """The picture and its halves, as long as they hold a window."""
    out = [a.astype(np.float64)]
    while len(out) <= levels and min(out[-1].shape) // 2 >= max(3, window // 2):
        out.append(halved(out[-1]))
    return out


def sample(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels, linear; beyond the edge, the edge's."""
    h, w = a.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(x.astype(int), max(0, w - 2)), np.minimum(y.astype(int), max(0, h - 2))
    fx, fy = x - i, y - j
    i2, j2 = np.minimum(i + 1, w - 1), np.minimum(j + 1, h - 1)
    return (a[j, i] * (1 - fx) + a[j, i2] * fx) * (1 - fy) + (a[j2, i] * (1 - fx) + a[j2, i2] * fx) * fy


def _inside(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x >= 0) & (x <= a.shape[1] - 1) & (y >= 0) & (y <= a.shape[0] - 1)


def follow(first: list[np.ndarray], second: list[np.ndarray], points: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Where points (m x 2, pixels) of the first pyramid are in the second, and whether they were found.

    A point isn't found if its window has no texture in two directions or the search leaves the picture by more than a window.
    """
    half = (search.window - 1) / 2
    span = np.arange(search.window) - half
    dx, dy = (g.ravel() for g in np.meshgrid(span, span))
    guess, found = np.zeros_like(points), np.ones(len(points), bool)
    for level in range(len(first) - 1, -1, -1):
        a, b, at = first[level], second[level], points / 2**level
        gy, gx = np.gradient(a) if min(a.shape) > 1 else (np.zeros_like(a), np.zeros_like(a))
        x, y = at[:, :1] + dx, at[:, 1:] + dy
        # What lies beyond the edge of either picture says nothing.
        known = _inside(a, x, y)
        value, ix, iy = sample(a, x, y), sample(gx, x, y) * known, sample(gy, x, y) * known
        xx, xy, yy = (ix * ix).mean(1), (ix * iy).mean(1), (iy * iy).mean(1)
        weakest = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2
        flat = weakest < search.texture
        if level == 0:
            found &= ~flat
        det = np.where(flat, 1.0, xx * yy - xy * xy)
        moving = ~flat
        for _ in range(search.steps):
            m = np.flatnonzero(moving)
            if not len(m):
                break
            bx, by = x[m] + guess[m, :1], y[m] + guess[m, 1:]
            error = (value[m] - sample(b, bx, by)) * _inside(b, bx, by)
            ex, ey = (error * ix[m]).mean(1), (error * iy[m]).mean(1)
            step = np.column_stack([yy[m] * ex - xy[m] * ey, xx[m] * ey - xy[m] * ex]) / det[m, None]
            guess[m] += step
            to = at[m] + guess[m]
            lost = (to < -search.window).any(1) | (to[:, 0] > a.shape[1] + search.window) | (to[:, 1] > a.shape[0] + search.window) | ~np.isfinite(to).all(1)
            found[m[lost]] = False
            moving[m] = ~lost & ((step**2).sum(1) > search.least_step**2)
        guess[~np.isfinite(guess).all(1)] = 0.0
        if level:
            guess *= 2
    return points + guess, found


def checked(a: np.ndarray, b: np.ndarray, points: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (pixels) in ``b`` of points in ``a``, the distance by which the way back misses (NaN without one), and the reason's number."""
    pa_, pb = pyramid(a, search.levels, search.window), pyramid(b, search.levels, search.window)
    to, there = follow(pa_, pb, points, search)
    back, again = follow(pb, pa_, to, search)
    miss = np.where(there & again, np.sqrt(((back - points) ** 2).sum(1)), np.nan)
    h, w = a.shape
    outside = (to < 0).any(1) | (to[:, 0] >= w) | (to[:, 1] >= h)
    number = REASONS.index
    reason = np.select([~there, ~again, miss > search.tolerance, outside], [number("forward_fail"), number("backward_fail"), number("backcheck_fail"), number("out_of_frame")], 0)
    return to, miss, reason


def track(a: np.ndarray, b: np.ndarray, points: np.ndarray, search: Search = Search()) -> Moved:  # noqa: B008
    """Places of points, as shares of width and height, of a picture in another of its size; points off the picture begin at its edge."""
    h, w = a.shape
    size = np.array([w, h], float)
    at = np.clip(points * size, 0.0, size - 1)
    to, error, reason = checked(a, b, at, search)
    retried = reason != 0
    if retried.any():
        to[retried], error[retried], reason[retried] = checked(a, b, at[retried], search.second)
    return Moved(to / size, error, retried, reason)


def resized(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The picture in another size, linear between pixels."""
    if a.shape == shape:
        return a
    y, x = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in zip(shape, a.shape, strict=True))
    return sample(a.astype(np.float64), *np.meshgrid(x, y))


def picture(grey: bytes, width: int, height: int) -> np.ndarray:
    """Grey bytes, row by row."""
    if len(grey) != width * height:
        raise ValueError(f"{len(grey)} bytes aren't {width} x {height} pixels")
    return np.frombuffer(grey, np.uint8).reshape(height, width)


def pixels(search: Search = Search()) -> Tracker:  # noqa: B008
    """A tracker for :func:`propagation.carry_forward`: payloads are (grey, width, height); targets of another size are brought to the source's."""

    def run(first: tuple, second: tuple, points: np.ndarray) -> Moved:
        a = picture(*first)
        return track(a, resized(picture(*second), a.shape), points, search)

    return run


def some_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, at most so many at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


#: Pairs that are Python objects at once.
PAIRS = 16

_RESULT = "array<struct<x: double, y: double, error: double, retried: boolean, reason: string>>"
_PLACES = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("error", pa.float64()), ("retried", pa.bool_()), ("reason", pa.string())]))


def tracked(pairs: DataFrame, search: Search = Search(), keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:  # noqa: B008
    """For each pair of pictures, where its points are in the second: array of struct<x, y, error, retried, reason>; no place (null) unless the reason is ok.

    pairs: the keys, first, second (grey bytes), width, height, points (array of struct<x, y>, shares of width and height). A null picture or
    null points give null; no points, none. Pairs are independent rows, so they are worked out where they lie.
    """
    rows = pairs.select(*keys, "first", "second", "width", "height", "points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, PAIRS):
            out = []
            for r in batch.select(["first", "second", "width", "height", "points"]).to_pylist():
                if any(v is None for v in r.values()):
                    out.append(None)
                    continue
                a, b = (picture(r[k], r["width"], r["height"]) for k in ("first", "second"))
                moved = track(a, b, np.array([[p["x"], p["y"]] for p in r["points"]], float).reshape(-1, 2), search)
                out.append([
                    {"x": float(x) if not why else None, "y": float(y) if not why else None, "error": None if np.isnan(e) else float(e), "retried": bool(again), "reason": REASONS[why]}
                    for (x, y), e, again, why in zip(moved.xy, moved.error, moved.retried, moved.reason, strict=True)
                ])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(out, _PLACES)], [*keys, "places"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, places {_RESULT}")

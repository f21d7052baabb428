"""Labels carried forward through frame sequences: what is predicted for a frame is a source for the frames after it.

A sequence is a fold: its state is the newest labelled frames, predicted ones among them. Frames are dealt by sequence and
sorted, and the fold takes them batch by batch (``mapInArrow``), so a sequence may be longer than memory; what is kept of it are
``Rules.history`` frames. The order of a sequence can't be split, other sequences run beside it.

How points move from one frame to another is up to a tracker: :func:`displacements` for tables of camera positions,
:mod:`annolith.operators.tracking` for grey pixels.

Defined results
  null sequence         a sequence of its own; frames without an index are neither sources nor targets
  null keypoints        none; a source without the n-th object or point doesn't count for it
  frames of one index   are in the order of their names; none is a source of another
  frame without objects isn't a source; target without sources: no prediction
  repeated objects      are objects of their own
  empty table           no rows
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Why a point has no place in a frame, in the trackers' numbers; 0: it has one.
REASONS = ("ok", "forward_fail", "backward_fail", "backcheck_fail", "out_of_frame")
COUNTERS = (
    "objects", "points", "predicted", "kept_previous", "source_invalid", "retried", "predicted_on_retry", *REASONS[1:], "fused", "rejected", "sources_used",
)


class Moved(NamedTuple):
    """Where m points are in another frame: places (m x 2), error, whether a retry was needed, number of the reason."""

    xy: np.ndarray
    error: np.ndarray
    retried: np.ndarray
    reason: np.ndarray


#: From the payloads of two frames and points (shares of width and height) to their places in the second frame.
Tracker = Callable[[tuple, tuple, np.ndarray], Moved]


@dataclass(frozen=True)
class Rules:
    """start, end: first and last target index (None: no bound); frames outside are only sources.

    history: source frames of a target, at most, the newest; decay: in frames, how fast older ones lose weight. nth: the object
    of a source frame, counted from its last (0), or all (-1). own_only: sources begin with the first target.
    """

    start: int | None = None
    end: int | None = None
    history: int = 16
    decay: float = 8.0
    nth: int = -1
    own_only: bool = False
    class_id: int = 0
    points: int = 17

    def __post_init__(self):
        if self.points <= 0 or not 1 <= self.history <= 16 or self.decay <= 0 or self.nth < -1:
            raise ValueError("points and decay must be positive, history from 1 to 16, nth at least -1")
        if self.start is not None and self.end is not None and self.end < self.start:
            raise ValueError("the end must not be before the start")

    def wants(self, index: int) -> bool:
        return (self.start is None or index >= self.start) and (self.end is None or index <= self.end)


@dataclass
class Source:
    index: int
    payload: tuple
    #: Of each object: class, box (4) and points (k x 3).
    objects: list[tuple[int, list[float], np.ndarray]]


def displacements(most: float) -> Tracker:
    """Payloads (x, y, blur): a point moves as the frames' positions do; the error is the difference of their blur.

    A point whose error is above ``most`` is tried again with twice as much; one that leaves the frame has no place.
    """

    def track(a: tuple, b: tuple, points: np.ndarray) -> Moved:
        xy = points + (np.array(b[:2], float) - np.array(a[:2], float))
        error = np.full(len(points), abs(float(b[2]) - float(a[2])))
        outside = ((xy < 0) | (xy >= 1)).any(1)
        retried = (error > most) | outside
        reason = np.where(error > 2 * most, REASONS.index("backcheck_fail"), np.where(outside, REASONS.index("out_of_frame"), 0))
        return Moved(xy, error, retried, reason)

    return track


@dataclass
class Fold:
    """The state of a sequence: labelled frames before ``index``, newest first, and those of that index."""

    rules: Rules
    track: Tracker
    before: list[Source] = field(default_factory=list)
    here: list[Source] = field(default_factory=list)
    index: int | None = None
    first_target: int | None = None

    def step(self, index: int, payload: tuple, objects: list[tuple[int, list[float], np.ndarray]]) -> tuple[list[tuple[int, list[float], np.ndarray]], dict[str, int], list[int]] | None:
        """The objects predicted for a frame, counters and the sources' indexes; None if it is no target or has no sources."""
        if self.index is None or index > self.index:
            self.before, self.here, self.index = (self.here + self.before)[: self.rules.history], [], index
        wanted, out = self.rules.wants(index), None
        if wanted and self.first_target is None:
            self.first_target = index
            if self.rules.own_only:
                self.before = []
        if wanted and self.before:
            made, counts = predict(self.before, payload, index, self.rules, self.track)
            out = made, counts, [s.index for s in self.before]
        mine = [o for o in objects if o[0] == self.rules.class_id] + (out[0] if out else [])
        if self.rules.nth >= 0:
            mine = mine[len(mine) - 1 - self.rules.nth :][:1] if len(mine) > self.rules.nth else []
        if mine and not (self.rules.own_only and self.first_target is None):
            self.here.append(Source(index, payload, mine))
        return out


def predict(sources: Sequence[Source], payload: tuple, index: int, rules: Rules, track: Tracker) -> tuple[list[tuple[int, list[float], np.ndarray]], dict[str, int]]:
    """The nearest source's objects with their points where all sources see them in the target; the n-th object of every source is the same one."""
    nearest, k = sources[0].objects, rules.points
    shape = (len(sources), len(nearest) * k)
    given = np.zeros((*shape, 3))
    for s, source in enumerate(sources):
        for o, (_, _, points) in enumerate(source.objects[: len(nearest)]):
            n = min(k, len(points))
            given[s, o * k : o * k + n] = points[:n]
    seen = (given[..., 2] > 0) & ~((given[..., 0] == 0) & (given[..., 1] == 0))
    xy, weight, reason, retried = np.full((*shape, 2), np.nan), np.zeros(shape), np.zeros(shape, int), np.zeros(shape, bool)
    for s, source in enumerate(sources):
        at = np.flatnonzero(seen[s])
        if not len(at):
            continue
        moved = track(source.payload, payload, given[s, at, :2])
        found = moved.reason == 0
        xy[s, at[found]] = moved.xy[found]
        gone = np.exp(-max(1, index - source.index) / max(0.001, rules.decay))
        weight[s, at[found]] = np.maximum(1e-6, gone / (1.0 + np.maximum(0.0, moved.error[found])) * np.where(moved.retried[found], 0.85, 1.0))
        reason[s, at], retried[s, at] = moved.reason, moved.retried
    candidate = seen & (reason == 0)
    n = candidate.sum(0)
    place, rejected = fused(xy, np.where(candidate, weight, 0.0), n)
    first = np.where(seen.any(0), seen.argmax(0), 0)
    columns = np.arange(shape[1])
    kept = np.where(seen.any(0)[:, None], given[first, columns], 0.0)
    most_visible = np.where(seen, given[..., 2], 0.0).max(0)
    points = np.where((n > 0)[:, None], np.column_stack([place, most_visible]), kept)
    counts = {
        "objects": len(nearest), "points": shape[1], "predicted": int((n > 0).sum()), "kept_previous": int(((n == 0) & seen.any(0)).sum()), "source_invalid": int((~seen.any(0)).sum()),
        "retried": int(retried.sum()), "predicted_on_retry": int((retried & candidate).sum()), **{name: int((seen & (reason == i)).sum()) for i, name in enumerate(REASONS) if i},
        "fused": int((n > 1).sum()), "rejected": rejected, "sources_used": int(n.sum()),
    }
    return [(c, list(box), points[o * k : (o + 1) * k]) for o, (c, box, _) in enumerate(nearest)], counts


def fused(xy: np.ndarray, weight: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """Weighted means of candidate places (sources x points x 2, NaN where none); of three or more, those far from the median are left out."""
    out = np.zeros(xy.shape[1:])
    one = n == 1
    out[one] = np.nansum(xy[:, one], 0)
    many = np.flatnonzero(n > 1)
    if not len(many):
        return out, 0
    x, w = xy[:, many], weight[:, many]
    away = np.sqrt(((x - np.nanmedian(x, 0)) ** 2).sum(-1))
    limit = np.maximum(0.002, np.nanmedian(away, 0) * 2.5)
    there = ~np.isnan(x[..., 0])
    keep = there & ((n[many] < 3) | (np.where(there, away, 0.0) <= limit))
    w = np.where(keep, w, 0.0)
    out[many] = (np.where(keep[..., None], x, 0.0) * w[..., None]).sum(0) / w.sum(0)[:, None]
    return out, int((there & ~keep).sum())


_POINT = "struct<x: double, y: double, v: double>"
PREDICTED = f"array<struct<class_id: int, cx: double, cy: double, w: double, h: double, kpts: array<{_POINT}>>>"
_OUT = f"frame_index long, name string, existing int, sources array<long>, predicted {PREDICTED}, counts map<string, long>"
_KPTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("v", pa.float64())]))
_PREDICTED = pa.list_(pa.struct([("class_id", pa.int32()), *[(c, pa.float64()) for c in ("cx", "cy", "w", "h")], ("kpts", _KPTS)]))


def _object(o: dict) -> tuple[int, list[float], np.ndarray]:
    return o["class_id"], [o[c] for c in ("cx", "cy", "w", "h")], np.array([[p[c] if p and p[c] is not None else 0.0 for c in "xyv"] for p in o["kpts"] or []], float).reshape(-1, 3)


def predicted_rows(made: list[tuple[int, list[float], np.ndarray]]) -> list[dict]:
    return [{"class_id": c, "cx": b[0], "cy": b[1], "w": b[2], "h": b[3], "kpts": [{"x": p[0], "y": p[1], "v": p[2]} for p in k.tolist()]} for c, b, k in made]


def with_objects(frames: DataFrame, objects: DataFrame, payload: Sequence[str]) -> DataFrame:
    """One row per frame (seq_id, frame_index, name) with its payload and its objects in line order.

    objects: seq_id, frame_index, name, line_no, class_id, cx, cy, w, h, kpts; rows without a whole box don't count.
    """
    keys = ["seq_id", "frame_index", "name"]
    whole = objects.where(F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull())
    o = whole.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sort_array(F.collect_list(F.struct("line_no", F.col("class_id").cast("int").alias("class_id"), "cx", "cy", "w", "h", "kpts"))).alias("objects"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return frames.select(*keys, *payload).join(o, same, "left").select(*keys, *payload, "objects")


def carry_forward(frames: DataFrame, objects: DataFrame, payload: Sequence[str], track: Tracker, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row per target that has sources: seq_id, frame_index, name, existing (its own objects), sources, predicted, counts."""
    spark = frames.sparkSession
    rows = with_objects(frames, objects, payload).where(F.col("frame_index").isNotNull()).withColumn("frame_index", F.col("frame_index").cast("long"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq_id").sortWithinPartitions("seq_id", "frame_index", "name")
    kind = rows.schema["seq_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, at = None, object()
        for batch in batches:
            out: list[list[Any]] = [[] for _ in range(7)]
            for row in batch.to_pylist():
                if fold is None or row["seq_id"] != at:
                    fold, at = Fold(rules, track), row["seq_id"]
                own = [_object(o) for o in row["objects"] or []]
                got = fold.step(row["frame_index"], tuple(row[c] for c in payload), own)
                if got is not None:
                    made, counts, sources = got
                    for column, value in zip(out, (at, row["frame_index"], row["name"], len(own), sources, predicted_rows(made), list(counts.items())), strict=True):
                        column.append(value)
            kinds = (batch.schema.field("seq_id").type, pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), _PREDICTED, pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["seq_id", "frame_index", "name", "existing", "sources", "predicted", "counts"])

    return dealt.mapInArrow(run, f"seq_id {kind.simpleString()}, {_OUT}")


def appended(carried: DataFrame) -> DataFrame:
    """The predicted objects as rows: they follow the frame's own (``line_no`` goes on)."""
    rows = carried.select("seq_id", "frame_index", "name", "existing", F.posexplode("predicted").alias("_i", "p"))
    return rows.select("seq_id", "frame_index", "name", (F.col("existing") + F.col("_i")).cast("int").alias("line_no"), "p.*")


def totals(carried: DataFrame) -> DataFrame:
    """All counters over all targets, in their order, zeros kept."""
    fixed = carried.sparkSession.createDataFrame(list(enumerate(COUNTERS)), "place int, counter string")
    n = carried.select(F.explode("counts").alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("n"))
    return fixed.join(n, "counter", "left").select("place", "counter", F.coalesce("n", F.lit(0)).alias("n"))


def first_valid(history: DataFrame, objects: DataFrame, points: int = 17) -> DataFrame:
    """Per target and object of its nearest source: each point from the first source that has a valid one, and the largest visibility.

    history: seq_id, target_index, source_index, place (1: the nearest). objects: seq_id, frame_index, obj_pos, kpts. The n-th object of
    every source is taken for the same one. Result: seq_id, target_index, obj_pos, kpts (as it is in that source), seen (visibilities).
    """
    o = objects.select("seq_id", F.col("frame_index").alias("source_index"), "obj_pos", "kpts")
    both = history.join(o, ["seq_id", "source_index"])
    lists = both.groupBy("seq_id", "target_index", "obj_pos").agg(F.sort_array(F.collect_list(F.struct("place", "kpts"))).alias("s"))
    lists = lists.where(F.get("s", F.lit(0))["place"] == 1)
    valid = lambda p: (p["v"] > 0) & ~((p["x"] == 0) & (p["y"] == 0))
    # Per point, the valid ones of all sources in order, at most as many as the history is deep.
    seen = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.filter(F.transform("s", lambda s: F.get(s["kpts"], k)), lambda p: F.coalesce(valid(p), F.lit(False))))
    lists = lists.withColumn("seen", seen)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "xyv"])
    return lists.select(
        "seq_id", "target_index", "obj_pos", F.transform("seen", lambda p: F.when(F.size(p) > 0, F.get(p, F.lit(0))).otherwise(zero)).alias("kpts"),
        F.transform("seen", lambda p: F.coalesce(F.array_max(F.transform(p, lambda q: q["v"])), F.lit(0.0))).alias("seen"),
    )

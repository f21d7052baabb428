"""Labels carried forward against a plain loop, on batches and streams; points followed through pictures."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.operators import propagation as pg
from annolith.operators import tracking as tr
from annolith.streaming import propagation as stream

MOST = 0.05
POINT = "struct<x: double, y: double, v: double>"
OBJECTS = f"seq_id long, frame_index long, name string, line_no int, class_id int, cx double, cy double, w double, h double, kpts array<{POINT}>"
FRAMES = "seq_id long, frame_index long, name string, px double, py double, blur double"


def made(seed=0, seqs=3, frames=60, points=4):
    """Frames with positions, some sharing an index; objects on a few of them, some of another class or without a box or points."""
    rng = np.random.default_rng(seed)
    f, o = [], []
    for s in range(seqs):
        for i in range(0, frames, 1 + s):
            for name in ("a", "b")[: 1 + (i % 13 == 6)]:
                f.append((s, i, name, *map(float, rng.normal(0, 0.08, 2)), float(rng.uniform(0, 0.2))))
                for line in range(int(rng.integers(0, 3)) if i % 7 == 1 else 0):
                    k = [(float(x), float(y), float(v)) if v >= 0 else (0.0, 0.0, 2.0) for x, y, v in zip(*rng.random((2, points)), rng.choice([-1, 0, 1, 2], points), strict=True)]
                    o.append((s, i, name, line, int(rng.integers(0, 5) == 0), None if rng.random() < 0.1 else 0.5, 0.5, 0.2, 0.2, k[: int(rng.integers(2, points + 1))]))
    return f, o


def loop(frames, objects, rules):
    """The rule as a plain loop, frame by frame and point by point."""
    out, lines = {}, {}
    for o in sorted(objects, key=lambda o: o[3]):
        if o[5] is not None:
            lines.setdefault(o[:3], []).append((o[4], o[5:9], o[9]))
    for seq in {f[0] for f in frames}:
        mine = sorted((f for f in frames if f[0] == seq), key=lambda f: f[1:3])
        targets = [f for f in mine if rules.wants(f[1])]
        least = targets[0][1] if rules.own_only and targets else None
        for t in targets:
            sources = []
            for f in sorted((f for f in mine if f[1] < t[1] and (least is None or f[1] >= least)), key=lambda f: -f[1]):
                have = [o for o in lines.get(f[:3], []) if o[0] == rules.class_id]
                if rules.nth >= 0:
                    have = [have[len(have) - 1 - rules.nth]] if len(have) > rules.nth else []
                if have and len(sources) < rules.history:
                    sources.append((f, have))
            if not sources:
                continue
            new = []
            for n, (c, box, _) in enumerate(sources[0][1]):
                points = []
                for k in range(rules.points):
                    seen, found = [], []
                    for f, have in sources:
                        if n < len(have) and k < len(have[n][2]):
                            x, y, v = have[n][2][k]
                            if v > 0 and (x, y) != (0, 0):
                                seen.append((x, y, v))
                                e = abs(t[5] - f[5])
                                p = (x + t[3] - f[3], y + t[4] - f[4])
                                if e <= 2 * MOST and 0 <= p[0] < 1 and 0 <= p[1] < 1:
                                    found.append((*p, max(1e-6, math.exp(-max(1, t[1] - f[1]) / rules.decay) / (1 + e) * (0.85 if e > MOST else 1))))
                    if not seen:
                        points.append((0, 0, 0))
                    elif not found:
                        points.append(seen[0])
                    else:
                        if len(found) > 2:
                            mx, my = statistics.median(p[0] for p in found), statistics.median(p[1] for p in found)
                            away = [math.hypot(p[0] - mx, p[1] - my) for p in found]
                            found = [p for p, a in zip(found, away, strict=True) if a <= max(0.002, 2.5 * statistics.median(away))]
                        w = sum(p[2] for p in found)
                        points.append((sum(p[0] * p[2] for p in found) / w, sum(p[1] * p[2] for p in found) / w, max(p[2] for p in seen)))
                new.append((c, box, points))
            lines.setdefault(t[:3], []).extend(new)
            out[t[:3]] = new
    return out


def flat(predicted):
    """Predictions by frame, as numbers."""
    return {k: [[o[0], *o[1], *[x for p in o[2] for x in p]] for o in v] for k, v in predicted.items()}


def rows_of(carried):
    return {(r.seq_id, r.frame_index, r.name): [[o.class_id, o.cx, o.cy, o.w, o.h, *[x for p in o.kpts for x in p]] for o in r.predicted] for r in carried}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9), k


@pytest.mark.parametrize(
    "rules",
    [pg.Rules(points=4), pg.Rules(points=4, start=20, end=40, history=3), pg.Rules(points=5, start=10, own_only=True), pg.Rules(points=4, nth=0, history=1), pg.Rules(points=3, nth=1), pg.Rules(points=4, class_id=1)],
)
def test_equal_to_a_plain_loop(spark, rules):
    frames, objects = made()
    want = flat(loop(frames, objects, rules))
    f, o = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(objects, OBJECTS)
    # Batches of five frames: the state lives on from one to the next.
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        carried = pg.carry_forward(f, o, ["px", "py", "blur"], pg.displacements(MOST), rules).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) > 10
    same(rows_of(carried), want)
    for r in carried:
        c = r.counts
        assert c["points"] == c["objects"] * rules.points == c["predicted"] + c["kept_previous"] + c["source_invalid"] and len(r.sources) <= rules.history


def test_rows_and_counters(spark):
    frames, objects = made(2)
    f, o = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(objects, OBJECTS).withColumns({"objects": F.lit(1), "counts": F.lit(2)})
    carried = pg.carry_forward(f, o, ["px", "py", "blur"], pg.displacements(MOST), pg.Rules(points=4)).cache()
    every = pg.appended(carried).collect()
    assert len(every) == sum(len(r.predicted) for r in carried.collect()) and {r.line_no for r in every} > {0}
    n = {r.counter: r.n for r in pg.totals(carried).collect()}
    assert set(n) == set(pg.COUNTERS)
    assert n["objects"] == len(every) and n["forward_fail"] == n["backward_fail"] == 0 < n["backcheck_fail"] and n["out_of_frame"] > 0 < n["predicted_on_retry"] <= n["retried"]
    carried.unpersist()


def test_nothing_to_carry(spark):
    f, o = spark.createDataFrame([], FRAMES), spark.createDataFrame([], OBJECTS)
    assert pg.carry_forward(f, o, ["px", "py", "blur"], pg.displacements(MOST)).count() == 0
    f = spark.createDataFrame([(None, 1, "a", 0.0, 0.0, 0.0), (None, 2, None, 0.1, 0.0, 0.0), (None, None, "x", 0.0, 0.0, 0.0)], FRAMES)
    o = spark.createDataFrame([(None, 1, "a", 0, 0, 0.5, 0.5, 0.1, 0.1, None), (None, 1, "a", 1, 0, 0.4, 0.5, 0.1, 0.1, [(0.5, 0.5, 2.0)])], OBJECTS)
    (r,) = pg.carry_forward(f, o, ["px", "py", "blur"], pg.displacements(MOST), pg.Rules(points=1)).collect()
    assert r.name is None and [[tuple(p) for p in x.kpts] for x in r.predicted] == [[(0.0, 0.0, 0.0)], [(0.6, 0.5, 2.0)]]


def test_rules_are_checked():
    for wrong in ({"points": 0}, {"history": 0}, {"history": 17}, {"decay": 0}, {"nth": -2}, {"start": 5, "end": 4}):
        with pytest.raises(ValueError):
            pg.Rules(**wrong)


def test_stream_begun_again(spark, tmp_path):
    """Frames come in three parts, each in a run of its own that goes on from the checkpoint; late ones are marked."""
    frames, objects = made(3)
    rules, payload, track = pg.Rules(points=4), ["px", "py", "blur"], pg.displacements(MOST)
    rows = pg.with_objects(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(objects, OBJECTS), payload)
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for low, high in ((0, 20), (20, 45), (45, 99)):
            rows.where(F.col("frame_index").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
            s = spark.readStream.schema(rows.schema).parquet(folder)
            q = stream.carry_forward(s, payload, track, rules).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
            assert q.awaitTermination(180)
        rows.where("frame_index = 7").write.mode("append").parquet(folder)
        s = spark.readStream.schema(rows.schema).parquet(folder)
        assert stream.carry_forward(s, payload, track, rules).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination(180)
    finally:
        spark.conf.set(key, before)
    got = spark.read.parquet(out)
    same(rows_of(got.where("not late and size(predicted) > 0").collect()), flat(loop(frames, objects, rules)))
    late = got.where("late").collect()
    assert late and all(r.frame_index == 7 and not r.predicted for r in late)


# --- points in pictures --------------------------------------------------------------------------
def scene(dx=0.0, dy=0.0, w=120, h=90):
    rng = np.random.default_rng(4)
    f, phase, strength = rng.uniform(-0.05, 0.05, (12, 2)), rng.uniform(0, 6, 12), rng.uniform(5, 10, 12)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    total = 128 + sum(s * np.sin(2 * np.pi * ((x - dx) * a + (y - dy) * b) + p) for s, (a, b), p in zip(strength, f, phase, strict=True))
    return np.clip(np.rint(total), 0, 255).astype(np.uint8)


AT = np.random.default_rng(5).uniform(0.3, 0.7, (12, 2))
SIZE = np.array([120.0, 90.0])


@pytest.mark.parametrize("shift", [(0, 0), (0.5, -0.25), (3.4, -2.2), (9.5, 6.0), (-11, 4)])
def test_known_shifts(shift):
    m = tr.track(scene(), scene(*shift), AT)
    assert (m.reason == 0).all() and np.abs((m.xy - AT) * SIZE - shift).max() < 0.1 and m.error.max() < 0.2


def test_reasons():
    number = pg.REASONS.index
    flat_ = np.full((90, 120), 7, np.uint8)
    assert set(tr.track(flat_, scene(), AT).reason) == {number("forward_fail")}
    away = tr.track(scene(), scene(-9, 0), np.array([[0.03, 0.5], [0.5, 0.5]]))
    assert away.reason.tolist() == [number("out_of_frame"), 0] and away.retried.tolist() == [True, False]
    half = scene()
    half[:, 60:] = 7
    gone = tr.track(scene(), half, np.array([[0.9, 0.5]]))
    assert gone.reason[0] in (number("backward_fail"), number("backcheck_fail"))
    other = np.random.default_rng(1).integers(0, 255, (90, 120)).astype(np.uint8)
    lost = tr.track(scene(), other, AT)
    assert (lost.reason != 0).sum() >= 6 and lost.retried[lost.reason != 0].all()


def test_second_try_is_larger():
    first = tr.Search(window=32, tolerance=1.5)
    assert (first.second.window, first.second.tolerance) == (48, 3.0)
    with pytest.raises(ValueError):
        tr.Search(window=0)


def test_pictures_of_another_size():
    big = tr.resized(scene(), (180, 240))
    assert big.shape == (180, 240) and np.abs(tr.resized(big, (90, 120)) - scene()).mean() < 3


def test_tracked_rows(spark):
    pts = [(float(x), float(y)) for x, y in AT]
    a, b = scene().tobytes(), scene(4, -3).tobytes()
    df = spark.createDataFrame([(1, a, b, pts), (2, a, None, pts), (3, a, b, []), (4, a, b, None)], "pair_id long, first binary, second binary, points array<struct<x: double, y: double>>")
    got = {r.pair_id: r.places for r in tr.tracked(df.withColumns({"width": F.lit(120), "height": F.lit(90), "places": F.lit(1)})).collect()}
    assert got[2] is None and got[3] == [] and got[4] is None and len(got[1]) == 12
    assert all(p.reason == "ok" and abs((p.x - x) * 120 - 4) < 0.1 and abs((p.y - y) * 90 + 3) < 0.1 for p, (x, y) in zip(got[1], pts, strict=True))


def test_labels_follow_pixels(spark):
    """A pose in the first picture is carried through pictures that move by two pixels a frame."""
    frames = [(1, i, f"f{i}", scene(2.0 * i, -1.0 * i).tobytes(), 120, 90) for i in range(6)]
    kpts = [(float(x), float(y), 2.0) for x, y in AT[:4]] + [(0.0, 0.0, 0.0)]
    f = spark.createDataFrame(frames, "seq_id long, frame_index long, name string, grey binary, width int, height int")
    o = spark.createDataFrame([(1, 0, "f0", 0, 0, 0.5, 0.5, 0.4, 0.4, kpts)], OBJECTS)
    got = rows_of(pg.carry_forward(f, o, ["grey", "width", "height"], tr.pixels(tr.Search(window=21)), pg.Rules(points=5, history=3)).collect())
    assert len(got) == 5
    for (_, i, _), ((_, *box_and_points),) in got.items():
        p = np.array(box_and_points[4:]).reshape(5, 3)
        assert np.abs((p[:4, :2] - AT[:4]) * SIZE - [2.0 * i, -1.0 * i]).max() < 0.3 and (p[4] == 0).all()


def test_pictures_are_worked_on_some_rows_at_a_time():
    """What Spark hands a worker at once may be 10,000 pairs, which were all made numbers together."""
    import pyarrow as pa

    from annolith.operators import tracking

    batch = pa.RecordBatch.from_pydict({"n": list(range(10_000)), "v": [[k] for k in range(10_000)]})
    parts = list(tracking.some_rows([batch, batch.slice(5, 0), batch.slice(3, 5)], 64))
    assert max(p.num_rows for p in parts) == 64 and [n for p in parts for n in p.column("n").to_pylist()] == [*range(10_000), *range(3, 8)]
    assert parts[1].column("v").flatten().to_pylist() == list(range(64, 128))

"""Queries over frame sequences whose labels are carried forward, and over points followed from picture to picture."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import propagation as pg
from ..operators import sequence as sq
from ..operators import tracking as tr
from . import fixtures as fx
from .catalog import M, micros, query, u


@query(f"""WITH o AS (SELECT image_id % 7 seq_id, image_id frame_index, vec_id, row_number() OVER (PARTITION BY image_id ORDER BY obj_idx) - 1 obj_pos FROM pose_box WHERE class_id = 0),
f AS (SELECT DISTINCT seq_id, frame_index FROM o), t AS (SELECT DISTINCT image_id % 7 seq_id, image_id target_index FROM pose_box),
h AS (SELECT t.seq_id, target_index, frame_index, row_number() OVER (PARTITION BY t.seq_id, target_index ORDER BY frame_index DESC) place
      FROM t JOIN f ON t.seq_id = f.seq_id AND frame_index < target_index QUALIFY place <= 3),
n AS (SELECT h.seq_id, target_index, obj_pos FROM h JOIN o USING (seq_id, frame_index) WHERE place = 1),
j AS (SELECT n.*, place, k, x, y, v, v > 0 AND NOT (x = 0 AND y = 0) ok FROM n JOIN h USING (seq_id, target_index) JOIN o USING (seq_id, frame_index, obj_pos) JOIN pose_kpts p ON p.vec_id = o.vec_id)
SELECT seq_id, target_index, obj_pos, k, {M('coalesce(arg_min(x, place) FILTER (ok), 0)')} x_u, {M('coalesce(arg_min(y, place) FILTER (ok), 0)')} y_u, {M('coalesce(arg_min(v, place) FILTER (ok), 0)')} v_u,
 {M('coalesce(max(v) FILTER (ok), 0)')} seen_u FROM j GROUP BY ALL""", "pose_box", "pose_kpts")
def history_first_valid(s, d):
    """Of the three newest labelled frames before each frame, every object's points from the first that sees them."""
    o = fx.poses(s, d).where("class_id = 0").select(F.expr("image_id % 7").alias("seq_id"), F.col("image_id").alias("frame_index"), "obj_idx", "kpts")
    o = o.withColumn("obj_pos", F.expr("row_number() OVER (PARTITION BY frame_index ORDER BY obj_idx) - 1"))
    targets = fx.view(s, d, "pose_box").select(F.expr("image_id % 7").alias("seq_id"), F.col("image_id").alias("frame_index")).distinct()
    found = pg.first_valid(sq.history(o.select("seq_id", "frame_index").distinct(), targets, 3), o)
    rows = found.select("seq_id", "target_index", F.col("obj_pos").cast("long"), F.posexplode(F.arrays_zip(F.col("kpts").alias("p"), F.col("seen").alias("seen"))).alias("k", "z"))
    return rows.select("seq_id", "target_index", "obj_pos", "k", u("z.p.x").alias("x_u"), u("z.p.y").alias("y_u"), u("z.p.v").alias("v_u"), u("z.seen").alias("seen_u"))


@query("SELECT event_id, CAST(least(frame_index, 5) AS INT) AS work FROM frames", "frames")
def history_work(s, d):
    return sq.expected_history(fx.view(s, d, "frames"), 5).select("event_id", "work")


_E = lambda i: f"CAST(embedding[{i}] AS DOUBLE)"


def _carried_sql(most: float, decay: float) -> str:
    """History of two frames, point by point: a frame's points depend on those of the two before it."""
    kpts = " UNION ALL ".join(
        f"SELECT seq_id, i, px, py, blur, {k} k, least(greatest(0.5 + {_E(3 * k + 1)}, 0.0), 1.0) x, least(greatest(0.5 + {_E(3 * k + 2)}, 0.0), 1.0) y, CASE WHEN {_E(3 * k + 3)} > -0.05 THEN 2.0 ELSE 0.0 END v FROM f WHERE i <= 2"
        for k in range(17)
    )
    side = lambda n: f"""v{n} > 0 AND NOT (x{n} = 0 AND y{n} = 0) valid{n}, x{n} + (f.px - px{n}) nx{n}, y{n} + (f.py - py{n}) ny{n}, abs(f.blur - blur{n}) e{n}"""
    ok = lambda n: f"valid{n} AND e{n} <= {2 * most} AND nx{n} >= 0 AND nx{n} < 1 AND ny{n} >= 0 AND ny{n} < 1 ok{n}, greatest(1e-6, exp(CAST(-{n} AS DOUBLE) / {decay}) / (1 + e{n}) * CASE WHEN e{n} > {most} THEN 0.85::DOUBLE ELSE 1::DOUBLE END) w{n}"
    place = lambda c: f"CASE WHEN ok1 AND ok2 THEN (n{c}1 * w1 + n{c}2 * w2) / (w1 + w2) WHEN ok1 THEN n{c}1 WHEN ok2 THEN n{c}2 WHEN valid1 THEN {c}1 WHEN valid2 THEN {c}2 ELSE 0 END"
    seen = "CASE WHEN ok1 OR ok2 THEN greatest(CASE WHEN valid1 THEN v1 ELSE 0 END, CASE WHEN valid2 THEN v2 ELSE 0 END) WHEN valid1 THEN v1 WHEN valid2 THEN v2 ELSE 0 END"
    return f"""WITH RECURSIVE f AS (SELECT label seq_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) i, {_E(57)} px, {_E(58)} py, {_E(59)} blur, embedding FROM embeddings),
p AS ({kpts}),
r AS (SELECT a.seq_id, a.k, a.i, a.x x1, a.y y1, a.v v1, a.px px1, a.py py1, a.blur blur1, b.x x2, b.y y2, b.v v2, b.px px2, b.py py2, b.blur blur2 FROM p a JOIN p b ON a.seq_id = b.seq_id AND a.k = b.k AND a.i = 2 AND b.i = 1
 UNION ALL SELECT seq_id, k, i, {place('x')}, {place('y')}, {seen}, px, py, blur, x1, y1, v1, px1, py1, blur1
 FROM (SELECT *, {ok(1)}, {ok(2)} FROM (SELECT r.* EXCLUDE (i), f.i, f.px, f.py, f.blur, {side(1)}, {side(2)} FROM r JOIN f ON f.seq_id = r.seq_id AND f.i = r.i + 1)))
SELECT CAST(seq_id AS BIGINT) seq_id, i frame_index, k, {M('x1')} x_u, {M('y1')} y_u, {M('v1')} v_u FROM r WHERE i > 2"""


@query(_carried_sql(0.1, 8.0))
def labels_carried_forward(s, d):
    """Each label's vectors are a sequence; the poses of its first two frames are carried through all others."""
    e = fx.table(s, d, "embeddings").join(fx.poses(s, d).select("vec_id", "cx", "cy", "w", "h", "kpts"), "vec_id")
    e = e.select(F.col("label").cast("long").alias("seq_id"), F.expr("CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT)").alias("frame_index"), F.col("vec_id").cast("string").alias("name"), "*")
    frames = e.select("seq_id", "frame_index", "name", *[F.element_at("embedding", 57 + k).cast("double").alias(c) for k, c in enumerate(("px", "py", "blur"))])
    objects = e.where("frame_index <= 2").select("seq_id", "frame_index", "name", F.lit(0).alias("line_no"), F.lit(0).alias("class_id"), "cx", "cy", "w", "h", "kpts")
    carried = pg.carry_forward(frames, objects, ["px", "py", "blur"], pg.displacements(0.1), pg.Rules(start=3, history=2))
    rows = pg.appended(carried).select("seq_id", "frame_index", F.posexplode("kpts").alias("k", "p"))
    return rows.select("seq_id", "frame_index", "k", u("p.x").alias("x_u"), u("p.y").alias("y_u"), u("p.v").alias("v_u"))


#: Waves of the pictures (periods across and down, in pixels) and where points are asked for.
_WAVES = [(40, 0), (0, 36), (52, 48), (-30, 44), (26, -58), (70, 24)]
_AT = [(0.5, 0.5), (0.4, 0.6), (0.6, 0.45), (0.45, 0.4)]
_WIDTH, _HEIGHT = 80, 64
#: Pairs of pictures made at once: a worker holds these as numbers, not all that Spark hands it at once.
_AT_ONCE = 64


def moved_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector two grey pictures: waves whose strength and phase are its components, the second moved by half pixels."""
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[0:_HEIGHT, 0:_WIDTH].astype(float)
        for batch in tr.some_rows(batches, _AT_ONCE):
            v = batch.column("e").flatten().to_numpy().reshape(len(batch), -1)
            shift = np.rint(v[:, :2] * 20) / 2
            grey = []
            for move in (np.zeros_like(shift), shift):
                total = np.full((len(v), _HEIGHT, _WIDTH), 128.0)
                for k, (across, down) in enumerate(_WAVES):
                    turns = sum((a[None] - move[:, i, None, None]) / p for i, (a, p) in enumerate(((x, across), (y, down))) if p)
                    total += (12 + 8 * np.tanh(v[:, 2 + k]))[:, None, None] * np.sin(2 * np.pi * (turns + v[:, 10 + k, None, None]))
                grey.append(np.clip(np.rint(total), 0, 255).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *[pa.array([g.tobytes() for g in part], pa.binary()) for part in grey]], ["pair_id", "first", "second"])

    pairs = e.mapInArrow(run, "pair_id long, first binary, second binary")
    at = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in _AT])
    return pairs.select("*", F.lit(_WIDTH).alias("width"), F.lit(_HEIGHT).alias("height"), at.alias("points"))


@query(f"""SELECT vec_id pair_id, CAST(k AS INT) k, 'ok' reason, CAST(round_even({_E(1)} * 20, 0) AS INT) dx, CAST(round_even({_E(2)} * 20, 0) AS INT) dy FROM embeddings, (SELECT unnest(range({len(_AT)})) k)""")
def points_tracked(s, d):
    """Points are found again where the pictures were moved to, to the nearest half pixel."""
    places = tr.tracked(moved_pictures(s, d), tr.Search(window=21, levels=2)).select("pair_id", F.posexplode("places").alias("k", "p"))
    x, y = (F.get(F.array(*[F.lit(a[i]) for a in _AT]), F.col("k")) for i in (0, 1))
    half = lambda c, at, size: F.rint((F.col(c) - at) * size * 2).cast("int")
    return places.select("pair_id", "k", "p.reason", half("p.x", x, _WIDTH).alias("dx"), half("p.y", y, _HEIGHT).alias("dy"))

"""Queries over masks, mosaics with their labels, and merged mirrored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keypoints as kp
from ..operators import export
from ..operators import layout as lay
from ..operators import mosaics as mo
from . import fixtures as fx
from .catalog import BOX, M, micros, query, u

_MASKS = """o AS (SELECT image_id, obj_idx, class_id, CAST(round(cx * 1000) AS INT) % 97 gap, CASE WHEN CAST(round(cx * 1000) AS INT) % 5 < 3 THEN 0 ELSE CAST(round(w * 100) AS INT) END n FROM boxes),
m AS (SELECT image_id, min(class_id) class_id, CAST(20 + image_id % 30 AS INT) width, CAST(sum(gap + n) AS INT) pixels FROM o GROUP BY image_id)"""


@query(f"""WITH {_MASKS},
s AS (SELECT *, sum(gap + n) OVER (PARTITION BY image_id ORDER BY obj_idx) - n first FROM o),
x AS (SELECT image_id, unnest(range(CAST(first AS BIGINT), CAST(first + n AS BIGINT))) p FROM s),
e AS (SELECT image_id, class_id, width, CAST(ceil(pixels / width) AS INT) + 2 height, min(p % width) l, min(p // width) t, max(p % width) r, max(p // width) b FROM x JOIN m USING (image_id) GROUP BY ALL)
SELECT image_id, class_id, {M('(l + r + 1) / (2.0::DOUBLE * width)')} cx_u, {M('(t + b + 1) / (2.0::DOUBLE * height)')} cy_u, {M('(r - l + 1) / width::DOUBLE')} w_u, {M('(b - t + 1) / height::DOUBLE')} h_u FROM e""", "boxes")
def mask_boxes(s, d):
    """An order's mask has a run a line; no row is made of a pixel. The SQL has a row a pixel."""
    b = fx.view(s, d, "boxes").select("image_id", "obj_idx", "class_id", F.round(F.col("cx") * 1000).cast("int").alias("c"), F.round(F.col("w") * 100).cast("int").alias("n"))
    runs = F.array((F.col("c") % 97).alias("gap"), F.when(F.col("c") % 5 < 3, 0).otherwise(F.col("n")))
    m = b.groupBy("image_id").agg(F.min("class_id").alias("class_id"), F.array_sort(F.collect_list(F.struct("obj_idx", runs.alias("runs")))).alias("lines"))
    m = m.select("image_id", F.lit(0).alias("obj_idx"), "class_id", F.lit(None).cast("double").alias("score"), F.flatten(F.transform("lines", lambda x: x["runs"])).alias("runs"), (20 + F.col("image_id") % 30).cast("int").alias("width"))
    pixels = F.aggregate("runs", F.lit(0), lambda a, n: a + n)
    m = m.withColumn("height", F.ceil(pixels / F.col("width")).cast("int") + 2)
    return micros(mo.boxes_of_masks(m), ["image_id", "class_id"], BOX)


def _placements_sql(factor: float) -> str:
    """The five cuts one after the other: rows t (image_id, canvas_w, canvas_h, step from 0, tile)."""
    steps = [(90, "false", True), (0, "true", False), (270, "false", True), (0, "false", False), (0, "true", False)]
    sql = [f"""e AS (SELECT *, height >= width tall, greatest(1, CAST(trunc(greatest(width, height) * {factor}::DOUBLE) AS INT)) extra FROM images),
c0 AS (SELECT image_id, width w, height h, tall, CASE WHEN tall THEN width ELSE 0 END rx, CASE WHEN tall THEN 0 ELSE height END ry, CASE WHEN tall THEN extra ELSE width END rw, CASE WHEN tall THEN height ELSE extra END rh,
 width + CASE WHEN tall THEN extra ELSE 0 END canvas_w, height + CASE WHEN tall THEN 0 ELSE extra END canvas_h FROM e)"""]
    for k, (turn, _, wide_first) in enumerate(steps):
        w, h = ("h", "w") if turn else ("w", "h")
        by_height = "NOT tall" if wide_first else "tall"
        sql.append(f"a{k} AS (SELECT *, CAST(round_even(CAST({w} AS DOUBLE) * rh / {h}, 0) AS INT) fw, CAST(round_even(CAST({h} AS DOUBLE) * rw / {w}, 0) AS INT) fh, {by_height} by_height FROM c{k} WHERE rw > 0 AND rh > 0)")
        sql.append(f"b{k} AS (SELECT *, CASE WHEN by_height THEN fw <= rw ELSE fh > rh END cut FROM a{k})")
        sql.append(f"d{k} AS (SELECT *, greatest(1, least(rw, CASE WHEN cut THEN fw ELSE rw END)) tw, greatest(1, least(rh, CASE WHEN cut THEN rh ELSE fh END)) th FROM b{k})")
        sql.append(f"c{k + 1} AS (SELECT image_id, w, h, tall, rx + CASE WHEN cut THEN tw ELSE 0 END rx, ry + CASE WHEN cut THEN 0 ELSE th END ry, rw - CASE WHEN cut THEN tw ELSE 0 END rw, rh - CASE WHEN cut THEN 0 ELSE th END rh, canvas_w, canvas_h FROM d{k})")
    every = " UNION ALL ".join(f"SELECT image_id, canvas_w, canvas_h, {k} step, rx x, ry y, tw tile_w, th tile_h, {turn} rotation, {flip} flip FROM d{k}" for k, (turn, flip, _) in enumerate(steps))
    return ", ".join(sql) + f", t AS ({every})"


@query(f"WITH {_placements_sql(0.7)} SELECT image_id, canvas_w, canvas_h, CAST(step AS INT) step, x, y, tile_w, tile_h, rotation, flip FROM t", "images")
def self_mosaic_placements(s, d):
    return lay.self_mosaic(fx.view(s, d, "images"))


def _pictures(s, d):
    """Sizes of the pictures of poses: those of orders of the same number."""
    return fx.view(s, d, "images").select("image_id", "width", "height")


_SWAP = ", ".join(map(str, kp.MIRROR))


@query(f"""WITH {_placements_sql(0.4)},
z AS (SELECT t.* REPLACE (step + 1 AS step), i.width, i.height FROM t JOIN images i USING (image_id) UNION ALL
 SELECT image_id, canvas_w, canvas_h, 0, 0, 0, width, height, 0, false, width, height FROM images JOIN (SELECT DISTINCT image_id, canvas_w, canvas_h FROM t) USING (image_id)),
s AS (SELECT *, greatest(1, CAST(round_even(canvas_w * (640 / greatest(canvas_w, canvas_h)::DOUBLE), 0) AS INT))::DOUBLE ow, greatest(1, CAST(round_even(canvas_h * (640 / greatest(canvas_w, canvas_h)::DOUBLE), 0) AS INT))::DOUBLE oh,
 tile_w / (CASE WHEN rotation IN (90, 270) THEN height ELSE width END)::DOUBLE sx, tile_h / (CASE WHEN rotation IN (90, 270) THEN width ELSE height END)::DOUBLE sy FROM z),
q AS (SELECT p.vec_id, p.image_id, p.obj_idx, p.class_id, s.* EXCLUDE (image_id), (cx - w / 2) ax, (cy - h / 2) ay, (cx + w / 2) bx, (cy + h / 2) b_y FROM pose_box p JOIN s USING (image_id)),
f AS (SELECT *, CASE WHEN flip THEN width - ax * width ELSE ax * width END fx1, CASE WHEN flip THEN width - bx * width ELSE bx * width END fx2, ay * height fy1, b_y * height fy2 FROM q),
r AS (SELECT *, CASE rotation WHEN 90 THEN fy1 WHEN 270 THEN height - fy1 ELSE fx1 END px1, CASE rotation WHEN 90 THEN fy2 WHEN 270 THEN height - fy2 ELSE fx2 END px2,
 CASE rotation WHEN 90 THEN width - fx1 WHEN 270 THEN fx1 ELSE fy1 END py1, CASE rotation WHEN 90 THEN width - fx2 WHEN 270 THEN fx2 ELSE fy2 END py2 FROM f),
g AS (SELECT *, (x + px1 * sx) * (ow / canvas_w) gx1, (x + px2 * sx) * (ow / canvas_w) gx2, (y + py1 * sy) * (oh / canvas_h) gy1, (y + py2 * sy) * (oh / canvas_h) gy2 FROM r),
c AS (SELECT *, greatest(0, least(gx1, gx2)) l, greatest(0, least(gy1, gy2)) tp, least(ow, greatest(gx1, gx2)) rt, least(oh, greatest(gy1, gy2)) bt FROM g),
k AS (SELECT * FROM c WHERE rt > l AND bt > tp AND rt - l >= 30 AND bt - tp >= 30),
n AS (SELECT image_id, min(step) stop FROM (SELECT image_id, unnest(range(7)) step FROM (SELECT DISTINCT image_id FROM k)) a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.image_id = a.image_id AND k.step = a.step) GROUP BY 1),
u AS (SELECT k.* FROM k JOIN n USING (image_id) WHERE step < stop)
SELECT u.step, u.image_id, u.obj_idx, u.class_id, {M('least(1, (l + rt) / 2 / ow)')} cx_u, {M('least(1, (tp + bt) / 2 / oh)')} cy_u, {M('least(1, (rt - l) / ow)')} w_u, {M('least(1, (bt - tp) / oh)')} h_u, CAST(j AS INT) k,
 {M("CASE WHEN p.x = 0 AND p.y = 0 AND p.v = 0 THEN 0 ELSE greatest(0, least(1, (u.x + (CASE rotation WHEN 90 THEN p.y * height WHEN 270 THEN height - p.y * height ELSE CASE WHEN flip THEN width - p.x * width ELSE p.x * width END END) * sx) * (ow / canvas_w) / ow)) END")} x_u,
 {M("CASE WHEN p.x = 0 AND p.y = 0 AND p.v = 0 THEN 0 ELSE greatest(0, least(1, (u.y + (CASE rotation WHEN 90 THEN width - p.x * width WHEN 270 THEN p.x * width ELSE p.y * height END) * sy) * (oh / canvas_h) / oh)) END")} y_u, {M('p.v')} v_u
FROM u, (SELECT unnest(range(17)) j, unnest([{_SWAP}]) partner) JOIN pose_kpts p ON p.vec_id = u.vec_id AND p.k = CASE WHEN flip THEN partner ELSE j END""", "images", "pose_box", "pose_kpts")
def self_mosaic_labels(s, d):
    """Poses on their image's mosaic of longest side 640: boxes under 30 pixels go, and with the first tile without a box the rest of the tiles."""
    placed = mo.self_mosaic_labels(fx.poses(s, d), _pictures(s, d), 0.4, 640, 30.0)
    rows = placed.select("step", "image_id", "obj_idx", "class_id", *BOX, F.posexplode("kpts").alias("k", "p"))
    return rows.select("step", "image_id", "obj_idx", "class_id", *[u(c).alias(f"{c}_u") for c in BOX], "k", u("p.x").alias("x_u"), u("p.y").alias("y_u"), u("p.v").alias("v_u"))


_TURN_X = "CASE rotation WHEN 90 THEN height - {y} WHEN 180 THEN width - {x} WHEN 270 THEN {y} ELSE {x} END"
_TURN_Y = "CASE rotation WHEN 90 THEN {x} WHEN 180 THEN height - {y} WHEN 270 THEN width - {x} ELSE {y} END"


@query(f"""WITH s0 AS (SELECT image_id // 4 mosaic_id, CAST(image_id % 4 AS INT) slot, image_id, width, height, CAST(image_id % 4 * 90 AS INT) rotation, CASE WHEN image_id % 2 = 1 THEN height ELSE width END rw, CASE WHEN image_id % 2 = 1 THEN width ELSE height END rh
 FROM images WHERE image_id IN (SELECT image_id FROM pose_box)),
s1 AS (SELECT *, max(rw) OVER (PARTITION BY mosaic_id) tw, max(rh) OVER (PARTITION BY mosaic_id) th, CAST(ceil((max(slot) OVER (PARTITION BY mosaic_id) + 1) / 2) AS INT) n FROM s0),
s2 AS (SELECT *, least(tw / rw::DOUBLE, th / rh::DOUBLE) sc FROM s1),
s3 AS (SELECT *, greatest(1, CAST(round_even(rw * sc, 0) AS INT)) nw, greatest(1, CAST(round_even(rh * sc, 0) AS INT)) nh FROM s2),
s AS (SELECT *, nw / rw::DOUBLE kx, nh / rh::DOUBLE ky, CAST(trunc((tw - nw) / 2) AS INT) px, CAST(trunc((th - nh) / 2) AS INT) py, slot % 2 * tw ox, slot // 2 * th oy, tw * 2 mw, th * n mh FROM s3),
b AS (SELECT p.*, s.* EXCLUDE (image_id), (cx - w / 2) * width ax, (cy - h / 2) * height ay, (cx + w / 2) * width bx, (cy + h / 2) * height b_y FROM pose_box p JOIN s USING (image_id)),
r AS (SELECT *, {_TURN_X.format(x='ax', y='ay')} x1, {_TURN_Y.format(x='ax', y='ay')} y1, {_TURN_X.format(x='bx', y='b_y')} x2, {_TURN_Y.format(x='bx', y='b_y')} y2 FROM b),
c AS (SELECT *, greatest(0, least(rw, least(x1, x2))) l, greatest(0, least(rh, least(y1, y2))) t, greatest(0, least(rw, greatest(x1, x2))) rt, greatest(0, least(rh, greatest(y1, y2))) bt FROM r),
e AS (SELECT *, CASE WHEN rotation = 0 THEN cx ELSE (l + rt) / 2 / rw END c1, CASE WHEN rotation = 0 THEN cy ELSE (t + bt) / 2 / rh END c2, CASE WHEN rotation = 0 THEN w ELSE (rt - l) / rw END c3, CASE WHEN rotation = 0 THEN h ELSE (bt - t) / rh END c4
 FROM c WHERE rotation = 0 OR (rt > l AND bt > t)),
f AS (SELECT * REPLACE (greatest(0, least(1, c1)) AS c1, greatest(0, least(1, c2)) AS c2, greatest(0, least(1, c3)) AS c3, greatest(0, least(1, c4)) AS c4) FROM e),
k AS (SELECT f.vec_id, p.k, p.v, {_TURN_X.format(x='p.x * width', y='p.y * height')} / rw kx0, {_TURN_Y.format(x='p.x * width', y='p.y * height')} / rh ky0, p.v > 0 AND NOT (p.x = 0 AND p.y = 0) ok, f.rotation, f.rw, f.rh, f.kx, f.ky, f.px, f.py, f.tw, f.th, f.ox, f.oy, f.mw, f.mh FROM f JOIN pose_kpts p ON p.vec_id = f.vec_id),
k1 AS (SELECT *, CASE WHEN rotation = 0 THEN greatest(0, least(1, kx0)) ELSE kx0 END hx, CASE WHEN rotation = 0 THEN greatest(0, least(1, ky0)) ELSE ky0 END hy FROM k),
k2 AS (SELECT *, ok AND (rotation = 0 OR (kx0 BETWEEN 0 AND 1 AND ky0 BETWEEN 0 AND 1)) AND NOT (hx = 0 AND hy = 0) stays FROM k1)
SELECT f.mosaic_id, f.slot, f.image_id, f.obj_idx, f.class_id, k2.k, CAST(f.mw AS INT) mosaic_w, CAST(f.mh AS INT) mosaic_h,
 {M('(greatest(0, least(1, (c1 * f.rw * f.kx + f.px) / f.tw)) * f.tw + f.ox) / f.mw')} cx_u, {M('(greatest(0, least(1, (c2 * f.rh * f.ky + f.py) / f.th)) * f.th + f.oy) / f.mh')} cy_u,
 {M('greatest(0, least(1, c3 * f.rw * f.kx / f.tw)) * f.tw / f.mw')} w_u, {M('greatest(0, least(1, c4 * f.rh * f.ky / f.th)) * f.th / f.mh')} h_u,
 {M('CASE WHEN stays THEN (greatest(0, least(1, (hx * f.rw * f.kx + f.px) / f.tw)) * f.tw + f.ox) / f.mw ELSE 0 END')} x_u, {M('CASE WHEN stays THEN (greatest(0, least(1, (hy * f.rh * f.ky + f.py) / f.th)) * f.th + f.oy) / f.mh ELSE 0 END')} y_u, {M('CASE WHEN stays THEN v ELSE 0 END')} v_u
FROM f JOIN k2 ON k2.vec_id = f.vec_id WHERE c3 > 0 AND c4 > 0""", "images", "pose_box", "pose_kpts")
def grid_mosaic_labels(s, d):
    """Four images a mosaic, two a row, each turned by another angle."""
    have = fx.view(s, d, "pose_box").select("image_id").distinct()
    slots = _pictures(s, d).join(have, "image_id").select(F.expr("image_id div 4").alias("mosaic_id"), (F.col("image_id") % 4).cast("int").alias("slot"), "image_id", "width", "height", (F.col("image_id") % 4 * 90).cast("int").alias("rotation"))
    rows = mo.grid_labels(fx.poses(s, d), slots, 2).select("mosaic_id", "slot", "image_id", "obj_idx", "class_id", "mosaic_w", "mosaic_h", *BOX, F.posexplode("kpts").alias("k", "p"))
    return rows.select("mosaic_id", "slot", "image_id", "obj_idx", "class_id", "k", F.col("mosaic_w").cast("int"), F.col("mosaic_h").cast("int"), *[u(c).alias(f"{c}_u") for c in BOX], u("p.x").alias("x_u"), u("p.y").alias("y_u"), u("p.v").alias("v_u"))


@query(f"""WITH n AS (SELECT vec_id, image_id, obj_idx, class_id, cx, cy, w, h, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE score END score FROM pose_box WHERE vec_id % 2 = 0),
f AS (SELECT vec_id, image_id, obj_idx, class_id, cx + 0.01 cx, cy - 0.01 cy, w, h, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE score END score FROM pose_box WHERE vec_id % 2 = 1),
j AS (SELECT n.*, f.vec_id f_id, f.class_id fc, f.cx fcx, f.cy fcy, f.w fw, f.h fh, f.score fs, coalesce(n.score, 1) wn, coalesce(f.score, 1) wf FROM n LEFT JOIN f ON n.image_id = f.image_id AND f.obj_idx = n.obj_idx + 1 AND n.vec_id % 3 > 0),
b AS (SELECT vec_id, f_id, image_id, class_id, CASE WHEN f_id IS NULL THEN cx ELSE (cx * wn + fcx * wf) / CASE WHEN wn + wf > 0 THEN wn + wf ELSE 1 END END cx, CASE WHEN f_id IS NULL THEN cy ELSE (cy * wn + fcy * wf) / CASE WHEN wn + wf > 0 THEN wn + wf ELSE 1 END END cy,
 CASE WHEN f_id IS NULL THEN wn ELSE greatest(wn, wf) END score FROM j UNION ALL SELECT NULL, vec_id, image_id, class_id, cx, cy, coalesce(score, 1) FROM f WHERE vec_id NOT IN (SELECT f_id FROM j WHERE f_id IS NOT NULL)),
k AS (SELECT b.*, coalesce(a.k, z.k) k, CASE WHEN a.k IS NULL THEN z.x WHEN z.k IS NULL THEN a.x WHEN a.v + z.v / 2 > 0 THEN (a.x * a.v + z.x * (z.v / 2)) / (a.v + z.v / 2) ELSE 0 END x, CASE WHEN a.k IS NULL THEN z.v / 2 WHEN z.k IS NULL THEN a.v ELSE greatest(a.v, z.v / 2) END v
 FROM b CROSS JOIN (SELECT unnest(range(17)) i) LEFT JOIN pose_kpts a ON a.vec_id = b.vec_id AND a.k = i LEFT JOIN pose_kpts z ON z.vec_id = b.f_id AND z.k = i AND i < 15)
SELECT image_id, CAST(class_id AS INT) class_id, CAST(k AS INT) k, {M('cx')} cx_u, {M('cy')} cy_u, {M('score')} score_u, {M('x')} x_u, {M('v')} v_u FROM k WHERE k IS NOT NULL""", "pose_box", "pose_kpts")
def flip_merge_poses(s, d):
    """Even rows are a run, odd ones its mirrored run, which sees 15 points with half the confidence; two in three of neighbours are matched."""
    p = fx.poses(s, d)
    n = p.where("vec_id % 2 = 0").withColumn("score", F.when(F.col("vec_id") % 5 != 0, F.col("score")))
    f = p.where("vec_id % 2 = 1").withColumns({"cx": F.col("cx") + F.lit(0.01), "cy": F.col("cy") - F.lit(0.01), "score": F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(F.col("score"))})
    f = f.withColumn("kpts", F.transform(F.slice("kpts", 1, 15), lambda q: kp.point(q["x"], q["y"], q["v"] / 2)))
    pairs = n.where("vec_id % 3 > 0").select("image_id", F.col("obj_idx").alias("a_idx"), (F.col("obj_idx") + 1).alias("b_idx"))
    pairs = pairs.join(f.select("image_id", F.col("obj_idx").alias("b_idx")), ["image_id", "b_idx"])
    m = export.flip_merge(n, f, pairs).select("image_id", F.col("class_id").cast("int"), "cx", "cy", "score", F.posexplode("kpts").alias("k", "q"))
    return m.select("image_id", "class_id", "k", u("cx").alias("cx_u"), u("cy").alias("cy_u"), u("score").alias("score_u"), u("q.x").alias("x_u"), u("q.v").alias("v_u"))

"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import keypoints as kp
from ..functions import urls
from ..operators import boxes as bx
from ..operators import dataset as ds
from ..operators import layout as lay
from ..operators import matching as mt
from ..operators import sequence as sq
from . import fixtures as fx

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracle: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _oracle[f.__name__] = fx.with_views(sql, *views)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


def M(e: str) -> str:
    return f"CAST(floor(({e}) * 1000000 + 0.5) AS BIGINT)"


def u(c) -> F.Column:
    return g.micro(F.col(c) if isinstance(c, str) else c)


def micros(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[u(v).alias(f"{v}_u") for v in values])


BOX = ["cx", "cy", "w", "h"]
_XYXY = "cx - w / 2 x1, cy - h / 2 y1, cx + w / 2 x2, cy + h / 2 y2"
_BOX_OUT = ", ".join(f"{M(c)} {c}_u" for c in BOX)


# --- boxes -------------------------------------------------------------------------------------
@query(f"SELECT image_id, obj_idx, {M('cx - w / 2')} x1_u, {M('cy - h / 2')} y1_u, {M('cx + w / 2')} x2_u, {M('cy + h / 2')} y2_u FROM boxes", "boxes")
def bbox_xyxy(s, d):
    return micros(bx.with_corners(fx.view(s, d, "boxes")), ["image_id", "obj_idx"], ["x1", "y1", "x2", "y2"])


_IOU = """CASE WHEN aa + bb - i > 0 THEN i / (aa + bb - i) ELSE 0 END"""


def _overlap(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"


def _area(a: str) -> str:
    return f"greatest(0, {a}.x2 - {a}.x1) * greatest(0, {a}.y2 - {a}.y1)"


@query(f"""WITH c AS (SELECT *, {_XYXY} FROM boxes),
p AS (SELECT a.image_id, a.obj_idx a_idx, b.obj_idx b_idx, {_overlap('a', 'b')} i, {_area('a')} aa, {_area('b')} bb
      FROM c a JOIN c b ON a.image_id = b.image_id AND a.obj_idx < b.obj_idx)
SELECT image_id, a_idx, b_idx, {M(_IOU)} iou_u FROM p""", "boxes")
def iou_pairs(s, d):
    return micros(bx.pairs(fx.view(s, d, "boxes")), ["image_id", "a_idx", "b_idx"], ["iou"])


_ENV = """e AS (SELECT b.image_id, width, height, min(least(greatest((cx - w / 2) * width, 0), width)) min_x, min(least(greatest((cy - h / 2) * height, 0), height)) min_y,
  max(least(greatest((cx + w / 2) * width, 0), width)) max_x, max(least(greatest((cy + h / 2) * height, 0), height)) max_y
  FROM boxes b JOIN images i ON b.image_id = i.image_id GROUP BY ALL)"""
_CROP = """c0 AS (SELECT image_id, width, height, least(CAST(trunc(greatest(0, min_x - 20)) AS INT), width - 1) l, least(CAST(trunc(greatest(0, min_y - 20)) AS INT), height - 1) t,
  CAST(trunc(least(width, max_x + 20)) AS INT) r, CAST(trunc(least(height, max_y + 20)) AS INT) b FROM e),
c AS (SELECT image_id, width, height, l "left", t top, greatest(r, l + 1) "right", greatest(b, t + 1) bottom FROM c0)"""


def _env(s, d):
    return bx.envelope(fx.view(s, d, "boxes"), fx.view(s, d, "images"))


@query(f"WITH {_ENV} SELECT image_id, {M('min_x')} min_x_u, {M('min_y')} min_y_u, {M('max_x')} max_x_u, {M('max_y')} max_y_u FROM e", "images", "boxes")
def envelope(s, d):
    return micros(_env(s, d), ["image_id"], ["min_x", "min_y", "max_x", "max_y"])


@query("""SELECT b.image_id, CAST(floor(min(least(greatest((cx - w / 2) * width, 0), width)) * 1000000 + 0.5) AS BIGINT) min_x_u,
 CAST(floor(max(least(greatest((cy + h / 2) * height, 0), height)) * 1000000 + 0.5) AS BIGINT) max_y_u
 FROM boxes b JOIN images i ON b.image_id = i.image_id WHERE least(abs(w) * width, abs(h) * height) >= 24 GROUP BY 1""", "images", "boxes")
def envelope_without_tiny(s, d):
    return micros(bx.envelope(fx.view(s, d, "boxes"), fx.view(s, d, "images"), 24.0), ["image_id"], ["min_x", "max_y"])


@query(f'WITH {_ENV}, {_CROP} SELECT image_id, "left", top, "right", bottom FROM c', "images", "boxes")
def envelope_margin_crop(s, d):
    return bx.margin_crop(_env(s, d)).select("image_id", "left", "top", "right", "bottom")


@query(f"""WITH {_ENV}, {_CROP},
k AS (SELECT b.image_id, obj_idx, class_id, "right" - "left" cw, bottom - top ch,
 least(greatest(least(greatest((cx - w / 2) * width, 0), width) - "left", 0), "right" - "left") x1, least(greatest(least(greatest((cy - h / 2) * height, 0), height) - top, 0), bottom - top) y1,
 least(greatest(least(greatest((cx + w / 2) * width, 0), width) - "left", 0), "right" - "left") x2, least(greatest(least(greatest((cy + h / 2) * height, 0), height) - top, 0), bottom - top) y2
 FROM boxes b JOIN c ON b.image_id = c.image_id),
n AS (SELECT image_id, obj_idx, class_id, (x1 + x2) / 2 / cw cx, (y1 + y2) / 2 / ch cy, (x2 - x1) / cw w, (y2 - y1) / ch h FROM k WHERE x2 > x1 AND y2 > y1),
o AS (SELECT image_id, obj_idx, class_id, least(greatest(cx, 0), 1) cx, least(greatest(cy, 0), 1) cy, least(greatest(w, 0), 1) w, least(greatest(h, 0), 1) h FROM n)
SELECT image_id, obj_idx, class_id, {_BOX_OUT} FROM o""", "images", "boxes")
def crop_rewrite(s, d):
    return micros(bx.rewrite_for_crop(fx.view(s, d, "boxes"), bx.margin_crop(_env(s, d))), ["image_id", "obj_idx", "class_id"], BOX)


@query(f"""WITH {_ENV}, {_CROP},
o AS (SELECT b.image_id, obj_idx, class_id, least(greatest((cx * width - "left") / ("right" - "left"), 0), 1) cx, least(greatest((cy * height - top) / (bottom - top), 0), 1) cy,
 least(greatest(w * width / ("right" - "left"), 0), 1) w, least(greatest(h * height / (bottom - top), 0), 1) h FROM boxes b JOIN c ON b.image_id = c.image_id)
SELECT image_id, obj_idx, class_id, {_BOX_OUT} FROM o""", "images", "boxes")
def crop_recentre(s, d):
    return micros(bx.recentre_for_crop(fx.view(s, d, "boxes"), bx.margin_crop(_env(s, d))), ["image_id", "obj_idx", "class_id"], BOX)


_LADDER = [(0, 0, "true", 1, 1), (1, 1, "false", 0, 0)] + [(2 + 6 * (not wide) + 2 * k + n, 2 + 3 * (not wide) + k, "true" if wide else "false", a, b) for wide in (True, False) for k, pair in enumerate(bx.LADDER) for n, (a, b) in enumerate(pair)]


@query(f"""WITH {_ENV},
p AS (SELECT *, max_x - min_x bw, max_y - min_y bh FROM e), q AS (SELECT *, bw > 0 AND bh > 0 whole FROM p),
c AS (SELECT q.*, nth, step, a, b, CASE WHEN wide AND whole THEN greatest(0, least(width, min_x - bw * 0.2::DOUBLE)) ELSE min_x END x1, CASE WHEN wide AND whole THEN greatest(0, least(height, min_y - bh * 0.2::DOUBLE)) ELSE min_y END y1,
 CASE WHEN wide AND whole THEN greatest(0, least(width, max_x + bw * 0.2::DOUBLE)) ELSE max_x END x2, CASE WHEN wide AND whole THEN greatest(0, least(height, max_y + bh * 0.2::DOUBLE)) ELSE max_y END y2
 FROM q CROSS JOIN (VALUES {", ".join(map(str, _LADDER)).replace("'", "")}) l(nth, step, wide, a, b)),
t0 AS (SELECT *, x2 - x1 rw, y2 - y1 rh, a::DOUBLE / greatest(1, b) ratio, least(width, height)::DOUBLE side FROM c),
t1 AS (SELECT *, CASE WHEN a = 0 THEN side ELSE greatest(rw, rh * ratio) END w0 FROM t0),
t2 AS (SELECT *, CASE WHEN a = 0 THEN side WHEN w0 / ratio < rh THEN rh * ratio ELSE w0 END tw, CASE WHEN a = 0 THEN side WHEN w0 / ratio < rh THEN rh ELSE w0 / ratio END th, CASE WHEN a = 0 THEN rw <= side AND rh <= side ELSE rw > 0 AND rh > 0 END fits FROM t1),
s0 AS (SELECT *, greatest(0, x2 - tw) l0, least(x1, width - tw) l9, greatest(0, y2 - th) t0, least(y1, height - th) t9 FROM t2 WHERE fits AND tw > 0 AND th > 0 AND tw <= width AND th <= height),
s1 AS (SELECT * REPLACE (CASE WHEN l0 > l9 AND l0 - l9 <= 1e-6 THEN l9 ELSE l0 END AS l0, CASE WHEN t0 > t9 AND t0 - t9 <= 1e-6 THEN t9 ELSE t0 END AS t0) FROM s0),
s2 AS (SELECT *, greatest(l0, least(l9, (x1 + x2) / 2 - tw / 2)) lx, greatest(t0, least(t9, (y1 + y2) / 2 - th / 2)) ty FROM s1 WHERE l0 <= l9 AND t0 <= t9),
s3 AS (SELECT *, greatest(0, least(width - 1, CAST(floor(lx) AS INT))) li, greatest(0, least(height - 1, CAST(floor(ty) AS INT))) ti FROM s2),
s4 AS (SELECT *, greatest(li + 1, least(width, CAST(ceil(lx + tw) AS INT))) ri, greatest(ti + 1, least(height, CAST(ceil(ty + th) AS INT))) bi FROM s3),
o AS (SELECT *, greatest(1, a) ra, greatest(1, b) rb FROM s4 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY step, CAST(ri - li AS BIGINT) * (bi - ti), nth) = 1),
u0 AS (SELECT e.image_id, e.width, e.height, li, ti, ri, bi, ra, rb, CAST(floor(least((ri - li) / ra::DOUBLE, (bi - ti) / rb::DOUBLE)) AS INT) un FROM e LEFT JOIN o ON o.image_id = e.image_id),
u1 AS (SELECT *, un - un % 2 unit, (un - un % 2) * ra nw, (un - un % 2) * rb nh FROM u0),
u2 AS (SELECT *, ra IS NOT NULL AND ri - li > 1 AND bi - ti > 1 AND unit >= 1 use_, greatest(0, least(width - nw, CAST(round_even((li + ri) / 2 - nw / 2, 0) AS INT))) nl, greatest(0, least(height - nh, CAST(round_even((ti + bi) / 2 - nh / 2, 0) AS INT))) nt FROM u1)
SELECT image_id, width, height, coalesce(CASE WHEN use_ THEN nl ELSE li END, -1) AS "left", coalesce(CASE WHEN use_ THEN nt ELSE ti END, -1) top, coalesce(CASE WHEN use_ THEN nl + nw ELSE ri END, -1) AS "right",
 coalesce(CASE WHEN use_ THEN nt + nh ELSE bi END, -1) bottom, coalesce(ra || ':' || rb, '') ratio FROM u2""", "images", "boxes")
def envelope_pad_ratio_crop(s, d):
    """-1 and no text where no crop fits."""
    c = bx.even_ratio_crop(bx.ratio_crop(_env(s, d)))
    return c.select("image_id", "width", "height", *[F.coalesce(k, F.lit(-1)).alias(k) for k in ("left", "top", "right", "bottom")], F.coalesce("ratio", F.lit("")).alias("ratio"))


def _turn_sql(angle: int) -> str:
    p = {90: ("height - {y}", "{x}"), 180: ("width - {x}", "height - {y}"), 270: ("{y}", "width - {x}")}[angle]
    X1, Y1, X2, Y2 = "(cx - w / 2) * width", "(cy - h / 2) * height", "(cx + w / 2) * width", "(cy + h / 2) * height"
    a, b = [q.format(x=X1, y=Y1) for q in p], [q.format(x=X2, y=Y2) for q in p]
    nw, nh = ("height", "width") if angle in (90, 270) else ("width", "height")
    return f"""WITH k AS (SELECT b.image_id, obj_idx, class_id, {nw} nw, {nh} nh, least(greatest(least({a[0]}, {b[0]}), 0), {nw}) l, least(greatest(least({a[1]}, {b[1]}), 0), {nh}) t,
 least(greatest(greatest({a[0]}, {b[0]}), 0), {nw}) r, least(greatest(greatest({a[1]}, {b[1]}), 0), {nh}) m FROM boxes b JOIN images i ON b.image_id = i.image_id),
n AS (SELECT image_id, obj_idx, class_id, least(greatest((l + r) / 2 / nw, 0), 1) cx, least(greatest((t + m) / 2 / nh, 0), 1) cy, least(greatest((r - l) / nw, 0), 1) w, least(greatest((m - t) / nh, 0), 1) h FROM k WHERE r > l AND m > t)
SELECT image_id, obj_idx, class_id, {_BOX_OUT} FROM n"""


def _turned(angle: int):
    def run(s, d):
        return micros(bx.turn(fx.view(s, d, "boxes"), fx.view(s, d, "images"), angle), ["image_id", "obj_idx", "class_id"], BOX)

    run.__name__ = f"rotate{angle}"
    query(_turn_sql(angle), "images", "boxes")(run)


for _angle in (90, 180, 270):
    _turned(_angle)


@query(f"""WITH k AS (SELECT b.*, copy, height > width tall FROM boxes b JOIN images i ON b.image_id = i.image_id CROSS JOIN (VALUES (0), (1)) v(copy)),
x AS (SELECT * REPLACE (CASE WHEN copy = 1 THEN 1 - cx ELSE cx END AS cx) FROM k),
n AS (SELECT image_id, obj_idx, class_id, copy, CASE WHEN tall THEN cx * 0.5::DOUBLE + copy * 0.5::DOUBLE ELSE cx END cx, CASE WHEN tall THEN cy ELSE cy * 0.5::DOUBLE + copy * 0.5::DOUBLE END cy,
 CASE WHEN tall THEN w * 0.5::DOUBLE ELSE w END w, CASE WHEN tall THEN h ELSE h * 0.5::DOUBLE END h FROM x)
SELECT image_id, obj_idx, class_id, copy, {_BOX_OUT} FROM n""", "images", "boxes")
def extend_flip(s, d):
    return micros(bx.extend_with_flip(fx.view(s, d, "boxes"), fx.view(s, d, "images")), ["image_id", "obj_idx", "class_id", "copy"], BOX)


@query("SELECT b.image_id, obj_idx FROM boxes b JOIN images i ON b.image_id = i.image_id WHERE w * width >= 20 AND h * height >= 20", "images", "boxes")
def min_bbox_filter(s, d):
    return bx.drop_small(fx.view(s, d, "boxes"), fx.view(s, d, "images")).select("image_id", "obj_idx")


@query("""SELECT image_id, obj_idx FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, obj_idx) r FROM boxes WHERE class_id = 0) WHERE r = 1""", "boxes")
def largest_pose(s, d):
    return bx.largest(fx.view(s, d, "boxes")).select("image_id", "obj_idx")


@query("""WITH r AS (SELECT image_id, obj_idx, w * h a, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, obj_idx) r FROM boxes WHERE class_id = 0),
f AS (SELECT image_id, obj_idx i1, a FROM r WHERE r = 1 AND a >= 0.02), s AS (SELECT image_id, obj_idx i2, a FROM r WHERE r = 2)
SELECT f.image_id, i1, i2 FROM f JOIN s ON f.image_id = s.image_id WHERE s.a >= 0.45 * f.a AND s.a >= 0.02""", "boxes")
def top2_persons(s, d):
    b = bx.largest(fx.view(s, d, "boxes"), 2).withColumn("a", F.col("w") * F.col("h"))
    p = b.groupBy("image_id").agg(*[F.max(F.when(F.col("place") == k, F.col(c))).alias(f"{n}{k}") for k in (1, 2) for c, n in (("obj_idx", "i"), ("a", "a"))])
    return p.where("a1 >= 0.02 and a2 >= 0.02 and a2 >= 0.45 * a1").select("image_id", "i1", "i2")


# --- datasets ----------------------------------------------------------------------------------
def _labels(s, d):
    return fx.view(s, d, "boxes").select("image_id").distinct()


@query("SELECT DISTINCT image_id FROM boxes WHERE image_id NOT IN (SELECT image_id FROM portraits)", "portraits", "boxes")
def orphan_labels(s, d):
    """Labels of all lines against portraits of all customers, whose numbers they share in part."""
    return ds.orphan_labels(_labels(s, d), fx.view(s, d, "portraits"), "image_id")


@query("SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM boxes)", "images", "boxes")
def unlabeled_images(s, d):
    return ds.unlabelled(fx.view(s, d, "images"), _labels(s, d), "image_id").select("image_id")


@query("SELECT image_id FROM images WHERE image_id IN (SELECT image_id FROM boxes)", "images", "boxes")
def paired_images(s, d):
    return ds.paired(fx.view(s, d, "images"), _labels(s, d), "image_id").select("image_id")


@query("SELECT count(*) missing FROM (SELECT image_id FROM boxes EXCEPT SELECT image_id FROM portraits)", "portraits", "boxes")
def stem_except(s, d):
    return fx.view(s, d, "boxes").select("image_id").subtract(fx.view(s, d, "portraits").select("image_id")).agg(F.count("*").alias("missing"))


@query("""SELECT image_id, 'move' "action" FROM (SELECT DISTINCT image_id FROM boxes) WHERE image_id NOT IN (SELECT image_id FROM portraits)
UNION ALL SELECT image_id, 'create' FROM portraits WHERE image_id NOT IN (SELECT image_id FROM boxes)""", "portraits", "boxes")
def cleanup_plan(s, d):
    return ds.cleanup_plan(fx.view(s, d, "portraits"), _labels(s, d), "image_id")


_SPLIT = """n AS (SELECT *, count(*) OVER (PARTITION BY source) c FROM images),
o AS (SELECT image_id, row_number() OVER (ORDER BY source, image_id) ordinal FROM n WHERE c >= 64),
sp AS (SELECT n.image_id, source, ordinal, CASE WHEN ordinal % 8 = 0 THEN 'val' ELSE 'train' END split FROM n LEFT JOIN o USING (image_id))"""


def _split(s, d):
    return ds.split_every(fx.view(s, d, "images"), "source", "image_id")


@query(f"WITH {_SPLIT} SELECT image_id, source, ordinal, split FROM sp", "images")
def split_every_8th(s, d):
    return _split(s, d).select("image_id", "source", "ordinal", "split")


@query(f"""WITH {_SPLIT}, b AS (SELECT image_id, count(*) n FROM boxes GROUP BY 1)
SELECT source, split, count(*) images, CAST(coalesce(sum(n), 0) AS BIGINT) objects FROM sp LEFT JOIN b USING (image_id) GROUP BY ROLLUP (source, split)""", "images", "boxes")
def instances_rollup(s, d):
    return ds.counts(_split(s, d), fx.view(s, d, "boxes"), "source", "image_id")


@query(f"""WITH {_SPLIT}, b AS (SELECT image_id, count(*) n FROM boxes GROUP BY 1)
SELECT source, CAST(coalesce(sum(n) FILTER (split = 'train'), 0) AS BIGINT) train, CAST(coalesce(sum(n) FILTER (split = 'val'), 0) AS BIGINT) val FROM sp LEFT JOIN b USING (image_id) GROUP BY 1""", "images", "boxes")
def instances_by_source_split(s, d):
    n = fx.view(s, d, "boxes").groupBy("image_id").agg(F.count("*").alias("n"))
    return _split(s, d).join(n, "image_id", "left").groupBy("source").pivot("split", ["train", "val"]).agg(F.coalesce(F.sum("n"), F.lit(0)))


@query("""SELECT image_id, lpad(CAST(row_number() OVER (ORDER BY image_id) + 94 AS VARCHAR), length(CAST(count(*) OVER () + 94 AS VARCHAR))::INT, '0') new_name FROM images""", "images")
def sequential_rename(s, d):
    return ds.rename_plan(fx.view(s, d, "images"), "image_id", 95).select("image_id", "new_name")


@query("SELECT image_id, row_number() OVER (ORDER BY image_id) coco_id, width, height FROM images", "images")
def coco_images(s, d):
    return ds.numbered(fx.view(s, d, "images"), ["image_id"], "coco_id").select("image_id", F.col("coco_id").cast("long"), "width", "height")


@query(f"""WITH k AS (SELECT b.image_id, obj_idx, class_id, least(greatest((cx - w / 2) * width, 0), width) x1, least(greatest((cy - h / 2) * height, 0), height) y1,
 least(greatest((cx + w / 2) * width, 0), width) x2, least(greatest((cy + h / 2) * height, 0), height) y2 FROM boxes b JOIN images i ON b.image_id = i.image_id)
SELECT row_number() OVER (ORDER BY image_id, obj_idx) annotation_id, image_id, class_id + 1 category_id, {M('x1')} left_u, {M('y1')} top_u, {M('x2 - x1')} box_w_u, {M('y2 - y1')} box_h_u, {M('(x2 - x1) * (y2 - y1)')} area_u
FROM k WHERE x2 > x1 AND y2 > y1""", "images", "boxes")
def coco_annotations(s, d):
    rows = ds.numbered(bx.exported_box(fx.view(s, d, "boxes"), fx.view(s, d, "images")), ["image_id", "obj_idx"], "annotation_id")
    rows = rows.select(F.col("annotation_id").cast("long").alias("annotation_id"), "image_id", (F.col("class_id") + 1).alias("category_id"), "left", "top", "box_w", "box_h", "area")
    return micros(rows, ["annotation_id", "image_id", "category_id"], ["left", "top", "box_w", "box_h", "area"])


@query("SELECT DISTINCT class_id + 1 category_id, CASE class_id WHEN 0 THEN 'person' ELSE 'class_' || class_id END name FROM boxes", "boxes")
def coco_categories(s, d):
    return ds.categories(fx.view(s, d, "boxes"), ["person"])


@query("""SELECT CAST(place AS INT) place, p.prefix, count(o.o_orderkey) n FROM (VALUES (0, '1-URGENT'), (1, '3-MEDIUM'), (2, 'none')) p(place, prefix) LEFT JOIN orders o ON o.o_orderpriority = p.prefix GROUP BY 1, 2""")
def prefix_counts(s, d):
    return ds.prefix_counts(fx.table(s, d, "orders"), "o_orderpriority", ["1-URGENT", "3-MEDIUM", "none"])


@query("SELECT max(CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT)) + 1 next_index FROM customer")
def next_index(s, d):
    return ds.next_index(fx.table(s, d, "customer"), "c_name", "[^0-9]*")


# --- keypoints ---------------------------------------------------------------------------------
def _points(df: DataFrame, column: str = "kpts") -> DataFrame:
    p = df.select("vec_id", F.posexplode(column).alias("k", "p"))
    return p.select("vec_id", "k", u("p.x").alias("x_u"), u("p.y").alias("y_u"), u("p.v").alias("v_u"))


def _point_sql(x: str, y: str, v: str, source: str) -> str:
    return f"SELECT vec_id, k, {M(x)} x_u, {M(y)} y_u, {M(v)} v_u FROM {source}"


@query(f"""SELECT vec_id, k, {M("CASE WHEN c >= 0.4 THEN x ELSE 0 END")} x_u, {M("CASE WHEN c >= 0.4 THEN y ELSE 0 END")} y_u, {M("CASE WHEN c >= 0.4 THEN 2 ELSE 0 END")} v_u
FROM (SELECT *, CAST(k AS DOUBLE) / 16 c FROM pose_kpts)""", "pose_kpts")
def vis_binarize(s, d):
    k = F.transform("kpts", lambda p, i: kp.binarize(kp.point(p["x"], p["y"], i / F.lit(16.0)), 0.4))
    return _points(fx.poses(s, d).withColumn("kpts", k))


@query("""SELECT event_id, CASE WHEN value <= 0 THEN 0 WHEN value / 100 <= 1 THEN CASE WHEN value / 100 >= 0.5 THEN 2 ELSE 0 END ELSE least(2, greatest(0, CAST(round_even(value / 100, 0) AS INT))) END v FROM events""")
def vis_to_coco(s, d):
    return fx.table(s, d, "events").select("event_id", kp.exported_visibility(F.col("value") / 100).alias("v"))


@query(f"""SELECT vec_id, k, {M('CASE WHEN k < 17 THEN x ELSE 0 END')} x_u, {M('CASE WHEN k < 17 THEN y ELSE 0 END')} y_u, {M('CASE WHEN k < 17 THEN v ELSE 0 END')} v_u
FROM (SELECT * FROM pose_kpts UNION ALL SELECT vec_id, image_id, obj_idx, k + 17, x, y, v FROM pose_kpts WHERE k < 3)""", "pose_kpts")
def kpt_pad_truncate(s, d):
    return _points(fx.poses(s, d).withColumn("kpts", kp.pad(F.col("kpts"), 20)))


_VALID = "v > 0 AND NOT (x = 0 AND y = 0)"
_FACE_BOX = f"(SELECT vec_id, image_id, obj_idx, min(x) x1, min(y) y1, max(x) x2, max(y) y2 FROM pose_kpts WHERE k < 5 AND {_VALID} GROUP BY ALL)"


@query(f"SELECT vec_id, {M('x1')} x1_u, {M('y1')} y1_u, {M('x2')} x2_u, {M('y2')} y2_u FROM {_FACE_BOX} WHERE x2 > x1 AND y2 > y1", "pose_kpts")
def face_envelope(s, d):
    e = fx.poses(s, d).select("vec_id", kp.face_envelope(F.col("kpts")).alias("b")).where("b is not null").select("vec_id", "b.*")
    return micros(e, ["vec_id"], ["x1", "y1", "x2", "y2"])


@query(f"SELECT vec_id, {M('(x1 + x2) / 2')} x_u, {M('(y1 + y2) / 2')} y_u FROM {_FACE_BOX}", "pose_kpts")
def face_middle(s, d):
    e = fx.poses(s, d).select("vec_id", kp.face_middle(F.col("kpts")).alias("m")).where("m is not null").select("vec_id", "m.*")
    return micros(e, ["vec_id"], ["x", "y"])


@query("""SELECT vec_id, CAST(floor(list_sum(list(x ORDER BY k)) / count(*) * 1000 + 0.5) AS BIGINT) x_m, CAST(floor(list_sum(list(y ORDER BY k)) / count(*) * 1000 + 0.5) AS BIGINT) y_m FROM pose_kpts WHERE k < 5 AND v > 0 GROUP BY 1""", "pose_kpts")
def face_centroid(s, d):
    e = fx.poses(s, d).select("vec_id", kp.face_mean(F.col("kpts")).alias("m")).where("m is not null")
    return e.select("vec_id", F.floor(F.col("m.x") * 1000 + 0.5).alias("x_m"), F.floor(F.col("m.y") * 1000 + 0.5).alias("y_m"))


_PAIRED = """m AS (SELECT p.vec_id, p.k, p.x, p.y, CAST(p.v AS DOUBLE) v, f.x fx, f.y fy, CAST(f.v AS DOUBLE) fv FROM pose_kpts p JOIN face_kpts f ON p.vec_id = f.vec_id AND p.k = f.k)"""


def _paired(s, d):
    return fx.poses(s, d).join(fx.faces(s, d).select("vec_id", F.col("kpts").alias("face")), "vec_id")


@query(f"""WITH {_PAIRED}, o AS (SELECT vec_id, k, fv > 0 AND NOT (fx = 0 AND fy = 0) b, v > 0 AND NOT (x = 0 AND y = 0) a, x, y, v, fx, fy, fv FROM m)
SELECT vec_id, k, {M('CASE WHEN NOT b THEN 0 WHEN NOT a THEN fx ELSE x * 0.75::DOUBLE + fx * 0.25::DOUBLE END')} x_u, {M('CASE WHEN NOT b THEN 0 WHEN NOT a THEN fy ELSE y * 0.75::DOUBLE + fy * 0.25::DOUBLE END')} y_u, {M('CASE WHEN NOT b THEN 0 ELSE fv END')} v_u FROM o""", "pose_kpts", "face_kpts")
def face_merge_weighted(s, d):
    return _points(_paired(s, d).withColumn("kpts", F.slice(kp.blend_face(F.col("kpts"), F.col("face"), 0.25), 1, 5)))


@query(f"""WITH {_PAIRED} SELECT vec_id, k, {M('CASE WHEN fv <= 0 THEN 0 WHEN v <= 0 THEN fx ELSE (x + fx) / 2 END')} x_u, {M('CASE WHEN fv <= 0 THEN 0 WHEN v <= 0 THEN fy ELSE (y + fy) / 2 END')} y_u,
 {M('CASE WHEN fv <= 0 THEN 0 WHEN v <= 0 THEN fv ELSE (v + fv) / 2 END')} v_u FROM m""", "pose_kpts", "face_kpts")
def face_merge_avg(s, d):
    return _points(_paired(s, d).withColumn("kpts", F.slice(kp.average_face(F.col("kpts"), F.col("face")), 1, 5)))


@query(f"""WITH {_PAIRED} SELECT k, count(*) n, CAST(floor(avg(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))) * 1000 + 0.5) AS BIGINT) mean_m
FROM m WHERE v > 0 AND NOT (x = 0 AND y = 0) AND fv > 0 AND NOT (fx = 0 AND fy = 0) GROUP BY 1""", "pose_kpts", "face_kpts")
def kpt_deviation_stats(s, d):
    p = _paired(s, d).select(F.posexplode(F.arrays_zip(kp.face(F.col("kpts")).alias("a"), F.col("face").alias("b"))).alias("k", "z"))
    p = p.select("k", F.col("z")["0"].alias("a"), F.col("z")["face"].alias("b")) if "0" in p.schema["z"].dataType.names else p.select("k", F.col("z.a").alias("a"), F.col("z.b").alias("b"))
    p = p.where(kp.valid(F.col("a")) & kp.valid(F.col("b")))
    return p.groupBy("k").agg(F.count("*").alias("n"), F.floor(F.avg(g.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))) * 1000 + 0.5).alias("mean_m"))


_PBOX = f"(SELECT *, {_XYXY} FROM pose_box)"


@query(f"""SELECT p.vec_id, count(*) FILTER ({_VALID} AND x >= x1 AND x <= x2 AND y >= y1 AND y <= y2) inside, count(*) FILTER ({_VALID}) valid FROM pose_kpts p JOIN {_PBOX} b ON p.vec_id = b.vec_id GROUP BY 1""", "pose_box", "pose_kpts")
def inside_ratio(s, d):
    return fx.poses(s, d).select("vec_id", kp.inside_counts(F.col("kpts"), bx.corners()).alias("c")).select("vec_id", F.col("c.inside").cast("long").alias("inside"), F.col("c.valid").cast("long").alias("valid"))


_IN = "x >= x1 AND x <= x2 AND y >= y1 AND y <= y2"


@query(f"""SELECT p.vec_id, k, {M(f'CASE WHEN {_IN} THEN x ELSE 0 END')} x_u, {M(f'CASE WHEN {_IN} THEN y ELSE 0 END')} y_u, {M(f'CASE WHEN {_IN} THEN v ELSE 0 END')} v_u FROM pose_kpts p JOIN {_PBOX} b ON p.vec_id = b.vec_id""", "pose_box", "pose_kpts")
def drop_outside_bbox(s, d):
    return _points(fx.poses(s, d).withColumn("kpts", kp.zero_outside(F.col("kpts"), bx.corners())))


@query(f"""WITH j(a, b) AS (VALUES {', '.join(map(str, kp.JOINTS))}), other AS (SELECT vec_id + 1 vec_id, k, x, y, v FROM pose_kpts)
SELECT p.vec_id, p.k, {M('coalesce(o.x, p.x)')} x_u, {M('coalesce(o.y, p.y)')} y_u, {M('coalesce(o.v, p.v)')} v_u
FROM pose_kpts p LEFT JOIN j ON p.k = j.b LEFT JOIN other o ON o.vec_id = p.vec_id AND o.k = j.a WHERE p.vec_id - 1 IN (SELECT vec_id FROM embeddings)""", "pose_kpts")
def mpii_replace(s, d):
    p = fx.poses(s, d)
    other = p.select((F.col("vec_id") + 1).alias("vec_id"), F.col("kpts").alias("sixteen"))
    return _points(p.join(other, "vec_id").withColumn("kpts", kp.replace_joints(F.col("kpts"), F.col("sixteen"))))


@query(f"""WITH f(a, b) AS (VALUES {', '.join(f'({i}, {m})' for i, m in enumerate(kp.MIRROR))})
SELECT p.vec_id, f.a k, {M('CASE WHEN x = 0 AND y = 0 AND v = 0 THEN 0 ELSE 1 - x END')} x_u, {M('y')} y_u, {M('v')} v_u FROM pose_kpts p JOIN f ON p.k = f.b""", "pose_kpts")
def hflip_kpts(s, d):
    return _points(fx.poses(s, d).withColumn("kpts", kp.mirrored(F.col("kpts"))))


@query("""WITH l AS (SELECT vec_id, x, y FROM pose_kpts WHERE k = 1), r AS (SELECT vec_id, x, y FROM pose_kpts WHERE k = 2)
SELECT l.vec_id, CAST(floor(degrees(atan2((r.y - l.y) * 480, (r.x - l.x) * 640)) * 1000 + 0.5) AS BIGINT) tilt_m FROM l JOIN r ON l.vec_id = r.vec_id""", "pose_kpts")
def eye_tilt(s, d):
    return fx.poses(s, d).select("vec_id", F.floor(kp.eye_tilt(F.col("kpts"), F.lit(640), F.lit(480)) * 1000 + 0.5).alias("tilt_m"))


@query(f"""WITH e(edge, a, b) AS (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(kp.EDGES))})
SELECT p.vec_id, edge, {M('p.x')} x1_u, {M('p.y')} y1_u, {M('q.x')} x2_u, {M('q.y')} y2_u FROM e JOIN pose_kpts p ON p.k = e.a JOIN pose_kpts q ON q.k = e.b AND q.vec_id = p.vec_id WHERE p.v > 0 AND q.v > 0""", "pose_kpts")
def skeleton_edges(s, d):
    e = fx.poses(s, d).select("vec_id", F.explode(kp.edges(F.col("kpts"))).alias("e")).select("vec_id", "e.*")
    return micros(e, ["vec_id", "edge"], ["x1", "y1", "x2", "y2"])


# --- matching ----------------------------------------------------------------------------------
def _anchors(df: DataFrame) -> DataFrame:
    m = kp.face_middle(F.col("kpts"))
    return df.select("image_id", "obj_idx", m["x"].alias("x"), m["y"].alias("y"))


def _greedy_sql(pairs: str, key: str, out: str = "") -> str:
    """Base objects 0 to 3 of an image, in order, take what is left. pairs: image_id, bi, oi and what ``key`` orders by."""
    ctes, taken = [f"c AS ({pairs})"], []
    for i in range(4):
        left = " ".join(f"AND NOT EXISTS (SELECT 1 FROM m{k} WHERE m{k}.image_id = c.image_id AND m{k}.oi = c.oi)" for k in range(i))
        ctes.append(f"m{i} AS (SELECT * FROM c WHERE bi = {i} {left} QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {key}, oi) = 1)")
        taken.append(f"SELECT image_id, bi base_idx, oi other_idx{out} FROM m{i}")
    return f"{', '.join(ctes)} {' UNION ALL '.join(taken)}"


def _face_sql(table: str, name: str) -> str:
    return f"""{name} AS (SELECT image_id, obj_idx, min(x) x1, min(y) y1, max(x) x2, max(y) y2 FROM {table} WHERE k < 5 AND {_VALID} GROUP BY 1, 2)"""


@query(f"""WITH {_face_sql('pose_kpts', 'a')}, {_face_sql('face_kpts', 'b')},
{_greedy_sql("SELECT a.image_id, a.obj_idx bi, b.obj_idx oi, sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) * ((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) * ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2)) dd FROM a JOIN b ON a.image_id = b.image_id", "dd", f", {M('dd')} score_u")}""", "pose_kpts", "face_kpts")
def greedy_nearest_face(s, d):
    return micros(mt.nearest_once(_anchors(fx.poses(s, d)), _anchors(fx.faces(s, d))), ["image_id", "base_idx", "other_idx"], ["score"])


def _face_boxes(df: DataFrame) -> DataFrame:
    b = kp.face_envelope(F.col("kpts"))
    return df.select("image_id", "obj_idx", *[b[c].alias(c) for c in ("x1", "y1", "x2", "y2")])


_IOU_PAIRS = f"""SELECT image_id, bi, oi, iou, dd FROM (SELECT *, {_IOU} iou FROM (SELECT a.image_id, a.obj_idx bi, b.obj_idx oi, {_overlap('a', 'b')} i, {_area('a')} aa, {_area('b')} bb,
 sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) dd FROM a JOIN b ON a.image_id = b.image_id)) WHERE iou >= 0.2 OR dd <= 0.05"""


@query(f"""WITH {_face_sql('pose_kpts', 'a0')}, {_face_sql('face_kpts', 'b0')}, a AS (SELECT * FROM a0 WHERE x2 > x1 AND y2 > y1), b AS (SELECT * FROM b0 WHERE x2 > x1 AND y2 > y1),
{_greedy_sql(_IOU_PAIRS, "iou < 0.2, CASE WHEN iou >= 0.2 THEN -iou ELSE dd END")}""", "pose_kpts", "face_kpts")
def greedy_iou_face(s, d):
    return mt.overlap_once(_face_boxes(fx.poses(s, d)), _face_boxes(fx.faces(s, d))).select("image_id", "base_idx", "other_idx")


@query(f"""WITH n AS (SELECT b.image_id, b.obj_idx bi, k.obj_idx oi, count(*) FILTER ({_VALID}) seen, count(*) FILTER ({_VALID} AND x >= x1 AND x <= x2 AND y >= y1 AND y <= y2) hit
 FROM {_PBOX} b JOIN pose_kpts k ON b.image_id = k.image_id GROUP BY 1, 2, 3),
{_greedy_sql("SELECT *, hit / seen::DOUBLE ratio FROM n WHERE hit > 0 AND hit / seen::DOUBLE >= 0.3", "-ratio, -hit")}""", "pose_box", "pose_kpts")
def inside_ratio_match(s, d):
    base = bx.with_corners(fx.poses(s, d)).select("image_id", "obj_idx", "x1", "y1", "x2", "y2")
    return mt.inside_once(base, fx.poses(s, d).select("image_id", "obj_idx", "kpts"), 0.3).select("image_id", "base_idx", "other_idx")


@query("""WITH RECURSIVE c AS (SELECT image_id, class_id, obj_idx, score, cx - w / 2 x1, cy - h / 2 y1, cx + w / 2 x2, cy + h / 2 y2, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, obj_idx) r FROM boxes),
k AS (SELECT image_id, class_id, r, [CAST(obj_idx AS BIGINT)] ids, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] kept FROM c WHERE r = 1
 UNION ALL SELECT c.image_id, c.class_id, c.r, CASE WHEN hit THEN ids ELSE list_append(ids, CAST(c.obj_idx AS BIGINT)) END, CASE WHEN hit THEN kept ELSE list_append(kept, {'x1': c.x1, 'y1': c.y1, 'x2': c.x2, 'y2': c.y2}) END
 FROM k JOIN c ON c.image_id = k.image_id AND c.class_id = k.class_id AND c.r = k.r + 1
 CROSS JOIN LATERAL (SELECT len(list_filter(kept, lambda q: least(q.x2, c.x2) > greatest(q.x1, c.x1) AND least(q.y2, c.y2) > greatest(q.y1, c.y1))) > 0 hit))
SELECT image_id, class_id, unnest(ids) obj_idx FROM (SELECT image_id, class_id, arg_max(ids, r) ids FROM k GROUP BY 1, 2)""".replace("WITH RECURSIVE", "WITH"), "boxes")
def nms_same_class(s, d):
    return mt.suppress(bx.with_corners(fx.view(s, d, "boxes"))).select("image_id", "class_id", "obj_idx")


_oracle["nms_same_class"] = _oracle["nms_same_class"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"""WITH a AS (SELECT b.image_id, b.obj_idx, b.x1, b.y1, b.x2, b.y2, f.fx, f.fy FROM {_PBOX} b JOIN (SELECT vec_id, sum(x) / count(*) fx, sum(y) / count(*) fy FROM pose_kpts WHERE k < 5 AND v > 0 GROUP BY 1) f ON b.vec_id = f.vec_id),
p AS (SELECT a.image_id, a.obj_idx base_idx, b.obj_idx other_idx, {_overlap('a', 'b')} i, {_area('a')} aa, {_area('b')} bb, sqrt((a.fx - b.fx) * (a.fx - b.fx) + (a.fy - b.fy) * (a.fy - b.fy)) dist FROM a JOIN a b ON a.image_id = b.image_id AND a.obj_idx <> b.obj_idx),
q AS (SELECT *, {_IOU} iou FROM p),
r AS (SELECT image_id, base_idx, max(iou) m, arg_max(other_idx, iou) by_iou, arg_min(other_idx, dist) FILTER (dist < 0.3) by_dist FROM q GROUP BY 1, 2)
SELECT image_id, base_idx, CASE WHEN m > 0.3 THEN by_iou ELSE by_dist END other_idx FROM r WHERE CASE WHEN m > 0.3 THEN by_iou ELSE by_dist END IS NOT NULL""", "pose_box", "pose_kpts")
def face_match_iou_or_center(s, d):
    m = kp.face_mean(F.col("kpts"))
    a = bx.with_corners(fx.poses(s, d)).select("image_id", "obj_idx", "x1", "y1", "x2", "y2", m["x"].alias("fx"), m["y"].alias("fy")).where("fx is not null")
    return _best_other(a)


def _best_other(a: DataFrame) -> DataFrame:
    """Partners among the other objects of the same image."""
    return mt.best_face(a, a, 0.3, 0.3, apart=True).select("image_id", "base_idx", "other_idx")


def _costs(s, d):
    a = fx.view(s, d, "pose_box").where("vec_id % 2 = 0").alias("a")
    b = fx.view(s, d, "pose_box").where("vec_id % 2 = 1").alias("b")
    j = a.join(b, F.col("a.image_id") == F.col("b.image_id"))
    dist = g.distance(F.col("a.cx"), F.col("a.cy"), F.col("b.cx"), F.col("b.cy")) / F.sqrt(F.lit(2.0))
    cost = 0.75 * dist + 0.25 * (1 - g.iou(bx.corners("a."), bx.corners("b.")))
    return j.select("a.image_id", F.col("a.obj_idx").alias("a_idx"), F.col("b.obj_idx").alias("b_idx"), cost.alias("cost"))


@query(f"""WITH p AS (SELECT a.image_id, a.obj_idx a_idx, b.obj_idx b_idx, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) / sqrt(2::DOUBLE) dd, {_overlap('a', 'b')} i, {_area('a')} aa, {_area('b')} bb
 FROM {_PBOX} a JOIN {_PBOX} b ON a.image_id = b.image_id AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
SELECT image_id, a_idx, b_idx, CAST(floor((0.75::DOUBLE * dd + 0.25::DOUBLE * (1 - {_IOU})) * 1000 + 0.5) AS BIGINT) cost_m FROM p""", "pose_box")
def pair_cost(s, d):
    return _costs(s, d).select("image_id", "a_idx", "b_idx", F.floor(F.col("cost") * 1000 + 0.5).alias("cost_m"))


@query(f"""WITH p AS (SELECT a.image_id, a.obj_idx a_idx, b.obj_idx b_idx, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) / sqrt(2::DOUBLE) dd, {_overlap('a', 'b')} i, {_area('a')} aa, {_area('b')} bb
 FROM {_PBOX} a JOIN {_PBOX} b ON a.image_id = b.image_id AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
c AS (SELECT image_id, a_idx, b_idx, 0.75::DOUBLE * dd + 0.25::DOUBLE * (1 - {_IOU}) cost FROM p), n AS (SELECT image_id, count(DISTINCT a_idx) rows_ FROM c GROUP BY 1),
m AS (SELECT image_id, a_idx a1, b_idx b1, cost c1, NULL a2, NULL b2, NULL c2, cost + 0.65::DOUBLE * (rows_ - 1) total FROM c JOIN n USING (image_id)
 UNION ALL SELECT x.image_id, x.a_idx, x.b_idx, x.cost, y.a_idx, y.b_idx, y.cost, x.cost + y.cost FROM c x JOIN c y ON x.image_id = y.image_id AND x.a_idx < y.a_idx AND x.b_idx <> y.b_idx
 UNION ALL SELECT image_id, NULL, NULL, NULL, NULL, NULL, NULL, 0.65::DOUBLE * rows_ FROM n),
w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY total) = 1),
u AS (SELECT image_id, a1 a_idx, b1 b_idx, c1 cost FROM w UNION ALL SELECT image_id, a2, b2, c2 FROM w)
SELECT image_id, CAST(a_idx AS BIGINT) a_idx, CAST(b_idx AS BIGINT) b_idx, {M('cost')} cost_u FROM u WHERE cost <= 0.55""", "pose_box")
def optimal_assignment(s, d):
    return micros(mt.assign(_costs(s, d)), ["image_id", "a_idx", "b_idx"], ["cost"])


# --- sequences ---------------------------------------------------------------------------------
@query("SELECT event_id FROM (SELECT event_id, abs(feat - lag(feat IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY frame_index)) dd FROM frames) WHERE dd <= 5", "frames")
def similar_frames_lag(s, d):
    return sq.near_duplicates(fx.view(s, d, "frames"), "feat", 5.0).select("event_id")


@query("""SELECT event_id, coalesce(lag(event_type) OVER w <> event_type, false) changed, first_value(event_type) OVER w first_value FROM frames WINDOW w AS (PARTITION BY seq_id ORDER BY frame_index)""", "frames")
def size_changes(s, d):
    return sq.size_changes(fx.view(s, d, "frames"), "event_type").select("event_id", "changed", "first_value")


@query("""SELECT event_id, lpad(CAST(frame_index AS VARCHAR), length(CAST(c AS VARCHAR))::INT, '0') AS label FROM (SELECT *, count(*) OVER (PARTITION BY seq_id) c FROM frames) WHERE (frame_index - 1) % 3 = 0""", "frames")
def frame_decimate(s, d):
    return sq.every_nth(fx.view(s, d, "frames"), 2).select("event_id", "label")


def _sources(s, d):
    f = fx.view(s, d, "frames").select("seq_id", F.col("frame_index").cast("long").alias("frame_index"), "event_type", "event_id", "feat")
    return f, f.where("event_type = 'purchase'"), f.where("event_type <> 'purchase'")


@query("""SELECT seq_id, target_index, source_index, place FROM (SELECT t.seq_id, t.frame_index target_index, s.frame_index source_index, row_number() OVER (PARTITION BY t.seq_id, t.frame_index ORDER BY s.frame_index DESC) place
FROM frames t JOIN frames s ON t.seq_id = s.seq_id AND s.frame_index < t.frame_index WHERE t.event_type <> 'purchase' AND s.event_type = 'purchase') WHERE place <= 4""", "frames")
def history_topk(s, d):
    """Purchases are the frames with labels; every other frame is a target."""
    _, src, tgt = _sources(s, d)
    return sq.history(src, tgt, 4)


@query("""SELECT seq_id, w."at", min(frame_index) frame_index FROM (SELECT DISTINCT seq_id, k "at" FROM frames, (VALUES (7), (20), (55)) v(k)) w JOIN (SELECT * FROM frames WHERE event_type = 'purchase') f USING (seq_id) WHERE f.frame_index >= w."at" GROUP BY 1, 2""", "frames")
def asof_next_frame(s, d):
    f, labelled, _ = _sources(s, d)
    want = f.select("seq_id").distinct().withColumn("at", F.explode(F.array(*[F.lit(k).cast("long") for k in (7, 20, 55)])))
    return sq.at_or_after(labelled, want)


@query("""SELECT seq_id, target_index, source_index, place FROM (SELECT t.seq_id, t.frame_index target_index, s.frame_index source_index, row_number() OVER (PARTITION BY t.seq_id, t.frame_index ORDER BY s.frame_index DESC) place
FROM frames t JOIN frames s ON t.seq_id = s.seq_id AND s.frame_index < t.frame_index) WHERE place <= 4""", "frames")
def history_all_frames(s, d):
    """Every frame is a target, and a source for those after it."""
    f, _, _ = _sources(s, d)
    return sq.history(f, f, 4)


@query("""SELECT t.seq_id, t.frame_index "at", min(p.frame_index) frame_index FROM frames t JOIN frames p ON t.seq_id = p.seq_id AND p.event_type = 'purchase' AND p.frame_index >= t.frame_index GROUP BY 1, 2""", "frames")
def asof_next_purchase(s, d):
    """For every frame the purchase there or next."""
    f, _, _ = _sources(s, d)
    return sq.at_or_after(f.where("event_type = 'purchase'"), f.select("seq_id", F.col("frame_index").alias("at")))


@query("""WITH c AS (SELECT seq_id, frame_index - frame_index % 6 grp, feat / 100 x, (feat * 7 % 100) / 100 y, greatest(1e-6, exp(-greatest(1, 6 - frame_index % 6) / 8::DOUBLE)) weight FROM frames),
m AS (SELECT seq_id, grp, count(*) n, median(x) mx, median(y) my FROM c GROUP BY 1, 2),
e AS (SELECT c.*, n, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) dd FROM c JOIN m USING (seq_id, grp)),
l AS (SELECT seq_id, grp, greatest(0.002, median(dd) * 2.5) lim FROM e GROUP BY 1, 2)
SELECT seq_id, grp, CAST(floor(sum(x * weight) FILTER (n < 3 OR dd <= lim) / sum(weight) FILTER (n < 3 OR dd <= lim) * 1000 + 0.5) AS BIGINT) x_m,
 CAST(floor(sum(y * weight) FILTER (n < 3 OR dd <= lim) / sum(weight) FILTER (n < 3 OR dd <= lim) * 1000 + 0.5) AS BIGINT) y_m, count(*) FILTER (n >= 3 AND dd > lim) rejected FROM e JOIN l USING (seq_id, grp) GROUP BY 1, 2""", "frames")
def robust_fusion(s, d):
    f, _, _ = _sources(s, d)
    gap = 6 - F.col("frame_index") % 6
    c = f.select("seq_id", (F.col("frame_index") - F.col("frame_index") % 6).alias("grp"), (F.col("feat") / 100).alias("x"), (F.col("feat") * 7 % 100 / 100).alias("y"), sq.weight(gap, F.lit(0.0), F.lit(False), 8.0).alias("weight"))
    r = sq.fuse(c, ["seq_id", "grp"])
    return r.select("seq_id", "grp", F.floor(F.col("x") * 1000 + 0.5).alias("x_m"), F.floor(F.col("y") * 1000 + 0.5).alias("y_m"), "rejected")


# --- layouts -----------------------------------------------------------------------------------
_NEAR = lambda t: f"abs(r - {t}) / {t} <= 0.01"
_BUCKET = f"""CASE WHEN {_NEAR('1.0::DOUBLE')} THEN CASE WHEN m <= 224 THEN 'square_small' WHEN m <= 384 THEN 'square_medium' ELSE 'square_large' END
 WHEN {_NEAR('0.5::DOUBLE')} OR {_NEAR('0.5625::DOUBLE')} THEN 'portrait_2' WHEN {_NEAR('2.0::DOUBLE')} OR {_NEAR('(16.0::DOUBLE / 9)')} THEN 'landscape_2'
 WHEN {_NEAR('(2.0::DOUBLE / 3)')} THEN 'portrait_6' WHEN {_NEAR('1.5::DOUBLE')} THEN 'landscape_6' ELSE 'rest' END"""


@query(f"SELECT image_id, {_BUCKET} bucket FROM (SELECT image_id, width / CAST(height AS DOUBLE) r, greatest(width, height) m FROM images)", "images")
def shape_buckets(s, d):
    return fx.view(s, d, "images").select("image_id", lay.bucket(F.col("width"), F.col("height")).alias("bucket"))


@query("SELECT image_id, CASE WHEN least(width, height) / CAST(greatest(width, height) AS DOUBLE) > 0.8::DOUBLE THEN 'square' WHEN height > width THEN 'portrait' ELSE 'landscape' END shape FROM images", "images")
def shape_classes(s, d):
    return fx.view(s, d, "images").select("image_id", lay.shape_class(F.col("width"), F.col("height")).alias("shape"))


@query("""WITH n AS (SELECT image_id, source, row_number() OVER (PARTITION BY source ORDER BY (image_id + 3) * 2654435761 % 4294967296, image_id) - 1 no, count(*) OVER (PARTITION BY source) c FROM images),
a AS (SELECT image_id, source, no, c FROM n UNION ALL SELECT image_id, source, no + c, c FROM n WHERE no < (4 - c % 4) % 4)
SELECT image_id, source, no // 4 group_no, CAST(no % 4 AS INT) slot FROM a""", "images")
def tile_groups(s, d):
    return lay.groups(fx.view(s, d, "images"), "source", 4, seed=3)


@query("""WITH g0 AS (SELECT image_id // 6 mosaic_id, CAST(row_number() OVER (PARTITION BY image_id // 6 ORDER BY image_id) - 1 AS INT) slot, width, height FROM images),
g AS (SELECT *, slot // 2 AS rw, slot % 2 AS cl, first_value(height) OVER (PARTITION BY mosaic_id, slot // 2 ORDER BY slot) rh FROM g0),
a AS (SELECT *, CASE WHEN height = rh THEN width ELSE greatest(1, CAST(round_even(width * (rh / CAST(height AS DOUBLE)), 0) AS INT)) END w1 FROM g),
b AS (SELECT *, sum(w1) OVER (PARTITION BY mosaic_id, rw) row_w FROM a),
c AS (SELECT *, first_value(row_w) OVER (PARTITION BY mosaic_id ORDER BY slot) base FROM b),
e AS (SELECT *, CASE WHEN row_w = base THEN w1 ELSE greatest(1, CAST(round_even(w1 * (CAST(base AS DOUBLE) / CAST(row_w AS DOUBLE)), 0) AS INT)) END tile_w, CASE WHEN row_w = base THEN rh ELSE greatest(1, CAST(round_even(rh * (CAST(base AS DOUBLE) / CAST(row_w AS DOUBLE)), 0) AS INT)) END tile_h FROM c),
f AS (SELECT mosaic_id, rw, sum(tile_h) FILTER (cl = 0) h FROM e GROUP BY 1, 2), y AS (SELECT mosaic_id, rw, coalesce(sum(h) OVER (PARTITION BY mosaic_id ORDER BY rw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) y FROM f)
SELECT e.mosaic_id, slot, CAST(coalesce(sum(tile_w) OVER (PARTITION BY e.mosaic_id, e.rw ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) x, CAST(y AS INT) y, tile_w, tile_h FROM e JOIN y ON e.mosaic_id = y.mosaic_id AND e.rw = y.rw""", "images")
def mosaic_layout(s, d):
    from pyspark.sql import Window

    i = fx.view(s, d, "images").withColumn("mosaic_id", F.expr("image_id div 6"))
    i = i.withColumn("slot", F.row_number().over(Window.partitionBy("mosaic_id").orderBy("image_id")) - 1)
    return lay.grid(i, 2)


@query("""WITH k AS (SELECT image_id, width, height, least(256 / CAST(width AS DOUBLE), 192 / CAST(height AS DOUBLE)) s FROM images),
n AS (SELECT image_id, greatest(1, CAST(round_even(width * s, 0) AS INT)) new_w, greatest(1, CAST(round_even(height * s, 0) AS INT)) new_h FROM k)
SELECT image_id, new_w, new_h, CAST(trunc((256 - new_w) / 2) AS INT) pad_x, CAST(trunc((192 - new_h) / 2) AS INT) pad_y FROM n""", "images")
def tile_fit(s, d):
    return fx.view(s, d, "images").select("image_id", lay.tile_fit(F.col("width"), F.col("height"), F.lit(256), F.lit(192)).alias("t")).select("image_id", "t.*")


@query("""SELECT image_id, greatest(1, CAST(round_even(width * k, 0) AS INT)) new_w, greatest(1, CAST(round_even(height * k, 0) AS INT)) new_h, CAST(ceil(width / 14.0) * 14 AS INT) aligned FROM (SELECT *, least(1, 160 / CAST(greatest(width, height) AS DOUBLE)) k FROM images)""", "images")
def target_size(s, d):
    w, h = g.fit_inside(F.col("width"), F.col("height"), 160)
    return fx.view(s, d, "images").select("image_id", w.alias("new_w"), h.alias("new_h"), g.align_up(F.col("width"), 14).alias("aligned"))


# --- web pages ---------------------------------------------------------------------------------
_LINKS = r"""l AS (SELECT page_id, unnest(u) url, generate_subscripts(u, 1) pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) u FROM pages)),
n AS (SELECT page_id, CASE WHEN url LIKE '//%' THEN 'https:' || url ELSE url END url, pos FROM l),
q AS (SELECT page_id, url, min(pos) pos FROM n GROUP BY 1, 2)"""


@query(f"WITH {_LINKS} SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos) place FROM q")
def page_links(s, d):
    p = fx.table(s, d, "pages").select("page_id", F.posexplode(urls.links(F.col("html"), relative=True)).alias("place", "url"))
    return p.select("page_id", "url", (F.col("place") + 1).cast("long").alias("place"))


@query(f"WITH {_LINKS} SELECT url, min(page_id) first_page, count(*) pages FROM q GROUP BY 1")
def dedupe_urls(s, d):
    p = fx.table(s, d, "pages").select("page_id", F.explode(urls.links(F.col("html"), relative=True)).alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) host, CASE WHEN lower(regexp_extract(url, '://([^/?#]*)', 1)) LIKE '%yandex.%' THEN 'yandex' WHEN lower(regexp_extract(url, '://([^/?#]*)', 1)) LIKE '%google.%' THEN 'google' ELSE 'generic' END provider FROM pages""")
def url_provider(s, d):
    return fx.table(s, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.provider(F.col("url")).alias("provider"))


_PARAM = lambda k: f"nullif(regexp_extract(q, '(?:^|&){k}=([^&]*)', 1), '')"


_PAGE = rf"TRY_CAST(coalesce({_PARAM('p')}, {_PARAM('page')}, {_PARAM('pn')}) AS INT)"
_QUERY_PART = r"(SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) q FROM pages)"


@query(f"SELECT coalesce({_PAGE}, -1) page, count(*) n FROM {_QUERY_PART} GROUP BY 1")
def query_param_page(s, d):
    """How many pages have each number in their address; -1: none."""
    page = F.coalesce(urls.page_index(F.col("url")), F.lit(-1))
    return fx.table(s, d, "pages").groupBy(page.alias("page")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, CAST({_PAGE} AS VARCHAR) page FROM {_QUERY_PART}")
def page_number(s, d):
    """The number in the address of every page, as text; null where it has none."""
    return fx.table(s, d, "pages").select("page_id", urls.page_index(F.col("url")).cast("string").alias("page"))


@query("""SELECT page_id, unnest(CASE WHEN len(u) = 0 THEN [NULL] ELSE u END) url FROM (SELECT page_id, list_concat(regexp_extract_all(html, '"ou"\\s*:\\s*"(https?:[^"]*)"', 1), regexp_extract_all(html, 'data-iurl="(https?:[^"]*)"', 1)) u FROM pages)""")
def page_image_urls(s, d):
    """Image addresses in the text of every page; a page without any has one row with null."""
    return fx.table(s, d, "pages").select("page_id", F.explode_outer(urls.image_urls(F.col("html"))).alias("url"))


_TENTHS = lambda unit: f"CAST(floor(b * 10 / {unit}.0::DOUBLE + 0.5) AS BIGINT)"
_READ = lambda unit, name: f"{_TENTHS(unit)} // 10 || '.' || {_TENTHS(unit)} % 10 || ' {name}'"


@query(f"SELECT page_id, CASE WHEN b >= 1048576 THEN {_READ(1048576, 'MB')} WHEN b >= 1024 THEN {_READ(1024, 'KB')} ELSE b || ' B' END size FROM (SELECT page_id, strlen(html) b FROM pages)")
def readable_sizes(s, d):
    return fx.table(s, d, "pages").select("page_id", g.readable_bytes(F.octet_length("html").cast("long")).alias("size"))

from . import dataset_catalog, files_catalog, mosaic_catalog, motion_catalog, pose_catalog, scan_catalog, text_catalog  # noqa: E402, F401  their queries are of this catalog

"""Queries over poses: boxes with their keypoints through every geometric rewrite, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keypoints as kp
from ..operators import boxes as bx
from ..operators import poses as ps
from . import fixtures as fx
from .catalog import _CROP, _IOU, BOX, M, _area, _overlap, micros, query, u

_VIEWS = ("images", "pose_box", "pose_kpts")
_VALID = "v > 0 AND NOT (x = 0 AND y = 0)"
_LIVE = """b AS (SELECT p.*, width, height FROM pose_box p JOIN images i ON p.image_id = i.image_id),
q AS (SELECT k.*, width, height FROM pose_kpts k JOIN images i ON k.image_id = i.image_id)"""


def c01(e: str) -> str:
    return f"least(greatest({e}, 0), 1)"


def _rows(df: DataFrame, *extra: str) -> DataFrame:
    """Every keypoint of a pose in a row (k from 0), and the box as k = -1, made where the pose lies."""
    four = lambda *v: F.struct(*[c.alias(f"a{i}") for i, c in enumerate(v)])
    points = F.transform("kpts", lambda p: four(u(p["x"]), u(p["y"]), u(p["v"]), F.lit(-1).cast("long")))
    all_ = F.concat(F.array(four(*[u(c) for c in BOX])), F.coalesce(points, F.array()))
    return df.select("image_id", "obj_idx", *extra, F.posexplode(all_).alias("k", "p")).select("image_id", "obj_idx", *extra, (F.col("k") - 1).alias("k"), "p.*")


def _sql(box: str, points: str, *extra: str) -> str:
    """box: a table with cx, cy, w, h; points: one with k, x, y, v of the same poses."""
    more = "".join(f", {e}" for e in extra)
    return f"""SELECT image_id, obj_idx{more}, -1 k, {', '.join(f'{M(c)} a{i}' for i, c in enumerate(BOX))} FROM {box}
UNION ALL SELECT image_id, obj_idx{more}, k, {M('x')} a0, {M('y')} a1, {M('v')} a2, -1 a3 FROM {points}"""


# --- envelopes and crops -----------------------------------------------------------------------
def _corner_sql(table: str) -> str:
    cut = lambda e, m: f"least(greatest({e}, 0), {m})"
    return f"""SELECT *, {cut('least(cx - w / 2, cx + w / 2) * width', 'width')} x1, {cut('least(cy - h / 2, cy + h / 2) * height', 'height')} y1,
 {cut('greatest(cx - w / 2, cx + w / 2) * width', 'width')} x2, {cut('greatest(cy - h / 2, cy + h / 2) * height', 'height')} y2 FROM {table}"""


def _env_sql(least: float = 0.0) -> str:
    live = f"WHERE least(w * width, h * height) >= {least}" if least else ""
    return f"""{_LIVE}, c0_ AS ({_corner_sql('b')} {live}),
m AS (SELECT image_id, width, height, x1, y1, x2, y2 FROM c0_ WHERE x2 > x1 AND y2 > y1 UNION ALL
 SELECT q.image_id, q.width, q.height, least(greatest(x * q.width, 0), q.width), least(greatest(y * q.height, 0), q.height), least(greatest(x * q.width, 0), q.width), least(greatest(y * q.height, 0), q.height)
 FROM q JOIN c0_ ON q.vec_id = c0_.vec_id WHERE {_VALID}),
e AS (SELECT image_id, width, height, min(x1) min_x, min(y1) min_y, max(x2) max_x, max(y2) max_y FROM m GROUP BY ALL)"""


def _poses(s, d):
    return fx.poses(s, d), fx.view(s, d, "images")


_FOUR = ", ".join(f"{M(c)} {c}_u" for c in ("min_x", "min_y", "max_x", "max_y"))


@query(f"WITH {_env_sql()} SELECT image_id, {_FOUR} FROM e", *_VIEWS)
def pose_envelope(s, d):
    return micros(ps.envelope(*_poses(s, d)), ["image_id"], ["min_x", "min_y", "max_x", "max_y"])


@query(f"WITH {_env_sql(60.0)} SELECT image_id, {_FOUR} FROM e", *_VIEWS)
def pose_envelope_without_tiny(s, d):
    return micros(ps.envelope(*_poses(s, d), 60.0), ["image_id"], ["min_x", "min_y", "max_x", "max_y"])


def _crops(s, d):
    return bx.margin_crop(ps.envelope(*_poses(s, d)), 5)


_CROPS = f"{_env_sql()}, {_CROP.replace('- 20', '- 5').replace('+ 20', '+ 5')}"
_CW, _CH = '("right" - "left")', "(bottom - top)"
_IN_CROP = f"""j AS (SELECT b.image_id, obj_idx, vec_id, cx, cy, w, h, b.width, b.height, "left", top, "right", bottom,
 least(greatest(least(greatest((cx - w / 2) * b.width, 0), b.width) - "left", 0), {_CW}) x1, least(greatest(least(greatest((cy - h / 2) * b.height, 0), b.height) - top, 0), {_CH}) y1,
 least(greatest(least(greatest((cx + w / 2) * b.width, 0), b.width) - "left", 0), {_CW}) x2, least(greatest(least(greatest((cy + h / 2) * b.height, 0), b.height) - top, 0), {_CH}) y2
 FROM b JOIN c ON b.image_id = c.image_id)"""


def _crop_points(rows: str, lost: str) -> str:
    x, y = c01(f'(q.x * q.width - "left") / {_CW}'), c01(f"(q.y * q.height - top) / {_CH}")
    return f"""SELECT q.image_id, q.obj_idx, q.k, CASE WHEN {_VALID} THEN {x} ELSE 0 END x, CASE WHEN {_VALID} THEN {y} ELSE 0 END y, CASE WHEN {_VALID} THEN v ELSE {lost} END v
 FROM q JOIN {rows} r ON q.vec_id = r.vec_id"""


@query(f"""WITH {_CROPS}, {_IN_CROP}, r0 AS (SELECT * FROM j WHERE x2 > x1 AND y2 > y1),
o AS (SELECT image_id, obj_idx, {c01(f'(x1 + x2) / 2 / {_CW}')} cx, {c01(f'(y1 + y2) / 2 / {_CH}')} cy, {c01(f'(x2 - x1) / {_CW}')} w, {c01(f'(y2 - y1) / {_CH}')} h FROM r0),
p AS ({_crop_points('(SELECT vec_id, "left", top, "right", bottom FROM r0)', 'v')}) {_sql('o', 'p')}""", *_VIEWS)
def pose_crop_rewrite(s, d):
    return _rows(ps.rewrite_for_crop(fx.poses(s, d), _crops(s, d)))


@query(f"""WITH {_CROPS}, {_IN_CROP}, t AS (SELECT *, least(cx - w / 2, cx + w / 2) * width px1, least(cy - h / 2, cy + h / 2) * height py1, greatest(cx - w / 2, cx + w / 2) * width px2,
 greatest(cy - h / 2, cy + h / 2) * height py2 FROM j),
r0 AS (SELECT * FROM t WHERE least(w * width, h * height) >= 60 OR (px1 >= "left" - 0.000001 AND py1 >= top - 0.000001 AND px2 <= "right" + 0.000001 AND py2 <= bottom + 0.000001)),
o AS (SELECT image_id, obj_idx, {c01(f'(cx * width - "left") / {_CW}')} cx, {c01(f'(cy * height - top) / {_CH}')} cy, {c01(f'w * width / {_CW}')} w, {c01(f'h * height / {_CH}')} h FROM r0),
p AS ({_crop_points('(SELECT vec_id, "left", top, "right", bottom FROM r0)', '0')}) {_sql('o', 'p')}""", *_VIEWS)
def pose_crop_recentre(s, d):
    return _rows(ps.recentre_for_crop(fx.poses(s, d), _crops(s, d), 60.0))


@query(f"""WITH {_CROPS} SELECT image_id, "left", top, "right", bottom FROM c WHERE greatest("right" - "left", bottom - top) >= 700""", *_VIEWS)
def pose_crop_large_enough(s, d):
    return ps.large_enough(_crops(s, d), 700).select("image_id", "left", "top", "right", "bottom")


# --- turns and flips ---------------------------------------------------------------------------
def _turn_sql(angle: int) -> str:
    point = {90: ("height - {y}", "{x}"), 180: ("width - {x}", "height - {y}"), 270: ("{y}", "width - {x}")}[angle]
    nw, nh = ("width", "height") if angle == 180 else ("height", "width")
    at = lambda x, y: tuple(t.format(x=x, y=y) for t in point)
    (ax, ay), (bx_, by) = at("(cx - w / 2) * width", "(cy - h / 2) * height"), at("(cx + w / 2) * width", "(cy + h / 2) * height")
    px, py = (f"({e}) / {n}" for e, n in zip(at("(x * width)", "(y * height)"), (nw, nh), strict=True))
    ok = f"{_VALID} AND {px} BETWEEN 0 AND 1 AND {py} BETWEEN 0 AND 1"
    return f"""c{angle} AS (SELECT *, {nw} nw, {nh} nh, greatest(0, least({ax}, {bx_})) l, greatest(0, least({ay}, {by})) t, least({nw}, greatest({ax}, {bx_})) r, least({nh}, greatest({ay}, {by})) bo FROM b),
r{angle} AS (SELECT * FROM c{angle} WHERE r > l AND bo > t),
o{angle} AS (SELECT {angle} angle, image_id, obj_idx, {c01('(l + r) / 2 / nw')} cx, {c01('(t + bo) / 2 / nh')} cy, {c01('(r - l) / nw')} w, {c01('(bo - t) / nh')} h FROM r{angle}),
p{angle} AS (SELECT {angle} angle, q.image_id, q.obj_idx, q.k, CASE WHEN {ok} THEN {c01(px)} ELSE 0 END x, CASE WHEN {ok} THEN {c01(py)} ELSE 0 END y, CASE WHEN {ok} THEN v ELSE 0 END v FROM q
 WHERE vec_id IN (SELECT vec_id FROM r{angle}))"""


_ALL = lambda t: " UNION ALL ".join(f"SELECT * FROM {t}{a}" for a in (90, 180, 270))


@query(f"WITH {_LIVE}, {', '.join(map(_turn_sql, (90, 180, 270)))}, o AS ({_ALL('o')}), p AS ({_ALL('p')}) {_sql('o', 'p', 'angle')}", *_VIEWS)
def pose_turns(s, d):
    return _rows(ps.turns(*_poses(s, d), [90, 180, 270, 90]), "angle")


_MIRROR = ", ".join(map(str, kp.MIRROR))


def _flip_half(x: str, y: str) -> tuple[str, str]:
    return f"CASE WHEN height > width THEN {x} * 0.5 + copy * 0.5 ELSE {x} END", f"CASE WHEN height > width THEN {y} ELSE {y} * 0.5 + copy * 0.5 END"


_NIL = "x = 0 AND y = 0 AND v = 0"
_PX, _PY = _flip_half("CASE WHEN copy = 1 THEN 1 - x ELSE x END", "y")
_BX, _BY = _flip_half("CASE WHEN copy = 1 THEN 1 - cx ELSE cx END", "cy")


@query(f"""WITH {_LIVE}, n AS (SELECT unnest([0, 1]) copy),
o AS (SELECT image_id, obj_idx, copy, {c01(_BX)} cx, {c01(_BY)} cy, {c01('CASE WHEN height > width THEN w * 0.5 ELSE w END')} w, {c01('CASE WHEN height > width THEN h ELSE h * 0.5 END')} h FROM b, n),
p AS (SELECT image_id, obj_idx, copy, CASE WHEN copy = 1 THEN [{_MIRROR}][k + 1] ELSE k END k, CASE WHEN {_NIL} THEN 0 ELSE {c01(_PX)} END x, CASE WHEN {_NIL} THEN 0 ELSE {c01(_PY)} END y, v FROM q, n)
{_sql('o', 'p', 'copy')}""", *_VIEWS)
def pose_extend_flip(s, d):
    return _rows(ps.extend_with_flip(*_poses(s, d)), "copy")


# --- mosaics -----------------------------------------------------------------------------------
#: One tile per image, its turn, flip, scale and place by rule, on a mosaic of 900 x 700 pixels.
_TILES = """SELECT image_id, width, height, CAST(CASE image_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE 270 END AS INT) rotation, image_id % 2 = 1 flip, CAST(0.25 AS DOUBLE) scale, CAST(image_id % 100 AS INT) "left",
 CAST(image_id % 70 AS INT) top, CAST(1.5 AS DOUBLE) scale_x, CAST(1.25 AS DOUBLE) scale_y, 900 mosaic_w, 700 mosaic_h FROM images"""


def _tiles(s, d):
    return s.sql(_TILES.replace('"left"', "`left`").replace("FROM images", "FROM {images}"), images=fx.view(s, d, "images"))


def _mosaic_point(x: str, y: str) -> tuple[str, str]:
    sx = f"(CASE rotation WHEN 90 THEN {y} * height WHEN 270 THEN height - {y} * height ELSE {x} * width END / tw)"
    sy = f"(CASE rotation WHEN 90 THEN width - {x} * width WHEN 270 THEN {x} * width ELSE {y} * height END / th)"
    return f'((CASE WHEN flip THEN 1 - {sx} ELSE {sx} END * tw * scale + "left") * scale_x / mosaic_w)', f"(({sy} * th * scale + top) * scale_y / mosaic_h)"


_MX, _MY = _mosaic_point("cx", "cy")
_KX, _KY = _mosaic_point("x", "y")


@query(f"""WITH t0 AS ({_TILES}), t AS (SELECT *, CASE WHEN rotation = 0 THEN width ELSE height END tw, CASE WHEN rotation = 0 THEN height ELSE width END th FROM t0),
g AS (SELECT vec_id, obj_idx, cx, cy, t.*, CASE WHEN rotation = 0 THEN w * width ELSE h * height END * scale * scale_x pw, CASE WHEN rotation = 0 THEN h * height ELSE w * width END * scale * scale_y ph
 FROM pose_box b JOIN t ON b.image_id = t.image_id),
r AS (SELECT * FROM g WHERE pw >= 20 AND ph >= 20),
o AS (SELECT image_id, obj_idx, {c01(_MX)} cx, {c01(_MY)} cy, {c01('pw / mosaic_w')} w, {c01('ph / mosaic_h')} h FROM r),
p AS (SELECT r.image_id, r.obj_idx, CASE WHEN flip THEN [{_MIRROR}][k + 1] ELSE k END k, CASE WHEN {_NIL} THEN 0 ELSE {c01(_KX)} END x, CASE WHEN {_NIL} THEN 0 ELSE {c01(_KY)} END y, v
 FROM r JOIN pose_kpts k ON r.vec_id = k.vec_id) {_sql('o', 'p')}""", *_VIEWS)
def pose_mosaic(s, d):
    return _rows(ps.place_on_mosaic(fx.poses(s, d), _tiles(s, d)))


# --- tilt --------------------------------------------------------------------------------------
_ANGLE = "radians(CAST(-(5 + image_id % 7) AS DOUBLE) - 0.5)"
_CORNERS = [("0", "0"), ("width", "0"), ("0", "height"), ("width", "height")]
_TX = lambda x, y: f"(centre_x + cos_ * ({x} - centre_x) - sin_ * ({y} - centre_y))"
_TY = lambda x, y: f"(centre_y + sin_ * ({x} - centre_x) + cos_ * ({y} - centre_y))"
_XS, _YS = (", ".join(f(x, y) for x, y in _CORNERS) for f in (_TX, _TY))
_BC = [(f"(cx {a} w / 2) * width", f"(cy {b} h / 2) * height") for a in "-+" for b in "-+"]
_BXS, _BYS = (", ".join(f"{f(x, y)} + {o}" for x, y in _BC) for f, o in ((_TX, "ox"), (_TY, "oy")))
_QX, _QY = f"(({_TX('x * width', 'y * height')} + ox) / ow)", f"(({_TY('x * width', 'y * height')} + oy) / oh)"
_ON = f"{_VALID} AND {_QX} BETWEEN 0 AND 1 AND {_QY} BETWEEN 0 AND 1"


def _canvas(s, d):
    turned = fx.view(s, d, "images").select("image_id", "width", "height", F.radians(-(5 + F.col("image_id") % 7).cast("double") - 0.5).alias("angle"), (F.col("width") * 0.5).alias("centre_x"), (F.col("height") * 0.25).alias("centre_y"))
    return ps.tilt_canvas(turned)


@query(f"""WITH i0 AS (SELECT image_id, width, height, cos({_ANGLE}) cos_, sin({_ANGLE}) sin_, width * 0.5::DOUBLE centre_x, height * 0.25::DOUBLE centre_y FROM images),
i1 AS (SELECT *, floor(least({_XS})) x0, floor(least({_YS})) y0, ceil(greatest({_XS})) x9, ceil(greatest({_YS})) y9 FROM i0),
i2 AS (SELECT *, least(greatest(round_even(greatest(0, x9 - x0 - width) / 3.0, 0), 0), floor((x9 - x0 - 1) / 2)) kx, least(greatest(round_even(greatest(0, y9 - y0 - height) / 2.0, 0), 0), floor((y9 - y0 - 1) / 2)) ky FROM i1),
i3 AS (SELECT *, -x0 - kx ox, -y0 - ky oy, x9 - x0 - 2 * kx ow, y9 - y0 - 2 * ky oh FROM i2),
g AS (SELECT vec_id, obj_idx, i3.*, greatest(0, least({_BXS})) l, greatest(0, least({_BYS})) t, least(ow, greatest({_BXS})) r, least(oh, greatest({_BYS})) bo FROM pose_box b JOIN i3 ON b.image_id = i3.image_id),
r0 AS (SELECT * FROM g WHERE r > l AND bo > t),
o AS (SELECT image_id, obj_idx, {c01('(l + r) / 2 / ow')} cx, {c01('(t + bo) / 2 / oh')} cy, {c01('(r - l) / ow')} w, {c01('(bo - t) / oh')} h FROM r0),
p AS (SELECT r0.image_id, r0.obj_idx, k, CASE WHEN {_ON} THEN {_QX} ELSE 0 END x, CASE WHEN {_ON} THEN {_QY} ELSE 0 END y, CASE WHEN {_ON} THEN v ELSE 0 END v FROM r0 JOIN pose_kpts q ON r0.vec_id = q.vec_id)
{_sql('o', 'p')}""", *_VIEWS)
def pose_tilted(s, d):
    return _rows(ps.tilted(fx.poses(s, d), _canvas(s, d)))


def _part(k: int) -> str:
    return f"max(CASE WHEN k = {k} AND {_VALID} THEN 1 ELSE 0 END) = 1"


_EYE = lambda c, s: f"abs(max(CASE WHEN k = 2 THEN {c} END) - max(CASE WHEN k = 1 THEN {c} END)) * max({s})"


@query(f"""WITH {_LIVE}, e AS (SELECT image_id, obj_idx, CASE WHEN {_EYE('x', 'width')} = 0 AND {_EYE('y', 'height')} = 0 THEN 90 ELSE degrees(atan2({_EYE('y', 'height')}, {_EYE('x', 'width')})) END tilt
 FROM q GROUP BY 1, 2 HAVING {_part(0)} AND {_part(1)} AND {_part(2)}) SELECT image_id, obj_idx, {M('tilt')} tilt_u FROM e WHERE tilt < 40""", *_VIEWS)
def pose_tilt_wanted(s, d):
    return micros(ps.tilt_wanted(*_poses(s, d), 40.0), ["image_id", "obj_idx"], ["tilt"])


# --- faces and portraits -----------------------------------------------------------------------
_P = lambda k, c, s: f"max(CASE WHEN k = {k} THEN {c} * {s} END)"
_SEEN = lambda *ks: " AND ".join(f"max(CASE WHEN k = {k} THEN v END) > 0" for k in ks)
_APART = lambda a, b: "sqrt(" + " + ".join(f"({_P(a, c, s)} - {_P(b, c, s)}) * ({_P(a, c, s)} - {_P(b, c, s)})" for c, s in (("x", "width"), ("y", "height"))) + ")"
_MEAN = lambda c, s: f"CASE WHEN {_SEEN(0, 1, 2, 3, 4)} THEN ({' + '.join(_P(k, c, s) for k in range(5))}) / 5 END"
_WIDEST = "greatest(" + ", ".join(f"CASE WHEN {_SEEN(a, b)} THEN {_APART(a, b)} END" for a, b in ((0, 1), (0, 2), (1, 2))) + ")"
_FACES = f"""{_LIVE}, f AS (SELECT image_id, obj_idx, max(width) width, max(height) height, {_MEAN('x', 'width')} face_x, {_MEAN('y', 'height')} face_y,
 CASE WHEN {_SEEN(3, 4)} THEN {_APART(3, 4)} * 1.32::DOUBLE WHEN {_WIDEST} > 0 THEN {_WIDEST} * 1.44::DOUBLE END diameter FROM q GROUP BY 1, 2)"""


@query(f"WITH {_FACES} SELECT image_id, obj_idx, {', '.join(f'coalesce({M(c)}, -1) {c}_u' for c in ('face_x', 'face_y', 'diameter'))} FROM f", *_VIEWS)
def pose_face_sizes(s, d):
    got = ps.face_sizes(*_poses(s, d))
    return got.select("image_id", "obj_idx", *[F.coalesce(u(c), F.lit(-1)).alias(f"{c}_u") for c in ("face_x", "face_y", "diameter")])


_LOW = lambda c, half, size: f"greatest(0, CASE WHEN CASE WHEN {c} - {half} < 0 THEN {c} + {half} - ({c} - {half}) ELSE {c} + {half} END > {size} THEN greatest({c} - {half}, 0) - (CASE WHEN {c} - {half} < 0 THEN {c} + {half} - ({c} - {half}) ELSE {c} + {half} END - {size}) ELSE greatest({c} - {half}, 0) END)"
_HIGH = lambda c, half, size: f"least({size}, CASE WHEN {c} - {half} < 0 THEN {c} + {half} - ({c} - {half}) ELSE {c} + {half} END)"


@query(f"""WITH {_FACES}, a AS (SELECT *, least(greatest(face_x, 0), width - 1) px, least(greatest(face_y, 0), height - 1) py FROM f WHERE face_x IS NOT NULL AND width > 1 AND height > 1),
a1 AS (SELECT *, least(px, width - px) rx, least(py, height - py) ry FROM a), a2 AS (SELECT *, coalesce(diameter * 3.0::DOUBLE / 2, least(rx, ry * 0.75::DOUBLE)) h0 FROM a1 WHERE rx > 0 AND ry > 0),
a3 AS (SELECT *, least(width / (h0 * 2), height / (h0 / 0.75::DOUBLE * 2)) fit FROM a2 WHERE h0 >= 1),
a4 AS (SELECT *, CASE WHEN diameter IS NOT NULL AND fit < 1 THEN h0 * fit ELSE h0 END hx, CASE WHEN diameter IS NOT NULL AND fit < 1 THEN h0 * fit ELSE h0 END / 0.75::DOUBLE hy FROM a3),
a5 AS (SELECT *, {_LOW('px', 'hx', 'width')} l, {_HIGH('px', 'hx', 'width')} r, {_LOW('py', 'hy', 'height')} t, {_HIGH('py', 'hy', 'height')} bo FROM a4),
a6 AS (SELECT *, CAST(round_even(l, 0) AS INT) li, CAST(round_even(t, 0) AS INT) ti FROM a5 WHERE r - l >= 1 AND bo - t >= 1)
SELECT image_id, obj_idx, li "left", ti top, greatest(li + 1, least(CAST(round_even(r, 0) AS INT), width)) "right", greatest(ti + 1, least(CAST(round_even(bo, 0) AS INT), height)) bottom FROM a6""", *_VIEWS)
def pose_portrait_crop(s, d):
    return ps.portrait_crop(ps.face_sizes(*_poses(s, d)), 0.75, 3.0).select("image_id", "obj_idx", "left", "top", "right", "bottom")


# --- matching ----------------------------------------------------------------------------------
@query(f"""WITH x AS (SELECT *, cx - w / 2 x1, cy - h / 2 y1, cx + w / 2 x2, cy + h / 2 y2 FROM pose_box),
kd AS (SELECT a.vec_id av, b.vec_id bv, sum(least(a.v, b.v) * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) / sum(least(a.v, b.v)) / sqrt(2::DOUBLE) kd
 FROM pose_kpts a JOIN pose_kpts b ON a.image_id = b.image_id AND a.k = b.k AND a.obj_idx < b.obj_idx WHERE least(a.v, b.v) > 0 GROUP BY 1, 2),
p AS (SELECT a.image_id, a.obj_idx a_idx, b.obj_idx b_idx, kd, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) / sqrt(2::DOUBLE) dd, {_overlap('a', 'b')} i, {_area('a')} aa, {_area('b')} bb
 FROM x a JOIN x b ON a.image_id = b.image_id AND a.obj_idx < b.obj_idx LEFT JOIN kd ON av = a.vec_id AND bv = b.vec_id)
SELECT image_id, a_idx, b_idx, CAST(floor(CASE WHEN kd IS NULL THEN 0.75::DOUBLE * dd + 0.25::DOUBLE * (1 - {_IOU}) ELSE 0.6::DOUBLE * kd + 0.3::DOUBLE * dd + 0.1::DOUBLE * (1 - {_IOU}) END * 10000 + 0.5) AS BIGINT) cost_t FROM p""", "pose_box", "pose_kpts")
def pose_pair_costs(s, d):
    p = fx.poses(s, d)
    return ps.pair_costs(p, p).where("a_idx < b_idx").select("image_id", "a_idx", "b_idx", F.floor(F.col("cost") * 10000 + 0.5).alias("cost_t"))

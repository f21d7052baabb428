"""Queries over label files as text, addresses, and points of two sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keypoints as kp
from ..functions import labels as lb
from ..functions import urls
from ..operators import dataset as ds
from ..operators import matching as mt
from ..streaming import ingest
from . import fixtures as fx
from .catalog import M, _anchors, _face_sql, _greedy_sql, _point_sql, _points, micros, query
from .scan_catalog import _LINES, _label_texts


# --- points ------------------------------------------------------------------------------------
@query(_point_sql("CASE WHEN c >= 0.45 THEN x ELSE 0 END", "CASE WHEN c >= 0.45 THEN y ELSE 0 END", "CASE WHEN c >= 0.45 THEN 2 ELSE 0 END", "(SELECT *, CASE WHEN k % 5 = 0 THEN 1 ELSE CAST(k AS DOUBLE) / 16 END c FROM pose_kpts)"), "pose_kpts")
def points_by_confidence(s, d):
    """A fifth of the points has no confidence, which counts as 1."""
    k = F.transform("kpts", lambda p, i: kp.from_confidence(p["x"], p["y"], F.when(i % 5 != 0, i / F.lit(16.0)), 0.45))
    return _points(fx.poses(s, d).withColumn("kpts", k))


def _with_faces(s, d):
    return fx.poses(s, d).join(fx.faces(s, d).select("vec_id", F.col("kpts").alias("face")), "vec_id")


@query(_point_sql("x", "y", "v", "(SELECT vec_id, k, x, y, v FROM pose_kpts WHERE k >= 5 UNION ALL SELECT vec_id, k, x, y, v FROM face_kpts)"), "pose_kpts", "face_kpts")
def faces_copied(s, d):
    return _points(_with_faces(s, d).withColumn("kpts", kp.copy_face(F.col("kpts"), F.col("face"))))


@query(_point_sql("CASE WHEN ok THEN fx ELSE x END", "CASE WHEN ok THEN fy ELSE y END", "CASE WHEN ok THEN fv ELSE v END", """(SELECT p.vec_id, p.k, p.x, p.y, p.v, f.x fx, f.y fy, f.v fv, coalesce(p.k BETWEEN 1 AND 4 AND f.v > 0 AND NOT (f.x = 0 AND f.y = 0), false) ok
 FROM pose_kpts p LEFT JOIN face_kpts f ON f.vec_id = p.vec_id AND f.k = p.k)"""), "pose_kpts", "face_kpts")
def eyes_and_ears_copied(s, d):
    return _points(_with_faces(s, d).withColumn("kpts", kp.copy_eyes_and_ears(F.col("kpts"), F.col("face"))))


_GREEDY = _greedy_sql("SELECT a.image_id, a.obj_idx bi, b.obj_idx oi, sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) * ((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) * ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2)) dd FROM a JOIN b ON a.image_id = b.image_id", "dd", f", {M('dd')} score_u")
_MATCHED = f"w AS (WITH {_face_sql('pose_kpts', 'a')}, {_face_sql('face_kpts', 'b')}, {_GREEDY}), base AS (WITH {_face_sql('pose_kpts', 'a')} SELECT image_id, obj_idx FROM a)"


@query(f"WITH {_MATCHED} SELECT base.image_id, CAST(base.obj_idx AS INT) base_idx, CAST(coalesce(w.other_idx, -1) AS INT) other_idx FROM base LEFT JOIN w ON w.image_id = base.image_id AND w.base_idx = base.obj_idx", "pose_kpts", "face_kpts")
def faces_with_unmatched(s, d):
    """Every pose that has a face point, with the face that it takes, or none."""
    base = _anchors(fx.poses(s, d)).where("x is not null")
    return mt.with_unmatched(base, mt.nearest_once(base, _anchors(fx.faces(s, d)))).select("image_id", "base_idx", F.coalesce("other_idx", F.lit(-1)).alias("other_idx"))


@query(f"WITH {_MATCHED} SELECT count(*) base_rows, count(w.other_idx) matched, CAST(round(avg(score_u) / 1000) AS BIGINT) mean_thousandths FROM base LEFT JOIN w ON w.image_id = base.image_id AND w.base_idx = base.obj_idx", "pose_kpts", "face_kpts")
def match_summary(s, d):
    base = _anchors(fx.poses(s, d)).where("x is not null")
    m = mt.match_summary(base, mt.nearest_once(base, _anchors(fx.faces(s, d))))
    return m.select("base_rows", "matched", F.round(F.col("mean_score") * 1000).cast("long").alias("mean_thousandths"))


# --- label files ---------------------------------------------------------------------------------
_NUMBER = "CASE WHEN {n} % {m} = 0 THEN CAST({n} // {m} AS VARCHAR) ELSE ({n} // {m}) || '.' || rtrim(lpad(CAST({n} % {m} AS VARCHAR), {w}, '0'), '0') END"


@query("""WITH b AS (SELECT image_id, obj_idx, class_id, CAST(round(cx * 1000) AS INT) x, CAST(round(cy * 100) AS INT) y, CAST(round(w * 100) AS INT) w FROM boxes),
l AS (SELECT image_id, obj_idx, class_id || ' ' || %s || ' ' || %s || ' ' || %s || ' 0.125 ' || %s || ' ' || %s || ' ' || CASE WHEN x %% 3 = 0 THEN '2' WHEN x %% 3 = 1 THEN '0' ELSE '0.5' END line FROM b)
SELECT CAST(image_id AS VARCHAR) stem, string_agg(line, chr(10) ORDER BY obj_idx) || chr(10) raw FROM l GROUP BY 1""" % tuple(_NUMBER.format(n=n, m=m, w=w) for n, m, w in (("x", 1000, 3), ("y", 100, 2), ("w", 100, 2), ("y", 100, 2), ("x", 1000, 3))), "boxes")
def label_texts(s, d):
    """Boxes with one point each as the text of label files, in line order."""
    b = fx.view(s, d, "boxes")
    share = lambda c, m: F.round(F.col(c) * m) / F.lit(float(m))
    x = F.round(F.col("cx") * 1000).cast("int")
    v = F.when(x % 3 == 0, 2.0).when(x % 3 == 1, 0.0000004).otherwise(0.5)
    point = F.array(kp.point(share("cy", 100), share("cx", 1000), v))
    rows = b.select(F.col("image_id").cast("string").alias("stem"), F.col("obj_idx").alias("line_no"), F.col("class_id").cast("string").alias("class_token"), share("cx", 1000).alias("cx"), share("cy", 100).alias("cy"), share("w", 100).alias("w"), F.lit(0.125).alias("h"), point.alias("kpts"))
    return lb.to_lines(rows, trailing_newline=True)


@query(f"""WITH {_LINES}, n AS (SELECT k.*, obj_idx - 0 line_no FROM (SELECT image_id, obj_idx, class_id, CAST(round(cx * 1000) AS INT) x, CAST(round(w * 100) AS INT) w FROM boxes) k)
SELECT CAST(image_id AS VARCHAR) stem, CAST(line_no AS INT) line_no, CAST(class_id AS INT) class_id, CASE WHEN x % 13 = 5 THEN 1500 ELSE x END cx_t, w w_h, 1 points, CASE WHEN x % 11 = 3 THEN -1 ELSE 2 END v FROM n WHERE x % 17 > 0 AND x % 19 > 0 AND x % 23 > 0""", "boxes")
def label_rows(s, d):
    """Label files as text read again: blank lines and lines that aren't poses go, the others keep their number."""
    r = lb.parse_files(_label_texts(s, d), "pose", "drop_line")
    return r.select("stem", "line_no", "class_id", F.round(F.col("cx") * 1000).cast("int").alias("cx_t"), F.round(F.col("w") * 100).cast("int").alias("w_h"), F.size("kpts").alias("points"), F.get("kpts", F.lit(0))["v"].cast("int").alias("v"))


@query(f"WITH {_LINES} SELECT CAST(image_id AS VARCHAR) stem, CAST(count(*) FILTER (kind <> 'blank') AS INT) n FROM k GROUP BY 1", "boxes")
def label_line_counts(s, d):
    return _label_texts(s, d).select("stem", ds.line_count(F.col("raw")).alias("n"))


@query("""SELECT i.image_id AS stem, CASE WHEN b.n IS NULL THEN 'missing' WHEN b.n = 0 THEN 'empty' ELSE 'labelled' END state
FROM portraits i LEFT JOIN (SELECT image_id, count(*) FILTER (class_id > 0) n FROM boxes GROUP BY 1) b ON b.image_id = i.image_id""", "portraits", "boxes")
def label_file_states(s, d):
    """Portraits whose label file is missing, has no line (all of class 0), or has some."""
    line = F.when(F.col("class_id") > 0, F.col("class_id").cast("string")).otherwise("")
    files = fx.view(s, d, "boxes").groupBy(F.col("image_id").alias("stem")).agg(F.concat_ws("\n", F.collect_list(line)).alias("raw"))
    return lb.file_states(fx.view(s, d, "portraits").withColumnRenamed("image_id", "stem"), files)


@query("SELECT image_id, width, height, n FROM images JOIN (SELECT image_id, count(*) n FROM boxes GROUP BY 1) USING (image_id)", "images", "boxes")
def images_that_must_pair(s, d):
    """Images that have a label file with what it holds; a missing one would end the job."""
    n = fx.view(s, d, "boxes").groupBy("image_id").agg(F.count("*").alias("n"))
    images = ds.paired(fx.view(s, d, "images"), n, "image_id")
    return ds.must_pair(images, n, "image_id").select("image_id", "width", "height", "n")


@query("SELECT event_id, printf('%.6f', value) six, rtrim(rtrim(printf('%.6f', value), '0'), '.') short, CASE WHEN value = 0 THEN '0.0' ELSE printf('%g', value) END general FROM events")
def number_texts(s, d):
    e = fx.table(s, d, "events")
    return e.select("event_id", lb.fixed6("value").alias("six"), lb.trimmed6("value").alias("short"), lb.general("value").alias("general"))


# --- addresses -------------------------------------------------------------------------------------
@query("SELECT DISTINCT regexp_extract(url, '^[^?#]*') url FROM pages WHERE page_id % 2 = 0 AND regexp_extract(url, '^[^?#]*') NOT IN (SELECT regexp_extract(url, '^[^?#]*') FROM pages WHERE page_id % 3 = 0)")
def unseen_addresses(s, d):
    """Addresses of even pages that no page divisible by three has."""
    p = fx.table(s, d, "pages").withColumn("url", F.regexp_extract("url", "^[^?#]*", 0))
    return ingest.unseen(p.where("page_id % 2 = 0").select("url"), p.where("page_id % 3 = 0"))


@query("SELECT c_custkey, regexp_extract(c_name, '^[^#]*') || '-' || (c_custkey % 7) stem, CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) * 10 + c_custkey % 7 number FROM customer")
def stems_and_numbers(s, d):
    """Paths with several dots and numbers: what stands after the last folder and before the last dot, and its last number."""
    c = fx.table(s, d, "customer")
    seventh = (F.col("c_custkey") % 7).cast("string")
    path = F.concat(F.lit("/a.b/c 1/"), F.regexp_extract("c_name", "^[^#]*", 0), F.lit("-"), seventh, F.lit(".jpg"))
    name = F.concat(F.lit("v2_"), F.regexp_extract("c_name", r"(\d+)$", 1), seventh, F.lit("_x"))
    return c.select("c_custkey", urls.stem(path).alias("stem"), urls.last_number(name).alias("number"))


@query(r"""WITH q AS (SELECT page_id, url, regexp_extract(url, '\?([^#]*)', 1) q FROM pages)
SELECT page_id, regexp_extract(url, '^[^?#]*') || '?' || CASE WHEN q = '' THEN 'page=9' WHEN q LIKE '%page=%' THEN regexp_replace(q, 'page=[^&]*', 'page=9') ELSE q || '&page=9' END || regexp_extract(url, '#.*$') url FROM q""")
def pages_of_nine(s, d):
    """Every address with its page set to 9, where it was or at the end."""
    return fx.table(s, d, "pages").select("page_id", urls.with_parameter(F.col("url"), "page", "9").alias("url"))


@query("SELECT event_id, event_id % 4 = 0 OR event_id % 4 = 3 asks FROM events")
def answers_that_ask_for_proof(s, d):
    e, k = fx.table(s, d, "events"), F.col("event_id") % 4
    mark = F.when(k == 0, '{"TYPE":"Captcha"}').when(k == 1, '{"type":"text"}').when(k == 2, "captcha").otherwise('{"type": "captcha"}')
    return e.select("event_id", urls.asks_for_proof(F.concat("props", mark)).alias("asks"))


@query("SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1), lambda x: 'https://e.example/' || x || '&y'))) url FROM pages")
def escaped_addresses(s, d):
    """Every page's links in escaped attributes of a result page."""
    html = F.regexp_replace("html", 'href="/([^"]*)"', '&quot;img_url&quot;:&quot;https:\\\\/\\\\/e.example\\\\/$1&amp;y&quot;')
    return fx.table(s, d, "pages").select("page_id", F.explode(urls.escaped_image_urls(html)).alias("url"))


@query("SELECT page_id, 'https://s.example/images/search?text=q&p=' || (page_id % 5 + 1) url FROM pages")
def next_result_pages(s, d):
    """Every page with result pages before and after its own linked in its text: the next one."""
    n = F.col("page_id") % 5
    link = lambda k: F.concat(F.lit('<a href="/images/search?text=q&amp;p='), (n + k).cast("string"), F.lit('">'))
    html = F.concat("html", link(3), link(-1), link(0), link(1), F.lit('<a href="/images/search?p=1">'))
    return fx.table(s, d, "pages").select("page_id", urls.next_page(html, F.lit("https://s.example/images/search?text=q"), n).alias("url"))


@query("""SELECT CAST(class_id + 1 AS INT) category_id, 'kp_0,kp_1,kp_2' points FROM (SELECT DISTINCT class_id FROM boxes)""", "boxes")
def names_that_do_not_fit(s, d):
    """Two names for three points give numbered names."""
    c = ds.coco_categories(ds.categories(fx.view(s, d, "boxes"), ["person"]), 3, ["a", "b"])
    return c.select(F.col("category_id").cast("int"), F.array_join("keypoints", ",").alias("points"))

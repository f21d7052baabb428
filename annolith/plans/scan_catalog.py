"""Queries over links of whole pages, checks of label files, and the totals that tools end with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as lb
from ..functions import urls
from ..operators import checks
from ..operators import dataset as ds
from ..operators import layout as lay
from . import fixtures as fx
from .catalog import query

_HREF = """'href="/([^"]*)"'"""


def _ordered_links(url: str, keep: str = "true") -> str:
    """Rows (page_id, url, place) of the distinct addresses that a page's own links become."""
    return f"""l AS (SELECT page_id, url page, unnest(regexp_extract_all(html, {_HREF}, 1)) x, generate_subscripts(regexp_extract_all(html, {_HREF}, 1), 1) i FROM pages),
m AS (SELECT page_id, {url} url, i FROM l), d AS (SELECT page_id, url, min(i) i FROM m WHERE {keep} GROUP BY 1, 2)
SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) place FROM d"""


def _placed(s, d, column):
    p = fx.table(s, d, "pages").select("page_id", F.posexplode(column).alias("i", "url"))
    return p.select("page_id", "url", (F.col("i") + 1).cast("long").alias("place"))


@query(f"WITH {_ordered_links("'https://i.example/' || x || '.jpg'")}")
def image_urls(s, d):
    """Every page as a result page whose links are pictures: the whole text is read."""
    return _placed(s, d, urls.image_urls(F.regexp_replace("html", 'href="/([^"]*)"', 'data-iurl="https://i.example/$1.jpg"')))


@query(f"WITH {_ordered_links("regexp_extract(page, '^([a-z]+://[^/?#]*)', 1) || '/' || x || '.png'")}")
def page_pictures(s, d):
    """Every page with pictures in the place of its links: paths joined to the page's address; a first attribute that doesn't fit gives way."""
    html = F.regexp_replace("html", '<a href="/([^"]*)"', '<img data-src="data:image/gif;base64,R0" data-original="/$1.png"')
    return _placed(s, d, urls.page_pictures(html, F.col("url")))


_OWN = "url NOT LIKE '%://www.google.com/%' AND url NOT LIKE '%://t.gstatic.com/%'"


@query(f"WITH {_ordered_links('''CASE WHEN x LIKE 't%' THEN 'https://www.google.com/' WHEN page LIKE 'https:%' THEN 'https://t.gstatic.com/' ELSE 'http://a.example/' END || x''', _OWN)}")
def result_links(s, d):
    """Every page as a result page whose links are redirects, some to the search host itself."""
    host = F.when(F.col("url").startswith("https:"), "https://t.gstatic.com/").otherwise("http://a.example/")
    html = F.regexp_replace(F.regexp_replace("html", 'href="/t', 'href="/url?q=https://www.google.com/t'), F.lit('href="/(?!url)'), F.concat(F.lit('href="/url?q='), host))
    return _placed(s, d, urls.result_links(html))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN CASE WHEN p_partkey % 4 = 0 THEN 'u' ELSE replace(p_name, ' ', '_') END || '_' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'video' ELSE replace(p_type, ' ', '_') || '.' || p_partkey END AS name FROM part""")
def video_names(s, d):
    """Names of files from what is known of videos: marks and letters beyond ASCII, blank users, three kinds of hosts."""
    p = fx.table(s, d, "part")
    number = F.when(F.col("p_partkey") % 5 == 0, "--é__").otherwise(F.concat(F.lit("_.ö"), "p_type", F.lit("."), F.col("p_partkey").cast("string"), F.lit("é-")))
    user = F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    page = F.when(F.col("p_size") % 3 == 1, "https://WWW.TikTok.com/x").when(F.col("p_size") % 3 == 2, "https://youtu.be/tiktok.com")
    return p.select("p_partkey", urls.video_name(number, F.lit(None).cast("string"), page, F.lit("https://v.example"), [F.lit(None).cast("string"), user]).alias("name"))


@query("""WITH k AS (SELECT image_id, width, height, CASE image_id % 4 WHEN 0 THEN 'HEIC' WHEN 1 THEN 'jpg' ELSE 'png' END ending, greatest(width, height) m FROM images), n AS (SELECT *, CASE WHEN m > 900 THEN m / 900::DOUBLE ELSE 1 END k FROM k)
SELECT image_id, m > 900 AS "resize", greatest(1, CAST(round_even(width / k, 0) AS INT)) width, greatest(1, CAST(round_even(height / k, 0) AS INT)) height, CASE WHEN image_id % 4 < 2 THEN 'jpg' ELSE 'png' END ending, m <= 900 AND image_id % 4 > 0 unchanged FROM n""", "images")
def resize_plan(s, d):
    ending = F.when(F.col("image_id") % 4 == 0, "HEIC").when(F.col("image_id") % 4 == 1, "jpg").otherwise("png")
    return fx.view(s, d, "images").select("image_id", g.resize_plan(F.col("width"), F.col("height"), ending, 900).alias("p")).select("image_id", "p.*")


@query("""SELECT count(*) files, CAST(sum(b) AS BIGINT) AS "before", CAST(sum(CASE WHEN b % 7 = 0 THEN 0 ELSE b // 2 END) AS BIGINT) AS "after", CAST(sum(b) - sum(CASE WHEN b % 7 = 0 THEN 0 ELSE b // 2 END) AS BIGINT) saved, count(*) FILTER (b % 7 = 0) deleted FROM (SELECT strlen(html) b FROM pages)""")
def byte_totals(s, d):
    b = fx.table(s, d, "pages").select(F.octet_length("html").cast("long").alias("before"))
    return checks.byte_totals(b.withColumn("after", F.when(F.col("before") % 7 != 0, F.expr("before div 2"))))


_KIND = """CASE WHEN abs(r - 1) <= 0.01 AND m <= 224 THEN 'square_small' WHEN abs(r - 1) <= 0.01 AND m <= 384 THEN 'square_medium' WHEN abs(r - 1) <= 0.01 THEN 'square_large'
 WHEN abs(r - 0.5) / 0.5 <= 0.01 OR abs(r - 9 / 16::DOUBLE) / (9 / 16::DOUBLE) <= 0.01 THEN 'portrait_2' WHEN abs(r - 2) / 2 <= 0.01 OR abs(r - 16 / 9::DOUBLE) / (16 / 9::DOUBLE) <= 0.01 THEN 'landscape_2'
 WHEN abs(r - 2 / 3::DOUBLE) / (2 / 3::DOUBLE) <= 0.01 THEN 'portrait_6' WHEN abs(r - 1.5) / 1.5 <= 0.01 THEN 'landscape_6' ELSE 'rest' END"""


@query(f"""WITH k AS (SELECT {_KIND} kind FROM (SELECT width::DOUBLE / height r, greatest(width, height) m FROM images)),
n AS (SELECT place, f.kind, size, kept, count(k.kind) images FROM (VALUES {", ".join(f"({i}, '{k}', {n}, {k in ds.KEPT_KINDS})" for i, (k, n) in enumerate(ds.GROUP_SIZES.items()))}) f(place, kind, size, kept) LEFT JOIN k ON k.kind = f.kind GROUP BY ALL)
SELECT CAST(place AS INT) place, kind, images, CAST(ceil(images / size::DOUBLE) * 2 AS BIGINT) mosaics, CASE WHEN kept THEN images ELSE 0 END kept, CAST(ceil(images / size::DOUBLE) * 2 AS BIGINT) + CASE WHEN kept THEN images ELSE 0 END outputs FROM n""", "images")
def planned_outputs(s, d):
    i = fx.view(s, d, "images")
    return ds.planned_outputs(i.withColumn("kind", lay.bucket(F.col("width").cast("double"), F.col("height").cast("double"))))


@query("SELECT image_id, count(*) FILTER (class_id = 0 OR class_id = 2) people FROM boxes GROUP BY 1", "boxes")
def people(s, d):
    """Class 2 stands for detections without a class."""
    return ds.people(fx.view(s, d, "boxes").withColumn("class_id", F.when(F.col("class_id") != 2, F.col("class_id"))))


@query("""SELECT count(i.image_id) images, count(l.image_id) labels, count(*) FILTER (i.image_id IS NOT NULL AND l.image_id IS NOT NULL) pairs, count(*) FILTER (i.image_id IS NULL) moved, count(*) FILTER (l.image_id IS NULL) created
FROM portraits i FULL JOIN (SELECT DISTINCT image_id FROM boxes) l ON l.image_id = i.image_id""", "portraits", "boxes")
def cleanup_totals(s, d):
    return checks.cleanup_totals(fx.view(s, d, "portraits"), fx.view(s, d, "boxes").select("image_id"), "image_id")


@query("""WITH n AS (SELECT source, count(*) FILTER (image_id % 8 > 0) ti, count(*) FILTER (image_id % 8 = 0) vi, CAST(sum(CASE WHEN image_id % 8 > 0 THEN c ELSE 0 END) AS BIGINT) tn, CAST(sum(CASE WHEN image_id % 8 = 0 THEN c ELSE 0 END) AS BIGINT) vn
 FROM images JOIN (SELECT image_id, count(*) c FROM boxes GROUP BY 1) USING (image_id) GROUP BY 1),
r AS (SELECT row_number() OVER (ORDER BY source) + 2 pos, '- ' || source || ': ' || ti + vi || ' images (train ' || ti || ', val ' || vi || '); ' || tn + vn || ' instances (train ' || tn || ', val ' || vn || ')' line FROM n),
t AS (SELECT count(*) k, CAST(sum(ti) AS BIGINT) ti, CAST(sum(vi) AS BIGINT) vi, CAST(sum(tn) AS BIGINT) tn, CAST(sum(vn) AS BIGINT) vn FROM n)
SELECT * FROM r UNION ALL VALUES (0, '# Merge Summary'), (1, ''), (2, 'Sources merged:') UNION ALL SELECT k + 3, '' FROM t
UNION ALL SELECT k + 4, 'Totals: ' || ti + vi || ' images (train ' || ti || ', val ' || vi || '); ' || tn + vn || ' instances (train ' || tn || ', val ' || vn || ')' FROM t""", "images", "boxes")
def merge_summary(s, d):
    n = fx.view(s, d, "boxes").groupBy("image_id").agg(F.count("*").alias("c"))
    i = fx.view(s, d, "images").join(n, "image_id")
    train = F.col("image_id") % 8 > 0
    counts = i.groupBy("source").agg(F.count_if(train).alias("train_images"), F.count_if(~train).alias("val_images"), F.sum(F.when(train, F.col("c")).otherwise(0)).alias("train_instances"), F.sum(F.when(~train, F.col("c")).otherwise(0)).alias("val_instances"))
    return checks.merge_summary(counts)


def _label_texts(s, d):
    """Label files of all images as text: class, box, one point; some lines lack a number, some have a word, some are blank."""
    b = fx.view(s, d, "boxes").select("image_id", "obj_idx", "class_id", F.round(F.col("cx") * 1000).cast("int").alias("x"), F.round(F.col("w") * 100).cast("int").alias("w"))
    text = lambda c, n: F.concat(F.lit("0."), F.lpad(F.col(c).cast("string"), n, "0"))
    numbers = [F.when(F.col("x") % 13 == 5, "1.5").otherwise(text("x", 3)), F.lit("0.5"), F.when(F.col("w") == 0, "0").otherwise(text("w", 2)), F.lit("0.25"), F.lit("0.5"), F.lit("0.5"), F.when(F.col("x") % 11 == 3, "-1").otherwise("2")]
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *numbers)
    line = F.when(F.col("x") % 17 == 0, F.regexp_replace(line, " [^ ]*$", "")).when(F.col("x") % 19 == 0, F.concat(line, F.lit(" 0.1 word 2"))).when(F.col("x") % 23 == 0, "  ").otherwise(line)
    files = b.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("obj_idx", line.alias("line")))).alias("l"))
    return files.select(F.col("image_id").cast("string").alias("stem"), F.concat_ws("\n", F.transform("l", lambda x: x["line"])).alias("raw"))


_LINES = """b AS (SELECT image_id, class_id, CAST(round(cx * 1000) AS INT) x, CAST(round(w * 100) AS INT) w FROM boxes),
k AS (SELECT *, CASE WHEN x % 17 = 0 THEN 'short' WHEN x % 19 = 0 THEN 'word' WHEN x % 23 = 0 THEN 'blank' ELSE 'fine' END kind FROM b)"""


@query(f"""WITH {_LINES}, c AS (SELECT 0 place, 'no_label_file' problem, count(*) n FROM portraits WHERE image_id NOT IN (SELECT image_id FROM boxes)
UNION ALL SELECT 1, 'no_image', count(DISTINCT image_id) FROM boxes WHERE image_id NOT IN (SELECT image_id FROM portraits) UNION ALL SELECT 2, 'same_stem', 0
UNION ALL SELECT 3, 'line', count(*) FROM k WHERE kind IN ('short', 'word') UNION ALL SELECT 4, 'class', count(*) FROM k WHERE kind = 'fine' AND class_id >= 2 UNION ALL SELECT 5, 'points', 0
UNION ALL SELECT 6, 'box', count(*) FROM k WHERE kind = 'fine' AND (x % 13 = 5 OR w = 0) UNION ALL SELECT 7, 'visibility', count(*) FROM k WHERE kind = 'fine' AND x % 11 = 3)
SELECT CAST(place AS INT) place, problem, n FROM c""", "portraits", "boxes")
def dataset_check(s, d):
    """Labels of all images against the portraits, which share some of their names."""
    report = checks.check_dataset(fx.view(s, d, "portraits").select(F.col("image_id").cast("string").alias("stem")), _label_texts(s, d), 2, 1)
    return checks.totals(report)


@query(f"""WITH {_LINES} SELECT CAST(image_id AS VARCHAR) stem, CAST(count(*) FILTER (kind = 'fine') AS INT) poses, CAST(count(*) FILTER (kind IN ('short', 'word')) AS INT) skipped, CAST(count(*) FILTER (kind = 'fine') AS INT) mismatched FROM k GROUP BY 1""", "boxes")
def pose_file_counts(s, d):
    """All poses have one point; two are expected."""
    return lb.pose_files(_label_texts(s, d), 2)


@query("SELECT event_id, CAST(h - 100 AS INT) height FROM (SELECT event_id, CAST(floor(value) AS INT) % 300 h FROM events) WHERE h > 100")
def frames_tall_enough(s, d):
    e = fx.table(s, d, "events").select("event_id", g.cut_height(F.floor("value").cast("int") % 300, 50).alias("height"))
    return e.where("height IS NOT NULL")

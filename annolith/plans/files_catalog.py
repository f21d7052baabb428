"""Queries over records' features, exports line by line, and rows up to a target."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pictures, records
from ..operators import dataset as ds
from ..operators import export
from . import fixtures as fx
from .catalog import query

_JPEG, _WEBP, _TEXT = "FFD8FFE000104A46", "524946460000000057454250", "68656C6C6F"


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'image' WHEN event_id % 4 = 1 THEN 'png' WHEN event_id % 5 < 3 THEN 'blob' WHEN event_id % 7 = 2 THEN 'extra' END AS "key",
 CASE WHEN event_id % 3 = 0 THEN '{_TEXT}' WHEN event_id % 4 = 1 THEN '{_JPEG}' WHEN event_id % 5 < 3 THEN '{_JPEG}' WHEN event_id % 7 = 2 THEN '{_WEBP}' END data,
 CASE WHEN event_id % 2 = 0 THEN 'img_' || event_id ELSE 'image_' || lpad(CAST(event_id AS VARCHAR), greatest(6, length(CAST(event_id AS VARCHAR)))::INT, '0') END stem FROM events""")
def record_pictures(s, d):
    """A named feature is taken whatever it holds; of others the first that begins as a picture does, but no file's name."""
    e, i = fx.table(s, d, "events"), F.col("event_id")
    have = lambda when, key, value: F.when(when, F.struct(F.lit(key).alias("key"), value.alias("value")))
    hexes = lambda x: F.unhex(F.lit(x))
    name = F.concat(F.lit("some/folder/img_"), i.cast("string"), F.lit(".jpg")).cast("binary")
    entries = F.array(
        have(i % 2 == 0, "filename", name), have(i % 3 > 0, "image/name", F.when(i % 2 == 0, name)), have(F.lit(True), "label", hexes(_TEXT)), have(i % 5 < 3, "blob", hexes(_JPEG)),
        have(i % 7 == 2, "extra", hexes(_WEBP)), have(i % 4 == 1, "png", hexes(_JPEG)), have(i % 3 == 0, "image", hexes(_TEXT)),
    )
    f = e.select("event_id", F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())).alias("features"))
    p = f.select("event_id", records.picture(F.col("features")).alias("p"), records.stem_of(F.col("features"), i).alias("stem"))
    return p.select("event_id", "p.key", F.hex("p.data").alias("data"), "stem")


@query("""SELECT o_orderkey, CAST(before AS BIGINT) successes FROM (SELECT o_orderkey, coalesce(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM orders)
WHERE before < (SELECT count(*) // 20 FROM orders)""")
def rows_until_enough(s, d):
    """Orders by date until a twentieth as many urgent ones as there are orders have come."""
    o = fx.table(s, d, "orders")
    rows = o.select("o_orderkey", "o_orderdate", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return ds.until_enough(rows, ["o_orderdate", "o_orderkey"], "urgent", o.count() // 20).select("o_orderkey", "successes")


_INFO = '{"info": {"description": "test", "version": "1.0", "year": 0, "contributor": "", "date_created": ""}, "licenses": [{"id": 1, "name": "free"}], "images": ['


@query(f"""WITH g AS (SELECT image_id, width, height, CASE WHEN image_id % 8 = 0 THEN 'val' ELSE 'train' END AS "split" FROM images),
a AS (SELECT g."split", image_id * 100 + obj_idx id, image_id, class_id + 1 category_id, CAST(floor(cx * 1000 + 0.5) AS BIGINT) l, CAST(floor(cy * 1000 + 0.5) AS BIGINT) t, CAST(floor(w * 1000 + 0.5) AS BIGINT) bw, CAST(floor(h * 1000 + 0.5) AS BIGINT) bh FROM boxes JOIN g USING (image_id)),
j AS (SELECT "split", 1 section, image_id id, '{{"id":' || image_id || ',"file_name":"' || image_id || '.jpg","width":' || width || ',"height":' || height || '}}' j FROM g
 UNION ALL SELECT "split", 2, id, '{{"id":' || id || ',"image_id":' || image_id || ',"category_id":' || category_id || ',"bbox":[' || l || ',' || t || ',' || bw || ',' || bh || '],"area":' || bw * bh || ',"iscrowd":0,"keypoints":[],"num_keypoints":0}}' FROM a
 UNION ALL SELECT "split", 3, c + 1, '{{"category_id":' || c + 1 || ',"name":"' || CASE c WHEN 0 THEN 'person' ELSE 'class_' || c END || '"}}' FROM (SELECT DISTINCT "split" FROM g), (SELECT DISTINCT class_id c FROM boxes)),
n AS (SELECT "split", section, row_number() OVER (PARTITION BY "split", section ORDER BY id) pos, j FROM j)
SELECT "split", CAST(section AS INT) section, pos, CASE WHEN pos > 1 THEN ',' ELSE '' END || j line FROM n
UNION ALL SELECT "split", CAST(section AS INT), 0, line FROM (SELECT DISTINCT "split" FROM g), (VALUES (1, '{_INFO}'), (2, '], "annotations": ['), (3, '], "categories": ['), (4, ']}}')) v(section, line)""", "images", "boxes")
def export_lines(s, d):
    """All boxes as the lines of two JSON documents."""
    split = F.when(F.col("image_id") % 8 == 0, "val").otherwise("train").alias("split")
    images = fx.view(s, d, "images").select(split, F.col("image_id").alias("id"), F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"), "width", "height")
    thousandths = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    b = fx.view(s, d, "boxes").select(split, (F.col("image_id") * 100 + F.col("obj_idx")).alias("id"), "image_id", (F.col("class_id") + 1).alias("category_id"), *[thousandths(c).alias(n) for c, n in (("cx", "left"), ("cy", "top"), ("w", "box_w"), ("h", "box_h"))])
    b = b.withColumns({"area": F.col("box_w") * F.col("box_h"), "kpts": F.expr("CAST(array() AS array<struct<x: double, y: double, v: double>>)")})
    return export.document_lines(images, b, ds.categories(fx.view(s, d, "boxes"), ["person"]), {"description": "test"}, [{"id": 1, "name": "free"}])


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 100) AS BIGINT)) g FROM embeddings),
t AS (SELECT vec_id, g, unnest(range(24)) i FROM p),
c AS (SELECT vec_id, g, i, 6 - 1 - i % 6 y, 4 - 1 - i // 6 x FROM t)
SELECT vec_id, CAST(sum((i + 1) * g[(y + 1) * 8 + x + 2 + 1]) AS BIGINT) checksum FROM c GROUP BY 1""")
def cropped_pictures(s, d):
    """Vectors as pictures of 8 x 8 grey values: a part of 4 x 6, mirrored, turned by 90 degrees; each pixel weighs by its place."""
    e = fx.table(s, d, "embeddings")
    grey = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 100).cast("long")), 2, "0")), ""))
    n = lambda *v: [F.lit(k) for k in v]
    part = pictures.turn(pictures.crop(grey, *n(8, 8, 2, 1, 6, 7)), *n(4, 6, 90, True))
    weighed = F.expr("aggregate(sequence(1, 24), 0L, (a, i) -> a + i * CAST(conv(hex(substring(part, i, 1)), 16, 10) AS BIGINT))")
    return e.select("vec_id", part.alias("part")).select("vec_id", weighed.alias("checksum"))

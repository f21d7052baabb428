"""Queries over data sets as a whole: names, counters, conflicts, categories, frames by block."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keypoints as kp
from ..operators import dataset as ds
from ..operators import sequence as sq
from . import fixtures as fx
from .catalog import M, micros, query


@query("""SELECT p_partkey, CASE WHEN n = 0 THEN p_type ELSE p_type || '_' || lpad(CAST(n AS VARCHAR), greatest(2, length(CAST(n AS VARCHAR)))::INT, '0') END unique_name
FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 n FROM part)""")
def unique_names(s, d):
    return ds.unique_names(fx.table(s, d, "part"), "p_type", ["p_partkey"]).select("p_partkey", "unique_name")


@query("""SELECT image_id, 7 + row_number() OVER (PARTITION BY source ORDER BY CASE WHEN width > height THEN 0 ELSE 1 END, image_id) - 1 number FROM images""", "images")
def prefix_counter(s, d):
    return ds.numbered_by_prefix(fx.view(s, d, "images"), "source", [F.when(F.col("width") > F.col("height"), 0).otherwise(1), "image_id"], 7).select("image_id", "number")


@query("""WITH p AS (SELECT o_orderkey source, o_orderkey - o_orderkey % 2 + 200 target FROM orders),
t AS (SELECT target, 'duplicate' problem FROM p GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT DISTINCT target, 'exists' problem FROM p WHERE target IN (SELECT o_custkey + 1400 FROM orders) AND target NOT IN (SELECT source FROM p))
SELECT * FROM t UNION ALL SELECT * FROM e""")
def rename_conflicts(s, d):
    o = fx.table(s, d, "orders")
    plan = o.select(F.col("o_orderkey").alias("source"), (F.col("o_orderkey") - F.col("o_orderkey") % 2 + 200).alias("target"))
    return ds.conflicts(plan, "source", "target", o.select((F.col("o_custkey") + 1400).alias("target")).distinct())


_ASKED = [*kp.NAMES, "tail", "wing"]
_NAMES = ", ".join(f"'{n}'" for n in _ASKED)


@query(f"""SELECT CAST(n.place AS INT) place, n.name, count(k.k) n FROM (SELECT unnest(range({len(_ASKED)})) place, unnest([{_NAMES}]) name) n
LEFT JOIN (SELECT k FROM pose_kpts WHERE v > 0 AND NOT (x = 0 AND y = 0)) k ON k.k = n.place GROUP BY 1, 2""", "pose_kpts")
def keypoint_counts(s, d):
    """How often each point is seen; two more names are asked for that no row has."""
    table = F.array(*[F.lit(n) for n in kp.NAMES])
    seen = fx.poses(s, d).select(F.posexplode("kpts").alias("k", "p")).where(kp.valid(F.col("p"))).select(F.get(table, F.col("k")).alias("name"))
    return ds.counts_of_all(seen, "name", _ASKED)


@query("""SELECT key, count(*) n FROM (SELECT event_id, unnest(json_keys(props)) key FROM events) GROUP BY 1""")
def key_histogram(s, d):
    return ds.key_histogram(fx.table(s, d, "events").select(F.json_object_keys("props").alias("keys")), "keys")


@query(f"""SELECT class_id + 1 category_id, CASE class_id WHEN 0 THEN 'person' ELSE 'class_' || class_id END name, CASE class_id WHEN 0 THEN 'person' ELSE 'object' END supercategory,
'{",".join(kp.NAMES)}' points, '{",".join(f"{a}-{b}" for a, b in kp.EXPORTED_EDGES)}' edges FROM (SELECT DISTINCT class_id FROM pose_box)""", "pose_box")
def coco_pose_categories(s, d):
    c = ds.coco_categories(ds.categories(fx.view(s, d, "pose_box"), ["person"]), 17)
    return c.select(F.col("category_id").cast("int"), "name", "supercategory", F.array_join("keypoints", ",").alias("points"), F.array_join(F.transform("skeleton", lambda e: F.concat(e[0].cast("string"), F.lit("-"), e[1].cast("string"))), ",").alias("edges"))


@query(f"""WITH f AS (SELECT label seq_id, vec_id frame_index, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) before FROM embeddings),
x AS (SELECT seq_id, frame_index, unnest(range(64)) pos_, unnest(embedding) a, unnest(before) b FROM f WHERE before IS NOT NULL),
m AS (SELECT seq_id, frame_index, pos_ // 24 * 3 + pos_ % 8 // 3 tile, avg(abs(a::DOUBLE - b::DOUBLE)) mean FROM x GROUP BY ALL)
SELECT seq_id, frame_index, {M('max(mean)')} difference_u FROM m GROUP BY 1, 2 HAVING max(mean) <= 0.2""")
def similar_frames_block(s, d):
    """Vectors as pictures of 8 x 8 grey values in blocks of 3, each label a sequence."""
    frames = fx.table(s, d, "embeddings").select(F.col("label").alias("seq_id"), F.col("vec_id").alias("frame_index"), F.col("embedding").cast("array<double>").alias("pixels"))
    return micros(sq.block_duplicates(frames, "pixels", 8, 3, 0.2), ["seq_id", "frame_index"], ["difference"])


@query("SELECT seq_id, frame_index, event_id FROM frames WHERE frame_index BETWEEN 5 AND 20", "frames")
def frames_in_range(s, d):
    return sq.in_range(fx.view(s, d, "frames"), 5, 20).select("seq_id", "frame_index", "event_id")


@query("SELECT image_id, obj_idx FROM boxes QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY obj_idx DESC) = 3", "boxes")
def third_from_the_end(s, d):
    return sq.from_the_end(fx.view(s, d, "boxes"), ["image_id"], [F.desc("obj_idx")], 2).select("image_id", "obj_idx")


@query("""WITH e AS (SELECT seq_id, frame_index, event_id, CASE WHEN feat < 30 THEN 1 ELSE 0 END none FROM frames),
r AS (SELECT *, sum(none) OVER (PARTITION BY seq_id ORDER BY frame_index ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) run FROM e),
m AS (SELECT *, coalesce(max(CASE WHEN run = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ended FROM r)
SELECT seq_id, frame_index, event_id FROM m WHERE ended = 0""", "frames")
def pages_until_empty(s, d):
    pages = fx.view(s, d, "frames").withColumn("hits", F.when(F.col("feat") < 30, 0).otherwise(1))
    return sq.until_empty(pages, "seq_id", "frame_index", "hits").select("seq_id", "frame_index", "event_id")

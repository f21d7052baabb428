"""Annotation tables derived from the test tables, as one SQL text for both engines.

``E(i)`` is the i-th component of an embedding (from 1) as a double.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS: dict[str, tuple[list[str], str]] = {
    "images": (["orders"], """
SELECT o_orderkey image_id, CAST(320 + (o_custkey % 1600) AS INT) width, CAST(240 + ((o_orderkey * 7) % 1400) AS INT) height,
       o_orderpriority source FROM orders"""),
    "portraits": (["customer"], "SELECT c_custkey image_id FROM customer"),
    "boxes": (["lineitem"], """
SELECT l_orderkey image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 obj_idx,
       l_linenumber % 3 class_id, (l_partkey % 1000) / CAST(1000 AS DOUBLE) cx, (l_suppkey % 100) / CAST(100 AS DOUBLE) cy,
       l_quantity / CAST(100 AS DOUBLE) w, CAST(0.02 AS DOUBLE) + l_discount * 4 h, l_extendedprice score FROM lineitem"""),
    "pose_box": (["embeddings"], """
SELECT vec_id, CAST(floor(vec_id / 4.0) AS BIGINT) image_id, vec_id % 4 obj_idx, CASE WHEN label < 8 THEN 0 ELSE 1 END class_id,
       0.5 + E(52) cx, 0.5 + E(53) cy, 0.05 + abs(E(54)) w, 0.05 + abs(E(55)) h, 0.5 + E(56) score FROM embeddings"""),
    "frames": (["events"], """
SELECT user_id seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) frame_index, event_id, event_type, value feat FROM events"""),
}

#: One row per keypoint: the second source is shifted, in reverse order, and sees fewer points.
KPTS = " UNION ALL ".join(
    f"""SELECT vec_id, CAST(floor(vec_id / 4.0) AS BIGINT) image_id, vec_id % 4 obj_idx, {k} k,
 least(greatest(0.5 + E({3 * k + 1}), 0.0), 1.0) x, least(greatest(0.5 + E({3 * k + 2}), 0.0), 1.0) y, CASE WHEN E({3 * k + 3}) > -0.05 THEN 2 ELSE 0 END v FROM embeddings"""
    for k in range(17)
)
FACE = " UNION ALL ".join(
    f"""SELECT vec_id, CAST(floor(vec_id / 4.0) AS BIGINT) image_id, 3 - (vec_id % 4) obj_idx, {k} k,
 least(greatest(0.5 + E({3 * k + 1}) + (label - 5) * 0.01, 0.0), 1.0) x, least(greatest(0.5 + E({3 * k + 2}) - (label - 5) * 0.01, 0.0), 1.0) y, CASE WHEN E({3 * k + 3}) > 0.0 THEN 2 ELSE 0 END v
 FROM embeddings"""
    for k in range(5)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    text = re.sub(r"\bE\((\d+)\)", r"CAST(element_at(embedding, \1) AS DOUBLE)", text)
    for t in tables:
        text = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def _points(count: int, x: str, y: str, seen: str):
    e = lambda k, i: f"CAST(element_at(embedding, 3 * {k} + {i}) AS DOUBLE)"
    at = lambda i, shift: f"least(greatest(0.5D + {e('k', i)}{shift}, 0.0D), 1.0D)"
    return F.expr(f"transform(sequence(0, {count - 1}), k -> named_struct('x', {at(1, x)}, 'y', {at(2, y)}, 'v', CAST(CASE WHEN {e('k', 3)} > {seen} THEN 2 ELSE 0 END AS DOUBLE)))")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with an array of 17 keypoints."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", _points(17, "", "", "-0.05D").alias("kpts"))
    return view(spark, sf_dir, "pose_box").join(e, "vec_id")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second source: an array of five keypoints."""
    e = table(spark, sf_dir, "embeddings")
    shift = "CAST(label - 5 AS DOUBLE) * 0.01D"
    return e.select("vec_id", F.expr("CAST(floor(vec_id / 4.0) AS BIGINT)").alias("image_id"), F.expr("3 - (vec_id % 4)").alias("obj_idx"), _points(5, f" + {shift}", f" - {shift}", "0.0D").alias("kpts"))


def with_views(sql: str, *names: str) -> str:
    """DuckDB text that begins with the named views."""
    texts = {n: t for n, (_, t) in VIEWS.items()} | {"pose_kpts": KPTS, "face_kpts": FACE}
    found = {n: re.sub(r"\bE\((\d+)\)", r"CAST(embedding[\1] AS DOUBLE)", texts[n]) for n in names}
    head = ", ".join(f"{n} AS ({t})" for n, t in found.items())
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"

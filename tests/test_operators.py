"""Hand-computed cases and brute force."""

import itertools
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.functions import geometry as g
from annolith.functions import keypoints as kp
from annolith.functions import labels, urls
from annolith.operators import boxes as bx
from annolith.operators import dataset as ds
from annolith.operators import export, layout
from annolith.operators import matching as mt
from annolith.plans import fixtures as fx
from annolith.sources import files, tfrecord

D = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_visibility_of_export(spark):
    values = [-1.0, 0.0, 0.49, 0.5, 1.0, 1.4, 1.5, 2.5, 7.0, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["x"] for r in df.orderBy("i").select(kp.exported_visibility(F.col("v")).alias("x")).collect()]
    assert got == [0, 0, 0, 2, 2, 1, 2, 2, 2, 0]


def test_binarize(spark):
    for v, want in ((-0.5, 0), (1.0, 2), (1.7, 1), (2.0, 2), (0.39, 0), (0.4, 2)):
        p = one(spark, kp.binarize(kp.point(0.3, 0.4, v)))
        assert p["v"] == want and (p["x"] == 0) == (want == 0)


def test_blends(spark):
    a, b = F.array(kp.point(0.4, 0.4, 2)), F.array(kp.point(0.8, 0.8, 1))
    p = one(spark, kp.blend_face(a, b, 0.25))[0]
    assert [round(p[c], 9) for c in "xyv"] == [0.5, 0.5, 1]
    p = one(spark, kp.average_face(F.array(kp.point(0.4, 0.4, 2)), F.array(kp.point(0.8, 0.6, 1))))[0]
    assert [round(p[c], 9) for c in "xyv"] == [0.6, 0.5, 1.5]


def images(spark, w, h):
    return spark.createDataFrame([(1, w, h, "a")], "image_id long, width int, height int, source string")


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "image_id long, obj_idx int, class_id int, cx double, cy double, w double, h double, score double")


def test_margin_crop(spark):
    env = bx.envelope(boxes(spark, (0, 0.5, 0.5, 0.2, 0.4, 1.0)), images(spark, 200, 100))
    r = bx.margin_crop(env, 20).first()
    assert (r["left"], r["top"], r["right"], r["bottom"]) == (60, 10, 140, 90)
    r = bx.rewrite_for_crop(boxes(spark, (0, 0.5, 0.5, 0.2, 0.4, 1.0)), bx.margin_crop(env, 20)).first()
    assert [round(r[c], 9) for c in bx.BOX] == [0.5, 0.5, 0.5, 0.5]


def test_turn(spark):
    r = bx.turn(boxes(spark, (1, 0.25, 0.5, 0.1, 0.2, 1.0)), images(spark, 200, 100), 90).first()
    assert [round(r[c], 9) for c in bx.BOX] == [0.5, 0.25, 0.2, 0.1]


def test_turning_four_times_changes_nothing(spark):
    b, sizes = boxes(spark, (0, 0.3, 0.6, 0.2, 0.1, 1.0)), [(200, 100), (100, 200)] * 2
    start = b.first()
    for w, h in sizes:
        b = bx.turn(b, images(spark, w, h), 90)
    r = b.first()
    assert [round(r[c] - start[c], 9) for c in bx.BOX] == [0, 0, 0, 0]


def test_extend(spark):
    got = {r["copy"]: round(r["cx"], 9) for r in bx.extend_with_flip(boxes(spark, (0, 0.25, 0.5, 0.1, 0.2, 1.0)), images(spark, 100, 200)).collect()}
    assert got == {0: 0.125, 1: 0.875}


def test_suppress_spares_what_a_dropped_box_overlaps(spark):
    b = boxes(spark, (0, 0.5, 0.5, 0.2, 0.2, 0.9), (0, 0.55, 0.5, 0.2, 0.2, 0.8), (0, 0.72, 0.5, 0.2, 0.2, 0.7))
    assert sorted(r["obj_idx"] for r in mt.suppress(bx.with_corners(b)).collect()) == [0, 2]


def test_self_mosaic(spark):
    got = layout.self_mosaic(images(spark, 200, 100)).orderBy("step").collect()
    assert (got[0]["canvas_w"], got[0]["canvas_h"]) == (200, 240)
    # Tiles of a 200 x 100 image computed by hand for the 140 pixels below it.
    first = got[0]
    assert (first["x"], first["y"], first["tile_w"], first["tile_h"], first["rotation"], first["flip"]) == (0, 100, 70, 140, 90, False)
    assert all(r["x"] + r["tile_w"] <= 200 and r["y"] + r["tile_h"] <= 240 for r in got)
    for a, b in itertools.combinations(got, 2):
        assert min(a["x"] + a["tile_w"], b["x"] + b["tile_w"]) <= max(a["x"], b["x"]) or min(a["y"] + a["tile_h"], b["y"] + b["tile_h"]) <= max(a["y"], b["y"])


def test_greedy_is_a_loop(spark):
    m = kp.face_middle(F.col("kpts"))
    pick = lambda df: df.select("image_id", "obj_idx", m["x"].alias("x"), m["y"].alias("y"))
    base, other = pick(fx.poses(spark, D)), pick(fx.faces(spark, D))
    got = {(r["image_id"], r["base_idx"]): r["other_idx"] for r in mt.nearest_once(base, other).collect()}
    want = {}
    a, b = base.toPandas(), other.toPandas()
    for image, rows in a.groupby("image_id"):
        left = b[(b.image_id == image) & b.x.notna()].sort_values("obj_idx").to_dict("records")
        for r in rows.sort_values("obj_idx").to_dict("records"):
            if left and r["x"] == r["x"]:
                k = min(range(len(left)), key=lambda i: (np.sqrt((r["x"] - left[i]["x"]) ** 2 + (r["y"] - left[i]["y"]) ** 2), left[i]["obj_idx"]))
                want[image, r["obj_idx"]] = left.pop(k)["obj_idx"]
    assert got == want


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = (int(k) for k in rng.integers(1, 6, 2))
        cost = rng.random((n, m))
        got = mt.assignment(cost)
        k = min(n, m)
        assert len(got) == k and len({i for i, _ in got}) == k and len({j for _, j in got}) == k
        if n <= m:
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert abs(sum(cost[i, j] for i, j in got) - best) < 1e-9


def test_split_counts(spark):
    rows = [(f"{d}", f"{i:03d}") for d, n in (("a", 63), ("b", 66), ("c", 64)) for i in range(n)]
    got = ds.split_every(spark.createDataFrame(rows, "source string, name string"), "source", "name").toPandas()
    val = got[got.split == "val"]
    assert val.groupby("source").size().to_dict() == {"b": 8, "c": 8}
    assert val[val.source == "c"].name.min() == "005"


def test_rename_width(spark):
    got = ds.rename_plan(spark.createDataFrame([(f"{i:02d}",) for i in range(12)], "name string"), "name", 95).toPandas()
    assert sorted(got.new_name) == [f"{n:03d}" for n in range(95, 107)]


LINES = "0 0.5 0.5 0.2 0.2\n\n1 0.1 0.2 0.3 0.4 0.5 0.6 2\nx 1 2 3 4\n0 0.5 0.5 0.2 0.2 0.1\n0 1"


@pytest.mark.parametrize("dialect, good", [("strict", 2), ("fixed", 1), ("lenient", 4), ("padded", 2), ("pose", 1)])
def test_dialects(spark, dialect, good):
    f = spark.createDataFrame([("a", LINES), ("b", "")], "stem string, raw string")
    assert labels.parse_files(f, dialect, "drop_line").count() == good


def test_label_errors(spark):
    f = spark.createDataFrame([("a", LINES), ("b", "0 0.5 0.5 0.1 0.1")], "stem string, raw string")
    assert [r["stem"] for r in labels.parse_files(f, "strict", "drop_image").collect()] == ["b"]
    with pytest.raises(Exception, match="label line of a"):
        labels.parse_files(f, "strict", "fail").collect()
    with pytest.raises(ValueError):
        labels.parse_line(F.col("x"), "other")


def test_lines_round_trip(spark):
    raw = "0 0.5 0.5 0.2 0.2 0.1 0.2 2\n1 0.123457 0 1 0.25"
    f = spark.createDataFrame([("a", raw)], "stem string, raw string")
    assert labels.to_lines(labels.parse_files(f)).first()["raw"] == raw


def test_formatters(spark):
    df = spark.createDataFrame([(0, 0.1234565), (1, 0.0000005), (2, -0.0000001)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(labels.fixed6("v")).collect()] == ["0.123456", "0.000000", "-0.000000"]
    assert [r[0] for r in df.select(labels.trimmed6("v")).collect()] == ["0.123456", "0", "0"]


def test_three_states(spark):
    img = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    f = spark.createDataFrame([("a", "0 1 1 1 1"), ("b", " \n")], "stem string, raw string")
    assert {r["stem"]: r["state"] for r in labels.file_states(img, f).collect()} == {"a": "labelled", "b": "empty", "c": "missing"}


def test_urls(spark):
    assert one(spark, urls.clean(F.lit("//a.b/c\\u003dd%20e+f"))) == "https://a.b/c=d e+f"
    assert one(spark, urls.last_number(F.lit("frame12_003x"))) == 3
    assert one(spark, urls.last_number(F.lit("abc"))) is None
    assert one(spark, urls.safe_name(F.lit("a b!"))) == "a_b"
    assert one(spark, urls.stem(F.lit("/x/y.z/a.b.jpg"))) == "a.b"


def test_iou(spark):
    c = [tuple(F.lit(float(v)) for v in b) for b in ((0, 0, 2, 2), (1, 1, 3, 3), (5, 5, 5, 5))]
    assert abs(one(spark, g.iou(c[0], c[1])) - 1 / 7) < 1e-12
    assert one(spark, g.iou(c[2], c[2])) == 0


def test_label_folder_and_headers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 1 1 1 1\n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 30, 20))
    (tmp_path / "q.JPG").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\0" * 8)
    (tmp_path / "bad.bmp").write_bytes(b"xx")
    got = {r["stem"]: r["raw"] for r in files.label_files(spark, str(tmp_path)).collect()}
    assert got == {"a": "0 1 1 1 1\n", "b": ""}
    sizes = {r["stem"]: (r["width"], r["height"]) for r in files.images(spark, str(tmp_path)).collect()}
    assert sizes == {"p": (30, 20), "q": (9, 7), "bad": (None, None)}


def test_tfrecord(spark, tmp_path):
    def field(n, payload):
        return bytes([n << 3 | 2, len(payload)]) + payload

    entry = field(1, b"image") + field(2, field(1, field(1, b"\x89PNG")))
    payload = field(1, field(1, entry))
    head = struct.pack("<Q", len(payload))
    (tmp_path / "x.tfrecord").write_bytes(head + struct.pack("<I", tfrecord.masked_crc(head)) + payload + b"\0\0\0\0")
    spark.dataSource.register(tfrecord.TFRecordSource)
    r = spark.read.format("tfrecord").load(str(tmp_path)).collect()
    assert [(x["record"], bytes(x["features"]["image"])) for x in r] == [(0, b"\x89PNG")]


def test_export(spark):
    img = spark.createDataFrame([("train", 1, "a.jpg", 4, 5)], "split string, id int, file_name string, width int, height int")
    ann = spark.createDataFrame([("train", 1, 1, 1, 0.0, 0.0, 2.0, 2.0, 4.0)], "split string, id int, image_id int, category_id int, left double, top double, box_w double, box_h double, area double")
    ann = ann.withColumn("kpts", F.array(kp.point(0.5, 0.5, 2), kp.point(0, 0, 0)))
    doc = json.loads(export.documents(img, ann, spark.createDataFrame([(1, "person")], "id int, name string")).first()["document"])
    assert doc["annotations"][0]["num_keypoints"] == 1 and doc["categories"][0]["name"] == "person"


def test_ratio_crop_holds_the_envelope(spark):
    env = bx.envelope(fx.view(spark, D, "boxes"), fx.view(spark, D, "images"))
    got = bx.ratio_crop(env).where("ratio is not null").select("image_id", "left", "top", "right", "bottom").join(env, "image_id")
    bad = got.where("left > min_x + 1e-6 or top > min_y + 1e-6 or right < max_x - 1e-6 or bottom < max_y - 1e-6 or right > width or bottom > height")
    assert got.count() and bad.count() == 0


def test_ratio_crop_against_a_loop(spark):
    """The ladder for rectangles in a 200 x 100 image, computed one by one."""
    rects = [(90.0, 40.0, 110.0, 60.0), (10.0, 5.0, 190.0, 95.0), (0.0, 0.0, 200.0, 30.0), (60.0, 0.0, 140.0, 100.0), (0.0, 0.0, 200.0, 100.0)]
    env = spark.createDataFrame([(i, 200, 100, *r) for i, r in enumerate(rects)], "image_id long, width int, height int, min_x double, min_y double, max_x double, max_y double")
    got = {r["image_id"]: (r["ratio"], r["left"], r["top"], r["right"], r["bottom"]) for r in bx.ratio_crop(env).collect()}
    assert got[0] == ("1:1", 86, 36, 114, 64)
    assert got[3] == ("1:1", 50, 0, 150, 100)
    assert got[1][0] == "2:1" and got[2][0] == "2:1" and got[4] == ("2:1", 0, 0, 200, 100)


def test_a_line_of_very_many_points(spark):
    """No value of a line is cut off, and each is read once."""
    n = 50_000
    line = "0 0.5 0.5 0.1 0.1 " + " ".join(f"0.{k % 10} 0.5 {k % 3}" for k in range(n))
    df = spark.createDataFrame([(line,)], "line string").select(labels.parse_line(F.col("line")).alias("p"))
    r = df.select(F.size("p.kpts").alias("n"), F.element_at("p.kpts", -1).alias("last"), "p.error").first()
    assert (r.n, r.error, tuple(r.last)) == (n, None, ((n - 1) % 10 / 10, 0.5, float((n - 1) % 3)))

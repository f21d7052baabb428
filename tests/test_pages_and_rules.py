"""Addresses in pages, and rules worked out by hand."""

import pytest
from pyspark.sql import functions as F

from annolith.functions import keypoints as kp
from annolith.functions import urls
from annolith.operators import dataset as ds
from annolith.operators import export, matching, poses
from annolith.operators import sequence as sq

POINT = "struct<x:double,y:double,v:double>"
POSE = f"image_id long, obj_idx int, class_id int, cx double, cy double, w double, h double, kpts array<{POINT}>"


def one(spark, column, **values):
    df = spark.range(1).withColumns({k: F.lit(v) for k, v in values.items()})
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.google.com/imgres?imgurl=https%3A%2F%2Fi.example%2Fa.jpg&x=1", "https://i.example/a.jpg"),
        ("https://www.google.com/imgres?imgurl=%2F%2Fi.example%2Fa%255Cb.jpg", "https://i.example/a\\b.jpg"),
        ("https://other.example/imgres?imgurl=https%3A%2F%2Fi.example%2Fa.jpg", "https://other.example/imgres?imgurl=https%3A%2F%2Fi.example%2Fa.jpg"),
        ("https://www.google.com/search?imgurl=https%3A%2F%2Fi.example%2Fa.jpg", "https://www.google.com/search?imgurl=https%3A%2F%2Fi.example%2Fa.jpg"),
        ("https://www.google.com/imgres?x=1", "https://www.google.com/imgres?x=1"),
    ],
)
def test_unwrap(spark, url, want):
    assert one(spark, urls.unwrap(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    "url, want",
    [("http://b.example/x", "http://b.example/x"), ("//b.example/x", "https://b.example/x"), ("/x", "https://a.example/x"), ("x.jpg", "https://a.example/p/x.jpg"), ("?q=1", "https://a.example/p/page?q=1")],
)
def test_joined(spark, url, want):
    assert one(spark, urls.joined(F.col("b"), F.col("u")), b="https://a.example/p/page?s=1#f", u=url) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://a.example/s?q=a+b&p=1&p=2&blank=", "https://a.example/s?q=a+b&p=9"),
        ("https://a.example/s?q=%C3%A9&x=1&q=2#f", "https://a.example/s?q=%C3%A9&q=2&x=1&p=9#f"),
        ("https://a.example/s", "https://a.example/s?p=9"),
    ],
)
def test_with_parameter(spark, url, want):
    assert one(spark, urls.with_parameter(F.col("u"), "p", "9"), u=url) == want


def test_pictures_of_pages(spark):
    base = "https://a.example/dir/page.html"
    head = '<META property="og:image" content="/one.jpg"><meta name=\'twitter:image\' content=\'//i.example/two.png\'><meta content="x"><img src="no.jpg">'
    body = '<img data-src="a.svg" src="b.jpg"><img SRC="c.jpg" data-original="d.jpg"><img src="data:x"><img alt="z"><img src="b.jpg">'
    got = lambda h: one(spark, urls.page_pictures(F.col("h"), F.lit(base)), h=h)
    assert got(head) == ["https://a.example/one.jpg", "https://i.example/two.png"]
    # In the first tag src= is found in data-src= first, so it has no picture but the vector one.
    assert got(body) == ["https://a.example/dir/d.jpg", "https://a.example/dir/b.jpg"]
    assert got("") == []
    page = 'x &quot;img_url&quot;:&quot;https://i.example/1.jpg&quot; href="/i?img_url=https%3A%2F%2Fi.example%2F2.jpg&amp;p=1" "img_url":"https://encrypted-tbn0.x/t.jpg"'
    assert one(spark, urls.escaped_image_urls(F.col("h")), h=page) == ["https://i.example/1.jpg", "https://i.example/2.jpg"]


def test_next_page(spark):
    base = "https://y.example/images/search?text=q"
    page = '"moreURL":"/images/search?text=q&amp;p=4" "next":"/images/search?text=q&p=3" "url":"/images/search?text=q&p=1" "url":"/images/search?text=q&p=2&img_url=x" <a href="/images/search?p=2&amp;text=q">'
    ask = lambda h, n: one(spark, urls.next_page(F.col("h"), F.lit(base), F.lit(n)), h=h)
    assert ask(page, 1) == "https://y.example/images/search?p=2&text=q" and ask(page, 2) == "https://y.example/images/search?text=q&p=3" and ask(page, 4) is None and ask("", 0) is None
    assert one(spark, urls.asks_for_proof(F.col("h")), h='{"type": "Captcha"}') and not one(spark, urls.asks_for_proof(F.col("h")), h="captcha")


# --- data sets ---------------------------------------------------------------------------------
def test_conflicts(spark):
    plan = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("e", "f"), ("g", "h")], "source string, target string")
    there = spark.createDataFrame([("a",), ("b",), ("f",), ("z",)], "target string")
    got = {(r.target, r.problem) for r in ds.conflicts(plan, "source", "target", there).collect()}
    assert got == {("c", "duplicate"), ("f", "exists")}
    assert {r.target for r in ds.conflicts(plan, "source", "target").collect()} == {"c"}


def test_pairing_rules(spark):
    images = spark.createDataFrame([("a",), ("b",)], "stem string")
    assert ds.must_pair(images, images.where("true")).count() == 2
    with pytest.raises(Exception, match="no label file for b"):
        ds.must_pair(images, images.where("stem = 'a'")).collect()
    assert one(spark, ds.line_count(F.col("t")), t="x\n\n \ny\n") == 2 and one(spark, ds.line_count(F.lit(None).cast("string"))) == 0


def test_unique_names(spark):
    rows = spark.createDataFrame([(k, "x") for k in range(102)] + [(0, "y")], "k int, stem string")
    got = {(r.stem, r.k): r.unique_name for r in ds.unique_names(rows, "stem", ["k"]).collect()}
    assert [got["x", k] for k in (0, 1, 10, 99, 101)] == ["x", "x_01", "x_10", "x_99", "x_101"] and got["y", 0] == "y"


def test_categories_for_export(spark):
    used = ds.categories(spark.createDataFrame([(0,), (3,), (0,)], "class_id int"), ["person"])
    full = {r.category_id: r for r in ds.coco_categories(used, 17).collect()}
    assert full[1].supercategory == "person" and full[4].name == "class_3" and full[4].supercategory == "object"
    assert full[1].keypoints == kp.NAMES and len(full[1].skeleton) == 15
    odd = ds.coco_categories(used, 3, ["a", "b"]).first()
    assert odd.keypoints == ["kp_0", "kp_1", "kp_2"] and "skeleton" not in odd
    assert ds.coco_categories(used, 3).columns == ["category_id", "name", "supercategory"]


def test_export_lines(spark):
    counts = spark.createDataFrame([("a", 2, 3), (None, 2, 3)], "dataset string, images int, objects int")
    assert sorted(r.line for r in export.summary(counts, "dataset").collect()) == ["| a | 2 | 3 |", "| total | 2 | 3 |"]
    plan = spark.createDataFrame([("a", "b")], "s string, t string")
    assert [tuple(r) for r in export.manifest(plan, "s", "t", "move").collect()] == [("move", "a", "b")]
    assert export.manifest(plan, "s", "t", "move", dry_run=True).first().action == "none"


def test_flip_merge(spark):
    schema = "image_id long, obj_idx int, class_id int, cx double, cy double, w double, h double, score double"
    normal = spark.createDataFrame([(1, 0, 0, 0.2, 0.2, 0.1, 0.1, 0.75), (1, 1, 0, 0.8, 0.8, 0.1, 0.1, 0.5)], schema)
    flipped = spark.createDataFrame([(1, 0, 0, 0.4, 0.2, 0.1, 0.1, 0.25), (1, 1, 0, 0.6, 0.6, 0.2, 0.2, 0.9)], schema)
    pairs = spark.createDataFrame([(1, 0, 0)], "image_id long, a_idx int, b_idx int")
    got = sorted((round(r.cx, 6), r.score) for r in export.flip_merge(normal, flipped, pairs).collect())
    assert got == [(0.25, 0.75), (0.6, 0.9), (0.8, 0.5)]


def test_unmatched_rows_stay(spark):
    base = spark.createDataFrame([(1, 0, 0.1, 0.1), (1, 1, 0.2, 0.1), (2, 0, 0.5, 0.5)], "image_id long, obj_idx int, x double, y double")
    other = spark.createDataFrame([(1, 0, 0.1, 0.2)], base.schema)
    got = {(r.image_id, r.base_idx): r.other_idx for r in matching.with_unmatched(base, matching.nearest_once(base, other)).collect()}
    assert got == {(1, 0): 0, (1, 1): None, (2, 0): None}
    s = matching.match_summary(base, matching.nearest_once(base, other)).first()
    assert (s.base_rows, s.matched) == (3, 1) and abs(s.mean_score - 0.1) < 1e-9


# --- keypoints ---------------------------------------------------------------------------------
def points(*p):
    return F.array(*[kp.point(*q) for q in p])


def test_points_of_other_sources(spark):
    p, q = points(*[(0.1 * k, 0.5, 2) for k in range(1, 7)]), points((0.9, 0.9, 1), (0.8, 0.8, 0), (0.7, 0.7, 2))
    x = lambda c: [round(r["x"], 6) for r in one(spark, c)]
    assert x(kp.copy_face(p, q)) == [0.9, 0.8, 0.7, 0.0, 0.0, 0.6]
    assert x(kp.copy_eyes_and_ears(p, q)) == [0.1, 0.2, 0.7, 0.4, 0.5, 0.6]
    made = one(spark, F.array(kp.from_confidence(F.lit(0.3), F.lit(0.4), F.lit(0.2), 0.5), kp.from_confidence(F.lit(0.3), F.lit(0.4), F.lit(None).cast("double"), 0.5)))
    assert [r["v"] for r in made] == [0, 2]


def test_poses_by_hand(spark):
    images = spark.createDataFrame([(1, 200, 100)], "image_id long, width int, height int")
    pose = spark.createDataFrame([(1, 0, 0, 0.5, 0.5, 0.2, 0.4, [(0.25, 0.5, 2.0), (0.0, 0.0, 1.0), (0.9, 0.1, 0.0)])], POSE)
    env = poses.envelope(pose, images).first()
    assert (env.min_x, env.min_y, env.max_x, env.max_y) == (50.0, 30.0, 120.0, 70.0)
    crops = spark.createDataFrame([(1, 200, 100, 60, 10, 140, 90)], "image_id long, width int, height int, left int, top int, right int, bottom int")
    got = poses.rewrite_for_crop(pose, crops).first()
    assert [tuple(p) for p in got.kpts] == [(0.0, 0.5, 2.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0)] and round(got.w, 6) == 0.5
    assert [tuple(p) for p in poses.recentre_for_crop(pose, crops).first().kpts][1] == (0.0, 0.0, 0.0)
    got = poses.turn(pose, images, 90).first()
    assert (got.cx, got.cy, round(got.w, 6), round(got.h, 6)) == (0.5, 0.5, 0.4, 0.2) and tuple(got.kpts[0]) == (0.5, 0.25, 2.0)
    outside = pose.withColumn("kpts", F.array(kp.point(1.2, 0.5, 2)))
    assert tuple(poses.turn(outside, images, 180).first().kpts[0]) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        poses.turns(pose, images, [45])
    copies = {r.copy: r for r in poses.extend_with_flip(pose, images).collect()}  # landscape: the canvas grows in height
    assert (copies[0].cy, copies[1].cy, copies[0].h) == (0.25, 0.75, 0.2) and tuple(copies[1].kpts[0]) == (0.75, 0.75, 2.0)


def test_no_tilt_changes_nothing(spark):
    canvas = poses.tilt_canvas(spark.createDataFrame([(1, 200, 100, 0.0, 100.0, 50.0)], "image_id long, width int, height int, angle double, centre_x double, centre_y double"))
    assert (canvas.first().out_w, canvas.first().out_h, canvas.first().offset_x) == (200, 100, 0)
    pose = spark.createDataFrame([(1, 0, 0, 0.5, 0.5, 0.2, 0.4, [(0.25, 0.5, 2.0)])], POSE)
    got = poses.tilted(pose, canvas).first()
    assert [round(v, 9) for v in (got.cx, got.cy, got.w, got.h)] == [0.5, 0.5, 0.2, 0.4] and tuple(got.kpts[0]) == (0.25, 0.5, 2.0)


def test_blocks_and_pages(spark):
    still, moved = [0.0] * 16, [0.0] * 15 + [8.0]
    frames = spark.createDataFrame([(1, 0, still), (1, 1, still), (1, 2, moved), (1, 3, [0.0] * 9)], "seq_id int, frame_index int, px array<double>")
    assert [(r.frame_index, r.difference) for r in sq.block_duplicates(frames, "px", 4, 2, 1.9).collect()] == [(1, 0.0)]
    assert {r.frame_index: r.difference for r in sq.block_duplicates(frames, "px", 4, 2, 2.0).collect()} == {1: 0.0, 2: 2.0}
    pages = spark.createDataFrame([(1, k, n) for k, n in enumerate([3, 0, 2, 0, None, 5])], "q int, page int, hits int")
    assert [r.page for r in sq.until_empty(pages, "q", "page", "hits").orderBy("page").collect()] == [0, 1, 2, 3, 4]
    assert sq.from_the_end(pages, ["q"], [F.desc("page")], 1).first().page == 4 and sq.from_the_end(pages, ["q"], [F.desc("page")], -1).count() == 6


def test_the_plan_of_a_portrait_crop_is_small(spark):
    """Steps that were columns under filters were written out in each other: the plan alone took more than a gigabyte."""
    from annolith.plans import pose_catalog

    crops = pose_catalog.ps.portrait_crop(pose_catalog.ps.face_sizes(*pose_catalog._poses(spark, "/root/testdata/sf0.001")), 0.75, 3.0)
    assert len(crops._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    faces = spark.createDataFrame([(1, 0, 0, 200.0, 100.0, 20.0, 50.0, 10.0), (2, 0, 0, 200.0, 100.0, None, 50.0, 10.0)], "image_id long, obj_idx int, class_id int, width double, height double, face_x double, face_y double, diameter double")
    assert [tuple(r) for r in poses.portrait_crop(faces, 0.5, 2.0).collect()] == [(1, 0, 0, 10, 30, 30, 70)]
    assert [tuple(r) for r in poses.portrait_crop(faces, 0.5).collect()] == [(1, 0, 0, 0, 10, 40, 90)]


def test_turned_poses_meet_their_images_once(spark):
    """Each angle had a join of its own, and boxes and points each made them again: tasks sorted several times what there is."""
    from annolith.plans import pose_catalog

    images = spark.createDataFrame([(1, 200, 100)], "image_id long, width int, height int")
    pose = spark.createDataFrame([(1, 0, 0, 0.5, 0.5, 0.2, 0.4, [(0.25, 0.5, 2.0)]), (1, 1, 0, 2.0, 2.0, 0.2, 0.4, []), (1, 2, 0, 0.5, 0.5, 0.2, 0.4, None)], POSE)
    rows = pose_catalog._rows(poses.turns(pose, images, [90, 270]), "angle")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = sorted((r.angle, r.obj_idx, r.k, r.a0, r.a1, r.a3) for r in rows.collect())
    box, of = (-1, 500000, 500000, 200000), lambda a, x, y: (a, 0, 0, x, y, -1)
    assert got == [(90, 0, *box), of(90, 500000, 250000), (90, 2, *box), (270, 0, *box), of(270, 500000, 750000), (270, 2, *box)]

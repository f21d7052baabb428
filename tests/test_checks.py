"""Checks of data sets, scans of folders, names and plans, by hand."""

import os

import pytest
from pyspark.sql import functions as F

from annolith.functions import geometry as g
from annolith.functions import keypoints as kp
from annolith.functions import labels as lb
from annolith.functions import urls
from annolith.operators import checks, poses
from annolith.operators import dataset as ds
from annolith.sources import files


def column(spark, c, rows, form):
    return [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {form}").orderBy("_i").select(c.alias("x")).collect()]


def test_everything_that_is_wrong(spark):
    images = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "stem string")
    lines = ["0 0.5 0.5 0.1 0.1 0.5 0.5 2", "", "2 0.5 0.5 0.1 0.1 0.5 0.5 2", "0.0 0.5 0.5 0.1 0.1 0.5 0.5 2", "0 0.5 0.5 0.1", "0 x 0.5 0.1 0.1", "0 1.5 0.5 0.1 0.1 0.5 0.5 2", "0 0.5 0.5 0 0.1", "1 0.5 0.5 0.1 0.1 0.5 1.5 1", "1 0.5 0.5 0.1 0.1 7 7 0"]
    f = spark.createDataFrame([("a", "\r\n".join(lines)), ("b", ""), ("d", "0 0.5 0.5 0.1 0.1 0.5 0.5 -1"), (None, None)], "stem string, raw string")
    got = sorted((r.problem, r.stem, r.line_no) for r in checks.check_dataset(images, f, 2, 1).collect())
    assert got == [("box", "a", 6), ("box", "a", 7), ("class", "a", 2), ("class", "a", 3), ("line", "a", 4), ("line", "a", 5), ("no_image", "d", None), ("no_label_file", "c", None), ("points", "a", 7), ("same_stem", "b", None), ("visibility", "a", 8), ("visibility", "d", 0)]
    n = {r.problem: r.n for r in checks.totals(checks.check_dataset(images, f, 2)).collect()}
    assert set(n) == set(checks.PROBLEMS) and n["points"] == 0 and n["box"] == 2
    assert checks.check_dataset(images.limit(0), f.limit(0), 1).count() == 0


def test_totals(spark):
    stems = lambda *x: spark.createDataFrame([(s,) for s in x], "stem string")
    assert tuple(checks.cleanup_totals(stems("a", "b", "b"), stems("b", "c", "d")).first()) == (2, 3, 1, 2, 1)
    assert tuple(checks.cleanup_totals(stems(), stems()).first()) == (0, 0, 0, 0, 0)
    sizes = spark.createDataFrame([(10, 4), (5, None), (7, 9)], "before long, after long")
    assert tuple(checks.byte_totals(sizes).first()) == (3, 22, 13, 9, 1) and tuple(checks.byte_totals(sizes.limit(0)).first()) == (0, 0, 0, 0, 0)
    form = "source string, train_images long, val_images long, train_instances long, val_instances long"
    text = lambda rows: [r.line for r in checks.merge_summary(spark.createDataFrame(rows, form)).orderBy("pos").collect()]
    assert text([("b", 7, 1, 70, None), ("a", 1, None, 2, 3)]) == ["# Merge Summary", "", "Sources merged:", "- a: 1 images (train 1, val 0); 5 instances (train 2, val 3)", "- b: 8 images (train 7, val 1); 70 instances (train 70, val 0)", "", "Totals: 9 images (train 8, val 1); 75 instances (train 72, val 3)"]
    assert text([]) == ["# Merge Summary", "", "Sources merged:", "- None (no new sources merged)", "", "Totals: 0 images (train 0, val 0); 0 instances (train 0, val 0)"]


def test_label_files_read_in_other_ways(spark):
    raw = "0 0.5 0.5 0.1 0.1 0.5 0.5 2 9\n\n 1 0.1 0.1 0.1 0.1 \n0 0.5 0.5\n0 0.5 0.5 0.1 0.1"
    f = spark.createDataFrame([("a", raw), ("b", ""), ("c", None)], "stem string, raw string")
    assert sorted((r.stem, r.line_no, r.line) for r in lb.raw_lines(f).collect()) == [("a", k, line) for k, line in enumerate(raw.split("\n")) if line.strip()]
    assert sorted((r.stem, r.line_no, len(r.kpts)) for r in lb.pose_entries(f).collect()) == [("a", 0, 1), ("a", 4, 0)]
    assert [r.line_no for r in lb.pose_entries(f, 1).collect()] == [2]
    g_ = spark.createDataFrame([("a", "0 0.5 0.5 0.1 0.1 1 1 2\nx\n0 0.5 0.5 0.1 0.1\n0 0.5 0.5 0.1 0.1 1 1 2 1 1 2"), ("b", "")], "stem string, raw string")
    assert sorted(map(tuple, lb.pose_files(g_, 2).collect())) == [("a", 2, 2, 1), ("b", 0, 0, 0)] and sorted(r.mismatched for r in lb.pose_files(g_).collect()) == [0, 0]


def put(root, *names):
    for n in names:
        path = os.path.join(root, n)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        open(path, "wb").write(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (7).to_bytes(4, "big") + (5).to_bytes(4, "big") if n.endswith((".png", ".dat")) else b"text")


def test_folders(spark, tmp_path):
    root = str(tmp_path / "sets")
    put(root, "one/images/a.png", "one/images/b.txt", "one/labels/a.txt", "one/labels/x.png", "two/images/c.PNG", "three/labels/d.txt", "all/images/e.png", "all/labels/e.txt")
    images, labels = files.datasets(spark, root, leave="all")
    assert [(r.dataset, r.stem) for r in images.collect()] == [("one", "a")] and [(r.dataset, r.stem) for r in labels.collect()] == [("one", "a")]
    root = str(tmp_path / "splits")
    put(root, "images/train/a.png", "images/val/b.png", "labels/train/a.txt", "labels/test/c.txt", "labels/train/n.md", "images/top.png")
    images, labels = files.split_tree(spark, root)
    assert sorted((r.split, r.stem) for r in images.collect()) == [("train", "a"), ("val", "b")] and sorted((r.split, r.stem) for r in labels.collect()) == [("test", "c"), ("train", "a")]
    root = str(tmp_path / "frames")
    put(root, "f_12.png", "f3_007.png", "none.png", "f_9.avi", "odd.dat", "clip.MP4")
    assert sorted((r.stem, r.frame_index) for r in files.frames(spark, root).collect()) == [("f3_007", 7), ("f_12", 12)]
    assert sorted(r.stem for r in files.videos(spark, root).collect()) == ["clip", "f_9"]
    assert {r.stem: (r.image, r.width) for r in files.any_images(spark, root).collect()} == {"f_12": (True, 7), "f3_007": (True, 7), "none": (True, 7), "f_9": (False, None), "odd": (True, 7), "clip": (False, None)}


def test_orders(spark):
    names = ["b2.png", "a10.png", "A10.png", "B1.png", "c.png"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = lambda by: [r.name for r in ds.ordered(df, by).collect()]
    assert got("name") == sorted(names) and got("lower") == ["A10.png", "a10.png", "B1.png", "b2.png", "c.png"] and got("index") == ["B1.png", "b2.png", "A10.png", "a10.png"]
    with pytest.raises(ValueError):
        ds.ordered(df, "size")


def test_names(spark):
    cases = [("id", None, None, "u"), ("é--", "YouTube", "https://tiktok.com", "u"), (" a b/c ", None, "https://x.TikTok.com/@n", " Us er "), (None, "TikTok", None, None), ("x" * 99, None, None, None)]
    got = column(spark, urls.video_name(F.col("a"), F.col("b"), F.col("c"), F.lit("https://v.example"), [F.col("d")]), cases, "a string, b string, c string, d string")
    assert got == ["id", "video", "Us_er_a_b_c", "u_video", "x" * 80]
    assert column(spark, urls.picture_answer(F.col("a"), F.col("b")), [(200, "Image/png"), (200, "text/html"), (404, "image/png"), (None, "image"), (200, None)], "a int, b string") == [True, False, False, False, False]
    html = '<a href="/url?q=https://a.example/x%3Fy&sa=1"><a href="/url?q=https://www.google.com/z"><a href="/url?q=https://a.example/x?y&z"><a href="/url?q=ftp://b">'
    assert column(spark, urls.result_links(F.col("a")), [(html,), ("",)], "a string") == [["https://a.example/x?y"], []]
    assert column(spark, urls.escaped_result_links(F.col("a")), [("{&quot;img_href&quot; : &quot;https://a.example/1&quot;,&quot;img_href&quot;:&quot;x&quot;}",)], "a string") == [["https://a.example/1"]]


def test_plans_for_pictures(spark):
    rows = [(4000, 1, "HEIC"), (100, 50, "png"), (1001, 500, "jpeg"), (None, 5, "png")]
    got = column(spark, g.resize_plan(F.col("w"), F.col("h"), F.col("e"), 1000), rows, "w int, h int, e string")
    assert [tuple(r) if r else None for r in got] == [(True, 1000, 1, "jpg", False), (False, 100, 50, "png", True), (True, 1000, 500, "jpeg", False), None]
    assert [r.ending for r in column(spark, g.resize_plan(F.col("w"), F.col("h"), F.col("e"), 1000, True), rows[:3], "w int, h int, e string")] == ["jpg"] * 3
    assert column(spark, g.cut_height(F.col("h"), 10), [(21,), (20,), (None,)], "h int") == [1, None, None]
    assert poses.parse_angles(" 270, 90,,270 ") == [270, 90]
    for wrong in ("", "45", "90 180", "-90"):
        with pytest.raises(ValueError):
            poses.parse_angles(wrong)


def test_points_by_number(spark):
    k = [[(0.5, 0.5, 2.0), (1.5, 0.5, 1.0), (0.0, 0.0, 2.0), (0.1, 0.1, 0.0)], []]
    form = "k array<struct<x: double, y: double, v: double>>"
    at = lambda i, **o: [tuple(p) if p else None for p in column(spark, kp.seen_point(F.col("k"), i, **o), [(x,) for x in k], form)]
    assert at(0) == [(0.5, 0.5, 2.0), None] and at(1) == [(1.5, 0.5, 1.0), None] and at(1, inside=True) == [None, None] and at(2) == at(3) == at(9) == [None, None]
    got = column(spark, F.size(kp.of_class(F.col("c"), F.slice("k", 1, 1), F.col("k"))), [(k[0], 0), (k[0], 1), (k[0], None)], f"{form}, c int")
    assert got == [1, 4, 4]


def test_description_of_a_data_set(spark, tmp_path):
    (tmp_path / "d.yaml").write_text("names:\n  1: b\n  0: a\nkpt_shape: [2, 3]\nflip_idx: [1, 0]\nkpt_names:\n  0: [x, y]\n")
    assert files.dataset_config(spark, str(tmp_path / "d.yaml")) == {"kpt_shape": [2, 3], "names": ["a", "b"], "kpt_names": ["x", "y"], "flip_idx": [1, 0]}
    (tmp_path / "e.yaml").write_text("names: [a]\n")
    assert files.dataset_config(spark, str(tmp_path / "e.yaml"))["names"] == ["a"]
    (tmp_path / "f.yaml").write_text("# x\n" * (files.CONFIG_LINES + 1))
    with pytest.raises(ValueError):
        files.dataset_config(spark, str(tmp_path / "f.yaml"))


def test_lines_are_read_once(spark):
    """Filters on what a line says were pushed below it, so each line was read two or three times."""
    files = spark.createDataFrame([("a", "0 0.5 0.5 0.1 0.1\\n \\n0 inf 0.5 1d 0.1\\r\\nx 0.5\\n1e0 nan -Inf 1f 3\\n\\t1  Infinity 2. .5 -0 "), ("b", ""), ("c", None)], "stem string, raw string")
    files = files.selectExpr("stem", r"replace(replace(replace(raw, '\\n', chr(10)), '\\r', chr(13)), '\\t', chr(9)) raw")
    rows = lb.parse_files(files, "strict", "drop_line")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    got = sorted((r.stem, r.line_no, r.class_id, r.cx, r.cy, r.h) for r in rows.collect())
    assert got == [("a", 0, 0, 0.5, 0.5, 0.1), ("a", 5, 1, float("inf"), 2.0, -0.0)]
    counts = {r.stem: (r.poses, r.skipped) for r in lb.pose_files(files).collect()}
    assert counts["a"] == (0, 5) and counts["b"] == (0, 0)


def test_lines_are_made_where_their_rows_lie(spark):
    """Each number of a line was a row of its own that went through a shuffle."""
    rows = spark.createDataFrame([("a", 1, "x", 0.5, None, 0.25, 1.0, [(0.1, 1e-7, 2.0), (0.5, float("nan"), 0.3)]), ("a", 0, None, 1.0, 0.0, -0.0, 0.1234567, []), ("a", 2, "y", 1.0, 1.0, 1.0, 1.0, None), ("b", 0, "z", 1.0, 1.0, 1.0, 1.0, None)], "stem string, line_no int, class_token string, cx double, cy double, w double, h double, kpts array<struct<x:double,y:double,v:double>>")
    lines = lb.to_lines(rows)
    assert "Generate" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in lines.collect()] == [("a", "1 0 0 0.123457\nx 0.5 0.25 1 0.1 0 2 0.5 0.3")]


def test_pose_counts_are_those_of_parsed_lines(spark):
    """Every kind of token and number of tokens, counted without making points, as the parser of whole lines counts them."""
    tokens = ["1", "-0.5", "1e3", "1d", "2F", "inf", "-INF", "+Infinity", "NaN", "nan", "x", "1.2.3", ".", ".5", "5.", "0x1p3", "1_0", "١", "1e400", "-", "fd", "word"]
    lines = [" ".join(["0.5"] * n) for n in (0, 1, 4, 5, 7, 8, 9, 11, 14, 56)] + ["", "   ", "\t\x0b ", " 0 1\t1 1  1 1 1 2\x0c", "0 1 1 1 1 1 1 2  "]
    lines += [" ".join(["0", *["0.5"] * k, t, *["0.5"] * (6 - k)]) for t in tokens for k in (0, 6)]
    files = [(f"f{i}", line) for i, line in enumerate(lines)] + [("all", "\r\n".join(lines)), ("all", "\n".join(lines)), (None, lines[5]), ("none", None), ("empty", "")]
    df = spark.createDataFrame(files, "stem string, raw string")
    read = df.select("stem", F.transform(F.split("raw", "\r?\n"), lambda x: lb.parse_line(x, "pose")).alias("p"))
    fine = F.filter("p", lambda r: r["error"].isNull() & r["class_token"].isNotNull())
    want = read.select("stem", F.size(fine), F.size(F.filter("p", lambda r: r["error"].isNotNull())), F.size(F.filter(fine, lambda r: F.size(r["kpts"]) != 2)))
    key = lambda r: str(tuple(r))
    got = lb.pose_files(df, 2)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert "kpts" not in got._jdf.queryExecution().optimizedPlan().toString()

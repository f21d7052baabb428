"""Plans of moves that are cut off and run again, sinks that leave nothing behind, exports in parts, videos and pictures."""

import hashlib
import io
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.functions import pictures, records
from annolith.operators import dataset as ds
from annolith.operators import export, moves, ranks
from annolith.sources import file_sink, label_sink, opened, tfrecord, video
from annolith.streaming import ingest

PLAN = "action string, source string, target string"


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(path) for f in fs if not f.startswith(".") and not f.endswith(".crc")}


# --- plans ---------------------------------------------------------------------------------------
def renames(folder, n=12):
    """A cycle of three, a chain, a swap, copies of files that move, a deletion whose name is wanted, new files."""
    p = lambda x: f"{folder}/{x}"
    for i in range(n):
        with open(p(f"f{i}"), "w") as f:
            f.write(f"content {i}")
    rows = [("move", p("f0"), p("f1")), ("move", p("f1"), p("f2")), ("move", p("f2"), p("f0")), ("move", p("f3"), p("f4")), ("move", p("f4"), p("f5")), ("move", p("f5"), p("deep/new")), ("move", p("f6"), p("f7")), ("move", p("f7"), p("f6"))]
    rows += [("copy", p("f0"), p("copy0")), ("copy", p("f8"), p("deep/copy8")), ("delete", p("f9"), None), ("move", p("f10"), p("f9")), ("create", None, p("made/empty")), ("create", None, p("f11")), ("none", p("f8"), p("never"))]
    after = {"f1": 0, "f2": 1, "f0": 2, "f4": 3, "f5": 4, "deep/new": 5, "f7": 6, "f6": 7, "copy0": 0, "f8": 8, "deep/copy8": 8, "f9": 10, "f11": 11}
    return rows, {k: f"content {v}".encode() for k, v in after.items()} | {"made/empty": b""}


def test_plan(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    rows, after = renames(folder)
    plan = spark.createDataFrame(rows, PLAN).repartition(4)
    before = tree(folder)
    assert {r.action: r.steps for r in moves.run_plan(plan, str(tmp_path / "state"), dry_run=True).collect()} == {"move": 9, "copy": 2, "delete": 1, "create": 2} and tree(folder) == before
    got = {r.action: r.steps for r in moves.run_plan(plan, str(tmp_path / "state")).collect()}
    assert tree(folder) == after and got == {"move": 9, "copy": 2, "delete": 1, "create": 1}
    # After its end it does nothing, though the files' names are again sources of moves.
    assert moves.run_plan(plan, str(tmp_path / "state")).collect() == [] and tree(folder) == after


@pytest.mark.parametrize(("stage", "left"), [(1, 1), (2, 3), (2, 8), (3, 2), (3, 7)])
def test_plan_cut_off_in_any_stage(spark, tmp_path, stage, left):
    """Some steps of a stage are done when the job fails; the plan ends right when it is run again, even if it is then made anew from the folder."""
    folder, state = tmp_path / "files", str(tmp_path / "state")
    folder.mkdir()
    rows, after = renames(folder)
    plan = spark.createDataFrame(rows, PLAN)
    # What a driver does up to the failure.
    run = hashlib.sha256(state.encode()).hexdigest()[:16]
    plan.where("action <> 'none'").write.parquet(f"{state}/plan")
    acting = [r for r in rows if r[0] != "none"]
    for s in range(1, stage):
        for r in acting:
            moves._step(s, run, *r)
        spark.range(1).select(F.lit("x").alias("action"), F.lit(0).cast("long").alias("steps")).write.parquet(f"{state}/stage-{s}")
    for r in acting[:left]:
        moves._step(stage, run, *r)
    assert tree(folder) != after
    moves.run_plan(spark.createDataFrame([("move", "nonsense", "other")], PLAN), state).collect()
    assert tree(folder) == after


def test_plan_with_problems(spark, tmp_path):
    p = lambda x: f"{tmp_path}/{x}"
    for x in "abcd":
        open(p(x), "w").write(x)
    rows = [("move", p("a"), p("b")), ("move", p("c"), p("n")), ("copy", p("d"), p("n")), ("move", p("gone"), p("m")), ("delete", p("c"), None), ("move", p("d"), None), ("fly", p("d"), p("k"))]
    got = {(r.problem, os.path.basename(r.path)) for r in moves.problems(spark.createDataFrame(rows, PLAN)).collect()}
    assert got == {("exists", "b"), ("duplicate", "n"), ("missing", "gone"), ("twice", "c"), ("incomplete", "d")}
    with pytest.raises(ValueError, match="duplicate"):
        moves.run_plan(spark.createDataFrame(rows, PLAN), p("state"))
    assert not os.path.exists(p("state")) and open(p("b")).read() == "b"
    assert moves.run_plan(spark.createDataFrame([], PLAN), p("state2")).collect() == []


# --- sinks ---------------------------------------------------------------------------------------
def save(df, folder, mode="append", **options):
    df.sparkSession.dataSource.register(label_sink.LabelFolder)
    df.write.format("labelfolder").mode(mode).options(**options).save(str(folder))


def labels(spark, rows):
    return spark.createDataFrame(rows, "stem string, raw string").repartition(3)


def test_failed_job_leaves_nothing(spark, tmp_path):
    save(labels(spark, [("a", "1"), ("b", "2")]), tmp_path)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="not a file's name"):
            save(labels(spark, [("a", "new"), ("c", "3"), ("../x", "4")]), tmp_path, mode)
        assert tree(tmp_path) == {"a.txt": b"1", "b.txt": b"2"} and not [f for f in os.listdir(tmp_path) if "staged" in f]
    save(labels(spark, [("b", "9")]), tmp_path, "overwrite")
    assert tree(tmp_path) == {"b.txt": b"9"}


def test_lines_are_added_once(spark, tmp_path):
    save(labels(spark, [("a", "1\n\n 2 ")]), tmp_path)
    more = labels(spark, [("a", "3"), ("b", "4\n"), ("c", "")])
    for _ in range(2):
        save(more, tmp_path, present="extend", job="run 7")
        assert tree(tmp_path) == {"a.txt": b"1\n2\n3\n", "b.txt": b"4\n", "c.txt": b""}
    save(labels(spark, [("a", "5")]), tmp_path, present="extend", job="run 8", empty="omit")
    assert tree(tmp_path)["a.txt"] == b"1\n2\n3\n5\n"
    with pytest.raises(Exception, match="two rows"):
        save(labels(spark, [("a", "6"), ("a", "7")]), tmp_path, present="extend")
    assert tree(tmp_path)["a.txt"] == b"1\n2\n3\n5\n"
    for wrong in ({"present": "x"}, {"empty": "x"}):
        with pytest.raises(Exception, match="unknown"):
            save(more, tmp_path, **wrong)


def test_job_cut_off_while_files_are_put_in_place(spark, tmp_path, monkeypatch):
    options = {"path": str(tmp_path), "present": "extend", "job": "j"}
    save(labels(spark, [("a", "1"), ("b", "2")]), tmp_path)
    rows = [type("R", (), {"stem": s, "raw": "new"}) for s in "abc"]
    w = label_sink._Writer(options, False)
    done = [w.write([r]) for r in rows]
    whole = label_sink._Writer._place

    def cut(self, plan):
        store, folder = opened.at(self.folder)
        name, part = plan["files"][0]
        store.move(f"{folder}/.{self.job}.staged/{part}", f"{folder}/{name}")
        raise OSError("the driver is gone")

    monkeypatch.setattr(label_sink._Writer, "_place", cut)
    with pytest.raises(OSError):
        w.commit(done)
    monkeypatch.setattr(label_sink._Writer, "_place", whole)
    again = label_sink._Writer(options, False)
    again.commit([again.write([r]) for r in rows])
    assert tree(tmp_path) == {"a.txt": b"1\nnew\n", "b.txt": b"2\nnew\n", "c.txt": b"new\n"} and not [f for f in os.listdir(tmp_path) if "staged" in f]


def test_addresses_noted_once(spark, tmp_path):
    folder = str(tmp_path / "seen")
    batch = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert ingest.seen_addresses(spark, folder).count() == 0
    note = lambda b, n: sorted(r.url for r in ingest.note_new(b, folder, n).collect())
    assert note(batch("a", "b", "b", None), 0) == ["a", "b"] and note(batch("b", "c"), 1) == ["c"]
    assert note(batch("b", "c"), 1) == ["c"] and note(batch("a"), 2) == []  # a batch that comes again
    assert sorted(r.url for r in ingest.seen_addresses(spark, folder).collect()) == ["a", "b", "c"]
    spark.createDataFrame([("c",), ("d",)], "url string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("url string").parquet(str(tmp_path / "in"))
    q = s.writeStream.foreachBatch(lambda b, n: ingest.note_new(b, folder, n + 10)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.url for r in ingest.seen_addresses(spark, folder).collect()) == ["a", "b", "c", "d"]


def test_file_folder(spark, tmp_path):
    spark.dataSource.register(file_sink.FileFolder)
    df = lambda rows: spark.createDataFrame(rows, "name string, content binary").repartition(2)
    write = lambda rows, mode="append": df(rows).write.format("filefolder").mode(mode).save(str(tmp_path / "f"))
    write([("a.png", b"1"), ("d/b.png", b"2"), ("none", None)])
    assert tree(tmp_path / "f") == {"a.png": b"1", "d/b.png": b"2"}
    for bad in ([("../x", b"1")], [("same", b"1"), ("same", b"2")], [("", b"1")]):
        with pytest.raises(Exception, match="name"):
            write([("ok", b"3"), *bad])
    assert tree(tmp_path / "f") == {"a.png": b"1", "d/b.png": b"2"}
    write([("c", b"4")], "overwrite")
    assert tree(tmp_path / "f") == {"c": b"4"}


# --- exports -------------------------------------------------------------------------------------
def test_export_in_parts(spark, tmp_path):
    images = [(s, i, f"{i}.jpg", 10, 20) for s, n in (("train", 300), (None, 3), ("val", 40)) for i in range(n)]
    notes = [("train", k, k // 2, 1, 1.0, 2.0, 3.0, 4.0, 12.0, [(0.5, 0.25, 2.0)] if k % 2 else []) for k in range(500)] + [("lost", 1, 1, 1, 1.0, 1.0, 1.0, 1.0, 1.0, [])]
    img = spark.createDataFrame(images, "split string, id long, file_name string, width int, height int")
    ann = spark.createDataFrame(notes, "split string, id long, image_id long, category_id int, left double, top double, box_w double, box_h double, area double, kpts array<struct<x: double, y: double, v: double>>")
    cat = spark.createDataFrame([(1, 'per"son'), (2, "b")], "category_id long, name string")
    lines = export.document_lines(img, ann, cat, {"description": "d\n", "year": 2020}, [{"id": 1}])
    export.write_documents(lines, str(tmp_path / "out"), 7)
    whole = {r.split: json.loads(r.document) for r in export.documents(img, ann, cat).collect()}
    found = {}
    for folder in sorted(os.listdir(tmp_path / "out")):
        if folder.startswith("split="):
            parts = sorted(f for f in os.listdir(tmp_path / "out" / folder) if f.startswith("part"))
            found[folder[6:]] = (len(parts), json.loads("".join(open(tmp_path / "out" / folder / f).read() for f in parts)))
    assert set(found) == {"train", "val", "__HIVE_DEFAULT_PARTITION__"} and found["train"][0] > 1
    for s in ("train", "val"):
        d = found[s][1]
        assert d["info"]["description"] == "d\n" and d["licenses"] == [{"id": 1}] and d["images"] == whole[s]["images"] and d["categories"] == whole[s]["categories"] and d["annotations"] == whole[s].get("annotations", [])


def test_until_enough(spark):
    rows = [(i, None if i % 5 == 4 else i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, ok boolean").repartition(5)
    for wanted in (0, 1, 7, 1000):
        got = sorted(r.i for r in ds.until_enough(df, ["i"], "ok", wanted).collect())
        want, n = [], 0
        for i, ok in rows:
            if n < wanted:
                want.append(i)
                n += bool(ok)
        assert got == want
    assert ds.until_enough(spark.createDataFrame([], "i int, ok boolean"), ["i"], "ok", 3).count() == 0
    with pytest.raises(ValueError):
        ds.until_enough(df, ["i"], "ok", -1)
    sums = {r.i: r.s for r in ranks.with_sum_before(df.withColumn("n", F.col("i").cast("long")), ["i"], "n", "s").collect()}
    assert sums == {i: i * (i - 1) // 2 for i in range(200)}


def test_made_names_that_exist(spark):
    rows = [(1, "x"), (2, "x"), (3, "x"), (4, "x_01"), (5, "x_01"), (6, "x_07"), (7, None), (8, None), (9, "x_1"), (10, "y"), (11, "y"), (12, "")]
    got = {r.i: r.unique_name for r in ds.unique_names(spark.createDataFrame(rows, "i int, name string"), "name", ["i"]).collect()}
    assert got == {1: "x", 2: "x_08", 3: "x_02", 4: "x_01", 5: "x_01_01", 6: "x_07", 7: None, 8: None, 9: "x_1", 10: "y", 11: "y_01", 12: ""}


# --- records, videos, pictures ---------------------------------------------------------------------
def varint(n):
    out = b""
    while True:
        out, n = out + bytes([n & 127 | (128 if n > 127 else 0)]), n >> 7
        if not n:
            return out


def message(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def test_features_of_every_kind():
    pair = lambda k, kind, data: message(1, message(1, k.encode()) + message(2, message(kind, data)))
    floats, ints = struct.pack("<3f", 0.5, -1.0, 8.0), varint(5) + varint((1 << 64) - 3) + varint(300)
    example = message(1, pair("b", 1, message(1, b"one") + message(1, b"two")) + pair("f", 2, message(1, floats)) + pair("g", 2, varint(1 << 3 | 5) + floats[:4] + varint(1 << 3 | 5) + floats[4:8]) + pair("i", 3, message(1, ints)) + pair("j", 3, varint(1 << 3) + varint(7)) + pair("none", 1, b""))
    assert tfrecord.features(example) == ({"b": [b"one", b"two"]}, {"f": [0.5, -1.0, 8.0], "g": [0.5, -1.0]}, {"i": [5, -3, 300], "j": [7]})


def test_records_with_pictures(spark, tmp_path):
    pair = lambda k, kind, data: message(1, message(1, k.encode()) + message(2, message(kind, data)))
    text = lambda k, v: pair(k, 1, message(1, v))
    jpeg = b"\xff\xd8\xff\xe0rest"
    with open(tmp_path / "a.tfrecord", "wb") as f:
        for parts in (text("filename", b"p/q/na\xffme.jpg") + text("other", jpeg) + pair("n", 3, message(1, varint(2))), text("png", b"any") + text("image", b"first"), text("filename", jpeg) + pair("w", 2, message(1, struct.pack("<f", 2.5)))):
            payload = message(1, parts)
            head = struct.pack("<Q", len(payload))
            f.write(head + struct.pack("<I", tfrecord.masked_crc(head)) + payload + struct.pack("<I", tfrecord.masked_crc(payload)))
    spark.dataSource.register(tfrecord.TFRecordSource)
    df = spark.read.format("tfrecord").option("verify", "true").load(str(tmp_path))
    got = df.select("record", records.picture(F.col("features")).alias("p"), records.picture(F.col("features"), "other").alias("o"), records.stem_of(F.col("features"), F.col("record")).alias("s"), "ints", "floats").orderBy("record").collect()
    assert [(r.p.key, bytes(r.p.data)) if r.p else None for r in got] == [("other", jpeg), ("image", b"first"), None]
    assert [bytes(r.o.data) if r.o else None for r in got] == [jpeg, None, None]
    assert got[0].s == "name" and got[1].s == "image_000001" and got[0].ints == {"n": [2]} and got[2].floats == {"w": [2.5]}


def test_heads(spark):
    cases = [(b"\xff\xd8\xff\xdb", True), (b"\x89PNG\r\n\x1a\n1", True), (b"GIF89a", True), (b"BMxx", True), (b"II*\0", True), (b"MM\0*", True), (b"RIFF1234WEBPVP8 ", True), (b"RIFF1234WAVE", False), (b"", False), (None, False), (b"\xff\xd8", False), (b"text", False)]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, d binary")
    assert [r.x for r in df.orderBy("i").select(records.is_picture(F.col("d")).alias("x")).collect()] == [w for _, w in cases]


def avi(frames, index=True, absolute=False, rec=False):
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    body, entries = b"", []
    for f in frames:
        entries.append((len(body), len(f)))
        body += chunk(b"00dc", f) + chunk(b"01wb", b"sound")
    inside = b"".join([b"LIST" + struct.pack("<I", 4 + len(body)) + b"rec " + body]) if rec else body
    head = b"LIST" + struct.pack("<I", 4) + b"hdrl" + chunk(b"JUNK", b"abc")
    movi = b"LIST" + struct.pack("<I", 4 + len(inside)) + b"movi" + inside
    base = 12 + len(head) + 8 if absolute else 0
    idx = chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 16, base + 4 + at, n) + struct.pack("<4sIII", b"01wb", 16, 0, 5) for at, n in entries)) if index else b""
    data = b"AVI " + head + movi + idx
    return b"RIFF" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize("form", [{}, {"absolute": True}, {"index": False}, {"index": False, "rec": True}])
def test_video_frames(spark, tmp_path, form):
    frames = [b"\xff\xd8" + bytes([i]) * (1 + i % 4) for i in range(11)]
    (tmp_path / "a.avi").write_bytes(avi(frames, **form))
    (tmp_path / "b.AVI").write_bytes(avi([b"x", b"", b"yy"]))
    (tmp_path / "note.txt").write_bytes(b"no video")
    spark.dataSource.register(video.VideoFrames)
    read = lambda **o: spark.read.format("videoframes").options(**o).load(str(tmp_path))
    every = read(partitionBytes="12")
    got = [(os.path.basename(r.file), r.number, r.label, r.frames, bytes(r.jpeg)) for r in every.orderBy("file", "number").collect()]
    assert got == [("a.avi", i + 1, f"{i + 1:02d}", 11, f) for i, f in enumerate(frames)] + [("b.AVI", i + 1, str(i + 1), 3, f) for i, f in enumerate([b"x", b"x", b"yy"])]
    assert every.rdd.getNumPartitions() > 2
    third = [r.number for r in read(skip="2").where("file like '%a.avi'").orderBy("number").collect()]
    assert third == [1, 4, 7, 10]


def test_other_videos(spark, tmp_path):
    (tmp_path / "a.avi").write_bytes(b"RIFF....WAVE")
    spark.dataSource.register(video.VideoFrames)
    with pytest.raises(Exception, match="not an AVI"):
        spark.read.format("videoframes").load(str(tmp_path / "a.avi")).count()
    assert spark.read.format("videoframes").load(str(tmp_path / "*.none")).count() == 0


def unpng(data):
    at, idat = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        if kind == b"IHDR":
            w, h, _, colour = struct.unpack(">IIBB", part[:10])
        idat += part if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * (3 if colour == 2 else 1))
    assert (rows[:, 0] == 2).all()
    return np.cumsum(rows[:, 1:], 0, dtype=np.uint8).tobytes()


def test_pictures(spark):
    rng = np.random.default_rng(0)
    rows = [(1, rng.integers(0, 256, 35, np.uint8).tobytes(), 7, 5), (2, rng.integers(0, 256, 36, np.uint8).tobytes(), 4, 3), (3, None, 1, 1), (4, b"\x09", 1, 1), (5, b"a", None, 1)]
    df = spark.createDataFrame(rows, "i int, p binary, w int, h int")
    got = {r.i: r for r in df.select("i", pictures.png("p", "w", "h").alias("png"), pictures.bmp("p", "w", "h").alias("bmp")).collect()}
    for i, p, w, h in rows:
        if p is None or w is None:
            assert got[i].png is None and got[i].bmp is None
            continue
        assert opened.image_size(io.BytesIO(got[i].png)) == opened.image_size(io.BytesIO(got[i].bmp)) == (w, h) and unpng(got[i].png) == p
        line = (w * 3 + 3) // 4 * 4
        back = np.frombuffer(bytes(got[i].bmp)[54:], np.uint8).reshape(h, line)[::-1, : w * 3].reshape(h, w, 3)[..., ::-1]
        want = np.frombuffer(p, np.uint8).reshape(h, w, -1)
        assert (back == want).all()
    with pytest.raises(Exception, match="aren't"):
        df.select(pictures.png("p", F.lit(2), F.lit(9))).collect()


def test_pixels_by_hand():
    """Against plain loops: parts, turns, sizes, tiles."""
    rng = np.random.default_rng(3)
    for channels in (1, 3):
        a = rng.integers(0, 256, (5, 7, channels), np.uint8)
        shaped = lambda b, h, w: np.frombuffer(b, np.uint8).reshape(h, w, -1)
        part = shaped(pictures.cropped(a.tobytes(), 7, 5, -1, 2, 4, 9), 7, 5)
        for y in range(7):
            for x in range(5):
                inside = 0 <= x - 1 < 7 and 0 <= y + 2 < 5
                assert (part[y, x] == (a[y + 2, x - 1] if inside else 0)).all()
        for angle, at in {0: lambda x, y: (x, y), 90: lambda x, y: (y, 4 - x), 180: lambda x, y: (6 - x, 4 - y), 270: lambda x, y: (6 - y, x)}.items():
            h, w = (7, 5) if angle % 180 else (5, 7)
            for mirror in (False, True):
                t = shaped(pictures.turned(a.tobytes(), 7, 5, angle, mirror), h, w)
                for y in range(h):
                    for x in range(w):
                        sx, sy = at(x, y)
                        assert (t[y, x] == a[sy, 6 - sx if mirror else sx]).all()
        small = shaped(pictures.resized(a[:4, :6].tobytes(), 6, 4, 3, 2), 2, 3)
        assert np.abs(small - a[:4, :6].reshape(2, 2, 3, 2, channels).mean((1, 3))).max() <= 0.5
        assert pictures.resized(a.tobytes(), 7, 5, 7, 5) == a.tobytes() and set(pictures.resized(bytes([9]) * 35, 7, 5, 3, 11)) == {9}
        tile = rng.integers(0, 256, (3, 3, channels), np.uint8)
        p = shaped(pictures.pasted(a.tobytes(), 7, 5, tile.tobytes(), 3, 3, 5, -1), 5, 7)
        want = a.copy()
        want[0:2, 5:7] = tile[1:3, 0:2]
        assert (p == want).all()
    with pytest.raises(ValueError):
        pictures.turned(b"a", 1, 1, 45)


def test_png_files_of_every_filter():
    """Rows written with each of the five filters, with and without alpha, are read as they were."""
    rng = np.random.default_rng(4)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    for colour, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        a = rng.integers(0, 256, (10, 6, channels)).astype(int)
        lines = b""
        for y in range(10):
            kind, line = y % 5, []
            for x in range(6):
                for c in range(channels):
                    left, up, corner = a[y, x - 1, c] if x else 0, a[y - 1, x, c] if y else 0, a[y - 1, x - 1, c] if x and y else 0
                    p = left + up - corner
                    paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    line.append((a[y, x, c] - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
            lines += bytes([kind, *line])
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
        assert pictures.from_png(data) == (a[..., : 1 if channels < 3 else 3].astype(np.uint8).tobytes(), 6, 10)
    for wrong in (b"x", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 16, 0, 0, 0, 0))):
        with pytest.raises(ValueError):
            pictures.from_png(wrong)


def test_pixel_columns(spark):
    df = spark.createDataFrame([(1, bytes(range(6)), 3), (2, None, 3), (3, bytes(6), None)], "i int, p binary, w int")
    n = lambda *v: [F.lit(k) for k in v]
    got = df.select(
        "i", pictures.crop("p", "w", *n(2, 1, 0, 3, 2)).alias("c"), pictures.turn("p", "w", *n(2, 180, False)).alias("t"), pictures.resize("p", "w", *n(2, 3, 2)).alias("r"), pictures.paste("p", "w", F.lit(2), "p", "w", *n(2, 1, 1)).alias("s")
    ).orderBy("i").collect()
    assert [bytes(x) for x in got[0][1:]] == [bytes([1, 2, 4, 5]), bytes([5, 4, 3, 2, 1, 0]), bytes(range(6)), bytes([0, 1, 2, 3, 0, 1])] and all(x is None for r in got[1:] for x in r[1:])


def test_overlays(spark):
    """Poses over pictures: the pixels of a box's sides, an edge and a point change, others don't."""
    from annolith.functions import keypoints as kp

    k = [(0.5, 0.5, 2.0), (0.9, 0.1, 2.0)] + [(0.0, 0.0, 0.0)] * 15
    df = spark.createDataFrame([(1, bytes(40 * 30), k), (2, None, k)], "i int, p binary, kpts array<struct<x: double, y: double, v: double>>")
    box = F.array(F.struct(F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"), F.lit(0.5).alias("w"), F.lit(0.4).alias("h")))
    points = F.transform(F.filter("kpts", kp.valid), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    got = {r.i: r.o for r in df.select("i", pictures.overlay("p", F.lit(40), F.lit(30), box, kp.edges(F.col("kpts")), points).alias("o")).collect()}
    a = np.frombuffer(got[1], np.uint8).reshape(30, 40, 3)
    at = lambda x, y: tuple(int(v) for v in a[y, x])
    assert got[2] is None and at(20, 15) == pictures.POINT_COLOUR and at(10, 15) == at(20, 9) == pictures.BOX_COLOUR and at(28, 9) == pictures.EDGE_COLOUR and at(0, 0) == at(5, 25) == (0, 0, 0)
    assert pictures.overlaid(bytes(12), 2, 2, [], [], []) == bytes(12) and len(pictures.overlaid(bytes(4), 2, 2, [{"cx": 9, "cy": 9, "w": 1, "h": 1}], [], [{"x": -5, "y": 2}])) == 12

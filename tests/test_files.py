"""Files read by their heads, written as label folders, and record files that are damaged."""

import io
import struct

import pytest

from annolith.functions import labels
from annolith.sources import files, label_sink, opened, tfrecord


def jpeg(w, h, segments=0):
    extra = (b"\xff\xe1" + struct.pack(">H", 65000) + b"x" * 64998) * segments
    return b"\xff\xd8" + extra + b"\xff\xc2\x00\x0b\x08" + struct.pack(">HH", h, w) + b"\0" * 8


def tiff(w, h, end):
    mark, e = (b"II*\0", "<") if end == "<" else (b"MM\0*", ">")
    wide = struct.pack(e + "HHI", 256, 3, 1) + struct.pack(e + "HH", w, 0)
    high = struct.pack(e + "HHI", 257, 4, 1) + struct.pack(e + "I", h)
    return mark + struct.pack(e + "I", 40) + b"\0" * 32 + struct.pack(e + "H", 2) + wide + high


def webp(kind, body):
    return b"RIFF" + b"\0\0\0\0" + b"WEBP" + kind + b"\0\0\0\0" + body


HEADS = {
    "png": (b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 30, 20) + b"\0" * 20, (30, 20)),
    "bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -20) + b"\0" * 20, (30, 20)),
    "gif": (b"GIF89a" + struct.pack("<HH", 30, 20) + b"\0" * 30, (30, 20)),
    "jpg": (jpeg(30, 20, 5), (30, 20)),
    "tif": (tiff(30, 20, "<"), (30, 20)),
    "tiff": (tiff(30, 70000, ">"), (30, 70000)),
    "x.webp": (webp(b"VP8X", b"\0" * 4 + (29).to_bytes(3, "little") + (19).to_bytes(3, "little") + b"\0" * 9), (30, 20)),
    "l.webp": (webp(b"VP8L", b"\x2f" + (29 | 19 << 14).to_bytes(4, "little") + b"\0" * 9), (30, 20)),
    "k.webp": (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 30, 20) + b"\0" * 9), (30, 20)),
}


@pytest.mark.parametrize("name", sorted(HEADS))
def test_sizes_from_heads(name):
    data, size = HEADS[name]
    assert opened.image_size(io.BytesIO(data)) == size
    for n in range(40):  # cut anywhere: a size or none, no crash
        opened.image_size(io.BytesIO(data[:n]))
    assert opened.image_size(io.BytesIO(b"")) is None


def test_images_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, (data, _) in HEADS.items():
        (tmp_path / "in" / f"i.{name}").write_bytes(data)
    (tmp_path / "bad.png").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in files.images(spark, str(tmp_path), files.IMAGES_WIDE).collect()}
    assert got == {f"i.{n}": s for n, (_, s) in HEADS.items()} | {"bad.png": (None, None)}


def test_listing_goes_down(spark, tmp_path):
    for k, folder in enumerate(("one/images/x y", "two/images", "images", "two")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / f"{k}.JPG").write_bytes(b"x" * k)
    got = {(r.stem, r.ending, r.bytes) for r in files.listed(spark, str(tmp_path)).collect()}
    assert got == {(str(k), "jpg", k) for k in range(4)}
    tree = {(r.dataset, r.stem) for r in files.dataset_tree(spark, str(tmp_path)).collect()}
    assert tree >= {("one", "0"), ("two", "1")}


def test_label_folder(spark, tmp_path):
    spark.dataSource.register(label_sink.LabelFolder)
    rows = [(f"s{i:03d}", f"0 0.5 0.5 0.1 {i}\n") for i in range(50)] + [("none", None), ("blank", ""), ("ä b", "é\n")]
    df = spark.createDataFrame(rows, "stem string, raw string").repartition(4)
    out = tmp_path / "labels"
    df.write.format("labelfolder").mode("append").save(str(out))
    assert {p.name: p.read_text() for p in out.iterdir()} == {f"{s}.txt": r or "" for s, r in rows}
    back = files.label_files(spark, str(out))
    assert {r.stem: r.raw for r in back.collect()} == {s: r or "" for s, r in rows}
    images = spark.createDataFrame([("s001",), ("none",), ("gone",)], "stem string")
    states = {r.stem: r.state for r in labels.file_states(images, back).collect()}
    assert states == {"s001": "labelled", "none": "empty", "gone": "missing"}
    assert files.label_files(spark, str(tmp_path / "lab*")).count() == len(rows)
    # Written again, some files change; without the empty ones; the folder emptied before.
    df.write.format("labelfolder").mode("append").save(str(out))
    assert len(list(out.iterdir())) == len(rows)
    df.write.format("labelfolder").mode("overwrite").option("empty", "omit").save(str(out))
    assert sorted(p.stem for p in out.iterdir()) == sorted(s for s, r in rows if r)


def test_label_folder_refuses(spark, tmp_path):
    spark.dataSource.register(label_sink.LabelFolder)
    for stem in ("../x", "", None, ".."):
        df = spark.createDataFrame([(stem, "x")], "stem string, raw string")
        with pytest.raises(Exception, match="not a file's name"):
            df.write.format("labelfolder").mode("append").save(str(tmp_path / "o"))
    with pytest.raises(Exception, match="unknown empty"):
        df.write.format("labelfolder").mode("append").option("empty", "drop").save(str(tmp_path / "o"))
    empty = df.limit(0)
    empty.write.format("labelfolder").mode("append").save(str(tmp_path / "e"))
    assert list((tmp_path / "e").iterdir()) == []


def test_lines_written_and_parsed_again(spark, tmp_path):
    spark.dataSource.register(label_sink.LabelFolder)
    text = "0 0.5 0.25 0.125 0.5 " + " ".join("0.1 0.2 2" for _ in range(17))
    parsed = labels.parse_files(spark.createDataFrame([("a", text + "\n" + text)], "stem string, raw string"))
    labels.to_lines(parsed, trailing_newline=True).write.format("labelfolder").mode("append").save(str(tmp_path / "l"))
    assert (tmp_path / "l" / "a.txt").read_text() == text + "\n" + text + "\n"


def record(payload):
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", tfrecord.masked_crc(head)) + payload + struct.pack("<I", tfrecord.masked_crc(payload))


def test_records(spark, tmp_path):
    spark.dataSource.register(tfrecord.TFRecordSource)
    for k in range(3):
        (tmp_path / f"{k}.rec").write_bytes(record(b"") * (k + 1))
    (tmp_path / "note.txt").write_bytes(b"")
    load = lambda p: spark.read.format("tfrecord").option("verify", "true").load(str(p))
    assert load(tmp_path / "*.rec").count() == 6
    assert load(tmp_path).count() == 6
    assert load(tmp_path / "2.rec").count() == 3
    assert load(tmp_path / "none-*").count() == 0


def test_damaged_records():
    whole = record(b"abcdef")
    assert list(tfrecord.records(io.BytesIO(whole * 2), verify=True)) == [b"abcdef"] * 2
    for n in range(1, len(whole)):
        with pytest.raises(ValueError, match="cut short"):
            list(tfrecord.records(io.BytesIO(whole[:n])))
    changed = whole[:14] + b"X" + whole[15:]
    assert list(tfrecord.records(io.BytesIO(changed))) == [b"abXdef"]
    with pytest.raises(ValueError, match="damaged"):
        list(tfrecord.records(io.BytesIO(changed), verify=True))

"""Streams give what batches give."""

from annolith.operators import sequence as sq
from annolith.streaming import ingest


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_new_addresses(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",)], "url string").write.parquet(str(tmp_path / "u"))
    s = spark.readStream.schema("url string").parquet(str(tmp_path / "u"))
    assert sorted(r["url"] for r in drain(ingest.new_addresses(s), "addresses")) == ["a", "b"]


def test_unseen(spark):
    b = spark.createDataFrame([("a",), ("b",), ("b",)], "url string")
    assert [r["url"] for r in ingest.unseen(b, spark.createDataFrame([("a",)], "url string")).collect()] == ["b"]


def test_changed_frames(spark, tmp_path):
    rows = [(k, i, float((i * 7 + k) % 11) if i % 5 else None) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "seq_id long, frame_index long, feat double")
    df.coalesce(1).write.parquet(str(tmp_path / "f"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "f"))
    got = {(r["seq_id"], r["frame_index"]) for r in drain(ingest.changed_frames(s, 4.0), "frames") if r["duplicate"]}
    want = {(r["seq_id"], r["frame_index"]) for r in sq.near_duplicates(df, "feat", 4.0).collect()}
    assert got == want and want

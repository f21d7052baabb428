"""The ten operators: brute force, round trips and odd input."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annolith.llm import ann, coder, fingerprint, graph, jaccard, langid, mixing, packing, quality, queries, sharding, tokens, warc

D = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
#: Nulls, blanks, repeats, ties, one very long text, and columns that operators use inside.
ODD = [
    (1, "a b c d e f g", "x", "en"), (1, "a b c d e f g", "x", "en"), (2, None, "x", None), (3, "", None, "en"), (4, " \t\n", "y", "en"), (5, "A b c d e f g", "y", "de"),
    (6, "one", "y", "de"), (7, LONG, "z", "fr"), (8, LONG + " end", "z", "fr"), (None, "no id at all here today", "z", "en"), (9, "12 34 !!", "é", "es"), (10, "one", "é", "es"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string, lang string")
    for c in ("n", "hub", "rank", "score", "label", "key", "size", "_chunk"):
        df = df.withColumn(c, F.lit(7))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def words(text):
    return WORDS.findall(text or "")


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


# --- archive -----------------------------------------------------------------------------------
PAGES = [(1, "u", "aa"), (2, "u\r\nX: y", "aa"), (3, None, None), (4, "v", "bb"), (None, "v", "bb"), (4, "v", "bb"), (5, "w", "")]


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("address", F.lit(1))
    a = warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.read_archive(spark, a).toPandas()
    assert len(got) == len(PAGES) and spark.read.parquet(a.payloads).count() == 3
    kinds = sorted((r.id if r.id == r.id else -1, r.record_type, r.refers_to if r.refers_to == r.refers_to else -1) for r in got.itertuples())
    assert kinds == [(-1, "revisit", 4), (1, "response", -1), (2, "revisit", 1), (3, "response", -1), (4, "response", -1), (4, "response", -1), (5, "revisit", 3)]
    assert all(r.stated_digest == r.payload_digest for r in got.itertuples())
    for r in got.itertuples():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(rest) == size + 4 and rest.endswith(b"\r\n\r\n") and head.count(b"X: y") <= 1 and b"\nX:" not in head
    warc.export_warc(warc.read_archive(spark, a), str(tmp_path / "w"))
    whole = b"".join(__import__("gzip").decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert sorted(whole.split(b"WARC/1.1\r\n")[1:]) == sorted(bytes(r.record)[10:] for r in got.itertuples())


def members(data):
    """The gzip members of a file, each by itself."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        data = d.unused_data


def test_records_in_files_stand_alone(spark, tmp_path):
    """Bytes that aren't UTF-8 stay; each record is a member of its own; a job that fails leaves nothing."""
    rows = [(b"WARC/1.1\r\n\xff\xfe\0\r\n\r\n",), (b"WARC/1.1\r\n" + b"\x80" * 100_000,), (b"",)]
    df = spark.createDataFrame(rows, "record binary").repartition(2)
    warc.export_warc(df, str(tmp_path / "w"))
    found = [m for p in (tmp_path / "w").glob("*.warc.gz") for m in members(p.read_bytes())]
    assert sorted(found) == sorted(r[0] for r in rows) and not [p for p in (tmp_path / "w").iterdir() if p.is_dir()]
    with pytest.raises(Exception):  # noqa: B017
        warc.export_warc(df.withColumn("record", F.when(F.length("record") > 99, F.raise_error(F.lit("no")).cast("binary")).otherwise(F.col("record"))), str(tmp_path / "w"))
    assert len([m for p in (tmp_path / "w").glob("*.warc.gz") for m in members(p.read_bytes())]) == 3
    warc.export_warc(df.limit(0), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("*.gz"))


def test_odd_archives(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    a = warc.write_archive(none, str(tmp_path / "none"))
    assert warc.read_archive(spark, a).count() == 0
    long = "x" * 3_000_000
    none.unionByName(spark.createDataFrame([(1, "u", long), (1, "u", "é"), (2, "v", long)], none.schema)).write.parquet(str(tmp_path / "t" / "pages.parquet"))
    got = sorted(map(tuple, warc.op1(spark, str(tmp_path / "t")).collect()))
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(1, 2, "response", None), (1, 3_000_000, "response", None), (2, 3_000_000, "revisit", 1)]
    assert got[0][2] == base64.b32encode(hashlib.sha1("é".encode()).digest()).decode()


def test_damaged_archive(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    a = warc.write_archive(pages, str(tmp_path / "a"))
    stored = spark.read.parquet(a.payloads)
    bad = spark.createDataFrame(stored.withColumn("payload", F.concat("payload", F.lit(b"!"))).collect(), stored.schema)
    bad.write.mode("overwrite").parquet(a.payloads)
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_archive(spark, a).collect()


# --- neighbours --------------------------------------------------------------------------------
def test_scaled_copies_are_equally_near(spark):
    """Copies of a vector in other lengths have one score, wherever they stand in a block, so the smaller ids come first."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 24))
    rows = [(100 + 40 * k + i, (v * 2.0**k).tolist()) for k in range(8) for i, v in enumerate(base)]
    df = spark.createDataFrame([*rows, (50, base[3].tolist())], "vec_id long, embedding array<double>")
    got = ann.search(df).where("query_id = 50").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [103, 143, 183, 223, 263] and len({r.score for r in got}) == 1


def test_neighbours(spark):
    e = spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(900, None), (950, [0.0] * 64), (1000, [float("nan")] * 64), (1050, [None] * 64), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    copies = e.where("vec_id = 7").withColumn("vec_id", F.explode(F.sequence(F.lit(2000).cast("long"), F.lit(2030).cast("long"))))
    e = e.unionByName(odd).unionByName(copies)
    got = ann.search(e).toPandas().sort_values(["query_id", "rank"])
    t = e.where("vec_id is not null and embedding is not null").toPandas()
    x = np.array([[np.nan if v is None else v for v in r] for r in t.embedding], float)
    keep = np.isfinite(x).all(1) & (x != 0).any(1)
    x, ids = x[keep], t.vec_id.to_numpy()[keep]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    assert set(got.query_id) == set(ids[ids % 50 == 0])
    for q, rows in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -np.round(s, 12)))][:5]
        hits, total = hits + len(set(best) & set(rows.vec_id)), total + 5
        assert list(rows["rank"]) == [1, 2, 3, 4, 5] and (np.diff(rows.score) <= 1e-12).all()
    assert hits / total >= 0.9
    assert set(got[got.query_id == 2000].vec_id) == {7, 2001, 2002, 2003, 2004}


def test_radius_search_is_complete():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    codes[250:] = codes[:250] ^ (1 << rng.integers(0, 16, (250, 4))).astype(np.uint16)  # near ones
    block = ann.Block(codes)
    for radius in (0, 3, 5, 9, 14, 32, 64):
        for q in codes[:10]:
            assert set(block.within(q, radius)) == set(np.flatnonzero(ann.distances(q, codes) <= radius))
    assert block.probed(codes[0], 4).mean() < 0.05


def test_probes_are_few_where_vectors_have_structure():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(300, 64)), 10, axis=0) + 0.15 * rng.normal(size=(3000, 64))
    model = ann.learn(x)
    codes = model.encode(x)
    block = ann.Block(codes)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = share = 0
    for q in range(0, 3000, 50):
        best = [i for i in np.argsort(-(unit @ unit[q])) if i != q][:5]
        hits += len(set(best) & set(block.within(codes[q], model.radius)))
        share += block.probed(codes[q], model.radius).mean()
    assert hits / 300 >= 0.9 and share / 60 < 0.2


def test_few_vectors(spark):
    e = spark.createDataFrame([(50, [1.0, 0.0]), (51, [0.0, 1.0])], "vec_id long, embedding array<float>").withColumn("qid", F.lit(1)).withColumn("key", F.lit(1))
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(e).collect()] == [(50, 51)]
    assert ann.search(e.where("vec_id < 0")).count() == 0


def test_result_does_not_depend_on_blocks(spark, monkeypatch):
    e = spark.read.parquet(f"{D}/embeddings.parquet")
    want = sorted(map(tuple, ann.search(e).collect()))
    monkeypatch.setattr(ann, "BLOCK", 60)
    monkeypatch.setattr(ann, "CHUNK", 4)
    assert [r[:3] for r in sorted(map(tuple, ann.search(e).collect()))] == [r[:3] for r in want]


# --- fingerprints ------------------------------------------------------------------------------
def test_fingerprints(spark, odd, none):
    rows = fingerprint.with_fingerprint(odd.select("doc_id", "text"), "text", "fp")
    got = {r["text"]: tuple(r["fp"]) for r in rows.collect()}
    assert got[None] == got[""] == got[" \t\n"] == () and len(got["one"]) == fingerprint.WORDS and len(got[LONG]) == fingerprint.WORDS
    same = lambda a, b: spark.createDataFrame([(list(got[a]), list(got[b]))], "a array<long>, b array<long>").select(fingerprint.likeness(F.col("a"), F.col("b"))).first()[0]
    assert same(LONG, LONG) == 1 and same("", None) == 1 and same("", "one") == 0
    assert abs(same(LONG, LONG + " end") - len(shingles(LONG)) / (len(shingles(LONG)) + 1)) < 0.05
    assert fingerprint.fingerprints(none).count() == 0


def test_likeness_is_near(spark, docs):
    got = fingerprint.op3(spark, D).toPandas().set_index("doc_id")
    t = docs.toPandas().sort_values("doc_id").reset_index(drop=True)
    errors = []
    for i, (d, text) in enumerate(zip(t.doc_id, t.text, strict=True)):
        after = t.text[(i + 1) % len(t)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got.edited_sha256[d] == hashlib.sha256(edited.encode()).hexdigest()
        for other, column in ((edited, "near_edited"), (after, "near_next")):
            a, b = ({tuple(words(x)[k : k + 5]) for k in range(max(1, len(words(x)) - 4))} for x in (text, other))
            errors.append(got[column][d] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.2


def test_next_wraps_and_orders(spark, odd):
    hot = [(k, f"{k} text") for k in range(30)] + [(15, f"hot {k}") for k in range(90)] + [(None, f"none {k}") for k in range(60)]
    for data in ([(d, t or "") for d, t, *_ in ODD], hot, [(3, "alone")]):
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        rows = fingerprint.with_next(df, "doc_id", lambda x: x, ["text"]).toPandas()
        key = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
        want = sorted((-1 if d is None else d, key[t], t) for d, t in data)
        follow, got = {}, {}
        for (d, _, t), (_, _, n) in zip(want, want[1:] + want[:1], strict=True):
            follow.setdefault((d, t), []).append(n)
        for r in rows.itertuples():
            got.setdefault((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.text), []).append(r.next_text)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in follow.items()}
    assert len(fingerprint._ranges(df.unionByName(spark.createDataFrame(hot, df.schema)), "doc_id", 24).where("doc_id = 15").select("_b", "_s").distinct().collect()) > 5


def test_edited_texts_of_odd_rows(spark, odd, none):
    got = fingerprint.edited_likeness(odd).toPandas()
    assert len(got) == len(ODD) and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert sorted(got.n_chars) == sorted(len(t or "") for _, t, *_ in ODD) and got.fingerprint.nunique() == 7
    assert fingerprint.edited_likeness(none).count() == 0
    one = fingerprint.edited_likeness(odd.where("doc_id = 6")).first()
    assert one.near_next == 1 and one.n_chars == 3


# --- mixing ------------------------------------------------------------------------------------
def check_mix(got):
    got = got.toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("sid").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), source_size=("source_size", "first"))
    assert (by["size"] == by.source_size).all() and (np.abs(by.taken - by.target) <= 1).all()
    return got


def test_mix(spark, docs):
    m = mixing.mix(docs)
    got = check_mix(m.documents)
    again = mixing.mix(docs.repartition(5)).documents.toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    targets = m.targets.toPandas()
    assert abs(targets.target.sum() - 1.5 * targets.source_size.sum()) < 1e-6 * targets.source_size.sum()
    assert len(got) == docs.count()


def brute_mix(spark, docs, block_words, golden):
    """doc_id, size, taken, first_slot, slots, slot by slot and word by word."""
    rows = [(r.doc_id, len(words(r.text)), r.source, r.h) for r in docs.select("doc_id", "text", "source", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()]
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sources = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    streams = {x: [k for k in sorted(range(len(rows)), key=lambda k: (rows[k][3] % n, rows[k][3])) if rows[k][2] == x] for x in sources}
    size = {x: sum(rows[k][1] for k in streams[x]) for x in sources}
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(sources)
    while True:
        level = left / sum(weight[x] for x in open_) if open_ else 0
        full = {x for x in open_ if level * weight[x] > 2 * size[x]}
        if not full:
            break
        for x in full:
            target[x] = 2 * size[x]
            left -= target[x]
        open_ -= full
    target |= {x: level * weight[x] for x in open_}
    want = {x: min(int(target[x] + 0.5), 2 * size[x]) for x in sources}
    total, count, slots, before = sum(want.values()), -(-sum(want.values()) // block_words), {x: [] for x in sources}, 0
    for x in sources:
        lo, hi = (int(v / total * 2**32) for v in (before, before + want[x]))
        slots[x] = [t for t in range(count) if lo <= (t + 1) * golden % 2**32 < hi] or [count + sources.index(x)]
        before += want[x]
    out = [[r[0], r[1], 0, set()] for r in rows]
    for x in sources:
        line = [k for k in streams[x] for _ in range(rows[k][1])]
        at, k = 0, len(slots[x])
        for i, slot in enumerate(slots[x]):
            for _ in range(want[x] // k + (i < want[x] % k)):
                doc = out[line[at % len(line)]]
                doc[2], at = doc[2] + 1, at + 1
                doc[3].add(slot)
    return sorted((d, z, t, min(q) if q else None, len(q)) for d, z, t, q in out)


@pytest.mark.parametrize("golden", [mixing.GOLDEN, 1])
def test_mix_by_brute_force(spark, docs, monkeypatch, golden):
    few = docs.where("length(text) < 2500").withColumn("source", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("source")))
    monkeypatch.setattr(mixing, "GOLDEN", golden)
    got = mixing.mix(few, block_words=300).documents.select("doc_id", "size", "taken", "first_slot", "slots").collect()
    want = brute_mix(spark, few, 300, golden)
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want and sum(r[2] for r in want)


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 10)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # 3165 words by 5 : 2 : 1 : 5; a stops at 200 and null at 20, b at 2 / 3 of 2945, c at 1 / 3.
    assert got["a"] == 200 and got[None] == 20 and abs(got["b"] - 2945 * 2 / 3) < 1e-6 and abs(got["c"] - 2945 / 3) < 1e-6


def test_mix_of_odd_rows(spark, odd, none):
    got = check_mix(mixing.mix(odd, block_words=64).documents)
    assert len(got) == len(ODD) and sorted(got["size"]) == sorted(len(words(t)) for _, t, *_ in ODD)
    assert mixing.mix(none).documents.count() == 0
    out = mixing.repeat_documents(odd)
    assert out.columns == odd.columns and out.where("text is null").count() == 0
    assert mixing.repeat_documents(none).count() == 0


# --- tokens, packing, files of ids -------------------------------------------------------------
TRICKY = ["a <|EndOfText|> <|ENDOFTEXT|>b <|startoftext|>", "  áb<|endoftext|>c. İst'll don't ΣΑΣ. 12,3 x y z foo-bar's ...'s", "", None, "\x1c a\x85b İ.", "Ⅷ² ﬁ. É. ok̸.", "Word. WORD, word", LONG]


def test_encoder():
    enc = tokens.Encoder(tokens.default_path())
    for _ in range(2):  # the second time from what is kept
        ids, bounds = enc.encode(pa.array(TRICKY))
        for i, t in enumerate(TRICKY):
            assert list(ids[bounds[i] : bounds[i + 1]]) == enc.tokenizer.encode(t or "", add_special_tokens=False).ids
    ids, bounds = enc.encode(pa.array(["a", "b c", ""]).slice(1, 2))
    assert len(bounds) == 3 and bounds[1] == len(ids) > 0


def check_packed(got, size):
    got = got.toPandas()
    at = {}
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert not at or max(at.values()) <= size
    return got, len(at)


def test_packing(spark, docs, odd, none):
    enc = tokens.Encoder(tokens.default_path())
    for df, size in ((docs, 4096), (odd, 512), (none, 4096)):
        got, used = check_packed(packing.pack_documents(df, size=size), size)
        rows = df.select("doc_id", "text").collect()
        lengths = [len(enc.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows]
        assert got.length.sum() == sum(lengths) and used <= 1.02 * sum(lengths) / size + 2
        assert (got.length[got.piece < got.groupby("doc_id", dropna=False).piece.transform("max")] == size).all()


def test_plans_hold_every_piece():
    rng = np.random.default_rng(0)
    for _ in range(30):
        k = int(rng.integers(1, 40))
        counts = {int(a): int(b) for a, b in zip(rng.integers(1, 101, k), rng.integers(1, 30, k), strict=True)}
        p = packing.make_plan(counts, 100)
        seq = {}
        for a in range(len(p.length)):
            last = a + 1 == len(p.length) or p.length[a + 1] != p.length[a]
            end = counts[int(p.length[a])] if last else p.first[a + 1]
            for q in range(int(end - p.first[a])):
                seq.setdefault(int(p.sequence[a]) + q, []).append((int(p.offset[a]), int(p.length[a])))
        assert sum(map(len, seq.values())) == sum(counts.values())
        for places in seq.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= 100


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, coder.BLOCK, coder.BLOCK + 1, 9000):
        for ids in (rng.choice([3, 5, 7, 49407, 65535, 0], n), rng.integers(0, 65536, n), np.zeros(n), rng.choice([65536, 2**22, 2**32 - 1], n)):
            ids = ids.astype(np.uint32)
            assert (coder.decode(*coder.encode(ids)) == ids).all()
    data = bytearray(coder.pack_segment([1, None], np.array([3, 4]), np.arange(7, dtype=np.uint32)))
    assert coder.unpack_segment(bytes(data))[0] == [1, None]
    data[-5] ^= 0x80  # the highest bit of the code
    with pytest.raises(ValueError):
        coder.unpack_segment(bytes(data))


def test_blocks_stand_alone():
    ids = np.random.default_rng(1).choice([3, 5, 7, 9], 9000).astype(np.uint32)
    (head, blocks), b = coder.encode(ids), coder.BLOCK
    assert (coder.decode(head, blocks[1:2]) == ids[b : 2 * b]).all() and sum(len(c) for _, _, c in blocks) * 2 < 9000


def test_fewer_bits_than_order_0(spark):
    """Whole texts of a table: the code, its heads and checksums take less than the ids' own entropy, and less than a plain deflate."""
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").toArrow()["text"].combine_chunks()
    ids, _ = tokens.with_end(*tokens.encoder(tokens.default_path()).encode(texts), 1)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    segment = coder.pack_segment([1], np.array([len(ids)]), ids)
    assert 8 * len(segment) / len(ids) < 0.85 * -(share * np.log2(share)).sum() and len(segment) < 0.8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    assert (coder.unpack_segment(segment)[2] == ids).all()


def test_classes_are_learned_from_all_pairs(monkeypatch):
    """What follows an id at odd places alone tells its class, however long a segment is and however its pairs are counted."""
    rng = np.random.default_rng(5)
    x = np.empty(800_001, np.int32)
    x[1::2] = rng.integers(50, 100, 400_000)
    x[0] = 0
    x[2::2] = rng.integers(0, 25, 400_000) + 25 * (x[1::2] % 2)
    of = coder.classes(x, 100)
    assert not set(of[50::2]) & set(of[51::2])
    monkeypatch.setattr(coder, "PAIR_TABLE", 1)
    assert (coder.classes(x, 100) == of).all()


def test_full_store_keeps_the_words_at_hand(monkeypatch):
    enc, learned = tokens.Encoder(tokens.default_path()), []
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (learned.append(sorted(w for w in words if w)), learn(words)))
    for text in ("house garden thrown", "garden qwertyx zyxwvut", "one two six ten red sky", "sky garden!"):
        ids, bounds = enc.encode(pa.array([text, text]))
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and bounds.tolist() == [0, len(want), 2 * len(want)]
    assert learned[:2] == [["garden", "house", "thrown"], ["qwertyx", "zyxwvut"]] and "sky" not in learned[3]


def plain_model(x, head):
    """What one block's model says before each id, by dictionaries and lists: a prediction with its chance, or none, and the table in use."""
    squash, stretch = coder.SQUASH.tolist(), coder.STRETCH.tolist()
    cells, hit, weight = [{}, {}], [[(i % 16) * 200 + 300 for i in range(32)] for _ in range(2)], [20000, 30000, 16000]
    prev = prev2 = 0
    table = len(head.codes) - 1
    for v in x:
        one = prev * 40503
        at = ((one >> 4) % coder.SLOTS, ((one + prev2 * 60493) >> 4) % coder.SLOTS)
        (id1, sure1), (id2, sure2) = (c.get(a, (0, 0)) for c, a in zip(cells, at, strict=True))
        said = None
        if sure1 > 1 or sure2 > 0:
            guess = id2 if sure2 else id1
            agree = sure1 if id1 == guess else 0
            states = (agree + 16 * (sure2 > 0), sure2 + 16 * (agree > 0))
            rates = [hit[0][states[0]], hit[1][states[1]]]
            inputs = [stretch[rates[0]], stretch[rates[1]], stretch[min(4095, int(head.size[table, guess]) >> 8)]]
            p = squash[min(2047, max(-2047, sum(a * b for a, b in zip(inputs, weight, strict=True)) >> 16)) + 2047]
            said = (guess, p)
            was = 4096 * (guess == v)
            weight = [min(200_000, max(-200_000, w + ((a * (was - p) * 6) >> 10))) for w, a in zip(weight, inputs, strict=True)]
            for k in range(2):
                hit[k][states[k]] = rates[k] + ((was - rates[k]) >> 5)
        yield said, table
        for c, a, (i, sure) in zip(cells, at, ((id1, sure1), (id2, sure2)), strict=True):
            c[a] = (v, min(15, sure + 1)) if sure and i == v else (v, 1) if sure <= 1 else (i, sure >> 1)
        prev2, prev, table = prev, v, int(head.of[v])


@pytest.mark.parametrize("kind", ["words", "few", "any"])
def test_predictions_by_a_plain_model(kind):
    """Tables, candidates, chances and confidences of two blocks side by side are those of each by itself."""
    rng = np.random.default_rng(3)
    ids = {"words": rng.zipf(1.4, 1500) % 90, "few": rng.choice([1, 2, 3], 1500), "any": rng.integers(0, 70000, 1500)}[kind].astype(np.uint32)
    ids[300:400] = ids[100:200]
    block = 900
    head, x = coder.Head.of_ids(ids, block)
    again = coder.Head.of_bytes(head.bytes())
    assert (again.ids == head.ids).all() and (again.size == head.size).all() and (head.ids[x] == ids).all() and set(head.size.sum(1)) <= {0, coder.TOTAL}
    models = coder._Models(2, head)
    plain = [plain_model(x[b * block : (b + 1) * block].tolist(), head) for b in range(2)]
    for t in range(block):
        k = 2 if t < 600 else 1
        now = np.array([x[t], x[block + t]][:k], np.int32) if k == 2 else x[t : t + 1]
        who, guess, chance = models.predict(k)
        told = {int(w): (int(g), int(c) >> (coder.BITS - 12)) for w, g, c in zip(who, guess, chance, strict=True)}
        for b in range(k):
            said, table = next(plain[b])
            assert told.get(b) == said and models.row[b] == table * len(head.ids) and head.size[table, now[b]] > 0
        models.learn(now, now[who] == guess)


def test_carries_go_back():
    """Ranges whose upper ends touch carry through words that are full; a part of one in a million asks for two words."""
    out, at, last = coder._Writer(1, 64), np.arange(1), coder.TOTAL - 1
    parts = [(last, 1)] * 13 + [(last - 400, 400)] + [(0, 1), (last, 1)] * 5
    for start, size in parts:
        out.code(at, np.array([start]), np.array([size]))
    source = coder._Reader(out.finish())
    for start, size in parts:
        where, step = source.place(at)
        assert start <= where[0] < start + size
        source.take(at, step, np.array([start]), np.array([size]))


def test_steps_at_once_give_the_same_code():
    """Many steps coded at once, the first blocks' alone at the end, are what one step after the other gives."""
    rng = np.random.default_rng(2)
    shape = (200, 7)
    chance = rng.choice([0, 1 << 8, 4000 << 8, 4095 << 8], shape).astype(np.int32)
    hit = (rng.random(shape) < 0.5) & (chance > 0)
    size = rng.choice([1, 5, 1000, 1 << 18], shape).astype(np.uint64)
    start = rng.integers(0, coder.TOTAL - (1 << 18), shape).astype(np.uint64)
    plain, fast = coder._Writer(7, 16), coder._Writer(7, 16)
    for t in range(200):
        k = 7 if t < 120 else 5
        c, h = chance[t, :k], hit[t, :k]
        plain.code(slice(0, k), np.where(h, 0, c), np.where(h, c, coder.TOTAL - c))
        at = np.flatnonzero(~h)
        plain.code(at, start[t, at], size[t, at])
    for lo, hi, k in ((0, 100, 7), (100, 120, 7), (120, 200, 5)):
        fast.code_steps(*(a[lo:hi, :k] for a in (chance, hit, start, size)))
    for a, b in zip(plain.finish(), fast.finish(), strict=True):
        assert a.tolist() == b.tolist()


def test_segments_side_by_side():
    """Segments with heads of many and of few ids, and an empty one, are read together as each by itself."""
    rng = np.random.default_rng(4)
    given = [rng.zipf(1.3, 9000) % 6000, rng.choice([3, 5, 7], 5000), np.zeros(0), rng.integers(0, 2**32, 300)]
    given = [g.astype(np.uint32) for g in given]
    data = [coder.pack_segment([k], np.array([len(g)]), g) for k, g in enumerate(given)]
    for k, ((docs, lengths, ids), g) in enumerate(zip(coder.unpack_segments(data), given, strict=True)):
        assert docs == [k] and lengths.tolist() == [len(g)] and (ids == g).all()
    with pytest.raises(ValueError):
        coder.unpack_segments([data[0], data[1][:-5] + bytes([data[1][-5] ^ 0x80]) + data[1][-4:]])


def test_segments_are_filled(monkeypatch):
    """Batches of one task make one segment, as far as its bytes go; rows stay in order."""
    batches = [pa.record_batch({"doc_id": [k], "text": pa.array([t], pa.string())}) for k, t in enumerate(["a" * 40, None, "b" * 50, "c" * 20, "d" * 200, ""])]
    monkeypatch.setattr(coder, "SEGMENT_BYTES", 100)
    assert [b.column("doc_id").to_pylist() for b in coder.full_batches(iter(batches))] == [[0, 1, 2], [3], [4], [5]]


def test_words_are_learned_without_the_steps_that_leave_them(monkeypatch):
    """Small letters go to the merges alone; all other words take every step. Ids are the tokenizer's own."""
    enc, seen = tokens.Encoder(tokens.default_path()), []
    plain = enc.letters
    monkeypatch.setattr(enc, "letters", type("Seen", (), {"encode_batch_fast": lambda _, texts, **k: (seen.extend(texts), plain.encode_batch_fast(texts, **k))[1]})())
    text = "garden straße ªº µm ñandú ÿes ñ̃x слово 東京 Ünder x÷y ×"
    assert enc.encode(pa.array([text]))[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert set(" ".join(seen).split()) == {"garden", "straße", "ªº", "µm", "ñandú", "ÿes", "ünder"}


def test_files_of_ids(spark, odd, none, tmp_path):
    enc = tokens.Encoder(tokens.default_path())
    coder.write_ids(odd, str(tmp_path / "ids"))
    got = coder.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    want = sorted([(-1 if d is None else d, t or "") for d, t, *_ in ODD])
    at = 0
    for r, (d, t) in zip(got, want, strict=True):
        ids = [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["ids"]) == (None if d < 0 else d, at, ids)
        at += len(ids)
    sums = coder._read(spark, str(tmp_path / "ids"), with_ids=False).orderBy("start").collect()
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in sums] == [(r["start"], len(r["ids"]), tokens.crc32(np.array(r["ids"], np.uint32))) for r in got]
    coder.write_ids(none, str(tmp_path / "none"))
    assert coder.read_ids(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("rows", [1, 40])
def test_long_lists_are_dealt(spark, monkeypatch, rows):
    """Lists of any length, in many ranges or in one task, give the same neighbours and lengths."""
    rng = np.random.default_rng(9)
    given = sorted({(int(t), int(n), int(d)) for t, n, d in zip(rng.choice([1, 1, 1, 2, 3, 4], 600), rng.integers(1, 30, 600), rng.integers(0, 10**6, 600), strict=True)})
    want = []
    for k, (t, n, d) in enumerate(given):
        b, f = given[k - 1] if k and given[k - 1][0] == t else None, given[k + 1] if k + 1 < len(given) and given[k + 1][0] == t else None
        want.append((t, n, d, b and b[2], b and b[1], f and f[1], sum(x[0] == t for x in given)))
    monkeypatch.setattr(jaccard, "LIST", rows)
    df = spark.createDataFrame(given, "token long, n int, digest long").repartition(5)
    got = jaccard.in_lists(df, "digest", "lists").select("token", "n", "digest", "a", "before", "after", "df").collect()
    assert sorted(map(tuple, got)) == want
    none = jaccard.in_lists(df.limit(0), "digest", "lists")
    assert none.count() == 0


def test_long_lists_change_nothing(spark, docs, monkeypatch):
    """The same classes if every list of two is dealt in ranges."""
    plain = sorted(map(tuple, jaccard.classes(docs).collect()))
    monkeypatch.setattr(jaccard, "LIST", 1)
    assert sorted(map(tuple, jaccard.classes(docs).collect())) == plain and len({r[2] for r in plain}) < len(plain)


# --- quality, language -------------------------------------------------------------------------
def test_quality(spark):
    big = "/root/testdata/sf0.01"
    got = quality.op7(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_of_odd_rows(spark, odd, none):
    for labels in ([(1, 1, 0), (6, 0, 0), (7, 1, 0), (None, 1, 0), (5, None, 0)], []):
        model = quality.train(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert quality.score(odd.select("doc_id", "text"), model, ["doc_id"]).where("score between 0 and 1").count() == len(ODD)
    assert quality.score(none, model, ["doc_id"]).count() == 0


def test_pairs_are_learned():
    x = np.random.default_rng(0).random((4000, 2)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and model.pairs


def test_language(spark):
    big = "/root/testdata/sf0.01"
    got = langid.op10(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


def test_language_of_odd_rows(spark, odd, none):
    model = langid.train(odd)
    got = langid.predict(odd.select("doc_id", "text"), model, ["doc_id"]).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all()
    assert (got[got.doc_id.isin([2, 3, 4, 9])].lang_pred == "und").all() and (got[got.doc_id == 7].lang_pred != "und").all()
    empty = langid.train(none)
    assert langid.predict(odd.select("doc_id", "text"), empty, ["doc_id"]).where("lang_pred = 'und' and score = 0").count() == len(ODD)
    assert langid.predict(none, model, ["doc_id"]).count() == 0


def test_words_of_a_text_that_switches(docs):
    t = docs.where("lang in ('en', 'de')").orderBy("doc_id").limit(60).toPandas()
    model = langid.fit(pa.array(t.text), list(t.lang))
    en, de = (" ".join(words(t[t.lang == x].text.iloc[0])[:30]) for x in ("en", "de"))
    got = [x[1] for x in langid.label_words(f"{en} {de}", model)]
    assert got[:25].count("en") >= 22 and got[-25:].count("de") >= 22


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    got = langid.forward_backward(e, np.array([0, 4, 4, 7]), t)
    for lo, hi in ((0, 4), (4, 7)):
        sums = np.zeros((hi - lo, 3))
        for path in __import__("itertools").product(range(3), repeat=hi - lo):
            w = np.exp(sum(e[lo + i, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in zip(path[:-1], path[1:], strict=True)))
            for i, k in enumerate(path):
                sums[i, k] += w
        assert np.allclose(got[lo:hi], sums / sums.sum(1, keepdims=True))


def test_transitions_gradient():
    """Expected counts are the derivatives of the log partition function."""
    rng = np.random.default_rng(1)
    e, t, bounds = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 5, 6, 6, 9])

    def log_z(e, t):
        total = 0.0
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            total += np.log(sum(np.exp(sum(e[lo + i, k] for i, k in enumerate(p)) + sum(t[a, b] for a, b in zip(p[:-1], p[1:], strict=True))) for p in __import__("itertools").product(range(3), repeat=hi - lo)))
        return total

    p, steps = langid.expected(e, bounds, t)
    for which, got in ((0, p), (1, steps)):
        for i, j in np.ndindex(got.shape):
            d = np.zeros(got.shape)
            d[i, j] = 1e-5
            up, down = ((e + d, t), (e - d, t)) if which == 0 else ((e, t + d), (e, t - d))
            assert abs((log_z(*up) - log_z(*down)) / 2e-5 - got[i, j]) < 1e-6


def test_every_letter_of_long_words_counts(docs):
    t = docs.where("lang in ('en', 'de')").orderBy("doc_id").limit(60).toPandas()
    model = langid.fit(pa.array(t.text), list(t.lang))
    for lang in ("en", "de"):
        other = "de" if lang == "en" else "en"
        glued = {x: "".join(re.sub("[^a-zäöüß]", "", "".join(t[t.lang == x].text).lower()))[:4000] for x in (lang, other)}
        # The ends of the run are of the other language, which must not decide.
        assert langid.label(pa.array([glued[other][:40] + glued[lang] + glued[other][:40]]), model)[0] == [lang]
    links, codes, bounds = langid.chain(pa.array(["ab " + "x" * 50 + "1y ", None, "z" * 24]))
    assert ["".join(links[c] for c in codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == ["ab" + "x" * 50 + "y", "", "z" * 24]


def test_learning_from_repeated_rows(spark, none):
    rows = [(1, "der die das und nicht", "s", "de")] * 500 + [(k, "the and of not with", "s", "en") for k in range(2, 40)] + [(50, "le la les", "s", "fr"), (51, None, "s", "fr")]
    df = spark.createDataFrame(rows, none.schema)
    assert langid.train(df, sample_docs=4).languages == ["de", "en", "fr"]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    assert quality.score(df, quality.train(df, labels, sample_rows=40), df.columns, "x").where("x between 0 and 1").count() == len(rows)


# --- similar documents -------------------------------------------------------------------------
def brute(rows):
    ids = [d for d, _ in rows]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(zip(ids, sets, strict=True)))


def near_copies():
    """Clusters of near copies, chains whose ends aren't alike, a passage in many documents, exact copies."""
    rng = np.random.default_rng(4)
    new = lambda n: [f"t{k}" for k in rng.integers(0, 10**6, n)]
    out, passage = [], new(50)
    for _ in range(6):
        base = new(int(rng.integers(20, 120)))
        for _ in range(12):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = new(1)[0]
            out.append(copy)
    chain = new(60)
    for _ in range(15):
        out.append(list(chain))
        chain = chain[4:] + new(4)
    out += [new(20) + passage + new(int(rng.integers(5, 60))) for _ in range(25)] + [passage + new(int(rng.integers(0, 8))) for _ in range(8)]
    out += [out[0]] * 9 + [["a", "b"]] * 3 + [["a", "b", "c"]] + [[]] * 2
    order = rng.permutation(len(out))
    return [(int(i) + 1, " ".join(out[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize("block, bits", [(400_000, 1 << 26), (300, 1 << 10)])
def test_classes(spark, monkeypatch, block, bits):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
    rows = near_copies()
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_classes_of_odd_rows(spark, odd, none):
    got = jaccard.classes(odd).toPandas()
    assert len(got) == len(ODD)
    by = got.dropna(subset=["doc_id"]).drop_duplicates().set_index("doc_id").component_id.to_dict()
    assert by[1] == by[5] == 1 and by[7] == by[8] == 7 and by[6] == by[10] == 6 and by[3] == 3 and by[4] == 4
    assert jaccard.classes(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").select("doc_id").collect()) == [1, 2, 3, 4, 6, 7, 9]


def test_classes_through_rows_without_id(spark):
    t = [f"t{k}" for k in range(80)]
    text = lambda a: " ".join(t[a : a + 60])
    # Neighbours are linked, 1 and 2 only through the texts between, which have no id.
    rows = [(1, text(0)), (None, text(6)), (None, text(6)), (None, text(12)), (2, text(18)), (None, "all by itself"), (3, "a b"), (3, "c d")]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, [(r.doc_id, r.component_id) for r in got])) == sorted(map(str, [(1, 1), (None, 1), (None, 1), (None, 1), (2, 1), (None, None), (3, 3), (3, 3)]))


def test_one_row_of_each_class(spark):
    t = [f"t{k}" for k in range(80)]
    text = lambda a: " ".join(t[a : a + 60])
    rows = [
        (None, "x y"), (None, "x y"), (None, "X  y"),  # copies without an id
        (None, text(0)), (None, text(4)), (5, text(8)), (7, text(8)),  # near copies of a numbered one
        (9, "one text"), (9, "another text"), (9, "another text"), (10, "another text"),  # an id with several texts
        (None, None), (None, " "), (11, ""),
    ]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = [(r.doc_id, (r.text or "").lower().split()) for r in got]
    want = [(None, ["x", "y"]), (5, text(8).split()), (9, ["one", "text"]), (9, ["another", "text"]), (None, []), (None, []), (11, [])]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300)] + [(1000, k) for k in range(1001, 1050)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got[k] == 0 for k in range(41)) and got[200] == 100 and got[1049] == 1000
    assert graph.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# --- shards ------------------------------------------------------------------------------------
def test_shards(spark):
    got = sharding.op9(spark, D).toPandas()
    n = got.groupby("shard").size()
    assert len(n) == 40 and n.max() - n.min() <= 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    # Equal texts are in one shard unless a boundary runs through them.
    many = got.groupby("text_crc32").shard.nunique()
    assert (many > 1).sum() <= 39


def test_a_hub_of_a_third_of_all_rows(spark):
    rows = [(k, b"hot" if k % 3 == 0 else (b"pair%d" % (k // 2) if k % 2 else b"one%d" % k)) for k in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "key long, hub binary"), 10).toPandas()
    n = got.groupby("shard").size()
    assert list(n) == [300] * 10 and got[got.hub == b"hot"].shard.nunique() <= 5
    assert sharding.shard(spark.createDataFrame([], "key long, hub binary"), 10).count() == 0


def test_a_hub_of_a_third_of_forty_shards(spark):
    rows = [(i, b"hot" if i % 3 == 0 else b"pair%d" % (i // 6)) for i in range(12_000)]
    got = sharding.shard(spark.createDataFrame(rows, "key long, hub binary"), 40).toPandas()
    assert list(got.groupby("shard").size()) == [300] * 40 and got[got.hub == b"hot"].shard.nunique() <= 15
    few = got[got.hub != b"hot"].groupby("hub").shard.nunique()
    assert few.max() <= 2 and (few > 1).mean() < 0.1


# --- registry ----------------------------------------------------------------------------------
def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] and set(queries.oracle_sql()) <= set(names)

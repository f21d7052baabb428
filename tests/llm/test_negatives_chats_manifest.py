"""Hard negatives, chats and manifests: brute force, round trips and odd input."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.llm import chat, merkle, negatives, queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_chat_format", "op13_merkle"])
def test_equal_to_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = queries.queries()[name](spark, D).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).values.tolist()))
    assert rows(got) == rows(want)


# --- hard negatives ----------------------------------------------------------------------------
def brute_negatives(rows, every=100, k=5):
    """The rule pair by pair."""
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {(i, label, tuple(v)) for i, label, v in ok if i % every == 0}:
        scored = sorted((-sum(p * q for p, q in zip(a[2], v, strict=True)), i, label) for i, label, v in ok if i != a[0] and len(v) == len(a[2]))
        positives = [s for s in scored if s[2] == a[1]][:k]
        for p in positives:
            mine = [s for s in scored if s[2] != a[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:k]
            out += [(a[0], p[1], r + 1, s[1], -p[0], -s[0]) for r, s in enumerate(mine)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    for c in ("no", "place", "score", "rank", "_part", "id", "vec"):
        df = df.withColumn(c, F.lit(1))
    return sorted(map(tuple, negatives.mine(negatives.usable(df, "vec_id", "embedding", F.col("label"))).collect()))


@pytest.mark.parametrize("seed", [0, 1])
def test_negatives_by_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(negatives, "CHUNK_COMPONENTS", 48)  # four anchors a chunk
    rows = [(i, int(rng.integers(3)), rng.normal(size=12).astype(np.float32).round(1).tolist()) for i in range(0, 500, 2)]
    rows += [(i + 1, int(rng.integers(3)), v) for i, _, v in rows[::9]]  # equal vectors, so ties
    rows += rows[:1] + rows[50:52]  # repeated rows, also of an anchor
    rows += [(200, 2, [0.5] * 12), (None, 1, [1.0] * 12), (101, None, [1.0] * 12), (103, 1, None), (105, 1, [None] + [1.0] * 11), (107, 1, [math.nan] * 12), (109, 1, [math.inf] * 12)]
    rows += [(300, 1, []), (301, 1, []), (302, 2, []), (400, 1, [1.0, 2.0]), (401, 1, [2.0, 1.0]), (403, 0, [1.0, 1.0]), (405, 0, [0.0, -1.0])]
    want = brute_negatives(rows)
    assert len(want) > 50 and mined(spark, rows) == want


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (3, 2, [1.0])]) == [] and mined(spark, [(100, 1, [1.0])]) == []


def test_intervals_hold_every_score():
    """After each plane the exact score lies in the interval, which halves; the last is the score."""
    rng = np.random.default_rng(5)
    q, a = rng.integers(-300, 300, (40, 7)).astype(float), rng.integers(-300, 300, (6, 7)).astype(float)
    planes, exact, sums, before = negatives.Planes.of(q), a @ q.T, np.zeros((6, 40)), np.inf
    up, down = np.where(a > 0, a, 0).sum(1)[:, None], np.where(a < 0, a, 0).sum(1)[:, None]
    for i, (p, w) in enumerate(zip(planes.planes, planes.weights, strict=True)):
        sums += w * (a @ p.T)
        rest = planes.open_after(i)
        assert (sums + rest * down <= exact).all() and (exact <= sums + rest * up).all() and rest < before
        before = rest
    assert (sums == exact).all()


def test_few_pairs_are_followed_one_by_one(monkeypatch):
    rng = np.random.default_rng(6)
    q, a = rng.integers(-99, 99, (300, 5)).astype(float), rng.integers(-99, 99, (4, 5)).astype(float)
    exact = a @ q.T
    for few, pairs in ((1.1, 7), (0.0, 10), (0.5, 50)):
        monkeypatch.setattr(negatives, "FEW", few)
        monkeypatch.setattr(negatives, "PAIRS", pairs)
        asked = negatives.Asked(a, np.array([0, 500, -np.inf, 10**6], float), np.array([900, 5000, 0, np.inf]))
        got = {(int(r), int(c)): int(s) for rs, cs, ss in negatives.scores(asked, negatives.Planes.of(q), np.ones((4, 300), bool), 0) for r, c, s in zip(rs, cs, ss, strict=True)}
        assert got == {(r, c): int(exact[r, c]) for r in range(4) for c in range(300) if asked.least[r] <= exact[r, c] <= asked.most[r]}


def test_too_large_components():
    with pytest.raises(ValueError):
        negatives.integers(np.array([[1e300]]))


# --- chats -------------------------------------------------------------------------------------
TRICKY = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nhi", "<|im_sep|>", "<\\|im_end|>", "<\\\\|im_sep|>", "<", "|im_end|>", "<<|", "\\", "a\nb\r\n", "𝄞 é <|", "$1 \\1 %0A", "<|" * 5, None]


def described(turns):
    """The columns of read_back from the turns themselves, and the text by the rule."""
    turns = [((r or ""), (t or "")) for r, t in turns]
    esc = lambda s: re.sub(r"<(\\*)\|", r"<\1\\|", s)
    text, loss, before = "", "", None
    for role, t in turns:
        head = f"<|im_start|>{esc(role.replace('%', '%25').replace(chr(10), '%0A'))}\n"
        text += "<|im_sep|>" if role == before else ("" if before is None else "<|im_end|>\n") + head
        text, before = text + esc(t), role
        loss += t if role == "assistant" else ""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    text += "<|im_end|>\n"
    return text, (len(turns), h("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), h(loss), len(text))


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("segment", "rows", "blocks", "loss", "_n", "_long", "first"):
        df = df.withColumn(c, F.lit(1))
    return chat.format_chats(df)


def test_chats_are_told_again(spark):
    roles = ["user", "assistant", "assistant", "", None, "a\nb%", "<|im_end|>", "assistant", "assistant", "user", "user", "system", "Assistant", "assistant", "tool"]
    convs = {1: list(zip(roles, TRICKY, strict=True)), 2: [("assistant", None)], 3: [("user", "x")], 4: [("user", "only"), ("user", "users")], None: [("assistant", "no id")]}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    formatted = chats(spark, rows[::-1]).collect()
    assert {r.conv_id: r.text for r in formatted} == {c: described(t)[0] for c, t in convs.items()}
    for r in formatted:
        masked = [r.text[s.start : s.start + s.length] for s in r.loss]
        assert [re.sub(r"<(\\*)\\\|", r"<\1|", m) for m in masked] == [t or "" for role, t in convs[r.conv_id] if role == "assistant"]
    got = {r.conv_id: tuple(r)[1:6] for r in chat.read_back(chats(spark, rows)).collect()}
    assert got == {c: described(t)[1] for c, t in convs.items()}


def test_order_of_turns(spark):
    """Null turns come first; ties go by role, then text; equal rows stay."""
    rows = [(1, 5, "b", "z"), (1, 5, "b", "y"), (1, 5, "a", "z"), (1, None, "u", "first"), (1, 5, "b", "y"), (1, -3, "u", "second")]
    got = chat.read_back(chats(spark, rows)).first()
    assert got.turns_sha256 == described([("u", "first"), ("u", "second"), ("a", "z"), ("b", "y"), ("b", "y"), ("b", "z")])[1][1] and got.n_turns == 6


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_long_conversations_in_segments(spark, monkeypatch, segment):
    """Put end to end, segments are the text of the whole; runs of a role go on over their borders."""
    monkeypatch.setattr(chat, "SEGMENT", segment)
    role = lambda i: ["user", "assistant", "assistant", "assistant", "assistant", "tool", "tool"][i % 7]
    convs = {7: [(role(i), f"t{i} <|im_end|>" * (i % 3)) for i in range(700)], 8: [("assistant", "x")] * 300, None: [(role(i), "n") for i in range(5)], 9: [("user", "very long " * 200_000)]}
    formatted = chats(spark, [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]).collect()
    assert all(len(r.loss) <= segment for r in formatted)
    whole = defaultdict(str)
    for r in sorted(formatted, key=lambda r: r.segment):
        whole[r.conv_id] += r.text
    assert dict(whole) == {c: described(t)[0] for c, t in convs.items()}
    got = {r.conv_id: tuple(r)[1:6] for r in chat.read_back(spark.createDataFrame(formatted)).collect()}
    assert got == {c: described(t)[1] for c, t in convs.items()}


def test_no_chats(spark):
    assert chats(spark, []).count() == 0 and chat.read_back(chats(spark, [])).count() == 0


def test_chats_need_no_python(spark):
    plan = chats(spark, [(1, 1, "a", "b")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- manifest ----------------------------------------------------------------------------------
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """The top of a list of digests, and per node its siblings of each level with its place among them."""
    paths = [[] for _ in nodes]
    level, of = list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, at in enumerate(of):
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            paths[i].append((run[: at % 16], run[at % 16 + 1 :]))
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        of = [at // 16 for at in of]
    return level[0], paths


def brute_manifest(rows):
    """(id, leaf, subroot, root, proof, folded, verified) of rows (id, group, leaf, now)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    mine = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        mine[g] = brute_tree([r[2] for r in groups[g]])
    root, above = brute_tree([mine[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for r, path in zip(groups[g], mine[g][1], strict=True):
            now = r[3]
            for left, right in path + above[k]:
                now = h(*left, now, *right)
            out.append((r[0], r[2], mine[g][0], root, h(*[x for left, right in path + above[k] for x in (*left, *right)]), now, now == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1, 2], [257, 5, 33], [1] * 20 + [300]])
def test_manifest_by_brute_force(spark, monkeypatch, sizes):
    """Blocks of 16 leaves, so that trees have several stages."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, None if g == 3 else f"s{g}é", h(str((g, i))), h(str((g, i))) if i % 3 else h("changed")) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, grp string, digest string, now string").repartition(4)
    # The workers' module isn't patched, but a function that is passed along is.
    monkeypatch.setattr(merkle, "_levels_here", lambda n, stage: max(0, min(1, merkle.depth(n) - stage)))
    got = merkle.verify(df)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark, tmp_path):
    long = "Wörter " * 200_000
    docs = [(1, "b", "en", 3, "ABC"), (1, "b", "en", 3, "ABC"), (1, "b", "en", 3, "abd"), (None, "b", None, None, None), (2, None, "de", 0, ""), (3, None, None, 5, long), (-7, "", "x", 1, "Ä-|:1"), (10, "é", "", 2, None), (4, "a:1", "-", 1, "Q")]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit(1), "pos": F.lit(2), "grp": F.lit("q"), "n": F.lit(3)}).write.parquet(f"{tmp_path}/documents.parquet")
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    rows = []
    for d in docs:
        changed = (*d[:4], low(d[4])) if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 else d
        rows.append((d[0], d[1], h(*map(field, d)), h(*map(field, changed))))
    got = merkle.op13(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_manifest(rows)


def test_manifest_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

"""What the corpus queries return of each document by a fixed rule, against plain Python over whole tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from annolith.llm import queries, quality, tokens

D = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ask(spark):
    done = {}

    def run(name):
        if name not in done:
            done[name] = queries.queries()[name](spark, D).collect()
        return done[name]

    return run


@pytest.fixture(scope="module")
def ids(docs):
    t = tokens.Encoder(tokens.default_path()).tokenizer
    return {d: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for d, r in docs.items()}


def test_edited_texts(ask, docs):
    order = sorted(docs)
    got = {r.doc_id: r for r in ask("op3_fingerprints")}
    assert got.keys() == docs.keys()
    for k, d in enumerate(order):
        text, other = docs[d].text or "", docs[order[(k + 1) % len(order)]].text or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + other[:n]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    by_text = {}
    for d, r in docs.items():
        assert by_text.setdefault(r.text or "", got[d].fingerprint) == got[d].fingerprint


def test_targets_of_the_mix(ask, docs):
    size = {d: len(WORDS.findall(r.text or "")) for d, r in docs.items()}
    sources = sorted({r.source for r in docs.values()}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size[d] for d, r in docs.items() if r.source == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:
        rest = [s for s in sources if s not in full]
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * of[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s], left = 2 * of[s], left - 2 * of[s]
            full.add(s)
    taken = dict.fromkeys(sources, 0)
    for r in ask("op4_mixing"):
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == of[s] and r.target == pytest.approx(target[s], rel=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(ask("op4_mixing")) == len(docs)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 50 for s in sources)


def test_pieces(ask, ids):
    rows, room = {}, {}
    for r in ask("op5_packing"):
        rows.setdefault(r.doc_id, []).append(r)
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert rows.keys() == ids.keys()
    for d, pieces in rows.items():
        pieces.sort(key=lambda r: r.piece)
        cuts = [ids[d][k : k + 4096] for k in range(0, len(ids[d]), 4096)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [(k, 4096 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cuts)]
    for parts in room.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(room) <= -(-sum(map(len, ids.values())) // 4096) + 2


def test_files_of_ids(ask, ids):
    at = 0
    for r in sorted(ask("op6_token_ids"), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    assert len(ask("op6_token_ids")) == len(ids)


def test_held_out(ask, docs):
    rest = lambda d, n: zlib.crc32(str(d).encode()) % n
    for r in ask("op7_quality"):
        assert r.held_out == (rest(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    known = {r.lang for r in docs.values() if r.lang} | {"und"}
    right = []
    for r in ask("op10_language"):
        text = docs[r.doc_id].text or ""
        assert r.held_out == (rest(r.doc_id, 3) == 1) and r.lang_pred in known and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
        if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und":
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert len(ask("op7_quality")) == len(ask("op10_language")) == len(docs) and np.mean(right) > 0.95


def test_shards(ask, docs):
    per = {}
    for r in ask("op9_sharding"):
        text = (docs[r.doc_id].text or "").encode()
        assert r["size"] == len(text) + 16 and r.text_crc32 == zlib.crc32(text) and r.law == "rows" and r.grown_shard is None
        per.setdefault(r.shard, []).append(r.slot)
    assert len(ask("op9_sharding")) == len(docs) and set(per) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1


def test_sums_of_the_additive_model():
    """Scores by adding table entries one by one."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.FEATURES))).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y)
    got = model.score(x)
    assert got.shape == (400,) and ((got > 0) & (got < 1)).all() and ((got > 0.5) == (y > 0.5)).mean() > 0.8
    for r, p in zip(x[:50], got[:50], strict=True):
        z = model.base + sum(float(t[sum(c <= v for c in cuts)]) for t, cuts, v in zip(model.tables, model.cuts, r, strict=True))
        place = [sum(c <= v for c in cuts) for cuts, v in zip(model.pair_cuts, r, strict=True)]
        z += sum(float(t[place[i], place[j]]) for i, j, t in model.pairs)
        assert p == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)
    assert model.pairs

"""Language of texts by a linear-chain conditional random field over words.

A word's features are hashed: its first and last letters, its letter pairs and triples, and the
word itself (the lexicon). Their weights give each word a value per language; learned
transitions join neighbouring words. Forward-backward gives each word's probabilities, so a
text that switches languages gets a label per word. A text's language is the one with the
largest mean probability over its words with letters. All letters count: a word of more than
``LETTERS`` letters, such as a text without spaces, is a run of pieces, each a link of the chain.

Defined results
  null text, or no letter   ``und`` with score 0
  null lang                 is not learned from
  rows without an id, or with another of that id and language   are labelled; one row of an id and language is learned from, none without an id
  texts of more than ``SAMPLE_CHARS`` characters   are learned from by so many of them, from a place that a hash decides, and labelled whole
  null or repeated id       each row is labelled by itself; a null id isn't held out
  nothing to learn from     ``und`` with score 0 for all
  empty table               no rows
  more columns              are ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import quality, storage, tokens, words

#: Documents that the model is learned from, at most: of each language in turn, those whose hashed ids come first.
SAMPLE_DOCS = 600
#: Characters of a text that is learned from, at most.
SAMPLE_CHARS = 200_000
#: Hashed weights per language.
TABLE = 1 << 17
#: Letters of a link of the chain; a longer word is cut into several.
LETTERS = 24
#: Texts whose score is lower are rejected as of no known language.
LEAST = 0.5


def chain(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct links (letters of words, lower-case, without marks), the number of each link in order, and each text's bounds in it."""
    unique, codes, bounds = words.split(words.text_column(texts))
    bare = pc.replace_substring_regex(pc.utf8_lower(unique), r"[^\p{L}]+", "")
    length = pc.utf8_length(bare).to_numpy() if len(bare) else np.zeros(0, np.int64)
    links = bare.to_pylist()
    long = np.flatnonzero(length > LETTERS)
    if not len(long):
        return links, codes, bounds
    times, first = np.ones(len(links), np.int64), np.arange(len(links))
    for k in long.tolist():
        w = links[k]
        first[k] = len(links)
        links += [w[i : i + LETTERS] for i in range(0, len(w), LETTERS)]
        times[k], links[k] = len(links) - first[k], ""
    n = times[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    return links, np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1]), ends[bounds]


def _letters(links: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each link, padded with 0, and their number."""
    points = np.array(links, dtype=f"<U{LETTERS}").view(np.uint32).reshape(len(links), LETTERS)
    return points, (points != 0).sum(1)


def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    a = (a ^ np.uint64(salt * 0x9E3779B1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((a >> np.uint64(40)) ^ (a >> np.uint64(17))) % np.uint64(TABLE - 1) + np.uint64(1)


def word_features(links: list[str]) -> np.ndarray:
    """Numbers of each link's features; 0 for none."""
    points, n = _letters(links)
    if not len(n):
        return np.zeros((0, 1), np.int32)
    p = points.astype(np.uint64)
    mul = np.uint64(1_000_003)
    padded = np.concatenate([np.full((len(p), 1), 1, np.uint64), p, np.zeros((len(p), 2), np.uint64)], 1)
    padded[np.arange(len(p)), n + 1] = 2  # a mark at either end
    two = padded[:, :-1] * mul + padded[:, 1:]
    three = two[:, :-1] * mul + padded[:, 2:]
    here = np.where(n[:, None] > 0, np.arange(LETTERS + 2)[None, :], LETTERS + 9)  # a word without letters has no features
    out = [np.where(here[:, : two.shape[1]] <= n[:, None], _mix(two, 1), 0), np.where(here[:, : three.shape[1]] < n[:, None], _mix(three, 2), 0)]
    whole, ends = np.zeros(len(p), np.uint64), np.arange(len(p))
    with np.errstate(over="ignore"):
        for k in range(LETTERS):
            whole = np.where(k < n, whole * mul + p[:, k] + np.uint64(7), whole)
        front, back = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
        for k in range(4):
            front = front * mul + p[:, k]
            back = back * mul + np.where(n > k, p[ends, np.maximum(n - 1 - k, 0)], 0)
            out.append(np.where(n > k, _mix(front, 10 + k), 0)[:, None])
            out.append(np.where(n > k, _mix(back, 20 + k), 0)[:, None])
    out.append(np.where(n > 0, _mix(whole, 30), 0)[:, None])
    return np.concatenate(out, 1).astype(np.int32)


@dataclass
class Chain:
    """weights: TABLE x languages, row 0 zero; transitions: from x to, as logarithms."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, unique: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A value per link and language, and which links have letters."""
        out, lettered = np.zeros((len(unique), len(self.languages)), np.float32), np.zeros(len(unique), bool)
        for k in range(0, len(unique), 20_000):
            f = word_features(unique[k : k + 20_000])
            out[k : k + 20_000] = self.weights[f].sum(1)
            lettered[k : k + 20_000] = (f != 0).any(1)
        return out, lettered


def forward_backward(e: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probabilities per word and language. e: values of the words of all texts, one after the other."""
    a, _, after = _messages(e, bounds, trans)
    a *= after
    return a / a.sum(1, keepdims=True)


def _messages(e: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: what comes from the words up to it, its own value, and what comes from the words after it, each up to a factor.

    All texts advance together, longest first, so a step has only those that are as long.
    """
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    start, length = bounds[:-1][order], n[order]
    x = np.exp(e - e.max(1, keepdims=True)).astype(np.float64)
    t = np.exp(trans - trans.max())
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # texts longer than the step
    a = np.empty_like(x)
    last = None
    for s in range(steps):
        at = start[: active[s]] + s
        v = x[at] if last is None else (last[: active[s]] @ t) * x[at]
        last = v / v.sum(1, keepdims=True)
        a[at] = last
    beta, after = np.ones((len(length), x.shape[1])), np.ones_like(x)
    for s in range(steps - 2, -1, -1):
        k = active[s + 1]
        at = start[:k] + s + 1
        b = (x[at] * beta[:k]) @ t.T
        beta[:k] = b / b.sum(1, keepdims=True)
        after[at - 1] = beta[:k]
    return a, x, after


def expected(e: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities per word and language, and the expected number of steps from each language to each."""
    a, x, after = _messages(e, bounds, trans)
    inner = np.ones(len(e), bool)
    inner[bounds[:-1][bounds[:-1] < len(e)]] = False
    at = np.flatnonzero(inner)
    joint = a[at - 1][:, :, None] * np.exp(trans - trans.max())[None] * (x[at] * after[at])[:, None, :]
    both = a * after
    return both / both.sum(1, keepdims=True), (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def fit(texts: pa.Array, labels: list[str], epochs: int = 20, window: int = 48, rate: float = 0.5, seed: int = 5) -> Chain:
    """Maximum likelihood by adaptive gradient steps. Texts are cut into windows, and the tails of some
    windows are exchanged, so that the transitions see texts that switch."""
    languages = sorted(set(labels))
    if not languages:
        return Chain([], np.zeros((TABLE, 0), np.float32), np.zeros((0, 0)))
    L = len(languages)
    unique, codes, bounds = chain(texts)
    f = word_features(unique)
    gold = np.repeat([languages.index(x) for x in labels], np.diff(bounds))
    full = [np.arange(a, b) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) for a in range(lo, hi, window) for b in [min(hi, a + window)]]
    rng = np.random.default_rng(seed)
    rng.shuffle(full)
    for i in range(0, len(full) - 1, 4):  # one pair of windows in four exchanges tails
        u, v = full[i], full[i + 1]
        k = int(rng.integers(0, min(len(u), len(v)) + 1))
        full[i], full[i + 1] = np.concatenate([u[:k], v[k:]]), np.concatenate([v[:k], u[k:]])
    place = np.concatenate(full) if full else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in full])]).astype(np.int64)
    codes, gold = codes[place], gold[place]
    W, T = np.zeros((TABLE, L), np.float32), np.zeros((L, L))
    gw, gt = np.full((TABLE, L), 1e-8), np.full((L, L), 1e-8)
    inner = np.ones(len(codes), bool)
    inner[ends[:-1][ends[:-1] < len(codes)]] = False
    second = np.flatnonzero(inner)
    want_t = np.zeros((L, L))
    np.add.at(want_t, (gold[second - 1], gold[second]), 1)
    onehot = np.eye(L)[gold]
    for _ in range(epochs):
        e = W[f].sum(1)[codes]
        p, got = expected(e, ends, T)
        d = onehot - p
        by_word = np.stack([np.bincount(codes, d[:, k], len(f)) for k in range(L)], 1)
        grad = np.stack([np.bincount(f.ravel(), np.repeat(by_word[:, k], f.shape[1]), TABLE) for k in range(L)], 1) / max(1, len(full)) - 1e-6 * W
        grad[0] = 0
        gw += grad**2
        W += (rate * grad / np.sqrt(gw)).astype(np.float32)
        g = (want_t - got) / max(1, len(second))
        gt += g**2
        T += rate * g / np.sqrt(gt)
    return Chain(languages, W, T)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Chain:
    """Learn from documents with a language that aren't held out: ``sample_docs`` at most, as many of each language as there are.

    They are chosen by their hashed ids, so only the chosen ones' texts are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.where(F.col("lang").isNotNull() & F.coalesce(quality.remainder(F.col("doc_id"), 3) != 1, F.lit(False)))
    keyed = rows.withColumn("h", F.xxhash64("doc_id"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    few = keyed.where(F.col("text").isNotNull()).select("lang", "h", "doc_id").distinct().withColumn("nth", nth).where(F.col("nth") <= sample_docs)
    chosen = few.orderBy("nth", "lang").limit(sample_docs).select("lang", "h", "doc_id")
    # At most sample_docs rows of SAMPLE_CHARS characters each: a fixed bound.
    met = keyed.join(F.broadcast(chosen), ["lang", "h", "doc_id"]).where(F.col("text").isNotNull())
    start = F.when(F.length("text") > SAMPLE_CHARS, F.pmod("h", F.length("text") - SAMPLE_CHARS + 1).cast("int")).otherwise(0)
    part = F.substr("text", start + 1, F.lit(SAMPLE_CHARS))
    got = met.select("h", "doc_id", "lang", part.alias("text")).groupBy("h", "doc_id", "lang").agg(F.min("text").alias("text")).toPandas()
    got = got.sort_values(["h", "doc_id", "lang"])
    model = fit(pa.array(got["text"], pa.string(), from_pandas=True), list(got["lang"]))
    del got
    storage.give_back()
    return model


def label(texts: pa.Array, model: Chain) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    texts = words.text_column(texts)
    n = len(texts)
    if not model.languages:
        return ["und"] * n, np.zeros(n)
    unique, codes, bounds = chain(texts)
    e, lettered = model.emissions(unique)
    p = forward_backward(e[codes], bounds, model.transitions) if len(codes) else np.zeros((0, len(model.languages)))
    use = lettered[codes].astype(float)
    owner = words.owners(bounds)
    sums = np.stack([np.bincount(owner, p[:, k] * use, n) for k in range(len(model.languages))], 1)
    total = np.bincount(owner, use, n)
    best = sums.argmax(1)
    share = sums[np.arange(n), best] / np.maximum(total, 1)
    return [model.languages[b] if t else "und" for b, t in zip(best, total, strict=True)], np.where(total > 0, np.minimum(share, 1.0), 0.0)


def label_words(text: str, model: Chain) -> list[tuple[str, str, float]]:
    """Each word of a text, as its lower-case letters, with its language and probability; a long one in pieces."""
    unique, codes, bounds = chain(pa.array([text], pa.large_string()))
    if not len(codes) or not model.languages:
        return []
    p = forward_backward(model.emissions(unique)[0][codes], bounds, model.transitions)
    return [(unique[int(c)], model.languages[int(k)], float(q[k])) for c, q, k in zip(codes, p, p.argmax(1), strict=True)]


def predict(docs: DataFrame, model: Chain, columns: list[str], names: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
    """The given columns of ``docs`` (text is read), then language and score under ``names``."""
    return tokens.add_columns(docs, columns, names, ["string", "double"], model, _labelled)


def _labelled(texts: pa.Array, model: Chain) -> list[pa.Array]:
    lang, score = label(texts, model)
    return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(quality.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs), ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")

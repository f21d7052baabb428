"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features; each visit fits a
tree of three leaves over the bins of one feature and adds a small part of it to the feature's
table. Then pairs of features that explain most of what is left get a table of their own, by
trees that cut both features once. A score is the sum of the tables' entries at the text's bins.

Defined results
  null or empty text   is scored like any other text: its features are zero
  null or repeated id  each row is scored by itself; a null id isn't held out
  labels null          are not learned from; a document with two labels is learned from twice
  no labels            the score is 0.5
  empty table          no rows
  more columns         are ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, tokens, words

#: Labelled rows that the model is learned from, at most: those whose hashed ids come first.
SAMPLE_ROWS = 20_000
#: Texts whose score is at least this are of good quality.
THRESHOLD = 0.7

FEATURES = [
    "log_words", "word_length", "long_words", "short_words", "upper_words", "title_words", "no_letter", "symbol_words", "mark_words",
    "stop_marks", "distinct", "top_word", "repeats", "distinct_pairs", "log_lines", "words_a_line", "same_lines", "symbols", "digits", "upper",
]


def features(texts: pa.Array) -> np.ndarray:
    """A row of features per text, over the whole text."""
    texts = words.text_column(texts)
    n = len(texts)
    unique, codes, bounds = words.split(texts)
    count = np.diff(bounds)
    owner = words.owners(bounds)
    chars = np.maximum(pc.utf8_length(texts).to_numpy(), 1)
    hit = lambda pattern: pc.match_substring_regex(unique, pattern).to_numpy(zero_copy_only=False).astype(np.float32)
    length = pc.utf8_length(unique).to_numpy().astype(np.float32)
    mean = lambda of_unique: words.mean_by(owner, of_unique[codes], n, count)

    key = np.sort(owner * np.int64(max(1, len(unique))) + codes)
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    runs = np.diff(np.concatenate([first, [len(key)]]))
    run_owner = key[first] // max(1, len(unique)) if len(key) else np.zeros(0, np.int64)
    distinct = np.bincount(run_owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, run_owner, runs)
    follows = owner[1:] == owner[:-1]
    repeats = np.bincount(owner[1:], follows & (codes[1:] == codes[:-1]), n)
    pairs = (codes[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (codes[1:].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(28)
    pairs = np.unique((owner[1:].astype(np.uint64) << np.uint64(36) | pairs)[follows])
    distinct_pairs = np.bincount((pairs >> np.uint64(36)).astype(np.int64), minlength=n)

    lines = pc.split_pattern(texts, "\n")
    ends = lines.offsets.to_numpy()
    n_lines = np.diff(ends)
    line_code = lines.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(n), n_lines)
    line_key = np.unique(line_owner * np.int64(max(1, len(line_code))) + line_code)
    distinct_lines = np.bincount(line_key // max(1, len(line_code)), minlength=n)
    share = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy() / chars
    some = np.maximum(count, 1)
    columns = [
        np.log1p(count),
        mean(length),
        mean((length > 12).astype(np.float32)),
        mean((length < 4).astype(np.float32)),
        mean(hit(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]+$")),
        mean(hit(r"^\p{Lu}\p{Ll}")),
        mean(1 - hit(r"\p{L}")),
        mean(hit(r"[#$%&*|<>{}\\^~=_@+\[\]/]")),
        mean(hit(r"!!|\?\?")),
        mean(hit(r"[.,;:!?]$")),
        distinct / some,
        top / some,
        repeats / some,
        distinct_pairs / some,
        np.log1p(n_lines),
        np.log1p(count / np.maximum(n_lines, 1)),
        1 - distinct_lines / np.maximum(n_lines, 1),
        share(r"[^\p{L}\p{N}\s.,;:!?'\"()-]"),
        share(r"\p{N}"),
        share(r"\p{Lu}"),
    ]
    return np.stack(columns, 1).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


@dataclass
class Additive:
    """Tables by feature and by pair of features; the score's log odds are their sum."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        if self.pairs:
            b = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)]
            for i, j, table in self.pairs:
                z += table[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _steps(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """A tree of up to three leaves over bins in order: the cut that gains most, then one more."""
    gain = lambda a, b: a * a / (b + l2)

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        a, b = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        v = gain(a[:-1], b[:-1]) + gain(a[-1] - a[:-1], b[-1] - b[:-1]) - gain(a[-1], b[-1])
        k = int(np.argmax(v))
        return float(v[k]), lo + k + 1

    edges = [0, len(g)]
    for _ in range(2):
        found = max((best(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)), key=lambda t: t[0])
        if found[0] <= 1e-9:
            break
        edges = sorted([*edges, found[1]])
    out = np.empty(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The tree that cuts both features of a table of sums once, and its gain."""
    G = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    H = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = slice(1, -1), slice(1, -1)
    parts = []
    for S in (G, H):
        ll = S[a, b]
        lr = S[a, -1:] - ll
        rl = S[-1:, b] - ll
        parts.append((ll, lr, rl, S[-1, -1] - ll - lr - rl))
    total = sum(x * x / (y + l2) for x, y in zip(*parts, strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + l2)
    if not total.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    leaf = [x[i, j] / (y[i, j] + l2) for x, y in zip(*parts, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(total[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, l2: float = 2.0) -> Additive:
    if not len(y):
        return Additive(0.0, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    quantiles = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) for j in range(x.shape[1])]
    model = Additive(float(np.log(p / (1 - p))), quantiles(bins), [], quantiles(8))
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(y), model.base)
    prob = lambda: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            q = prob()
            step = rate * _steps(np.bincount(at[j], y - q, len(table)), np.bincount(at[j], q * (1 - q), len(table)), l2)
            table += step
            z += step[at[j]]
    low = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]
    width = [len(c) + 1 for c in model.pair_cuts]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        q = prob()
        k = low[i] * width[j] + low[j]
        return tuple(np.bincount(k, v, width[i] * width[j]).reshape(width[i], width[j]) for v in (y - q, q * (1 - q)))

    strength = sorted(((_quadrants(*sums(i, j), l2)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for gain, i, j in strength if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _quadrants(*sums(i, j), l2)[1]
            table += step
            z += step[low[i], low[j]]
    return model


def remainder(doc_id: Column, k: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def _features_of(df: DataFrame) -> DataFrame:
    """quality and the features of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.small_batches(batches, "text"):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), *[pa.array(c) for c in x.T]], names=["quality", *FEATURES])

    return df.select("quality", "text").mapInArrow(run, "quality int, " + ", ".join(f"{f} float" for f in FEATURES))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Additive:
    """Learn from labelled rows that aren't held out: ``sample_rows`` labels at most, by hashed id, and twice as many pairs of label and text."""
    known = labels.where(F.col("quality").isin(0, 1) & F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(False)))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    # At most sample_rows rows of two numbers: a fixed bound.
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # An id that very many rows have gives very many pairs; rows of numbers, of which so many are taken, by hash, so reruns take the same.
    rows = _features_of(met).orderBy(F.xxhash64("quality", *FEATURES), "quality", *FEATURES).limit(2 * sample_rows).toPandas()
    rows = rows.sort_values(["quality", *FEATURES])
    model = fit(rows[FEATURES].to_numpy(np.float32), rows["quality"].to_numpy(float))
    del rows
    storage.give_back()
    return model


def score(docs: DataFrame, model: Additive, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of ``docs`` (text is read) and the score under ``name``."""
    return tokens.add_columns(docs, columns, [name], ["double"], model, _scored)


def _scored(texts: pa.Array, model: Additive) -> list[pa.Array]:
    return [pa.array(model.score(features(texts)), pa.float64())]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

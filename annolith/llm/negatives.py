"""Hard negatives by bit-sliced integer products.

Components become integers, floor(256 * x). A candidate's components are read as bit-planes in two's complement, the sign
plane first: a product with an anchor is the weighted sum of the anchor's products with the planes. After each plane the
planes left can add no more than an interval that the anchor alone decides, so every score lies in an interval that halves with
each plane. A candidate goes no further once its interval can't reach the scores that are asked for; what goes through all planes has its exact
score. While many pairs are left, a plane is one matrix product for a tile of anchors; after that only pairs that are left are followed.

Anchors are numbered and dealt into chunks of bounded size, one broadcast each; the candidates are read where they lie and aren't shuffled,
and of each part only the best per anchor go on. Two passes: positives (the best of the anchor's label), then negatives (of other labels, in the
window that each positive's score sets).

Defined results
  null id, label or vector, null or non-finite components   the row takes no part
  vectors of unlike length   aren't compared
  repeated ids        each row is a candidate, and an anchor if it isn't equal to another; rows of the anchor's own id aren't its candidates
  empty vectors       score 0 with each other
  ties                go to the smaller id
  empty table         no rows
  more columns        are ignored, whatever their names
  scores that 53 bits can't hold raise an error
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

#: Components of the anchors of a chunk, at most (8 bytes each in the broadcast), unless one anchor alone has more.
CHUNK_COMPONENTS = 1 << 21
#: Anchors that one matrix product takes.
TILE = 128
#: Share of the pairs of a tile below which the pairs are followed one by one.
FEW = 1 / 16
#: Pairs that are followed at once.
PAIRS = 1 << 16
LOWEST = -(2**62)


def integers(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as whole numbers in doubles."""
    q = np.floor(x.astype(np.float64) * scale)
    if q.size and np.abs(q).max() ** 2 * max(1, q.shape[1]) >= 2**53:
        raise ValueError("components too large for exact scores")
    return q


@dataclass
class Planes:
    """The planes of whole numbers (n x d), most significant first, and their weights."""

    planes: list[np.ndarray]
    weights: list[int]

    @classmethod
    def of(cls, q: np.ndarray) -> Planes:
        whole = q.astype(np.int64)
        bits = int(max(whole.max(initial=0), -whole.min(initial=0) - 1)).bit_length()
        places = range(bits - 1, -1, -1)
        planes = [(whole < 0).astype(np.float32), *[((whole >> b) & 1).astype(np.float32) for b in places]]
        return cls(planes, [-(1 << bits), *[1 << b for b in places]])

    def open_after(self, i: int) -> int:
        """The largest number that the planes after the i-th can make."""
        return (1 << (len(self.planes) - 1 - i)) - 1


@dataclass
class Asked:
    """What anchors (m x d) look for: scores of at least ``least`` and at most ``most`` each, and which rows are theirs."""

    q: np.ndarray
    least: np.ndarray
    most: np.ndarray


def scores(asked: Asked, planes: Planes, open_pairs: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, exact score) of the open pairs (m x n) whose scores lie in the asked interval.

    With ``k`` > 0 only an anchor's k best are needed, and the k-th largest lower end of the intervals raises ``least``.
    """
    q = asked.q
    up, down = np.where(q > 0, q, 0).sum(1), np.where(q < 0, q, 0).sum(1)
    least = asked.least.astype(np.float64)
    sums = np.zeros(open_pairs.shape)
    # Sums of whole numbers below 2 ** 24 are exact in single precision.
    kind = np.float32 if np.abs(q).sum(1).max(initial=0) < 2**24 else np.float64
    narrow, n_planes = q.astype(kind), len(planes.planes)
    i = 0
    while i < n_planes and open_pairs.mean() > FEW:
        sums += planes.weights[i] * (narrow @ planes.planes[i].astype(kind, copy=False).T).astype(np.float64)
        rest = planes.open_after(i)
        if 0 < k <= open_pairs.shape[1] and i >= 2:
            low = np.where(open_pairs, sums, -np.inf)
            least = np.maximum(least, np.partition(low, -k, 1)[:, -k] + rest * down)
        open_pairs = open_pairs & (sums + (rest * up)[:, None] >= least[:, None]) & (sums + (rest * down)[:, None] <= asked.most[:, None])
        i += 1
    row, col = np.nonzero(open_pairs)
    for at in range(0, len(row), PAIRS):
        r, c = row[at : at + PAIRS], col[at : at + PAIRS]
        s = sums[r, c]
        for j in range(i, n_planes):
            s = s + planes.weights[j] * np.einsum("ij,ij->i", q[r], planes.planes[j][c])
            rest = planes.open_after(j)
            keep = (s + rest * up[r] >= least[r]) & (s + rest * down[r] <= asked.most[r])
            r, c, s = r[keep], c[keep], s[keep]
        yield r, c, s.astype(np.int64)


class Best:
    """The k best (score, then smaller id) of each of n lists, as candidates come in."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LOWEST, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in candidates of lists ``at``."""
        if not len(at):
            return
        lists = np.unique(at)
        a = np.concatenate([np.repeat(lists, self.k), at])
        s = np.concatenate([self.score[lists].ravel(), score])
        i = np.concatenate([self.id[lists].ravel(), ids])
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        first = np.searchsorted(a, lists)
        take = first[:, None] + np.arange(self.k)
        self.score[lists], self.id[lists] = s[take], i[take]

    @property
    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all that are filled."""
        at, j = np.nonzero(self.score > LOWEST)
        return at, self.score[at, j], self.id[at, j]


@dataclass
class Chunk:
    """Anchors of one length of vectors: number, id, label, integers."""

    no: np.ndarray
    id: np.ndarray
    label: np.ndarray
    q: np.ndarray
    #: Scores of the positives (m x k, best first, LOWEST if fewer); None while they are sought.
    positives: np.ndarray | None = None


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and integers of the rows of each length of vector."""
    vec = batch.column("vec")
    sizes = np.diff(vec.offsets.to_numpy())
    for d in np.unique(sizes):
        part = batch.filter(pa.array(sizes == d)) if len(np.unique(sizes)) > 1 else batch
        v = part.column("vec")
        flat = v.flatten().to_numpy(zero_copy_only=False)
        yield part.column("id").to_numpy(), part.column("label").to_numpy(), integers(flat.reshape(len(part), d))


def _positives(shared: Broadcast, k: int):
    """Per anchor, the best of its label in a part of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, Chunk] = shared.value
        best = {d: Best(len(c.no), k) for d, c in chunks.items()}
        for batch in batches:
            for ids, labels, q in _by_length(batch):
                if (c := chunks.get(q.shape[1])) is None:
                    continue
                for label in np.intersect1d(labels, c.label):
                    mine, rows = np.flatnonzero(c.label == label), np.flatnonzero(labels == label)
                    planes = Planes.of(q[rows])
                    for at in range(0, len(mine), TILE):
                        m = mine[at : at + TILE]
                        asked = Asked(c.q[m], best[q.shape[1]].worst[m], np.full(len(m), np.inf))
                        for r, s, score in scores(asked, planes, c.id[m][:, None] != ids[rows][None, :], k):
                            best[q.shape[1]].add(m[r], score, ids[rows][s])
        for d, b in best.items():
            at, score, ids = b.rows()
            yield pa.RecordBatch.from_arrays([pa.array(chunks[d].no[at]), pa.array(np.zeros(len(at), np.int32)), pa.array(score), pa.array(ids)], ["no", "place", "score", "id"])

    return run


def _negatives(shared: Broadcast, k: int, share: tuple[int, int]):
    """Per anchor and positive, the best of other labels whose scores lie in the positive's window."""
    a, b = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, Chunk] = shared.value
        best = {d: Best(c.positives.size, k) for d, c in chunks.items()}
        for batch in batches:
            for ids, labels, q in _by_length(batch):
                d = q.shape[1]
                if (c := chunks.get(d)) is None:
                    continue
                planes, width = Planes.of(q), c.positives.shape[1]
                for at in range(0, len(c.no), TILE):
                    m = np.arange(at, min(at + TILE, len(c.no)))
                    most = c.positives[m]
                    there = most > LOWEST
                    # ceil(a / b of the positive's score), or what the list's worst has, if that is more.
                    worst = best[d].worst.reshape(-1, width)[m]
                    least = np.where(there, np.maximum(-(-a * np.where(there, most, 0) // b), worst), 2**62)
                    asked = Asked(c.q[m], least.min(1), np.where(there, most, LOWEST).max(1))
                    open_pairs = (c.label[m][:, None] != labels[None, :]) & (c.id[m][:, None] != ids[None, :]) & (asked.most >= asked.least)[:, None]
                    for r, s, score in scores(asked, planes, open_pairs, 0):
                        for w in range(width):
                            fits = (score >= least[r, w]) & (score <= most[r, w])
                            best[d].add(m[r[fits]] * width + w, score[fits], ids[s[fits]])
        for d, x in best.items():
            at, score, ids = x.rows()
            width = chunks[d].positives.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(chunks[d].no[at // width]), pa.array((at % width).astype(np.int32)), pa.array(score), pa.array(ids)], ["no", "place", "score", "id"])

    return run


_FOUND = "no long, place int, score long, id long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each list over all parts, with their rank from 1."""
    w = Window.partitionBy("no", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def usable(df: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """id, label and vec of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id, label, vec, as :func:`usable` gives them. Anchors: ids divisible by ``every``. A negative's score is at most its
    positive's and at least ``share`` (as a fraction) of it.
    """
    spark = rows.sparkSession
    anchors = rows.where(F.col("id") % every == 0).groupBy("id", "label", "vec").agg(F.lit(1).alias("_one")).drop("_one")
    n = storage.partitions(spark)
    anchors = storage.materialize(anchors.repartitionByRange(n, F.size("vec"), "id", "label").withColumns({"_part": F.spark_partition_id(), "_size": F.size("vec")}), "negatives-anchors")
    # Parts are numbered one after the other: chunks are ranges of numbers, and their anchors have one length, mostly.
    sums = anchors.groupBy("_part").agg(F.count("*").alias("_n"))
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_size", "id", "label", "vec")) - 1
    numbered = anchors.withColumn("_nth", nth).join(sums, "_part").select((F.col("_before") + F.col("_nth")).cast("long").alias("no"), "id", "label", "vec")
    numbered = storage.materialize(numbered, "negatives-numbered")
    total, widest = numbered.agg(F.count("*"), F.max(F.size("vec"))).first()
    per_chunk = max(1, CHUNK_COMPONENTS // max(1, widest or 1))

    near, far = [], []
    for first in range(0, total, per_chunk):
        here = F.col("no").between(first, first + per_chunk - 1)
        chunks = _collected(numbered.where(here))  # per_chunk anchors at most
        found = rows.mapInArrow(_positives(spark.sparkContext.broadcast(chunks), positives), _FOUND)
        near.append(storage.materialize(_ranked(found, positives), "negatives-positives"))
        place = {d: {int(no): i for i, no in enumerate(c.no)} for d, c in chunks.items()}
        for c in chunks.values():
            c.positives = np.full((len(c.no), positives), LOWEST, np.int64)
        for r in near[-1].collect():  # per_chunk times positives rows at most
            for d, at in place.items():
                if r["no"] in at:
                    chunks[d].positives[at[r["no"]], r["rank"] - 1] = r["score"]
        found = rows.mapInArrow(_negatives(spark.sparkContext.broadcast(chunks), negatives, share), _FOUND)
        far.append(storage.materialize(_ranked(found, negatives), "negatives-negatives"))
    if not near:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    positive = _union(near).select("no", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    negative = _union(far).select("no", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = numbered.select("no", F.col("id").alias("anchor_id"))
    out = negative.join(positive, ["no", "place"]).join(named, "no")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _collected(anchors: DataFrame) -> dict[int, Chunk]:
    """The anchors of a chunk by the length of their vectors."""
    table = anchors.toArrow().combine_chunks()
    out: dict[int, list] = {}
    for batch in table.to_batches():
        no = batch.column("no").to_numpy()
        vec = batch.column("vec")
        sizes = np.diff(vec.offsets.to_numpy())
        for d in np.unique(sizes):
            take = sizes == d
            part = batch.filter(pa.array(take))
            q = integers(part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(part), d))
            out.setdefault(int(d), []).append((no[take], part.column("id").to_numpy(), part.column("label").to_numpy(), q))
    return {d: Chunk(*[np.concatenate(x) for x in zip(*parts, strict=True)]) for d, parts in out.items()}


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(vectors, "vec_id", "embedding", label))

"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: rotations that are learned on a bounded sample turn the data so
that signs lose little (iterative quantisation). A code is split into substrings of 16 bits,
each indexed. If a code lies within the radius of a query's, some substring lies within a share
of the radius (pigeonhole), so probing the buckets around the query's substrings finds every
code within the radius. Those are ranked by exact cosine in double precision.

The radius is learned, too: on the sample it takes in nearly all true neighbours, which are
farther off in a sample than in the whole table. Queries that find fewer than k within it
are asked again with a larger one, step by step, until it takes in whole codes.

Equal vectors are one entry of the index with its smallest ids, so many copies of a vector
cost no more than one, and no result depends on how many there are, or on how the index is cut.

Defined results
  null, zero or non-finite vectors, null ids   take no part, as query or candidate
  repeated ids        each row is a candidate; a query doesn't find rows of its own id
  vectors of another length than the sample's most frequent take no part
  ties                go to the smaller id
  empty table         no rows
  more columns        are ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

#: Vectors that rotations and radius are learned from, at most: those whose hashed ids come first.
SAMPLE = 6_000
#: Share of the sample's true neighbours within the radius.
RECALL = 0.985
#: Bits of a substring.
SUBSTRING = 16
#: Vectors in a block of the index, and queries in a chunk.
BLOCK, CHUNK = 16_384, 4_096


@dataclass
class Codes:
    """mean and rotations (dimension x bits) give codes; radius in bits."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rows of substrings."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.rotation > 0, axis=1).view(np.uint16)

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of one code to many."""
    return np.bitwise_count(b ^ a).sum(1, dtype=np.int32)


def learn(x: np.ndarray, rotations: int = 2, steps: int = 30, k: int = 5, seed: int = 3) -> Codes:
    """Rotations by iterative quantisation, and the radius, from a sample."""
    rng = np.random.default_rng(seed)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    v = centred @ axes
    parts = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        parts.append(axes @ r)
    codes = Codes(mean, np.concatenate(parts, 1), 0)
    if (bits := codes.bits) % SUBSTRING:
        codes.rotation = codes.rotation[:, : bits - bits % SUBSTRING] if bits >= SUBSTRING else np.tile(codes.rotation, SUBSTRING)[:, :SUBSTRING]
    c = codes.encode(x)
    tried = rng.permutation(len(x))[:400]
    sims = unit[tried] @ unit.T
    sims[np.arange(len(tried)), tried] = -2
    far = []
    for row, q in zip(sims, tried, strict=True):
        near = np.argsort(-row)[:k]
        far.append(distances(c[q], c[near[row[near] > -2]]))
    far = np.concatenate(far) if far else np.zeros(0)
    codes.radius = int(np.quantile(far, RECALL)) if len(far) else codes.bits
    return codes


#: All values of a substring, by their number of bits, and how many have at most so many.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16)), kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16)), minlength=SUBSTRING + 1))


class Block:
    """A part of the index: for each substring, its codes sorted by value, and where each value's bucket begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        m = codes.shape[1]
        self.order = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(m)]
        self.start = [np.searchsorted(codes[o, j], np.arange((1 << SUBSTRING) + 1)).astype(np.int32) for j, o in enumerate(self.order)]
        self.values = [np.unique(codes[:, j]) for j in range(m)]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Which codes lie in the buckets that a radius asks for.

        With m substrings and radius = m * a + b: one of the first b + 1 substrings is within a, or
        one of the others within a - 1.
        """
        m = self.codes.shape[1]
        a, b = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            most = min(a if j <= b else a - 1, SUBSTRING)
            if most < 0:
                continue
            # The buckets around the value, or of those that aren't empty the ones around it: the smaller list is gone through.
            near, have = int(_WITHIN[most]), self.values[j]
            v = (_MASKS[:near] ^ code[j]).astype(np.int64) if near < len(have) else have[np.bitwise_count(have ^ code[j]) <= most].astype(np.int64)
            lo = self.start[j][v]
            n = self.start[j][v + 1] - lo
            hit[self.order[j][np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = True
        return hit

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within the radius."""
        at = np.flatnonzero(self.probed(code, radius))
        return at[distances(code, self.codes[at]) <= radius]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = column.offsets.to_numpy()
    n = len(column)
    return flat[at[0] : at[-1]].reshape(n, -1) if n else np.zeros((0, 1))


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec and a hash of vec, of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.coalesce(usable, F.lit(False)))
    return rows.withColumn("key", F.xxhash64("vec"))


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    rows = usable_vectors(df, id_col, vec_col)
    # The smallest ids of each distinct vector: Spark limits them before the shuffle, so copies stay at home.
    w = Window.partitionBy("key", "vec").orderBy("id")
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    entries = storage.materialize(few.groupBy("key", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-entries")
    asked = rows.where(F.col("id") % every == 0).select("id", "key", "vec")
    asked = storage.materialize(asked, "ann-asked")
    queries = storage.materialize(asked.groupBy("key", "vec").agg(F.min("id").alias("qid")), "ann-queries")

    sample = entries.select("vec", F.col("ids")[0].alias("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()  # SAMPLE rows at most
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = sample["vec"].map(len)
    width = int(dims.mode().iloc[0])
    model = learn(np.stack(sample.loc[dims == width, "vec"].tolist()).astype(float), k=k)
    shared = spark.sparkContext.broadcast(model)

    same = F.size("vec") == width
    entries, queries = entries.where(same), queries.where(same)
    near, radius, open_ = None, model.radius, queries
    while True:
        got = storage.materialize(_nearest(entries, open_, shared, radius, k), "ann-near")
        near = got if near is None else near.unionByName(got)
        if radius >= model.bits:
            break
        # A query finds itself, so with more than k it has k others.
        enough = got.groupBy("qid").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > k)
        open_ = storage.materialize(open_.join(enough, "qid", "left_anti"), "ann-open")
        if not open_.limit(1).count():
            break
        radius = min(model.bits, radius + max(1, model.bits // 8))
    near = near.groupBy("qid", "score", "ids").agg(F.lit(1).alias("_one")).drop("_one")  # what two rounds found
    lists = near.groupBy("qid").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    lists = queries.join(lists, "qid").select("key", "vec", "near")
    found = asked.join(storage.materialize(lists, "ann-lists"), ["key", "vec"])
    pairs = F.flatten(F.transform("near", lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("minus"), i.alias("vec_id")))))
    best = F.slice(F.array_sort(F.filter(pairs, lambda p: p["vec_id"] != F.col("id"))), 1, k)
    out = found.select(F.col("id").alias("query_id"), F.posexplode(best).alias("pos", "p"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("p.vec_id").alias("vec_id"), (-F.col("p.minus")).alias("score"))


def _nearest(entries: DataFrame, queries: DataFrame, shared: Broadcast, radius: int, k: int) -> DataFrame:
    """qid, score and ids of the k + 1 nearest entries within the radius, block by block of the index and chunk by chunk of the queries."""
    blocks, chunks = max(1, -(-entries.count() // BLOCK)), max(1, -(-queries.count() // CHUNK))
    index = entries.select(F.pmod("key", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(None).cast("long").alias("qid"), "vec", "ids")
    probes = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod("key", F.lit(chunks)).cast("int").alias("chunk"), "qid", "vec", F.lit(None).cast("array<bigint>").alias("ids"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        model = shared.value
        asks = np.asarray(table["qid"].is_valid())
        both = table.combine_chunks()
        x = _matrix(both["vec"].combine_chunks() if isinstance(both["vec"], pa.ChunkedArray) else both["vec"])
        q, v = x[asks], x[~asks]
        qid = both["qid"].to_numpy(zero_copy_only=False)[asks].astype(np.int64)
        ids = both.filter(pa.array(~asks))["ids"].to_pylist()
        out: list[tuple[int, float, list[int]]] = []
        if len(q) and len(v):
            first = np.array([i[0] for i in ids])
            block, codes = Block(model.encode(v)), model.encode(q)
            # Row by row, so a score doesn't depend on the row's place.
            norm = np.sqrt((v * v).sum(1))
            for a, code, vec in zip(qid, codes, q, strict=True):
                at = block.within(code, radius)
                score = (v[at] * vec).sum(1) / (norm[at] * np.sqrt((vec * vec).sum()))
                best = np.lexsort((first[at], -score))[: k + 1]
                out += [(int(a), float(score[b]), ids[at[b]]) for b in best]
        return pa.table({"qid": pa.array([o[0] for o in out], pa.int64()), "score": pa.array([o[1] for o in out], pa.float64()), "ids": pa.array([o[2] for o in out], pa.list_(pa.int64()))})

    near = index.unionByName(probes).groupBy("block", "chunk").applyInArrow(run, "qid long, score double, ids array<long>")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0])
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).drop("_r")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

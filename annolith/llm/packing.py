"""Pack documents into as few sequences as possible: linear grouping, then best fit.

Only a count per length decides how sequences are made up, and there are at most as many
lengths as a sequence has tokens, so the plan has a fixed bound whatever the corpus.

1. Pieces longer than ``large`` are sorted and cut into groups of equal count; within a group
   every length counts as the group's largest (linear grouping).
2. The few sizes that remain make configurations of a sequence; a linear programme over
   them is solved by column generation and its solution is rounded down.
3. Actual pieces take the places of their group, longest first, which leaves more room.
4. Small pieces, and the few that rounding down left, go into the fullest sequence that has room, longest first (best fit).

The plan says, for the r-th piece of a length, its sequence and offset. The rank r is found
with running sums, so no length needs one task.

Defined results
  null or empty text   one piece: the end id
  null or repeated id  each row is a document of its own
  empty table          no rows
  more columns         are ignored
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefix, storage, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of at most ``size`` tokens. ``docs``: doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in tokens.small_batches(batches, "text"):
            ids, bounds = tokens.with_end(*enc.encode(batch.column("text")), end_id)
            n = np.diff(bounds)
            pieces = -(-n // size)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(size, n[doc] - start)
            at = bounds[doc] + start
            crc = [tokens.crc32(ids[a : a + k]) for a, k in zip(at, length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return rows.mapInArrow(run, PIECES)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[tuple[int, ...], float]]:
    """Gilmore and Gomory's column generation: configurations (count per size) and how often each is used.

    It ends when no configuration is worth more than a sequence; after ``rounds`` exchanges, a guard against cycles, with what it has, which
    holds all pieces as well and may only need more sequences.
    """
    k = len(sizes)
    columns = [tuple(int(capacity // s) if i == j else 0 for j in range(k)) for i, s in enumerate(sizes)]
    basis = np.diag([float(c[i]) for i, c in enumerate(columns)])
    in_basis, x = list(columns), demand / np.diag(basis)
    inverse = np.linalg.inv(basis)
    most = int(capacity // sizes.min())
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        # Best value of at most j items by room used; sizes are large, so j is small.
        best = np.zeros(capacity + 1)
        picks: list[np.ndarray] = []
        for _ in range(most):
            new, pick = best.copy(), np.full(capacity + 1, -1, np.int16)
            for i, s in enumerate(sizes):
                value = best[: capacity + 1 - s] + price[i]
                better = value > new[s:] + 1e-12
                new[s:][better] = value[better]
                pick[s:][better] = i
            picks.append(pick)
            best = new
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = x - step * direction
        x[out] = step
        in_basis[out] = tuple(int(c) for c in column)
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
    return [(c, max(0.0, float(v))) for c, v in zip(in_basis, x, strict=True) if v > 1e-9]


@dataclass
class Plan:
    """Arrays sorted by (length, first): pieces of ``length`` with rank from ``first`` on go to
    sequences from ``sequence`` on, one each, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


class _Supply:
    """Pieces of a group by length, longest first."""

    def __init__(self, counts: list[tuple[int, int]]):
        self.left = [[n, c] for n, c in counts if c]
        self.at = 0

    def __bool__(self) -> bool:
        return self.at < len(self.left)

    def take(self, most: int) -> tuple[int, int]:
        n, c = self.left[self.at]
        got = min(c, most)
        self.left[self.at][1] -= got
        if not self.left[self.at][1]:
            self.at += 1
        return n, got

    @property
    def head(self) -> list[int]:
        return self.left[self.at]


def make_plan(counts: dict[int, int], capacity: int, large: int | None = None, groups: int = 20) -> Plan:
    """counts: pieces per length, all from 1 to ``capacity``."""
    large = capacity // 8 if large is None else large
    taken: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int]] = []
    opened = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs (first sequence, how many)

    def put(lengths: list[int], often: int) -> None:
        nonlocal opened
        used = 0
        for n in lengths:
            rows.append((n, taken[n], opened, used))
            taken[n] += often
            used += n
        gaps[capacity - used].append((opened, often))
        opened += often

    rest = defaultdict(int, {n: c for n, c in counts.items() if n <= large})
    for n in [n for n in counts if n == capacity]:
        put([n], counts[n])
    big = sorted(((n, c) for n, c in counts.items() if large < n < capacity and c), reverse=True)
    if big:
        total = sum(c for _, c in big)
        per = -(-total // groups)
        supplies: list[list[tuple[int, int]]] = [[]]
        room = per
        for n, c in big:
            while c:
                got = min(c, room)
                supplies[-1].append((n, got))
                c, room = c - got, room - got
                if not room:
                    supplies.append([])
                    room = per
        supplies = [s for s in supplies if s]
        # Groups that round up to the same size are one.
        merged: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s in supplies:
            merged[s[0][0]] += s
        sizes = np.array(sorted(merged, reverse=True))
        demand = np.array([sum(c for _, c in merged[s]) for s in sizes], float)
        supply = [_Supply(merged[s]) for s in sizes]
        left = demand.astype(np.int64)

        def fill(config: tuple[int, ...], often: int) -> None:
            """Actual pieces in a configuration: runs in which every place has one length."""
            while often:
                places: list[int] = []
                run = often
                for i, k in enumerate(config):
                    if k:
                        # All k places from one length if it lasts, else place by place.
                        n, c = supply[i].head
                        if c >= k:
                            run = min(run, c // k)
                        else:
                            run = 1
                for i, k in enumerate(config):
                    need = k * run
                    while need:
                        n, got = supply[i].take(need)
                        if run > 1:
                            places += [n] * (got // run)
                        else:
                            places += [n] * got
                        need -= got
                put(places, run)
                often -= run

        for config, often in configurations(sizes, demand, capacity):
            k = int(often + 1e-9)
            for i, c in enumerate(config):
                if c:
                    k = min(k, int(left[i] // c))
            if k:
                fill(config, k)
                left -= np.array(config) * k
        # What rounding down left joins the small pieces: at most a few for each size.
        for s in supply:
            while s:
                n, got = s.take(s.head[1])
                rest[n] += got

    open_rooms = sorted(r for r in gaps if r > 0 and gaps[r])
    for n in sorted(rest, reverse=True):
        need = rest[n]
        while need:
            at = bisect.bisect_left(open_rooms, n)
            if at == len(open_rooms):
                often = -(-need // (capacity // n))
                gaps[capacity].append((opened, often))
                opened += often
                bisect.insort(open_rooms, capacity)
                continue
            room = open_rooms[at]
            first, often = gaps[room].pop()
            if not gaps[room]:
                open_rooms.pop(at)
            got = min(need, often)
            rows.append((n, taken[n], first, capacity - room))
            taken[n] += got
            need -= got
            for r, a, c in ((room - n, first, got), (room, first + got, often - got)):
                if c and r:
                    if not gaps[r]:
                        bisect.insort(open_rooms, r)
                    gaps[r].append((a, c))
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], opened)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset. ``pieces``: a written table with doc_id, piece, start and length."""
    spark = pieces.sparkSession
    n = 8 * storage.partitions(spark)
    # At most ``capacity`` rows come to the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(counts, capacity)
    ranked = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)))
    ranked = prefix.running(ranked, ["length"], ["_chunk"], ["doc_id", "piece", "ids_crc32"], {"rank": F.lit(1).cast("long")}).drop("_chunk")
    shared = spark.sparkContext.broadcast((plan.length, plan.first, plan.sequence, plan.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = shared.value
        # One number per (length, rank): lengths are below 2 ** 21.
        key = (length << 42) | first
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            at = np.searchsorted(key, (n << 42) | rank, "right") - 1
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence[at] + rank - first[at])).append_column("offset", pa.array(offset[at]))
            yield from t.to_batches()

    names = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long"
    return ranked.select(*[f.name for f in names], "rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 4096, end_id: int = 1) -> DataFrame:
    pieces = storage.materialize(cut(docs, path or tokens.default_path(), size, end_id), "pack-pieces")
    return pack(pieces, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

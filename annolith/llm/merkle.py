"""A manifest of a data set: one root digest that proves every row.

Each row is a leaf, the SHA-256 of its columns. Within a group (a source) leaves stand in order and every ``FANOUT``
neighbours become their digest, level by level, until one is left; the groups' digests likewise give the root.

Leaves are dealt into aligned blocks of ``BLOCK`` = 16 ** 3 neighbours, whatever group they are of, so a group of any size is many
blocks. A block is a contiguous matrix of 64-byte hex digests: reshaped by the fanout, its rows are hashed level by level.
What a block becomes is a leaf of the next stage, which has 4096 times fewer rows. Proofs go down the same way: a block
gets the path above it once, and finds every sibling inside by index arithmetic.

Defined results
  null in a column    has a digest of its own ("-")
  null group          a group of its own, first in order
  null id             stands before all others of its group
  repeated ids        stand in the order of their leaves; equal rows may take each other's place
  empty text          has the digest of its length, 0
  empty table         no rows
  more columns        aren't part of a leaf, whatever their names
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

FANOUT = 16
#: Levels of a block, and leaves of a whole one.
LEVELS = 3
BLOCK = FANOUT**LEVELS
DIGEST = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf(*values: Column) -> Column:
    """Digest of a row: each value's UTF-8 byte count, a colon and the value, or ``-`` for null."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def depth(n: int) -> int:
    """Levels until one of n nodes is left."""
    d = 0
    while n > 1:
        n, d = -(-n // FANOUT), d + 1
    return d


def _digest(data: bytes | memoryview) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def raised(nodes: np.ndarray, levels: int) -> list[np.ndarray]:
    """The matrices of ``levels`` levels above a block's nodes (n x 64 bytes), the nodes first."""
    out = [nodes]
    for _ in range(levels):
        nodes = out[-1]
        whole = len(nodes) // FANOUT
        rows = nodes[: whole * FANOUT].reshape(whole, FANOUT * DIGEST)
        up = [_digest(r.data) for r in rows]
        if len(nodes) % FANOUT:
            up.append(_digest(nodes[whole * FANOUT :].tobytes()))
        out.append(np.frombuffer(b"".join(up), np.uint8).reshape(-1, DIGEST))
    return out


def siblings(level: np.ndarray, at: int) -> tuple[bytes, bytes]:
    """The digests left and right of a node in its run."""
    first = at - at % FANOUT
    run = level[first : first + FANOUT].tobytes()
    cut = (at - first) * DIGEST
    return run[:cut], run[cut + DIGEST :]


def fold(node: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The digest that a node and the siblings of its path give."""
    for left, right in path:
        node = _digest(left + node + right)
    return node


def _levels_here(n: int, stage: int) -> int:
    """Levels that a group of n leaves has in a stage."""
    return max(0, min(LEVELS, depth(n) - LEVELS * stage))


def _matrix(table: pa.Table, name: str = "digest") -> np.ndarray:
    return np.frombuffer("".join(table[name].to_pylist()).encode(), np.uint8).reshape(-1, DIGEST)


def positions(rows: DataFrame, group: str, order: Sequence[str], tag: str) -> DataFrame:
    """Add each row's place in its group (``pos``, from 0) and the group's size (``n``). Equal rows may take each other's place."""
    spark = rows.sparkSession
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(storage.partitions(spark), group, *order, "_salt").withColumn("_chunk", F.spark_partition_id())
    dealt = storage.materialize(dealt.drop("_salt"), tag)
    sums = dealt.groupBy(group, "_chunk").agg(F.count("*").alias("_c"))
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(group, "_chunk", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(of_group).alias("n"))
    nth = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(*order)) - 1
    placed = dealt.withColumn("_nth", nth).join(bases, [group, "_chunk"])
    return placed.withColumn("pos", (F.col("_before") + F.col("_nth")).cast("long")).drop("_chunk", "_before", "_nth")


def _rise(nodes: DataFrame, stage: int) -> DataFrame:
    """What the blocks of a stage become: the nodes of the next."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table["n"][0].as_py()
        top = raised(_matrix(table), _levels_here(n, stage))[-1]
        return pa.table({"grp": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "digest": [top[0].tobytes().decode()], "n": pa.array([n], pa.int64())})

    return nodes.select("grp", "pos", "digest", "n", F.expr(f"pos div {BLOCK}").alias("block")).groupBy("grp", "block").applyInArrow(run, "grp string, pos long, digest string, n long")


class Tree:
    """The stages of one table of leaves (grp, pos, n, digest, more): ``stages[-1]`` has one row per group."""

    def __init__(self, leaves: DataFrame, tag: str):
        self.tag, self.stages = tag, [leaves]
        largest = leaves.agg(F.max("n")).first()[0] or 0
        for s in range(-(-depth(largest) // LEVELS)):
            self.stages.append(storage.materialize(_rise(self.stages[-1], s), f"{tag}-nodes"))

    @property
    def tops(self) -> DataFrame:
        """grp and digest of each group."""
        return self.stages[-1].select("grp", "digest")

    def paths_to_leaves(self, above: DataFrame) -> DataFrame:
        """Per block of leaves (grp, pos), the path above it; ``above``: grp, left, right, subroot, root of each group."""
        paths = above.withColumn("pos", F.lit(0).cast("long"))
        for s in range(len(self.stages) - 2, 0, -1):
            paths = storage.materialize(_descend(self.stages[s], s, paths), f"{self.tag}-paths")
        return paths


_PATH = "grp string, pos long, left array<binary>, right array<binary>, subroot string, root string"


def _path_of(up: pa.Table) -> list[tuple[bytes, bytes]]:
    return list(zip(up["left"][0].as_py(), up["right"][0].as_py(), strict=True))


def _with_paths(nodes: DataFrame, paths: DataFrame):
    """The nodes of a block together with the path above it."""
    return nodes.withColumn("_block", F.expr(f"pos div {BLOCK}")).groupBy("grp", "_block").cogroup(paths.groupBy("grp", "pos"))


def _descend(nodes: DataFrame, stage: int, paths: DataFrame) -> DataFrame:
    """The path of each node of a stage, from that of its block."""

    def run(table: pa.Table, up: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        levels = raised(_matrix(table), _levels_here(table["n"][0].as_py(), stage))
        above = _path_of(up)
        # An outer group of one level has nothing inside its block to add.
        mine = [[siblings(m, i // FANOUT**k) for k, m in enumerate(levels[:-1])] + above for i in range(len(table))]
        side = lambda which: pa.array([[p[which] for p in path] for path in mine], pa.list_(pa.binary()))
        const = lambda c: pa.array([up[c][0].as_py()] * len(table), pa.string())
        return pa.table({"grp": table["grp"], "pos": table["pos"], "left": side(0), "right": side(1), "subroot": const("subroot"), "root": const("root")})

    return _with_paths(nodes.select("grp", "pos", "digest", "n"), paths).applyInArrow(run, _PATH)


_PROVED = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """Per leaf: digest of its siblings, and the root that its given leaf (``now``) and they give."""

    def run(table: pa.Table, up: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        levels = raised(_matrix(table), _levels_here(table["n"][0].as_py(), 0))
        above, root = _path_of(up), up["root"][0].as_py()
        # From the run upwards, neighbours share their path.
        shared = [[siblings(m, r // FANOUT ** (k - 1)) for k, m in enumerate(levels[:-1]) if k] + above for r in range(-(-len(table) // FANOUT))]
        rest = [b"".join(a + b for a, b in path) for path in shared]
        proof, folded = [], []
        for i, now in enumerate(table["now"].to_pylist()):
            run_ = i // FANOUT
            if len(levels) > 1:
                left, right = siblings(levels[0], i)
                proof.append(hashlib.sha256(left + right + rest[run_]).hexdigest())
                folded.append(fold(now.encode(), [(left, right), *shared[run_]]).decode())
            else:
                proof.append(hashlib.sha256(rest[run_]).hexdigest())
                folded.append(fold(now.encode(), shared[run_]).decode())
        const = lambda c: pa.array([up[c][0].as_py()] * len(table), pa.string())
        return pa.table({"id": table["id"], "leaf": table["digest"], "subroot": const("subroot"), "root": const("root"), "proof_sha256": proof, "folded_root": folded, "verified": pa.array([f == root for f in folded], pa.bool_())})

    return _with_paths(leaves.select("grp", "pos", "digest", "n", "id", "now"), paths).applyInArrow(run, f"id {leaves.schema['id'].dataType.simpleString()}, {_PROVED}")


def manifest(rows: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree over ``rows`` (grp, id, digest, more) and, per group, grp, left, right, subroot and root.

    Groups and ids are in ascending order, nulls first; groups are compared by their UTF-8 bytes.
    """
    # A name that is never null and keeps the order.
    named = rows.withColumn("grp", F.coalesce(F.concat(F.lit("+"), F.col("grp")), F.lit("")))
    # Dealing into ranges reads its input twice: digests are written first, so texts are read and hashed once.
    named = storage.materialize(named, "merkle-digests")
    tree = Tree(positions(named, "grp", ["id", "digest"], "merkle-leaves"), "merkle")
    tops = positions(tree.tops.select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest"), "all", ["name"], "merkle-tops")
    over = Tree(tops.withColumnRenamed("all", "grp"), "merkle-top")
    nothing = F.expr("CAST(array() AS array<binary>)")
    root = over.tops.select("grp", nothing.alias("left"), nothing.alias("right"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    if len(over.stages) > 1:
        paths = storage.materialize(_descend(over.stages[0], 0, over.paths_to_leaves(root)), "merkle-top-paths")
    else:
        paths = root.withColumn("pos", F.lit(0).cast("long"))
    above = over.stages[0].select("pos", F.col("name").alias("grp"), F.col("digest").alias("subroot")).join(paths.select("pos", "left", "right", "root"), "pos").drop("pos")
    return tree, storage.materialize(above.select("grp", "left", "right", "subroot", "root"), "merkle-groups")


def verify(rows: DataFrame) -> DataFrame:
    """Build the manifest of ``rows`` (grp, id, digest, now) and fold each ``now`` with the proof of its place: id, leaf, subroot, ..., verified."""
    tree, above = manifest(rows)
    return _prove(tree.stages[0], tree.paths_to_leaves(above))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    values = [F.col(c) for c in COLUMNS]
    digests = docs.select(
        F.col("source").alias("grp"),
        F.col("doc_id").alias("id"),
        leaf(*values).alias("digest"),
        F.when(tampered, leaf(*values[:-1], F.translate("text", _UPPER, _UPPER.lower()))).alias("now"),
    )
    return verify(digests.withColumn("now", F.coalesce("now", "digest"))).withColumnRenamed("id", "doc_id")

"""Similar documents by n-gram Jaccard: a grouped prefix join.

A document's set holds its distinct five-word shingles. Two sets that are similar enough differ
in few shingles: of a set of size n at most a quarter is missing in the other. So

1. Write each document's size, digest and key; equal sets have one digest and go on once.
2. Deal the shingles whose hash lies below a fixed share, and count those that no other set of
   fitting size has. A set in which more than a quarter of n are such is linked with nothing and
   goes: most documents, even those that share passages with many others.
3. Deal all shingles of the sets that are left, and note how many sets have each. Shingles that
   no other set has can't meet; sets with more than a quarter of them go. The others are
   ordered from rare to common, by exact counts.
4. The prefix of a set is its n // 4 + 1 rarest shingles, less those that no other set has: linked
   sets share one of its shingles. Sets with the same size and prefix are one group. In
   each shingle's list of groups, sorted by size, neighbours whose sizes allow a link are candidate
   edges: any two groups that may link lie in the same chain, so a list of any length gives as
   many edges as members. The components of these edges hold all links.
5. Expand groups and verify members with whole sets: first each with one pivot of its component,
   twice; then all outside the component's largest verified part with everything in the component,
   in cells of bounded size.
6. Components of the verified links; copies take the class of their set.

Defined results
  null text or no words   an empty set, linked with nothing
  fewer words than five   the whole sequence is the one shingle
  null or repeated id     a row counts by its text; the class id is its smallest id, null if none has one
  empty table             no rows
  more columns            are ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graph, storage, tokens, words

SHINGLE = 5
#: Least similarity, in hundredths.
LEAST = 75
#: Sixteenths of all hashes that the first look at shingles covers.
LOOK = 5
#: Bits of a dealt key that hold the set's size in the first look; larger sizes count as the largest.
SIZE_BITS = 18
#: Shingles of a block: what one task compares with another block or a pivot.
BLOCK = 400_000
#: Rows of a shingle's list that one task sorts; longer lists are dealt to many tasks.
LIST = 200_000
#: Rounds in which members are compared with a pivot of their component.
ROUNDS = 2
#: Bytes of text that are made into shingles at once.
BATCH = 4_000_000
#: Bits of the filter of documents whose sets are read again, at most (8 MB). It spares work only: a join decides.
FILTER_BITS = 1 << 26


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, with repeats, and each text's bounds."""
    unique, codes, bounds = words.split(words.text_column(texts))
    low = pc.ascii_lower(unique).to_pylist()
    word = pd.util.hash_array(np.array(low, dtype=object), categorize=False) if low else np.zeros(0, np.uint64)
    h = word[codes]
    n = np.diff(bounds)
    acc = np.full(max(0, len(h) - SHINGLE + 1), SHINGLE, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            acc = (acc ^ h[k : k + len(acc)]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
    owner = words.owners(bounds)
    inside = owner[: len(acc)] == owner[SHINGLE - 1 :] if len(acc) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    count = np.maximum(n - SHINGLE + 1, 0)
    count[short] = 1
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(out_bounds[-1]), np.uint64)
    is_short = np.zeros(len(n), bool)
    is_short[short] = True
    out[~np.repeat(is_short, count)] = acc[inside]
    for d in short:
        out[out_bounds[d]] = xxhash.xxh3_64_intdigest(h[bounds[d] : bounds[d + 1]].tobytes(), seed=int(n[d]))
    return out, out_bounds


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    h, bounds = shingles(batch.column("text"))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(h[a:b])


def _digest(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).astype(np.int64))


def _look(s: np.ndarray) -> np.ndarray:
    """The shingles of the first look, without the bits that make room for the size. Two that differ in these bits only count as one."""
    return np.unique(s[: np.searchsorted(s, np.uint64(LOOK << 60))] >> np.uint64(SIZE_BITS))


def row_key() -> Column:
    """A row's number: rows with the same one have the same id, or none, and the same text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def fits(smaller: Column, larger: Column) -> Column:
    """Sets of these sizes may link."""
    return 100 * smaller.cast("long") >= LEAST * larger.cast("long")


def spare(n: Column) -> Column:
    """Of a set of size n, so many shingles at most are missing in a linked one."""
    return n - F.ceil(n * LEAST / 100)


def profile(docs: DataFrame) -> DataFrame:
    """row, doc_id, n, digest, and how many shingles the first look has of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.small_batches(batches, "text", BATCH):
            n, digest, looked = [], [], []
            for s in _sets(batch):
                n.append(len(s)), digest.append(_digest(s) if len(s) else None), looked.append(len(_look(s)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(digest, pa.int64()), pa.array(looked, pa.int32())], names=["row", "doc_id", "n", "digest", "looked"]
            )

    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n int, digest long, looked int")


def shared_counts(docs: DataFrame) -> DataFrame:
    """digest, and how many shingles of its first look another set of fitting size has, too."""
    top, low = (1 << SIZE_BITS) - 1, np.uint64(SIZE_BITS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in tokens.small_batches(batches, "text", BATCH):
            key, digest = [], []
            for s in _sets(batch):
                if len(s) and (d := _digest(s)) not in seen:
                    if len(seen) < 1_000_000:  # a set that isn't remembered is only dealt again
                        seen.add(d)
                    k = (_look(s) << low) | np.uint64(min(len(s), top))
                    key.append(k.astype(np.int64)), digest.append(np.full(len(k), d, np.int64))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(digest))], names=["key", "digest"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, carried = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def counts() -> pa.RecordBatch:
            d, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            u, at = np.unique(d, return_inverse=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bincount(at, c, len(u)).astype(np.int64))], names=["digest", "times"])

        for batch in batches:
            # A batch begins with the last row of the one before, which counts once.
            key, digest = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([digest, batch.column(1).to_numpy()])
            if len(key) < 2:
                continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])])
            key, digest = key[new], digest[new]
            n, token = key & top, key >> SIZE_BITS
            near = (token[1:] == token[:-1]) & (100 * n[:-1] >= LEAST * n[1:])
            marked = np.concatenate([near, [False]])
            marked[1:] |= near
            marked[0] &= not carried
            carried = bool(marked[-1] or (len(marked) == 1 and carried))
            found.append(np.unique(digest[marked], return_counts=True))
            if sum(len(x[0]) for x in found) > 2_000_000:
                yield counts()
            key, digest = key[-1:], digest[-1:]
        yield counts()

    dealt = docs.select("text").mapInArrow(deal, "key long, digest long")
    dealt = dealt.repartition(storage.partitions(docs.sparkSession), F.shiftright("key", SIZE_BITS)).sortWithinPartitions("key", "digest")
    return dealt.mapInArrow(mark, "digest long, times long").groupBy("digest").agg(F.sum("times").alias("times"))


def row_filter(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the rows' numbers, packed, and how many bits there are: 16 a row, ``FILTER_BITS`` at most."""
    bits = min(FILTER_BITS, 1 << max(10, (16 * wanted.count()).bit_length()))
    bit = F.pmod("row", F.lit(bits))
    # One row for 32 bits: FILTER_BITS / 32 rows at most.
    got = wanted.groupBy(F.shiftright(bit, 5).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(row, {bits}) & 31 AS int))")).alias("word")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[got["at"].to_numpy()] = got["word"].to_numpy().astype(np.uint32)
    return table, bits


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: digest, n, row. Its sets in full: digest, n, s."""
    shared = docs.sparkSession.sparkContext.broadcast(row_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shared.value
        for whole in batches:
            bit = whole.column("row").to_numpy() & (bits - 1)
            keep = (table[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1)
            for batch in tokens.small_batches(iter([whole.filter(pa.array(keep.astype(bool)))]), "text", BATCH):
                s = [x.view(np.int64) for x in _sets(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(s, pa.list_(pa.int64()))], names=["row", "s"])

    read = docs.select(row_key().alias("row"), "text").mapInArrow(run, "row long, s array<long>")
    return wanted.join(read, "row").dropDuplicates(["row"]).select("digest", "n", "s")


def in_lists(rows: DataFrame, key: str, tag: str) -> DataFrame:
    """rows: token, n, ``key``. Adds, of the token's list sorted by n and key: a and before (key and n of the row before), after (n of the next), and df, the list's length.

    Lists of more than ``LIST`` rows are dealt in ranges of token, n and key; only the rows at the ends of ranges look beyond them.
    """
    lists = Window.partitionBy("token")
    w = lists.orderBy("n", key)
    beside = {"a": F.lag(key).over(w), "before": F.lag("n").over(w), "after": F.lead("n").over(w)}
    # At most one in LIST rows.
    hot = storage.materialize(rows.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > LIST), f"{tag}-long")
    if not hot.limit(1).count():
        return rows.withColumns(beside | {"df": F.count("*").over(lists)})
    short = rows.join(hot, "token", "left_anti").withColumns(beside | {"df": F.count("*").over(lists)})
    dealt = rows.join(hot, "token").repartitionByRange(storage.partitions(rows.sparkSession), "token", "n", key)
    dealt = storage.materialize(dealt.withColumn("_range", F.spark_partition_id()), f"{tag}-ranges")
    part = Window.partitionBy("_range", "token")
    w = part.orderBy("n", key)
    near = dealt.withColumns({"a": F.lag(key).over(w), "before": F.lag("n").over(w), "after": F.lead("n").over(w)})
    # One row per range.
    ends = dealt.groupBy("_range").agg(F.min(F.struct("token", "n", key)).alias("first"), F.max(F.struct("token", "n", key)).alias("last"))
    ranges = Window.orderBy("_range")
    ends = ends.select("_range", F.lag("last").over(ranges).alias("_b"), F.lead("first").over(ranges).alias("_f"))
    near = near.join(F.broadcast(ends), "_range")
    behind, ahead = F.col("before").isNull() & (F.col("token") == F.col("_b.token")), F.col("after").isNull() & (F.col("token") == F.col("_f.token"))
    near = near.withColumns({"a": F.when(behind, F.col(f"_b.{key}")).otherwise(F.col("a")), "before": F.when(behind, F.col("_b.n")).otherwise(F.col("before")), "after": F.when(ahead, F.col("_f.n")).otherwise(F.col("after"))})
    return short.unionByName(near.select(*short.columns))


def rare_first(sets: DataFrame) -> DataFrame:
    """digest, n, s: the shingles that another set of fitting size has, rare ones first; k: of these, the prefix; grp.

    Sets that miss more than a linked set may are left out.
    """
    lists = in_lists(sets.select(F.explode("s").alias("token"), "n", "digest"), "digest", "jaccard-lists")
    lists = lists.where(fits(F.col("before"), F.col("n")) | fits(F.col("n"), F.col("after")))
    kept = lists.groupBy("digest", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("s"))
    kept = kept.withColumn("k", spare(F.col("n")) + 1 - (F.col("n") - F.size("s"))).where("k > 0").withColumn("k", F.col("k").cast("int"))
    return kept.withColumn("grp", F.xxhash64("n", F.slice("s", F.lit(1), F.col("k"))))


def candidate_edges(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between groups that may link: neighbours in a list, joined as stars by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = graph.Forest()
        for batch in batches:
            for a, b in np.unique(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1), axis=0).tolist():
                forest.join(a, b)
        a, b = forest.stars()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    groups = sets.select("grp", "n", F.slice("s", F.lit(1), F.col("k")).alias("prefix")).groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    lists = in_lists(groups.select(F.explode("prefix").alias("token"), "n", "grp"), "grp", "jaccard-prefixes")
    return lists.where(fits(F.col("before"), F.col("n"))).select("a", F.col("grp").alias("b")).mapInArrow(run, "a long, b long")


def in_blocks(members: DataFrame) -> DataFrame:
    """members: comp, digest, n. Adds the number of blocks that the component is cut into, and the row's own."""
    total = members.groupBy("comp").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("members"))
    return members.join(total, "comp").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))


def linked(n: Column, m: Column, both: Column) -> Column:
    return 100 * both.cast("long") >= LEAST * (n + m - both).cast("long")


def with_pivot(members: DataFrame) -> DataFrame:
    """members: comp, blocks, block, digest, n, s. Adds label: the component's pivot if linked with it, else null.

    A pivot is written once per block, so members of a large component are compared by many tasks.
    """
    first = members.groupBy("comp").agg(F.min("digest").alias("digest"))
    pivot = members.join(first, ["comp", "digest"]).select("comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("digest").alias("pivot"), F.col("n").alias("m"), F.col("s").alias("other"))
    both = F.size(F.array_intersect("s", "other"))
    met = members.join(pivot, ["comp", "block"])
    return met.withColumn("label", F.when((F.col("pivot") == F.col("digest")) | linked(F.col("n"), F.col("m"), both), F.col("pivot"))).drop("pivot", "m", "other")


def compare(sets: list[np.ndarray], size: np.ndarray, label: np.ndarray, ask: np.ndarray) -> list[tuple[int, int]]:
    """Links (pairs of positions) of the sets to ``ask`` with sets of other labels, as many as it takes to connect what is connected."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    forest, found = graph.Forest(), []
    for x in np.flatnonzero(ask).tolist():
        lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        n = hi - lo
        hits = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        both = np.bincount(hits, minlength=len(sets))
        for y in np.flatnonzero((100 * both >= LEAST * (size[x] + size - both)) & (label != label[x])).tolist():
            a, b = int(label[x]), int(label[y])
            if forest.find(a) != forest.find(b):
                forest.join(a, b)
                found.append((x, y))
    return found


def verify(cells: DataFrame) -> DataFrame:
    """cells: comp, i, j, ask, digest, label, n, s, sorted by cell. Edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def close() -> pa.RecordBatch:
            ask, digest, label, size = (np.array(x) for x in list(zip(*rows, strict=True))[:4])
            got = compare([r[4] for r in rows], size, label, ask)
            return pa.RecordBatch.from_arrays([pa.array([int(digest[k]) for k in x], pa.int64()) for x in (zip(*got, strict=True) if got else ((), ()))], names=["a", "b"])

        for batch in batches:
            small = [batch.column(c).to_pylist() for c in ("comp", "i", "j", "ask", "digest", "label", "n")]
            s = batch.column("s")
            flat, at = s.values.to_numpy(), s.offsets.to_numpy()
            for r, (comp, i, j, *rest) in enumerate(zip(*small, strict=True)):
                if (comp, i, j) != cell:
                    if rows:
                        yield close()
                    cell, rows = (comp, i, j), []
                rows.append((*rest, flat[at[r] : at[r + 1]].copy()))
        if rows:
            yield close()

    return cells.mapInArrow(run, "a long, b long")


def links(placed: DataFrame) -> DataFrame:
    """placed: comp, digest, n, s, of all sets that have a candidate. Edges (a, b) that connect what verified links connect."""
    spark = placed.sparkSession
    todo = storage.materialize(in_blocks(placed).where("members > 1"), "jaccard-placed")
    whole, done, columns = todo, None, ["comp", "digest", "n", "s"]
    for k in range(ROUNDS):
        met = storage.materialize(with_pivot(todo), f"jaccard-round{k}")
        label = met.where("label is not null").select("digest", "label")
        done = label if done is None else done.unionByName(label)
        todo = in_blocks(met.where("label is null").select(*columns))
    parts = whole.join(done, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    parts = storage.materialize(parts, "jaccard-parts")
    size = parts.groupBy("comp", "label").agg(F.count("*").alias("k"))
    core = size.groupBy("comp").agg(F.max(F.struct("k", "label")).alias("core"), F.count("*").alias("labels")).where("labels > 1").select("comp", F.col("core.label").alias("core"))
    # What is outside the largest part meets everything: its blocks (i) with all blocks (j).
    rest = parts.join(core, "comp")
    outer = in_blocks(rest.where("label <> core").select("comp", "digest", "n", "label", "s"))
    cells = outer.select("comp", F.col("block").alias("i"), "blocks").distinct()
    sides = rest.select("comp", F.col("block").alias("j"), "blocks").distinct()
    asks = outer.withColumnRenamed("block", "i").drop("blocks", "members").join(sides.drop("blocks"), "comp").withColumn("ask", F.lit(True))
    others = rest.withColumnRenamed("block", "j").join(cells.drop("blocks"), "comp").withColumn("ask", F.lit(False))
    columns = ["comp", "i", "j", "ask", "digest", "label", "n", "s"]
    dealt = asks.select(*columns).unionByName(others.select(*columns)).repartition(storage.partitions(spark), "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "digest")
    stars = parts.where("digest <> label").select(F.col("digest").alias("a"), F.col("label").alias("b"))
    return storage.materialize(stars.unionByName(verify(dealt)), "jaccard-links")


def classified(docs: DataFrame) -> DataFrame:
    """row (its key), doc_id, n, label (of its class) and component (the class's smallest id) of every row; the last two are null without words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = storage.materialize(profile(docs), "jaccard-profiles")
    sets = own.where("n > 0").groupBy("digest").agg(F.max("n").alias("n"), F.max("looked").alias("looked"), F.min("doc_id").alias("first"), F.min("row").alias("row"))
    sets = storage.materialize(sets, "jaccard-sets")
    met = sets.join(shared_counts(docs), "digest", "left").where(F.col("looked") - F.coalesce("times", F.lit(0)) <= spare(F.col("n")))
    left = storage.materialize(met.select("digest", "n", "row"), "jaccard-left")
    full = storage.materialize(whole_sets(docs, left), "jaccard-full")
    ready = storage.materialize(rare_first(full), "jaccard-ready")
    groups = graph.components(candidate_edges(ready), "jaccard-groups")
    placed = ready.join(groups.withColumnRenamed("node", "grp"), "grp", "left").select(F.coalesce("label", "grp").alias("comp"), "digest", "n", "s")
    labels = graph.components(links(placed), "jaccard-classes").withColumnRenamed("node", "digest")

    known = sets.select("digest", "first").join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    known = storage.materialize(known, "jaccard-known")
    smallest = storage.materialize(known.groupBy("label").agg(F.min("first").alias("component")), "jaccard-smallest")
    of_set = storage.materialize(known.join(smallest, "label").select("digest", "label", "component"), "jaccard-of-set")
    return own.join(of_set, "digest", "left").select("row", "doc_id", "n", "label", "component")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return classified(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class stays: of those with the smallest id, or of all if none has an id, that with the smallest key.

    Of rows with the same id and text, that whose columns' hash is smallest stays. Rows without words all stay.
    """
    heads = classified(docs).where("n > 0 and doc_id <=> component").groupBy("label").agg(F.min("row").alias("keep"))
    row, keep, nth = words.unused(docs.columns, "row", "keep", "nth")
    heads = storage.materialize(heads.select(F.col("keep").alias(keep)), "jaccard-keep")
    wordless = words_missing(F.col("text"))
    rows = docs.where(~wordless).withColumn(row, row_key())
    first = F.row_number().over(Window.partitionBy(row).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    kept = rows.join(heads, F.col(row) == F.col(keep), "left_semi").withColumn(nth, first).where(F.col(nth) == 1).drop(nth, row)
    return kept.unionByName(docs.where(wordless))


def words_missing(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(True))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))

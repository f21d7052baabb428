"""Mix sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a seeded hash and laid end to end, as often as the
target asks. Slots of the schedule are points of the golden-ratio sequence, as whole numbers
of 32 bits, mapped through the cumulative targets of the sources. The points that fall into a source's
interval are its slots: their number cuts the source's words into as many equal blocks, and a
slot's rank among them names the block that it takes. A document's words are those of the slots that its
blocks are joined to. Only DataFrame functions are used.

Defined results
  null text           0 words: nothing is taken
  null source         a source of its own, last in order
  null or repeated id each row is a document of its own
  a source too small for a point   one slot after all others
  empty table         an empty mix
  more columns        are ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import prefix, storage, words

#: Fractional part of the golden ratio in parts of 2 ** 32, to the nearest odd number.
GOLDEN = 2654435769
#: Points repeat after so many slots, so that products stay below 2 ** 63.
PERIOD = 1 << 31
#: Low bits of a point that a cell leaves open; slots meet the sources' intervals cell by cell.
CELL_BITS = 20


def count_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source (source, source_size) its number, weight and target.

    Sources by code point, null last, take the weights in turn. ``share`` times all words are dealt
    by weight; a source takes ``most`` times its size at most, and what it can't take goes to
    the others by weight. The level at which this ends is found from running sums over the
    sources in the order in which they fill up.
    """
    chunked = prefix.in_order(sizes, [F.col("source").asc_nulls_last()], "mix-sources")
    named = prefix.running(chunked.withColumn("_all", F.lit(0)), ["_all"], ["_chunk"], [F.col("source").asc_nulls_last()], {"sid": F.lit(1).cast("long")})
    table = F.array(*[F.lit(float(x)) for x in weights])
    named = named.withColumn("weight", F.get(table, (F.col("sid") % len(weights)).cast("int"))).withColumn("full_at", most * F.col("source_size") / F.col("weight")).drop("_chunk", "_all")
    filled = prefix.in_order(named, [F.col("full_at"), F.col("sid")], "mix-levels").withColumn("_all", F.lit(0))
    filled = prefix.running(filled, ["_all"], ["_chunk"], [F.col("full_at"), F.col("sid")], {"full_before": most * F.col("source_size"), "weight_before": F.col("weight")})
    total = filled.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))
    level = (F.lit(share) * F.col("all_words") - F.col("full_before")) / (F.col("all_weight") - F.col("weight_before"))
    found = filled.crossJoin(F.broadcast(total)).select("*", level.alias("level")).where(F.col("level") <= F.col("full_at"))
    one = found.agg(F.min_by("level", F.struct("full_at", "sid")).alias("level"))
    cap = most * F.col("source_size")
    return named.crossJoin(F.broadcast(one)).select("source", "sid", "source_size", "weight", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).cast("double").alias("target"))


def _with_number(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Add the source's number, size and target. Both sides are read from tables, so a source that holds
    many rows is split by Spark's skew join; null sources get a key of their own."""
    key = lambda c: F.concat(F.when(c.isNull(), "-").otherwise("+"), F.coalesce(c, F.lit("")))
    named = targets.select(key(F.col("source")).alias("_key"), "sid", "source_size", "target")
    return rows.withColumn("_key", key(F.col("source"))).join(named, "_key").drop("_key")


def _schedule(spark: SparkSession, plan: DataFrame, block_words: int) -> DataFrame:
    """plan: sid, want, before (words of earlier sources). Slots with their source, the rank among its slots, and the block's start and words."""
    total = plan.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0]
    count = -(-total // block_words)
    edge = lambda x: F.floor(x / F.lit(float(max(1, total))) * 2.0**32).cast("long")
    spans = plan.select("sid", edge(F.col("before")).alias("lo"), edge(F.col("before") + F.col("want")).alias("hi"))
    spans = spans.where("lo < hi").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))))
    point = ((F.col("id") % PERIOD + 1) * GOLDEN).bitwiseAND(F.lit((1 << 32) - 1))
    slots = spark.range(count).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.shiftright("point", CELL_BITS))
    met = slots.join(spans, "cell").where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    size = max(1, -(-count // (8 * storage.partitions(spark))))
    met = storage.materialize(met.select("slot", "sid", F.expr(f"slot div {size}").alias("_part")), "mix-slots")
    ranked = prefix.running(met, ["sid"], ["_part"], ["slot"], {"rank": F.lit(1).cast("long")}).select("slot", "sid", "rank")
    have = plan.select("sid", "want").join(met.groupBy("sid").agg(F.count("*").alias("slots")), "sid", "left")
    tail = have.where("slots is null").select((F.lit(count) + F.col("sid")).alias("slot"), "sid", F.lit(0).cast("long").alias("rank"))
    have = have.withColumn("slots", F.coalesce("slots", F.lit(1).cast("long")))
    cut = ranked.unionByName(tail).join(have, "sid").withColumns({"q": F.expr("want div slots"), "m": F.expr("want % slots")})
    # The first m blocks have a word more than the others.
    start = F.col("rank") * F.col("q") + F.least("rank", "m")
    return cut.select("slot", "sid", "rank", start.alias("start"), (F.col("q") + (F.col("rank") < F.col("m")).cast("long")).alias("words"), "slots", "want")


@dataclass
class Mix:
    """documents: a row each with its place in its source's stream, the words taken of it, its first slot (null if it has none) and how many slots it is in.
    schedule: slot, sid, rank, start, words (the block, in the words that the source gives), slots and want (of the source).
    targets: as of :func:`source_targets`."""

    documents: DataFrame
    schedule: DataFrame
    targets: DataFrame


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 4096, seed: int = 17) -> Mix:
    """Take ``share`` times all words by the weights; the rows need doc_id, text and source."""
    spark = docs.sparkSession
    n = 8 * storage.partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    rows = storage.materialize(rows, "mix-rows")
    targets = storage.materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")

    want = F.least(F.round("target").cast("long"), (F.lit(most) * F.col("source_size")).cast("long"))
    plan = prefix.in_order(targets.where("source_size > 0").select("sid", want.alias("want")).where("want > 0"), [F.col("sid")], "mix-plan").withColumn("_all", F.lit(0))
    plan = storage.materialize(prefix.running(plan, ["_all"], ["_chunk"], ["sid"], {"before": F.col("want")}).select("sid", "want", "before"), "mix-intervals")
    schedule = storage.materialize(_schedule(spark, plan, block_words), "mix-schedule")

    keyed = _with_number(rows, targets).withColumn("_chunk", F.pmod(F.col("h"), F.lit(n)))
    placed = prefix.running(keyed, ["sid"], ["_chunk"], ["h", "doc_id"], {"at": F.col("size")}).drop("_chunk")
    cuts = schedule.where("rank = 0").select("sid", "want", F.expr("want div slots").alias("q"), F.expr("want % slots").alias("m"))
    keys = ["doc_id", "sid", "at", "size", "source_size", "target", "h"]
    rounds = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr("(want - 1) div source_size"))), lambda k: k * F.col("source_size") + F.col("at"))
    parts = placed.where("size > 0").join(cuts, "sid").withColumn("from", F.explode(rounds)).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("want")))
    longer = F.col("m") * (F.col("q") + 1)  # words in blocks of q + 1
    rank = lambda p: F.when(p < longer, F.floor(p / (F.col("q") + 1))).otherwise(F.col("m") + F.floor((p - longer) / F.greatest(F.col("q"), F.lit(1))))
    parts = parts.where(F.col("from") < F.col("to")).withColumn("rank", F.explode(F.sequence(rank(F.col("from")), rank(F.col("to") - 1))))
    got = parts.join(schedule.select("slot", "sid", "rank", "start", "words"), ["sid", "rank"])
    here = F.least("to", F.col("start") + F.col("words")) - F.greatest("from", "start")
    full = got.groupBy("h", "sid", "at").agg(F.sum(here).alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("slots"))
    full = storage.materialize(full, "mix-taken")
    # Rows without words share the place of the row that follows: they take nothing.
    full = placed.withColumn("real", F.col("size") > 0).join(full.withColumn("real", F.lit(True)), ["h", "sid", "at", "real"], "left")
    full = full.select(*keys, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("slots", F.lit(0)).cast("long").alias("slots"))
    return Mix(full, schedule, targets)


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus in whole documents: each row of ``docs`` as often as the mix takes it, rounded.

    A document without words gives nothing to a mix of words and is left out. Rows with the same id and
    text share what the mix takes of them, in the order of a hash of their columns.
    """
    done = mix(docs, weights, share, most, seed=seed).documents
    h, h2, times, rows, here, copy = words.unused(docs.columns, "h", "h2", "times", "rows", "here", "copy")
    taken = done.where("size > 0").groupBy(F.col("h").alias(h2)).agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("long").alias(times), F.count("*").alias(rows))
    taken = storage.materialize(taken.where(F.col(times) > 0), "mix-times")
    met = docs.withColumn(h, F.xxhash64(F.lit(seed), "doc_id", "text")).join(taken, F.col(h) == F.col(h2))
    nth = F.row_number().over(Window.partitionBy(h).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    each = F.expr(f"`{times}` div `{rows}`") + F.when(nth <= F.expr(f"`{times}` % `{rows}`"), 1).otherwise(0)
    out = met.withColumn(here, each).where(F.col(here) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(here).cast("long"))))
    return out.select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "slots")

"""Shards by balanced label propagation.

Documents that belong together share a hub (here: equal texts). Every document begins in a
shard given by its hash. In each round a hub counts its members by shard, and members elsewhere
ask to move to the shard that holds most of them; a shard accepts as many as its quota has room
for. Rounds go on until nothing moves. A hub larger than an even share needs several shards and
would leave no room for others, so it isn't moved: such hubs stand before all others, each in one
run. At the end the documents, ordered by shard and hub, are cut into pieces whose counts differ
by one at most, so a cut goes through few hubs and the law ``rows`` holds exactly.

Defined results
  null text            an empty one for the hub and checksum; its size is the fixed part alone
  null or repeated id  each row has a place of its own
  a hub larger than a shard   fills as many consecutive shards as it needs
  empty table          no rows
  more columns         are ignored
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefix, storage


def propagate(nodes: DataFrame, shards: int, slack: float = 1.0) -> DataFrame:
    """nodes: any columns with ``hub`` (not null) and ``key`` (long). Adds ``label`` and ``hub_rows``.

    A shard takes up to 1 + ``slack`` times its even share, so that groups have room to gather; the
    cut at the end makes the shards even. A hub's members go to the shard that holds most of them
    among those with room, unless they are where the hub has as many already. Rounds end when no
    member asks to move: every move raises the sum of the squared votes, and a shard with room
    accepts some of those that ask. A hub of more than an even share has the label -1.
    """
    spark = nodes.sparkSession
    n = storage.partitions(spark)
    hubs = storage.materialize(nodes.groupBy("hub").agg(F.count("*").alias("hub_rows")), "shard-hubs")
    total = nodes.count()
    large = F.col("hub_rows") * shards > total
    own = F.pmod(F.xxhash64("key", "hub"), F.lit(shards)).cast("int")
    state = storage.materialize(nodes.join(hubs, "hub").withColumn("label", F.when(large, F.lit(-1)).otherwise(own)), "shard-state")
    quota = int(-(-state.where("label >= 0").count() // shards) * (1 + slack)) + 1
    every = spark.range(shards).select(F.col("id").cast("int").alias("goal"))
    while True:
        # One row per shard: a fixed bound.
        load = state.groupBy("label").agg(F.count("*").alias("load")).withColumnRenamed("label", "goal")
        room = every.join(load, "goal", "left").select("goal", (F.lit(quota) - F.coalesce("load", F.lit(0))).alias("room")).where("room > 0")
        room = storage.materialize(room, "shard-room")
        votes = state.where("hub_rows > 1 and label >= 0").groupBy("hub", "label").agg(F.count("*").alias("votes"))
        votes = storage.materialize(votes, "shard-votes")
        open_ = votes.join(F.broadcast(room.select(F.col("goal").alias("label"))), "label", "left_semi")
        # The hub's number settles ties, so that not all small hubs meet in the first shard.
        best = open_.groupBy("hub").agg(F.max_by("label", F.struct("votes", F.xxhash64("hub", "label"))).alias("goal"), F.max(F.struct("votes", F.xxhash64("hub", "label"))).alias("strength"))
        own = votes.select("hub", "label", F.struct("votes", F.xxhash64("hub", "label")).alias("here"))
        goals = own.join(best, "hub").where(F.col("here") < F.col("strength")).select("hub", "label", "goal")
        goals = storage.materialize(goals, "shard-goals")
        if not goals.limit(1).count():
            return state
        moving = state.join(goals, ["hub", "label"], "left")
        asks = moving.where("goal is not null").withColumn("_chunk", F.pmod(F.xxhash64("key"), F.lit(8 * n)))
        asks = prefix.running(asks, ["goal"], ["_chunk"], ["hub", "key"], {"place": F.lit(1).cast("long")}).drop("_chunk")
        asks = asks.join(F.broadcast(room), "goal").withColumn("label", F.when(F.col("place") < F.col("room"), F.col("goal")).otherwise(F.col("label")))
        stay = moving.where("goal is null")
        state = storage.materialize(asks.select(*state.columns).unionByName(stay.select(*state.columns)), "shard-state")


def shard(nodes: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot``; the shards' row counts differ by one at most."""
    n = storage.partitions(nodes.sparkSession)
    state = propagate(nodes, shards)
    total = max(1, state.count())
    hot = max(64, total // (shards * 16))
    state = state.withColumn("_chunk", F.when(F.col("label") < 0, F.xxhash64("hub")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(max(4, n // 4)))))
    state = state.withColumn("_sub", F.when(F.col("hub_rows") > hot, 1 + F.pmod(F.xxhash64("key"), F.lit(4 * n))).otherwise(F.lit(0).cast("long")))
    placed = prefix.running(state.withColumn("_all", F.lit(0)), ["_all"], ["label", "_chunk", "_sub"], ["hub", "key"], {"rank": F.lit(1).cast("long")})
    placed = placed.withColumn("shard", F.expr(f"int((rank * {shards}) div {total})"))
    first = F.expr(f"(bigint(shard) * {total} + {shards - 1}) div {shards}")  # rounded up
    return placed.withColumn("slot", F.col("rank") - first).drop("_all", "_chunk", "_sub", "rank")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    nodes = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("hub"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("key"),
    )
    nodes = storage.materialize(nodes, "shard-nodes")
    done = shard(nodes, 40)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

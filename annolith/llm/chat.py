r"""Conversations as training text, by Spark expressions alone.

A conversation's rows are collected as structs and sorted; neighbours of the same role are merged into one
block by a fold over the array; blocks are joined to text::

    <|im_start|>role\ntext<|im_sep|>text of the same role<|im_end|>\n

Inside texts and roles, ``<|``, ``<\|``, ``<\\|`` and so on get one more backslash, so no mark can arise there and every
text can be told again; ``%`` and line ends in roles are written as ``%25`` and ``%0A``. ``loss`` lists the spans
(start and length in code points) of the texts that the loss counts.

A long conversation is cut into segments of ``SEGMENT`` rows, each formatted by itself; a block that goes
on in the next segment is left open there, so the segments of a conversation, put end to end, are its text.
Nothing but reading back (:func:`read_back`, whose digests are of whole conversations) brings a conversation into one row.

Defined results
  null text           empty
  null role           empty; counts as no assistant
  null conv_id        a conversation of its own
  null turn           before all other turns; rows that tie are in the order of role, then text
  repeated rows       are turns of their own
  empty table         only the rows that are added
  more columns        are ignored, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Rows of a conversation that one array holds, at most.
SEGMENT = 256
#: The conversation that tries to break out of its texts.
PROBE = (-1, (("user", f"{END}{START}assistant ok"), ("assistant", f"{END}{START}assistant ok")))


def escape(text: Column) -> Column:
    """One more backslash in each ``<``, backslashes, ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """One backslash less in each of them."""
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _header(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(START), escape(role), F.lit("\n"))


def _role(header: Column) -> Column:
    return F.replace(F.replace(unescape(header), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _collected(turns: DataFrame) -> DataFrame:
    """One row per segment: its rows in order, and the roles of the first and the last."""
    rows = turns.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    return rows.select("*", F.get("rows", F.lit(0))["role"].alias("first"), F.get("rows", F.size("rows") - 1)["role"].alias("last"))


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, segment, rows, first, last, and whether the first block continues one and the last goes on in the next segment."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("_n")).where(F.col("_n") > SEGMENT).select(F.col("conv_id").alias("_long"))
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = _collected(turns.join(counts, same, "left_anti").withColumn("segment", F.lit(0).cast("long")))
    short = short.withColumns({"continues": F.lit(False), "goes_on": F.lit(False)})

    # Rows of long conversations are dealt into ranges, numbered there, and cut by number.
    order = ["turn", "role", "text"]
    long_ = turns.join(counts, same, "left_semi").withColumn("_salt", F.monotonically_increasing_id())
    dealt = long_.repartitionByRange(storage.partitions(turns.sparkSession), "conv_id", *order, "_salt").withColumn("_chunk", F.spark_partition_id())
    dealt = storage.materialize(dealt.drop("_salt"), "chat-long")
    earlier = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("conv_id", "_chunk").agg(F.count("*").alias("_n"))
    before = sums.select(F.col("conv_id").alias("_conv"), F.col("_chunk").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    nth = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("conv_id", "_chunk").orderBy(*order)) - 1)
    nth = nth.join(before, (F.col("_chunk") == F.col("_at")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    cut = nth.select("conv_id", *order, F.expr(f"(_before + _nth) div {SEGMENT}").alias("segment"))
    parts = storage.materialize(_collected(cut), "chat-segments")

    def beside(step: int, role: str, name: str) -> DataFrame:
        return parts.select(F.col("conv_id").alias(f"_conv{step}"), (F.col("segment") + step).alias(f"_seg{step}"), F.col(role).alias(name))

    for step, role, name in ((1, "last", "_before"), (-1, "first", "_after")):
        joined = (F.col("segment") == F.col(f"_seg{step}")) & F.col("conv_id").eqNullSafe(F.col(f"_conv{step}"))
        long_parts = (parts if step == 1 else long_parts).join(beside(step, role, name), joined, "left")
    long_parts = long_parts.withColumns({"continues": F.coalesce(F.col("_before") == F.col("first"), F.lit(False)), "goes_on": F.coalesce(F.col("_after") == F.col("last"), F.lit(False))})
    return short.unionByName(long_parts.select(*short.columns))


def merged(rows: Column) -> Column:
    """Blocks (role, texts) of sorted rows: neighbours of the same role are one."""

    def step(blocks: Column, row: Column) -> Column:
        last = F.get(blocks, F.size(blocks) - 1)
        longer = F.struct(row["role"].alias("role"), F.concat(last["texts"], F.array(row["text"])).alias("texts"))
        other = F.struct(row["role"].alias("role"), F.array(row["text"]).alias("texts"))
        return F.when(last["role"] == row["role"], F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))).otherwise(F.concat(blocks, F.array(other)))

    return F.aggregate(rows, F.expr("CAST(array() AS array<struct<role:string,texts:array<string>>>)"), step)


def _pieces(blocks: Column, counted: str, continues: Column, goes_on: Column) -> Column:
    """The text in pieces (s, loss), in order."""
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def block(b: Column, i: Column) -> Column:
        head = F.when((i == 0) & continues, F.lit(SEP)).otherwise(_header(b["role"]))
        tail = F.when((i == F.size(blocks) - 1) & goes_on, F.lit("")).otherwise(F.lit(f"{END}\n"))
        texts = F.transform(b["texts"], lambda t, k: F.array(piece(F.when(k == 0, head).otherwise(F.lit(SEP)), no), piece(escape(t), b["role"] == counted)))
        return F.concat(F.flatten(texts), F.array(piece(tail, no)))

    return F.flatten(F.transform(blocks, block))


def _spans(pieces: Column) -> Column:
    """Start and length, in code points, of the pieces that count."""

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p["s"]).cast("long")
        span = F.struct(acc["at"].alias("start"), n.alias("length"))
        return F.struct((acc["at"] + n).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start:bigint,length:bigint>>)").alias("spans"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def format_chats(turns: DataFrame, counted: str = "assistant") -> DataFrame:
    """conv_id, segment, text and loss of every conversation; ``turns`` has conv_id, turn, role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = turns.select("conv_id", "turn", text("role"), text("text"))
    blocks = segments(turns).select("conv_id", "segment", "continues", "goes_on", merged(F.col("rows")).alias("blocks"))
    pieces = blocks.select("conv_id", "segment", _pieces(F.col("blocks"), counted, F.col("continues"), F.col("goes_on")).alias("pieces"))
    return pieces.select("conv_id", "segment", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("text"), _spans(F.col("pieces")).alias("loss"))


def parsed(text: Column) -> Column:
    """Blocks (role, texts) of a whole formatted conversation: what :func:`merged` made."""

    def block(b: Column) -> Column:
        b = F.substring_index(b, END, 1)
        end = F.instr(b, "\n")
        texts = F.split(F.substr(b, end + 1), r"<\|im_sep\|>", -1)
        return F.struct(_role(F.substr(b, F.lit(1), end - 1)).alias("role"), F.transform(texts, unescape).alias("texts"))

    return F.transform(F.slice(F.split(text, r"<\|im_start\|>", -1), 2, 2**30), block)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks, n_segments."""
    parts = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "text", "loss"))).alias("parts"))
    masked = F.transform("parts", lambda p: F.array_join(F.transform(p["loss"], lambda s: unescape(F.substr(p["text"], s["start"].cast("int") + 1, s["length"].cast("int")))), ""))
    whole = parts.select("conv_id", F.size("parts").cast("long").alias("n_segments"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), F.array_join(masked, "").alias("masked"))
    told = whole.select("*", parsed(F.col("text")).alias("blocks"))
    lines = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n")))))
    told = told.select("*", lines.alias("lines"))
    return told.select(
        "conv_id",
        F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
        F.size("blocks").cast("long").alias("n_blocks"),
        "n_segments",
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE[0], i, role, text) for i, (role, text) in enumerate(PROBE[1])], "conv_id long, turn long, role string, text string")
    return read_back(storage.materialize(format_chats(turns.unionByName(probe)), "chat"))

"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every shingle is hashed once. The high bits of the hash name its bin and each bin keeps its
smallest hash. An empty bin takes the value of another: it probes bins in an order given by a
hash of its own number, so that two texts that fill the same bins borrow alike (optimal
densification). Of each bin's value the low byte is kept, eight bins to a 64-bit word. Two
fingerprints agree by chance in one byte of 256; the likeness is corrected for that.

Defined results
  null text               an empty text
  no words                the empty fingerprint: likeness 1 to another empty one, else 0
  fewer words than five   the whole sequence is the one shingle
  null or repeated id     rows are ordered by id (null first), then by hash of the text, then by text
  a single row            its next document is itself
  empty table             no rows
  more columns            are ignored, whatever their names
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import prefix, storage

BINS = 256
WORDS = BINS // 8
#: Hashed probes of an empty bin, before it takes the first of all filled bins in hashed order.
PROBES = 8
_LOW = 0x00FFFFFFFFFFFFFF
_ONES = 0x0101010101010101


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = 5) -> DataFrame:
    """Add the packed fingerprint of a text column: an array of 32 longs, empty without words."""
    t, w, s, b, v = (f"_{k}_{out}" for k in "twsbv")
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    df = df.withColumn(t, F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ")))
    df = df.withColumn(w, F.transform(t, lambda x: F.xxhash64(x))).drop(t)
    n = F.size(w)
    whole = F.array(F.aggregate(w, _lit(7), lambda a, x: F.xxhash64(a, x)))
    rolled = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(shingle)]))
    df = df.withColumn(s, F.when(n >= shingle, rolled).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))).drop(w)
    # One more value per bin, the largest it can hold: it comes first in its bin only if the bin is empty.
    marks = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda k: F.shiftleft(k.cast("long"), 56).bitwiseOR(_lit(_LOW)))
    df = df.withColumn(s, F.when(F.size(s) > 0, F.sort_array(F.concat(F.col(s), marks))))
    first = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(F.col(s), i - 1), 56)))
    df = df.withColumn(b, first).drop(s)
    empty = lambda x: x.bitwiseAND(_lit(_LOW)) == _LOW
    at = lambda j, t: F.xxhash64(j, t).bitwiseAND(_lit(BINS - 1)).cast("int")

    def borrowed(j: Column) -> Column:
        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(PROBES)),
            _lit(_LOW),
            lambda acc, t: F.when(empty(acc), F.get(F.col(b), at(j, t))).otherwise(acc),
        )
        last = lambda: F.array_min(F.transform(F.filter(b, lambda x: ~empty(x)), lambda x: F.struct(F.xxhash64(F.shiftright(x, 56), j).alias("o"), x.alias("x"))))["x"]
        return F.transform(F.array(found), lambda x: F.when(empty(x), last()).otherwise(x))[0]

    df = df.withColumn(v, F.transform(b, lambda x, j: F.when(empty(x), borrowed(j)).otherwise(x))).drop(b)
    byte = lambda i, k: F.shiftleft(F.get(F.col(v), i * 8 + k).bitwiseAND(_lit(255)), 8 * k)

    def word(i: Column) -> Column:
        x = byte(i, 0)
        for k in range(1, 8):
            x = x.bitwiseOR(byte(i, k))
        return x

    packed = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word)
    return df.withColumn(out, F.when(F.col(v).isNull(), F.array().cast("array<bigint>")).otherwise(packed)).drop(v)


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, corrected for bytes that agree by chance."""

    def same(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        # Fold the bits of each byte into its lowest: 1 where the bytes differ.
        for k in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.lit(8) - F.bit_count(d.bitwiseAND(_lit(_ONES)))

    share = F.aggregate(F.zip_with(a, b, same), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 2.0**-8
    fixed = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(fixed)


def _ranges(docs: DataFrame, key: str, pieces: int) -> DataFrame:
    """Add _h, a hash of the text, and _b and _s: the row's range by key, then hash. A key that fills several ranges is split by hash."""
    total, nulls = docs.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    found = docs.approxQuantile(key, [i / pieces for i in range(1, pieces)], 0.25 / pieces) if pieces > 1 else []
    times = Counter(found)
    split = [F.lit(x) for v, c in times.items() if c > 1 for x in (int(v), c)]
    many = F.coalesce(F.element_at(F.create_map(*split), F.col(key)), F.lit(0)) if split else F.lit(0)
    many = F.when(F.col(key).isNull(), -(-nulls * pieces // max(1, total))).otherwise(many)
    rows = docs.withColumn("_h", F.xxhash64("text")).withColumn("_b", F.when(F.col(key).isNull(), -1).otherwise(prefix.bucket(F.col(key), sorted(times))))
    at = F.least(F.floor((F.col("_h") * 2.0**-64 + 0.5) * many), many - 1).cast("int")
    # Rows with a split key come first in their range; the others follow.
    return rows.withColumn("_s", F.when(many > 0, at).otherwise(2 * pieces))


def with_next(docs: DataFrame, key: str, derive: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the row that follows by key, then hash of the text, then text.

    docs: key and text. Rows are dealt once, by range. The first row of each range is also put at the
    end of the range before, so no row needs another range. ``derive`` adds columns before rows are dealt.
    """
    rows = _ranges(docs, key, 8 * storage.partitions(docs.sparkSession))
    # One row per range: their number is bounded by that of the ranges.
    first = rows.groupBy("_b", "_s").agg(F.min(F.struct(key, "_h", "text")).alias("first"))
    first = storage.materialize(first.select("_b", "_s", "first.*"), "next-starts")
    ranges = [(r["_b"], r["_s"]) for r in first.select("_b", "_s").orderBy("_b", "_s").collect()]
    if ranges:
        before = [(*r, *ranges[i - 1]) for i, r in enumerate(ranges)]
        edge = docs.sparkSession.createDataFrame(before, "_b int, _s int, _tb int, _ts int")
        guests = first.join(F.broadcast(edge), ["_b", "_s"]).drop("_b", "_s").withColumnsRenamed({"_tb": "_b", "_ts": "_s"}).withColumn("_guest", F.lit(1))
        rows = derive(rows.withColumn("_guest", F.lit(0)).unionByName(guests))
    else:
        rows = derive(rows.withColumn("_guest", F.lit(0)))
    w = Window.partitionBy("_b", "_s").orderBy("_guest", F.col(key).asc_nulls_first(), "_h", "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return rows.where("_guest = 0").drop("_guest", "_b", "_s", "_h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Columns doc_id, text, and ``fp``, the packed fingerprint of the whole text."""
    return with_fingerprint(_texts(docs), "text", "fp")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose end is the beginning of the next document, and their likeness."""
    pairs = with_next(_texts(docs), "doc_id", lambda rows: with_fingerprint(rows, "text", "fp"), ["text", "fp"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    pairs = with_fingerprint(pairs, "edited", "efp")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )

"""Label lines: ``class cx cy w h`` and, for poses, ``x y v`` per keypoint.

Tools of this kind read lines more or less strictly. A dialect says what a line may be:

strict    5 tokens, or 5 and whole triplets
fixed     5 or 56 tokens
lenient   anything: fewer than 5 tokens give no box, a broken last triplet is dropped
padded    5 tokens and whole triplets, padded or cut to ``count`` keypoints
pose      at least 8 tokens and whole triplets
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import keypoints as kp

DIALECTS = ("strict", "fixed", "lenient", "padded", "pose")
#: What a malformed line does: end the job, drop its file, make the file count as unlabelled, or go.
ON_ERROR = ("fail", "drop_image", "as_unlabelled", "drop_line")


def number(token: Column) -> Column:
    """A token as a double; null if it isn't one. A trailing type letter isn't part of a number."""
    return F.when(~F.substring(token, -1, 1).isin("d", "D", "f", "F") | (F.lower(F.substring(token, -3, 3)) == "inf"), token.try_cast("double"))


def _tokens(line: Column) -> Column:
    """What white space parts; of a blank line one empty token."""
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value): a lambda's variable is worked out once, however often it's named."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _shape(n: Column, dialect: str) -> Column:
    """Whether a line may have n tokens."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; known: {', '.join(DIALECTS)}")
    triplets = (n - 5) % 3 == 0
    return {
        "strict": (n >= 5) & triplets,
        "fixed": (n == 5) | (n == 56),
        "lenient": F.lit(True),
        "padded": (n >= 5) & triplets,
        "pose": (n >= 8) & triplets,
    }[dialect]


def _row(tokens: Column, values: Column, dialect: str, count: int) -> Column:
    """What a line says; values: its tokens as numbers, the class first."""
    n = F.size(tokens)
    shape = _shape(n, dialect)
    numeric = ~F.exists(values, lambda v: v.isNull())
    k = F.greatest(F.lit(0), F.floor((n - 5) / 3).cast("int"))
    points = F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), k - 1)), lambda i: kp.point(F.get(values, 5 + 3 * i), F.get(values, 6 + 3 * i), F.get(values, 7 + 3 * i))))
    points = F.coalesce(points, F.array().cast("array<struct<x:double,y:double,v:double>>"))
    if dialect == "padded":
        points = kp.pad(points, count)
    ok = shape & numeric
    box = lambda i: F.when(n >= 5, F.get(values, i + 1))
    error = F.when(~shape, F.concat(F.lit("tokens: "), n.cast("string"))).when(~numeric, F.lit("not a number"))
    return F.struct(
        F.get(tokens, 0).alias("class_token"), F.get(values, 0).cast("int").alias("class_id"), *[F.when(ok, box(i)).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))],
        F.when(ok, points).alias("kpts"), error.alias("error"),
    )


def parse_line(line: Column, dialect: str = "strict", count: int = 17) -> Column:
    """struct<class_token, class_id, cx, cy, w, h, kpts, error>; null for a blank line."""
    # A line's tokens and values aren't made anew for each point.
    return _once(_tokens(line), lambda t: F.when(F.get(t, 0) != "", _once(F.transform(t, number), lambda v: _row(t, v, dialect, count))))


def parsed_lines(files: DataFrame, dialect: str = "strict", count: int = 17) -> DataFrame:
    """stem, line_no, line and ``p``, what :func:`parse_line` makes of it, of every line that isn't blank.

    Tokens and numbers leave generators: a column would be worked out again in every filter that is pushed below it.
    """
    lines = files.select("stem", F.posexplode(F.split("raw", "\r?\n")).alias("line_no", "line"))
    lines = lines.select("stem", "line_no", "line", F.explode(F.array(_tokens(F.col("line")))).alias("_t")).where(F.get("_t", 0) != "")
    lines = lines.select("stem", "line_no", "line", "_t", F.explode(F.array(F.transform("_t", number))).alias("_v"))
    return lines.select("stem", "line_no", "line", _row(F.col("_t"), F.col("_v"), dialect, count).alias("p"))


def parse_files(files: DataFrame, dialect: str = "strict", on_error: str = "fail", count: int = 17) -> DataFrame:
    """One row per line of label files (stem, raw). Files stay apart from their lines: a file may be empty."""
    if on_error not in ON_ERROR:
        raise ValueError(f"unknown on_error {on_error!r}; known: {', '.join(ON_ERROR)}")
    rows = parsed_lines(files, dialect, count).select("stem", "line_no", "p.*", F.col("line").alias("raw"))
    if on_error == "fail":
        bad = F.raise_error(F.concat(F.lit("label line of "), F.col("stem"), F.lit(": "), F.col("error"))).cast("string")
        return rows.withColumn("error", F.when(F.col("error").isNotNull(), bad))
    if on_error == "drop_line":
        return rows.where("error is null")
    broken = rows.where("error is not null").select("stem").distinct()
    return rows.join(broken, "stem", "left_anti")


def raw_lines(files: DataFrame) -> DataFrame:
    """Lines of label files that aren't blank, as they are: stem, line_no, line."""
    lines = files.select("stem", F.posexplode(F.split("raw", "\r?\n")).alias("line_no", "line"))
    return lines.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")


def pose_entries(files: DataFrame, class_id: int = 0) -> DataFrame:
    """Lines of one class with a whole box, read leniently: the sources that labels are carried forward from. A line that isn't numbers fails the job."""
    rows = parse_files(files, "lenient", "fail").where(F.col("error").isNull())
    return rows.where((F.col("class_id") == class_id) & F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()).drop("error")


def _pose_points(line: Column) -> Column:
    """How many points a pose's line has, without making them: -1 for a line that isn't a pose, null for a blank one."""
    # Only d and f, as type letters or in inf, make a token no number that can be cast to one.
    odd = lambda t: F.when(line.rlike("[dDfF]"), F.exists(t, lambda x: number(x).isNull())).otherwise(F.exists(t, lambda x: x.try_cast("double").isNull()))
    points = lambda t: F.when(_shape(F.size(t), "pose") & ~odd(t), F.floor((F.size(t) - 5) / 3).cast("int")).otherwise(-1)
    return _once(_tokens(line), lambda t: F.when(F.get(t, 0) != "", points(t)))


def pose_files(files: DataFrame, points: int | None = None) -> DataFrame:
    """Per label file: lines that can be read as poses, lines that can't, and poses with another number of points than ``points``."""
    read, known = F.filter("_n", lambda n: n >= 0), F.filter("_n", lambda n: n.isNotNull())
    odd = F.size(F.filter(read, lambda n: n != points)) if points is not None else F.lit(0)
    counts = files.select("stem", F.explode(F.array(F.transform(F.split("raw", "\r?\n"), _pose_points))).alias("_n"))
    return counts.select("stem", F.size(read).alias("poses"), (F.size(known) - F.size(read)).alias("skipped"), odd.alias("mismatched"))


def file_states(images: DataFrame, files: DataFrame) -> DataFrame:
    """stem and state: missing, empty or labelled."""
    n = F.size(F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != ""))
    state = files.select("stem", F.when(n > 0, "labelled").otherwise("empty").alias("state"))
    return images.select("stem").join(state, "stem", "left").withColumn("state", F.coalesce("state", F.lit("missing")))


@F.pandas_udf(T.StringType())
def fixed6(v: pd.Series) -> pd.Series:
    """Six decimals, rounded from the exact binary value."""
    return v.map(lambda x: f"{x:.6f}", na_action="ignore")


def _short(x: float) -> str:
    out = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if out == "-0" else out


@F.pandas_udf(T.StringType())
def trimmed6(v: pd.Series) -> pd.Series:
    """Six decimals without trailing zeros."""
    return v.map(_short, na_action="ignore")


@F.pandas_udf(T.StringType())
def visibility(v: pd.Series) -> pd.Series:
    """A whole number if nearly one, else six decimals without trailing zeros."""
    return v.map(lambda x: str(round(x)) if abs(x - round(x)) < 1e-6 else _short(x), na_action="ignore")


@F.pandas_udf(T.StringType())
def general(v: pd.Series) -> pd.Series:
    """Six significant digits; zero is 0.0."""
    return v.map(lambda x: "0.0" if x == 0 else f"{x:g}", na_action="ignore")


@F.pandas_udf(T.StringType())
def _line_text(token: pd.Series, values: pd.Series) -> pd.Series:
    """The line of a class and its numbers: the box, then points of which each third number is a visibility. Nulls are left out."""
    seen = lambda x: str(round(x)) if abs(x - round(x)) < 1e-6 else _short(x)

    def one(t: str | None, v) -> str | None:
        if v is None:
            return None
        texts = [seen(x) if i > 3 and (i - 4) % 3 == 2 else _short(x) for i, x in enumerate(v) if x is not None and x == x]
        return " ".join(texts if t is None else [t, *texts])

    return pd.Series([one(t, v) for t, v in zip(token, values, strict=True)], dtype=object)


def to_lines(rows: DataFrame, trailing_newline: bool = False) -> DataFrame:
    """Label files (stem, raw) from rows with class_token, cx, cy, w, h and kpts, in line order.

    A line is made where its row lies; only whole lines are brought together. Rows without points (null) are left out.
    """
    flat = F.concat(F.array("cx", "cy", "w", "h"), F.flatten(F.transform("kpts", lambda p: F.array(p["x"], p["y"], p["v"]))))
    line = rows.select("stem", "line_no", _line_text("class_token", flat).alias("line")).where("line is not null")
    files = line.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    raw = F.concat_ws("\n", F.transform("l", lambda x: x["line"]))
    return files.select("stem", F.concat(raw, F.lit("\n")).alias("raw") if trailing_newline else raw.alias("raw"))

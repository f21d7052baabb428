"""Plans of moves, copies, deletions and new files, carried out by tasks.

A plan may hold chains and cycles (a becomes b, b becomes a). It is written down before anything happens, and goes through three stages, each marked when
all tasks have ended:

1. copies are made under names of their own, beside their targets
2. files that move get such names, too, and files to be deleted go
3. these names become the targets, and empty files are created

Within a stage every step can be repeated: what is done already is seen by the name of its own. So a plan that failed half-way is run again with the same
state folder and ends as if it hadn't failed; after its end nothing more happens.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import opened

ACTIONS = ("move", "copy", "delete", "create", "none")


def _own_name(target: str, run: str) -> str:
    folder, name = posixpath.split(target)
    return f"{folder}/.{hashlib.sha256(f'{run} {target}'.encode()).hexdigest()[:24]}.{name[-60:]}.part"


def _is_file(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type == fs.FileType.File


def _step(stage: int, run: str, action: str, source: str | None, target: str | None) -> int:
    """One row in one stage; 1 if something was done."""
    store, to = opened.at(target or source)
    _, start = opened.at(source or target)
    part = _own_name(to, run)
    if stage == 1 and action == "copy" and not _is_file(store, part):
        store.create_dir(posixpath.dirname(to), recursive=True)
        with store.open_input_stream(start) as data, store.open_output_stream(part + "~") as out:
            while chunk := data.read(1 << 20):
                out.write(chunk)
        store.move(part + "~", part)
        return 1
    if stage == 2 and action == "move" and not _is_file(store, part):
        store.create_dir(posixpath.dirname(to), recursive=True)
        try:
            store.move(start, part)
        except FileNotFoundError:
            if not _is_file(store, part):  # another attempt of this task may have moved it
                raise
        return 1
    if stage == 2 and action == "delete" and _is_file(store, start):
        store.delete_file(start)
        return 1
    if stage == 3 and action in ("move", "copy") and _is_file(store, part):
        store.move(part, to)
        return 1
    if stage == 3 and action == "create" and not _is_file(store, to):
        store.create_dir(posixpath.dirname(to), recursive=True)
        with store.open_output_stream(to):
            pass
        return 1
    return 0


def _carry_out(stage: int, run: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = [_step(stage, run, *r) for r in rows[["action", "source", "target"]].itertuples(index=False)]
            yield pd.DataFrame({"action": rows["action"], "done": done})

    return work


def _existing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        there = []
        for path in rows["path"]:
            store, name = opened.at(path)
            there.append(_is_file(store, name))
        yield rows.assign(there=there)


def problems(plan: DataFrame) -> DataFrame:
    """path and problem: targets that two rows want (``duplicate``), that exist and stay (``exists``), sources that aren't there (``missing``) or that two moves
    or deletions want (``twice``), rows without an action's names (``incomplete``). A file that is to be created may exist.
    """
    needs_source, needs_target = F.col("action").isin("move", "copy", "delete"), F.col("action").isin("move", "copy", "create")
    acting = plan.where("action <> 'none'")
    incomplete = acting.where((needs_source & F.col("source").isNull()) | (needs_target & F.col("target").isNull()) | ~F.col("action").isin(*ACTIONS))
    out = incomplete.select(F.coalesce("source", "target", "action").alias("path"), F.lit("incomplete").alias("problem"))
    targets = acting.where(needs_target & F.col("target").isNotNull())
    out = out.unionByName(targets.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("duplicate").alias("problem")))
    leaving = acting.where(F.col("action").isin("move", "delete") & F.col("source").isNotNull()).select(F.col("source").alias("path"))
    out = out.unionByName(leaving.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("twice").alias("problem")))
    look = lambda paths: paths.distinct().mapInPandas(_existing, "path string, there boolean")
    taken = look(targets.where("action <> 'create'").select(F.col("target").alias("path"))).where("there").join(leaving.distinct(), "path", "left_anti")
    gone = look(acting.where(needs_source & F.col("source").isNotNull()).select(F.col("source").alias("path"))).where("NOT there")
    return out.unionByName(taken.select("path", F.lit("exists").alias("problem"))).unionByName(gone.select("path", F.lit("missing").alias("problem")))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def run_plan(plan: DataFrame, state: str, dry_run: bool = False) -> DataFrame:
    """Carry out a plan (action, source, target: addresses of files in one store) and return how many steps of each action were done now.

    ``state``: a folder of this plan alone, in a store that all machines share. If it holds a plan, that one is gone on with. A plan with
    :func:`problems` raises ValueError before anything is done. With ``dry_run`` the plan's rows are counted and nothing is done. Sources and targets
    must be normal addresses (no ``..``), so that equal files have equal names.
    """
    spark = plan.sparkSession
    if dry_run:
        return plan.where("action <> 'none'").groupBy("action").agg(F.count("*").alias("steps"))
    saved = f"{state.rstrip('/')}/plan"
    if not _there(spark, f"{saved}/_SUCCESS"):
        wrong = problems(plan).orderBy("problem", "path").limit(5).collect()
        if wrong:
            raise ValueError("; ".join(f"{r.problem}: {r.path}" for r in wrong))
        plan.select("action", "source", "target").where("action <> 'none'").write.mode("overwrite").parquet(saved)
    rows, counted = spark.read.parquet(saved), []
    run = hashlib.sha256(state.rstrip("/").encode()).hexdigest()[:16]
    for stage in (1, 2, 3):
        mark = f"{state.rstrip('/')}/stage-{stage}"
        if not _there(spark, f"{mark}/_SUCCESS"):
            done = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(_carry_out(stage, run), "action string, done int")
            done.groupBy("action").agg(F.sum("done").alias("steps")).write.mode("overwrite").parquet(mark)
            counted.append(spark.read.parquet(mark))
    out = spark.createDataFrame([], "action string, steps long")
    for c in counted:
        out = out.unionByName(c)
    # A move is two steps, a copy, too: they are counted when they reach their target.
    return out.groupBy("action").agg(F.max("steps").alias("steps")).where("steps > 0")

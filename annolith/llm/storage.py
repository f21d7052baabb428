"""Tables between steps, kept in the folder that all machines share.

The folder is ``spark.checkpoint.dir``. A table written there cuts the lineage: when an
executor is lost, later steps read the table again instead of repeating earlier steps.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only when the session has no checkpoint folder and Spark runs on one machine.
LOCAL_FOLDER = "/tmp/checkpoints"

_scope: list[str] = ["default"]
_written: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    """The shared folder. Raises on a cluster that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_FOLDER


def new_path(spark: SparkSession, tag: str) -> str:
    """A path that no other table has."""
    path = f"{root(spark)}/annolith/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(_scope[-1], []).append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with the same schema."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession, name: str, fresh: bool = True):
    """Tables written inside belong to ``name``; those of an earlier use of it are removed first.

    A pipeline stage opens the scope of its pipeline: what the stages before it wrote is no
    longer needed, for their results have been written and read again.
    """
    if fresh:
        release(spark, name)
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def release(spark: SparkSession, name: str = "default") -> None:
    """Delete the tables of a scope. Results that still read them must have been written before."""
    jvm = spark.sparkContext._jvm
    for path in _written.pop(name, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Let go of memory that Python, Arrow and the C library keep for later: after a model was learned, a driver lives on with it for nothing."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)

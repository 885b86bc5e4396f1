"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII white space.
GAP = r"[\x20\x09-\x0D]+"

_ROOT = Path(__file__).resolve().parents[2]
_OWN_SHARED: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SHARED:
        _OWN_SHARED[app] = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return _OWN_SHARED[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage.

    The files outlive any executor. drop_materialized() removes them when no
    DataFrame needs them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a file or folder, wherever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = folder(spark, path)
    fs.delete(at, True)


def drop_materialized(spark: SparkSession) -> int:
    """Deletes what materialize() has written in this process; returns the number of tables."""
    done = 0
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())
        done += 1
    return done


def workers_import_us(spark: SparkSession) -> None:
    """Lets Python workers started on this machine import the package, wherever the driver was started.

    A cluster gets the package by --py-files or an installed wheel instead.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if str(_ROOT) not in paths:
        env["PYTHONPATH"] = ":".join([str(_ROOT), *paths])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], want: str) -> str:
    """want, with underscores in front until no column has that name, whatever its case."""
    low = {c.lower() for c in taken}
    while want.lower() in low:
        want = "_" + want
    return want


def tree_reduced(states: DataFrame, merge: Callable[[bytes, bytes], bytes], depth: int = 2) -> bytes | None:
    """One state out of a column of states, one a partition, merged by pairs in tasks and in few levels; None if there is no partition."""
    parts = states.rdd
    if not parts.getNumPartitions():
        return None
    return parts.map(lambda row: bytes(row[0])).treeReduce(merge, depth)

"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []
_KEPT: dict[tuple[str, ...], DataFrame] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet under spark.checkpoint.dir (a folder of our own where that is unset and all run on this machine), read back without lineage."""
    spark = df.sparkSession
    path = place(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, which drop_written() removes."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own(spark)
    _WRITTEN.append(f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def stamp(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files under the paths: it changes when any of them is written again."""
    seen = []
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.md5(repr(sorted(seen)).encode()).hexdigest()


def kept(spark: SparkSession, label: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written once an application for each label and state of the input files: for tables that many queries derive alike from the same input."""
    key = (spark.sparkContext.applicationId, label, stamp(spark, *inputs))
    if key not in _KEPT:
        _KEPT[key] = written(make(), label)
    return _KEPT[key]


def _own(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return _OWN[app]


def drop_written(spark: SparkSession) -> int:
    """Deletes what written() has written in this process; returns the number of tables."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    _KEPT.clear()
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
        done += 1
    return done


def workers_import_us(spark: SparkSession) -> None:
    """Lets Python workers that start on this machine import the package. A cluster gets it by --py-files or as a wheel."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])

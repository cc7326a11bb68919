"""Tables of the input folder, and results that several steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in that of ``spark.checkpoint.dir``, which all executors share; it goes when the application ends.

    Where the setting is unset a local session uses a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to a workspace and read again, so that what uses it twice computes it once."""
    spark = df.sparkSession
    path = workspace(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: another state, another table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))) if fs.exists(at) else ()


def kept(spark: SparkSession, sf_dir: str, name: str, inputs: Sequence[str], build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """``build`` stored once in an application for the given state of the ``inputs``, so that the queries that start from it share one table."""
    key = (spark.sparkContext.applicationId, name, sf_dir, tuple(_state(spark, f"{sf_dir}/{t}.parquet") for t in inputs))
    if key not in _kept:
        _kept[key] = stored(build(spark, sf_dir))
    return _kept[key]

"""Written tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting that shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where that is unset and all tasks run on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that its lineage ends there.

    Unlike ``checkpoint()``, which computes its input twice, this runs the plan once. The table goes when the application ends,
    the plan's shuffle files as soon as it is written: left to the driver's garbage collection, they pile up on large inputs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``settle`` from the shared folder before the application ends; nothing may read them any more."""
    for df in tables:
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the component being its smallest node.

    Alternates the large-star and small-star steps: each hangs the neighbours of a node below the
    smallest of them, so paths halve and every component ends as a star. A step is a window minimum,
    linear in the edges; nothing is gathered on the driver but whether a step changed anything.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = settle(edges)
    own = Window.partitionBy("u")
    for _ in range(most):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least("u", F.min("v").over(own))
        large = both.withColumn("m", low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = large.withColumn("m", F.min("v").over(own))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = settle(small.select("e.u", "e.v").filter("u <> v").distinct())
        # a forest of stars: every node hangs below one other, which hangs below none
        loose = small.join(small.select(F.col("u").alias("v")), "v", "left_semi")
        done = is_empty(loose) and is_empty(small.groupBy("u").count().filter("count > 1"))
        edges = small
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)

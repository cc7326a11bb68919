"""The model run again on every batch of changed prices, and what that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.plans.published import current, discard, publish, published, stage
from strandline.streaming.keyed import changes, events_in, state_store
from strandline.streaming.live import overlaid

Model = Callable[[DataFrame], DataFrame]


def recompute(base: DataFrame, live_now: DataFrame, model: Model, key: str) -> DataFrame:
    """(key, live, price, verdict) of every row of ``base`` under the live prices (symbol, price): the whole model is run, as ranks compare every row with all others."""
    rows = model(overlaid(base, live_now, key)).select(key, "price", "verdict")
    return rows.join(live_now.select(F.col("symbol").alias(key), F.col("price").alias("live")), key, "left").select(key, "live", "price", "verdict")


def changed_keys(before: DataFrame, after: DataFrame, moved: DataFrame, key: str) -> DataFrame:
    """(key, price_changed, verdict_changed, before, after): rows whose quote moved united with rows whose verdict is another one."""
    old, new = before.select(key, F.col("verdict").alias("before")), after.select(key, F.col("verdict").alias("after"))
    both = new.join(old, key, "left").join(moved.select(F.col("symbol").alias(key), F.lit(True).alias("price_changed")), key, "left")
    both = both.withColumn("price_changed", F.coalesce("price_changed", F.lit(False))).withColumn("verdict_changed", ~F.col("before").eqNullSafe(F.col("after")))
    return both.filter("price_changed OR verdict_changed").select(key, "price_changed", "verdict_changed", "before", "after")


def apply_batch(spark: SparkSession, base: DataFrame, moved: DataFrame, model: Model, key: str, out: str, n: int) -> bool:
    """One batch of moved quotes (symbol, price): publishes the snapshot of version ``n + 1`` and then the keys it changed.

    The snapshot of the version before says which live prices hold besides the moved ones. The changed keys are written to
    ``out/changes/batch=n`` before the snapshot's manifest appears; a batch that is run again after that does nothing, one that
    broke before starts over and replaces what it had written.
    """
    now = current(spark, f"{out}/snapshot")
    if now is not None and now.version > n:
        return False
    before = published(spark, f"{out}/snapshot")
    kept = before.filter("live IS NOT NULL").select(F.col(key).alias("symbol"), F.col("live").alias("price")).join(moved.select("symbol"), "symbol", "left_anti")
    fresh = recompute(base, kept.unionByName(moved.select("symbol", "price")), model, key)
    data = stage(fresh, f"{out}/snapshot")
    try:
        after = spark.read.schema(fresh.schema).parquet(f"{out}/snapshot/{data}")
        changed_keys(before, after, moved, key).write.mode("overwrite").parquet(f"{out}/changes/batch={n}")
        publish(spark, f"{out}/snapshot", data, fresh.schema, n + 1)
    except BaseException:
        discard(spark, f"{out}/snapshot", data)
        raise
    return True


def start_model(spark: SparkSession, base: DataFrame, path: str, checkpoint: str, out: str, model: Model, key: str, files_a_batch: int | None = None, once: bool = True) -> StreamingQuery:
    """Stream of event files over the rows of ``base``: each batch's changed quotes re-run ``model`` and add to ``out/changes`` the keys whose price or verdict changed.

    The first snapshot, of ``base`` without live prices, is published when there is none. ``out/moved`` keeps the quotes of each batch.
    """
    if current(spark, f"{out}/snapshot") is None:
        first = recompute(base, spark.createDataFrame([], "symbol long, price double"), model, key)
        publish(spark, f"{out}/snapshot", stage(first, f"{out}/snapshot"), first.schema, 0)

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/moved/batch={n}")
        session = batch.sparkSession
        apply_batch(session, base, session.read.schema(batch.schema).parquet(f"{out}/moved/batch={n}"), model, key, out, n)

    with state_store(spark):
        writer = changes(events_in(spark, path, files_a_batch)).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()

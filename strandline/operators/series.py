"""Time-series joins and returns over ranges of time: no task holds a whole series, however long one is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.order import numbered, placed
from strandline.plans.tables import stored


def last_known(df: DataFrame, by: Sequence[str], on: str, tie: str, value: Column, name: str) -> DataFrame:
    """``df`` with the column ``name``: the last non-null ``value`` of the series ``by`` at or before each row in the order of (``on``, ``tie``).

    The rows are stored in ranges of (``by``, ``on``, ``tie``). A range finds its own last values; what it begins with is the last
    value of the ranges of its series before it, of which there is a row a range and series. A row without series or time has none.
    """
    named = [F.col(c).isNotNull() for c in (*by, on)]
    for c in named:
        value = F.when(c, value)
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(df.withColumn("_value", value).repartitionByRange(parts, *by, on, tie).withColumn("_part", F.spark_partition_id()))
    order = F.struct(on, tie)
    tails = rows.groupBy(*by, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), order)).alias("_tail"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = tails.withColumn("_begins", F.last("_tail", True).over(ahead)).filter("_begins IS NOT NULL").drop("_tail")
    own = Window.partitionBy(*by, "_part").orderBy(on, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.last("_value", True).over(own)).join(begins, [*by, "_part"], "left")
    placed_at = F.coalesce("_own", "_begins")
    for c in named:
        placed_at = F.when(c, placed_at)
    return rows.withColumn(name, placed_at).drop("_value", "_own", "_begins", "_part")


def asof_backward(left: DataFrame, right: DataFrame, by: str | Sequence[str], on: str, value: str, days: int) -> DataFrame:
    """Adds ``value`` of the last right row at or before the left one, at most ``days`` back, and ``matched_on``.

    ``by`` names the series keys; without any, all rows are one series. Of right rows of one day the largest value counts.
    """
    by = [by] if isinstance(by, str) else list(by)
    kind = right.schema[value].dataType
    feed = right.groupBy(*by, on).agg(F.max(value).alias("_v")).withColumn("_side", F.lit(0))
    both = left.withColumn("_v", F.lit(None).cast(kind)).withColumn("_side", F.lit(1)).unionByName(feed, allowMissingColumns=True)
    found = last_known(both, by, on, "_side", F.when(F.col("_side") == 0, F.struct(F.col("_v").alias("v"), F.col(on).alias("d"))), "_hit").filter("_side = 1")
    near = F.datediff(F.col(on), F.col("_hit.d")) <= days
    return found.select(*left.columns, F.when(near, F.col("_hit.v")).alias(value), F.when(near, F.col("_hit.d")).alias("matched_on"))


def steps_back(series: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """``series`` with ``steps``, 1 for the last point of each key and one more for each point before, and ``n_points``."""
    rows = numbered(placed(series, [by], on, value), [by], on, value, "steps")
    return rows.join(series.groupBy(by).agg(F.count(on).alias("n_points")), by)


def return_n_back(series: DataFrame, by: str, on: str, value: str, n: int) -> DataFrame:
    """Per key: percent change from the point ``n`` before the last (the first, if there are fewer) to the last."""
    picked = steps_back(series, by, on, value).groupBy(by).agg(
        F.max(F.when(F.col("steps") == 1, F.col(value))).alias("_last"),
        F.max(F.when(F.col("steps") == F.least(F.lit(n + 1), F.col("n_points")), F.col(value))).alias("_from"),
        F.max("n_points").alias("_n"),
    )
    return picked.select(by, F.when((F.col("_n") > 1) & (F.col("_from") > 0) & (F.col("_last") > 0), (F.col("_last") / F.col("_from") - 1) * 100).alias("return_pct"))


def return_since(series: DataFrame, by: str, on: str, value: str, anchor: str) -> DataFrame:
    """Per key: percent change from the last point at or before the date ``anchor`` to the last point."""
    before = F.col(on) <= F.lit(anchor).cast("date")
    picked = series.groupBy(by).agg(F.max_by(value, on).alias("_last"), F.max_by(F.when(before, F.col(value)), F.when(before, F.col(on))).alias("_from"))
    return picked.select(by, F.when(F.col("_from") > 0, (F.col("_last") / F.col("_from") - 1) * 100).alias("return_pct"))


def continuity(series: DataFrame, by: str, on: str, value: str, tolerance: float) -> DataFrame:
    """Rows whose value moved more than ``tolerance`` (relative) from the row before."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(on))
    return series.withColumn("previous", before).filter(F.abs(F.col(value) - F.col("previous")) > tolerance * F.col("previous"))


def carried_forward(calendar: DataFrame, series: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """Every (key, date) of ``calendar`` with the last known value and its age in days; null values of ``series`` are none."""
    points = series.filter(F.col(value).isNotNull()).groupBy(by, on).agg(F.max(value).alias("v"))
    rows = calendar.select(by, on).join(points, [by, on], "left")
    rows = last_known(rows.withColumn("_tie", F.lit(0)), [by], on, "_tie", F.when(F.col("v").isNotNull(), F.struct("v", F.col(on).alias("d"))), "_hit")
    return rows.select(by, on, F.col("_hit.v").alias(value), F.datediff(F.col(on), F.col("_hit.d")).alias("stale_days"))

"""Order statistics and ranks that do not gather a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.tables import stored


def placed(df: DataFrame, by: list[str], value: str, key: str, descending: bool = True) -> DataFrame:
    """``df`` in stored ranges of (``by``, ``value``, ``key``): ``_part`` numbers the range, so ties and large groups are split by the key."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(df.repartitionByRange(parts, *by, order, key).withColumn("_part", F.spark_partition_id()))


def numbered(rows: DataFrame, by: list[str], value: str, key: str, name: str, descending: bool = True) -> DataFrame:
    """Row number of the non-null values of each group of rows that ``placed`` has put in ranges; null values have none."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    some = F.col(value).isNotNull()
    above = rows.filter(some).groupBy(*by, "_part").count()  # a row a range and group
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select(*by, "_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_above"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(F.when(some, 0).otherwise(1), order, key))
    out = rows.withColumn("_own", own).join(above, [*by, "_part"], "left")
    return out.withColumn(name, F.when(some, F.col("_own") + F.coalesce("_above", F.lit(0))).cast("long")).drop("_own", "_above", "_part")


def ranked(df: DataFrame, value: str, key: str, name: str = "rank") -> DataFrame:
    """Global row number by ``value`` descending, ``key`` breaking ties; null values have none. No task sees all rows."""
    return numbered(placed(df, [], value, key), [], value, key, name)


def nearest_rank(df: DataFrame, by: list[str], value: str, p: float, name: str, key: str) -> DataFrame:
    """Element floor(n p) of the sorted non-null values of each group, capped at the last: p = 0.5 is the upper median."""
    rows = placed(df.filter(F.col(value).isNotNull()).select(*by, value, key), by, value, key, False)
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    at = F.least(F.col("_n"), F.floor(F.col("_n") * p) + 1)
    return numbered(rows, by, value, key, "_at", False).join(n, by).filter(F.col("_at") == at).select(*by, F.col(value).alias(name))


def exact_median(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Mean of the middle one or two non-null values, as one row."""
    rows = placed(df.filter(F.col(value).isNotNull()).select(value, key), [], value, key, False)
    n = rows.count()
    middle = numbered(rows, [], value, key, "_at", False).filter(F.col("_at").isin((n + 1) // 2, n // 2 + 1))
    return middle.agg(F.avg(value).alias(name))


def nth_value(df: DataFrame, value: str, key: str, n: int, name: str) -> DataFrame:
    """One row: the n-th largest ``value`` and the ``key`` that has it, null if there are fewer."""
    return ranked(df, value, key, "_at").filter(F.col("_at") == n).agg(F.max(value).alias(name), F.max(key).alias(f"{name}_{key}"))

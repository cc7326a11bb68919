"""Lookups with a stated policy for duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.tables import stored


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in ``order``, which must be total; reverse it for last-wins."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).filter("_at = 1").drop("_at")


def unique_only(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once: what is ambiguous matches nothing. Rows without a key are none.

    One aggregate that is combined before its shuffle, so a key of many rows is never in one place.
    """
    own = F.struct(*(F.col(c) for c in df.columns))
    found = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.any_value(own).alias("_row"))
    return found.filter("_n = 1").select("_row.*")


def collisions(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once, with ``n_rows``; the keys are counted first and meet their rows in a join that can be split."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    return df.join(stored(counts), keys).select(*df.columns, "n_rows")


def resolve(rows: DataFrame, stages: list[tuple[str, str, DataFrame]], terminal: Column) -> DataFrame:
    """Waterfall: (method, key column of ``rows``, unique dimension (key, target)) in order, as one left join a stage.

    Adds ``target``, ``method``; where ``terminal`` holds only the first stage may match.
    """
    target, method = F.lit(None).cast("long"), F.lit("none")
    for k, (name, key, dim) in enumerate(stages):
        rows = rows.join(dim.select(F.col(dim.columns[0]).alias(f"_k{k}"), F.col(dim.columns[1]).cast("long").alias(f"_t{k}")), F.col(key) == F.col(f"_k{k}"), "left")
    for k in range(len(stages) - 1, -1, -1):
        hit = F.col(f"_t{k}").isNotNull()
        hit = hit & ~terminal if k else hit
        target, method = F.when(hit, F.col(f"_t{k}")).otherwise(target), F.when(hit, F.lit(stages[k][0])).otherwise(method)
    out = rows.withColumn("target", target).withColumn("method", method)
    return out.drop(*(f"_{c}{k}" for k in range(len(stages)) for c in "kt"))

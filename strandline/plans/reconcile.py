"""Two share counts held against each other, and a third source that says which is right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import ratio_class, rounded
from strandline.operators.order import nearest_rank
from strandline.plans.tables import stored

OUTLIER_PCT = 10.0
AGREES = 0.02


def compared(rows: DataFrame) -> DataFrame:
    """Rows (key, shares, price, factor, other_cap, quote, implied_free) that have both values, with the gap of the other one in percent."""
    full = F.col("shares") * F.col("price")
    rows = rows.withColumn("full_cap", full).filter("full_cap > 0 AND other_cap > 0")
    return rows.withColumn("gap_pct", (F.col("other_cap") - F.col("full_cap")) / F.col("full_cap") * 100)


def adjudicated(rows: DataFrame, threshold: float = OUTLIER_PCT) -> DataFrame:
    """Outliers with status, the third source's side, the share ratio and the corporate action it equals, if any."""
    out = compared(rows).filter(F.abs("gap_pct") > threshold)
    theirs = F.try_divide(F.col("other_cap"), F.when(F.col("quote") > 0, F.col("quote")))
    ratio = F.try_divide(theirs, F.col("shares"))
    third = F.try_divide(F.col("implied_free"), F.col("factor"))
    ours_near: Column = F.abs(F.try_divide(third, F.col("shares")) - 1) < AGREES
    theirs_near = F.abs(F.try_divide(third, theirs) - 1) < AGREES
    side = F.when(third.isNull(), None).when(ours_near, "ours").when(F.coalesce(theirs_near, F.lit(False)), "theirs").otherwise("neither")
    status = F.when(side == "ours", "resolved-ours").when(side == "theirs", "resolved-theirs").otherwise("quarantine")
    exact = ratio_class(ratio)
    cause = F.when(status == "resolved-ours", "third source matches our count").when(status == "resolved-theirs", "third source matches the other count").when(
        exact.isNotNull(), F.concat(F.lit("counts differ by a corporate action of "), F.regexp_replace(rounded(exact, 4).cast("string"), r"\.0$", ""), F.lit(", no third source"))
    ).otherwise("counts differ by no corporate action and no third source covers the company")
    return out.select("key", status.alias("status"), side.alias("agrees_with"), rounded(F.col("gap_pct"), 3).alias("gap_pct"), rounded(ratio, 4).alias("share_ratio"), exact.alias("action"), cause.alias("cause"))


def summary(rows: DataFrame, threshold: float = OUTLIER_PCT) -> DataFrame:
    """One row: rows compared, median of the magnitude of their gaps (the upper one), rows over ``threshold`` and over 5 percent, outliers by status."""
    both = stored(compared(rows).select("key", F.abs("gap_pct").alias("size")))
    middle = nearest_rank(both.withColumn("all", F.lit(0)), ["all"], "size", 0.5, "median_gap", "key").agg(F.max("median_gap")).scalar()
    told = adjudicated(rows, threshold).agg(*(F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("resolved-ours", "resolved-theirs", "quarantine")))
    counts = both.agg(F.count("*").alias("n_compared"), F.count_if(F.col("size") > threshold).alias("n_over"), F.count_if(F.col("size") > 5).alias("n_over_5"))
    return counts.select("n_compared", rounded(middle, 3).alias("median_gap"), "n_over", "n_over_5", *(F.lit(v).cast("long").alias(k) for k, v in told.first().asDict().items()))

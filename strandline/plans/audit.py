"""Coverage, overlap and freshness of the model's tables, and rules that need more than one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.benchmarks import drifted

FEEDS = {"reconciliation": 45, "index lists": 12, "prices": 4, "quotes": 4}
DEFAULT_STALE = 14


def coverage(rows: DataFrame) -> DataFrame:
    """One row of conditional counts over the companies."""
    n = lambda c, name: F.count_if(c).alias(name)
    held = F.col("in_eem") | F.col("in_smin")
    return rows.agg(
        F.count("*").alias("companies"), n(held, "held"), n(~held, "unheld"), n(F.col("factor_a").isNotNull(), "with_a"), n(F.col("factor_b").isNotNull(), "with_b"),
        n(F.col("factor_a").isNotNull() & F.col("factor_b").isNotNull(), "with_both"), n(F.col("ff").isNotNull(), "with_float"), n(held & F.col("ff").isNull(), "held_without_float"),
        n(F.col("rule") == "gap-switch", "switched"), n(F.col("quarantined"), "quarantined"), n(F.col("price") > 0, "priced"), n(F.col("shares").isNotNull(), "with_shares"),
    )


def overlap(rows: DataFrame) -> DataFrame:
    """One row: floor of the standard segment, ceiling of the small-cap one, and where both reach, if the ceiling is above: width, ratio, companies by segment."""
    std, small = (F.when(F.col("segment") == s, F.col("ff")) for s in ("standard", "smallcap"))
    ends = rows.agg(F.min(std).alias("lo"), F.max(small).alias("hi"))
    both = rows.join(F.broadcast(ends), (F.col("hi") > F.col("lo")) & F.col("ff").between(F.col("lo"), F.col("hi")))  # one row
    inside = both.agg(*(F.count_if(F.col("segment") == s).alias(f"n_{s}") for s in ("standard", "smallcap", "outside")))
    out = ends.join(inside)  # one row each
    some = F.col("hi") > F.col("lo")
    return out.select("lo", "hi", F.when(some, F.col("hi") - F.col("lo")).alias("width"), F.when(some, F.col("hi") / F.col("lo")).alias("ratio"), "n_standard", "n_smallcap", "n_outside")


def with_zero_rows(totals: DataFrame, by: str, values: tuple[str, ...]) -> DataFrame:
    """``totals`` with a row for every one of ``values``; sums and counts of what has no rows are 0."""
    every = totals.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    return every.join(totals, by, "left").fillna(0)


def weight_coverage(rows: DataFrame, weight: str, matched: Column) -> DataFrame:
    """One row: rows and weight in all and matched, and the matched share of the weight."""
    w = F.col(weight)
    out = rows.agg(F.count("*").alias("n"), F.count_if(matched).alias("n_matched"), F.sum(w).alias("weight"), F.sum(F.when(matched, w)).alias("weight_matched"))
    return out.withColumn("share", F.try_divide("weight_matched", "weight"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, keys that occur more than once, rows without key. Counted by key first, so no set of all keys is built."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"))
    some = F.col(key).isNotNull()
    return per.agg(F.sum("n").alias("n_rows"), F.count_if(some).alias("n_keys"), F.count_if(some & (F.col("n") > 1)).alias("n_repeated"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("n_null"))


def first_known(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """First non-null ``value`` of each group in ``order``."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value))


def latest_by(rows: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.max(on).alias(on), *(F.max_by(v, on).alias(v) for v in values))


def freshness(feeds: DataFrame, today: Column) -> DataFrame:
    """(feed, as_of) with age, allowed age, whether it is stale, and whether it is the oldest, which governs."""
    allowed = F.lit(DEFAULT_STALE)
    for name, days in FEEDS.items():
        allowed = F.when(F.col("feed") == name, days).otherwise(allowed)
    oldest = feeds.agg(F.min_by("feed", F.struct("as_of", "feed"))).scalar()
    rows = feeds.withColumn("age_days", F.datediff(today, F.col("as_of"))).withColumn("allowed_days", allowed)
    return rows.withColumn("stale", F.col("age_days") > F.col("allowed_days")).withColumn("governs", F.col("feed") == oldest)


def both_signs(rows: DataFrame, value: str) -> DataFrame:
    """One row: whether there are values on both sides of zero, or none at all."""
    return rows.agg(((F.count(value) == 0) | (F.coalesce(F.bool_or(F.col(value) > 0), F.lit(False)) & F.coalesce(F.bool_or(F.col(value) < 0), F.lit(False)))).alias("ok"))


def magnitude_problems(rows: DataFrame, independent: DataFrame, key: str) -> DataFrame:
    """Rows (key, full) whose value is a hundred times off an independent one (key, other), or tiny although that one is large."""
    both = rows.join(independent, key)
    ratio = F.try_divide("full", "other")
    why = F.when(~ratio.between(0.01, 100), "magnitude").when((F.col("other") >= 2e10) & (F.col("full") < 1e5), "small rupees")
    return both.withColumn("problem", why).filter("problem IS NOT NULL").select(key, "problem")


def price_evidence(seed: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """One row: how many seed prices equal the day's close and how many are within a percent of it."""
    both = seed.join(prices, key).filter("seed_price > 0 AND close > 0")
    gap = F.abs(F.col("close") - F.col("seed_price")) / F.col("seed_price")
    return both.agg(F.count("*").alias("n"), F.count_if(gap < 1e-4).alias("exact"), F.count_if(gap < 0.01).alias("near"))


def uncovered(seed: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """Seed rows that nothing tracks although they are listed somewhere."""
    return seed.filter("listing <> 'neither'").join(tracked.select(key), key, "left_anti")


def close_mismatches(today: DataFrame, before: DataFrame, key: str, tolerance: float = 0.011) -> DataFrame:
    """Rows whose previous close of today is not yesterday's close; stale rows and rows of the same trade date are not compared."""
    old = before.filter("stale_days = 0").select(key, F.col("close").alias("yesterday"), F.col("trade_date").alias("old_date"))
    both = today.join(old, key).filter("prev_close IS NOT NULL AND yesterday IS NOT NULL AND trade_date > old_date")
    return both.filter(F.abs(F.col("prev_close") - F.col("yesterday")) > tolerance).select(key, "prev_close", "yesterday")


def snapshot_moves(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after, moved) of two snapshots, a row a field."""
    both = old.select(key, F.struct(*fields).alias("o")).join(new.select(key, F.struct(*fields).alias("n")), key)
    lines = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("double").alias("before"), F.col(f"n.{f}").cast("double").alias("after")) for f in fields))
    return both.select(key, F.explode(lines).alias("l")).select(key, "l.*").withColumn("moved", ~F.col("before").eqNullSafe(F.col("after")))


def drift_members(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Drift of every fund weight since the capture price, which is the price a percent or two away by key."""
    captured = F.col("price") * (1 + (F.col("p_partkey") % 5 - 2) / 100)
    value = rows.select("p_partkey", (F.col("shares") * F.col("price")).alias("now"), (F.col("shares") * captured).alias("captured"))
    return drifted(weights.join(value, "p_partkey"))

"""Live quotes as a stream: latest value by key, changed keys, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import change_pct, price_choice

QUOTE = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def quotes(events: DataFrame) -> DataFrame:
    """(symbol, price, received_at, event_id) and why a row is none: reject_reason."""
    why = F.when(F.col("event_type") == "error", "status").when(F.col("value").isNull() | ~(F.col("value") > 0) | F.isnan("value") | (F.col("value") == float("inf")), "no price")
    return events.select(F.col("user_id").alias("symbol"), F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("received_at"), "event_id", why.alias("reject_reason"))


def latest(rows: DataFrame) -> DataFrame:
    """Last good quote of each symbol by (received_at, event_id)."""
    good = rows.filter("reject_reason IS NULL")
    return good.groupBy("symbol").agg(F.max_by("price", F.struct("received_at", "event_id")).alias("price"), F.max("received_at").alias("received_at"), F.max_by("event_id", F.struct("received_at", "event_id")).alias("event_id"))


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """Symbols whose price is new or another one."""
    old = before.select("symbol", F.col("price").alias("old_price"))
    return now.join(old, "symbol", "left").filter(~F.col("price").eqNullSafe(F.col("old_price"))).select("symbol", "old_price", "price")


def absent(requested: DataFrame, received: DataFrame) -> DataFrame:
    """Dead letters for symbols that were asked for and did not come."""
    return requested.select("symbol").join(received.select("symbol"), "symbol", "left_anti").withColumn("reject_reason", F.lit("absent"))


def in_session(rows: DataFrame, open_now: Column) -> DataFrame:
    """Quotes received while the market is open."""
    return rows.filter(open_now)


def overlaid(base: DataFrame, quotes_now: DataFrame, key: str) -> DataFrame:
    """Company rows under live prices: price, tier, exchange, previous close, days of staleness, day change and free float follow the quote where there is one.

    Without a quote they are those of the end of the day, whose price stays beside in any case. ``prev_close`` and ``stale_days`` are read
    where ``base`` has them; a quote may bring a ``prev_close`` of its own, which then counts before the stored one.
    """
    own = lambda c, kind: F.col(c) if c in base.columns else F.lit(None).cast(kind)
    theirs = F.col("prev_close") if "prev_close" in quotes_now.columns else F.lit(None).cast("double")
    now = quotes_now.select(F.col("symbol").alias(key), F.col("price").alias("_live"), theirs.alias("_live_before"))
    rows = base.join(now, key, "left").withColumn("eod_price", F.col("price"))
    choice = price_choice(F.col("_live"), F.col("_live_before"), F.col("eod_price"), own("prev_close", "double"), own("stale_days", "int"))
    rows = rows.withColumn("_c", choice)
    kept = {"price": "price", "tier": "tier", "exchange": "exchange", "prev_close": "before", "stale_days": "stale_days"}
    rows = rows.withColumns({name: F.col(f"_c.{c}") for name, c in kept.items()}).withColumn("day_change_pct", change_pct(F.col("price"), F.col("prev_close")))
    ff = F.floor(F.col("factor") * F.col("shares") * F.col("price") + 0.5)
    return rows.withColumn("ff", F.when(F.col("ff").isNotNull(), ff)).drop("_c", "_live", "_live_before")


def verdict_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after) of the rows whose verdict differs."""
    old, new = before.select(key, F.col("verdict").alias("before")), after.select(key, F.col("verdict").alias("after"))
    return old.join(new, key).filter(~F.col("before").eqNullSafe(F.col("after")))

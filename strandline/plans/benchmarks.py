"""Benchmark returns in the series' own currency and converted, basket returns and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import passive_drift, rounded
from strandline.operators.series import asof_backward, steps_back

WINDOWS = (("1d", 1), ("1m", 21), ("3m", 63), ("1y", 250))


def change(last: Column, first: Column, converted: bool) -> Column:
    """Percent change between two points (d, close, rate); converted ones need both rates."""
    price = F.try_divide(last["close"], first["close"])
    fine = (last["d"] > first["d"]) & (first["close"] > 0) & (last["close"] > 0)
    if converted:
        price = F.try_divide(last["close"] * last["rate"], first["close"] * first["rate"])
        fine = fine & (last["rate"] > 0) & (first["rate"] > 0)
    return F.when(fine, (price - 1) * 100)


def summary(series: DataFrame, rates: DataFrame, anchor: str, days: int = 7) -> DataFrame:
    """(name, horizon, own_pct, converted_pct, fx_pp, measured_from): the windows and the return since ``anchor``.

    ``series`` (name, d, close), ``rates`` (d, rate) of one pair of currencies; a rate may be ``days`` old. A window longer than the series begins with it.
    """
    rated = asof_backward(series, rates, [], "d", "rate", days)
    rows = steps_back(rated, "name", "d", "close").withColumnsRenamed({"steps": "at", "n_points": "n"})
    point = F.struct("d", "close", "rate")
    pick = lambda cond: F.max(F.when(cond, point))  # noqa: E731  one row fits
    before = F.col("d") <= F.lit(anchor).cast("date")
    got = rows.groupBy("name").agg(
        pick(F.col("at") == 1).alias("last"), F.max_by(F.when(before, point), F.when(before, F.col("d"))).alias("since"),
        *(pick(F.col("at") == F.least(F.lit(k + 1), F.col("n"))).alias(label) for label, k in WINDOWS),
    )
    last = F.col("last")
    lines = [F.struct(F.lit(label).alias("horizon"), rounded(change(last, F.col(label), False), 3).alias("own_pct"), rounded(change(last, F.col(label), True), 3).alias("converted_pct"), F.col(f"{label}.d").alias("measured_from")) for label in [w for w, _ in WINDOWS] + ["since"]]
    out = got.select("name", F.explode(F.array(*lines)).alias("r")).select("name", "r.*")
    return out.withColumn("fx_pp", rounded(F.col("converted_pct") - F.col("own_pct"), 3))


def newest_and_lag(series: DataFrame) -> DataFrame:
    """(name, last_date, lag_days): how far each series is behind the newest one."""
    own = series.groupBy("name").agg(F.max("d").alias("last_date"))
    return own.withColumn("lag_days", F.datediff(own.agg(F.max("last_date")).scalar(), F.col("last_date")))


def basket_returns(members: DataFrame) -> DataFrame:
    """(fund, basket): value now over value at capture, over members (fund, now, captured) that have both."""
    both = F.col("now").isNotNull() & F.col("captured").isNotNull()
    return members.filter(both).groupBy("fund").agg(F.try_divide(F.sum("now"), F.sum("captured")).alias("basket"))


def drifted(members: DataFrame) -> DataFrame:
    """``members`` (fund, key, weight, now, captured) with implied weight and drift since capture."""
    rows = members.join(F.broadcast(basket_returns(members)), "fund", "left")  # one row a fund
    return rows.withColumn("drift", passive_drift(F.col("weight"), F.try_divide(F.col("now"), F.col("captured")), F.col("basket")))

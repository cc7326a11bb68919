"""Scalar functions of the model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REVIEW_MONTHS = (2, 5, 8, 11)


def rounded(c: Column, places: int = 0) -> Column:
    """Half up toward plus infinity, unlike ``round``."""
    k = 10.0**places
    return F.floor(c * k + 0.5) / k


def normalised_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"\b(LIMITED|LTD|THE|COMPANY|CO)\b", ""), "[^A-Z0-9]", "")


def normalised_ticker(c: Column) -> Column:
    return F.translate(F.upper(F.trim(c)), ".", "-")


def ticker_class(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.isNull() | t.isin("", "--", "-"), "none").when(t.rlike(r"^\d+$"), "bse-code").otherwise("nse")


def company_key(isin: Column, code: Column) -> Column:
    return F.coalesce(isin, F.concat(F.lit("bse:"), code.cast("string")))


def days_of_volume(shares: Column, volume: Column) -> Column:
    """Null where the volume is unknown or zero, never 0."""
    return F.when(volume > 0, F.abs(shares) / volume)


def change_pct(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) / before * 100)


def last_business_day(d: Column) -> Column:
    end = F.last_day(d)
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def next_review(d: Column) -> Column:
    """First last-business-day of a review month after ``d``."""
    months = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.add_months(F.trunc(d, "month"), i))
    ends = F.transform(F.filter(months, lambda m: F.month(m).isin(*REVIEW_MONTHS)), lambda m: last_business_day(m))
    return F.array_min(F.filter(ends, lambda e: e > d))


def market_open(ts: Column, opens: int = 9 * 60 + 15, closes: int = 15 * 60 + 30) -> Column:
    """Weekday and minute within the window, both ends included; ``ts`` is local exchange time."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (F.weekday(ts) < 5) & minute.between(opens, closes)


def ratio_class(r: Column, tolerance: float = 0.002) -> Column:
    """First listed corporate-action ratio, or its reciprocal, within the tolerance."""
    # Fixed values.
    listed = (10.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.25)
    out = F.lit(None).cast("double")
    for v in reversed([x for k in listed for x in (k, 1 / k)]):
        out = F.when(F.abs(r - v) / v <= tolerance, F.lit(v)).otherwise(out)
    return out


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet will not take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


CRORE = 1e7


def crore(c: Column) -> Column:
    return c / CRORE


def distance_to(value: Column, threshold: Column) -> Column:
    """Percent that ``value`` is from a positive threshold."""
    return F.when(threshold > 0, (value - threshold) / threshold * 100)


def flow_primitives(aum_usd: Column, fx: Column) -> Column:
    """Rupees a point and a basis point of a fund's weight."""
    point = aum_usd * fx / 100
    return F.struct(point.alias("inr_per_point"), (point / 100).alias("inr_per_bp"), crore(point).alias("crore_per_point"))


def passive_drift(weight: Column, stock: Column, basket: Column) -> Column:
    """What a weight has become by price alone since it was read: implied weight and drift in points; it needs no trade."""
    fine = weight.isNotNull() & stock.isNotNull() & ~F.isnan(stock) & (basket > 0)
    implied = F.when(fine, weight * (stock / basket))
    return F.when(fine, F.struct(weight.alias("weight"), implied.alias("implied"), (implied - weight).alias("drift_pp"), F.lit(False).alias("requires_trade")))


def price_choice(live: Column, live_before: Column, close: Column, before: Column, stale_days: Column) -> Column:
    """Live price, else end of day, else none, with the tier that says which."""
    fine = lambda c: (c > 0) & ~F.isnan(c) & (c < float("inf"))
    eod = F.struct(close.alias("price"), before.alias("before"), F.when(F.coalesce(stale_days, F.lit(0)) > 0, "stale").otherwise("eod").alias("tier"), F.lit("BSE").alias("exchange"), F.coalesce(stale_days, F.lit(0)).alias("stale_days"))
    now = F.struct(live.alias("price"), F.coalesce(live_before, before).alias("before"), F.lit("live").alias("tier"), F.lit("NSE").alias("exchange"), F.lit(0).alias("stale_days"))
    return F.when(fine(live), now).when(fine(close), eod)


def derived_factor(implied: Column, shares: Column) -> Column:
    """Implied free shares over all shares, six places, in (0, 1.02] or null."""
    f = rounded(F.try_divide(implied, shares), 6)
    return F.when((f > 0) & (f <= 1.02), f)


def recent_isin(c: Column) -> Column:
    """The stricter of two patterns in use: a digit at the end."""
    return c.rlike(r"^IN[A-Z0-9]{9}\d$")


def listed_isin(c: Column) -> Column:
    return c.rlike("^IN[A-Z0-9]{10}$")


def listing_class(bse: Column, nse: Column) -> Column:
    b, n = (F.coalesce(F.trim(c), F.lit("")) != "" for c in (bse, nse))
    return F.when(b & n, "both").when(b, "bse-only").when(n, "nse-only").otherwise("neither")


def float_over_full(free: Column, full: Column) -> Column:
    """Reason to reject a free float above the full value, null where there is none."""
    return F.when(free > full * 1.001, F.lit("free float above full value"))


def previous_review(d: Column) -> Column:
    """Last last-business-day of a review month at or before ``d``."""
    months = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.add_months(F.trunc(d, "month"), -i))
    ends = F.transform(F.filter(months, lambda m: F.month(m).isin(*REVIEW_MONTHS)), lambda m: last_business_day(m))
    return F.array_max(F.filter(ends, lambda e: e <= d))


def upcoming_reviews(d: Column, n: int) -> Column:
    """The next ``n`` reviews after ``d``, in order."""
    months = F.transform(F.sequence(F.lit(0), F.lit(3 * n + 3)), lambda i: F.add_months(F.trunc(d, "month"), i))
    ends = F.transform(F.filter(months, lambda m: F.month(m).isin(*REVIEW_MONTHS)), lambda m: last_business_day(m))
    return F.slice(F.filter(ends, lambda e: e > d), 1, n)


#: Time zone, first and last minute of the sessions, Monday to Friday.
SESSIONS = {"india": ("Asia/Kolkata", 9 * 60 + 15, 15 * 60 + 30), "usa": ("America/New_York", 9 * 60 + 30, 16 * 60)}


def in_market_hours(utc: Column, market: str) -> Column:
    """Whether a market is in session at an instant, by its own clock; holidays are not known."""
    zone, opens, closes = SESSIONS[market]
    return market_open(F.from_utc_timestamp(utc, zone), opens, closes)


def india_time(utc: Column) -> Column:
    return F.from_utc_timestamp(utc, "Asia/Kolkata")


def latest_trade_date(utc: Column) -> Column:
    """The last weekday whose session has ended in India."""
    t = india_time(utc)
    d = F.when(F.hour(t) * 60 + F.minute(t) > 15 * 60 + 30, t.cast("date")).otherwise(F.date_sub(t.cast("date"), 1))
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    codes = F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1 "), " "), lambda x: x != "")
    start = F.lit(2166136261).cast("long")
    step = lambda h, x: ((h.bitwiseXOR(F.conv(x, 16, 10).cast("long"))) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(codes, start, step)


def file_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def canonical_set(symbols: Column) -> Column:
    """Canonical form of a set of symbols: trimmed, upper case, distinct, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(symbols, lambda s: F.upper(F.trim(s))), lambda s: s != ""))), ",")

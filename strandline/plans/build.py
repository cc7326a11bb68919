"""The company records as a whole: holdings, exchange masters, a seed list, prices, floats, volumes and findings to one row a company with its verdict."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.parse import first_with_source
from strandline.functions.scalar import change_pct, company_key, price_choice
from strandline.plans.company import verdicts
from strandline.plans.records import appended, company_slots, quarantined, split_seed, with_float, with_side
from strandline.plans.tables import stored

FUNDS = ("eem", "smin", "eems")
#: Why a held company has no scrip.
NO_SCRIP = "listed on the other exchange alone"


@dataclass(frozen=True)
class Sources:
    """What a build reads; each is a table with the columns named here, in any order and with others beside.

    holdings: fund, ord, isin, scrip_code, symbol, symbol_source, name, weight_pct, quantity, value_usd (resolved). scrips: ord, scrip_code,
    isin, name, sector, kind, full_cap, price, shares, factor. symbols: isin, symbol, symbol_source. seed: ord, isin, name, symbol, scrip_code, cap, sector.
    floats: ord, symbol, implied_shares, rupees. prices: ord, scrip_code, close, prev_close, stale_days, trade_date. volumes: ord, symbol, detail_3m,
    batch_3m, batch_10d. findings: isin, cause, gap_pct.
    """

    holdings: DataFrame
    scrips: DataFrame
    symbols: DataFrame
    seed: DataFrame
    floats: DataFrame
    prices: DataFrame
    volumes: DataFrame
    findings: DataFrame


def universe(s: Sources, funds: Sequence[str] = FUNDS) -> tuple[DataFrame, DataFrame]:
    """(key, isin, scrip_code, seed_code, name, symbol, symbol_source, seed_sector, via, no_scrip_reason, a slot a fund): what the funds hold, then scrips that none
    holds, then seed rows that neither has; and the side list of seed rows that are listed nowhere."""
    held = company_slots(s.holdings, funds, ["name", "symbol", "symbol_source"]).withColumns({"via": F.lit("holdings"), "no_scrip_reason": F.when(F.col("scrip_code").isNull(), NO_SCRIP)})
    named = s.symbols.select(F.col("isin").alias("_isin"), "symbol", "symbol_source")
    scrips = s.scrips.select("ord", company_key(F.col("isin"), F.col("scrip_code")).alias("key"), "isin", "scrip_code", "name", F.lit("scrips").alias("via"))
    scrips = scrips.join(named, F.col("isin") == F.col("_isin"), "left").drop("_isin")
    both = stored(appended(held, scrips))
    fresh, side = split_seed(s.seed, both)
    sectors = s.seed.select("ord", F.col("sector").alias("seed_sector"))
    fresh = fresh.join(sectors, "ord", "left").withColumns({"via": F.lit("seed"), "symbol_source": F.when(F.col("symbol").isNotNull(), "seed")})
    return appended(both, fresh), side


def company_records(s: Sources, funds: Sequence[str] = FUNDS) -> DataFrame:
    """One record a company: identity, slots, scrip data, float choice, price with its tier, volume with its source, quarantine, segment and verdict."""
    rows, _ = universe(s, funds)
    rows = with_side(rows, s.scrips, [("scrip_code", "scrip_code"), ("isin", "isin")], "ord", "scrip")
    rows = with_side(rows, s.floats, [("symbol", "symbol")], "ord", "nse")
    rows = with_side(rows, s.prices, [("scrip_code", "scrip_code")], "ord", "eod")
    rows = with_side(rows, s.volumes, [("symbol", "symbol")], "ord", "vol")
    rows = quarantined(rows, s.findings, "isin")
    rows = rows.withColumns({
        "name": F.coalesce("scrip.name", "name"), "sector": F.coalesce("scrip.sector", "seed_sector"), "sector_source": F.when(F.col("scrip.sector").isNotNull(), "scrips").when(F.col("seed_sector").isNotNull(), "seed"),
        "kind": F.col("scrip.kind"), "full_cap": F.col("scrip.full_cap"), "scrip_price": F.col("scrip.price"), "shares": F.col("scrip.shares"), "factor_bse": F.col("scrip.factor"), "implied_nse": F.col("nse.implied_shares"), "rupees_nse": F.col("nse.rupees"),
    })
    none = F.lit(None).cast("double")
    rows = rows.withColumn("_price", price_choice(none, none, F.col("eod.close"), F.col("eod.prev_close"), F.col("eod.stale_days")))
    rows = rows.withColumns({"price": F.col("_price.price"), "prev_close": F.col("_price.before"), "price_tier": F.col("_price.tier"), "price_exchange": F.col("_price.exchange"), "stale_days": F.col("_price.stale_days"), "price_date": F.col("eod.trade_date")})
    rows = with_float(rows).withColumn("day_change_pct", change_pct(F.col("price"), F.col("prev_close")))
    volume = first_with_source({"detail-3m": F.col("vol.detail_3m"), "batch-3m": F.col("vol.batch_3m"), "batch-10d": F.col("vol.batch_10d")})
    rows = rows.withColumns({"adv": volume["value"], "adv_source": F.when(volume["value"].isNotNull(), volume["source"])})
    in_fund = {f: F.col(f).isNotNull() for f in funds}
    segment = F.when(in_fund["eem"], "standard").when(in_fund["smin"], "smallcap").otherwise("outside")
    rows = rows.withColumns({"held": F.coalesce(*(F.when(c, True) for c in in_fund.values()), F.lit(False)), "segment": segment, "in_eems": in_fund["eems"], "quarantined": F.col("quarantine").isNotNull()})
    rows = stored(rows.withColumn("p_partkey", F.col("key")).drop("scrip", "nse", "eod", "vol", "_price", "seed_sector"))
    return verdicts(rows).drop("p_partkey", "in_eems")

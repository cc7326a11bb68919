"""Company records: fund slots of the holdings, appended companies, enrichment sides, the float choice, the observed boundary, coverage by fund."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import company_key, derived_factor, listed_isin, rounded
from strandline.operators.lookup import one_per_key
from strandline.operators.order import exact_median, numbered, placed, ranked
from strandline.plans.tables import stored

SLOT = ("weight_pct", "quantity", "value_usd")


def india_equity(holdings: DataFrame) -> DataFrame:
    """The slice of a fund's holdings (location, asset_class) that the model is about."""
    return holdings.filter((F.col("location") == "India") & (F.col("asset_class") == "Equity"))


def company_slots(holdings: DataFrame, funds: Sequence[str], identity: Sequence[str], order: str = "ord") -> DataFrame:
    """One row a company: what its first holding says of it, a slot {weight_pct, quantity, value_usd} for each fund, and how many holdings it has.

    ``holdings`` (fund, isin, scrip_code, the columns of ``identity`` and of a slot) in the order of ``order``, the place in the file carried
    along (any column that can be ordered, total within a company). The key is the ISIN, else the scrip code; holdings with neither belong to no company. The last holding of a fund fills its
    slot; a null slot is a fund that does not hold the company, which is not a weight of zero. Both orders are taken in one
    aggregate that is combined before its shuffle.
    """
    rows = holdings.withColumn("key", company_key(F.col("isin"), F.col("scrip_code"))).filter("key IS NOT NULL")
    slot = F.struct(*SLOT)
    own = [F.max_by(F.when(F.col("fund") == f, slot), F.when(F.col("fund") == f, F.col(order))).alias(f) for f in funds]
    out = rows.groupBy("key").agg(F.min_by(F.struct("isin", "scrip_code", *identity), order).alias("_id"), *own, F.count("*").alias("n_holdings"))
    return out.select("key", "_id.*", *funds, "n_holdings")


def appended(companies: DataFrame, others: DataFrame, key: str = "key") -> DataFrame:
    """``companies`` and those of ``others`` whose key is not there yet, the first of each key by ``ord``; columns that one side lacks are null."""
    fresh = one_per_key(others.filter(F.col(key).isNotNull()), [key], [F.col("ord")]).join(companies.select(key), key, "left_anti").drop("ord")
    return companies.unionByName(fresh, allowMissingColumns=True)


def split_seed(seed: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seed rows (ord, isin, name, symbol, scrip_code, cap) that no company has, as rows to append and as a side list of those that are listed nowhere, with the reason.

    A seed's scrip code is kept beside as ``seed_code`` only: the active master does not have it, so it is no scrip to ask for. Why there
    is no scrip is said in words.
    """
    listing = F.coalesce(F.trim("scrip_code"), F.lit("")) != ""
    rows = seed.withColumn("key", company_key(F.col("isin"), F.when(listing, F.col("scrip_code")))).filter("key IS NOT NULL")
    rows = rows.join(companies.select("key"), "key", "left_anti")
    nowhere = ~listing & (F.coalesce(F.trim("symbol"), F.lit("")) == "")
    side = rows.filter(nowhere).select("isin", "name", "cap", F.lit("the list names no code on either exchange, so neither can be asked").alias("reason"))
    why = F.when(listing, F.concat(F.lit("code "), F.col("scrip_code"), F.lit(" of the list is not active in any segment"))).otherwise("listed on the other exchange alone")
    return rows.filter(~nowhere).select("ord", "key", "isin", "name", "symbol", F.when(listing, F.col("scrip_code")).alias("seed_code"), why.alias("no_scrip_reason")), side


def with_side(rows: DataFrame, side: DataFrame, keys: Sequence[tuple[str, str]], order: str, name: str) -> DataFrame:
    """``rows`` with the struct ``name`` of the first row of ``side`` by ``order`` that has the row's key.

    ``keys`` are pairs (column of ``rows``, column of ``side``): a row asks by the first key that it has and by no other, say by code
    and, only without one, by ISIN. All kinds of key meet in one join on (kind, key), one shuffle however many there are.
    """
    kind, value = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, (own, _) in reversed(list(enumerate(keys))):
        kind, value = F.when(F.col(own).isNotNull(), k).otherwise(kind), F.when(F.col(own).isNotNull(), F.col(own).cast("string")).otherwise(value)
    payload = F.struct(*(c for c in side.columns if c != order))
    asked = [F.struct(F.lit(k).alias("_kind"), F.col(c).cast("string").alias("_key")) for k, (_, c) in enumerate(keys)]
    known = side.select(F.explode(F.array(*asked)).alias("a"), order, payload.alias(name)).select("a.*", order, name).filter("_key IS NOT NULL")
    known = known.groupBy("_kind", "_key").agg(F.min_by(name, order).alias(name))
    return rows.withColumns({"_kind": kind, "_key": value}).join(known, ["_kind", "_key"], "left").drop("_kind", "_key")


def quarantined(rows: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``quarantine`` {reason, gap_pct}: what a list of findings (key, cause, gap_pct) says of a share count, null where it says nothing."""
    said = findings.groupBy(key).agg(F.max_by(F.struct(F.coalesce("cause", F.lit("the share count could not be corroborated")).alias("reason"), "gap_pct"), F.abs("gap_pct")).alias("quarantine"))
    return rows.join(said, key, "left")


#: Percent by which two float factors may differ before the second exchange's counts.
SWITCH_PCT = 2.0


#: The rules by which one of two float factors counts.
RULES = ("nse-preferred-on-material-gap", "bse-primary", "bse-only", "nse-only", "nse-only-published-rupees")


def float_gap(primary: Column, other: Column) -> Column:
    """Percent by which the second factor is above the first, which has to be above zero."""
    return F.when((primary > 0) & other.isNotNull(), rounded((other - primary) / primary * 100, 3))


def float_rule(primary: Column, other: Column, gap: Column, threshold: float) -> Column:
    """Which rule decides between two factors; null where there is neither."""
    both = primary.isNotNull() & other.isNotNull()
    preferred, first, alone, second, _ = RULES
    return F.when(both & (F.abs(gap) > threshold), preferred).when(both, first).when(primary.isNotNull(), alone).when(other.isNotNull(), second)


def float_why(rule: Column, gap: Column, threshold: float) -> Column:
    """The rule in words."""
    apart = F.concat(F.lit("both publish, "), F.when(gap.isNotNull(), F.format_string("%.3f", F.abs(gap))).otherwise("an unknown share"))
    says = (
        F.concat(apart, F.lit(f" % apart, beyond {threshold:g} %: the second counts")), F.concat(apart, F.lit(f" % apart, within {threshold:g} %: the first stands")), F.lit("the second publishes none to compare"),
        F.lit("the first has no reading"), F.lit("no full value to form a factor from; the second exchange publishes rupees"),
    )
    out = F.lit(None).cast("string")
    for name, text in zip(RULES, says, strict=True):
        out = F.when(rule == name, text).otherwise(out)
    return out


def with_float(rows: DataFrame, threshold: float = SWITCH_PCT) -> DataFrame:
    """``rows`` (shares, price, full_cap, factor_bse, implied_nse, rupees_nse) with factor_nse, gap_pct, choice {rule, chose, gap_pct, threshold_pct, why}, factor, ff_at_capture, ff, basis, source.

    The second exchange's factor is its implied free shares over all shares, where that can be a factor at all. The free float is factor times full value, brought to
    the price in force; where that cannot be formed the rupees that the second exchange publishes count.
    """
    bse, nse = F.col("factor_bse"), F.col("factor_nse")
    rows = rows.withColumn("factor_nse", derived_factor(F.col("implied_nse"), F.when(F.col("shares") > 0, F.col("shares"))))
    rows = rows.withColumn("gap_pct", float_gap(bse, nse)).withColumn("_rule", float_rule(bse, nse, F.col("gap_pct"), threshold))
    rows = rows.withColumn("factor", F.when(F.col("_rule").startswith("nse"), nse).otherwise(bse))
    formed = F.col("_rule").isNotNull() & F.col("full_cap").isNotNull()
    rows = rows.withColumn("_how", F.when(formed, "formed").when(F.col("rupees_nse") > 0, "published"))
    rows = rows.withColumn("_rule", F.when(F.col("_rule").isNull() & (F.col("_how") == "published"), RULES[-1]).otherwise(F.col("_rule")))
    how, rule = F.col("_how"), F.col("_rule")
    chose = F.left(rule, F.lit(3))
    compared = F.when(rule.isin(*RULES[:2]), F.col("gap_pct"))
    choice = F.struct(rule.alias("rule"), chose.alias("chose"), compared.alias("gap_pct"), F.lit(float(threshold)).alias("threshold_pct"), float_why(rule, compared, threshold).alias("why"))
    rows = rows.withColumns({
        "choice": F.when(rule.isNotNull(), choice), "ff_at_capture": F.when(how == "formed", rounded(F.col("factor") * F.col("full_cap"))).when(how == "published", rounded(F.col("rupees_nse"))),
        "source": F.when(how == "formed", chose).when(how == "published", "nse"), "_again": F.when(F.col("price") > 0, rounded(F.col("factor") * F.col("shares") * F.col("price"))),
    })
    basis = F.when(F.col("_again").isNotNull(), "factor x shares x price").when(how == "formed", "factor x full value").when(how == "published", "published rupees of the second exchange")
    return rows.withColumns({"ff": F.coalesce("_again", "ff_at_capture"), "basis": basis}).drop("_rule", "_how", "_again")


def boundary_record(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The observed boundary of ``rows`` (key, name, segment, ff) as one record of counts, floor, ceiling, overlap, rank cutoff, a percentile and three medians.

    Positions come from ranges with carried counts; the record itself is two aggregates. Ties go by ``key``.
    """
    rows = stored(rows.select(key, name, "segment", F.col("ff").cast("double").alias("ff")).filter("ff IS NOT NULL"))
    rows = ranked(rows, "ff", key, "place")
    rows = stored(numbered(placed(rows, ["segment"], "ff", key, False), ["segment"], "ff", key, "at", False))
    of = lambda s: F.col("segment") == s
    std = F.when(of("standard"), F.struct("ff", key))
    ends = rows.agg(
        *(F.count_if(of(s)).alias(f"n_{s}") for s in ("standard", "smallcap", "outside")),
        F.min(F.when(of("standard"), F.col("ff"))).alias("standard_floor"), F.min_by(name, std).alias("standard_floor_company"),
        F.max(F.when(of("smallcap"), F.col("ff"))).alias("smallcap_ceiling"), F.max_by(name, F.when(of("smallcap"), F.struct("ff", key))).alias("smallcap_ceiling_company"),
    )
    e = ends.first().asDict()  # seven values
    lo, hi = e["standard_floor"], e["smallcap_ceiling"]
    some = lo is not None and hi is not None and hi > lo
    inside = F.col("ff").between(lo, hi) if some else F.lit(False)
    nth = lambda s, p: F.max(F.when(of(s) & (F.col("at") == min(e[f"n_{s}"], int(e[f"n_{s}"] * p) + 1)), F.col("ff")))
    cut = F.col("place") == e["n_standard"]
    value = lambda v, kind: F.lit(v).cast(kind)
    return rows.agg(
        *(value(e[f"n_{s}"], "long").alias(f"n_{s}") for s in ("standard", "smallcap", "outside")),
        value(lo, "double").alias("standard_floor"), value(e["standard_floor_company"], "string").alias("standard_floor_company"),
        value(hi, "double").alias("smallcap_ceiling"), value(e["smallcap_ceiling_company"], "string").alias("smallcap_ceiling_company"),
        F.lit(some).alias("has_overlap"), value(lo if some else None, "double").alias("overlap_low"), value(hi if some else None, "double").alias("overlap_high"),
        value(hi - lo if some else None, "double").alias("overlap_width"), value(hi / lo if some and lo else None, "double").alias("overlap_ratio"),
        F.count_if(inside).alias("n_overlap"), *(F.count_if(inside & of(s)).alias(f"n_overlap_{s}") for s in ("standard", "smallcap", "outside")),
        F.max(F.when(cut, F.col("ff"))).alias("rank_cutoff"), F.max(F.when(cut, F.col(name))).alias("rank_cutoff_company"),
        nth("standard", 0.05).alias("standard_p5"), nth("standard", 0.5).alias("standard_median"), nth("smallcap", 0.5).alias("smallcap_median"), nth("outside", 0.5).alias("outside_median"),
    )


def fund_coverage(holdings: DataFrame, floats: DataFrame) -> DataFrame:
    """By fund: holdings, resolved, unresolved and with a free float, and the weight of the resolved and of those with a float.

    ``holdings`` (fund, key, weight_pct), the key null where nothing was found; ``floats`` (key, ff) has each key once.
    """
    rows = holdings.join(floats.filter("ff IS NOT NULL").select("key", F.lit(True).alias("_f")), "key", "left")
    some, valued = F.col("key").isNotNull(), F.col("_f").isNotNull()
    weight = F.coalesce("weight_pct", F.lit(0.0))
    total = lambda cond, n: rounded(F.coalesce(F.sum(F.when(cond, weight)), F.lit(0.0)), 5).alias(n)
    return rows.groupBy("fund").agg(
        F.count("*").alias("holdings"), F.count_if(some).alias("resolved"), F.count_if(~some).alias("unresolved"), F.count_if(valued).alias("with_float"),
        total(some, "weight_resolved"), total(valued, "weight_with_float"),
    )


#: Fixed value: the group of trusts that are no equity and are kept.
TRUST_GROUP = "IF"


def instrument_route(rows: DataFrame, equity_codes: DataFrame) -> DataFrame:
    """Master rows (scrip_code, scrip_id, group, isin) with ``route`` (kept or skipped), ``reason`` and ``kind``; a malformed ISIN of a kept row becomes null."""
    listed = equity_codes.select(F.trim("scrip_code").alias("scrip_code")).distinct().withColumn("_equity", F.lit(True))
    clean = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) for c in ("scrip_code", "scrip_id", "group", "isin")}
    rows = rows.withColumns(clean).join(listed, "scrip_code", "left")
    trust, equity = F.col("group") == TRUST_GROUP, F.col("_equity").isNotNull()
    reason = F.when((F.col("scrip_code") == "") | (F.col("scrip_id") == ""), "no scrip code or no scrip id").when(~equity & ~trust, F.concat(F.lit("neither equity nor a trust, group "), F.when(F.col("group") == "", "none").otherwise(F.col("group"))))
    rows = rows.withColumn("reason", reason).withColumn("route", F.when(F.col("reason").isNull(), "kept").otherwise("skipped"))
    kept = F.col("route") == "kept"
    return rows.withColumn("kind", F.when(kept & trust, "trust").when(kept, "equity")).withColumn("isin", F.when(listed_isin(F.col("isin")), F.col("isin"))).drop("_equity")


def universe_to_fetch(master: DataFrame, held: DataFrame, seed: DataFrame, floor: float) -> DataFrame:
    """Scrips worth a request, before any is made, and seed rows that are not: (scrip_code, route, reason).

    ``master`` (scrip_code, isin, indicative_cap) has each code once. Fetched are the held (scrip_code), the large by the master's own value, and the seeded
    (ord, scrip_code, isin) whose code the master has under the same ISIN. The floor is a filter that reaches the scan.
    """
    large = master.filter(F.col("indicative_cap") >= floor).select("scrip_code", F.lit(1).alias("why"))
    of_funds = held.filter("scrip_code IS NOT NULL").join(master.select("scrip_code"), "scrip_code", "left_semi").select("scrip_code", F.lit(0).alias("why"))
    asked = one_per_key(seed.filter("scrip_code IS NOT NULL"), ["scrip_code"], [F.col("ord")]).select("scrip_code", F.col("isin").alias("_theirs"))
    asked = asked.join(master.select("scrip_code", F.col("isin").alias("_ours"), F.lit(True).alias("_known")), "scrip_code", "left")
    problem = F.when(F.col("_known").isNull(), "not in the active master").when(F.col("_ours") != F.col("_theirs"), F.concat(F.lit("the master has ISIN "), F.col("_ours")))
    asked = stored(asked.select("scrip_code", problem.alias("reason")))
    good = of_funds.unionByName(large).unionByName(asked.filter("reason IS NULL").select("scrip_code", F.lit(2).alias("why")))
    reasons = F.get(F.array(*map(F.lit, ("held", "large", "seeded"))), F.min("why"))
    fetched = good.groupBy("scrip_code").agg(reasons.alias("reason")).withColumn("route", F.lit("fetch"))
    rejected = asked.filter("reason IS NOT NULL").withColumn("route", F.lit("rejected"))
    return fetched.unionByName(rejected).select("scrip_code", "route", "reason")


def disagreements(rows: DataFrame, key: str, gap: str, threshold: float, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """How far two readings are apart over ``rows``: one row (compared, median_abs_gap, the mean of the middle two, over the threshold, worst key and gap), and the ``top`` rows by magnitude."""
    rows = stored(rows.select(key, F.col(gap).alias("gap")).filter("gap IS NOT NULL").withColumns({"size": F.abs("gap")}))
    middle = exact_median(rows, "size", key, "median").scalar()
    worst = F.struct("size", F.col(key))
    told = rows.agg(F.count("*").alias("compared"), F.count_if(F.col("size") > threshold).alias("over"), F.max_by(key, worst).alias("worst"), F.max_by("gap", worst).alias("worst_gap"))
    return told.select("compared", middle.alias("median_abs_gap"), "over", "worst", "worst_gap"), rows.orderBy(F.desc("size"), key).limit(top).select(key, "gap")

"""The company model on the star-schema tables: float choice, funds, segments, verdicts, flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalar import crore, days_of_volume, distance_to, flow_primitives, rounded
from strandline.operators.order import ranked
from strandline.plans.tables import kept, stored, table

GAP = 0.01
HELD_UNTIL = "2000-01-01"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a part: price, shares, two float factors, the chosen one with its rule, and the free float; stored once for all queries on the same tables."""
    return kept(spark, sf_dir, "companies", ["part", "lineitem"], built_companies)


def built_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``companies``, computed."""
    lines = table(spark, sf_dir, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    kept = 100 - F.floor(F.col("l_discount") * 100 + 0.5)
    own, held = F.col("l_linestatus") == "O", F.col("l_shipdate") < F.lit(HELD_UNTIL).cast("timestamp_ntz")
    per = lines.select("l_partkey", "l_quantity", cents.alias("c"), (cents * kept).alias("k"), own.alias("own"), held.alias("held")).groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("shares"), F.sum("k").alias("k"), F.sum("c").alias("c"), F.sum(F.when(F.col("own"), F.col("k"))).alias("ko"),
        F.sum(F.when(F.col("own"), F.col("c"))).alias("co"), F.count_if("own").alias("n_own"), F.sum(F.when(F.col("held"), F.col("c"))).alias("ext_hold"),
    )
    rows = table(spark, sf_dir, "part").join(per, F.col("p_partkey") == F.col("l_partkey"), "left")
    first = F.col("k") / (F.col("c") * 100)
    second = F.when(F.col("n_own") >= 8, F.try_divide(F.col("ko").cast("double"), F.col("co") * 100))
    rows = rows.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.col("p_retailprice").alias("price"), "shares", first.alias("factor_a"), second.alias("factor_b"), F.coalesce("ext_hold", F.lit(0)).alias("ext_hold"))
    gap = F.abs(F.col("factor_b") - F.col("factor_a")) / F.col("factor_a")
    rule = F.when(F.col("factor_a").isNull() & F.col("factor_b").isNull(), "none").when(F.col("factor_b").isNull(), "only-a").when(F.col("factor_a").isNull(), "only-b").when(gap > GAP, "gap-switch").otherwise("primary")
    rows = rows.withColumn("gap", gap).withColumn("rule", rule)
    factor = F.when(F.col("rule").isin("gap-switch", "only-b"), F.col("factor_b")).otherwise(F.col("factor_a"))
    rows = rows.withColumn("factor", factor)
    ff = F.when(F.col("p_partkey") % 53 != 0, F.floor(F.col("factor") * F.col("shares") * F.col("price") + 0.5))
    basis = F.when(ff.isNotNull(), F.concat(F.lit("factor x shares x price, "), F.col("rule")))
    return rows.withColumn("ff", ff).withColumn("basis", basis).withColumn("quarantined", F.col("p_partkey") % 97 == 0)


def with_funds(rows: DataFrame) -> DataFrame:
    """Fund membership by held value, and the segment: the top 14 % standard, the next 38 % small-cap."""
    rows = stored(rows.withColumn("ext_hold", F.col("ext_hold").cast("double")).withColumn("ff", F.col("ff").cast("double")))
    n = rows.count()
    rows = ranked(rows, "ext_hold", "p_partkey", "hold_rank")
    eem, smin = F.col("hold_rank") <= n * 14 // 100, (F.col("hold_rank") > n * 14 // 100) & (F.col("hold_rank") <= n * 52 // 100)
    rows = rows.withColumn("in_eem", eem).withColumn("in_smin", smin).withColumn("in_eems", smin & (F.col("p_partkey") % 10 != 0))
    return rows.withColumn("segment", F.when(F.col("in_eem"), "standard").when(F.col("in_smin"), "smallcap").otherwise("outside"))


#: Moves below this many percent are recorded and float no band.
LEAST_MOVE = 1.0
SEGMENTS = ("standard", "smallcap", "outside")


def bands(unit: float, returns: dict[str, float] | None = None) -> dict[str, dict]:
    """For each segment the inclusion and exclusion bands in force, raw ones beside them, and why they were floated or not."""
    raw = {"inclusion_low": 0.9 * unit, "inclusion_high": unit, "exclusion_low": 0.8 * unit, "exclusion_high": 0.88 * unit}
    out = {}
    for segment in SEGMENTS:
        move = (returns or {}).get(segment)
        known = move is not None and abs(move) != float("inf") and move == move
        applied = known and abs(move) >= LEAST_MOVE
        factor = 1 + move / 100 if applied else 1.0
        scaled = {k: float(int(v * factor + 0.5)) for k, v in raw.items()} if applied else raw
        why = "no return for this segment, the raw band stands" if not known else f"the segment moved {move:+.2f} %" + ("" if applied else f", inside {LEAST_MOVE:g} %")
        out[segment] = {"applied": applied, "factor": factor, "reason": why, **scaled, **{f"raw_{k}": v for k, v in raw.items()}}
    return out


def verdicts(rows: DataFrame, returns: dict[str, float] | None = None) -> DataFrame:
    """The ordered rules: verdict, the list of the rules reached so that a verdict can be replayed, the distance from its threshold, notes.

    ``returns``: percent moves by segment that float the desk's bands.
    """
    rows = ranked(rows.withColumn("ff", F.col("ff").cast("double")), "ff", "p_partkey", "ff_rank")
    standard_row = (F.col("segment") == "standard") & F.col("ff").isNotNull()
    head = rows.agg((F.sum("ff") / F.count("ff")).alias("u"), F.count_if(standard_row).alias("n")).first()  # two numbers
    u, n_standard = float(head["u"] or 0.0), int(head["n"])
    cut = rows.filter(F.col("ff_rank") == n_standard).select("ff").first()
    cut = None if cut is None else cut["ff"]
    ff, outside = F.col("ff"), F.col("segment") == "outside"
    small, standard = F.col("segment") == "smallcap", F.col("segment") == "standard"
    known = bands(u, returns)

    def band(name: str) -> Column:
        out = F.lit(None).cast("double")
        for segment in SEGMENTS:
            out = F.when(F.col("segment") == segment, F.lit(known[segment][name]).cast("double")).otherwise(out)
        return out

    in_high, in_low, ex_low, ex_high = (band(k) for k in ("inclusion_high", "inclusion_low", "exclusion_low", "exclusion_high"))
    # name, asked of, fires, verdict, threshold, threshold that the distance is from
    n, at_cut, none = F.lit(float(n_standard)), F.lit(cut).cast("double"), F.lit(None).cast("double")
    rules = (
        ("quarantine", F.lit(True), F.col("quarantined"), "unknown", none, none),
        ("no-float", F.lit(True), ff.isNull(), "unknown", none, none),
        ("inclusion-high", outside, ff >= in_high, "likely-inclusion", in_high, in_high),
        ("inclusion-low", outside, ff >= in_low, "possible-inclusion", in_low, in_high),
        ("exclusion-low", ~outside, ff < ex_low, "likely-exclusion", ex_low, ex_low),
        ("exclusion-high", ~outside, ff < ex_high, "exclusion-risk", ex_high, ex_low),
        ("rank-up", small & (F.lit(n_standard) > 0), F.col("ff_rank") <= n_standard, "migration-up", n, at_cut),
        ("rank-down", standard & (F.lit(n_standard) > 0), F.col("ff_rank") > n_standard, "migration-down", n, at_cut),
    )
    factor, raw_of = band("factor"), {"inclusion-high": "inclusion_high", "inclusion-low": "inclusion_low", "exclusion-low": "exclusion_low", "exclusion-high": "exclusion_high"}
    verdict, reached, listed = F.lit("stable"), F.lit(True), []
    threshold = F.when(outside, in_low).otherwise(ex_high)
    for name, asked, fires, _, limit, _ in rules:
        hit = asked & F.coalesce(fires, F.lit(False))
        value = F.col("ff_rank").cast("double") if name.startswith("rank") else ff
        raw = band(f"raw_{raw_of[name]}") if name in raw_of else none
        one = F.struct(F.lit(name).alias("rule"), hit.alias("fired"), value.alias("value"), limit.alias("threshold"), raw.alias("raw_threshold"), factor.alias("factor"))
        listed.append(F.when(reached & asked, one))
        reached = reached & ~hit
    for _, asked, fires, says, _, measured in reversed(rules):
        hit = asked & F.coalesce(fires, F.lit(False))
        verdict = F.when(hit, says).otherwise(verdict)
        threshold = F.when(hit, measured).otherwise(threshold)
    note = F.when(~verdict.isin("stable", "unknown") & ~standard & ~F.col("in_eems"), F.lit("not sampled by the sampling fund, so without a flow of it"))
    rows = rows.withColumn("verdict", verdict).withColumn("rules", F.array_compact(F.array(*listed)))
    return rows.withColumn("distance_threshold", threshold).withColumn("distance_pct", rounded(distance_to(ff, threshold), 3)).withColumn("note", note)


VERDICT_OF = {
    "quarantine": "unknown", "no-float": "unknown", "inclusion-high": "likely-inclusion", "inclusion-low": "possible-inclusion",
    "exclusion-low": "likely-exclusion", "exclusion-high": "exclusion-risk", "rank-up": "migration-up", "rank-down": "migration-down",
}


def replayed(rules: Column | None = None) -> Column:
    """Verdict from the list of rules alone."""
    rules = F.col("rules") if rules is None else rules
    names = F.create_map(*(F.lit(x) for pair in VERDICT_OF.items() for x in pair))
    return F.coalesce(names[F.get(F.filter(rules, lambda r: r["fired"]), F.lit(0))["rule"]], F.lit("stable"))


def assessed(spark: SparkSession, sf_dir: str, returns: dict[str, float] | None = None) -> DataFrame:
    return verdicts(with_funds(companies(spark, sf_dir)), returns)


FUNDS = ("eem", "smin", "eems")
#: Rupees a dollar in the holdings files.
FX = 83.0


def fund_totals(rows: DataFrame) -> dict[str, float]:
    """Held value of each fund and free float of each segment, a few numbers from one pass."""
    held = [F.sum(F.when(F.col(f"in_{f}"), F.col("ext_hold"))).alias(f) for f in FUNDS]
    floats = [F.sum(F.when(F.col("segment") == s, F.col("ff"))).alias(s) for s in SEGMENTS]
    return {k: float(v or 0.0) for k, v in rows.agg(*held, *floats).first().asDict().items()}


def fund_weights(rows: DataFrame) -> DataFrame:
    """(p_partkey, fund, weight_pct, fund_value): long form of the three funds."""
    value = fund_totals(rows.withColumn("ff", F.col("ff").cast("double")))
    slots = F.array(*(F.when(F.col(f"in_{f}"), F.struct(F.lit(f).alias("fund"), F.lit(value[f]).alias("v"))) for f in FUNDS))
    long = rows.select("p_partkey", "ext_hold", F.explode(F.array_compact(slots)).alias("s"))
    return long.select("p_partkey", F.col("s.fund").alias("fund"), F.try_divide(100 * F.col("ext_hold"), F.col("s.v")).alias("weight_pct"), F.col("s.v").alias("fund_value"))


#: Shape of the flows: verdict, fund, direction, segment that the bought weight is a share of, whether only a fund that holds the company takes part.
FLOWS = (
    ("likely-exclusion", "eem", "sell", None, True), ("likely-exclusion", "smin", "sell", None, True), ("likely-exclusion", "eems", "sell", None, True),
    ("exclusion-risk", "eem", "sell", None, True), ("exclusion-risk", "smin", "sell", None, True), ("exclusion-risk", "eems", "sell", None, True),
    ("migration-up", "smin", "sell", None, True), ("migration-up", "eems", "sell", None, True), ("migration-up", "eem", "buy", "standard", False),
    ("migration-down", "eem", "sell", None, True), ("migration-down", "smin", "buy", "smallcap", False),
    ("likely-inclusion", "smin", "buy", "smallcap", False), ("likely-inclusion", "eems", "buy", "smallcap", True),
    ("possible-inclusion", "smin", "buy", "smallcap", False), ("possible-inclusion", "eems", "buy", "smallcap", True),
)
#: Where the sampling fund may or may not take part, which is told and not counted as zero.
NOT_SAMPLED = ("migration-up", "migration-down", "likely-inclusion", "possible-inclusion")


def flows(rows: DataFrame, fx: float = FX) -> DataFrame:
    """Flows by verdict: what a fund holds is sold whole, what it enters is bought at its share of the segment's float.

    The shape is a table of few rows that each row picks from, so nothing is joined or shuffled.
    """
    value = fund_totals(rows)
    options = []
    for verdict, fund, direction, segment, held in FLOWS:
        sell = direction == "sell"
        own = F.try_divide(100 * F.col("ext_hold"), F.lit(value[fund])) if sell else F.try_divide(100 * F.col("ff"), F.lit(value[segment]))
        weight = F.when(F.col(f"in_{fund}"), own) if held else own
        per_point = flow_primitives(F.lit(value[fund] / 100), F.lit(fx))["inr_per_point"]
        one = F.struct(F.lit(fund).alias("fund"), F.lit(direction).alias("direction"), weight.alias("weight"), per_point.alias("per_point"), F.lit("measured-position" if sell else "estimated").alias("certainty"))
        options.append(F.when((F.col("verdict") == verdict) & weight.isNotNull(), one))
    rows = rows.withColumn("adv", F.when(F.col("p_partkey") % 11 != 0, F.col("shares") / 20))
    out = rows.select("p_partkey", "verdict", "price", "adv", F.explode(F.array_compact(F.array(*options))).alias("f")).select("p_partkey", "verdict", "price", "adv", "f.*")
    sign = F.when(F.col("direction") == "sell", -1).otherwise(1)
    size = F.abs("weight") * F.col("per_point")
    shares = F.when(F.col("price") > 0, size / F.col("price"))
    return out.select(
        "p_partkey", "verdict", "fund", "direction", rounded(F.col("weight"), 6).alias("weight"), rounded(sign * size).alias("flow"), rounded(crore(sign * size), 2).alias("flow_crore"),
        rounded(sign * shares).alias("flow_shares"), rounded(days_of_volume(shares, F.col("adv")), 4).alias("days"), "adv", "certainty",
    )


def not_sampled(rows: DataFrame) -> DataFrame:
    """(p_partkey, verdict, fund): flows of the sampling fund that cannot be told, as it does not hold the company; no zeros."""
    skipped = (F.col("verdict") == "migration-down") | (F.col("verdict").isin(*NOT_SAMPLED) & ~F.col("in_eems"))
    return rows.filter(skipped).select("p_partkey", "verdict", F.lit("eems").alias("fund"))

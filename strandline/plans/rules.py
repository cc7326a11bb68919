"""Data-quality rules as violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import recent_isin
from strandline.operators.lookup import collisions
from strandline.plans.company import GAP, replayed
from strandline.plans.tables import stored


def violations(df: DataFrame, key: str, rules: dict[str, Column], details: dict[str, Column] | None = None) -> DataFrame:
    """(rule, key) for every row and rule whose condition, the forbidden state, holds; one scan for all rules. With ``details`` also what was seen, null for a rule that names nothing."""
    says = lambda name: (details or {}).get(name, F.lit(None)).cast("string")
    fired = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("rule"), says(name).alias("detail"))) for name, c in rules.items())))
    rows = df.select(F.explode(fired).alias("v"), F.col(key).cast("string").alias("key"))
    return rows.select("v.rule", "key", *(["v.detail"] if details is not None else []))


def company_details() -> dict[str, Column]:
    """What the row rules saw."""
    text = lambda label, c: F.concat(F.lit(f"{label}="), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return {
        "replay": text("verdict", "verdict"), "quarantine-unknown": text("verdict", "verdict"), "factor-range": text("factor", "factor"), "choice-has-source": text("rule", "rule"), "primary-has-source": text("rule", "rule"),
        "choice-re-derives": text("rule", "rule"), "value-has-basis": text("basis", "basis"), "no-zero-weight": text("held", "ext_hold"),
    }


def fund_collisions(holdings: DataFrame) -> DataFrame:
    """Holdings (fund, isin) of a fund that share an ISIN with another of the same fund: one of the two is the wrong company."""
    return collisions(holdings.filter("isin IS NOT NULL"), ["fund", "isin"])


def trade_claims(drift: DataFrame, key: str) -> DataFrame:
    """(rule, key) of drift records (requires_trade) that claim a trade: price alone forces none."""
    return violations(drift, key, {"drift-needs-no-trade": F.coalesce("requires_trade", F.lit(True))})


def unit_problems(rows: DataFrame, sizes: DataFrame, key: str, fields: list[str], large: float = 2e10, least: float = 1e5) -> DataFrame:
    """(rule, key, detail): rupee ``fields`` under ``least`` of companies that an independent source (key, size) calls large; size never comes from the fields under test."""
    both = rows.join(sizes.filter(F.col("size") >= large), key)
    small = F.array_compact(F.array(*(F.when(F.col(f) < least, F.concat(F.lit(f"{f}="), F.floor(f).cast("string"))) for f in fields)))
    return both.select(F.lit("rupees-of-the-large").alias("rule"), F.col(key).cast("string").alias("key"), F.explode(small).alias("detail"))


def company_rules() -> dict[str, Column]:
    """Row rules of the company model."""
    ff, factor, a, b = F.col("ff"), F.col("factor"), F.col("factor_a"), F.col("factor_b")
    second = F.col("rule").isin("gap-switch", "only-b")
    derived = F.when(a.isNull() & b.isNull(), "none").when(b.isNull(), "only-a").when(a.isNull(), "only-b").when(F.abs(b - a) / a > GAP, "gap-switch").otherwise("primary")
    return {
        "disjoint": F.col("in_eem") & F.col("in_smin"),
        "sampler-subset": F.col("in_eems") & ~F.col("in_smin"),
        "replay": ~replayed().eqNullSafe(F.col("verdict")),
        "quarantine-unknown": F.col("quarantined") & (F.col("verdict") != "unknown"),
        "factor-range": ~((factor > 0) & (factor <= 1.02)),
        "choice-has-source": second & b.isNull(),
        "primary-has-source": F.col("rule").isin("primary", "only-a") & a.isNull(),
        "float-recovers": F.abs(factor * F.col("shares") * F.col("price") - ff) > F.greatest(F.lit(1.0), 1e-6 * ff),
        "value-has-basis": ff.isNull() != F.col("basis").isNull(),
        "choice-re-derives": F.col("rule") != derived,
        "label-agrees": ~factor.eqNullSafe(F.when(second, b).otherwise(a)),
        "no-zero-weight": (F.col("in_eem") | F.col("in_smin")) & (F.col("ext_hold") == 0),
    }


def flow_violations(flows: DataFrame, sampled: DataFrame, key: str) -> DataFrame:
    """(rule, key): flows of companies that have none, days without a volume, flows of a sampler that does not hold, one-sided migrations."""
    rows = violations(flows, key, {"no-flow-of-the-stable": F.col("verdict").isin("stable", "unknown"), "days-without-volume": F.col("adv").isNull() & F.col("days").isNotNull()})
    absent = flows.filter("fund = 'eems'").join(sampled.select(key), key, "left_anti").select(F.lit("sampler-holds").alias("rule"), F.col(key).cast("string").alias("key"))
    both = flows.filter(F.col("verdict").startswith("migration")).groupBy(key).agg(F.bool_or(F.col("direction") == "buy").alias("b"), F.bool_or(F.col("direction") == "sell").alias("s"))
    return all_violations(rows, absent, both.filter("NOT (b AND s)").select(F.lit("migration-both-ways").alias("rule"), F.col(key).cast("string").alias("key")))


def seed_violations(seed: DataFrame, floor: float) -> DataFrame:
    """(key, problem) of seed rows (key, isin, cap): malformed ISIN, value below the floor, an ISIN that another row has."""
    twice = stored(seed.filter("isin IS NOT NULL").groupBy("isin").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = seed.join(twice, "isin", "left")
    problem = F.when(~F.coalesce(recent_isin(F.col("isin")), F.lit(False)), "isin").when(~F.coalesce(F.col("cap") >= floor, F.lit(False)), "floor").when(F.col("n") > 1, "repeated isin")
    return rows.select("key", problem.alias("problem")).filter("problem IS NOT NULL")


def inactive_codes(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Codes that the master lacks or does not call active."""
    return rows.join(master.filter("status = 'active'").select("code"), "code", "left_anti").select(F.lit("code-active").alias("rule"), F.col("code").cast("string").alias("key"))


def unexpected(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Rows (key, n) whose number is not the expected one, and expected keys that are missing (n is null)."""
    return expected.join(found, key, "full").filter(~F.col("n").eqNullSafe(F.col("expected")))


def prints_as_zero(value: Column, shown: Column) -> Column:
    """Whether a number other than zero is shown as zero, or zero as something else."""
    zero = shown.rlike(r"^[+-]?[^0-9<>]*0(\.0*)?[^0-9]*$")
    return (value != 0) == zero


def not_re_derived(kept: DataFrame, fresh: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows of ``fresh`` whose stored value is another one."""
    old = kept.select(*keys, F.col(value).alias("_kept"))
    differs = (F.abs(F.col("_kept") - F.col(value)) > tolerance) | (F.col("_kept").isNull() != F.col(value).isNull())
    return fresh.join(old, keys).filter(differs).drop("_kept")


def all_violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

"""Queries of writes that count, of rules with faults that make each of them fire, and of the reconciliation's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalar import rounded
from strandline.plans import audit as A
from strandline.plans import company as C
from strandline.plans import records as R
from strandline.plans import reconcile, writing
from strandline.plans import rules as Q
from strandline.plans.model_queries import RECONCILE, _faulty, _reconciled_rows
from strandline.plans.published import published
from strandline.plans.record_queries import FLOATS, SLOTS, _holdings, float_rows
from strandline.plans.tables import workspace
from strandline.plans.workload import COMPANY, QUERIES, SQL, _half_up, _t, query

__all__ = ["QUERIES", "SQL"]

_SIDES = """, w AS (SELECT e.*, CASE WHEN final LIKE 'nse%' THEN 'nse' WHEN final LIKE 'bse%' THEN 'bse' END AS chose, coalesce(CASE WHEN price > 0 THEN factor * shares * price END, CASE WHEN how = 'rupees' THEN rupees END) AS ff, p_size % 3 = 0 AS held,
 CASE p_size % 4 WHEN 0 THEN 'stale' WHEN 1 THEN NULL ELSE 'eod' END AS tier, p_size % 5 <> 0 AS named, CASE WHEN p_size % 7 <> 0 THEN shares / 20 END AS adv FROM e JOIN part USING (p_partkey)) """
_COUNTS = {
    "companies": "true", "held": "held", "not_held": "NOT held", "with_float": "ff IS NOT NULL", "with_float_factor": "factor IS NOT NULL", "float_from_nse": "{src} = 'nse'", "float_from_bse": "{src} = 'bse'",
    "bse_primary": "{rule} = 'bse-primary'", "bse_only": "{rule} = 'bse-only'", "nse_preferred_on_gap": "{rule} = 'nse-preferred-on-material-gap'", "nse_only": "{rule} = 'nse-only'", "nse_only_published_rupees": "{rule} = 'nse-only-published-rupees'",
    "comparable": "{gap} IS NOT NULL", "without_float": "ff IS NULL", "priced_eod": "tier = 'eod'", "priced_stale": "tier = 'stale'", "unpriced": "tier IS NULL", "live_eligible": "named", "live_ineligible": "NOT named", "with_adv": "adv IS NOT NULL",
}
_SOURCE = "(CASE how WHEN 'formed' THEN CASE WHEN rule LIKE 'nse%' THEN 'nse' ELSE 'bse' END WHEN 'rupees' THEN 'nse' END)"


def _counters() -> dict:
    """The counts of the coverage block as aggregates over company records."""
    return {k: F.count_if(F.expr(c.format(rule="choice.rule", gap="gap_pct", src="source"))) for k, c in _COUNTS.items()}


def _records(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    rows = R.with_float(float_rows(spark, d))
    rows = rows.withColumns({"held": size % 3 == 0, "tier": F.when(size % 4 == 0, "stale").when(size % 4 != 1, "eod"), "named": size % 5 != 0, "adv": F.when(size % 7 != 0, F.col("shares") / 20)})
    return rows.select("p_partkey", "choice", "factor", "gap_pct", "source", "ff", "basis", "held", "tier", "named", "adv")


@query(FLOATS + _SIDES + "SELECT " + ", ".join(f"count(*) FILTER ({c.format(rule='final', gap='(CASE WHEN bse > 0 AND nse IS NOT NULL THEN gap END)', src=_SOURCE)}) AS {k}" for k, c in _COUNTS.items()) + " FROM w")
def coverage_from_write(spark: SparkSession, d: str) -> DataFrame:
    """Twenty counts of the company records, taken while the records are written; the write would be refused under its floors."""
    path = workspace(spark, "companies")
    none = spark.createDataFrame([], "rule string, key string")
    got = writing.guarded_write(_records(spark, d), path, none, least_rows=10, floors={"a float": (F.col("ff").isNotNull(), 0.5)}, counters=_counters())
    return spark.createDataFrame([tuple(got[k] for k in _COUNTS)], ", ".join(f"{k} long" for k in _COUNTS))


ROUTES = ("kept", "skipped", "failed")
REASONS = ("no symbol", "status", "no price", "no time")


@query("WITH r AS (SELECT CASE WHEN user_id IS NULL THEN 'no symbol' WHEN user_id % 10 = 3 THEN 'not asked for' WHEN event_type = 'error' THEN 'status' WHEN value IS NULL OR NOT value > 0 THEN 'no price' END AS reason FROM events), x AS (SELECT CASE WHEN reason IS NULL THEN 'route kept' WHEN reason IN ('no symbol', 'not asked for') THEN 'route skipped' ELSE 'route failed' END AS what FROM r UNION ALL SELECT CASE WHEN reason = 'not asked for' THEN 'reason other' ELSE 'reason ' || reason END FROM r WHERE reason IS NOT NULL UNION ALL SELECT 'rows' FROM r UNION ALL SELECT 'read back' FROM r WHERE reason IS NULL) SELECT what, count(*) AS n FROM x GROUP BY 1")
def routed_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes kept, skipped or failed, each with its reason: counts of the pass that wrote them, and the kept ones read back."""
    e = _t(spark, d, "events")
    skipped = F.when(F.col("user_id").isNull(), "no symbol").when(F.col("user_id") % 10 == 3, "not asked for")
    failed = F.when(F.col("event_type") == "error", "status").when(F.col("value").isNull() | ~(F.col("value") > 0), "no price")
    route = F.when(skipped.isNotNull(), "skipped").when(failed.isNotNull(), "failed").otherwise("kept")
    path = workspace(spark, "quotes")
    got = writing.routed_write(e.select("event_id", F.col("user_id").alias("symbol"), F.col("value").alias("price"), route.alias("route"), F.coalesce(skipped, failed).alias("reason")), path, ROUTES, REASONS)
    counts = spark.createDataFrame([(k, n) for k, n in got.items() if n], "what string, n long")
    return counts.unionByName(published(spark, path).filter("route = 'kept'").agg(F.lit("read back").alias("what"), F.count("*").alias("n")))


@query("SELECT line FROM (SELECT 'Company export,\"as of today, closes\"' AS line UNION ALL SELECT 'A weight belongs to one fund only.' UNION ALL SELECT '' UNION ALL SELECT 'Key,Name,Balance' UNION ALL SELECT c_custkey || ',' || CASE c_custkey % 4 WHEN 0 THEN '\"' || c_name || ', \"\"Ltd\"\"\"' WHEN 1 THEN '''=' || c_name WHEN 2 THEN '' ELSE c_name END || ',' || CASE WHEN b < 0 THEN '''' ELSE '' END || b FROM (SELECT c_custkey, c_name, CAST(floor(c_acctbal) AS BIGINT) AS b FROM customer))")
def exported_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of an exported file: banner, header, and cells that are quoted or made safe for a spreadsheet (the reader takes the byte order mark off)."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat("c_name", F.lit(', "Ltd"'))).when(k % 4 == 1, F.concat(F.lit("="), "c_name")).when(k % 4 == 3, F.col("c_name"))
    rows = _t(spark, d, "customer").select("c_custkey", name.alias("name"), F.floor("c_acctbal").alias("balance"))
    path = workspace(spark, "export")
    writing.export_csv(rows, path, [["Company export", "as of today, closes"], ["A weight belongs to one fund only."]], [F.desc("balance"), F.col("c_custkey")], {"c_custkey": "Key", "name": "Name", "balance": "Balance"})
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line"))


RULE_FAULTS = COMPANY + """, z AS (SELECT *, CASE WHEN p_partkey % 137 = 8 THEN NULL ELSE factor_a END AS a2, CASE WHEN (in_eem OR in_smin) AND p_partkey % 11 = 9 THEN 0 ELSE ext_hold END AS h2 FROM verdict) """


@query(RULE_FAULTS + "SELECT 'primary-has-source' AS rule, CAST(p_partkey AS VARCHAR) AS key, 'rule=' || rule AS detail FROM z WHERE rule IN ('primary', 'only-a') AND a2 IS NULL UNION ALL SELECT 'no-zero-weight', CAST(p_partkey AS VARCHAR), 'held=0.0' FROM z WHERE (in_eem OR in_smin) AND h2 = 0")
def dq_details(spark: SparkSession, d: str) -> DataFrame:
    """Two rules with the faults that they are for and what they saw: a source without a reading behind it, and a held weight of zero."""
    rows, k = C.assessed(spark, d), F.col("p_partkey")
    held = F.col("in_eem") | F.col("in_smin")
    rows = rows.withColumns({"factor_a": F.when(k % 137 != 8, F.col("factor_a")), "ext_hold": F.when(held & (k % 11 == 9), 0.0).otherwise(F.col("ext_hold"))})
    asked = {n: c for n, c in Q.company_rules().items() if n in ("primary-has-source", "no-zero-weight")}
    return Q.violations(rows, "p_partkey", asked, Q.company_details())


@query(SLOTS + "SELECT fund, isin, n AS n_rows FROM (SELECT fund, isin, count(*) OVER (PARTITION BY fund, isin) AS n FROM h WHERE isin IS NOT NULL AND quantity > 40) WHERE n > 1")
def dq_fund_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Holdings of a fund that share their ISIN with another one of it."""
    return Q.fund_collisions(_holdings(spark, d).filter("quantity > 40").select("fund", "isin"))


DRIFT = COMPANY + """, w AS (SELECT 'eem' AS fund, p_partkey, ext_hold, price, shares FROM seg WHERE in_eem UNION ALL SELECT 'smin', p_partkey, ext_hold, price, shares FROM seg WHERE in_smin UNION ALL SELECT 'eems', p_partkey, ext_hold, price, shares FROM seg WHERE in_eems),
m AS (SELECT *, 100 * CAST(ext_hold AS DOUBLE) / sum(CAST(ext_hold AS DOUBLE)) OVER (PARTITION BY fund) AS weight, shares * price AS now, shares * (price * (1 + (p_partkey % 5 - 2) / 100)) AS captured FROM w), r AS (SELECT fund, sum(now) / sum(captured) AS basket FROM m GROUP BY 1),
x AS (SELECT m.fund, p_partkey, weight * (now / captured / basket) - weight AS pp FROM m JOIN r ON r.fund = m.fund WHERE now > 0 AND captured > 0) """


def _drift(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_funds(C.companies(spark, d))
    out = A.drift_members(rows, C.fund_weights(rows).withColumnRenamed("weight_pct", "weight")).filter("drift IS NOT NULL")
    return out.select("fund", "p_partkey", F.col("drift.drift_pp").alias("drift_pp"), F.col("drift.requires_trade").alias("requires_trade"))


@query(DRIFT + "SELECT 'as it is' AS state, count(*) FILTER (pp > 0) > 0 AND count(*) FILTER (pp < 0) > 0 AS ok FROM x UNION ALL SELECT 'prices of two days', false UNION ALL SELECT 'no drift', true")
def dq_drift_signs(spark: SparkSession, d: str) -> DataFrame:
    """Whether drifts have both signs: as they are, when all prices have moved on by a day, and when there are none."""
    drift = _drift(spark, d)
    states = {"as it is": drift, "prices of two days": drift.withColumn("drift_pp", F.abs("drift_pp") + 0.1), "no drift": drift.filter("drift_pp IS NULL")}
    rows = [A.both_signs(df, "drift_pp").select(F.lit(name).alias("state"), "ok") for name, df in states.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(DRIFT + "SELECT 'drift-needs-no-trade' AS rule, CAST(p_partkey AS VARCHAR) AS key, fund FROM (SELECT fund, p_partkey FROM x WHERE p_partkey % 17 = 2) ")
def dq_trade_claims(spark: SparkSession, d: str) -> DataFrame:
    """Drift records that claim a trade, of which some were made to."""
    drift = _drift(spark, d).withColumn("requires_trade", F.col("requires_trade") | (F.col("p_partkey") % 17 == 2))
    key = F.concat_ws("|", "fund", F.col("p_partkey").cast("string"))
    found = Q.trade_claims(drift.withColumn("key", key), "key")
    return found.select("rule", F.substring_index("key", "|", -1).alias("key"), F.substring_index("key", "|", 1).alias("fund"))


_SIZE = "shares * price * 1e4 * (1 + p_partkey % 3)"


@query(COMPANY + f", s AS (SELECT *, shares * price * CASE WHEN p_partkey % 41 = 3 THEN 1 ELSE 1e4 END AS full_cap, ff * CASE WHEN p_partkey % 43 = 5 THEN 1e-3 ELSE 1e4 END AS free, {_SIZE} AS size FROM company) SELECT 'rupees-of-the-large' AS rule, CAST(p_partkey AS VARCHAR) AS key, f || '=' || CAST(floor(v) AS BIGINT) AS detail FROM (SELECT p_partkey, 'full_cap' AS f, full_cap AS v, size FROM s UNION ALL SELECT p_partkey, 'free', free, size FROM s) WHERE size >= 1.5e10 AND v < 3e6")
def dq_units(spark: SparkSession, d: str) -> DataFrame:
    """Rupee fields too small for companies that an independent size calls large: some were put in another unit, field by field."""
    k, cap = F.col("p_partkey"), F.col("shares") * F.col("price")
    rows = C.companies(spark, d)
    fields = rows.select(k, (cap * F.when(k % 41 == 3, 1.0).otherwise(1e4)).alias("full_cap"), (F.col("ff") * F.when(k % 43 == 5, 1e-3).otherwise(1e4)).alias("free"))
    return Q.unit_problems(fields, rows.select(k, (cap * 1e4 * (1 + k % 3)).alias("size")), "p_partkey", ["full_cap", "free"], large=1.5e10, least=3e6)


_SIDE = "CASE WHEN third IS NULL THEN NULL WHEN abs(third / shares - 1) < 0.02 THEN 'ours' WHEN coalesce(abs(third / theirs - 1) < 0.02, false) THEN 'theirs' ELSE 'neither' END"


@query(RECONCILE + f", o AS (SELECT *, {_SIDE} AS side FROM c), r AS (SELECT abs(gap) AS g, row_number() OVER (ORDER BY abs(gap), key) AS i, count(*) OVER () AS n FROM c) SELECT count(*) AS n_compared, (SELECT {_half_up('max(g)', 3)} FROM r WHERE i = least(n, n // 2 + 1)) AS median_gap, count(*) FILTER (abs(gap) > 10) AS n_over, count(*) FILTER (abs(gap) > 5) AS n_over_5, count(*) FILTER (abs(gap) > 10 AND side = 'ours') AS resolved_ours, count(*) FILTER (abs(gap) > 10 AND side = 'theirs') AS resolved_theirs, count(*) FILTER (abs(gap) > 10 AND coalesce(side, 'neither') = 'neither') AS quarantine FROM o")
def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    """How far two share counts are apart over all companies, and how the outliers were settled."""
    return reconcile.summary(_reconciled_rows(spark, d))


@query(RECONCILE + f", o AS (SELECT *, coalesce({_SIDE}, 'neither') AS side FROM c WHERE abs(gap) > 10) SELECT CASE side WHEN 'ours' THEN 'third source matches our count' WHEN 'theirs' THEN 'third source matches the other count' ELSE CASE WHEN abs(ratio - 2) / 2 <= 0.002 THEN 'counts differ by a corporate action of 2, no third source' WHEN abs(ratio - 1.25) / 1.25 <= 0.002 THEN 'counts differ by a corporate action of 1.25, no third source' WHEN abs(ratio - 0.5) / 0.5 <= 0.002 THEN 'counts differ by a corporate action of 0.5, no third source' ELSE 'counts differ by no corporate action and no third source covers the company' END END AS cause, count(*) AS n FROM o GROUP BY 1")
def reconcile_causes(spark: SparkSession, d: str) -> DataFrame:
    """Outliers by the cause that is told of them."""
    return reconcile.adjudicated(_reconciled_rows(spark, d)).groupBy("cause").agg(F.count("*").alias("n"))


GAPS = FLOATS + ", y AS (SELECT p_partkey, gap AS g, row_number() OVER (ORDER BY abs(gap), p_partkey) AS i, count(*) OVER () AS n FROM e WHERE gap IS NOT NULL) "


@query(GAPS + "SELECT count(*) AS compared, median(abs(g)) AS median_abs_gap, count(*) FILTER (abs(g) > 2) AS over, arg_max(p_partkey, (abs(g), p_partkey)) AS worst, arg_max(g, (abs(g), p_partkey)) AS worst_gap FROM y")
def disagreement_report(spark: SparkSession, d: str) -> DataFrame:
    """How far the two float factors are apart over all companies that have both."""
    return R.disagreements(_records(spark, d), "p_partkey", "gap_pct", 2.0)[0]


@query(GAPS + "SELECT p_partkey, g AS gap FROM y ORDER BY abs(g) DESC, p_partkey LIMIT 10")
def disagreement_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest of these gaps, with their signs."""
    return R.disagreements(_records(spark, d), "p_partkey", "gap_pct", 2.0)[1]


_EACH_FAULT = SQL["dq_violations"].replace("SELECT rule, count(*) AS n FROM (", "SELECT rule, CAST(p_partkey AS VARCHAR) AS key FROM (").removesuffix(" GROUP BY 1").replace(" AS rule FROM z WHERE", " AS rule, p_partkey FROM z WHERE").replace("' FROM z WHERE", "', p_partkey FROM z WHERE")


@query(_EACH_FAULT)
def dq_violation_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every row that breaks a rule of the company model, with the rule: disjoint segments and the sampler's subset among them."""
    return Q.violations(_faulty(C.assessed(spark, d)), "p_partkey", Q.company_rules())

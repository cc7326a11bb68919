"""More of the model's operators as queries over the star-schema tables, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import format as fmt
from strandline.functions import parse, scalar
from strandline.functions.scalar import rounded
from strandline.operators import identity
from strandline.operators.order import nth_value
from strandline.plans import audit as A
from strandline.plans import benchmarks as B
from strandline.plans import company as C
from strandline.plans import reconcile as R
from strandline.plans import rules as Q
from strandline.plans.tables import stored
from strandline.plans.screen import natural_order, ordinal, watched
from strandline.plans.workload import COMPANY, FLOW, QUERIES, SERIES, SQL, _daily, _fx, _half_up, _t, query
from strandline.streaming import live

__all__ = ["QUERIES", "SQL"]

RETURNS = {"standard": 4.25, "smallcap": -2.5, "outside": 0.4}


def _floated(raw: str) -> str:
    """The band in force: scaled and rounded for the two segments that moved a percent or more."""
    return f"(CASE segment WHEN 'standard' THEN floor({raw} * 1.0425 + 0.5) WHEN 'smallcap' THEN floor({raw} * 0.975 + 0.5) ELSE {raw} END)"


ASSESS = f""", b AS (SELECT *, {_floated('u')} AS ih, {_floated('0.9 * u')} AS il, {_floated('0.8 * u')} AS xl, {_floated('0.88 * u')} AS xh, (SELECT ff FROM rk WHERE fr = ns) AS cut FROM rk),
a AS (SELECT *, CASE WHEN quarantined OR ff IS NULL THEN 'unknown' WHEN segment = 'outside' AND ff >= ih THEN 'likely-inclusion' WHEN segment = 'outside' AND ff >= il THEN 'possible-inclusion' WHEN segment = 'outside' THEN 'stable'
 WHEN ff < xl THEN 'likely-exclusion' WHEN ff < xh THEN 'exclusion-risk' WHEN segment = 'smallcap' AND fr <= ns THEN 'migration-up' WHEN segment = 'standard' AND fr > ns THEN 'migration-down' ELSE 'stable' END AS v FROM b),
f AS (SELECT *, CASE WHEN v = 'unknown' THEN NULL WHEN v IN ('likely-inclusion', 'possible-inclusion') THEN ih WHEN v = 'stable' AND segment = 'outside' THEN il WHEN v IN ('likely-exclusion', 'exclusion-risk') THEN xl WHEN v LIKE 'migration%' THEN cut ELSE xh END AS th FROM a) """


@query(COMPANY + ASSESS + f"SELECT p_partkey, v AS verdict, {_half_up('(ff - th) / th * 100', 3)} AS distance_pct, CASE WHEN v NOT IN ('stable', 'unknown') AND segment <> 'standard' AND NOT in_eems THEN 1 ELSE 0 END AS noted FROM f")
def assess_floated(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts under bands that float with the segments' moves, with the distance from the threshold."""
    rows = C.assessed(spark, d, RETURNS)
    return rows.select("p_partkey", "verdict", "distance_pct", F.col("note").isNotNull().cast("int").alias("noted"))


@query(COMPANY + ASSESS + "SELECT segment, count(*) AS n, CAST(sum(CASE WHEN segment = 'outside' THEN 0 ELSE 1 END) AS BIGINT) AS floated FROM f WHERE ff IS NOT NULL AND NOT quarantined GROUP BY 1")
def floated_bands(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose rules carry a floated threshold that differs from the raw one in the direction of the segment's move."""
    rows = C.assessed(spark, d, RETURNS).filter("ff IS NOT NULL AND NOT quarantined")
    moved = F.exists("rules", lambda r: F.sign(r["threshold"] - r["raw_threshold"]) == F.sign(r["factor"] - 1))
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(moved & (F.col("segment") != "outside")).alias("floated"))


@query(COMPANY + "SELECT count(*) AS companies, count(*) FILTER (in_eem OR in_smin) AS held, count(*) FILTER (NOT (in_eem OR in_smin)) AS unheld, count(factor_a) AS with_a, count(factor_b) AS with_b, count(factor_a + factor_b) AS with_both, count(ff) AS with_float, count(*) FILTER ((in_eem OR in_smin) AND ff IS NULL) AS held_without_float, count(*) FILTER (rule = 'gap-switch') AS switched, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (price > 0) AS priced, count(shares) AS with_shares FROM seg")
def coverage_block(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(C.with_funds(C.companies(spark, d)))


@query(COMPANY + ", e AS (SELECT min(ff) FILTER (segment = 'standard') AS lo, max(ff) FILTER (segment = 'smallcap') AS hi FROM seg) SELECT lo, hi, CASE WHEN hi > lo THEN hi - lo END AS width, CASE WHEN hi > lo THEN hi / lo END AS ratio, count(*) FILTER (hi > lo AND ff BETWEEN lo AND hi AND segment = 'standard') AS n_standard, count(*) FILTER (hi > lo AND ff BETWEEN lo AND hi AND segment = 'smallcap') AS n_smallcap, count(*) FILTER (hi > lo AND ff BETWEEN lo AND hi AND segment = 'outside') AS n_outside FROM seg, e GROUP BY lo, hi")
def segment_overlap(spark: SparkSession, d: str) -> DataFrame:
    return A.overlap(C.with_funds(C.companies(spark, d)))


@query(COMPANY + ", o AS (SELECT ff, p_partkey, row_number() OVER (ORDER BY ff DESC, p_partkey) AS i FROM seg WHERE ff IS NOT NULL) SELECT ff AS cutoff, p_partkey AS cutoff_p_partkey FROM o WHERE i = (SELECT count(*) FROM seg WHERE segment = 'standard' AND ff IS NOT NULL)")
def rank_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """The N-th largest float, N being the size of the standard segment."""
    rows = C.with_funds(C.companies(spark, d))
    n = rows.filter("segment = 'standard' AND ff IS NOT NULL").count()
    return nth_value(rows, "ff", "p_partkey", n, "cutoff")


@query(COMPANY + "SELECT s.segment, coalesce(sum(ff), 0) AS total, count(ff) AS n FROM (VALUES ('standard'), ('smallcap'), ('outside'), ('frontier')) s(segment) LEFT JOIN seg ON seg.segment = s.segment GROUP BY 1")
def segment_totals_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_funds(C.companies(spark, d)).groupBy("segment").agg(F.sum("ff").alias("total"), F.count("ff").alias("n"))
    return A.with_zero_rows(rows, "segment", ("standard", "smallcap", "outside", "frontier"))


@query(f"SELECT count(*) AS n, count(s_suppkey) AS n_matched, sum(w) AS weight, sum(CASE WHEN s_suppkey IS NOT NULL THEN w END) AS weight_matched, {_half_up('sum(CASE WHEN s_suppkey IS NOT NULL THEN w END) / sum(w)', 8)} AS share FROM (SELECT p_partkey, floor(p_retailprice) AS w FROM part) LEFT JOIN supplier ON p_partkey = s_suppkey")
def naive_join_weight(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", F.floor("p_retailprice").cast("double").alias("w")).join(_t(spark, d, "supplier").select("s_suppkey"), F.col("p_partkey") == F.col("s_suppkey"), "left")
    return A.weight_coverage(rows, "w", F.col("s_suppkey").isNotNull()).withColumn("share", rounded(F.col("share"), 8))


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(k) AS n_keys, count(*) FILTER (k IS NOT NULL AND n > 1) AS n_repeated, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS n_null FROM (SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS k, count(*) AS n FROM part GROUP BY 1)")
def distinct_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicates(_t(spark, d, "part").select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("k")), "k")


@query("SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def first_known_value(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")))
    return A.first_known(rows, ["o_custkey"], "o_totalprice", ["o_orderdate", "o_orderkey"])


@query("SELECT name, max(d) AS d, arg_max(close, d) AS close FROM s GROUP BY name".join([SERIES, ""]))
def latest_point(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_by(_daily(spark, d), ["name"], "d", ["close"])


@query(SERIES + ", l AS (SELECT name, max(d) AS last_date FROM s WHERE NOT (name LIKE '3%' AND d > DATE '2001-06-30') GROUP BY 1) SELECT name, last_date, CAST(date_diff('day', last_date, (SELECT max(last_date) FROM l)) AS INTEGER) AS lag_days FROM l")
def newest_and_lag(spark: SparkSession, d: str) -> DataFrame:
    """How far each series is behind the newest; one of them ends early."""
    return B.newest_and_lag(_daily(spark, d).filter(~(F.col("name").startswith("3") & (F.col("d") > F.lit("2001-06-30").cast("date")))))


@query("WITH f AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'prices' WHEN '2-HIGH' THEN 'quotes' WHEN '3-MEDIUM' THEN 'index lists' WHEN '5-LOW' THEN 'reconciliation' ELSE 'other' END AS feed, CAST(max(o_orderdate) AS DATE) - CAST(CAST(ascii(o_orderpriority) - 49 AS INTEGER) * 5 AS INTEGER) AS as_of FROM orders GROUP BY o_orderpriority), t AS (SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders) SELECT feed, as_of, CAST(date_diff('day', as_of, today) AS INTEGER) AS age_days, CASE feed WHEN 'reconciliation' THEN 45 WHEN 'index lists' THEN 12 WHEN 'prices' THEN 4 WHEN 'quotes' THEN 4 ELSE 14 END AS allowed_days, date_diff('day', as_of, today) > CASE feed WHEN 'reconciliation' THEN 45 WHEN 'index lists' THEN 12 WHEN 'prices' THEN 4 WHEN 'quotes' THEN 4 ELSE 14 END AS stale, feed = (SELECT arg_min(feed, (as_of, feed)) FROM f) AS governs FROM f, t")
def feed_freshness(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    name = F.col("o_orderpriority")
    feed = F.when(name == "1-URGENT", "prices").when(name == "2-HIGH", "quotes").when(name == "3-MEDIUM", "index lists").when(name == "5-LOW", "reconciliation").otherwise("other")
    rows = o.groupBy(name).agg(F.max("o_orderdate").cast("date").alias("m")).select(feed.alias("feed"), F.expr("date_sub(m, cast((ascii(o_orderpriority) - 49) * 5 as int))").alias("as_of"))
    return A.freshness(rows, o.agg(F.max("o_orderdate").cast("date").alias("t")).scalar())


def _summary_line(label: str, i: int | str) -> str:
    first, rate, day = f"c_{label}", f"r_{label}", f"d_{label}"
    own = f"CASE WHEN d_0 > {day} THEN (c_0 / {first} - 1) * 100 END"
    conv = f"CASE WHEN d_0 > {day} THEN ((c_0 * r_0) / ({first} * {rate}) - 1) * 100 END"
    return f"SELECT name, '{label}' AS horizon, {_half_up(own, 3)} AS own_pct, {_half_up(conv, 3)} AS converted_pct, {day} AS measured_from FROM g"


def _at(i: str, name: str) -> str:
    return ", ".join(f"max({c}) FILTER ({i}) AS {p}_{name}" for c, p in (("close", "c"), ("rate", "r"), ("d", "d")))


SUMMARY = SERIES + f""", p AS (SELECT s.*, CASE WHEN date_diff('day', fx.d, s.d) <= 7 THEN fx.rate END AS rate, row_number() OVER (PARTITION BY s.name ORDER BY s.d DESC) AS i, count(*) OVER (PARTITION BY s.name) AS n,
 max(CASE WHEN s.d <= DATE '1998-01-01' THEN s.d END) OVER (PARTITION BY s.name) AS anchor FROM s ASOF LEFT JOIN fx ON s.d >= fx.d),
g AS (SELECT name, {_at('i = 1', '0')}, {_at('i = least(2, n)', '1d')}, {_at('i = least(22, n)', '1m')}, {_at('i = least(64, n)', '3m')}, {_at('i = least(251, n)', '1y')}, {_at('d = anchor', 'since')} FROM p GROUP BY name),
l AS ({' UNION ALL '.join(_summary_line(x, x) for x in ('1d', '1m', '3m', '1y', 'since'))}) SELECT *, {_half_up('converted_pct - own_pct', 3)} AS fx_pp FROM l"""


@query(SUMMARY)
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    daily = _daily(spark, d)
    return B.summary(daily, _fx(daily), "1998-01-01")


@query(COMPANY + ", w AS (SELECT 'eem' AS fund, p_partkey, ext_hold, price, shares FROM seg WHERE in_eem UNION ALL SELECT 'smin', p_partkey, ext_hold, price, shares FROM seg WHERE in_smin UNION ALL SELECT 'eems', p_partkey, ext_hold, price, shares FROM seg WHERE in_eems), m AS (SELECT *, 100 * CAST(ext_hold AS DOUBLE) / sum(CAST(ext_hold AS DOUBLE)) OVER (PARTITION BY fund) AS weight, shares * price AS now, shares * (price * (1 + (p_partkey % 5 - 2) / 100)) AS captured FROM w), r AS (SELECT fund, sum(now) / sum(captured) AS basket FROM m GROUP BY 1) " + f"SELECT m.fund, p_partkey, {_half_up('weight * (now / captured / basket)', 6)} AS implied, {_half_up('weight * (now / captured / basket) - weight', 6)} AS drift_pp, false AS requires_trade FROM m JOIN r ON m.fund = r.fund WHERE now IS NOT NULL AND captured > 0")
def basket_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_funds(C.companies(spark, d))
    out = A.drift_members(rows, C.fund_weights(rows).withColumnRenamed("weight_pct", "weight")).filter("drift IS NOT NULL")
    return out.select("fund", "p_partkey", rounded(F.col("drift.implied"), 6).alias("implied"), rounded(F.col("drift.drift_pp"), 6).alias("drift_pp"), F.col("drift.requires_trade").alias("requires_trade"))


@query(COMPANY + f", v AS (SELECT CAST(sum(ext_hold) FILTER (in_eem) AS DOUBLE) AS eem, CAST(sum(ext_hold) FILTER (in_smin) AS DOUBLE) AS smin, CAST(sum(ext_hold) FILTER (in_eems) AS DOUBLE) AS eems FROM seg), l AS (SELECT 'eem' AS fund, eem AS x FROM v UNION ALL SELECT 'smin', smin FROM v UNION ALL SELECT 'eems', eems FROM v) SELECT fund, {_half_up('x / 100 * 83 / 100', 2)} AS inr_per_point, {_half_up('x / 100 * 83 / 100 / 100', 2)} AS inr_per_bp, {_half_up('x / 100 * 83 / 100 / 1e7', 6)} AS crore_per_point FROM l")
def flow_primitives(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_funds(C.companies(spark, d))
    sums = rows.agg(*(F.sum(F.when(F.col(f"in_{f}"), F.col("ext_hold"))).alias(f) for f in C.FUNDS))
    long = sums.select(F.explode(F.array(*(F.struct(F.lit(f).alias("fund"), F.col(f).alias("x")) for f in C.FUNDS))).alias("r")).select("r.*")
    p = scalar.flow_primitives(F.col("x") / 100, F.lit(C.FX))
    return long.select("fund", rounded(p["inr_per_point"], 2).alias("inr_per_point"), rounded(p["inr_per_bp"], 2).alias("inr_per_bp"), rounded(p["crore_per_point"], 6).alias("crore_per_point"))


_FACTOR = "CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 20 = 0 THEN 2.0 WHEN p_partkey % 20 = 7 THEN 1.25 WHEN p_partkey % 20 = 9 THEN 0.5 WHEN p_partkey % 20 = 13 THEN 1.17 ELSE 1 + (p_partkey % 7) / 1000 END"
RECONCILE = COMPANY + f""", x AS (SELECT p_partkey AS key, shares, price, factor, shares * price AS full_cap, shares * price * CAST({_FACTOR} AS DOUBLE) AS other_cap, CASE WHEN p_partkey % 17 <> 5 THEN price END AS quote,
 CASE WHEN p_partkey % 3 = 0 THEN factor * shares * 1.001 WHEN p_partkey % 3 = 1 THEN factor * shares * CAST({_FACTOR} AS DOUBLE) END AS free FROM company),
c AS (SELECT *, (other_cap - full_cap) / full_cap * 100 AS gap, other_cap / quote AS theirs, other_cap / quote / shares AS ratio, free / factor AS third FROM x WHERE full_cap > 0 AND other_cap > 0) """


@query(RECONCILE + f", o AS (SELECT *, CASE WHEN third IS NULL THEN NULL WHEN abs(third / shares - 1) < 0.02 THEN 'ours' WHEN coalesce(abs(third / theirs - 1) < 0.02, false) THEN 'theirs' ELSE 'neither' END AS side FROM c WHERE abs(gap) > 10) SELECT key, CASE side WHEN 'ours' THEN 'resolved-ours' WHEN 'theirs' THEN 'resolved-theirs' ELSE 'quarantine' END AS status, side AS agrees_with, {_half_up('gap', 3)} AS gap_pct, {_half_up('ratio', 4)} AS share_ratio, CASE WHEN abs(ratio - 2) / 2 <= 0.002 THEN 2.0 WHEN abs(ratio - 0.5) / 0.5 <= 0.002 THEN 0.5 WHEN abs(ratio - 1.25) / 1.25 <= 0.002 THEN 1.25 END::DOUBLE AS action FROM o")
def share_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return R.adjudicated(_reconciled_rows(spark, d)).drop("cause")


def _reconciled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Companies with the value and quote of a second source, and free shares of a third one for two of three."""
    k = F.col("p_partkey")
    off = F.when(k % 13 == 0, None).when(k % 20 == 0, 2.0).when(k % 20 == 7, 1.25).when(k % 20 == 9, 0.5).when(k % 20 == 13, 1.17).otherwise(1 + (k % 7) / 1000)
    free = F.when(k % 3 == 0, F.col("factor") * F.col("shares") * 1.001).when(k % 3 == 1, F.col("factor") * F.col("shares") * off)
    return C.companies(spark, d).select(k.alias("key"), "shares", "price", "factor", (F.col("shares") * F.col("price") * off).alias("other_cap"), F.when(k % 17 != 5, F.col("price")).alias("quote"), free.alias("implied_free"))


def _holding_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    part, cust, supp = _t(spark, d, "part"), _t(spark, d, "customer"), _t(spark, d, "supplier")
    k = F.col("p_partkey")
    ticker = F.expr("CASE p_partkey % 10 WHEN 0 THEN '--' WHEN 1 THEN concat('C', p_partkey) WHEN 2 THEN cast(p_partkey as string) WHEN 3 THEN concat('n', p_partkey % 150) WHEN 4 THEN concat('D.', p_partkey % 400) WHEN 7 THEN if(p_partkey % 20 = 7, 'PINA', 'PINB') WHEN 8 THEN 'BLK' ELSE concat('X', p_partkey) END")
    name = F.expr("CASE WHEN p_partkey % 10 = 8 THEN concat('Blocked Ltd ', p_partkey) WHEN p_partkey % 10 IN (3, 5) THEN concat('The Customer#', lpad(cast(p_partkey as string), 9, '0'), ' Limited') WHEN p_partkey % 10 = 6 THEN concat('Dup ', p_partkey % 50) ELSE p_name END")
    holdings = part.select(k.alias("key"), ticker.alias("ticker"), name.alias("name"))
    isin = F.expr("concat('INC', lpad(cast(c_custkey as string), 8, '0'), '1')")
    master = cust.select(F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("scrip_code"), F.expr("concat('C', c_custkey)").alias("scrip_id"), isin.alias("isin"), F.expr("if(c_custkey % 10 = 3, concat('Dup Co ', c_custkey % 50), c_name)").alias("name"))
    universe = supp.select(F.col("s_suppkey").alias("ord"), F.expr("concat('N', s_suppkey)").alias("symbol"), F.expr("concat(if(s_suppkey % 2 = 0, 'INC', 'INS'), lpad(cast(s_suppkey as string), 8, '0'), '1')").alias("isin"), F.col("s_name").alias("name"))
    seed = cust.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("ord"), F.expr("concat('D-', c_custkey)").alias("symbol"), isin.alias("isin"), F.expr("cast(if(c_custkey % 8 = 0, c_custkey + 1, c_custkey) as string)").alias("scrip_code"), F.col("c_name").alias("name"))
    confirmed = spark.createDataFrame([(2, "PINB", "6", "INC000000071"), (1, "PINA", "5", "INC000000051"), (3, "PINA", "6", "INC000000061")], "ord int, ticker string, scrip_code string, isin string")
    blocked = spark.createDataFrame([(2, "BLK", "Blocked", "listed elsewhere"), (1, "BLK", "Blocked Ltd", "not listed")], "ord int, ticker string, name_prefix string, reason string")
    return holdings, master, universe, seed, confirmed, blocked


RESOLVE = """WITH h AS (SELECT p_partkey AS key, p_partkey % 10 AS r, p_partkey AS k FROM part), c AS (SELECT c_custkey AS k, 'INC' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '1' AS isin FROM customer),
x AS (SELECT h.key, r, ci.isin AS id_isin, h.k, s.s_suppkey AS nk, CASE WHEN s.s_suppkey % 2 = 0 THEN 'INC' ELSE 'INS' END || lpad(CAST(s.s_suppkey AS VARCHAR), 8, '0') || '1' AS n_isin, nc.k AS n_code, d.k AS dk, d.isin AS d_isin,
 CASE WHEN r IN (3, 5) AND h.k % 10 <> 3 THEN nm.isin END AS name_isin, CASE WHEN r IN (3, 5) AND h.k % 10 <> 3 THEN nm.k END AS name_code, dup.hits, dup.isin AS dup_isin, dup.k AS dup_k FROM h
 LEFT JOIN c ci ON ci.k = h.k LEFT JOIN supplier s ON r = 3 AND s.s_suppkey = h.k % 150 LEFT JOIN c nc ON s.s_suppkey % 2 = 0 AND nc.k = s.s_suppkey LEFT JOIN c d ON r = 4 AND d.k = h.k % 400 AND d.k % 4 = 0 LEFT JOIN c nm ON nm.k = h.k
 LEFT JOIN (SELECT k % 50 AS m, count(*) AS hits, min(isin) AS isin, min(k) AS k FROM c WHERE k % 10 = 3 GROUP BY 1) dup ON r = 6 AND dup.m = h.k % 50)
SELECT key, CASE WHEN r = 8 THEN 'none' WHEN r = 7 AND key % 20 = 7 THEN 'confirmed' WHEN r = 7 THEN 'none' WHEN r = 1 AND id_isin IS NOT NULL THEN 'scrip_id' WHEN r = 2 AND id_isin IS NOT NULL THEN 'scrip_code' WHEN r IN (2, 0) THEN 'none' WHEN nk IS NOT NULL OR dk IS NOT NULL THEN 'isin' WHEN name_isin IS NOT NULL THEN 'name' WHEN hits = 1 THEN 'name' ELSE 'none' END AS method,
 CASE WHEN r = 7 AND key % 20 = 7 THEN 'INC000000051' WHEN r IN (7, 8) THEN NULL WHEN r IN (1, 2) THEN id_isin WHEN nk IS NOT NULL THEN n_isin WHEN dk IS NOT NULL THEN d_isin WHEN name_isin IS NOT NULL THEN name_isin WHEN hits = 1 THEN dup_isin END AS isin,
 CASE WHEN r = 7 AND key % 20 = 7 THEN '5' WHEN r IN (7, 8) THEN NULL WHEN r IN (1, 2) THEN CASE WHEN id_isin IS NOT NULL THEN CAST(k AS VARCHAR) END WHEN nk IS NOT NULL THEN CAST(n_code AS VARCHAR) WHEN dk % 8 = 0 THEN NULL WHEN dk IS NOT NULL THEN CAST(dk AS VARCHAR) WHEN name_isin IS NOT NULL THEN CAST(name_code AS VARCHAR) WHEN hits = 1 THEN CAST(dup_k AS VARCHAR) END AS scrip_code,
 CASE WHEN r = 8 THEN 'not listed' WHEN r = 7 AND key % 20 <> 7 THEN 'confirmed mapping of PINB no longer agrees with the master' WHEN r = 2 AND id_isin IS NULL THEN k || ' reads as a scrip code and is not in the master' WHEN r = 0 THEN 'no ticker' WHEN r = 1 AND id_isin IS NOT NULL OR r IN (2, 7) OR nk IS NOT NULL OR dk IS NOT NULL OR name_isin IS NOT NULL OR hits = 1 THEN NULL WHEN hits > 1 THEN 'the name matches ' || hits || ' scrips' ELSE 'no match' END AS reason FROM x """


@query(RESOLVE)
def resolve_holdings(spark: SparkSession, d: str) -> DataFrame:
    return identity.resolve_holdings(*_holding_tables(spark, d)).select("key", "method", "isin", "scrip_code", "reason")


@query(f"SELECT method, count(*) AS n FROM ({RESOLVE}) GROUP BY 1")
def resolve_holdings_histogram(spark: SparkSession, d: str) -> DataFrame:
    return identity.resolve_holdings(*_holding_tables(spark, d)).groupBy("method").agg(F.count("*").alias("n"))


@query("SELECT 'INC' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '1' AS isin, 'C' || s_suppkey AS ours, 'N' || s_suppkey AS theirs FROM supplier JOIN customer ON c_custkey = s_suppkey WHERE s_suppkey % 2 = 0")
def source_conflicts(spark: SparkSession, d: str) -> DataFrame:
    _, master, universe, *_ = _holding_tables(spark, d)
    return identity.conflicts(master.select("isin", F.col("scrip_id").alias("symbol")), universe)


@query("SELECT count(*) FILTER (c_custkey IS NULL) AS missing, count(s_suppkey) AS narrow, count(c_custkey) AS wide, count(*) FILTER (c_custkey IS NULL) = 0 AND count(c_custkey) > count(s_suppkey) AS ok FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def superset_check(spark: SparkSession, d: str) -> DataFrame:
    return identity.superset_problems(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), _t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


_LISTS = "SELECT 'a' AS source, 'S' || c_custkey AS symbol, CASE WHEN c_custkey % 9 = 0 THEN 'DUM' || c_custkey WHEN c_custkey % 11 = 0 THEN 'bad' ELSE 'INC' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '1' END AS isin, c_name AS name FROM customer UNION ALL SELECT 'b', 'S' || s_suppkey, 'INC' || lpad(CAST(s_suppkey + CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR), 8, '0') || '1', s_name FROM supplier"
LISTS = f"WITH l AS ({_LISTS}), w AS (SELECT *, CASE WHEN starts_with(isin, 'DUM') THEN 'placeholder' WHEN isin = 'bad' THEN 'malformed isin' END AS why FROM l), g AS (SELECT *, min(isin) OVER (PARTITION BY symbol) <> max(isin) OVER (PARTITION BY symbol) AS two FROM w WHERE why IS NULL) "


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = _t(spark, d, "customer").select(F.lit("a").alias("source"), F.expr("concat('S', c_custkey)").alias("symbol"), F.expr("CASE WHEN c_custkey % 9 = 0 THEN concat('DUM', c_custkey) WHEN c_custkey % 11 = 0 THEN 'bad' ELSE concat('INC', lpad(cast(c_custkey as string), 8, '0'), '1') END").alias("isin"), F.col("c_name").alias("name"))
    b = _t(spark, d, "supplier").select(F.lit("b").alias("source"), F.expr("concat('S', s_suppkey)").alias("symbol"), F.expr("concat('INC', lpad(cast(s_suppkey + if(s_suppkey % 10 = 0, 1, 0) as string), 8, '0'), '1')").alias("isin"), F.col("s_name").alias("name"))
    return identity.merged_lists(a.unionByName(b))


@query(LISTS + "SELECT symbol, min(isin) AS isin, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM g WHERE NOT two GROUP BY 1")
def index_lists_union(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d)[0].select("symbol", "isin", F.array_join("sources", ",").alias("sources"))


@query(LISTS + "SELECT reject_reason, count(*) AS n FROM (SELECT why AS reject_reason FROM w WHERE why IS NOT NULL UNION ALL SELECT 'two isins' FROM g WHERE two) GROUP BY 1")
def index_lists_rejects(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d)[1].groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("SELECT key, problem FROM (SELECT p_partkey AS key, CASE WHEN NOT f / o BETWEEN 0.01 AND 100 THEN 'magnitude' WHEN o >= 2e10 AND f < 1e5 THEN 'small rupees' END AS problem FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN p_retailprice / 1e7 ELSE p_retailprice END AS f, p_retailprice * (1 + p_partkey % 3) AS o FROM part)) WHERE problem IS NOT NULL")
def magnitude_check(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.col("p_retailprice"), F.col("p_partkey")
    part = _t(spark, d, "part")
    rows = part.select(k.alias("key"), F.when(k % 50 == 0, p / 1e7).otherwise(p).alias("full"))
    return A.magnitude_problems(rows, part.select(k.alias("key"), (p * (1 + k % 3)).alias("other")), "key")


@query("SELECT count(*) AS n, count(*) FILTER (p_partkey % 4 = 0) AS exact, count(*) FILTER (p_partkey % 4 IN (0, 1)) AS near FROM part")
def price_date_evidence(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.col("p_retailprice"), F.col("p_partkey")
    part = _t(spark, d, "part")
    return A.price_evidence(part.select("p_partkey", p.alias("seed_price")), part.select("p_partkey", (p * F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 1.005).otherwise(1.5)).alias("close")), "p_partkey")


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    seed = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 6 == 0, "neither").otherwise("both").alias("listing"))
    return A.uncovered(seed, _t(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key")), "key").select("key")


@query("SELECT p_partkey AS key, p_retailprice + CASE WHEN p_partkey % 8 = 0 THEN 0.02 ELSE 0 END AS prev_close, p_retailprice AS yesterday FROM part WHERE p_partkey % 8 = 0 AND p_partkey % 5 <> 0")
def close_continuity(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.col("p_retailprice"), F.col("p_partkey")
    part = _t(spark, d, "part")
    today = part.select(k.alias("key"), (p + F.when(k % 8 == 0, 0.02).otherwise(0)).alias("prev_close"), F.lit("2024-01-03").cast("date").alias("trade_date"))
    before = part.select(k.alias("key"), p.alias("close"), F.lit("2024-01-02").cast("date").alias("trade_date"), F.when(k % 5 == 0, 1).otherwise(0).alias("stale_days"))
    return A.close_mismatches(today, before, "key")


@query("SELECT field, count(*) AS n, count(*) FILTER (moved) AS moved FROM (SELECT 'acctbal' AS field, s_suppkey % 3 = 0 AS moved FROM supplier UNION ALL SELECT 'nation', false FROM supplier) GROUP BY 1")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    moves = A.snapshot_moves(s, s.withColumn("acctbal", F.when(F.col("s_suppkey") % 3 == 0, F.col("acctbal") + 1).otherwise(F.col("acctbal"))), "s_suppkey", ["acctbal", "nation"])
    return moves.groupBy("field").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved"))


@query("SELECT p_partkey, CASE WHEN live > 0 THEN live WHEN close > 0 THEN close END AS price, CASE WHEN live > 0 THEN 'live' WHEN close > 0 AND stale > 0 THEN 'stale' WHEN close > 0 THEN 'eod' END AS tier FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice + 1 WHEN p_partkey % 3 = 1 THEN 0 END AS live, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS close, p_partkey % 2 AS stale FROM part)")
def price_tier(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.col("p_retailprice"), F.col("p_partkey")
    choice = scalar.price_choice(F.when(k % 3 == 0, p + 1).when(k % 3 == 1, 0.0), F.lit(None).cast("double"), F.when(k % 5 != 0, p), F.lit(None).cast("double"), (k % 2).cast("int"))
    return _t(spark, d, "part").select("p_partkey", choice["price"].alias("price"), choice["tier"].alias("tier"))


@query("SELECT p_partkey, CASE WHEN f > 0 AND f <= 1.02 THEN f END AS factor FROM (SELECT p_partkey, floor(p_partkey % 130 / 100 * 1e6 + 0.5) / 1e6 AS f FROM part)")
def derived_factor(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", scalar.derived_factor((F.col("p_partkey") % 130).cast("double"), F.lit(100.0)).alias("factor"))


@query("SELECT listing, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'both' WHEN p_partkey % 2 = 0 THEN 'bse-only' WHEN p_partkey % 3 = 0 THEN 'nse-only' ELSE 'neither' END AS listing FROM part) GROUP BY 1")
def listing_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    c = scalar.listing_class(F.when(k % 2 == 0, k.cast("string")), F.when(k % 3 == 0, k.cast("string")).otherwise(" "))
    return _t(spark, d, "part").groupBy(c.alias("listing")).agg(F.count("*").alias("n"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'bse-code' ELSE 'nse' END AS kind FROM part) GROUP BY 1")
def ticker_classes(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE p_partkey % 4 WHEN 0 THEN ' -- ' WHEN 1 THEN cast(p_partkey as string) ELSE concat('m.', p_partkey) END")
    return _t(spark, d, "part").groupBy(scalar.ticker_class(t).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_partkey % 5 IN (0, 1) AS listed, p_partkey % 5 = 0 AS recent, CASE WHEN p_partkey % 7 = 0 THEN 'free float above full value' END AS rejected, 'T-' || p_partkey AS ticker, CASE WHEN p_partkey % 3 = 0 THEN 'bse:' || p_partkey ELSE 'IN' || p_partkey END AS company FROM part")
def key_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    isin = F.expr("concat('INE', lpad(cast(p_partkey % 1000000 as string), 6, '0'), CASE p_partkey % 5 WHEN 0 THEN '0A1' WHEN 1 THEN '0AX' WHEN 2 THEN '0A' WHEN 3 THEN 'a01' ELSE '0A10' END)")
    key = scalar.company_key(F.when(k % 3 != 0, F.concat(F.lit("IN"), k.cast("string"))), k)
    return _t(spark, d, "part").select(k, scalar.listed_isin(isin).alias("listed"), scalar.recent_isin(isin).alias("recent"), scalar.float_over_full(F.when(k % 7 == 0, 1.002).otherwise(1.0005), F.lit(1.0)).alias("rejected"), scalar.normalised_ticker(F.concat(F.lit(" t."), k.cast("string"))).alias("ticker"), key.alias("company"))


@query("WITH x AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id - 3000) * 12345.678 END AS v FROM events), a AS (SELECT *, CAST(CAST(floor(abs(v)) AS BIGINT) AS VARCHAR) AS w, printf('%.2f', abs(v)) AS t FROM x), g AS (SELECT *, split_part(t, '.', 1) AS i, split_part(t, '.', 2) AS f FROM a) SELECT event_id, CASE WHEN v IS NULL THEN '—' ELSE CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN length(i) > 3 THEN rtrim(regexp_replace(reverse(left(i, length(i) - 3)), '(\\d\\d)', '\\1,', 'g'), ',').reverse() || ',' || right(i, 3) ELSE i END || '.' || f END AS text FROM g")
def indian_grouping(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return _t(spark, d, "events").select(k, fmt.grouped(F.when(k % 9 != 0, (k - 3000) * F.lit(12345.678)), 2).alias("text"))


@query("SELECT event_id, CASE WHEN v = 0 THEN '0.00%' WHEN abs(v) < 0.005 THEN CASE WHEN v < 0 THEN '>-' ELSE '<' END || '0.01%' ELSE CASE WHEN v > 0 THEN '+' ELSE '' END || printf('%.2f', v) || '%' END AS text, CASE WHEN v = 0 THEN '0' WHEN abs(v) < 0.5 THEN CASE WHEN v < 0 THEN '>-1' ELSE '<1' END ELSE CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) END AS n FROM (SELECT event_id, (event_id % 400 - 200) * 0.00327 AS v FROM events)")
def floored_percent(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("event_id") % 400 - 200) * F.lit(0.00327)
    return _t(spark, d, "events").select("event_id", fmt.signed_percent(v).alias("text"), fmt.count_text(v).alias("n"))


@query("SELECT event_id, CASE WHEN c = 0 THEN '₹0 Cr' WHEN c < 0.01 THEN '<₹0.01 Cr' WHEN c >= 100 THEN '₹' || printf('%.0f', c) || ' Cr' WHEN c >= 10 THEN '₹' || printf('%.1f', c) || ' Cr' ELSE '₹' || printf('%.2f', c) || ' Cr' END AS flow, day(ts) || ' ' || strftime(ts, '%b') || ' ' || year(ts) AS day FROM (SELECT event_id, ts, abs((event_id % 700 - 300) * 12345.7 * CASE WHEN event_id % 3 = 0 THEN 400 WHEN event_id % 3 = 1 THEN 10 ELSE 0.01 END) / 1e7 AS c FROM events)")
def flow_and_date_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    v = (k % 700 - 300) * F.lit(12345.7) * F.when(k % 3 == 0, 400.0).when(k % 3 == 1, 10.0).otherwise(0.01)
    return _t(spark, d, "events").select(k, fmt.flow_text(v).alias("flow"), fmt.short_date(F.col("ts").cast("date")).alias("day"))


@query("SELECT s, CASE WHEN s < 45 THEN 'just now' WHEN s < 60 THEN s || ' seconds ago' WHEN s < 3600 THEN s // 60 || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN s // 3600 || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 2592000 THEN s // 86400 || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' ELSE s // 2592000 || ' month' || CASE WHEN s // 2592000 = 1 THEN '' ELSE 's' END || ' ago' END AS ago FROM (SELECT DISTINCT event_id * event_id % 9000000 AS s FROM events)")
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("event_id") * F.col("event_id") % 9000000).alias("s")
    return _t(spark, d, "events").select(s).distinct().select("s", fmt.relative_time(F.col("s")).alias("ago"))


@query("SELECT d, (SELECT max(e) FROM e WHERE e <= d) AS before, (SELECT string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) FROM (SELECT e FROM e WHERE e > d ORDER BY e LIMIT 3)) AS next3 FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)".join(["WITH m AS (SELECT CAST(x AS DATE) AS x FROM range(DATE '1989-01-01', DATE '2006-01-01', INTERVAL 1 MONTH) r(x) WHERE month(x) IN (2, 5, 8, 11)), e AS (SELECT last_day(x) - CAST(greatest(isodow(last_day(x)) - 5, 0) AS INTEGER) AS e FROM m) ", ""]))
def review_neighbours(spark: SparkSession, d: str) -> DataFrame:
    days = _t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.select("d", scalar.previous_review(F.col("d")).alias("before"), F.array_join(F.transform(scalar.upcoming_reviews(F.col("d"), 3), lambda x: x.cast("string")), ",").alias("next3"))


@query("SELECT event_id, l - CAST(greatest(isodow(l) - 5, 0) AS INTEGER) AS trade_date FROM (SELECT event_id, CASE WHEN hour(t) * 60 + minute(t) > 930 THEN CAST(t AS DATE) ELSE CAST(t AS DATE) - 1 END AS l FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS t FROM events))")
def latest_trade_dates(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", scalar.latest_trade_date(F.col("ts").cast("timestamp")).alias("trade_date"))


@query("SELECT p_partkey, p_name, r FROM (SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS r FROM part WHERE p_partkey IN (SELECT o_custkey FROM orders)) ORDER BY CASE r % 4 WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END, p_partkey LIMIT 60")
def watchlist_ordinal_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("r"))
    rows = watched(rows, _t(spark, d, "orders").select(F.col("o_custkey").alias("p_partkey")), "p_partkey")
    return rows.orderBy(ordinal((F.col("r") % 4).cast("string"), ("2", "0", "3", "1")), "p_partkey").limit(60)


@query("SELECT p_partkey, v FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice - 1500 END AS v FROM part) ORDER BY coalesce(v, 0) DESC, p_partkey LIMIT 900")
def build_sort_null_as_zero(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice") - 1500).alias("v"))
    return rows.orderBy(F.coalesce("v", F.lit(0.0)).desc(), "p_partkey").limit(900)


@query("SELECT s, k FROM (SELECT 'Item ' || p_partkey % 500 AS s, min(p_partkey) AS k, min(p_partkey % 500) AS n FROM part GROUP BY 1) ORDER BY n LIMIT 100")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    """Text order in which 9 comes before 10."""
    rows = _t(spark, d, "part").groupBy(F.concat(F.lit("Item "), F.col("p_partkey") % 500).alias("s")).agg(F.min("p_partkey").alias("k"))
    return rows.orderBy(natural_order(F.col("s"))).limit(100)


@query("SELECT user_id, string_agg(DISTINCT upper(event_type), ',' ORDER BY upper(event_type)) AS kinds FROM events GROUP BY 1")
def canonical_sets(spark: SparkSession, d: str) -> DataFrame:
    per = _t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return per.select("user_id", scalar.canonical_set(F.transform("s", lambda x: F.concat(F.lit(" "), x))).alias("kinds"))


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def file_digests(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", scalar.file_digest(F.col("c_name")).alias("digest"))


_TEXTS = "CASE p_partkey % 10 WHEN 0 THEN '5d' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN '-' WHEN 4 THEN '1,234.50' WHEN 5 THEN '0' WHEN 6 THEN '-3' WHEN 7 THEN '' WHEN 8 THEN ' 7.25 ' ELSE cast(p_partkey as string) END"


@query("SELECT p_partkey, CASE p_partkey % 10 WHEN 4 THEN 1234.5 WHEN 8 THEN 7.25 WHEN 9 THEN p_partkey END::DOUBLE AS price, CASE p_partkey % 10 WHEN 4 THEN 1234.5 WHEN 5 THEN 0 WHEN 8 THEN 7.25 WHEN 9 THEN p_partkey END::DOUBLE AS n, CASE p_partkey % 10 WHEN 5 THEN 0 WHEN 6 THEN -3 WHEN 8 THEN 7.25 WHEN 9 THEN p_partkey END::DOUBLE AS csv, CASE p_partkey % 10 WHEN 4 THEN 1234.5 WHEN 5 THEN 0 WHEN 6 THEN -3 WHEN 8 THEN 7.25 WHEN 9 THEN p_partkey END::DOUBLE AS declared FROM part")
def lenient_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr(_TEXTS)
    return _t(spark, d, "part").select("p_partkey", parse.price(t).alias("price"), parse.count_value(t).alias("n"), parse.csv_number(t).alias("csv"), parse.declared_number(t).alias("declared"))


@query("SELECT event_id, value AS price, CASE WHEN event_id % 3 <> 0 THEN 1.5 END::DOUBLE AS lo, CASE WHEN event_id % 3 <> 0 THEN 1234.25 END::DOUBLE AS hi, CASE WHEN event_id % 4 <> 0 THEN DATE '2024-10-27' + CAST(event_id % 50 AS INTEGER) END AS split_date, CASE WHEN event_id % 5 <> 0 THEN 'A, B Ltd' END AS name FROM events WHERE value > 0")
def quote_records(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a `k=v` quote: number, range, date from epoch seconds, text; missing marks are null."""
    day = "unix_seconds(timestamp_seconds(1729987200 + 86400 * (event_id % 50)))"
    raw = F.expr(f"concat('Symbol=', user_id, ',Company Name=', if(event_id % 5 = 0, 'N/A', 'A, B Ltd'), ',52-Week Range=', if(event_id % 3 = 0, '-', '1.5 - 1,234.25'), ',Last Split Date=', if(event_id % 4 = 0, 'N/A', cast({day} as string)), ',Current Price=', cast(value as string))")
    rows = _t(spark, d, "events").filter("value > 0").select("event_id", raw.alias("raw")).withColumn("kv", parse.key_values(F.col("raw"))).select("event_id", parse.quote_record(F.col("kv"), F.col("raw"), F.lit(None).cast("double")).alias("q"))
    return rows.select("event_id", F.col("q.price").alias("price"), F.col("q.year_range.lo").alias("lo"), F.col("q.year_range.hi").alias("hi"), F.col("q.split_date").alias("split_date"), F.col("q.name").alias("name"))


@query("SELECT symbol, source, adv FROM (SELECT p_partkey AS symbol, CASE WHEN p_partkey % 2 = 0 THEN 'detail3m' WHEN p_partkey % 3 = 0 THEN 'batch3m' WHEN p_partkey % 5 = 0 THEN 'batch10d' END AS source, CASE WHEN p_partkey % 2 = 0 THEN 1.0 WHEN p_partkey % 3 = 0 THEN 2.0 WHEN p_partkey % 5 = 0 THEN 3.0 END::DOUBLE AS adv FROM part)")
def adv_with_source(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    got = parse.first_with_source({"detail3m": F.when(k % 2 == 0, 1.0), "batch3m": F.when(k % 3 == 0, 2.0), "batch10d": F.when(k % 5 == 0, 3.0)})
    return _t(spark, d, "part").select(k.alias("symbol"), got["source"].alias("source"), got["value"].alias("adv"))


@query(COMPANY + ", q AS (SELECT user_id, arg_max(value, (ts, event_id)) AS live FROM events WHERE event_type <> 'error' AND value > 0 GROUP BY 1) " + "SELECT p_partkey, CASE WHEN live > 0 THEN live ELSE price END AS price, CASE WHEN live > 0 THEN 'live' ELSE 'eod' END AS tier, CASE WHEN p_partkey % 53 <> 0 THEN floor(factor * shares * CASE WHEN live > 0 THEN live ELSE price END + 0.5) END AS ff, price AS eod_price FROM company LEFT JOIN q ON user_id = p_partkey")
def live_overlay(spark: SparkSession, d: str) -> DataFrame:
    quotes = live.latest(live.quotes(_t(spark, d, "events")))
    return live.overlaid(C.companies(spark, d), quotes, "p_partkey").select("p_partkey", "price", "tier", F.col("ff").cast("double").alias("ff"), "eod_price")


LIVE_VERDICT = COMPANY.replace("company AS (", "base_company AS (", 1).replace("held AS (SELECT *,", "q AS (SELECT user_id, arg_max(value, (ts, event_id)) AS live FROM events WHERE event_type <> 'error' AND value > 0 GROUP BY 1), company AS (SELECT * REPLACE (CASE WHEN p_partkey % 53 <> 0 THEN floor(factor * shares * coalesce(live, price) + 0.5) END AS ff) FROM base_company LEFT JOIN q ON user_id = p_partkey), held AS (SELECT *,", 1)


@query(f"SELECT o.p_partkey, o.verdict AS before, n.verdict AS after FROM ({COMPANY} SELECT p_partkey, verdict FROM verdict) o JOIN ({LIVE_VERDICT} SELECT p_partkey, verdict FROM verdict) n USING (p_partkey) WHERE o.verdict <> n.verdict")
def live_verdict_changes(spark: SparkSession, d: str) -> DataFrame:
    """Companies whose verdict the live prices change: the whole model is run again over the overlaid rows."""
    base = C.companies(spark, d)
    now = live.overlaid(base, live.latest(live.quotes(_t(spark, d, "events"))), "p_partkey")
    return live.verdict_changes(C.verdicts(C.with_funds(base)), C.verdicts(C.with_funds(now)), "p_partkey")


def _faulty(rows: DataFrame) -> DataFrame:
    """Assessed rows into which faults are put, by key, for the rules to find."""
    k = lambda n, r: F.col("p_partkey") % n == r
    put = lambda c, *faults: F.coalesce(*(F.when(cond, v) for cond, v in faults), F.col(c)).alias(c)
    gone = lambda c, cond: F.when(~cond, F.col(c)).alias(c)
    return rows.select(
        "p_partkey", "rules", "shares", "price", "ff", "in_eem", "ext_hold", "factor_a", put("verdict", (k(101, 1), F.lit("stable"))), F.when(k(103, 2), 1.5).otherwise(F.col("factor")).alias("factor"),
        gone("basis", k(107, 3)), put("quarantined", (k(109, 4), F.lit(True))), put("in_smin", (k(113, 5), F.lit(True)), (k(127, 6), F.lit(False))), put("in_eems", (k(127, 6), F.lit(True))),
        put("rule", (k(131, 7), F.lit("gap-switch"))), gone("factor_b", k(131, 7)),
    )


_REDERIVED = "CASE WHEN factor_a IS NULL AND fb IS NULL THEN 'none' WHEN fb IS NULL THEN 'only-a' WHEN factor_a IS NULL THEN 'only-b' WHEN abs(fb - factor_a) / factor_a > 0.01 THEN 'gap-switch' ELSE 'primary' END"
FAULTY = COMPANY + """, z AS (SELECT *, CASE WHEN p_partkey % 101 = 1 THEN 'stable' ELSE verdict END AS v2, CASE WHEN p_partkey % 103 = 2 THEN 1.5 ELSE factor END AS f2, CASE WHEN p_partkey % 107 = 3 OR ff IS NULL THEN 0 ELSE 1 END AS has_basis,
 CASE WHEN p_partkey % 109 = 4 THEN true ELSE quarantined END AS q2, CASE WHEN p_partkey % 113 = 5 THEN true WHEN p_partkey % 127 = 6 THEN false ELSE in_smin END AS s2, CASE WHEN p_partkey % 127 = 6 THEN true ELSE in_eems END AS e2,
 CASE WHEN p_partkey % 131 = 7 THEN 'gap-switch' ELSE rule END AS r2, CASE WHEN p_partkey % 131 = 7 THEN NULL ELSE factor_b END AS fb FROM verdict) """


@query(FAULTY + f"""SELECT rule, count(*) AS n FROM (SELECT 'disjoint' AS rule FROM z WHERE in_eem AND s2 UNION ALL SELECT 'sampler-subset' FROM z WHERE e2 AND NOT s2 UNION ALL SELECT 'replay' FROM z WHERE v2 <> verdict
 UNION ALL SELECT 'quarantine-unknown' FROM z WHERE q2 AND v2 <> 'unknown' UNION ALL SELECT 'factor-range' FROM z WHERE NOT (f2 > 0 AND f2 <= 1.02) UNION ALL SELECT 'choice-has-source' FROM z WHERE r2 IN ('gap-switch', 'only-b') AND fb IS NULL
 UNION ALL SELECT 'primary-has-source' FROM z WHERE r2 IN ('primary', 'only-a') AND factor_a IS NULL UNION ALL SELECT 'float-recovers' FROM z WHERE abs(f2 * shares * price - ff) > greatest(1, 1e-6 * ff) UNION ALL SELECT 'value-has-basis' FROM z WHERE (ff IS NULL) <> (has_basis = 0)
 UNION ALL SELECT 'choice-re-derives' FROM z WHERE r2 <> ({_REDERIVED}) UNION ALL SELECT 'label-agrees' FROM z WHERE f2 IS DISTINCT FROM (CASE WHEN r2 IN ('gap-switch', 'only-b') THEN fb ELSE factor_a END) UNION ALL SELECT 'no-zero-weight' FROM z WHERE (in_eem OR s2) AND ext_hold = 0) GROUP BY 1""")
def dq_violations(spark: SparkSession, d: str) -> DataFrame:
    return Q.violations(_faulty(C.assessed(spark, d)), "p_partkey", Q.company_rules()).groupBy("rule").agg(F.count("*").alias("n"))


@query(COMPANY + ", z AS (SELECT *, CASE WHEN p_partkey % 101 = 1 THEN 'stable' ELSE verdict END AS v2 FROM verdict) SELECT v2 AS verdict, count(*) AS n, count(*) FILTER (v2 <> verdict) AS mismatches FROM z GROUP BY 1")
def rules_replay_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose verdict does not follow from their rules, after some verdicts were overwritten."""
    rows = _faulty(C.assessed(spark, d))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(~C.replayed().eqNullSafe(F.col("verdict"))).alias("mismatches"))


FLOW_FAULTS = COMPANY + FLOW + """, y AS (SELECT p_partkey, CASE WHEN p_partkey % 31 = 1 THEN 'stable' ELSE verdict END AS verdict, CASE WHEN p_partkey % 37 = 3 AND direction = 'buy' THEN 'eems' ELSE fund END AS fund, direction, CASE WHEN adv > 0 THEN sh / adv END AS days,
 CASE WHEN p_partkey % 41 <> 4 THEN adv END AS adv FROM fl WHERE NOT (p_partkey % 29 = 2 AND direction = 'buy')), h AS (SELECT p_partkey FROM seg WHERE in_eems) """


@query(FLOW_FAULTS + """SELECT rule, count(*) AS n FROM (SELECT 'no-flow-of-the-stable' AS rule FROM y WHERE verdict IN ('stable', 'unknown') UNION ALL SELECT 'days-without-volume' FROM y WHERE adv IS NULL AND days IS NOT NULL
 UNION ALL SELECT 'sampler-holds' FROM y WHERE fund = 'eems' AND p_partkey NOT IN (SELECT p_partkey FROM h) UNION ALL SELECT 'migration-both-ways' FROM (SELECT p_partkey FROM y WHERE verdict LIKE 'migration%' GROUP BY 1 HAVING count(DISTINCT direction) < 2)) GROUP BY 1""")
def dq_flow_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = C.assessed(spark, d)
    k = F.col("p_partkey")
    put = C.flows(rows).filter(~((k % 29 == 2) & (F.col("direction") == "buy")))
    put = put.withColumn("verdict", F.when(k % 31 == 1, "stable").otherwise(F.col("verdict"))).withColumn("fund", F.when((k % 37 == 3) & (F.col("direction") == "buy"), "eems").otherwise(F.col("fund")))
    put = put.withColumn("adv", F.when(k % 41 != 4, F.col("adv")))
    found = Q.flow_violations(put, rows.filter("in_eems").select("p_partkey"), "p_partkey")
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT problem, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'isin' WHEN c_custkey % 11 = 0 THEN 'floor' WHEN c_custkey % 13 = 0 THEN 'repeated isin' END AS problem FROM customer) WHERE problem IS NOT NULL GROUP BY 1")
def dq_seed_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    isin = F.when(k % 9 == 0, "bad").when((k % 13 == 0) & (k % 11 != 0), "INC000000001").otherwise(F.concat(F.lit("INC"), F.lpad((k + 10).cast("string"), 8, "0"), F.lit("1")))
    seed = _t(spark, d, "customer").select(k.alias("key"), isin.alias("isin"), F.when(k % 11 == 0, 5.0).otherwise(5000.0).alias("cap"))
    return Q.seed_violations(seed, 2000.0).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def dq_inactive_codes(spark: SparkSession, d: str) -> DataFrame:
    master = _t(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.when(F.col("c_custkey") % 2 == 0, "active").otherwise("gone").alias("status"))
    return Q.inactive_codes(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("code")), master).select("key")


@query("SELECT name, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderpriority AS name FROM orders) GROUP BY 1 HAVING name <> '3-MEDIUM' AND NOT (name = '2-HIGH' AND false)")
def dq_expected_counts(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose number of rows is not the one an importer expects; here only one group is as expected."""
    per = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    right = per.filter("name = '3-MEDIUM'").withColumnRenamed("n", "expected")
    expected = right.unionByName(per.filter("name <> '3-MEDIUM'").select("name", (F.col("n") + 1).alias("expected")))
    return Q.unexpected(per, expected, "name").select("name", "n")


@query("SELECT count(*) AS n, 0::BIGINT + count(*) FILTER (event_id % 400 = 200) AS zeros, count(*) FILTER (event_id % 400 <> 200 AND event_id % 3 = 0) AS wrong FROM events")
def dq_zero_prints(spark: SparkSession, d: str) -> DataFrame:
    """Texts that print a number other than zero as zero: every third is printed without the floor, with no places."""
    v = (F.col("event_id") % 400 - 200) * F.lit(0.00001)
    shown = F.when(F.col("event_id") % 3 == 0, fmt.grouped(v)).otherwise(fmt.percent(v))
    rows = _t(spark, d, "events").select(v.alias("v"), shown.alias("shown"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("v") == 0).alias("zeros"), F.count_if(Q.prints_as_zero(F.col("v"), F.col("shown"))).alias("wrong"))


@query(SUMMARY + " WHERE horizon IN ('1m', '1y')")
def dq_returns_re_derive(spark: SparkSession, d: str) -> DataFrame:
    """Stored returns that differ from those of the series: two windows were stored a point too high."""
    fresh = stored(benchmark_summary(spark, d))
    kept = fresh.withColumn("own_pct", F.when(F.col("horizon").isin("1m", "1y"), F.col("own_pct") + 1).otherwise(F.col("own_pct")))
    return Q.not_re_derived(kept, fresh, ["name", "horizon"], "own_pct").select("name", "horizon", "own_pct", "converted_pct", "measured_from", "fx_pp")

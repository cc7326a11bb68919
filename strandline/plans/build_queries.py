"""The whole build of company records over the star-schema tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalar import rounded
from strandline.plans.build import Sources, company_records, universe
from strandline.plans.workload import COMPANY, QUERIES, SQL, _half_up, _t, query

__all__ = ["QUERIES", "SQL"]


def _isin(k: Column, prefix: str = "INE") -> Column:
    return F.concat(F.lit(prefix), F.lpad(k.cast("string"), 9, "0"))


def sources(spark: SparkSession, d: str) -> Sources:
    """Parts as scrips and companies, order lines as holdings and readings, customers as a seed list with companies of its own."""
    line, part, k, size = _t(spark, d, "lineitem"), _t(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    p, q = F.col("l_partkey"), F.col("l_quantity")
    fund = F.when(p % 5 == 0, "eem").when((p % 5 == 1) & (F.col("l_linenumber") % 2 == 0), "eems").when((p % 5).isin(1, 2), "smin")
    code, isin = F.when(p % 11 != 0, p.cast("string")), F.when(p % 7 != 0, _isin(p))
    holdings = line.select(
        fund.alias("fund"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_suppkey", "l_quantity").alias("ord"), isin.alias("isin"), code.alias("scrip_code"), F.when(p % 4 != 0, F.concat(F.lit("S"), p.cast("string"))).alias("symbol"),
        F.lit("universe").alias("symbol_source"), F.col("l_suppkey").cast("string").alias("name"), F.col("l_discount").alias("weight_pct"), q.alias("quantity"), F.col("l_extendedprice").alias("value_usd"),
    ).filter("fund IS NOT NULL")
    per = line.groupBy("l_partkey").agg(
        F.sum(q).alias("shares"), rounded(F.sum(F.when(F.col("l_linestatus") == "O", q)) / F.sum(q), 4).alias("factor"), F.sum(F.when(F.col("l_returnflag") == "N", q)).alias("implied"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.floor(F.col("l_extendedprice") + 0.5))).alias("rupees"), F.count("*").alias("n"),
    )
    rows = part.join(per, k == p, "left")
    scrips = rows.filter(size % 10 != 0).select(
        k.alias("ord"), k.cast("string").alias("scrip_code"), F.when(k % 7 != 0, _isin(k)).alias("isin"), F.col("p_name").alias("name"), F.when(size % 3 != 0, F.col("p_type")).alias("sector"), F.lit("equity").alias("kind"),
        (F.col("shares") * F.col("p_retailprice") * 1.01).alias("full_cap"), F.col("p_retailprice").alias("price"), "shares", F.when(size % 6 != 0, F.col("factor")).alias("factor"),
    )
    symbol = F.concat(F.lit("S"), k.cast("string"))
    c = F.col("c_custkey")
    seed = _t(spark, d, "customer").select(
        c.alias("ord"), F.when(c % 2 == 0, _isin(c)).otherwise(_isin(c, "INX")).alias("isin"), F.col("c_name").alias("name"), F.when(c % 3 == 0, F.concat(F.lit("T"), c.cast("string"))).alias("symbol"),
        F.when(c % 5 == 0, c.cast("string")).alias("scrip_code"), F.col("c_acctbal").alias("cap"), F.when(c % 4 != 0, F.col("c_mktsegment")).alias("sector"),
    )
    return Sources(
        holdings, scrips, part.filter((k % 4 != 0) & (k % 7 != 0)).select(_isin(k).alias("isin"), symbol.alias("symbol"), F.lit("universe").alias("symbol_source")), seed,
        rows.filter(size % 4 != 0).select(k.alias("ord"), symbol.alias("symbol"), F.col("implied").alias("implied_shares"), "rupees"),
        part.filter(size % 9 != 0).select(k.alias("ord"), k.cast("string").alias("scrip_code"), (F.col("p_retailprice") * 1.5).alias("close"), F.col("p_retailprice").alias("prev_close"), (size % 2).cast("int").alias("stale_days"), F.lit("2026-01-05").cast("date").alias("trade_date")),
        rows.select(k.alias("ord"), symbol.alias("symbol"), F.when(size % 2 == 0, F.col("n")).alias("detail_3m"), F.when(size % 3 == 0, F.col("n") + 1).alias("batch_3m"), F.when(size % 5 == 0, F.col("n") + 2).alias("batch_10d")),
        part.filter(k % 97 == 5).select(_isin(k).alias("isin"), F.when(size % 2 == 0, F.lit("counts differ")).alias("cause"), (size - 25).cast("double").alias("gap_pct")),
    )


BUILD = f"""WITH h AS (SELECT l_partkey AS k, CASE WHEN l_partkey % 5 = 0 THEN 'eem' WHEN l_partkey % 5 = 1 AND l_linenumber % 2 = 0 THEN 'eems' WHEN l_partkey % 5 IN (1, 2) THEN 'smin' END AS fund FROM lineitem),
held AS (SELECT k, count(*) FILTER (fund = 'eem') > 0 AS eem, count(*) FILTER (fund = 'smin') > 0 AS smin, count(*) FILTER (fund = 'eems') > 0 AS eems FROM h WHERE fund IS NOT NULL AND NOT (k % 7 = 0 AND k % 11 = 0) GROUP BY k),
per AS (SELECT l_partkey, sum(l_quantity) AS shares, {_half_up("sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) / sum(l_quantity)", 4)} AS bse, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS implied, sum(CASE WHEN l_returnflag = 'A' THEN floor(l_extendedprice + 0.5) END) AS rupees, count(*) AS n FROM lineitem GROUP BY 1),
pt AS (SELECT part.*, shares, bse, implied, rupees, n, p_size % 10 <> 0 AS listed FROM part LEFT JOIN per ON l_partkey = p_partkey),
u AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') ELSE 'bse:' || p_partkey END AS key, h.k IS NOT NULL AS was_held, CASE WHEN h.k IS NULL OR p_partkey % 11 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS code,
  CASE WHEN p_partkey % 4 <> 0 AND (h.k IS NOT NULL OR p_partkey % 7 <> 0) THEN 'S' || p_partkey END AS symbol, coalesce(eem, false) AS eem, coalesce(smin, false) AS smin, coalesce(eems, false) AS eems, pt.* FROM pt LEFT JOIN held h ON h.k = p_partkey WHERE h.k IS NOT NULL OR listed),
sd AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'INE' ELSE 'INX' END || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key, CASE WHEN c_custkey % 3 = 0 THEN 'T' || c_custkey END AS symbol, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) END AS seed_code, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg0 FROM customer),
fresh AS (SELECT * FROM sd WHERE key NOT IN (SELECT key FROM u)),
b AS (SELECT key, CASE WHEN was_held THEN 'holdings' ELSE 'scrips' END AS via, symbol, eem, smin, eems, was_held AND code IS NULL AS no_scrip, CASE WHEN listed THEN CASE WHEN p_size % 3 <> 0 THEN 'scrips' END END AS sector_source,
  CASE WHEN listed THEN shares * p_retailprice * 1.01 END AS full_cap, CASE WHEN listed THEN shares END AS shares, CASE WHEN listed AND p_size % 6 <> 0 THEN bse END AS bse, CASE WHEN symbol IS NOT NULL AND p_size % 4 <> 0 THEN implied END AS implied, CASE WHEN symbol IS NOT NULL AND p_size % 4 <> 0 THEN rupees END AS rupees,
  CASE WHEN code IS NOT NULL AND p_size % 9 <> 0 THEN p_retailprice * 1.5 END AS price, CASE WHEN code IS NOT NULL AND p_size % 9 <> 0 THEN CASE WHEN p_size % 2 > 0 THEN 'stale' ELSE 'eod' END END AS tier, p_partkey % 97 = 5 AND p_partkey % 7 <> 0 AS quarantined,
  CASE WHEN symbol IS NOT NULL THEN CASE WHEN p_size % 2 = 0 AND n IS NOT NULL THEN 'detail-3m' WHEN p_size % 3 = 0 AND n IS NOT NULL THEN 'batch-3m' WHEN p_size % 5 = 0 AND n IS NOT NULL THEN 'batch-10d' END END AS adv_source FROM u
 UNION ALL SELECT key, 'seed', symbol, false, false, false, true, CASE WHEN seg0 IS NOT NULL THEN 'seed' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, c_custkey % 97 = 5 AND c_custkey % 2 = 0 AND c_custkey IN (SELECT p_partkey FROM part), NULL FROM fresh WHERE symbol IS NOT NULL OR seed_code IS NOT NULL),
f1 AS (SELECT *, {_half_up('implied / CASE WHEN shares > 0 THEN shares END', 6)} AS r FROM b), f2 AS (SELECT *, CASE WHEN r > 0 AND r <= 1.02 THEN r END AS nse FROM f1), f3 AS (SELECT *, {_half_up('(nse - bse) / bse * 100', 3)} AS gap FROM f2),
f4 AS (SELECT *, CASE WHEN bse IS NOT NULL AND nse IS NOT NULL THEN CASE WHEN abs(gap) > 2 AND bse > 0 THEN 'nse-preferred-on-material-gap' ELSE 'bse-primary' END WHEN bse IS NOT NULL THEN 'bse-only' WHEN nse IS NOT NULL THEN 'nse-only' END AS rule0 FROM f3),
f5 AS (SELECT *, CASE WHEN rule0 LIKE 'bse%' THEN bse ELSE nse END AS factor, CASE WHEN rule0 IS NOT NULL AND full_cap IS NOT NULL THEN 'formed' WHEN rupees > 0 THEN 'rupees' END AS how FROM f4),
f6 AS (SELECT *, CASE WHEN rule0 IS NULL AND how = 'rupees' THEN 'nse-only-published-rupees' ELSE rule0 END AS frule, coalesce(CASE WHEN price > 0 THEN floor(factor * shares * price + 0.5) END, CASE how WHEN 'formed' THEN floor(factor * full_cap + 0.5) WHEN 'rupees' THEN floor(rupees + 0.5) END) AS ff FROM f5),
seg AS (SELECT *, key AS p_partkey, eems AS in_eems, CASE WHEN eem THEN 'standard' WHEN smin THEN 'smallcap' ELSE 'outside' END AS segment FROM f6),
""" + COMPANY[COMPANY.index("head AS (") :]


@query(BUILD + "SELECT key, via, symbol, eem OR smin OR eems AS held, no_scrip, sector_source, frule AS rule, factor, CAST(ff AS DOUBLE) AS ff, price, tier AS price_tier, adv_source, quarantined, segment, verdict FROM verdict")
def company_build(spark: SparkSession, d: str) -> DataFrame:
    """Every company of the build with what decides about it."""
    rows = company_records(sources(spark, d))
    return rows.select("key", "via", "symbol", "held", F.col("no_scrip_reason").isNotNull().alias("no_scrip"), "sector_source", F.col("choice.rule").alias("rule"), "factor", F.col("ff").cast("double").alias("ff"), "price", "price_tier", "adv_source", "quarantined", "segment", "verdict")


@query(BUILD + "SELECT key AS isin, c_custkey AS n FROM fresh WHERE symbol IS NULL AND seed_code IS NULL")
def company_build_side_list(spark: SparkSession, d: str) -> DataFrame:
    """Seed rows that are listed nowhere and become no company."""
    _, side = universe(sources(spark, d))
    return side.select("isin", F.substring("isin", 4, 9).cast("long").alias("n"))

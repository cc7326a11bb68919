"""Queries over whole records: what a resolved holding carries, a company with its slots and sides, choices with their reasons, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import format as fmt
from strandline.functions import scalar
from strandline.functions.scalar import rounded
from strandline.operators import identity
from strandline.plans import company as C
from strandline.plans import records as R
from strandline.plans.model_queries import _holding_tables
from strandline.plans.screen import Screen, listed, natural_order, screened, sort_clicked, unlike_intersection
from strandline.sources.readers import paired_arrays
from strandline.plans.workload import COMPANY, QUERIES, SQL, _half_up, _t, query

__all__ = ["QUERIES", "SQL"]

FUNDS = ("eem", "smin", "eems")


def _norm(name: str) -> str:
    return f"regexp_replace(regexp_replace(upper({name}), '\\b(LIMITED|LTD|THE|COMPANY|CO)\\b', ' ', 'g'), '[^A-Z0-9]+', '', 'g')"


HOLDINGS = f"""WITH holdings AS (SELECT p_partkey AS key, CASE p_partkey % 10 WHEN 0 THEN '--' WHEN 1 THEN 'C' || p_partkey WHEN 2 THEN CAST(p_partkey AS VARCHAR) WHEN 3 THEN 'n' || p_partkey // 10 % 150 WHEN 4 THEN 'D.' || p_partkey % 400
   WHEN 7 THEN CASE WHEN p_partkey % 20 = 7 THEN 'PINA' ELSE 'PINB' END WHEN 8 THEN 'BLK' ELSE 'X' || p_partkey END AS ticker,
  CASE WHEN p_partkey % 10 = 8 THEN 'Blocked Ltd ' || p_partkey WHEN p_partkey % 10 IN (3, 5) THEN 'The Customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || ' Limited' WHEN p_partkey % 10 = 6 THEN 'Dup ' || p_partkey % 50 ELSE p_name END AS name FROM part),
master AS (SELECT c_custkey AS ord, CAST(c_custkey AS VARCHAR) AS scrip_code, 'C' || c_custkey AS scrip_id, 'INC' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '1' AS isin, CASE WHEN c_custkey % 10 = 3 THEN 'Dup Co ' || c_custkey % 50 ELSE c_name END AS name FROM customer),
universe AS (SELECT s_suppkey AS ord, 'N' || s_suppkey AS symbol, CASE WHEN s_suppkey % 2 = 0 THEN 'INC' ELSE 'INS' END || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '1' AS isin, s_name AS name FROM supplier),
seed AS (SELECT c_custkey AS ord, 'D-' || c_custkey AS symbol, 'INC' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '1' AS isin, CAST(CASE WHEN c_custkey % 8 = 0 THEN c_custkey + 1 ELSE c_custkey END AS VARCHAR) AS scrip_code, c_name AS name FROM customer WHERE c_custkey % 4 = 0),
pins(ord, ticker, scrip_code, isin) AS (VALUES (1, 'PINA', '5', 'INC000000051'), (2, 'PINB', '6', 'INC000000071'), (3, 'PINA', '6', 'INC000000061')),
stops(ord, ticker, prefix, reason) AS (VALUES (1, 'BLK', 'BLOCKED', 'not listed'), (2, 'BLK', 'BLOCKED', 'listed elsewhere')),
nse AS (SELECT isin, min(symbol) AS symbol, 'nse-universe' AS source FROM universe GROUP BY isin HAVING count(*) = 1),
sym AS (SELECT * FROM nse UNION ALL SELECT isin, arg_min(symbol, ord), 'seed' FROM seed WHERE isin NOT IN (SELECT isin FROM nse) GROUP BY isin),
scrip AS (SELECT master.*, sym.symbol, sym.source FROM master LEFT JOIN sym USING (isin)),
lone AS (SELECT isin, min(scrip_code) AS code, min(scrip_id) AS id, min(name) AS name FROM master GROUP BY isin HAVING count(*) = 1),
names AS (SELECT {_norm('name')} AS n, count(*) AS hits, min(scrip_code) AS code FROM master GROUP BY 1),
h AS (SELECT key, trim(ticker) AS t, replace(upper(trim(ticker)), '.', '-') AS nt, {_norm('name')} AS n FROM holdings),
stop AS (SELECT key, arg_min(reason, ord) AS why FROM h JOIN stops ON t = ticker AND starts_with(n, prefix) GROUP BY key),
pin AS (SELECT ticker, arg_min(scrip_code, ord) AS code, arg_min(isin, ord) AS isin FROM pins GROUP BY ticker),
j AS (SELECT h.*, stop.why, pin.ticker IS NOT NULL AS pinned, pc.isin IS NOT DISTINCT FROM pin.isin AS agrees, pc.scrip_code AS pin_code, bi.scrip_code AS id_code, bc.scrip_code AS num_code, u.symbol AS u_symbol, u.isin AS u_isin, u.name AS u_name,
  sd.symbol AS s_symbol, sd.isin AS s_isin, sd.name AS s_name, CASE WHEN sc.scrip_code IS NULL THEN sl.code WHEN sc.isin = sd.isin THEN sc.scrip_code END AS s_code, ul.code AS u_code, names.hits, names.code AS name_code
 FROM h LEFT JOIN stop USING (key) LEFT JOIN pin ON h.t = pin.ticker LEFT JOIN scrip pc ON pc.scrip_code = pin.code LEFT JOIN scrip bi ON bi.scrip_id = t AND t NOT IN ('', '--') LEFT JOIN scrip bc ON bc.scrip_code = t
 LEFT JOIN universe u ON u.symbol = nt LEFT JOIN lone ul ON ul.isin = u.isin LEFT JOIN seed sd ON sd.symbol = nt LEFT JOIN scrip sc ON sc.scrip_code = sd.scrip_code LEFT JOIN lone sl ON sl.isin = sd.isin LEFT JOIN names ON names.n = h.n),
m AS (SELECT *, CASE WHEN why IS NOT NULL THEN 'none' WHEN pinned AND agrees THEN 'confirmed' WHEN pinned THEN 'none' WHEN id_code IS NOT NULL THEN 'scrip_id' WHEN regexp_full_match(t, '\\d+') THEN CASE WHEN num_code IS NULL THEN 'none' ELSE 'scrip_code' END
  WHEN t IN ('', '--') THEN 'none' WHEN u_symbol IS NOT NULL THEN 'universe' WHEN s_symbol IS NOT NULL THEN 'seed' WHEN hits = 1 THEN 'name' ELSE 'none' END AS how FROM j),
c AS (SELECT *, CASE how WHEN 'confirmed' THEN pin_code WHEN 'scrip_id' THEN id_code WHEN 'scrip_code' THEN num_code WHEN 'universe' THEN u_code WHEN 'seed' THEN s_code WHEN 'name' THEN name_code END AS code FROM m),
w AS (SELECT c.key, how, code, CASE how WHEN 'universe' THEN u_isin WHEN 'seed' THEN s_isin ELSE k.isin END AS isin, CASE how WHEN 'universe' THEN u_symbol WHEN 'seed' THEN s_symbol ELSE k.symbol END AS symbol,
  CASE how WHEN 'universe' THEN 'nse-universe' WHEN 'seed' THEN 'seed' ELSE k.source END AS source, k.scrip_id, coalesce(k.name, CASE how WHEN 'universe' THEN u_name WHEN 'seed' THEN s_name END) AS name FROM c LEFT JOIN scrip k ON k.scrip_code = c.code) """


@query(HOLDINGS + """SELECT key, CASE WHEN how IN ('universe', 'seed') THEN 'isin' ELSE how END AS method, CASE how WHEN 'none' THEN 'none' WHEN 'universe' THEN 'nse-universe' WHEN 'seed' THEN 'seed' ELSE 'isin' END AS via,
 CASE how WHEN 'none' THEN 'none' WHEN 'confirmed' THEN 'hand-checked' WHEN 'name' THEN 'normalised-name' ELSE 'exact' END AS confidence, isin, symbol, source AS symbol_source, code AS scrip_code, scrip_id, name AS resolved_name FROM w""")
def resolved_records(spark: SparkSession, d: str) -> DataFrame:
    """What each holding resolves to: scrip, name, and the exchange symbol of its ISIN with the list that says so; doubled pins and prefixes do not double a holding."""
    holdings, *lists = _holding_tables(spark, d)
    k = F.col("key")
    holdings = holdings.withColumn("ticker", F.when(k % 10 == 3, F.concat(F.lit("n"), F.expr("key div 10 % 150"))).otherwise(F.col("ticker")))
    rows = identity.resolve_holdings(holdings, *lists)
    return rows.select("key", "method", "via", "confidence", "isin", "symbol", "symbol_source", "scrip_code", "scrip_id", "resolved_name")


@query("WITH t AS (SELECT p_partkey, ['Á', 'a', 'Ab', 'B', 'é', 'E'][1 + p_size % 6] AS w, CASE WHEN p_partkey % 3 = 0 THEN '' || p_partkey WHEN p_partkey % 3 = 1 THEN '00' || p_partkey || '0000000000000000000' ELSE p_partkey || lpad('' || p_size, 21, '0') END AS n FROM part), o AS (SELECT *, row_number() OVER (ORDER BY lower(strip_accents(w)), length(ltrim(n, '0')), ltrim(n, '0'), p_partkey) AS place FROM t) SELECT p_partkey, w || n AS label, place FROM o WHERE place <= 500")
def collated_sort(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 labels of letters and numbers of up to 25 digits, in an order blind to case and accents that takes digits as numbers."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    w = F.get(F.array(*map(F.lit, ("Á", "a", "Ab", "B", "é", "E"))), F.col("p_size") % 6)
    n = F.when(F.col("p_partkey") % 3 == 0, k).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("00"), k, F.lit("0" * 19))).otherwise(F.concat(k, F.lpad(size, 21, "0")))
    rows = _t(spark, d, "part").select("p_partkey", F.concat(w, n).alias("label"))
    top = rows.orderBy(natural_order(F.col("label")), "p_partkey").limit(500)
    return top.select("p_partkey", "label", F.row_number().over(Window.orderBy(natural_order(F.col("label")), "p_partkey")).cast("long").alias("place"))  # of 500 rows


@query("SELECT click, p_partkey, CAST(place AS BIGINT) AS place FROM (SELECT 'another' AS click, p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS place FROM part UNION ALL SELECT 'again', p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) FROM part UNION ALL SELECT 'a third', p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) FROM part) WHERE place <= 40")
def header_clicks(spark: SparkSession, d: str) -> DataFrame:
    """Top rows after clicks on one head, on the same again, and on a third without a preferred direction."""
    spec, out = Screen(sort="p_size", limit=40), None
    for click, column in (("another", "p_retailprice"), ("again", "p_retailprice"), ("a third", "p_size")):
        spec = sort_clicked(spec, column, {"p_retailprice": "asc"})
        top = screened(_t(spark, d, "part"), spec, {}, ["p_name"], "p_partkey")
        order = F.desc(spec.sort) if spec.descending else F.asc(spec.sort)
        own = top.select(F.lit(click).alias("click"), "p_partkey", F.row_number().over(Window.orderBy(order, "p_partkey")).cast("long").alias("place"))  # of 40 rows
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT c_custkey, c_mktsegment, c_acctbal, CAST(row_number() OVER (ORDER BY c_mktsegment, abs(c_acctbal) DESC, c_custkey) AS BIGINT) AS place FROM customer QUALIFY place <= 300")
def listed_by_magnitude(spark: SparkSession, d: str) -> DataFrame:
    """Customers by segment, then by the size of their balance whatever its sign."""
    top = listed(_t(spark, d, "customer"), [("c_mktsegment", "asc"), ("c_acctbal", "abs")], "c_custkey", 300)
    place = F.row_number().over(Window.orderBy("c_mktsegment", F.abs("c_acctbal").desc(), "c_custkey"))  # of 300 rows
    return top.select("c_custkey", "c_mktsegment", "c_acctbal", place.cast("long").alias("place"))


@query("SELECT (SELECT count(*) FROM part WHERE p_size > 20 AND p_brand LIKE 'Brand#1%' AND p_retailprice < 1500) AS together, 0::BIGINT AS unlike")
def filters_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Rows that pass three filters at once, and keys for which that is not the intersection of the three results."""
    part = _t(spark, d, "part")
    filters = [F.col("p_size") > 20, F.col("p_brand").startswith("Brand#1"), F.col("p_retailprice") < 1500]
    unlike = unlike_intersection(part, filters, "p_partkey").agg(F.count("*").alias("n")).scalar()
    return part.filter(filters[0] & filters[1] & filters[2]).agg(F.count("*").alias("together")).select("together", unlike.alias("unlike"))


SLOTS = """WITH h AS (SELECT row(l_orderkey, l_linenumber, l_extendedprice, l_discount, l_suppkey, l_quantity) AS ord, ['eem', 'smin', 'eems'][1 + l_linenumber % 3] AS fund, CASE WHEN l_partkey % 7 <> 0 THEN 'INE' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS isin,
  CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS scrip_code, CAST(l_suppkey AS VARCHAR) AS name, l_discount AS weight_pct, l_quantity AS quantity, l_extendedprice AS value_usd FROM lineitem),
k AS (SELECT *, coalesce(isin, 'bse:' || scrip_code) AS key FROM h),
s AS (SELECT key, arg_min(scrip_code, ord) FILTER (scrip_code IS NOT NULL) AS code, arg_min(name, ord) AS name, arg_max(weight_pct, ord) FILTER (fund = 'eem') AS eem_weight, arg_max(quantity, ord) FILTER (fund = 'smin') AS smin_quantity,
  arg_max(value_usd, ord) FILTER (fund = 'eems') AS eems_value, count(*) AS n_holdings FROM k WHERE key IS NOT NULL GROUP BY key) """


def _holdings(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as holdings of three funds, some without ISIN, some without scrip code, some with neither."""
    k = F.col("l_partkey")
    return _t(spark, d, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_suppkey", "l_quantity").alias("ord"), F.get(F.array(*map(F.lit, FUNDS)), F.col("l_linenumber") % 3).alias("fund"), F.when(k % 7 != 0, F.concat(F.lit("INE"), F.lpad(k.cast("string"), 9, "0"))).alias("isin"),
        F.when(k % 11 != 0, k.cast("string")).alias("scrip_code"), F.col("l_suppkey").cast("string").alias("name"), F.col("l_discount").alias("weight_pct"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("value_usd"),
        F.col("l_linestatus").alias("location"), F.col("l_returnflag").alias("asset_class"), "l_partkey",
    )


@query(SLOTS + "SELECT key, code AS scrip_code, name, eem_weight, smin_quantity, eems_value, n_holdings FROM s")
def company_slots(spark: SparkSession, d: str) -> DataFrame:
    """Companies of the holdings: the first holding names them, the last of each fund fills its slot; the lines come shuffled."""
    rows = R.company_slots(_holdings(spark, d).repartition(5, "quantity"), FUNDS, ["name"])
    return rows.select("key", "scrip_code", "name", F.col("eem.weight_pct").alias("eem_weight"), F.col("smin.quantity").alias("smin_quantity"), F.col("eems.value_usd").alias("eems_value"), "n_holdings")


@query("WITH h AS (SELECT DISTINCT coalesce(CASE WHEN l_partkey % 7 <> 0 THEN 'INE' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') END, CASE WHEN l_partkey % 11 <> 0 THEN 'bse:' || l_partkey END) AS key FROM lineitem WHERE l_partkey % 3 = 0), s AS (SELECT p_partkey, 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS key, CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_size % 3 = 1 THEN '' END AS code, p_size % 5 = 0 AS named FROM part) SELECT CASE WHEN coalesce(code, '') = '' AND NOT named THEN 'side list' WHEN coalesce(code, '') = '' THEN 'the other exchange' ELSE 'code not active' END AS outcome, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM s WHERE key NOT IN (SELECT key FROM h WHERE key IS NOT NULL) GROUP BY 1")
def seed_append(spark: SparkSession, d: str) -> DataFrame:
    """Companies of a list that no fund holds: appended with the reason why they have no scrip, or put on the side list."""
    held = R.company_slots(_holdings(spark, d).filter("l_partkey % 3 = 0"), FUNDS, ["name"])
    k = F.col("p_partkey")
    seed = _t(spark, d, "part").select(
        k.alias("ord"), F.concat(F.lit("INE"), F.lpad(k.cast("string"), 9, "0")).alias("isin"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("S"), k)).alias("symbol"),
        F.when(F.col("p_size") % 3 == 0, k.cast("string")).when(F.col("p_size") % 3 == 1, "").alias("scrip_code"), F.col("p_retailprice").alias("cap"),
    )
    fresh, side = R.split_seed(seed, held)
    every = R.appended(held, fresh).join(held.select("key"), "key", "left_anti")
    why = F.when(F.col("seed_code").isNotNull(), "code not active").otherwise("the other exchange")
    rows = every.select(why.alias("outcome"), "isin").unionByName(side.select(F.lit("side list").alias("outcome"), "isin"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.substring("isin", 4, 9).cast("long")).alias("keys"))


@query("WITH side AS (SELECT CAST(s_suppkey AS VARCHAR) AS code, 'INE' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0') AS isin, s_name, s_acctbal, s_suppkey FROM supplier), c AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS code, CASE WHEN p_size % 7 <> 0 THEN 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS isin FROM part) SELECT p_partkey, coalesce(a.s_name, b.s_name) AS side_name, coalesce(a.s_acctbal, b.s_acctbal) AS side_value FROM c LEFT JOIN side a ON a.code = c.code LEFT JOIN side b ON c.code IS NULL AND b.isin = c.isin")
def enriched_by_code_or_isin(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the supplier of their code or, only where they have no code, of their ISIN; every supplier comes twice and the first counts."""
    k, s = F.col("p_partkey").cast("string"), F.col("s_suppkey")
    rows = _t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, k).alias("code"), F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("INE"), F.lpad(k, 9, "0"))).alias("isin"))
    side = _t(spark, d, "supplier").select(s.cast("string").alias("code"), F.concat(F.lit("INE"), F.lpad((s + 1).cast("string"), 9, "0")).alias("isin"), "s_name", "s_acctbal", s.alias("ord"))
    side = side.unionByName(side.withColumns({"s_name": F.lit("a later row"), "ord": F.col("ord") + 10**9}))
    out = R.with_side(rows, side, [("code", "code"), ("isin", "isin")], "ord", "side")
    return out.select("p_partkey", F.col("side.s_name").alias("side_name"), F.col("side.s_acctbal").alias("side_value"))


_FINDINGS = f"SELECT key, gap, cause FROM (SELECT l_suppkey AS key, {_half_up('(sum(l_extendedprice) / sum(l_quantity) / 1500 - 1) * 100', 3)} AS gap, CASE WHEN l_suppkey % 4 <> 0 THEN 'mode ' || min(l_returnflag) END AS cause FROM lineitem GROUP BY 1) WHERE abs(gap) > 5"


@query(f"WITH f AS ({_FINDINGS}) SELECT s_suppkey, key IS NOT NULL AS quarantined, CASE WHEN key IS NOT NULL THEN coalesce(cause, 'the share count could not be corroborated') END AS reason, gap AS gap_pct FROM supplier LEFT JOIN f ON key = s_suppkey")
def quarantine_list(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that a list of findings quarantines, with cause and gap."""
    gap = rounded((F.sum("l_extendedprice") / F.sum("l_quantity") / 1500 - 1) * 100, 3)
    findings = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(gap.alias("gap_pct"), F.min("l_returnflag").alias("m"))
    findings = findings.filter(F.abs("gap_pct") > 5).select("s_suppkey", "gap_pct", F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("mode "), "m")).alias("cause"))
    rows = R.quarantined(_t(spark, d, "supplier"), findings, "s_suppkey")
    return rows.select("s_suppkey", F.col("quarantine").isNotNull().alias("quarantined"), F.col("quarantine.reason").alias("reason"), F.col("quarantine.gap_pct").alias("gap_pct"))


def float_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts with two readings of their float, of which some lack one, and the rupees that one source publishes."""
    q = F.col("l_quantity")
    bse = rounded(F.sum(F.when(F.col("l_linestatus") == "O", q)) / F.sum(q), 4)
    per = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(q).alias("shares"), bse.alias("factor_bse"), F.sum(F.when(F.col("l_returnflag") == "N", q)).alias("implied_nse"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))).alias("rupees_nse"))
    size = F.col("p_size")
    rows = _t(spark, d, "part").join(per, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("price", F.col("p_retailprice"))
    return rows.withColumns({"full_cap": F.when(size % 6 != 0, F.col("shares") * F.col("price") * 1.01), "factor_bse": F.when(size % 5 != 0, F.col("factor_bse")), "implied_nse": F.when(size % 4 != 0, F.col("implied_nse"))})


FLOATS = f"""WITH per AS (SELECT l_partkey, sum(l_quantity) AS shares, {_half_up("sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) / sum(l_quantity)", 4)} AS bse, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS implied, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS rupees FROM lineitem GROUP BY 1),
b AS (SELECT p_partkey, p_retailprice AS price, shares, CASE WHEN p_size % 6 <> 0 THEN shares * p_retailprice * 1.01 END AS full_cap, CASE WHEN p_size % 5 <> 0 THEN bse END AS bse, CASE WHEN p_size % 4 <> 0 THEN implied END AS implied, rupees FROM part LEFT JOIN per ON l_partkey = p_partkey),
n AS (SELECT *, {_half_up('implied / shares', 6)} AS f FROM b), m AS (SELECT *, CASE WHEN f > 0 AND f <= 1.02 THEN f END AS nse FROM n),
g AS (SELECT *, CASE WHEN bse > 0 THEN {_half_up('(nse - bse) / bse * 100', 3)} END AS gap FROM m),
c AS (SELECT *, CASE WHEN bse IS NOT NULL AND nse IS NOT NULL THEN CASE WHEN abs(gap) > 2 THEN 'nse-preferred-on-material-gap' ELSE 'bse-primary' END WHEN bse IS NOT NULL THEN 'bse-only' WHEN nse IS NOT NULL THEN 'nse-only' END AS rule FROM g),
d AS (SELECT *, CASE WHEN rule IN ('bse-primary', 'bse-only') THEN bse ELSE nse END AS factor FROM c),
e AS (SELECT *, CASE WHEN rule IS NULL AND rupees > 0 THEN 'nse-only-published-rupees' ELSE rule END AS final, CASE WHEN factor IS NOT NULL AND full_cap IS NOT NULL THEN 'formed' WHEN rupees > 0 THEN 'rupees' END AS how FROM d) """


@query(FLOATS + f"""SELECT p_partkey, final AS rule, CASE WHEN final LIKE 'nse%' THEN 'nse' WHEN final LIKE 'bse%' THEN 'bse' END AS chose, CASE WHEN rule IN ('bse-primary', 'nse-preferred-on-material-gap') THEN gap END AS gap_pct, CASE WHEN final IS NOT NULL THEN 2.0::DOUBLE END AS threshold_pct,
 factor, CASE how WHEN 'formed' THEN floor(factor * full_cap + 0.5) WHEN 'rupees' THEN floor(rupees + 0.5) END AS ff_at_capture, coalesce(CASE WHEN price > 0 THEN floor(factor * shares * price + 0.5) END, CASE how WHEN 'rupees' THEN floor(rupees + 0.5) END) AS ff,
 CASE WHEN factor IS NOT NULL THEN 'factor x shares x price' WHEN how = 'rupees' THEN 'published rupees of the second exchange' END AS basis, CASE how WHEN 'formed' THEN CASE WHEN rule LIKE 'nse%' THEN 'nse' ELSE 'bse' END WHEN 'rupees' THEN 'nse' END AS source FROM e""")
def float_choice_records(spark: SparkSession, d: str) -> DataFrame:
    """Which exchange's float counts for every part, by which rule and gap, and the free float with its basis and source."""
    out = R.with_float(float_rows(spark, d))
    return out.select("p_partkey", *(F.col(f"choice.{c}").alias(c) for c in ("rule", "chose", "gap_pct", "threshold_pct")), "factor", "ff_at_capture", "ff", "basis", "source")


BOUNDARY = COMPANY + """, p AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY ff, p_partkey) AS i, count(*) OVER (PARTITION BY segment) AS cnt FROM rk WHERE ff IS NOT NULL),
e AS (SELECT count(*) FILTER (segment = 'standard') AS s, min(ff) FILTER (segment = 'standard') AS lo, max(ff) FILTER (segment = 'smallcap') AS hi FROM p), o AS (SELECT p.*, s, lo, hi, hi > lo AS meet, hi > lo AND ff BETWEEN lo AND hi AS inside FROM p, e) """


@query(BOUNDARY + """SELECT count(*) FILTER (segment = 'standard') AS n_standard, count(*) FILTER (segment = 'smallcap') AS n_smallcap, count(*) FILTER (segment = 'outside') AS n_outside, any_value(lo) AS standard_floor, arg_min(p_name, (ff, p_partkey)) FILTER (segment = 'standard') AS standard_floor_company,
 any_value(hi) AS smallcap_ceiling, arg_max(p_name, (ff, p_partkey)) FILTER (segment = 'smallcap') AS smallcap_ceiling_company, any_value(meet) AS has_overlap, any_value(CASE WHEN meet THEN lo END) AS overlap_low, any_value(CASE WHEN meet THEN hi END) AS overlap_high,
 any_value(CASE WHEN meet THEN hi - lo END) AS overlap_width, any_value(CASE WHEN meet THEN hi / lo END) AS overlap_ratio, count(*) FILTER (inside) AS n_overlap, count(*) FILTER (inside AND segment = 'standard') AS n_overlap_standard,
 count(*) FILTER (inside AND segment = 'smallcap') AS n_overlap_smallcap, count(*) FILTER (inside AND segment = 'outside') AS n_overlap_outside, max(ff) FILTER (fr = s) AS rank_cutoff, max(p_name) FILTER (fr = s) AS rank_cutoff_company,
 max(ff) FILTER (segment = 'standard' AND i = least(cnt, CAST(floor(cnt * 0.05) AS BIGINT) + 1)) AS standard_p5, max(ff) FILTER (segment = 'standard' AND i = least(cnt, cnt // 2 + 1)) AS standard_median,
 max(ff) FILTER (segment = 'smallcap' AND i = least(cnt, cnt // 2 + 1)) AS smallcap_median, max(ff) FILTER (segment = 'outside' AND i = least(cnt, cnt // 2 + 1)) AS outside_median FROM o""")
def boundary_record(spark: SparkSession, d: str) -> DataFrame:
    """The observed boundary as one record of twenty-two fields."""
    return R.boundary_record(C.with_funds(C.companies(spark, d)), "p_partkey", "p_name")


@query(SLOTS + ", f AS (SELECT k.*, CASE WHEN l.v IS NOT NULL THEN 1 END AS valued FROM k LEFT JOIN (SELECT 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS key, p_retailprice AS v FROM part WHERE p_size % 4 <> 0) l USING (key)) " + f"SELECT fund, count(*) AS holdings, count(key) AS resolved, count(*) - count(key) AS unresolved, count(valued) AS with_float, {_half_up('sum(CASE WHEN key IS NOT NULL THEN weight_pct END)', 5)} AS weight_resolved, {_half_up('sum(CASE WHEN valued = 1 THEN weight_pct END)', 5)} AS weight_with_float FROM f GROUP BY fund")
def fund_weight_coverage(spark: SparkSession, d: str) -> DataFrame:
    """By fund the holdings resolved and with a free float, and their weights."""
    holdings = _holdings(spark, d).withColumn("key", scalar.company_key(F.col("isin"), F.col("scrip_code")))
    floats = _t(spark, d, "part").select(F.concat(F.lit("INE"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("key"), F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("ff"))
    return R.fund_coverage(holdings, floats)


@query("SELECT fund, count(*) AS n, sum(l_quantity) AS quantity FROM (SELECT ['eem', 'smin', 'eems'][1 + l_linenumber % 3] AS fund, l_quantity FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N') GROUP BY 1")
def india_equity_slice(spark: SparkSession, d: str) -> DataFrame:
    """The slice of the holdings that is open and not returned, which stand for location and asset class."""
    rows = _holdings(spark, d).withColumns({"location": F.when(F.col("location") == "O", "India").otherwise(F.col("location")), "asset_class": F.when(F.col("asset_class") == "N", "Equity").otherwise("Cash")})
    return R.india_equity(rows).groupBy("fund").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("WITH r AS (SELECT p_partkey, CASE WHEN p_size % 13 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS code, CASE WHEN p_size = 7 THEN NULL ELSE 'X' END AS id, CASE WHEN p_size % 6 = 0 THEN 'IF' WHEN p_size % 5 = 0 THEN '' ELSE substr(p_brand, 7, 1) END AS grp, p_size % 2 = 0 AS good, p_partkey IN (SELECT s_suppkey FROM supplier) AS eq FROM part), x AS (SELECT *, CASE WHEN code = '' OR id IS NULL THEN 'no scrip code or no scrip id' WHEN NOT eq AND grp <> 'IF' THEN 'neither equity nor a trust, group ' || CASE WHEN grp = '' THEN 'none' ELSE grp END END AS reason FROM r) SELECT CASE WHEN reason IS NULL THEN 'kept' ELSE 'skipped' END AS route, reason, CASE WHEN reason IS NULL THEN CASE WHEN grp = 'IF' THEN 'trust' ELSE 'equity' END END AS kind, count(*) AS n, count(CASE WHEN good THEN 1 END) AS with_isin FROM x GROUP BY ALL")
def instrument_routes(spark: SparkSession, d: str) -> DataFrame:
    """Master rows kept as equity or trust, or skipped with the reason."""
    size, k = F.col("p_size"), F.col("p_partkey").cast("string")
    rows = _t(spark, d, "part").select(
        F.when(size % 13 == 0, "").otherwise(F.concat(F.lit(" "), k)).alias("scrip_code"), F.when(size != 7, "X").alias("scrip_id"), F.when(size % 6 == 0, "IF").when(size % 5 == 0, "").otherwise(F.substring("p_brand", 7, 1)).alias("group"),
        F.when(size % 2 == 0, F.concat(F.lit("INE"), F.lpad(k, 9, "0"))).otherwise("bad").alias("isin"), (size % 2 == 0).alias("good"),
    )
    out = R.instrument_route(rows, _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("scrip_code")))
    return out.groupBy("route", "reason", "kind").agg(F.count("*").alias("n"), F.count_if("good").alias("with_isin"))


@query("WITH held AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-12-01'), seeded AS (SELECT c_custkey AS k, CASE WHEN p_partkey IS NULL THEN 'not in the active master' WHEN c_custkey % 3 = 0 THEN 'the master has ISIN INE' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS why FROM customer LEFT JOIN part ON p_partkey = c_custkey WHERE c_acctbal > 8000), good AS (SELECT k, 0 AS o FROM held JOIN part ON p_partkey = k UNION ALL SELECT p_partkey, 1 FROM part WHERE p_retailprice >= 1800 UNION ALL SELECT k, 2 FROM seeded WHERE why IS NULL) SELECT 'fetch' AS route, ['held', 'large', 'seeded'][1 + min(o)] AS reason, CAST(k AS VARCHAR) AS scrip_code FROM good GROUP BY k UNION ALL SELECT 'rejected', why, CAST(k AS VARCHAR) FROM seeded WHERE why IS NOT NULL")
def universe_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Scrips worth a request (held, large by the master's own value, seeded) and seed rows that are rejected."""
    isin = lambda k: F.concat(F.lit("INE"), F.lpad(k.cast("string"), 9, "0"))
    master = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("scrip_code"), isin(F.col("p_partkey")).alias("isin"), F.col("p_retailprice").alias("indicative_cap"))
    held = _t(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("2001-12-01").cast("timestamp_ntz")).select(F.col("l_partkey").cast("string").alias("scrip_code")).distinct()
    k = F.col("c_custkey")
    seed = _t(spark, d, "customer").filter("c_acctbal > 8000").select(k.alias("ord"), k.cast("string").alias("scrip_code"), F.when(k % 3 == 0, "INE").otherwise(isin(k)).alias("isin"))
    return R.universe_to_fetch(master, held, seed, 1800.0).select("route", "reason", "scrip_code")


@query("SELECT l_partkey, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS close FROM lineitem WHERE l_discount > 0.02")
def zipped_series(spark: SparkSession, d: str) -> DataFrame:
    """Closes of parallel arrays of times and values, by order; values of zero, below zero and nulls are no closes."""
    value = F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")).when(F.col("l_discount") > 0.01, 0.0).when(F.col("l_discount") > 0, -F.col("l_extendedprice"))
    rows = _t(spark, d, "lineitem").withColumns({"t": F.unix_timestamp(F.col("l_shipdate").cast("timestamp")), "v": value})
    pairs = rows.groupBy("l_orderkey", "l_partkey").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p"))  # the lines of an order
    return paired_arrays(pairs.select("l_partkey", F.col("p.t").alias("t"), F.col("p.v").alias("v")), "t", "v", "l_partkey")


@query("SELECT market, count(*) AS n FROM (SELECT 'india' AS market, ts + INTERVAL 330 MINUTE AS l, 555 AS o, 930 AS c FROM events UNION ALL SELECT 'usa', ts - CASE WHEN ts >= date_trunc('year', ts) + INTERVAL 2 MONTH + to_days(CAST(14 - isodow(date_trunc('year', ts) + INTERVAL 2 MONTH) AS INTEGER)) + INTERVAL 7 HOUR AND ts < date_trunc('year', ts) + INTERVAL 10 MONTH + to_days(CAST(7 - isodow(date_trunc('year', ts) + INTERVAL 10 MONTH) AS INTEGER)) + INTERVAL 6 HOUR THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, 570, 960 FROM events) WHERE isodow(l) <= 5 AND hour(l) * 60 + minute(l) BETWEEN o AND c GROUP BY 1")
def market_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events inside the sessions of two markets, each by its own clock with its summer time."""
    ts = F.col("ts").cast("timestamp")
    markets = F.array_compact(F.array(*(F.when(scalar.in_market_hours(ts, m), F.lit(m)) for m in scalar.SESSIONS)))
    return _t(spark, d, "events").select(F.explode(markets).alias("market")).groupBy("market").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN v IS NULL THEN '—' ELSE CASE WHEN v > 0 THEN '+' ELSE '' END || printf('%.2f', v) || '%' END AS day, CASE WHEN f IS NULL THEN '—' WHEN f <> 0 AND abs(f) < 0.005 THEN CASE WHEN f < 0 THEN '>-' ELSE '<' END || '0.01%' ELSE printf('%.2f', f) || '%' END AS factor, n || CASE WHEN n = 1 THEN ' part' ELSE ' parts' END AS parts FROM (SELECT p_partkey, p_size AS n, CASE WHEN p_size % 5 <> 0 THEN (p_size - 25) / 7.3::DOUBLE END AS v, CASE WHEN p_size % 7 <> 0 THEN (p_size - 20) / 1024 END AS f FROM part)")
def change_texts(spark: SparkSession, d: str) -> DataFrame:
    """Day changes, shares and counts as texts."""
    n = F.col("p_size")
    day, factor = F.when(n % 5 != 0, (n - 25) / 7.3), F.when(n % 7 != 0, (n - 20) / 102400)
    return _t(spark, d, "part").select("p_partkey", fmt.day_change_text(day).alias("day"), fmt.factor_percent(factor).alias("factor"), F.concat(n.cast("string"), F.lit(" "), fmt.plural(n, "part")).alias("parts"))

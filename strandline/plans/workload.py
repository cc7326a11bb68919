"""The model's operators as queries over the star-schema tables, each with the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import parse, scalar
from strandline.functions.scalar import rounded
from strandline.operators import lookup, series
from strandline.operators.order import exact_median, nearest_rank
from strandline.plans import company as C
from strandline.plans.screen import Screen, screened, size_band
from strandline.plans.tables import kept
from strandline.sources.readers import shape_problems
from strandline.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

COMPANY = """
WITH per AS (
  SELECT l_partkey, sum(l_quantity) AS shares, sum(c * d) AS k, sum(c) AS c, sum(CASE WHEN o THEN c * d END) AS ko,
         sum(CASE WHEN o THEN c END) AS co, count(CASE WHEN o THEN 1 END) AS n_own, sum(CASE WHEN h THEN c END) AS ext_hold
  FROM (SELECT l_partkey, l_quantity, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS c, 100 - CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS d,
               l_linestatus = 'O' AS o, l_shipdate < TIMESTAMP '2000-01-01' AS h FROM lineitem) GROUP BY l_partkey),
base AS (
  SELECT p.*, p_retailprice AS price, shares, CAST(k AS DOUBLE) / (c * 100) AS factor_a,
         CASE WHEN n_own >= 8 THEN CAST(ko AS DOUBLE) / nullif(co * 100, 0) END AS factor_b, coalesce(ext_hold, 0) AS ext_hold
  FROM part p LEFT JOIN per ON p_partkey = l_partkey),
ruled AS (
  SELECT *, abs(factor_b - factor_a) / factor_a AS gap,
         CASE WHEN factor_a IS NULL AND factor_b IS NULL THEN 'none' WHEN factor_b IS NULL THEN 'only-a' WHEN factor_a IS NULL THEN 'only-b'
              WHEN abs(factor_b - factor_a) / factor_a > 0.01 THEN 'gap-switch' ELSE 'primary' END AS rule FROM base),
company AS (
  SELECT *, CASE WHEN p_partkey % 53 <> 0 THEN floor((CASE WHEN rule IN ('gap-switch', 'only-b') THEN factor_b ELSE factor_a END) * shares * price + 0.5) END AS ff,
         CASE WHEN rule IN ('gap-switch', 'only-b') THEN factor_b ELSE factor_a END AS factor, p_partkey % 97 = 0 AS quarantined FROM ruled),
held AS (SELECT *, row_number() OVER (ORDER BY ext_hold DESC, p_partkey) AS hr, count(*) OVER () AS n FROM company),
funds AS (SELECT *, hr <= n * 14 // 100 AS in_eem, hr > n * 14 // 100 AND hr <= n * 52 // 100 AS in_smin FROM held),
seg AS (SELECT *, in_smin AND p_partkey % 10 <> 0 AS in_eems, CASE WHEN in_eem THEN 'standard' WHEN in_smin THEN 'smallcap' ELSE 'outside' END AS segment FROM funds),
head AS (SELECT sum(ff) / count(ff) AS u, count(CASE WHEN segment = 'standard' AND ff IS NOT NULL THEN 1 END) AS ns FROM seg),
rk AS (SELECT seg.*, u, ns, CASE WHEN ff IS NOT NULL THEN row_number() OVER (ORDER BY ff DESC NULLS LAST, p_partkey) END AS fr FROM seg, head),
verdict AS (
  SELECT *, CASE WHEN quarantined OR ff IS NULL THEN 'unknown' WHEN segment = 'outside' AND ff >= u THEN 'likely-inclusion'
    WHEN segment = 'outside' AND ff >= 0.9 * u THEN 'possible-inclusion' WHEN segment = 'outside' THEN 'stable' WHEN ff < 0.8 * u THEN 'likely-exclusion'
    WHEN ff < 0.88 * u THEN 'exclusion-risk' WHEN segment = 'smallcap' AND fr <= ns THEN 'migration-up' WHEN segment = 'standard' AND fr > ns THEN 'migration-down'
    ELSE 'stable' END AS verdict FROM rk)
"""
SERIES = """
WITH s AS (SELECT o_orderpriority AS name, CAST(o_orderdate AS DATE) AS d, floor(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) / count(*) + 0.5) AS close
           FROM orders GROUP BY 1, 2),
fx AS (SELECT d, close AS rate FROM s WHERE name = (SELECT min(name) FROM s) AND day(d) % 9 = 0)
"""


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return C.table(spark, d, name)


def _half_up(expr: str, places: int) -> str:
    return f"floor(({expr}) * 1e{places} + 0.5) / 1e{places}"


@query(COMPANY + "SELECT segment, verdict, count(*) AS n FROM verdict GROUP BY 1, 2")
def verdict_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return C.assessed(spark, d).groupBy("segment", "verdict").agg(F.count("*").alias("n"))


@query(COMPANY + "SELECT verdict, count(*) AS n FROM verdict GROUP BY 1")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.assessed(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query(COMPANY + "SELECT rule, count(*) AS n FROM company GROUP BY 1")
def float_choice_rules(spark: SparkSession, d: str) -> DataFrame:
    return C.companies(spark, d).groupBy("rule").agg(F.count("*").alias("n"))


@query(COMPANY + f"SELECT p_partkey, {_half_up('gap', 8)} AS gap FROM company WHERE gap IS NOT NULL ORDER BY company.gap DESC, p_partkey LIMIT 10")
def float_gap_top10(spark: SparkSession, d: str) -> DataFrame:
    rows = C.companies(spark, d).filter("gap IS NOT NULL").orderBy(F.desc("gap"), "p_partkey").limit(10)
    return rows.select("p_partkey", rounded(F.col("gap"), 8).alias("gap"))


@query(COMPANY + f"SELECT {_half_up('median(gap)', 8)} AS median_gap FROM company")
def gap_median_exact(spark: SparkSession, d: str) -> DataFrame:
    return exact_median(C.companies(spark, d), "gap", "p_partkey", "m").select(rounded(F.col("m"), 8).alias("median_gap"))


@query(COMPANY + ", r AS (SELECT segment, ff, row_number() OVER (PARTITION BY segment ORDER BY ff) AS i, count(*) OVER (PARTITION BY segment) AS n FROM seg WHERE ff IS NOT NULL) SELECT segment, ff AS upper_median FROM r WHERE i = least(n, CAST(floor(n * 0.5) AS BIGINT) + 1)")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return nearest_rank(C.with_funds(C.companies(spark, d)).withColumn("ff", F.col("ff").cast("double")), ["segment"], "ff", 0.5, "upper_median", "p_partkey")


@query(COMPANY + ", r AS (SELECT segment, ff, row_number() OVER (PARTITION BY segment ORDER BY ff) AS i, count(*) OVER (PARTITION BY segment) AS n FROM seg WHERE ff IS NOT NULL) SELECT segment, ff AS p5 FROM r WHERE i = least(n, CAST(floor(n * 0.05) AS BIGINT) + 1)")
def nearest_rank_p5(spark: SparkSession, d: str) -> DataFrame:
    return nearest_rank(C.with_funds(C.companies(spark, d)).withColumn("ff", F.col("ff").cast("double")), ["segment"], "ff", 0.05, "p5", "p_partkey")


@query(COMPANY + "SELECT segment, sum(ff) AS total, count(ff) AS with_float, count(*) AS n FROM seg GROUP BY 1")
def segment_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_funds(C.companies(spark, d)).withColumn("ff", F.col("ff").cast("double"))
    return rows.groupBy("segment").agg(F.sum("ff").alias("total"), F.count("ff").alias("with_float"), F.count("*").alias("n"))


@query(COMPANY + "SELECT min(CASE WHEN segment = 'standard' THEN ff END) AS floor_ff, arg_min(p_partkey, ff) FILTER (segment = 'standard' AND ff IS NOT NULL) AS floor_key, max(CASE WHEN segment = 'smallcap' THEN ff END) AS ceiling_ff, arg_max(p_partkey, ff) FILTER (segment = 'smallcap' AND ff IS NOT NULL) AS ceiling_key FROM seg")
def observed_boundary(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_funds(C.companies(spark, d)).withColumn("ff", F.col("ff").cast("double"))
    std, small = (F.when((F.col("segment") == s) & F.col("ff").isNotNull(), F.col("ff")) for s in ("standard", "smallcap"))
    return rows.agg(F.min(std).alias("floor_ff"), F.min_by("p_partkey", std).alias("floor_key"), F.max(small).alias("ceiling_ff"), F.max_by("p_partkey", small).alias("ceiling_key"))


@query(COMPANY + "SELECT count(CASE WHEN in_eem AND in_smin THEN 1 END) AS overlaps, count(CASE WHEN in_eems AND NOT in_smin THEN 1 END) AS not_subset, count(CASE WHEN in_eems THEN 1 END) AS sampled, count(CASE WHEN in_smin THEN 1 END) AS replicated FROM seg")
def segment_disjoint(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_funds(C.companies(spark, d))
    return rows.agg(F.count_if(F.col("in_eem") & F.col("in_smin")).alias("overlaps"), F.count_if(F.col("in_eems") & ~F.col("in_smin")).alias("not_subset"), F.count_if("in_eems").alias("sampled"), F.count_if("in_smin").alias("replicated"))


@query(COMPANY + "SELECT p_partkey, in_eem, in_smin, in_eems, CAST(CASE WHEN in_eem THEN 1 ELSE 0 END + CASE WHEN in_smin THEN 1 ELSE 0 END + CASE WHEN in_eems THEN 1 ELSE 0 END AS INTEGER) AS n_funds FROM seg WHERE in_eem OR in_smin")
def company_pivot_funds(spark: SparkSession, d: str) -> DataFrame:
    w = C.fund_weights(C.with_funds(C.companies(spark, d)))
    held = w.groupBy("p_partkey").pivot("fund", ["eem", "smin", "eems"]).agg(F.count(F.lit(1)))
    return held.select("p_partkey", *(F.coalesce(F.col(f) > 0, F.lit(False)).alias(f"in_{f}") for f in ("eem", "smin", "eems")), sum(F.coalesce(F.col(f), F.lit(0)) for f in ("eem", "smin", "eems")).cast("int").alias("n_funds"))


@query(COMPANY + "SELECT count(*) AS unheld, CAST(sum(p_partkey) AS BIGINT) AS keys FROM seg WHERE NOT in_eem AND NOT in_smin")
def unheld_append(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_funds(C.companies(spark, d))
    held = C.fund_weights(rows).select("p_partkey")
    return _t(spark, d, "part").join(held, "p_partkey", "left_anti").agg(F.count("*").alias("unheld"), F.sum("p_partkey").alias("keys"))


FLOW = """, shape(verdict, fund, direction, target, held) AS (VALUES ('likely-exclusion','eem','sell','',true),('likely-exclusion','smin','sell','',true),('likely-exclusion','eems','sell','',true),
('exclusion-risk','eem','sell','',true),('exclusion-risk','smin','sell','',true),('exclusion-risk','eems','sell','',true),('migration-up','smin','sell','',true),('migration-up','eems','sell','',true),
('migration-up','eem','buy','standard',false),('migration-down','eem','sell','',true),('migration-down','smin','buy','smallcap',false),('likely-inclusion','smin','buy','smallcap',false),
('likely-inclusion','eems','buy','smallcap',true),('possible-inclusion','smin','buy','smallcap',false),('possible-inclusion','eems','buy','smallcap',true)),
wide AS (SELECT 'eem' AS fund, p_partkey, ext_hold FROM seg WHERE in_eem UNION ALL SELECT 'smin', p_partkey, ext_hold FROM seg WHERE in_smin UNION ALL SELECT 'eems', p_partkey, ext_hold FROM seg WHERE in_eems),
val AS (SELECT fund, CAST(sum(ext_hold) AS DOUBLE) AS v FROM wide GROUP BY 1), tot AS (SELECT segment, sum(ff) AS t FROM seg GROUP BY 1),
fl0 AS (SELECT v.p_partkey, v.verdict, s.fund, s.direction, v.price, CASE WHEN v.p_partkey % 11 <> 0 THEN v.shares / 20 END AS adv, val.v / 100 * 83 / 100 AS pt,
 CASE WHEN s.direction = 'sell' THEN 100 * CAST(w.ext_hold AS DOUBLE) / val.v WHEN NOT s.held OR w.ext_hold IS NOT NULL THEN 100 * v.ff / tot.t END AS w0
 FROM verdict v JOIN shape s ON v.verdict = s.verdict LEFT JOIN wide w ON w.p_partkey = v.p_partkey AND w.fund = s.fund JOIN val ON val.fund = s.fund LEFT JOIN tot ON tot.segment = s.target),
fl AS (SELECT *, CASE WHEN direction = 'sell' THEN -1 ELSE 1 END AS sg, CASE WHEN price > 0 THEN w0 * pt / price END AS sh FROM fl0 WHERE w0 IS NOT NULL) """


@query(COMPANY + FLOW + "SELECT verdict, fund, direction, count(*) AS n, sum(floor(sg * w0 * pt + 0.5)) AS flow FROM fl GROUP BY 1, 2, 3")
def flows_by_shape(spark: SparkSession, d: str) -> DataFrame:
    return C.flows(C.assessed(spark, d)).groupBy("verdict", "fund", "direction").agg(F.count("*").alias("n"), F.sum("flow").alias("flow"))


@query(COMPANY + FLOW + f"SELECT p_partkey, fund, direction, {_half_up('sg * w0 * pt / 1e7', 2)} AS flow_crore, floor(sg * sh + 0.5) AS flow_shares, {_half_up('CASE WHEN adv > 0 THEN sh / adv END', 4)} AS days, CASE WHEN direction = 'sell' THEN 'measured-position' ELSE 'estimated' END AS certainty FROM fl")
def flow_records(spark: SparkSession, d: str) -> DataFrame:
    return C.flows(C.assessed(spark, d)).select("p_partkey", "fund", "direction", "flow_crore", "flow_shares", "days", "certainty")


@query(COMPANY + "SELECT verdict, count(*) AS n FROM verdict WHERE verdict = 'migration-down' OR (verdict IN ('migration-up', 'likely-inclusion', 'possible-inclusion') AND NOT in_eems) GROUP BY 1")
def flows_not_sampled(spark: SparkSession, d: str) -> DataFrame:
    return C.not_sampled(C.assessed(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"))


@query(COMPANY + FLOW + "SELECT fund, arg_max(floor(sg * w0 * pt + 0.5), (abs(floor(sg * w0 * pt + 0.5)), p_partkey)) AS flow FROM fl GROUP BY 1")
def largest_flow(spark: SparkSession, d: str) -> DataFrame:
    """The flow of largest magnitude by fund, with its sign."""
    return C.flows(C.assessed(spark, d)).groupBy("fund").agg(F.max_by("flow", F.struct(F.abs("flow"), "p_partkey")).alias("flow"))


@query(COMPANY + f"SELECT p_partkey, {_half_up('CASE WHEN shares > 0 THEN abs(ff) / shares END', 4)} AS days FROM company")
def days_of_adv(spark: SparkSession, d: str) -> DataFrame:
    return C.companies(spark, d).select("p_partkey", rounded(scalar.days_of_volume(F.col("ff").cast("double"), F.col("shares")), 4).alias("days"))


@query(COMPANY + "SELECT p_partkey, ratio FROM (SELECT p_partkey, factor_a / nullif(factor_b, 0) * (CASE WHEN p_partkey % 4 = 0 THEN 1 / (1 + p_partkey % 11)::DOUBLE WHEN p_partkey % 4 = 1 THEN 1.25 WHEN p_partkey % 4 = 2 THEN 1.5 ELSE 1 + p_partkey % 11 END) AS r FROM company) CROSS JOIN LATERAL (SELECT CASE WHEN abs(r - 10::DOUBLE) / (10::DOUBLE) <= 0.002 THEN (10::DOUBLE)::DOUBLE WHEN abs(r - 1 / 10::DOUBLE) / (1 / 10::DOUBLE) <= 0.002 THEN (1 / 10::DOUBLE)::DOUBLE WHEN abs(r - 5::DOUBLE) / (5::DOUBLE) <= 0.002 THEN (5::DOUBLE)::DOUBLE WHEN abs(r - 1 / 5::DOUBLE) / (1 / 5::DOUBLE) <= 0.002 THEN (1 / 5::DOUBLE)::DOUBLE WHEN abs(r - 4::DOUBLE) / (4::DOUBLE) <= 0.002 THEN (4::DOUBLE)::DOUBLE WHEN abs(r - 1 / 4::DOUBLE) / (1 / 4::DOUBLE) <= 0.002 THEN (1 / 4::DOUBLE)::DOUBLE WHEN abs(r - 3::DOUBLE) / (3::DOUBLE) <= 0.002 THEN (3::DOUBLE)::DOUBLE WHEN abs(r - 1 / 3::DOUBLE) / (1 / 3::DOUBLE) <= 0.002 THEN (1 / 3::DOUBLE)::DOUBLE WHEN abs(r - 2.5::DOUBLE) / (2.5::DOUBLE) <= 0.002 THEN (2.5::DOUBLE)::DOUBLE WHEN abs(r - 1 / 2.5::DOUBLE) / (1 / 2.5::DOUBLE) <= 0.002 THEN (1 / 2.5::DOUBLE)::DOUBLE WHEN abs(r - 2::DOUBLE) / (2::DOUBLE) <= 0.002 THEN (2::DOUBLE)::DOUBLE WHEN abs(r - 1 / 2::DOUBLE) / (1 / 2::DOUBLE) <= 0.002 THEN (1 / 2::DOUBLE)::DOUBLE WHEN abs(r - 1.5::DOUBLE) / (1.5::DOUBLE) <= 0.002 THEN (1.5::DOUBLE)::DOUBLE WHEN abs(r - 1 / 1.5::DOUBLE) / (1 / 1.5::DOUBLE) <= 0.002 THEN (1 / 1.5::DOUBLE)::DOUBLE WHEN abs(r - 1.25::DOUBLE) / (1.25::DOUBLE) <= 0.002 THEN (1.25::DOUBLE)::DOUBLE WHEN abs(r - 1 / 1.25::DOUBLE) / (1 / 1.25::DOUBLE) <= 0.002 THEN (1 / 1.25::DOUBLE)::DOUBLE END::DOUBLE AS ratio) WHERE ratio IS NOT NULL")
def ratio_classify(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    r = F.try_divide(F.col("factor_a"), F.col("factor_b")) * F.when(k % 4 == 0, 1 / (1 + k % 11)).when(k % 4 == 1, 1.25).when(k % 4 == 2, 1.5).otherwise(1 + k % 11)
    return C.companies(spark, d).select("p_partkey", scalar.ratio_class(r).alias("ratio")).filter("ratio IS NOT NULL")


BANDS = (1e4, 1e5, 3e5, 1e6)


@query(COMPANY + "SELECT band, count(*) AS n FROM (SELECT CASE WHEN ff < 1e4 THEN 0 WHEN ff < 1e5 THEN 1 WHEN ff < 3e5 THEN 2 WHEN ff < 1e6 THEN 3 WHEN ff >= 1e6 THEN 4 END AS band FROM company) GROUP BY 1")
def size_bands(spark: SparkSession, d: str) -> DataFrame:
    return C.companies(spark, d).groupBy(size_band(F.col("ff"), BANDS).alias("band")).agg(F.count("*").alias("n"))


@query(COMPANY + "SELECT p_partkey, p_name, ff FROM verdict WHERE segment <> 'outside' ORDER BY ff DESC NULLS LAST, p_partkey LIMIT 80")
def screen_default(spark: SparkSession, d: str) -> DataFrame:
    rows = C.assessed(spark, d)
    return screened(rows, Screen(filters={"scope": "held"}, limit=80), {"scope": {"held": F.col("segment") != "outside"}}, ["p_name"], "p_partkey").select("p_partkey", "p_name", "ff")


@query(COMPANY + "SELECT p_partkey, p_brand, ff FROM verdict WHERE verdict = 'stable' AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'e') ORDER BY ff NULLS LAST, p_partkey LIMIT 50")
def screen_search_filter_sort(spark: SparkSession, d: str) -> DataFrame:
    spec = Screen("BRAND#1 e", {"verdict": "stable", "other": "x"}, "ff", False, 50)
    return screened(C.assessed(spark, d), spec, {"verdict": {"stable": F.col("verdict") == "stable"}}, ["p_name", "p_brand", "p_type"], "p_partkey").select("p_partkey", "p_brand", "ff")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "daily", ["orders"], _daily_of_orders)


def _daily_of_orders(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderdate").cast("date").alias("d"), F.floor(F.col("o_totalprice") * 100 + 0.5).alias("c"))
    return o.groupBy("name", "d").agg(F.floor(F.sum("c") / F.count("*") + 0.5).cast("double").alias("close"))


def _fx(daily: DataFrame) -> DataFrame:
    one = daily.agg(F.min("name").alias("m")).scalar()
    return daily.filter((F.col("name") == one) & (F.day("d") % 9 == 0)).select("d", F.col("close").alias("rate"))


@query(SERIES + "SELECT s.name, s.d, s.close, CASE WHEN date_diff('day', fx.d, s.d) <= 7 THEN fx.rate END AS rate, CASE WHEN date_diff('day', fx.d, s.d) <= 7 THEN fx.d END AS matched_on FROM s ASOF LEFT JOIN fx ON s.d >= fx.d")
def fx_asof_7d(spark: SparkSession, d: str) -> DataFrame:
    daily = _daily(spark, d)
    return series.asof_backward(daily, _fx(daily), [], "d", "rate", 7)


@query(SERIES + f"SELECT name, {_half_up('(max(CASE WHEN i = 1 THEN close END) / max(CASE WHEN i = least(22, n) THEN close END) - 1) * 100', 6)} AS return_pct FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d DESC) AS i, count(*) OVER (PARTITION BY name) AS n FROM s) GROUP BY name")
def return_n_back(spark: SparkSession, d: str) -> DataFrame:
    return series.return_n_back(_daily(spark, d), "name", "d", "close", 21).select("name", rounded(F.col("return_pct"), 6).alias("return_pct"))


@query(SERIES + f"SELECT name, {_half_up('(arg_max(close, d) / (arg_max(close, d) FILTER (d <= DATE ' + chr(39) + '1998-01-01' + chr(39) + ')) - 1) * 100', 6)} AS return_pct FROM s GROUP BY name")
def return_since(spark: SparkSession, d: str) -> DataFrame:
    return series.return_since(_daily(spark, d), "name", "d", "close", "1998-01-01").select("name", rounded(F.col("return_pct"), 6).alias("return_pct"))


@query(SERIES + "SELECT name, d, close, previous FROM (SELECT *, lag(close) OVER (PARTITION BY name ORDER BY d) AS previous FROM s) WHERE abs(close - previous) > 0.5 * previous")
def price_continuity(spark: SparkSession, d: str) -> DataFrame:
    return series.continuity(_daily(spark, d), "name", "d", "close", 0.5)


@query(SERIES + ", days AS (SELECT DISTINCT d FROM s), names AS (SELECT DISTINCT name FROM s), cal AS (SELECT name, d FROM names, days), j AS (SELECT cal.name, cal.d, s.close, s.d AS own FROM cal LEFT JOIN s ON s.name = cal.name AND s.d = cal.d) SELECT name, d, last_value(close IGNORE NULLS) OVER w AS close, CAST(date_diff('day', last_value(own IGNORE NULLS) OVER w, d) AS INTEGER) AS stale_days FROM j WINDOW w AS (PARTITION BY name ORDER BY d ROWS UNBOUNDED PRECEDING)")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    daily = _daily(spark, d)
    names = daily.groupBy().agg(F.array_sort(F.collect_set("name")).alias("n")).scalar()  # five series
    calendar = daily.select("d").distinct().withColumn("name", F.explode(names))
    return series.carried_forward(calendar, daily, "name", "d", "close").select("name", "d", "close", F.col("stale_days").cast("int").alias("stale_days"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(upper(c_name), '\\b(LIMITED|LTD|THE|COMPANY|CO)\\b', '', 'g'), '[^A-Z0-9]', '', 'g') AS name FROM customer")
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", scalar.normalised_name(F.col("c_name")).alias("name"))


@query("SELECT event_id, value AS price, user_id AS symbol FROM events")
def rawquote_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    raw = _t(spark, d, "events").select("event_id", F.concat(F.lit("Symbol="), F.col("user_id"), F.lit(",Company Name=A, B Ltd,52-Week Range=1 - 2,Price="), F.col("value").cast("string")).alias("raw"))
    fields = raw.withColumn("kv", parse.key_values(F.col("raw")))
    return fields.select("event_id", F.col("kv")["Price"].try_cast("double").alias("price"), F.col("kv")["Symbol"].try_cast("long").alias("symbol"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CAST(p_partkey AS DOUBLE) * 1000 + 12345 END AS v FROM part")
def grouped_number_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.format_number(F.col("p_partkey") * 1000 + 12345, 0)
    text = F.when(F.col("p_partkey") % 3 == 0, n).when(F.col("p_partkey") % 3 == 1, (F.col("p_partkey") * 1000 + 12345).cast("string")).otherwise(F.concat(n, F.lit(",1")))
    return _t(spark, d, "part").select("p_partkey", parse.grouped_number(text).alias("v"))


@query("SELECT problem, count(*) AS n FROM (SELECT CASE WHEN contains(lower(left(html, 400)), '<!doctype') OR contains(lower(left(html, 400)), '<html') THEN 'markup' ELSE 'none' END AS problem FROM pages) GROUP BY 1")
def shape_guard(spark: SparkSession, d: str) -> DataFrame:
    found = F.when(F.array_contains(shape_problems(F.col("html")), "markup"), "markup").otherwise("none")
    return _t(spark, d, "pages").groupBy(found.alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT d, CAST(min(e) AS DATE) AS review FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) CROSS JOIN LATERAL (SELECT last_day(CAST(date_trunc('month', d) AS DATE) + to_months(CAST(i AS INTEGER))) AS l FROM range(0, 6) r(i)) CROSS JOIN LATERAL (SELECT l - CAST(greatest(isodow(l) - 5, 0) AS INTEGER) AS e) WHERE month(l) IN (2, 5, 8, 11) AND e > d GROUP BY d")
def review_calendar(spark: SparkSession, d: str) -> DataFrame:
    days = _t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.select("d", scalar.next_review(F.col("d")).alias("review"))


@query("SELECT count(*) AS n, count(CASE WHEN isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) BETWEEN 555 AND 930 THEN 1 END) AS open FROM events")
def market_hours(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(scalar.market_open(F.col("ts"))).alias("open"))


@query("SELECT user_id AS symbol, arg_max(value, (ts, event_id)) AS price FROM events WHERE event_type <> 'error' AND value > 0 GROUP BY 1")
def live_latest_quote(spark: SparkSession, d: str) -> DataFrame:
    return live.latest(live.quotes(_t(spark, d, "events"))).select("symbol", "price")


@query("WITH h AS (SELECT *, event_id < (SELECT max(event_id) * 0.9 FROM events) AS early FROM events WHERE event_type <> 'error' AND value > 0), b AS (SELECT user_id, arg_max(value, (ts, event_id)) AS p FROM h WHERE early GROUP BY 1), n AS (SELECT user_id, arg_max(value, (ts, event_id)) AS p FROM h GROUP BY 1) SELECT n.user_id AS symbol, b.p AS old_price, n.p AS price FROM n LEFT JOIN b USING (user_id) WHERE b.p IS DISTINCT FROM n.p")
def live_changed_keys(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    early = events.filter(F.col("event_id") < events.agg((F.max("event_id") * 0.9).alias("m")).scalar())
    return live.changed(live.latest(live.quotes(early)), live.latest(live.quotes(events)))


@query("SELECT CASE WHEN event_type = 'error' THEN 'status' ELSE 'no price' END AS reject_reason, count(*) AS n FROM events WHERE event_type = 'error' OR value IS NULL OR NOT value > 0 GROUP BY 1")
def live_dead_letter(spark: SparkSession, d: str) -> DataFrame:
    return live.quotes(_t(spark, d, "events")).filter("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))


def _named_parts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_name", "p_brand", "p_type").alias("name"))


@query("SELECT min(p_partkey) AS p_partkey, concat_ws('|', p_name, p_brand, p_type) AS name FROM part GROUP BY 2 HAVING count(*) = 1")
def unique_name_match(spark: SparkSession, d: str) -> DataFrame:
    return lookup.unique_only(_named_parts(spark, d), "name")


@query("SELECT p_partkey, name, n_rows FROM (SELECT p_partkey, concat_ws('|', p_name, p_brand, p_type) AS name, count(*) OVER (PARTITION BY concat_ws('|', p_name, p_brand, p_type)) AS n_rows FROM part) WHERE n_rows > 1")
def collision_rows(spark: SparkSession, d: str) -> DataFrame:
    return lookup.collisions(_named_parts(spark, d), ["name"])


@query("SELECT count(*) AS n, count(s_suppkey) AS matched, CAST(sum(CASE WHEN s_suppkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def naive_join_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").join(_t(spark, d, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left")
    return rows.agg(F.count("*").alias("n"), F.count("s_suppkey").alias("matched"), F.sum(F.col("s_suppkey").isNull().cast("long")).alias("unmatched"))


WATERFALL = """WITH n AS (SELECT p_partkey, concat_ws('|', p_name, p_brand, p_type) AS name FROM part), u AS (SELECT name, min(p_partkey) AS k FROM n GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT n.p_partkey, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_suppkey WHEN n.p_partkey % 7 = 0 THEN NULL WHEN c.c_custkey IS NOT NULL THEN c.c_custkey ELSE u.k END AS target,
CASE WHEN s.s_suppkey IS NOT NULL THEN 'supplier' WHEN n.p_partkey % 7 = 0 THEN 'none' WHEN c.c_custkey IS NOT NULL THEN 'customer' WHEN u.k IS NOT NULL THEN 'name' ELSE 'none' END AS method
FROM n LEFT JOIN supplier s ON s_suppkey = n.p_partkey LEFT JOIN customer c ON c_custkey = n.p_partkey LEFT JOIN u ON u.name = n.name) """


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    parts = _named_parts(spark, d).withColumn("ticker", F.col("p_partkey"))
    dims = [("supplier", "ticker", _t(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("t"))), ("customer", "ticker", _t(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("t")))]
    dims.append(("name", "name", lookup.unique_only(_named_parts(spark, d), "name").select("name", "p_partkey")))
    return lookup.resolve(parts, dims, F.col("p_partkey") % 7 == 0)


@query(WATERFALL + "SELECT p_partkey, target, method FROM r")
def resolve_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("p_partkey", "target", "method")


@query(WATERFALL + "SELECT method, count(*) AS n FROM r GROUP BY 1")
def resolve_method_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).groupBy("method").agg(F.count("*").alias("n"))


@query("SELECT key, source FROM (SELECT c_custkey AS key, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer))")
def universe_union(spark: SparkSession, d: str) -> DataFrame:
    both = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("source"), F.lit(0).alias("o")).unionByName(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("source"), F.lit(1).alias("o")))
    return lookup.one_per_key(both, ["key"], [F.col("o")]).select("key", "source")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '''=' || p_name ELSE p_name END AS cell FROM part")
def csv_sanitise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("="), F.col("p_name"))).otherwise(F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", scalar.csv_safe(raw).alias("cell"))


@query(COMPANY + "SELECT fund, count(*) AS holdings, count(ff) AS with_float FROM (SELECT 'eem' AS fund, ff FROM seg WHERE in_eem UNION ALL SELECT 'smin', ff FROM seg WHERE in_smin UNION ALL SELECT 'eems', ff FROM seg WHERE in_eems) GROUP BY 1")
def fund_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_funds(C.companies(spark, d))
    return C.fund_weights(rows).join(rows.select("p_partkey", "ff"), "p_partkey").groupBy("fund").agg(F.count("*").alias("holdings"), F.count("ff").alias("with_float"))



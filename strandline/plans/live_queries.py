"""Queries that run streams: events come in two instalments, and the stream is started again for the second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalar
from strandline.functions import format as fmt
from strandline.functions.scalar import rounded
from strandline.plans import company as C
from strandline.plans.published import Files
from strandline.plans.tables import workspace
from strandline.plans.workload import COMPANY, QUERIES, SQL, _half_up, _t, query
from strandline.streaming import keyed, live, model

__all__ = ["QUERIES", "SQL"]

_GOOD = "event_type <> 'error' AND value > 0"



def _early(share: float) -> str:
    return f"event_id < (SELECT max(event_id) * {share} FROM events)"


_EARLY = _early(0.9)


def _last_quotes(name: str, also: str = "true") -> str:
    return f"{name} AS (SELECT user_id, arg_max(value, (ts, event_id)) AS p FROM events WHERE {_GOOD} AND {also} GROUP BY 1)"


def _moved(early: str) -> str:
    return f"WITH {_last_quotes('b', early)}, {_last_quotes('n')}, moved AS (SELECT n.user_id AS symbol, b.p AS old_price, n.p AS price FROM n LEFT JOIN b USING (user_id) WHERE b.p IS DISTINCT FROM n.p)"


def _instalments(spark: SparkSession, d: str, share: float = 0.9) -> list[DataFrame]:
    events = _t(spark, d, "events")
    cut = events.agg((F.max("event_id") * share).alias("m")).scalar()
    return [events.filter(F.col("event_id") < cut), events.filter(F.col("event_id") >= cut)]


def _next_batch(spark: SparkSession, folder: str) -> int:
    """The number of the batch that is written to ``folder`` next."""
    return 1 + max((int(n.removeprefix("batch=")) for n in Files(spark, folder).names("") if n.startswith("batch=")), default=-1)


def _last_batch(spark: SparkSession, folder: str, first_new: int) -> DataFrame:
    return spark.read.parquet(folder).filter(F.col("batch") >= first_new).drop("batch")


def _streamed(spark: SparkSession, d: str) -> tuple[str, int]:
    """The folder of a stream over both instalments and the first batch of the second one."""
    at, batches = workspace(spark, "stream"), []
    for part in _instalments(spark, d):
        part.write.mode("append").parquet(f"{at}/in")
        keyed.start_changes(spark, f"{at}/in", f"{at}/checkpoint", f"{at}/changes").awaitTermination()
        batches.append(_next_batch(spark, f"{at}/changes"))
    return at, batches[0]


@query(f"{_moved(_EARLY)} SELECT symbol, old_price, price FROM moved")
def stream_changed_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that the second instalment changes, as the stream emits them from its state."""
    at, second = _streamed(spark, d)
    return _last_batch(spark, f"{at}/changes", second).select("symbol", "old_price", "price")


@query(f"SELECT user_id AS symbol, arg_max(value, (ts, event_id)) AS price FROM events WHERE {_GOOD} GROUP BY 1")
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """What the state store holds after both instalments, read from the checkpoint."""
    at, _ = _streamed(spark, d)
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{at}/checkpoint")
    return state.select(F.col("key.symbol").alias("symbol"), F.col("value.price").alias("price"))


def _company_under(quotes: str, name: str) -> str:
    """The verdicts of the model whose free floats follow the quotes of a CTE (user_id, p), as the CTE ``name``."""
    sql = COMPANY.replace("WITH per AS", f"WITH {quotes}, per AS", 1).replace("company AS (", "base_company AS (", 1)
    over = "company AS (SELECT * REPLACE (CASE WHEN p_partkey % 53 <> 0 THEN floor(factor * shares * coalesce(p, price) + 0.5) END AS ff) FROM base_company LEFT JOIN q ON user_id = p_partkey), "
    return f"{name} AS ({sql.replace('held AS (SELECT *,', over + 'held AS (SELECT *,', 1)} SELECT p_partkey, verdict FROM verdict)"


#: Of the companies few have a quote in the first instalment, so that the second moves many a verdict.
FEW = 0.01
BOTH = f"{_moved(_early(FEW))}, {_company_under(_last_quotes('q', _early(FEW)), 'old')}, {_company_under(_last_quotes('q'), 'now')}"


@query(BOTH + " SELECT p_partkey, symbol IS NOT NULL AS price_changed, old.verdict <> now.verdict AS verdict_changed, old.verdict AS before, now.verdict AS after FROM old JOIN now USING (p_partkey) LEFT JOIN moved ON symbol = p_partkey WHERE symbol IS NOT NULL OR old.verdict <> now.verdict")
def stream_changed_companies(spark: SparkSession, d: str) -> DataFrame:
    """Companies whose price or verdict the second instalment changes: the model runs again in every batch of the stream."""
    at, batches = workspace(spark, "stream"), []
    base = C.companies(spark, d)
    for part in _instalments(spark, d, FEW):
        part.write.mode("append").parquet(f"{at}/in")
        model.start_model(spark, base, f"{at}/in", f"{at}/checkpoint", at, lambda rows: C.verdicts(C.with_funds(rows)), "p_partkey").awaitTermination()
        batches.append(_next_batch(spark, f"{at}/changes"))
    return _last_batch(spark, f"{at}/changes", batches[0])


@query(f"SELECT user_id AS symbol, arg_max(value, (ts, event_id)) AS price FROM events WHERE {_GOOD} AND isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) BETWEEN 555 AND 930 GROUP BY 1")
def stream_session_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Latest quotes of a stream that takes only what comes while the exchange is open."""
    at = workspace(spark, "stream")
    _t(spark, d, "events").write.parquet(f"{at}/in")
    keyed.start_changes(spark, f"{at}/in", f"{at}/checkpoint", f"{at}/changes", gate=scalar.market_open(F.col("ts"))).awaitTermination()
    return spark.read.parquet(f"{at}/changes").select("symbol", "price")


@query("SELECT coalesce(why, 'absent') AS reject_reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'status' ELSE 'no price' END AS why FROM events WHERE event_type = 'error' OR value IS NULL OR NOT value > 0 UNION ALL SELECT NULL FROM part WHERE p_partkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error' AND value > 0 AND user_id IS NOT NULL)) GROUP BY 1")
def stream_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Why events were no quotes, and how many companies that were asked for had none."""
    at = workspace(spark, "stream")
    _t(spark, d, "events").write.parquet(f"{at}/in")
    keyed.start_dead_letters(spark, f"{at}/in", f"{at}/checkpoint", f"{at}/dead").awaitTermination()
    dead = spark.read.parquet(f"{at}/dead").select("symbol", "reject_reason")
    asked = _t(spark, d, "part").select(F.col("p_partkey").alias("symbol"))
    return dead.unionByName(live.absent(asked, live.latest(live.quotes(_t(spark, d, "events"))))).groupBy("reject_reason").agg(F.count("*").alias("n"))


_OVER = "(SELECT p_partkey, p_size, p_retailprice AS price, p_retailprice * (1 - (p_size % 7 - 3) / 100.0::DOUBLE) AS prev, p_size % 4 AS stale, q.p, b.p AS before FROM part LEFT JOIN q ON q.user_id = p_partkey LEFT JOIN b ON b.user_id = p_partkey)"


@query(f"WITH {_last_quotes('q')}, {_last_quotes('b', _EARLY)}, x AS (SELECT *, coalesce(p, price) AS now, CASE WHEN p IS NULL THEN prev ELSE coalesce(before, prev) END AS was FROM {_OVER}) SELECT p_partkey, now AS price, was AS prev_close, CASE WHEN p IS NULL THEN CASE WHEN stale > 0 THEN 'stale' ELSE 'eod' END ELSE 'live' END AS tier, CASE WHEN p IS NULL THEN 'BSE' ELSE 'NSE' END AS exchange, CAST(CASE WHEN p IS NULL THEN stale ELSE 0 END AS INTEGER) AS stale_days, {_half_up('(now - was) / was * 100', 4)} AS day_change_pct FROM x")
def live_view(spark: SparkSession, d: str) -> DataFrame:
    """Every part under its live quote, with previous close, day change and staleness; the early quotes stand for the closes of the day before."""
    events, early = _t(spark, d, "events"), _instalments(spark, d)[0]
    before = live.latest(live.quotes(early)).select("symbol", F.col("price").alias("prev_close"))
    now = live.latest(live.quotes(events)).select("symbol", "price").join(before, "symbol", "left")
    base = _t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * (1 - (F.col("p_size") % 7 - 3) / 100)).alias("prev_close"), (F.col("p_size") % 4).cast("int").alias("stale_days"))
    base = base.withColumns({"factor": F.lit(1.0), "shares": F.lit(1.0), "ff": F.col("price")})
    rows = live.overlaid(base, now, "p_partkey")
    return rows.select("p_partkey", "price", "prev_close", "tier", "exchange", "stale_days", rounded(F.col("day_change_pct"), 4).alias("day_change_pct"))

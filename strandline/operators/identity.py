"""Resolution of holdings against a master, an exchange universe and a seed list, with the method, how sure it is, and the reason where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import normalised_name, normalised_ticker
from strandline.operators.lookup import one_per_key, unique_only
from strandline.plans.tables import stored


SCRIP = ("isin", "scrip_code", "scrip_id", "name", "symbol", "symbol_source")


def symbols_by_isin(universe: DataFrame, seed: DataFrame) -> DataFrame:
    """(isin, symbol, symbol_source): the universe's symbol where one row alone has the ISIN, else that of the first seed row with it."""
    first = unique_only(universe.select("isin", "symbol"), "isin").select("isin", "symbol", F.lit("nse-universe").alias("symbol_source"))
    filled = one_per_key(seed.filter("isin IS NOT NULL"), ["isin"], [F.col("ord")]).filter("symbol IS NOT NULL").select("isin", "symbol", F.lit("seed").alias("symbol_source"))
    return first.unionByName(filled.join(first, "isin", "left_anti"))


def first_of_list(listed: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, rows): what a list kept by hand says of each ``key``, in the list's order ``ord``; one row a key, so a join cannot double anything."""
    rows = F.array_sort(F.collect_list(F.struct("ord", *columns)))
    return listed.groupBy(key).agg(rows.alias("rows"))


def _keyed(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(f"{name}_key"), F.struct(*SCRIP).alias(name))


def resolve_holdings(holdings: DataFrame, master: DataFrame, universe: DataFrame, seed: DataFrame, confirmed: DataFrame, blocked: DataFrame) -> DataFrame:
    """``holdings`` (key, ticker, name) with isin, symbol, symbol_source, scrip_code, scrip_id, resolved_name, method, via, confidence, reason; one row each, whatever the lists hold.

    ``master`` (ord, scrip_code, scrip_id, isin, name), ``universe`` (ord, symbol, isin, name), ``seed`` (ord, symbol, isin,
    scrip_code, name), ``confirmed`` (ord, ticker, scrip_code, isin), ``blocked`` (ord, ticker, name_prefix, reason). In order: blocked by ticker
    and the first prefix of the name; the first confirmed row, if the master still agrees; scrip id; scrip code (terminal for a numeric ticker); no ticker
    (terminal); universe symbol; seed symbol, whose code is believed only where its ISIN agrees; a name that one scrip alone has.
    Master ids and codes and seed symbols: the first row counts; universe symbols: the last; ISINs and names: only if one row has
    them. What is found carries the symbol of its ISIN with the list that says so. Every stage is a left join against keys that occur once.
    """
    # the lists are looked up in several ways: each is put in shape once
    scrips = stored(master.join(symbols_by_isin(universe, seed), "isin", "left"))
    codes = stored(one_per_key(scrips.filter("scrip_code IS NOT NULL"), ["scrip_code"], [F.col("ord")]))
    lone = stored(unique_only(scrips, "isin"))
    named = scrips.withColumn("norm", normalised_name(F.col("name"))).filter("norm <> ''")
    hits = named.groupBy("norm").agg(F.count("*").alias("hits"), F.any_value(F.struct(*SCRIP)).alias("name_hit"))
    last = one_per_key(universe, ["symbol"], [F.desc("ord")])
    first = one_per_key(seed.withColumn("norm", normalised_ticker(F.col("symbol"))).filter("norm <> ''"), ["norm"], [F.col("ord")])
    by_isin = lone.select(F.col("isin").alias("lone_key"), F.struct("scrip_code", "scrip_id", "name").alias("lone"))
    by_code = codes.select(F.col("scrip_code").alias("code_key"), F.col("isin").alias("code_isin"), F.struct("scrip_code", "scrip_id", "name").alias("code"))

    def listed(rows: DataFrame, scrip: Column, source: str, key: str, name: str) -> DataFrame:
        """An exchange listing with the scrip of the same company, if there is one; its own name where there is none."""
        fields = F.struct("isin", scrip["scrip_code"].alias("scrip_code"), scrip["scrip_id"].alias("scrip_id"), F.coalesce(scrip["name"], "name").alias("name"), "symbol", F.lit(source).alias("symbol_source"))
        return rows.select(F.col(key).alias(f"{name}_key"), fields.alias(name))

    by_symbol = listed(last.join(by_isin, F.col("isin") == F.col("lone_key"), "left"), F.col("lone"), "nse-universe", "symbol", "nse")
    both = first.join(by_code, F.col("scrip_code") == F.col("code_key"), "left").join(by_isin, F.col("isin") == F.col("lone_key"), "left")
    believed = F.when(F.col("code").isNull(), F.col("lone")).when(F.col("code_isin") == F.col("isin"), F.col("code"))
    by_seed = listed(both, believed, "seed", "norm", "seed")
    pins = first_of_list(confirmed, "ticker", "scrip_code", "isin").select(F.col("ticker").alias("pin_key"), F.get("rows", F.lit(0)).alias("said"))
    pins = pins.join(codes.select(F.col("scrip_code").alias("_c"), F.struct(*SCRIP).alias("pin")), F.col("said.scrip_code") == F.col("_c"), "left").drop("_c")
    stops = first_of_list(blocked.withColumn("prefix", normalised_name(F.col("name_prefix"))), "ticker", "prefix", "reason").select(F.col("ticker").alias("block_key"), F.col("rows").alias("stops"))

    text = lambda c: F.coalesce(c, F.lit(""))
    rows = holdings.withColumn("t", F.trim(text("ticker"))).withColumn("nt", normalised_ticker(text("ticker"))).withColumn("nn", normalised_name(text("name")))
    by_id = _keyed(one_per_key(scrips.filter("scrip_id IS NOT NULL"), ["scrip_id"], [F.col("ord")]), "scrip_id", "id")
    dims = ((stops, "t", "block"), (pins, "t", "pin"), (by_id, "t", "id"), (_keyed(codes, "scrip_code", "num"), "t", "num"), (by_symbol, "nt", "nse"), (by_seed, "nt", "seed"), (hits.withColumnRenamed("norm", "name_key"), "nn", "name"))
    for dim, on, prefix in dims:
        rows = rows.join(dim, F.col(on) == F.col(f"{prefix}_key"), "left")
    rows = rows.withColumn("stop", F.get(F.filter("stops", lambda s: F.startswith(F.col("nn"), s["prefix"])), F.lit(0)))
    numeric, empty = F.col("t").rlike(r"^\d+$"), F.col("t").isin("", "--")
    has = lambda p: F.col(f"{p}_key").isNotNull()
    nothing, no = F.lit(None).cast(rows.schema["id"].dataType), F.lit(None).cast("string")
    agrees = F.coalesce(F.col("pin.isin") == F.col("said.isin"), F.lit(False))
    # condition, method, via, confidence, what was found, reason
    steps: list[tuple[Column, str, str, str, Column, Column]] = [
        (F.col("stop").isNotNull(), "none", "none", "none", nothing, F.col("stop.reason")),
        (has("pin") & agrees, "confirmed", "", "hand-checked", F.col("pin"), no),
        (has("pin"), "none", "none", "none", nothing, F.format_string("confirmed mapping of %s no longer agrees with the master", "t")),
        (has("id") & ~empty, "scrip_id", "", "exact", F.col("id"), no),
        (numeric & has("num"), "scrip_code", "", "exact", F.col("num"), no),
        (numeric, "none", "none", "none", nothing, F.format_string("%s reads as a scrip code and is not in the master", "t")),
        (empty, "none", "none", "none", nothing, F.lit("no ticker")),
        (has("nse"), "isin", "nse-universe", "exact", F.col("nse"), no),
        (has("seed"), "isin", "seed", "exact", F.col("seed"), no),
        (has("name") & (F.col("hits") == 1), "name", "", "normalised-name", F.col("name_hit"), no),
        (has("name"), "none", "none", "none", nothing, F.format_string("the name matches %d scrips", "hits")),
        (F.lit(True), "none", "none", "none", nothing, F.lit("no match")),
    ]
    says = lambda method, via, sure, found, reason: F.struct(F.lit(method).alias("method"), (F.lit(via) if via else F.when(found["isin"].isNotNull(), "isin").otherwise("bse-scrip")).alias("via"), F.lit(sure).alias("confidence"), found.alias("found"), reason.alias("reason"))
    picked = says(*steps[-1][1:])
    for cond, *rest in reversed(steps[:-1]):
        picked = F.when(cond, says(*rest)).otherwise(picked)
    out = rows.select(*(F.col(c) for c in holdings.columns), picked.alias("_p"))
    found = [F.col(f"_p.found.{c}").alias("resolved_name" if c == "name" else c) for c in SCRIP]
    return out.select(*holdings.columns, *found, *(F.col(f"_p.{c}") for c in ("method", "via", "confidence", "reason")))


def conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """ISINs for which two sources (isin, symbol) name different symbols, the right one being unique."""
    other = unique_only(right.filter("isin IS NOT NULL"), "isin").select("isin", normalised_ticker(F.col("symbol")).alias("theirs"))
    rows = left.select("isin", normalised_ticker(F.col("symbol")).alias("ours")).join(other, "isin")
    return rows.filter("ours <> theirs")


def merged_lists(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index lists (source, symbol, isin, name) as one row a symbol with its sources, and rejects with a reason.

    A placeholder ISIN and a malformed one are rejected, and so is a symbol that comes with two ISINs.
    """
    why = F.when(F.col("isin").startswith("DUM"), "placeholder").when(F.col("isin").isNull() | ~F.col("isin").rlike("^IN[A-Z0-9]{10}$"), "malformed isin")
    rows = lists.withColumn("reject_reason", why)
    own = Window.partitionBy("symbol")
    good = rows.filter("reject_reason IS NULL").withColumn("lo", F.min("isin").over(own)).withColumn("hi", F.max("isin").over(own))
    bad = rows.filter("reject_reason IS NOT NULL").unionByName(good.filter("lo <> hi").withColumn("reject_reason", F.lit("two isins")).drop("lo", "hi"))
    kept = good.filter("lo = hi").groupBy("symbol").agg(F.min("isin").alias("isin"), F.min("name").alias("name"), F.array_sort(F.collect_set("source")).alias("sources"))
    return kept, bad


def superset_problems(narrow: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """One row: keys of ``narrow`` that ``wide`` lacks, both counts, and whether wide is strictly larger."""
    both = narrow.select(key).distinct().withColumn("n", F.lit(1)).join(wide.select(key).distinct().withColumn("w", F.lit(1)), key, "full")
    out = both.agg(F.count_if(F.col("w").isNull()).alias("missing"), F.count("n").alias("narrow"), F.count("w").alias("wide"))
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("wide") > F.col("narrow")))

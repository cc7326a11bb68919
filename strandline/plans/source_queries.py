"""Queries that write files from the tables in the feeds' shapes and read them back through the sources, with the SQL of what has to come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import parse, scalar
from strandline.plans import benchmarks as B
from strandline.plans.model_queries import SUMMARY
from strandline.plans.tables import workspace
from strandline.plans.workload import QUERIES, SQL, _daily, _fx, _t, query
from strandline.sources import readers

__all__ = ["QUERIES", "SQL"]


@query("SELECT d, CASE WHEN dayofyear(d) % 7 = 4 AND year(d) < 2000 THEN CAST(d + INTERVAL 100 YEAR AS DATE) WHEN dayofyear(d) % 7 <> 6 THEN d END AS parsed FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def feed_date_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Dates in the six shapes of the feeds, of which one has years of two digits, in this century, and in one that is none of them."""
    day = _t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    text = F.date_format("d", "EEE, d MMMM")
    for k, shape in enumerate(("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "d-MMM-yyyy HH:mm:ss", "d-MMM-yyyy", "d MMM yy '|' HH:mm", "MMM d, yyyy")):
        text = F.when(F.dayofyear("d") % 7 == k, F.date_format(F.col("d").cast("timestamp"), shape)).otherwise(text)
    return day.select("d", parse.feed_date(text).alias("parsed"))


@query("SELECT CASE WHEN p_size % 11 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS scrip_code, p_name || ', \"Ltd\"' AS name, DATE '2026-01-05' AS trade_date, p_retailprice AS close, CASE WHEN p_size % 4 > 0 THEN CAST(p_size % 4 AS DOUBLE) END AS low, CAST(p_size % 3 AS DOUBLE) AS volume, CASE WHEN p_size % 11 = 0 THEN 'no scrip code' END AS reject_reason FROM part")
def price_file_rows(spark: SparkSession, d: str) -> DataFrame:
    """A day's price file in parts: prices of zero become null, counts of zero stay, rows without a scrip code are told."""
    size, text = F.col("p_size"), lambda c: c.cast("string")
    cells = {
        "TradDt": F.lit("2026-01-05"), "FinInstrmTp": F.lit("STK"), "FinInstrmId": F.when(size % 11 != 0, text(F.col("p_partkey"))).otherwise(""), "ISIN": F.lit("INE000000001"), "TckrSymb": F.concat(F.lit("S"), "p_partkey"), "SctySrs": F.lit("A"),
        "FinInstrmNm": F.concat("p_name", F.lit(', "Ltd"')), "OpnPric": F.lit("-"), "HghPric": F.lit("1"), "LwPric": text(size % 4), "ClsPric": text(F.col("p_retailprice")), "LastPric": F.lit("0"), "PrvsClsgPric": F.lit("NaN"), "TtlTradgVol": text(size % 3),
    }
    path = workspace(spark, "prices")
    _t(spark, d, "part").select(*(c.alias(n) for n, c in cells.items())).write.csv(path, header=True, escape='"')
    return readers.price_file(spark, path).select("scrip_code", "name", "trade_date", "close", "low", "volume", "reject_reason")


def _one_file(spark: SparkSession, sections: list[DataFrame], name: str) -> str:
    """The lines (at, value) of the sections, one behind the other and each in its order, as one file, which is what such a document is."""
    path = workspace(spark, name)
    lines = [df.select(F.lit(k).alias("section"), F.col("at").cast("long").alias("at"), "value") for k, df in enumerate(sections)]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    out.repartition(1).sortWithinPartitions("section", "at").select("value").write.text(path)
    (part,) = [n for n in readers.file_names(spark, path) if n.startswith("part-")]
    return f"{path}/{part}"


def _text(spark: SparkSession, *lines: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "at long, value string")


@query("SELECT CAST(p_partkey AS VARCHAR) AS k, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_size % 5 = 0 THEN 'short row' END AS reject_reason FROM part")
def strict_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table read by its header, quoted cells with commas and line ends, extra cells, and short rows that are told."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    full = F.concat(F.lit('"'), "p_name", F.lit(', ""x""\nmore",'), k, F.lit(","), size, F.when(F.col("p_size") % 3 == 0, ",extra").otherwise(""))
    short = F.concat(F.lit('"a, b",'), k)
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("at"), F.when(F.col("p_size") % 5 == 0, short).otherwise(full).alias("value"))
    path = _one_file(spark, [_text(spark, "﻿Name,Key,Size"), rows], "table")
    return readers.strict_csv(spark, path, ["Key", "Size"]).select(F.col("Key").alias("k"), F.col("Size").alias("size"), "reject_reason")


@query("SELECT p_partkey, p_name || ', x' AS name, CAST(p_retailprice AS VARCHAR) AS price, CASE WHEN p_size % 2 = 0 THEN 'z' END AS last FROM part")
def csv_line_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of single lines, quoted ones and missing ones among them."""
    line = F.concat(F.lit('"'), "p_name", F.lit(', x",'), F.col("p_retailprice").cast("string"), F.when(F.col("p_size") % 2 == 0, ",z").otherwise(""))
    cells = _t(spark, d, "part").select("p_partkey", readers.csv_cells(line, 3).alias("c"))
    return cells.select("p_partkey", F.col("c")[0].alias("name"), F.col("c")[1].alias("price"), F.col("c")[2].alias("last"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _workbook(spark: SparkSession, d: str) -> str:
    """The parts as a sheet below a preamble, every row in its place with gaps between, and a second sheet."""
    data = lambda kind, c: F.concat(F.lit(f'<x:Cell><x:Data x:Type="{kind}">'), c, F.lit("</x:Data></x:Cell>"))
    far = F.concat(F.lit('<x:Cell x:Index="5"><x:Data x:Type="Boolean">'), (F.col("p_size") % 2).cast("string"), F.lit("</x:Data></x:Cell>"))
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("at"), F.concat(F.lit('<x:Row x:Index="'), (F.col("p_partkey") * 2 + 10).cast("string"), F.lit('">'), data("String", F.col("p_partkey").cast("string")), data("String", _escaped(F.concat("p_name", F.lit(" & <Co>")))), data("Number", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_retailprice").cast("string"))), far, F.lit("</x:Row>")).alias("value"))
    cell = lambda *texts: "<x:Row>" + "".join(f'<x:Cell><x:Data x:Type="String">{t}</x:Data></x:Cell>' for t in texts) + "</x:Row>"
    head = ['<?xml version="1.0"?>', '<x:Workbook xmlns:x="urn:s">', '<x:Worksheet x:Name="Holdings"><x:Table>', cell("All parts"), cell("Jan 5, 2026"), cell("As of", "5 January"), cell("Rows", "many"), cell("Key", "Name", "Price", "Key", "Flag")]
    tail = ['</x:Table></x:Worksheet><x:Worksheet x:Name="Notes"><x:Table>', cell("Key", "other"), "</x:Table></x:Worksheet></x:Workbook>"]
    return _one_file(spark, [_text(spark, *head), rows, _text(spark, *tail)], "workbook")


@query("SELECT CAST(p_partkey * 2 + 9 AS INTEGER) AS row_no, CAST(p_partkey AS VARCHAR) AS k, p_name || ' & <Co>' AS name, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS price, p_size % 2 = 1 AS flag FROM part")
def workbook_cells(spark: SparkSession, d: str) -> DataFrame:
    """Typed cells of a sheet by its header row, read in ranges of rows: numbers, flags and texts, and the place of every row."""
    sheet = readers.workbook_rows(spark, _workbook(spark, d), "Holdings", 300)
    typed = sheet.filter("row_no > 4").select("row_no", *(parse.typed_cell(F.get("cells", F.lit(i)), F.get("kinds", F.lit(i))).alias(n) for i, n in enumerate(("k", "name", "price", "gap", "flag"))))
    return typed.select("row_no", F.col("k.text").alias("k"), F.col("name.text").alias("name"), F.col("price.number").alias("price"), F.col("flag.flag").alias("flag"))


@query("SELECT 'record' AS what, CAST(p_partkey AS VARCHAR) AS k, p_name || ' & <Co>' AS v FROM part UNION ALL SELECT 'preamble', 'As of', '5 January' UNION ALL SELECT 'preamble', 'Rows', 'many' UNION ALL SELECT 'preamble', NULL, 'All parts'")
def workbook_records(spark: SparkSession, d: str) -> DataFrame:
    """Records by header name, of equal names the first, and what the rows above the header say."""
    sheet = readers.workbook_rows(spark, _workbook(spark, d), "Holdings", 300)
    records = readers.sheet_records(sheet, "Key").select(F.lit("record").alias("what"), F.col("record")["Key"].alias("k"), F.col("record")["Name"].alias("v"))
    return records.unionByName(readers.preamble(sheet, "Key").select(F.lit("preamble").alias("what"), F.col("key").alias("k"), F.col("value").alias("v")))


@query("SELECT p_partkey, CASE WHEN p_size % 4 <> 3 THEN CAST(floor(x * 1e7 + 0.5) AS BIGINT) END AS rupees, CASE WHEN p_size % 4 <> 3 THEN x END AS reading, CASE WHEN p_size % 4 <> 3 THEN x END AS price FROM (SELECT p_partkey, p_size, floor(p_retailprice * 100 + 0.5) / 100 * 10 AS x FROM part)")
def money_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of money in crore as rupees, as readings and as prices; texts that are no whole number are none."""
    x = scalar.rounded(F.col("p_retailprice"), 2) * 10
    text = F.when(F.col("p_size") % 4 == 0, F.format_number(x, 2)).when(F.col("p_size") % 4 == 3, F.concat(F.format_number(x, 2), F.lit(" Cr"))).otherwise(F.format_string("%.2f", x))
    return _t(spark, d, "part").select("p_partkey", parse.crore_to_rupees(text).cast("long").alias("rupees"), parse.reading(text).alias("reading"), parse.price(text).alias("price"))


@query("SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS digest FROM (SELECT c_custkey, hex(encode(c_name || 'é')) AS x FROM customer)")
def short_digests(spark: SparkSession, d: str) -> DataFrame:
    """The 32-bit digests of names, letters of several bytes among them."""
    return _t(spark, d, "customer").select("c_custkey", scalar.fnv1a(F.concat("c_name", F.lit("é"))).alias("digest"))


@query(f"SELECT count(*) AS n, count(*) FILTER (own_pct <> converted_pct) > 0 AS converted FROM ({SUMMARY})")
def dq_conversion_seen(spark: SparkSession, d: str) -> DataFrame:
    """Whether returns in the other currency differ from the series' own somewhere: if none does, nothing was converted."""
    daily = _daily(spark, d)
    rows = B.summary(daily, _fx(daily), "1998-01-01")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("own_pct") != F.col("converted_pct")), F.lit(False)).alias("converted"))

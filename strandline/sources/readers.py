"""Readers for delimited text, XML workbooks, paired arrays and shape-guarded files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.parse import count_value, feed_date, price
from strandline.plans.tables import stored
from strandline.sources.workbook import WorkbookSource, opened


def strict_csv(spark: SparkSession, path: str, required: list[str], optional: list[str] | None = None) -> DataFrame:
    """Columns ``required`` and ``optional`` by header name as strings, and ``reject_reason`` (null where good).

    A missing or doubled header raises; an optional column that is not there is null. A row with fewer cells than the header is rejected; more cells are ignored.
    """
    header = spark.read.csv(path, multiLine=True, escape='"').first()
    names = [(c or "").lstrip("﻿").strip() for c in header] if header else []
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing columns {missing}")
    if len(set(n for n in names if n)) < len([n for n in names if n]):
        raise ValueError("doubled header")
    wide = [*(f"c{i}" for i in range(len(names))), "_corrupt"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in wide])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True)
    # a corrupt row is a short or a long one: its cells are counted with the quoted ones closed up
    cells = F.size(F.split(F.regexp_replace("_corrupt", r'"([^"]|"")*"', "q"), ","))
    short = F.col("_corrupt").isNotNull() & (cells < len(names))
    cell = lambda c: F.trim(f"c{names.index(c)}") if c in names else F.lit(None).cast("string")
    return rows.select(*(cell(c).alias(c) for c in [*required, *(optional or [])]), F.when(short, "short row").alias("reject_reason"))


def csv_cells(line: Column, n: int) -> Column:
    """The first ``n`` cells of one delimited line, quotes and a leading mark of the encoding taken off."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    row = F.from_csv(F.regexp_replace(line, "^\ufeff", ""), schema, {"mode": "PERMISSIVE", "escape": '"'})
    return F.array(*(F.trim(row[f"c{i}"]) for i in range(n)))


def shape_problems(text: Column, required: list[str] | None = None, content_type: Column | None = None, date_column: str | None = None, expected: Column | None = None) -> Column:
    """What keeps a text from being a delimited table: an array, empty where nothing does.

    With ``date_column`` its cells have to be ISO dates, and ``expected`` (a date) what they say.
    """
    head = F.lower(F.substring(text, 1, 400))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    checks = [
        (F.coalesce(F.trim(text), F.lit("")) == "", "empty"),
        (head.contains("<!doctype") | head.contains("<html"), "markup"),
        (F.size(lines) < 2, "fewer than two lines"),
    ]
    header = F.split(F.get(lines, F.lit(0)), ",")
    checks += [(~F.array_contains(header, c), f"no column {c}") for c in required or []]
    if content_type is not None:
        checks.append((F.coalesce(F.lower(content_type).contains("html"), F.lit(False)), "html content type"))
    if date_column:
        at = (F.array_position(header, date_column) - 1).cast("int")
        dates = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(F.get(F.split(x, ","), at)))
        checks.append((F.exists(dates, lambda x: x.isNull() | ~x.rlike(r"^\d{4}-\d{2}-\d{2}$")), "date is not iso"))
        if expected is not None:
            checks.append((F.exists(dates, lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}$") & (x != expected.cast("string"))), "another date"))
    return F.array_compact(F.array(*(F.when(bad, F.lit(why)) for bad, why in checks)))


#: What is read of a file before it is admitted.
HEAD_BYTES = 1 << 14


def _heads(required: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            headers, problems = [], []
            for path, length in zip(pdf["path"], pdf["length"], strict=True):
                with opened(path) as f:
                    head = f.read(HEAD_BYTES).decode("utf-8", "replace").lstrip("\ufeff")
                lines = [line for line in head.splitlines() if line.strip()]
                start = head[:400].lower()
                names = [c.strip().strip('"') for c in lines[0].split(",")] if lines else []
                found = ["empty"] if not lines and length <= HEAD_BYTES else []
                found += ["markup"] if "<!doctype" in start or "<html" in start else []
                found += ["fewer than two lines"] if len(lines) < 2 and length <= HEAD_BYTES else []
                headers.append(names)
                problems.append(found + [f"no column {c}" for c in required if c not in names])
            yield pd.DataFrame({"file": pdf["path"], "size": pdf["length"], "header": headers, "problems": problems})

    return run


def admitted_files(spark: SparkSession, path: str, required: Sequence[str], date_column: str | None = None, expected: str | None = None) -> DataFrame:
    """(file, size, problems) of every delimited file under ``path``; one without problems is admitted.

    Files are listed without being read; of each the first ``HEAD_BYTES`` are looked at, which tell an empty file, a page of markup, a file of one line and
    missing columns. Only what passes is read on, line by line, for dates that are not ISO or not the ``expected`` one.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    heads = stored(files.mapInPandas(_heads(required), "file string, size long, header array<string>, problems array<string>"))
    if not date_column:
        return heads.select("file", "size", "problems")
    good = heads.filter(F.size("problems") == 0)
    paths = [r["file"] for r in good.select("file").collect()]  # a name a file
    if not paths:
        return heads.select("file", "size", "problems")
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    at = good.select(F.col("file").alias("_file"), (F.array_position("header", date_column) - 1).cast("int").alias("_at"))
    rows = lines.join(at, F.regexp_replace("file", "^file:/+", "/") == F.regexp_replace("_file", "^file:/+", "/"))
    cell = F.regexp_replace(F.trim(F.get(F.split("value", ","), F.col("_at"))), '^"|"$', "")
    iso = F.coalesce(cell.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    per = rows.filter(F.coalesce(cell, F.lit("")) != date_column).groupBy("_file").agg(F.count_if(~iso).alias("odd"), F.count_if(iso & (cell != F.lit(expected))).alias("other"))
    told = F.array_compact(F.array(F.when(F.col("odd") > 0, "date is not iso"), F.when(F.col("other") > 0, "another date")))
    out = heads.join(per.select(F.col("_file").alias("file"), told.alias("more")), "file", "left")
    return out.select("file", "size", F.concat("problems", F.coalesce("more", F.array().cast("array<string>"))).alias("problems"))


def paired_arrays(df: DataFrame, stamps: str, values: str, *keys: str) -> DataFrame:
    """Parallel arrays of epoch seconds and closes to rows; null and non-positive closes leave."""
    rows = df.select(*keys, F.explode(F.arrays_zip(F.col(stamps).alias("t"), F.col(values).alias("v"))).alias("p"))
    return rows.select(*keys, F.timestamp_seconds("p.t").cast("date").alias("date"), F.col("p.v").cast("double").alias("close")).filter("close > 0")


def workbook_rows(spark: SparkSession, path: str, sheet: str, rows_a_partition: int = 5000) -> DataFrame:
    """(row_no, cells, kinds) of a sheet of a SpreadsheetML workbook: gaps are null, rows are numbered from 0 as the file places them."""
    spark.dataSource.register(WorkbookSource)
    rows = spark.read.format("workbook").option("sheet", sheet).option("rowsPerPartition", rows_a_partition).load(path)
    return rows.select("row_no", "cells", "kinds")


def sheet_records(rows: DataFrame, label: str) -> DataFrame:
    """(row_no, record): a map by header name of every row below the header, the first row whose first cell is ``label``.

    Blank rows are left out; of equal header names the first counts. A sheet without such a row raises.
    """
    head = rows.filter(F.trim(F.get("cells", F.lit(0))) == label).orderBy("row_no").first()  # one row
    if head is None:
        raise ValueError(f"no header row that begins with {label}")
    names = [(c or "").strip() for c in head["cells"]]
    first = {n: i for i, n in reversed(list(enumerate(names))) if n}
    record = F.create_map(*(x for n, i in sorted(first.items(), key=lambda p: p[1]) for x in (F.lit(n), F.get("cells", F.lit(i)))))
    below = rows.filter((F.col("row_no") > head["row_no"]) & F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return below.select("row_no", record.alias("record"))


def preamble(rows: DataFrame, label: str) -> DataFrame:
    """(row_no, key, value) of the rows above the header that hold two cells or more; a single cell that is no date is the title, under a null key."""
    top = rows.filter(F.trim(F.get("cells", F.lit(0))) == label).agg(F.min("row_no")).scalar()
    key, value = F.trim(F.get("cells", F.lit(0))), F.get(F.filter(F.slice("cells", 2, 1 << 30), lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), F.lit(0))
    above = rows.filter(F.col("row_no") < top).select("row_no", key.alias("key"), value.alias("value")).filter("key <> ''")
    title = F.col("value").isNull()
    return above.filter(~title | feed_date(F.col("key")).isNull()).select("row_no", F.when(~title, F.col("key")).alias("key"), F.when(title, F.col("key")).otherwise(F.col("value")).alias("value"))


#: Columns of a price file in the file's own order; the last two may be missing.
PRICE_COLUMNS = ("TradDt", "FinInstrmTp", "FinInstrmId", "ISIN", "TckrSymb", "SctySrs", "FinInstrmNm", "OpnPric", "HghPric", "LwPric", "ClsPric", "LastPric", "PrvsClsgPric")
OPTIONAL_PRICE_COLUMNS = ("TtlTradgVol", "TtlNbOfTxsExctd")


def price_file(spark: SparkSession, path: str) -> DataFrame:
    """A day's prices by header name: prices of zero or less are null, counts of zero stay, cells that a short row lacks are null.

    Rows without a scrip code come with ``reject_reason``, which is null for all others, so that they can be counted.
    """
    rows = strict_csv(spark, path, [*PRICE_COLUMNS], [*OPTIONAL_PRICE_COLUMNS])
    named = {"open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "last": "LastPric", "prev_close": "PrvsClsgPric"}
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select(
        text("FinInstrmId").alias("scrip_code"), text("ISIN").alias("isin"), text("TckrSymb").alias("symbol"), text("FinInstrmNm").alias("name"), text("SctySrs").alias("series"), text("FinInstrmTp").alias("kind"),
        feed_date(F.col("TradDt")).alias("trade_date"), *(price(F.col(c)).alias(n) for n, c in named.items()), count_value(F.col("TtlTradgVol")).alias("volume"), count_value(F.col("TtlNbOfTxsExctd")).alias("trades"),
        F.when(text("FinInstrmId").isNull(), "no scrip code").alias("reject_reason"),
    )


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder of any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def json_document(spark: SparkSession, path: str, schema: T.StructType, required: bool = True) -> DataFrame:
    """Rows of a whole-file JSON document; an optional one that is not there is an empty table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not required and not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)

"""Writes that count what they write, refuse what is too little, route rejects, and export in order."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.functions.scalar import csv_safe
from strandline.plans.published import current, discard, publish, stage


class Refused(ValueError):
    """A write that its rules forbid; no reader sees any of it."""


def counted(df: DataFrame, path: str, counters: Mapping[str, Column]) -> tuple[str, dict]:
    """Stages ``df`` at ``path`` and returns the folder with the ``counters``, aggregates that are taken from the rows while they are written."""
    seen = Observation(f"written-{uuid.uuid4().hex}")
    data = stage(df.observe(seen, *(c.alias(name) for name, c in counters.items())), path)
    return data, seen.get


def guarded_write(df: DataFrame, path: str, found: DataFrame, least_rows: int = 0, shrink: float = 1.0, floors: Mapping[str, tuple[Column, float]] | None = None, counters: Mapping[str, Column] | None = None) -> dict:
    """Publishes ``df`` as the next version of the table at ``path`` if ``found`` is empty, the rows reach ``least_rows`` and ``shrink`` of those published, and each share of ``floors`` its least.

    Rows, shares and ``counters`` are counted while the rows are staged, in the one pass there is; they are kept with the version and returned.
    The version before stays readable throughout; what was refused is removed.
    """
    spark = df.sparkSession
    if bad := found.groupBy("rule").count().orderBy("rule").limit(100).collect():
        raise Refused("; ".join(f"{r['rule']}: {r['count']}" for r in bad))
    shares = {f"share of {k}": F.coalesce(F.avg(c.cast("double")), F.lit(0.0)) for k, (c, _) in (floors or {}).items()}
    before = current(spark, path)
    data, got = counted(df, path, {"rows": F.count("*"), **shares, **(counters or {})})
    there = before.notes.get("rows", 0) if before else 0
    problems = [f"{got['rows']} rows; {least_rows} are the least, {there} are there"] if got["rows"] < least_rows or got["rows"] < shrink * there else []
    problems += [f"{k}: {got[f'share of {k}']:.4f} of {least:g}" for k, (_, least) in (floors or {}).items() if got[f"share of {k}"] < least]
    if problems:
        discard(spark, path, data)
        raise Refused("; ".join(problems))
    publish(spark, path, data, df.schema, before.version + 1 if before else 0, got)
    return got


def routed_write(df: DataFrame, path: str, routes: Sequence[str], reasons: Sequence[str]) -> dict:
    """Publishes rows with the columns ``route`` and ``reason`` in a folder a route, and returns how many went each way and why, counted in the same pass.

    A route or reason that is not listed is counted under ``other``; a reader that asks for one route reads that folder alone.
    """
    spark = df.sparkSession
    count = lambda c, values, kind: {f"{kind} {v}": F.count_if(F.col(c) == v) for v in values} | {f"{kind} other": F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values))}
    seen = Observation(f"routed-{uuid.uuid4().hex}")
    watched = df.observe(seen, F.count("*").alias("rows"), *(c.alias(n) for n, c in (count("route", routes, "route") | count("reason", reasons, "reason")).items()))
    data = f"data-{uuid.uuid4().hex}"
    watched.write.partitionBy("route").parquet(f"{path.rstrip('/')}/{data}")
    before = current(spark, path)
    publish(spark, path, data, df.schema, before.version + 1 if before else 0, seen.get)
    return seen.get


def csv_field(c: Column) -> Column:
    """A cell: nothing for null, an apostrophe before what a spreadsheet would take for a formula, quotes where a comma, a quote or a line end needs them."""
    text = csv_safe(c.cast("string"))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\n\r]'), quoted).otherwise(text), F.lit(""))


def csv_row(*cells: Column) -> Column:
    return F.array_join(F.array(*map(csv_field, cells)), ",")


BYTE_ORDER_MARK = "﻿"


def export_csv(df: DataFrame, path: str, banner: Sequence[Sequence[str]], orders: Sequence[Column], labels: Mapping[str, str] | None = None) -> None:
    """``df`` as one CSV file in numbered parts: a byte order mark, the ``banner`` rows, an empty line, the header and the rows by ``orders``, which must be total.

    Lines end in CR LF. The head is sorted with the rows, so it is in the first part; the parts in the order of their names are the file, and no task holds more
    than its range of rows.
    """
    spark = df.sparkSession
    head = [[*row] for row in banner] + [None, [(labels or {}).get(c, c) for c in df.columns]]
    lines = [(k, "" if cells is None else None, cells) for k, cells in enumerate(head)]
    top = spark.createDataFrame(lines, "at int, blank string, cells array<string>")  # a few lines
    text = F.coalesce("blank", F.array_join(F.transform("cells", csv_field), ","))
    top = top.select("at", F.when(F.col("at") == 0, F.concat(F.lit(BYTE_ORDER_MARK), text)).otherwise(text).alias("value"))
    body = df.withColumns({"_at": F.lit(len(lines)), "_value": csv_row(*(F.col(c) for c in df.columns))})
    both = body.unionByName(top.select(F.col("at").alias("_at"), F.col("value").alias("_value")), allowMissingColumns=True)
    both.orderBy("_at", *orders).select(F.col("_value").alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)

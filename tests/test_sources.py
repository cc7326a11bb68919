"""Workbooks in ranges of rows, and admission of files."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.parse import typed_cell
from strandline.sources import readers, workbook


def sheet_xml(p, name, rows):
    a = f"{p}:" if p else ""
    body = "".join(f"<{a}Row{at}>" + "".join(f'<{a}Cell{c}><{a}Data {a or "ss:"}Type="{k}">{v}</{a}Data></{a}Cell>' for c, k, v in cells) + f"</{a}Row>\r\n" for at, cells in rows)
    return f'<{a}Worksheet {a or "ss:"}Name="{name}"><{a}Table><{a}Column/>{body}</{a}Table></{a}Worksheet>'


@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1", "utf-16"])
@pytest.mark.parametrize("prefix", ["ss", "x", ""])
def test_ranges_of_two_sheets_are_the_whole_workbook(tmp_path, prefix, encoding):
    r = random.Random(5)
    sheets, want = [], {}
    for name in ("Holdings é", "Other"):
        rows, number, expected = [], 0, []
        for k in range(57):
            at = ""
            if k and r.random() < 0.2:
                number += r.randrange(1, 4)
                at = f' {prefix or "ss"}:Index="{number + 1}"'
            cells, column, dense, kinds = [], 0, [], []
            for j in range(r.randrange(0, 5)):
                place = ""
                if r.random() < 0.3:
                    column += r.randrange(1, 3)
                    place += f' {prefix or "ss"}:Index="{column + 1}"'
                merge = r.choice((0, 0, 2))
                place += f' {prefix or "ss"}:MergeAcross="{merge}"' if merge else ""
                kind, value, text = r.choice((("Number", "1.5", "1.5"), ("String", "a &amp; b é", "a & b é"), ("String", "<![CDATA[<x> &amp;]]>", "<x> &amp;"), ("String", "", "")))
                cells.append((place, kind, value))
                for column_of in (dense, kinds):
                    column_of.extend([None] * (column + 1 + merge - len(column_of)))
                dense[column], kinds[column] = text, kind
                column += 1 + merge
            rows.append((at, cells))
            expected.append((number, dense, kinds))
            number += 1
        sheets.append(sheet_xml(prefix, name, rows))
        want[name] = expected
    space = f'xmlns:{prefix}="urn:s"' if prefix else 'xmlns="urn:s" xmlns:ss="urn:s"'
    root = f"{prefix}:Workbook" if prefix else "Workbook"
    at = tmp_path / "w.xml"
    at.write_bytes(f'<?xml version="1.0" encoding="{encoding}"?>\r\n<{root} {space}>{"".join(sheets)}</{root}>'.encode(encoding))
    for size in (1, 4, 1000):
        parts = workbook.plan(str(at), size)
        assert len(parts) == 2 * -(-57 // size)
        data = at.read_bytes()
        got = [row for p in parts for row in workbook.rows_of(data[p.start : p.end], p)]
        assert {n: [row[1:] for row in got if row[0] == n] for n in want} == want


def test_workbook_is_a_source_with_types(spark, tmp_path):
    rows = [("", [("", "String", "Ticker"), ("", "String", "Weight")])] + [("" if k != 7 else ' ss:Index="20"', [("", "String", f"T{k}"), ("", "Number", str(k / 2)), ("", "Boolean", "1")]) for k in range(12)]
    at = tmp_path / "w.xml"
    at.write_text('<ss:Workbook xmlns:ss="u">' + sheet_xml("ss", "A", rows) + sheet_xml("ss", "B", rows[:2]) + "</ss:Workbook>")
    sheet = readers.workbook_rows(spark, str(at), "A", 3)
    assert sheet.rdd.getNumPartitions() == 5
    got = sorted((r.row_no, r.cells[0]) for r in sheet.collect())
    assert got == [(0, "Ticker"), *((k + 1, f"T{k}") for k in range(7)), *((k + 12, f"T{k}") for k in range(7, 12))]
    cells = sheet.filter("row_no > 0").select(typed_cell(F.get("cells", F.lit(1)), F.get("kinds", F.lit(1)))["number"].alias("n"), typed_cell(F.get("cells", F.lit(2)), F.get("kinds", F.lit(2)))["flag"].alias("f"))
    assert sorted(r.n for r in cells.collect()) == [k / 2 for k in range(12)] and cells.filter("f").count() == 12
    assert readers.sheet_records(sheet, "Ticker").count() == 12
    assert readers.workbook_rows(spark, str(at), "C").count() == 0


def test_one_verdict_a_file(spark, tmp_path):
    files = {
        "good.csv": "TradDt,X\r\n2026-01-05,1\r\n2026-01-05,2\r\n", "odd.csv": "X,TradDt\n1,5 Jan\n", "other.csv": '\ufeffTradDt,X\n2026-01-05,1\n"2026-01-06",2\n', "page.csv": "  <!DOCTYPE html>\n<html>\n",
        "empty.csv": " \n", "short.csv": "TradDt,X\n", "no.csv": "A,B\n1,2\n", "long.csv": "TradDt,X\n" + "2026-01-05,1\n" * 4000 + "soon,1\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r.file.rsplit("/", 1)[1]: (r.size, r.problems) for r in readers.admitted_files(spark, str(tmp_path), ["TradDt", "X"], "TradDt", "2026-01-05").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: len(v.encode()) for k, v in files.items()}
    assert {k: v[1] for k, v in got.items()} == {
        "good.csv": [], "odd.csv": ["date is not iso"], "other.csv": ["another date"], "page.csv": ["markup", "no column TradDt", "no column X"], "empty.csv": ["empty", "fewer than two lines", "no column TradDt", "no column X"],
        "short.csv": ["fewer than two lines"], "no.csv": ["no column TradDt", "no column X"], "long.csv": ["date is not iso"],
    }
    assert all(r.problems == [] for r in readers.admitted_files(spark, str(tmp_path / "odd.csv"), ["X"]).collect())


def test_json_documents(spark, tmp_path):
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("asOf", T.StringType()), T.StructField("rows", T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])))])
    at = tmp_path / "d.json"
    at.write_text('{\n "asOf": "2026-01-05",\n "rows": [{"k": 1, "v": 2.5},\n {"k": 2}], "more": 1\n}\n')
    doc = readers.json_document(spark, str(at), kind)
    assert [tuple(r) for r in doc.select("asOf", F.explode("rows").alias("r")).select("asOf", "r.*").collect()] == [("2026-01-05", 1, 2.5), ("2026-01-05", 2, None)]
    assert readers.json_document(spark, str(tmp_path / "no.json"), kind, required=False).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.json_document(spark, str(tmp_path / "no.json"), kind).count()

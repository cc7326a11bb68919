import csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from strandline.operators import identity, lookup, order, series
from strandline.plans import company, published, records, rules, writing
from strandline.plans.company import replayed
from strandline.sources import readers


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(n)


def test_asof_tolerance(spark):
    left = spark.createDataFrame([("a", day(7)), ("a", day(8)), ("b", day(1))], "k string, d date")
    right = spark.createDataFrame([("a", day(0), 2.0), ("b", day(2), 9.0)], "k string, d date, r double")
    got = {(r.k, r.d): r.r for r in series.asof_backward(left, right, "k", "d", "r", 7).collect()}
    assert got == {("a", day(7)): 2.0, ("a", day(8)): None, ("b", day(1)): None}


def test_rank_matches_a_plain_sort(spark):
    rows = [(k, float((k * 7) % 13) if k % 5 else None) for k in range(200)]
    got = {r.k: r["rank"] for r in order.ranked(spark.createDataFrame(rows, "k int, v double"), "v", "k").collect()}
    want = {k: i + 1 for i, (k, _) in enumerate(sorted(((k, v) for k, v in rows if v is not None), key=lambda x: (-x[1], x[0])))}
    assert got == {k: want.get(k) for k, _ in rows}


def test_upper_median(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4)], "g string, v double").withColumn("k", F.monotonically_increasing_id())
    assert order.nearest_rank(rows, ["g"], "v", 0.5, "m", "k").first().m == 3.0


def test_waterfall_is_terminal(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id int, name string")
    a = spark.createDataFrame([(1, 10)], "k int, t long")
    b = spark.createDataFrame([("x", 20), ("y", 30)], "k string, t long")
    got = {r.id: (r.target, r.method) for r in lookup.resolve(rows, [("id", "id", a), ("name", "name", b)], F.col("id") == 3).collect()}
    assert got == {1: (10, "id"), 2: (30, "name"), 3: (None, "none")}


def test_replay_detects_a_changed_rule(spark):
    rows = spark.createDataFrame([([("quarantine", True)], "stable")], "rules array<struct<rule:string,fired:boolean>>, verdict string")
    assert rules.violations(rows.withColumn("k", F.lit(1)), "k", {"replay": ~replayed().eqNullSafe(F.col("verdict"))}).count() == 1


def test_guarded_write_refuses(spark, tmp_path):
    good = spark.range(5)
    none = spark.createDataFrame([], "rule string, key string")
    path = str(tmp_path / "t")
    assert writing.guarded_write(good, path, none, counters={"even": F.count_if(F.col("id") % 2 == 0)}) == {"rows": 5, "even": 3}
    with pytest.raises(writing.Refused):
        writing.guarded_write(spark.range(2), path, none)
    with pytest.raises(writing.Refused):
        writing.guarded_write(good, path, spark.createDataFrame([("r", "1")], "rule string, key string"))
    assert published.published(spark, path).count() == 5 and published.current(spark, path).notes == {"rows": 5, "even": 3}


def test_strict_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('A,B,C\n1,"x, y",3\n1,2\n1,2,3,4\n')
    got = [tuple(r) for r in readers.strict_csv(spark, str(p), ["A", "C"]).collect()]
    assert got == [("1", "3", None), ("1", None, "short row"), ("1", "3", None)]
    with pytest.raises(ValueError):
        readers.strict_csv(spark, str(p), ["D"])


def test_workbook_gaps(spark, tmp_path):
    p = tmp_path / "w.xml"
    p.write_text(
        '<?xml version="1.0"?><ss:Workbook xmlns:ss="u"><ss:Worksheet ss:Name="Holdings"><ss:Table><ss:Row><ss:Cell><ss:Data ss:Type="String">a</ss:Data></ss:Cell>'
        '<ss:Cell ss:Index="3"><ss:Data ss:Type="Number">2</ss:Data></ss:Cell></ss:Row><ss:Row><ss:Cell ss:MergeAcross="1"><ss:Data ss:Type="String">b</ss:Data></ss:Cell>'
        '<ss:Cell><ss:Data ss:Type="String">c</ss:Data></ss:Cell></ss:Row></ss:Table></ss:Worksheet></ss:Workbook>'
    )
    got = {r.row_no: r.cells for r in readers.workbook_rows(spark, str(p), "Holdings").collect()}
    assert got == {0: ["a", None, "2"], 1: ["b", None, "c"]}


def test_guarded_write_holds_floors_and_leaves_nothing_behind(spark, tmp_path):
    none = spark.createDataFrame([], "rule string, key string")
    path = str(tmp_path / "t")
    writing.guarded_write(spark.range(5), path, none, floors={"priced": (F.col("id") >= 0, 0.95)})
    with pytest.raises(writing.Refused):
        writing.guarded_write(spark.range(9), path, none, floors={"priced": (F.col("id") > 4, 0.95)})
    for n in (7, 8, 9):
        writing.guarded_write(spark.range(n), path, none)
    with pytest.raises(writing.Refused):
        writing.guarded_write(spark.range(20).filter("id < 0"), path, none, floors={"priced": (F.col("id") > 4, 0.95)})
    assert published.published(spark, path).count() == 9 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == 2


def test_a_reader_finds_a_whole_table_at_any_step_of_a_write(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "t"), []
    none = spark.createDataFrame([], "rule string, key string")
    writing.guarded_write(spark.range(5), path, none)
    read = lambda: seen.append(published.published(spark, path).count())
    for step in ("stage", "publish"):
        old = getattr(writing, step)
        monkeypatch.setattr(writing, step, lambda *a, _old=old, **k: (read(), _old(*a, **k), read())[1])
    remove = published.Files.remove
    monkeypatch.setattr(published.Files, "remove", lambda self, name: (read(), remove(self, name), read())[1])
    for n in (6, 7):
        writing.guarded_write(spark.range(n), path, none)
    assert seen == [5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 7]


def test_routed_rows_are_counted_in_the_pass_that_writes_them(spark, tmp_path):
    rows = spark.createDataFrame([(1, "kept", None), (2, "skipped", "no id"), (3, "skipped", "new"), (4, "failed", "no answer"), (5, "kept", None)], "k long, route string, reason string")
    got = writing.routed_write(rows, str(tmp_path / "r"), ["kept", "skipped", "failed"], ["no id", "no answer"])
    assert got == {"rows": 5, "route kept": 2, "route skipped": 2, "route failed": 1, "route other": 0, "reason no id": 1, "reason no answer": 1, "reason other": 1}
    back = published.published(spark, str(tmp_path / "r"))
    assert sorted(r.k for r in back.filter("route = 'skipped'").collect()) == [2, 3] and back.count() == 5


def test_workbook_rows_go_on_after_a_gap_and_become_records(spark, tmp_path):
    cell = lambda *vs: "".join(f'<ss:Cell><ss:Data ss:Type="String">{v}</ss:Data></ss:Cell>' for v in vs)
    rows = [("", cell("Fund of things")), ("", cell("Aug 17, 2026")), ("", cell("As of", "x")), (' ss:Index="6"', cell("Ticker", "Name", "Name")), ("", cell("T1", "a", "b")), ("", cell("", "")), ("", cell("T2", "c &amp; d"))]
    p = tmp_path / "w.xml"
    p.write_text('<?xml version="1.0"?><ss:Workbook xmlns:ss="u"><ss:Worksheet ss:Name="H"><ss:Table>' + "".join(f"<ss:Row{at}>{c}</ss:Row>" for at, c in rows) + "</ss:Table></ss:Worksheet></ss:Workbook>")
    sheet = readers.workbook_rows(spark, str(p), "H")
    assert sorted(r.row_no for r in sheet.collect()) == [0, 1, 2, 5, 6, 7, 8]
    assert {r.row_no: r.record for r in readers.sheet_records(sheet, "Ticker").collect()} == {6: {"Ticker": "T1", "Name": "a"}, 8: {"Ticker": "T2", "Name": "c & d"}}
    assert sorted(tuple(r)[1:] for r in readers.preamble(sheet, "Ticker").collect() if r.key) == [("As of", "x")]
    assert [r.value for r in readers.preamble(sheet, "Ticker").collect() if r.key is None] == ["Fund of things"]
    with pytest.raises(ValueError):
        readers.sheet_records(sheet, "Nothing")


def test_short_and_long_rows(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('A,B,C\n1,2,,9\n"1,5",2\n1,"x ""y"", z",3\n')
    assert [tuple(r) for r in readers.strict_csv(spark, str(p), ["A", "C"]).collect()] == [("1", None, None), ("1,5", None, "short row"), ("1", "3", None)]


def test_price_file_and_shape_guard(spark, tmp_path):
    cells = {"TradDt": "2026-08-17", "FinInstrmTp": "STK", "FinInstrmId": "500", "ISIN": "INE000000001", "TckrSymb": "T", "SctySrs": "A", "FinInstrmNm": '"A, B"', "OpnPric": "1", "HghPric": "0", "LwPric": "-1", "ClsPric": "2.5", "LastPric": "NaN", "PrvsClsgPric": '"1,000"'}
    assert list(cells) == list(readers.PRICE_COLUMNS)
    line = lambda **other: ",".join((cells | other).values())
    p = tmp_path / "p.csv"
    p.write_text("\n".join([",".join([*cells, "TtlTradgVol", "TtlNbOfTxsExctd"]), line() + ",0,7", line(FinInstrmId="") + ",3,1", "2026-08-17,STK,501,INE000000002"]) + "\n")
    nameless, row, short = sorted(readers.price_file(spark, str(p)).collect(), key=lambda r: r.scrip_code or "")
    assert (row.scrip_code, row.name, row.open, row.high, row.low, row.close, row.last, row.prev_close, row.volume, row.trades) == ("500", "A, B", 1.0, None, None, 2.5, None, 1000.0, 0.0, 7.0)
    assert nameless.reject_reason == "no scrip code" and row.reject_reason is None and (short.scrip_code, short.isin, short.close, short.reject_reason) == ("501", "INE000000002", None, None)
    p.write_text(",".join(cells) + "\n" + line() + "\n")  # neither optional column
    (bare,) = readers.price_file(spark, str(p)).collect()
    assert (bare.close, bare.volume, bare.trades, bare.trade_date) == (2.5, None, None, dt.date(2026, 8, 17))
    texts = [("D,X\n2026-01-01,1", "text/csv"), ("D,X\n1 Jan,1", "text/html; x"), ("<html>", None)]
    found = spark.createDataFrame(texts, "t string, c string").select(readers.shape_problems(F.col("t"), ["D"], F.col("c"), "D", F.lit("2026-01-01").cast("date")).alias("p")).collect()
    assert [r.p for r in found] == [[], ["html content type", "date is not iso"], ["markup", "fewer than two lines", "no column D"]]
    assert readers.json_document(spark, str(tmp_path / "no.json"), T.StructType([T.StructField("a", T.LongType())]), required=False).count() == 0
    assert spark.createDataFrame([('\ufeffa,"b, c",',)], "t string").select(readers.csv_cells(F.col("t"), 3).alias("c")).first().c == ["a", "b, c", None]


def test_export_is_one_ordered_file_with_banner_mark_and_line_ends(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(k, t, v) for k, (t, v) in enumerate([("=x", 1.5), ('a "b", c', -2.0), (None, None), ("line\nbreak", 0.0), ("₹ é", 3.0)] * 40)]
    writing.export_csv(spark.createDataFrame(rows, "k long, t string, v double").repartition(6), str(tmp_path / "e"), [["made from x", "as of y, z"], ["a note"]], [F.desc("k")], {"t": "Text, label"})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "e").glob("part-*"))
    data = b"".join(p.read_bytes() for p in parts)
    assert len(parts) > 1 and data.startswith(b'\xef\xbb\xbfmade from x,"as of y, z"\r\na note\r\n\r\nk,"Text, label",v\r\n')
    back = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
    assert back[:4] == [["made from x", "as of y, z"], ["a note"], [], ["k", "Text, label", "v"]]
    safe = lambda c: "'" + c if c[:1] in tuple("=+-@\t\r") and c else c
    assert back[4:] == [[str(k), safe(t or ""), "" if v is None else safe(str(v))] for k, t, v in reversed(rows)]


def test_ranks_and_order_statistics_of_tied_values(spark):
    rows = [(k, g, v) for k, (g, v) in enumerate([("a", 1.0)] * 40 + [("a", None)] * 3 + [("a", 5.0), ("b", 2.0), ("b", 4.0), ("b", 3.0), ("b", 9.0)])]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    want = {r[0]: i + 1 for i, r in enumerate(sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[0])))}
    got = {r.k: r.rank for r in order.ranked(df, "v", "k").collect()}
    assert {k: v for k, v in got.items() if v} == want and sum(v is None for v in got.values()) == 3
    assert {r.g: r.m for r in order.nearest_rank(df, ["g"], "v", 0.5, "m", "k").collect()} == {"a": 1.0, "b": 4.0}
    assert order.exact_median(df.filter("g = 'b'"), "v", "k", "m").first().m == 3.5
    assert order.nth_value(df, "v", "k", 2, "x").first().x == 5.0


def test_bands_float_only_from_the_least_move_on():
    known = company.bands(100.0, {"standard": 1.0, "smallcap": 0.99, "outside": float("nan")})
    assert [known[s]["applied"] for s in ("standard", "smallcap", "outside")] == [True, False, False]
    assert known["standard"]["inclusion_high"] == 101.0 and known["standard"]["raw_inclusion_high"] == 100.0


def test_cascade_reaches_no_rule_after_one_that_fires(spark):
    rows = [(1, 200.0, "outside", False), (2, None, "outside", False), (3, 70.0, "standard", False), (4, 95.0, "standard", False), (5, 60.0, "smallcap", True)]
    df = spark.createDataFrame(rows, "p_partkey long, ff double, segment string, quarantined boolean").withColumn("in_eems", F.lit(False))
    got = {r.p_partkey: (r.verdict, [x.rule for x in r.rules]) for r in company.verdicts(df).collect()}
    assert got[2] == ("unknown", ["quarantine", "no-float"]) and got[5] == ("unknown", ["quarantine"])
    assert got[1] == ("likely-inclusion", ["quarantine", "no-float", "inclusion-high"])
    assert all(company.VERDICT_OF[names[-1]] == v for v, names in got.values() if v not in ("stable",))


def test_a_long_series_is_split_by_time_and_matches_a_plain_scan(spark, monkeypatch):
    r = random.Random(3)
    left = [("hot", k * 3 + r.randrange(3), k) for k in range(600)] + [(f"c{k % 7}", r.randrange(2000), 600 + k) for k in range(60)] + [(None, 5, 900), ("hot", None, 901)]
    right = [("hot", r.randrange(1800), float(k)) for k in range(80)] + [("c1", 40, 1.0), ("c1", 40, 3.0), ("c2", 100, None), ("c3", None, 4.0), (None, 4, 8.0)]
    at = lambda n: None if n is None else day(n)
    seen = []
    keep = series.stored
    monkeypatch.setattr(series, "stored", lambda df: seen.append(keep(df)) or seen[-1])
    a = spark.createDataFrame([(k, at(d), i) for k, d, i in left], "k string, d date, i int")
    b = spark.createDataFrame([(k, at(d), v) for k, d, v in right], "k string, d date, r double")
    for by in (["k"], []):
        got = {x.i: (x.r, x.matched_on) for x in series.asof_backward(a, b, by, "d", "r", 9).collect()}
        for k, d, i in left:
            fits = [(e, v) for g, e, v in right if e is not None and d is not None and e <= d and (not by or (g == k and k is not None))]
            last = max((e for e, _ in fits), default=None)
            best = max((v for e, v in fits if e == last and v is not None), default=None)
            near = last is not None and d - last <= 9
            assert got[i] == ((best, at(last)) if near else (None, None)), (by, k, d, i)
    parts = seen[0].filter("k = 'hot'").groupBy("_part").count().collect()
    assert len(parts) > 3 and max(p["count"] for p in parts) < 300


def test_carry_forward_over_ranges(spark):
    days = [("a", day(n)) for n in range(400)] + [("b", day(n)) for n in range(3)]
    points = [("a", day(n), float(n)) for n in (5, 6, 90, 200)] + [("a", day(7), None), ("b", day(2), 1.0)]
    got = {(x.k, x.d): (x.v, x.stale_days) for x in series.carried_forward(spark.createDataFrame(days, "k string, d date"), spark.createDataFrame(points, "k string, d date, v double"), "k", "d", "v").collect()}
    for k, d in days:
        known = [(e, v) for g, e, v in points if g == k and e <= d and v is not None]
        assert got[k, d] == ((max(known)[1], (d - max(known)[0]).days) if known else (None, None))


def test_returns_over_points_back(spark):
    rows = [("a", day(n), float(n + 1)) for n in range(100)] + [("b", day(0), 4.0), ("c", day(0), 4.0), ("c", day(9), 5.0)]
    got = {x.k: x.return_pct for x in series.return_n_back(spark.createDataFrame(rows, "k string, d date, v double"), "k", "d", "v", 21).collect()}
    assert got == {"a": (100 / 79 - 1) * 100, "b": None, "c": 25.0}


def test_doubled_pins_and_prefixes_leave_one_row_a_holding(spark):
    frame = spark.createDataFrame
    holdings = frame([(1, "P", "x"), (2, "Q", "Big Co Ltd one"), (3, " ID1 ", None), (4, "77", "y"), (5, None, "z"), (6, "s.a", "w"), (7, "ZZ", "Lone Limited"), (8, "ZZ", "Twin"), (9, "Q", "other"), (10, "P2", "x"), (11, "SEED", "q")], "key int, ticker string, name string")
    master = frame([(1, "10", "ID1", "I1", "One"), (2, "20", "ID2", "I2", "The Lone Co"), (3, "30", "ID3", "I3", "Twin"), (4, "40", "ID4", "I4", "TWIN Ltd"), (5, "50", "ID1", "I5", "Later id"), (6, "60", "ID6", "I6", "Six"), (7, "61", "ID7", "I6", "Same isin")], "ord int, scrip_code string, scrip_id string, isin string, name string")
    universe = frame([(1, "SYM1", "I1", "n"), (2, "S-A", "I9", "Only here"), (3, "D1", "I2", "d"), (4, "D2", "I2", "d")], "ord int, symbol string, isin string, name string")
    seed = frame([(1, "SEED", "I6", "61", "seeded"), (2, "LATE", "I2", None, "late"), (3, "LATER", "I2", None, "later")], "ord int, symbol string, isin string, scrip_code string, name string")
    confirmed = frame([(2, "P", "20", "I2"), (1, "P", "10", "I1"), (1, "P2", "10", "wrong")], "ord int, ticker string, scrip_code string, isin string")
    blocked = frame([(2, "Q", "Big", "second"), (1, "Q", "Big Co", "first")], "ord int, ticker string, name_prefix string, reason string")
    got = {r.key: r for r in identity.resolve_holdings(holdings, master, universe, seed, confirmed, blocked).collect()}
    assert len(got) == 11 and identity.resolve_holdings(holdings, master, universe, seed, confirmed, blocked).count() == 11
    row = lambda k: (got[k].method, got[k].via, got[k].confidence, got[k].isin, got[k].symbol, got[k].symbol_source, got[k].scrip_code, got[k].scrip_id, got[k].resolved_name)
    assert row(1) == ("confirmed", "isin", "hand-checked", "I1", "SYM1", "nse-universe", "10", "ID1", "One")
    assert (got[2].method, got[2].reason) == ("none", "first") and got[9].reason == "no match" and "no longer agrees" in got[10].reason
    assert row(3) == ("scrip_id", "isin", "exact", "I1", "SYM1", "nse-universe", "10", "ID1", "One")
    assert "77 reads as a scrip code" in got[4].reason and got[5].reason == "no ticker"
    assert row(6) == ("isin", "nse-universe", "exact", "I9", "S-A", "nse-universe", None, None, "Only here")
    # two universe rows have the ISIN, so the first seed row names the symbol
    assert row(7) == ("name", "isin", "normalised-name", "I2", "LATE", "seed", "20", "ID2", "The Lone Co")
    assert got[8].reason == "the name matches 2 scrips"
    assert row(11) == ("isin", "seed", "exact", "I6", "SEED", "seed", "61", "ID7", "Same isin")


def test_sides_by_the_first_key_a_row_has(spark):
    rows = spark.createDataFrame([(1, "c1", "i1"), (2, None, "i2"), (3, "gone", "i2"), (4, None, None)], "k int, code string, isin string")
    side = spark.createDataFrame([(2, "c1", "i9", "later"), (1, "c1", "i2", "first"), (3, "c3", None, "third")], "ord int, code string, isin string, v string")
    got = {r.k: r.s.v if r.s else None for r in records.with_side(rows, side, [("code", "code"), ("isin", "isin")], "ord", "s").collect()}
    assert got == {1: "first", 2: "first", 3: None, 4: None}


def test_slots_keep_not_held_apart_from_zero(spark):
    rows = [(3, "a", "I", None, "late", 3.0, 1.0, 1.0), (1, "b", "I", None, "first", 0.0, 0.0, 0.0), (5, "a", "I", None, "x", 5.0, 2.0, 2.0), (2, "a", None, "7", "by code", 1.0, 1.0, 1.0), (9, "a", None, None, "nothing", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ord int, fund string, isin string, scrip_code string, name string, weight_pct double, quantity double, value_usd double")
    got = {r.key: (r.name, r.a, r.b, r.c, r.n_holdings) for r in records.company_slots(df.repartition(3), ("a", "b", "c"), ["name"]).collect()}
    assert got == {"I": ("first", (5.0, 2.0, 2.0), (0.0, 0.0, 0.0), None, 3), "bse:7": ("by code", (1.0, 1.0, 1.0), None, None, 1)}

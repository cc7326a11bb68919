import datetime as dt

from pyspark.sql import functions as F

from strandline.functions import format as fmt
from strandline.functions import parse, scalar


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_grouped_number(spark):
    rows = spark.createDataFrame([("8,71,532.61",), ("1,2,3,4",), ("1,234,567",), ("-",), (None,), ("12",), ("1,23",)], "x string")
    got = [r[0] for r in rows.select(parse.grouped_number(F.col("x"))).collect()]
    assert got == [871532.61, None, 1234567.0, None, None, 12.0, 123.0]


def test_zero_is_a_count_but_no_price(spark):
    rows = spark.createDataFrame([("0",), ("--",), ("1,000",)], "x string")
    got = [tuple(r) for r in rows.select(parse.count_value(F.col("x")), parse.price(F.col("x"))).collect()]
    assert got == [(0.0, None), (None, None), (1000.0, 1000.0)]


def test_feed_dates(spark):
    rows = spark.createDataFrame([("2026-08-19",), ("19-Aug-2026 09:07:24",), ("19 Aug 26 | 16:01",), ("19-AUG-2026",), ("19  aug 26|16:01",), ("2026-08-19T09:07:24.000Z",), ("2026-08-19T09:07:24Z",), ("2026-08-19T09:07:24.123456+00:00",), ("2026-08-19T22:07:24-03:00",), ("Aug 17, 2026",), ("soon",), ("2026-08-19Tx",), ("32-Aug-2026",), ("",), (None,)], "x string")
    got = [r[0] for r in rows.select(parse.feed_date(F.col("x"))).collect()]
    assert got == [dt.date(2026, 8, 19)] * 8 + [dt.date(2026, 8, 20), dt.date(2026, 8, 17)] + [None] * 5
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert [r[0] for r in rows.select(parse.feed_date(F.col("x"))).collect()] == got
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_key_values_keep_commas_and_last_key(spark):
    got = one(spark, parse.key_values(F.col("x")), x="Company Name=K, Hospital Ltd,52-Week Range=1 - 2,A=1,A=2")
    assert got == {"Company Name": "K, Hospital Ltd", "52-Week Range": "1 - 2", "A": "2"}
    got = one(spark, parse.key_values(F.col("x")), x="lost, too,Yearly Change (%)=-3.5, 10-Day Average Volume=1,234,5=6,a_b=7,-c=8,P/E.x=9=10,")
    assert got == {"Yearly Change (%)": "-3.5", "10-Day Average Volume": "1,234,5=6,a_b=7,-c=8", "P/E.x": "9=10,"}
    assert one(spark, parse.key_values(F.col("x")), x="none at all") == {}


def test_rounding_is_half_up(spark):
    assert one(spark, scalar.rounded(F.col("x")), x=-2.5) == -2.0
    assert one(spark, scalar.rounded(F.col("x"), 2), x=1.005) == 1.0


def test_reviews(spark):
    assert one(spark, scalar.next_review(F.col("x")), x=dt.date(2026, 2, 27)) == dt.date(2026, 5, 29)
    assert one(spark, scalar.last_business_day(F.col("x")), x=dt.date(2026, 5, 3)) == dt.date(2026, 5, 29)


def test_volume_unknown_is_not_zero_days(spark):
    rows = spark.createDataFrame([(10.0, None), (10.0, 0.0), (-10.0, 4.0)], "s double, v double")
    assert [r[0] for r in rows.select(scalar.days_of_volume(F.col("s"), F.col("v"))).collect()] == [None, None, 2.5]


def test_texts_of_numbers_and_dates(spark):
    rows = [(0.0,), (0.0004,), (-0.0004,), (0.0005,), (12.3456,), (-1234567.5,), (None,), (float("nan"),)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "v double").select(fmt.percent(F.col("v")), fmt.signed_percent(F.col("v")), fmt.points(F.col("v")), fmt.count_text(F.col("v")), fmt.grouped(F.col("v"), 1)).collect()]
    assert got[0] == ("0.000%", "0.00%", "0.00 pp", "0", "0.0")
    assert got[1][:4] == ("<0.001%", "<0.01%", "<0.01 pp", "<1") and got[2][:4] == (">-0.001%", ">-0.01%", ">-0.01 pp", ">-1")
    assert got[3][0] == "0.001%" and got[4][:3] == ("12.346%", "+12.35%", "+12.35 pp") and got[5][3:] == ("-12,34,567", "-12,34,567.5")
    assert got[6] == got[7] == ("—",) * 5
    ages = spark.createDataFrame([(-5,), (44,), (59,), (60,), (7200,), (86400 * 3,), (86400 * 800,)], "s long").select(fmt.relative_time(F.col("s")).alias("r"), fmt.tick_age(F.col("s")).alias("t")).collect()
    assert [r.r for r in ages] == ["just now", "just now", "59 seconds ago", "1 minute ago", "2 hours ago", "3 days ago", "2 years ago"] and [r.t for r in ages][:4] == ["0s ago", "44s ago", "59s ago", "1m ago"]
    money = spark.createDataFrame([(0.0,), (50000.0,), (1.234e9,), (5e8,), (-2.5e7,)], "v double").select(fmt.flow_text(F.col("v")).alias("f"), fmt.rupees(F.col("v"), 1).alias("r")).collect()
    assert [r.f for r in money] == ["₹0 Cr", "<₹0.01 Cr", "₹123 Cr", "₹50.0 Cr", "₹2.50 Cr"] and money[2].r == "₹123.4 Cr"


def test_quote_fields_and_typed_cells(spark):
    raw = "Company Name=Kovai Medical Center, Hospital Ltd,Day Range=1 - 2,52-Week Range=N/A,Last Split Date=1730073600,Opening Price=Infinity,Last Volume=1,200,3-Month Average Volume=nan,Yearly Change (%)=-2.5,Symbol=None,Exchange=NSI,Current Price=3,5=6"
    q = spark.createDataFrame([(raw,)], "raw string").withColumn("kv", parse.key_values(F.col("raw"))).select(parse.quote_record(F.col("kv"), F.col("raw"), F.lit(9.5)).alias("q"), "kv").first()
    assert q.q.name == "Kovai Medical Center, Hospital Ltd" and q.q.day_range.hi == 2.0 and tuple(q.q.year_range) == (None, None) and (q.q.volume, q.q.volume_3m, q.q.year_change_pct, q.q.symbol) == (1200.0, None, -2.5, None) and str(q.q.split_date) == "2024-10-28" and q.q.open is None and q.q.price == 9.5
    assert q.kv["Current Price"] == "3,5=6"
    cells = spark.createDataFrame([("", "Number"), ("1,2", "Number"), ("TRUE", "Boolean"), ("x", "String")], "v string, k string").select(parse.typed_cell(F.col("v"), F.col("k")).alias("c")).collect()
    assert [tuple(r.c) for r in cells] == [(None, None, None), (12.0, None, None), (None, True, None), (None, None, "x")]
    texts = spark.createDataFrame([("8,71,532.61",), ("1,2,3,4",), ("5d",), ("NaN",), ("-7",)], "t string")
    assert [tuple(r) for r in texts.select(parse.reading(F.col("t")), parse.crore_to_rupees(F.col("t"))).collect()][0] == (871532.61, 8715326100000)
    assert [r[0] for r in texts.select(parse.price(F.col("t"))).collect()] == [871532.61, 1234.0, None, None, None]


def test_hashes_and_sets(spark):
    got = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(scalar.fnv1a(F.col("t"))).collect()
    assert [r[0] for r in got] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    assert spark.createDataFrame([([" b", "A", "a", ""],)], "s array<string>").select(scalar.canonical_set(F.col("s"))).first()[0] == "A,B"


def test_quote_ranges_keep_the_half_that_is_a_number(spark):
    rows = spark.createDataFrame([("1303.5 - 1321.6",), ("1-2",), ("x - 5",), ("1 - 2 - 3",), ("--",), (None,), ("7",)], "t string")
    assert [tuple(r[0]) for r in rows.select(parse.quote_range(F.col("t"))).collect()] == [(1303.5, 1321.6), (1.0, 2.0), (None, 5.0)] + [(None, None)] * 4


def test_the_envelope_price_counts_where_it_is_finite(spark):
    rows = spark.createDataFrame([(0.0,), (float("nan"),), (None,), (4.0,)], "e double").withColumn("kv", parse.key_values(F.lit("Current Price=3")))
    assert [r[0] for r in rows.select(parse.quote_record(F.col("kv"), F.lit("x"), F.col("e"))["price"]).collect()] == [0.0, 3.0, 3.0, 4.0]


def test_sessions_of_two_markets(spark):
    times = ["2026-01-05 03:45:00", "2026-01-05 03:44:59", "2026-01-05 10:00:59", "2026-01-05 14:30:00", "2026-07-06 13:30:00", "2026-01-05 13:30:00", "2026-01-05 21:00:30", "2026-01-03 15:00:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").withColumn("t", F.col("t").cast("timestamp"))
    got = [tuple(r) for r in rows.select(scalar.in_market_hours(F.col("t"), "india"), scalar.in_market_hours(F.col("t"), "usa")).collect()]
    assert got == [(True, False), (False, False), (True, False), (False, True), (False, True), (False, False), (False, True), (False, False)]


def test_texts_of_day_changes_factors_and_plurals(spark):
    rows = spark.createDataFrame([(1.234,), (-0.001,), (0.0,), (None,)], "v double")
    assert [tuple(r) for r in rows.select(fmt.day_change_text(F.col("v")), fmt.factor_percent(F.col("v"))).collect()] == [("+1.23%", "123.40%"), ("-0.00%", "-0.10%"), ("0.00%", "0.00%"), ("—", "—")]
    assert [r[0] for r in spark.createDataFrame([(1,), (2,), (0,)], "n int").select(fmt.plural(F.col("n"), "row")).collect()] == ["row", "rows", "rows"]

"""Lenient parsers as column functions: what does not match whole is null, never a guess, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of numbers in the feeds.
GROUPED = r"^-?\d{1,3}(,\d{2,3})*(\.\d+)?$"
PLAIN = r"^-?\d+(\.\d+)?$"
#: Shapes of dates in the feeds.
DATES = ("yyyy-MM-dd", "d-MMM-yyyy[ HH:mm:ss]", "d MMM yy '|' HH:mm", "MMM d, yyyy")
INSTANT = "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS][XXX]"


def grouped_number(c: Column) -> Column:
    """Number with groups of two or three digits, the whole string or null."""
    t = F.trim(c)
    return F.when(t.rlike(GROUPED) | t.rlike(PLAIN), F.replace(t, F.lit(","), F.lit("")).try_cast("double"))


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(c: Column) -> Column:
    """The whole text as a number once commas are gone; words such as NaN and Infinity and suffixes are none."""
    t = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def positive(c: Column) -> Column:
    """``c`` where it is a finite number above zero, else null."""
    return F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c)


def price(c: Column) -> Column:
    return positive(_number(c))


def count_value(c: Column) -> Column:
    """Count of zero or more; zero is a reading."""
    n = _number(c)
    return F.when(n >= 0, n)


def declared_number(c: Column) -> Column:
    """Number of a declared numeric cell; blanks and dashes are null."""
    return F.when(~F.trim(c).isin("", "-", "--"), _number(c))


def reading(c: Column) -> Column:
    """Number or grouped text above zero."""
    return positive(F.coalesce(_number(c), grouped_number(c)))


def typed_cell(value: Column, kind: Column) -> Column:
    """(number, flag, text) of a workbook cell by its declared type; an empty number is null."""
    v = F.trim(value)
    return F.struct(F.when(kind == "Number", _number(v)).alias("number"), F.when(kind == "Boolean", F.lower(v).isin("1", "true")).alias("flag"), F.when(~F.coalesce(kind, F.lit("")).isin("Number", "Boolean"), value).alias("text"))


def csv_text(c: Column) -> Column:
    """Trimmed text, null where it is a mark for nothing."""
    t = F.trim(c)
    return F.when(~F.upper(t).isin("", "-", "--", "NA", "N/A"), t)


#: What quotes write where they have nothing.
MISSING = ("", "N/A", "NA", "None", "null", "nan", "-", "--", "Infinity")


def quote_text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin(*MISSING), t)


def quote_number(c: Column) -> Column:
    return _number(quote_text(c))


def quote_range(c: Column) -> Column:
    """`lo - hi` to {lo, hi}; a half that is no number is null, and both are where there are not two halves."""
    halves = F.split(quote_text(c), r"\s*-\s*")
    half = lambda i: F.when(F.size(halves) == 2, _number(F.get(halves, F.lit(i))))
    return F.struct(half(0).alias("lo"), half(1).alias("hi"))


def quote_date(c: Column) -> Column:
    """Date of epoch seconds of 9 to 11 digits, or of a date text."""
    t = quote_text(c)
    return F.when(t.rlike(r"^\d{9,11}$"), F.timestamp_seconds(t.try_cast("long")).cast("date")).otherwise(feed_date(t))


#: Fields of a quote that are numbers, by the labels of the text.
QUOTE_NUMBERS = {
    "prev_close": "Previous Close", "open": "Opening Price", "market_cap": "Market Cap", "volume": "Last Volume", "volume_10d": "10-Day Average Volume", "volume_3m": "3-Month Average Volume",
    "average_50d": "50-Day Moving Average", "average_200d": "200-Day Moving Average", "year_change_pct": "Yearly Change (%)",
}


def quote_record(kv: Column, raw: Column, envelope_price: Column, status: Column | None = None) -> Column:
    """Fields of a `k=v` quote, ``kv`` being the column of its ``key_values``: a finite price of the envelope counts before that of the text, which is kept."""
    f = lambda name: kv[name]
    finite = F.when(~F.isnan(envelope_price) & (F.abs(envelope_price) < float("inf")), envelope_price)
    day, year = quote_range(f("Day Range")), quote_range(f("52-Week Range"))
    return F.struct(
        quote_text(f("Symbol")).alias("symbol"), quote_text(f("Company Name")).alias("name"), (F.lit(None).cast("string") if status is None else status).alias("status"), F.coalesce(finite, quote_number(f("Current Price"))).alias("price"),
        *(quote_number(f(label)).alias(name) for name, label in QUOTE_NUMBERS.items()), day.alias("day_range"), year.alias("year_range"),
        quote_text(f("Last Split Factor")).alias("split_factor"), quote_date(f("Last Split Date")).alias("split_date"), quote_text(f("Exchange")).alias("exchange"), raw.alias("raw"), F.lit("nse").alias("source"),
    )


def first_with_source(values: dict[str, Column]) -> Column:
    """First non-null value in order, and which one it is."""
    source, value = F.lit(None).cast("string"), F.coalesce(*values.values())
    for name, c in reversed(values.items()):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return F.struct(source.alias("source"), value.alias("value"))


def csv_number(c: Column) -> Column:
    """Strict decimal without grouping; dashes and N/A are null."""
    t = F.trim(c)
    return F.when(t.rlike(PLAIN), t.try_cast("double"))


def crore_to_rupees(c: Column) -> Column:
    return F.floor(positive(grouped_number(c)) * 1e7 + 0.5)


def feed_date(c: Column) -> Column:
    """Date of the feeds' shapes, an instant's in UTC, else null."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s*\|\s*", " | "), r"\s+", " ")
    instant = F.try_to_timestamp(F.when(t.rlike("T"), t), F.lit(INSTANT))
    zoned = F.when(t.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.to_utc_timestamp(instant, F.current_timezone())).otherwise(instant)
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("date") for f in DATES), zoned.cast("date"))


LETTERS_AND_DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: What a label may hold besides letters and digits, and not begin with.
LABEL_MARKS = " ()%./-"


def _begins_pair(piece: Column) -> Column:
    """Whether a piece between commas begins with a label and an equals sign; a label holds a letter, and begins with a letter or a digit."""
    label = F.ltrim(F.substring_index(piece, "=", 1))
    fit = F.translate(label, LETTERS_AND_DIGITS + LABEL_MARKS, "") == ""
    return (F.instr(piece, "=") > 1) & fit & (F.translate(F.left(label, F.lit(1)), LETTERS_AND_DIGITS, "") == "") & label.rlike("[A-Za-z]")


def key_values(c: Column) -> Column:
    """`k=v,k=v` to a map. Pieces between commas that begin with no label belong to the value before them, and what stands before the first label to none; the last of equal keys wins."""
    empty = F.array().cast("array<string>")

    def glued(done: Column, piece: Column) -> Column:
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(","), piece)))
        return F.when(_begins_pair(piece), F.concat(done, F.array(piece))).when(F.size(done) > 0, longer).otherwise(done)

    parts = F.aggregate(F.split(c, ","), empty, glued)
    keyed = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value")))
    last = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)

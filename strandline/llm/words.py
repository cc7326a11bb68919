"""Word columns in plain Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r"


def lower_ascii(text: Column) -> Column:
    """``lower``, but for the two letters that it turns into ASCII ones: texts that hold one go letter by letter.

    Fit for finding ASCII words: A-Z are lower-cased, and no other letter becomes ASCII.
    """
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.when(odd, exact).otherwise(F.lower(text))


def _pieces(text: Column) -> Column:
    """Split at single blanks, which is much cheaper than at a pattern, without the empty pieces."""
    return F.array_remove(F.split(text, " "), "")


def blank_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    text = F.coalesce(text, F.lit(""))
    for gap in BLANK[1:]:
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return _pieces(text)


def alnum_words(text: Column) -> Column:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased; none for null."""
    return _pieces(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))

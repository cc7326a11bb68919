"""A declarative screen: filters, search terms, sort and page as one frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Screen:
    """``filters`` picks one option by filter id; an unknown id or option filters nothing."""

    query: str = ""
    filters: Mapping[str, str] = field(default_factory=dict)
    sort: str = "ff"
    descending: bool = True
    limit: int | None = None
    offset: int = 0


def size_band(c: Column, edges: Sequence[float]) -> Column:
    """Half-open bands [edge, next edge); null is in none."""
    out = F.when(c < edges[0], F.lit(0))
    for k, edge in enumerate(edges):
        out = out.when(c < edges[k + 1], k + 1) if k + 1 < len(edges) else out.when(c >= edge, k + 1)
    return out


def screened(df: DataFrame, spec: Screen, options: Mapping[str, Mapping[str, Column]], hay: Sequence[str], key: str) -> DataFrame:
    """Rows that pass every chosen filter and hold every search term in one of ``hay``; nulls sort last both ways."""
    for name, option in spec.filters.items():
        if (condition := options.get(name, {}).get(option)) is not None:
            df = df.filter(condition)
    text = F.lower(F.concat_ws(" ", *hay))
    for term in spec.query.lower().split():
        df = df.filter(text.contains(term))
    by = F.col(spec.sort)
    kind = df.schema[spec.sort].dataType.simpleString()
    if kind in ("double", "float"):
        by = F.when(~F.isnan(by), by)  # not a number sorts as null does
    elif kind == "string":
        by = natural_order(by)
    df = df.orderBy(by.desc_nulls_last() if spec.descending else by.asc_nulls_last(), key)
    if spec.offset:
        df = df.offset(spec.offset)
    return df if spec.limit is None else df.limit(spec.limit)


def watched(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a watchlist."""
    return df.join(keys.select(key), key, "left_semi")


def ordinal(c: Column, listed: Sequence[str]) -> Column:
    """Place in a list of priorities; what is not listed comes last."""
    at = F.array_position(F.array(*map(F.lit, listed)), c)
    return F.when(at > 0, at).otherwise(len(listed) + 1)


#: Fixed value: the order of texts by base letters, blind to case and accents.
COLLATION = "UNICODE_CI_AI"
#: Places for the number of digits, which come before the digits themselves.
LENGTH_PLACES = 6


def natural_order(c: Column) -> Column:
    """Key of a text order that is blind to case and accents and takes runs of digits as numbers, however long.

    A run is its digits without leading zeros behind their number, so a longer one is larger and nothing is cut; the letters
    between are compared by the engine's collation.
    """
    pieces = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def coded(piece: Column) -> Column:
        digits = F.regexp_replace(piece, "^0+(?=.)", "")
        return F.when(piece.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), LENGTH_PLACES, "0"), digits)).otherwise(piece)

    return F.collate(F.array_join(F.transform(pieces, coded), ""), COLLATION)


def sort_clicked(spec: Screen, column: str, preferred: Mapping[str, str] | None = None) -> Screen:
    """The screen after a click on a column's head: the same column turns its direction, another one begins with the direction it prefers, descending if none is said."""
    if column == spec.sort:
        return replace(spec, descending=not spec.descending)
    return replace(spec, sort=column, descending=(preferred or {}).get(column, "desc") == "desc")


def listed(df: DataFrame, orders: Sequence[tuple[str, str]], key: str, limit: int | None = None) -> DataFrame:
    """Rows by several columns in turn, each (column, order): asc, desc, or abs, the largest magnitude first. Nulls come last, the key decides ties."""
    by = {"asc": lambda c: F.col(c).asc_nulls_last(), "desc": lambda c: F.col(c).desc_nulls_last(), "abs": lambda c: F.abs(c).desc_nulls_last()}
    df = df.orderBy(*(by[order](c) for c, order in orders), key)
    return df if limit is None else df.limit(limit)


def unlike_intersection(df: DataFrame, filters: Sequence[Column], key: str) -> DataFrame:
    """Keys for which all filters at once and the intersection of each filter's own result disagree; none should."""
    together, apart = df, None
    for f in filters:
        together = together.filter(f)
        own = df.filter(f).select(key)
        apart = own if apart is None else apart.intersect(own)
    both = together.select(key).distinct()
    return both.exceptAll(apart).unionByName(apart.exceptAll(both))

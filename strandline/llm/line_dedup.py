"""Lines that many documents share leave all of them but one.

Lines are exploded with their places and normalised to a 128-bit digest. Documents are counted by
digest with partial aggregates; a digest over the threshold meets the places of its line again in a join
that Spark splits where a line is hot, and each document gets back the places to leave out. Texts
move once, for the reassembly, and never by a line's digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import settle
from strandline.llm.words import BLANK

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _keys(text: Column) -> Column:
    """Normalised lines: A-Z lower-cased, ASCII white space stripped at both ends."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(F.split(low, "\n"), lambda line: F.btrim(line, F.lit(BLANK)))


def shared_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(line, keeper) of every ``line`` of ``lines`` (line, doc_id) that ``least_docs`` documents hold; the keeper is the largest doc_id."""
    held = lines.groupBy("line").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return held.filter(F.col("n_docs") >= least_docs).select("line", "keeper")


def dedup_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    r"""(doc_id, n_lines, n_dropped, text) of every row of ``docs`` (doc_id, text): the text without shared lines.

    Lines end at ``\n``; a null or empty text is one empty line. A line's key is the line with ASCII
    white space stripped at both ends and A-Z lower-cased. A key of at least ``least_chars`` code points in
    at least ``least_docs`` documents keeps its lines, all of them, in the largest doc_id holding it and
    loses them elsewhere. Rows that share a doc_id are one document for this count and each come
    back; rows without doc_id count for no key and keep all their lines. Very long texts are split whole in
    their task. Extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("body"), text.alias("text"))
    places = rows.filter("doc_id IS NOT NULL").select("doc_id", "body", F.posexplode(_keys(F.col("text"))).alias("place", "key"))
    places = settle(places.filter(F.char_length("key") >= least_chars).select("doc_id", "body", "place", F.unhex(F.md5("key")).alias("line")))
    # both sides are tables, so that the join can split a hot line
    shared = settle(shared_lines(places, least_docs))
    gone = places.join(shared, "line").filter("doc_id <> keeper").groupBy("doc_id", "body").agg(F.collect_set("place").alias("gone"))
    split = rows.select("doc_id", "body", F.split("text", "\n").alias("lines"))
    out = split.join(settle(gone), ["doc_id", "body"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), F.array_join(kept, "\n").alias("text"))

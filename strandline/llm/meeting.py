"""Bring the texts of pairs together: each text is fetched once, compressed, and sent once for each of its pairs or of the cells that they fall in."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import drop, settle

#: Members of a hub that meet it in one run, about.
MEMBERS = 4096
#: Texts of one seat, about; a cell holds those of two.
SEATS = 256


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor()
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            *keys, texts = part.columns
            packed = [z.compress((t or "").encode()) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(packed, pa.binary())], [*part.schema.names[:-1], "packed"])


def pack(docs: DataFrame, *keys: str) -> DataFrame:
    """(``keys`` or doc_id, packed): the texts of ``docs`` compressed one by one, a null one as an empty one."""
    rows = docs.select(*(keys or ("doc_id",)), "text")
    return rows.mapInArrow(_pack, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", packed binary")


def unpack(column: pa.Array) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(p) for p in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


def meet(pairs: DataFrame, docs: DataFrame, extra: str) -> DataFrame:
    """Rows (hub, part, doc_id, ``extra``, packed) for the distinct ``pairs`` (a, b, ``extra``), b < a.

    A partition holds all rows of a (hub, part), in the order of doc_id: the hub b, whose ``extra`` is null, and
    then members a. A hub of many members has several parts and comes with each.
    """
    # large hubs alone are joined, so that small ones need no place of their own beside the rows of a large one
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).alias("parts")).filter("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("a"), "parts"), F.lit(0).cast("long"))
    members = pairs.join(parts, "b", "left").select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), part.alias("part"), extra)
    members = settle(members)
    hubs = members.select(F.col("hub").alias("doc_id"), "hub", "part").distinct()
    runs = members.unionByName(hubs, allowMissingColumns=True)
    # the same join at every size: a third of all documents may have a partner
    runs = runs.join(pack(docs.filter("doc_id IS NOT NULL")).hint("merge"), "doc_id").select("hub", "part", "doc_id", extra, "packed")
    return runs.repartition("hub", "part").sortWithinPartitions("hub", "part", "doc_id", "packed")


def meet_in_cells(pairs: DataFrame, docs: DataFrame, extra: str) -> DataFrame:
    """Rows (u, v, other_id, doc_id, ``extra``, packed) for the distinct ``pairs`` (a, b, ``extra``), b < a.

    Texts with the same smallest partner have a seat, or several that hold ``SEATS`` texts each, and the pairs of two seats a cell (u, v), so a
    text is sent once for a cell whatever the number of its pairs there. A partition holds all rows of a cell: first its texts, whose
    other_id is null, in the order of doc_id, and then its pairs (doc_id a, other_id b), which have no text, in the order of b and a.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    least = settle(both.groupBy("x").agg(F.least("x", F.min("y")).alias("least")))
    sizes = least.groupBy("least").agg(F.ceil(F.count("*") / SEATS).alias("parts")).filter("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("x"), "parts"), F.lit(0).cast("long"))
    seats = settle(least.join(sizes, "least", "left").select("x", F.xxhash64("least", part).alias("seat")))
    own, other = (seats.select(F.col("x").alias(c), F.col("seat").alias(f"seat_{c}")) for c in ("a", "b"))
    seated = pairs.join(own, "a").join(other, "b")
    seated = settle(seated.select(F.least("seat_a", "seat_b").alias("u"), F.greatest("seat_a", "seat_b").alias("v"), F.col("b").alias("other_id"), F.col("a").alias("doc_id"), extra))
    drop(least, seats)
    needed = seated.select("u", "v", "doc_id").unionByName(seated.select("u", "v", F.col("other_id").alias("doc_id"))).distinct()
    texts = pack(docs.filter("doc_id IS NOT NULL")).hint("merge").join(needed, "doc_id")
    rows = seated.unionByName(texts, allowMissingColumns=True).select("u", "v", "other_id", "doc_id", extra, "packed")
    return rows.repartition("u", "v").sortWithinPartitions("u", "v", "other_id", "doc_id", "packed")

"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words; positions with 0 are ignored, so a substituted word there
does not hide a hit. The hashes of the benchmark's masked words are joined with those of all document
positions. A hit fixes where the item would start in the document; the words along that diagonal are
then compared one by one, tolerating substitutions.

Scale. A seed row is of bounded size: beside the hash it holds the item's id, the place and the words around it, as many as an
overlap with that hit can reach. So many rows at most are broadcast (``BROADCAST_ROWS``); documents then stream through one projection and one
join, a hit is verified where it is found and nothing but verified overlaps is shuffled. With more seeds only hashes, ids and places
are joined by a shuffle, and the words of items and documents are fetched for the distinct diagonals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import settle
from strandline.llm.words import alnum_words

#: Fixed masks: 1 is compared, 0 is ignored. The first two hit every stretch of 13 words of which any two are
#: substituted; the others every item of 5 to 12 words in which as many are as ``SHARE`` allows (one, two from 10 words on).
MASKS = ("11010111", "11100001011", "10111", "1111", "11101", "11011", "1", "11", "111")
LONG_MASKS = 2
#: The last masks are for items of exactly their length, in which nothing may be substituted.
EXACT_MASKS = 3
#: Items with fewer words than this are looked up by the short masks.
LONG_ITEM = 13
SHARE = 0.8
#: Words of an item that must stand in a document, but for the substitutions.
STRETCH = 13
#: Seed rows of some 300 bytes that are broadcast at most.
BROADCAST_ROWS = 200_000
#: More seed rows are broadcast in slices of about that many, each with a pass over the documents; more slices than these are joined by a shuffle of all positions.
MOST_SLICES = 16
#: Words before and after the first word of a hit that an overlap with it can reach.
AROUND = STRETCH - 1


def _seeds(k: int, words: str = "h") -> str:
    """SQL array of the seed hashes of mask ``k`` at every position of the array ``words`` of word hashes."""
    mask = MASKS[k]
    picked = ", ".join(f"get({words}, i + {j})" if j else "x" for j, bit in enumerate(mask) if bit == "1")
    return f"transform(slice({words}, 1, greatest(size({words}) - {len(mask) - 1}, 0)), (x, i) -> xxhash64({k}, {picked}))"


def _hashed(df: DataFrame, key: str) -> DataFrame:
    df = df.select(F.col(key).cast("long").alias(key), alnum_words(F.col("text")).alias("words"))
    return df.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def _around(words: str, at: str, reach: int) -> str:
    """SQL array of the word hashes from ``reach`` words before ``at`` to as many and a mask after, null where there is none."""
    return f"transform(sequence({at} - {reach}, {at} + {reach} + {max(map(len, MASKS)) - 1}), j -> get({words}, cast(j as int)))"


def seed_table(benchmark: DataFrame, least_words: int = 1) -> DataFrame:
    """(seed, item_id, n_words, at, mask, around): each masked hash of each item, its position, and the words around it."""
    items = _hashed(benchmark.filter("item_id IS NOT NULL"), "item_id").filter(F.size("h") >= max(1, least_words)).distinct()
    exact = len(MASKS) - EXACT_MASKS
    fits = lambda k: f"size(h) >= {LONG_ITEM}" if k < LONG_MASKS else f"size(h) < {LONG_ITEM}" if k < exact else f"size(h) = {len(MASKS[k])}"
    lists = ", ".join(f"if({fits(k)}, {_seeds(k)}, array())" for k in range(len(MASKS)))
    out = items.select("item_id", F.col("h").alias("item"), F.posexplode_outer(F.expr(f"array({lists})")).alias("mask", "list"))
    out = out.select("item_id", "item", "mask", F.posexplode_outer("list").alias("at", "seed")).filter("seed IS NOT NULL")
    return out.select("seed", "item_id", F.size("item").alias("n_words"), "at", "mask", F.expr(_around("item", "at", AROUND)).alias("around"))


def _best(first: str, n: str, same: str, stretch: int) -> str:
    """SQL: the most equal words of a stretch, over the array ``same`` of 1, 0 or null (outside the item) from item word ``first`` on."""
    w = f"least({stretch}, {n})"
    sums = f"aggregate(slice({same}, s, {w}), 0, (a, x) -> a + x)"
    whole = f"({first} + s - 1 >= 0 AND {first} + s - 1 + {w} <= {n})"
    return f"coalesce(array_max(transform(sequence(1, greatest(1, size({same}) - {w} + 1)), s -> if({whole}, {sums}, 0))), 0)"


def _slices(seeds: DataFrame, n: int, most: int) -> list[DataFrame]:
    """``seeds`` in ranges of at most twice ``most`` rows; none if that takes more than ``MOST_SLICES``, or if a range is larger."""
    parts = -(-n // most) if most else MOST_SLICES + 1
    if parts > MOST_SLICES:
        return []
    rows = settle(seeds.repartitionByRange(parts, "seed", "item_id", "at").withColumn("slice", F.spark_partition_id()))
    sizes = {r["slice"]: r["count"] for r in rows.groupBy("slice").count().collect()}  # a row a slice
    if max(sizes.values()) > 2 * most:
        return []
    return [rows.filter(F.col("slice") == k).drop("slice") for k in sorted(sizes)]


def _looked_up(hits: DataFrame, seeds: DataFrame, stretch: int) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, best): every position of ``hits`` (doc_id, h, seeds) whose seed is among the broadcast ``seeds``, compared with the words around."""
    hits = hits.select("doc_id", "h", F.explode_outer("seeds").alias("list")).select("doc_id", "h", F.posexplode_outer("list").alias("pos", "seed"))
    hits = hits.join(F.broadcast(seeds.drop("mask")), "seed")
    # compared behind a generator: inside the join's condition it would take the join out of generated
    # code, and every position would be copied with all words of its document
    equal = f"transform(around, (a, i) -> if(at - {AROUND} + i < 0 OR at - {AROUND} + i >= n_words, 0, if(a = get(h, pos - {AROUND} + i), 1, 0)))"
    hits = hits.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("first_word"), "n_words", "at", F.explode_outer(F.expr(f"array({equal})")).alias("equal"))
    return hits.select("doc_id", "item_id", "first_word", "n_words", F.expr(_best(f"at - {AROUND}", "n_words", "equal", stretch)).alias("best"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, stretch: int = STRETCH, least_words: int = 1, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified overlaps: (doc_id, item_id, first_word, n_words, n_equal, similarity).

    An overlap is a diagonal, item word 0 against document word ``first_word`` (negative where the
    document begins inside the item), that holds ``stretch`` (at most ``STRETCH``) consecutive words (all of a shorter item)
    of which at least ``share`` (at least ``SHARE``) are equal. n_words is the item's length, n_equal the most equal words of such a stretch, similarity
    their share of it. Words are alphanumeric, A-Z lower-cased. Items shorter than ``least_words`` are left out. Null or empty texts, null ids and empty
    tables give no rows; a repeated
    row of either table gives no second row; the same item at several places of a document gives a
    row each. A very long text is read whole, its word hashes being held once by its task. Extra columns are ignored.
    """
    if stretch > STRETCH or share < SHARE:
        raise ValueError("the masks are not sure to find such overlaps")
    seeds = seed_table(benchmark, least_words)
    used = {r["mask"]: r["count"] for r in seeds.groupBy("mask").count().collect()}  # a row a mask
    n, masks = sum(used.values()), sorted(used)
    if not masks:
        masks = [0]
    rows = _hashed(docs.filter("doc_id IS NOT NULL"), "doc_id")
    # outer generators: from an inner one the optimizer infers a filter on the array and, moving it
    # down, would rebuild the word hashes for each element
    lists = ", ".join(_seeds(k) for k in masks)
    hits = rows.withColumn("seeds", F.expr(f"array({lists})"))
    w = f"least({stretch}, n_words)"
    keys = ["doc_id", "item_id", "first_word", "n_words"]
    slices = [seeds] if n <= broadcast_rows else _slices(seeds, n, broadcast_rows)
    if slices:
        hits = reduce(DataFrame.unionByName, (_looked_up(hits, part, stretch) for part in slices))
    else:
        hits = hits.select("doc_id", F.explode_outer("seeds").alias("list")).select("doc_id", F.posexplode_outer("list").alias("pos", "seed"))
        hits = hits.join(seeds.select("seed", "item_id", "n_words", "at").hint("merge"), "seed")
        hits = settle(hits.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("first_word"), "n_words").distinct())
        items = _hashed(benchmark.filter("item_id IS NOT NULL"), "item_id").withColumnRenamed("h", "item").distinct()
        hits = hits.join(items, "item_id").filter("size(item) = n_words").join(rows.distinct(), "doc_id")
        equal = "transform(item, (a, i) -> if(a = get(h, first_word + i), 1, 0))"
        hits = hits.select(*keys, F.explode_outer(F.expr(f"array({equal})")).alias("equal"))
        hits = hits.withColumn("best", F.expr(_best("0", "n_words", "equal", stretch)))
    hits = hits.filter(F.expr(f"best >= {share} * {w}"))
    hits = hits.groupBy(*(F.col(c).cast("long").alias(c) for c in keys)).agg(F.max("best").cast("long").alias("n_equal"))
    return hits.withColumn("similarity", F.expr(f"n_equal / {w}"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` without a verified overlap; rows without doc_id stay, of a repeated doc_id all rows go or stay.

    Null, empty and very long texts, repeated rows, empty tables and extra columns as in ``contaminated_spans``; all columns come back.
    """
    found = contaminated_spans(docs, benchmark, share).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)

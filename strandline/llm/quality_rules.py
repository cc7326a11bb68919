"""Rule features of a text, and a likelihood ratio of hashed n-grams against a trusted target.

Everything is a DataFrame expression. The n-grams are the words and the pairs of neighbouring words; they are hashed into ``BUCKETS`` counters. One
pass counts every document (partial aggregation leaves at most one row a bucket and task), one
scores every document. The weights are one row of fixed size, read as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import settle
from strandline.llm.words import blank_words

BUCKETS = 1 << 14
#: Documents below this mean log-likelihood ratio an n-gram are rejected.
THRESHOLD = -0.5
#: Weight of the raw distribution in the target's, as a share of the target's n-grams.
PRIOR = 0.01


def _hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with words, their number, the n-gram buckets."""
    docs = docs.withColumn("words", blank_words(F.col("text"))).withColumn("n_words", F.size("words"))
    pairs = "transform(slice(words, 1, greatest(n_words - 1, 0)), (w, i) -> xxhash64(w, get(words, i + 1)))"
    return docs.withColumn("buckets", F.expr(f"transform(concat(transform(words, w -> xxhash64(w)), {pairs}), h -> cast(pmod(h, {BUCKETS}) as int))"))


def ngram_weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row: ``weights``, the log ratio of each bucket's probability in the target and in all of ``docs``.

    ``target`` has the doc_ids of the trusted rows, which all count; they grow with the input, so a shuffle joins them.
    Without any target row every weight is 0. The target's multinomial is smoothed towards the raw one.
    """
    chosen = target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    chosen = chosen.withColumn("chosen", F.lit(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.hint("merge"), "doc_id", "left")
    counts = _hashed(rows).select("chosen", F.explode_outer("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("chosen").alias("trusted"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "trusted"])
    listed = every.groupBy().agg(F.sum("raw").alias("n_raw"), F.sum("trusted").alias("n_trusted"), F.array_sort(F.collect_list(F.struct("bucket", "raw", "trusted"))).alias("c"))
    weight = (
        f"transform(c, x -> if(n_trusted = 0 OR x.raw = 0, 0D, ln((x.trusted + {PRIOR}D * n_trusted * x.raw / n_raw) / ((1 + {PRIOR}D) * n_trusted) / (x.raw / n_raw))))"
    )
    return listed.select(F.expr(weight).alias("weights"))


def with_rules(docs: DataFrame) -> DataFrame:
    """Adds word_chars, n_symbols, n_dup_lines, n_repeat_words to a frame with text, words and n_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    docs = docs.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    docs = docs.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    docs = docs.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # Equal 3-word windows: the hash of each has its lowest bits replaced by the window's position, so
    # that one sort of longs brings equal windows together and still tells where they stand.
    docs = docs.withColumn("bits", F.expr("cast(ceil(log2(n_words + 2)) as int)"))
    docs = docs.withColumn("whole", F.expr("transform(words, w -> xxhash64(w))"))
    window = "shiftleft(shiftright(xxhash64(h, get(whole, i + 1), get(whole, i + 2)), bits), bits) | i"
    docs = docs.withColumn("ordered", F.expr(f"sort_array(transform(slice(whole, 1, greatest(n_words - 2, 0)), (h, i) -> {window}))"))
    # one xor with each neighbour tells whether all but the position bits are equal
    alike = " OR ".join(f"shiftright(x ^ get(ordered, i {side}), bits) = 0" for side in ("- 1", "+ 1"))
    docs = docs.withColumn("repeats", F.expr(f"sort_array(transform(filter(ordered, (x, i) -> {alike}), x -> x & (shiftleft(1L, bits) - 1)))"))
    # windows that are equal in those bits and not in the others: then all are compared by their whole hashes
    full = "xxhash64(get(whole, cast(x & mask as int)), get(whole, cast(x & mask as int) + 1), get(whole, cast(x & mask as int) + 2))"
    docs = docs.withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    after = "get(ordered, i + 1)"
    docs = docs.withColumn("mixed", F.expr(f"exists(transform(ordered, (x, i) -> coalesce(shiftright(x ^ {after}, bits) = 0 AND {full} <> {full.replace('x & mask', after + ' & mask')}, false)), x -> x)"))
    pairs = "array_sort(transform(slice(whole, 1, greatest(n_words - 2, 0)), (h, i) -> struct(xxhash64(h, get(whole, i + 1), get(whole, i + 2)) AS f, cast(i as long) AS i)))"
    docs = docs.withColumn("pairs", F.expr(f"if(mixed, {pairs}, NULL)"))
    exact = "sort_array(transform(filter(pairs, (x, i) -> x.f = get(pairs, i - 1).f OR x.f = get(pairs, i + 1).f), x -> x.i))"
    docs = docs.withColumn("repeats", F.expr(f"if(mixed, {exact}, repeats)"))
    covered = "aggregate(zip_with(repeats, slice(repeats, 2, size(repeats)), (p, q) -> least(3L, coalesce(q - p, 3L))), 0L, (a, x) -> a + x)"
    docs = docs.withColumn("n_repeat_words", F.expr(covered))
    return docs.drop("lines", "bits", "whole", "ordered", "repeats", "mask", "mixed", "pairs")


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def judged(docs: DataFrame, target: DataFrame, threshold: float, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``docs`` (doc_id, text and any others) with those of ``RULES``; see ``quality_rules``."""
    weights = ngram_weights(docs, target)
    own = docs.select(F.struct(*names).alias("own"), "text")
    rows = with_rules(_hashed(own).withColumn("weights", weights.scalar()))
    rows = rows.withColumn("llr", F.expr("if(n_words = 0, 0D, aggregate(buckets, 0D, (a, b) -> a + weights[b]) / greatest(size(buckets), 1))"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select(
        "own.*", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr",
    )
    # written: a filter on the verdict would otherwise be moved below the arrays and rebuild them for each element
    return settle(rows)


def quality_rules(docs: DataFrame, target: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rule counts, llr and verdict of every row of ``docs`` (doc_id, text).

    ``base_failed``: n_words < 50, or 100 * n_repeat_words > 50 * n_words. ``kept``: not base_failed
    and llr, the mean log ratio an n-gram, at least ``threshold``. A null or blank text has no words:
    zeros, llr 0, base_failed. Repeated rows are counted and returned as often as they come; rows without doc_id are
    judged and are in no target; extra columns are ignored; an empty table gives no rows. Very long texts are counted whole: a
    text's arrays take some 60 bytes a word in its task. Windows are compared by 64-bit hashes of their words.
    """
    return judged(docs, target, threshold, ["doc_id"]).select("doc_id", *RULES)


def drop_rejected(docs: DataFrame, target: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, each judged by itself; columns named like a rule are not for this."""
    return judged(docs, target, threshold, [c for c in docs.columns if c not in RULES]).filter("kept").select(docs.columns)

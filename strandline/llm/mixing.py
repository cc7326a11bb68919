"""Mixing sources to target weights by subset sums over document lengths.

Documents are counted by (source, exact length); that table, not the documents, is what a budget is
fitted on: whole repeats of a source first, then an equal share of every length, then the rest by a
bounded-knapsack table over the lengths still available. Seeded documents fill the count of each
length. Only ids and lengths are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import settle
from strandline.llm.words import blank_words

MOST_REPEATS = 3
MIXED = ("size", "source_size", "target", "taken")
#: Parts of the seeded order of a (source, length), so that many documents of one length are not in one task.
PARTS = 64


def targets(sizes: list[int], weights: Sequence[float] = (1, 2, 3), most: int = MOST_REPEATS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, repeating; what exceeds ``most`` times a size is shared again."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        total = sum(weight[i] for i in open_)
        full = [i for i in open_ if rest * weight[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * weight[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def subset_counts(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the words sum to ``budget`` or, failing that, to the most below it.

    An equal share of every length leaves a rest of some documents a length; whole documents,
    longest first, cut that to about eight times the longest; a bounded-knapsack table of reachable sums,
    places it. The table is that long whatever the budget: four bytes for each word of eight longest documents.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    longest = lengths[order[0]]
    spare = 8 * longest
    taken = [c * max(0, budget - spare) // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    for i in order:
        more = min(counts[i] - taken[i], max(0, rest - spare) // lengths[i]) if lengths[i] else 0
        taken[i] += more
        rest -= more * lengths[i]
    # for every sum the step that first reached it: what it takes to walk back, whatever the number of steps
    first = np.full(rest + 1, -1, np.int32)
    first[0] = 0
    steps: list[tuple[int, int]] = [(-1, 0)]
    for i in order:
        free, part = counts[i] - taken[i] if 0 < lengths[i] <= rest else 0, 1
        free = min(free, rest // lengths[i]) if free else 0
        while free > 0 and first[rest] < 0:
            take = min(part, free)
            words = take * lengths[i]
            new = np.flatnonzero((first[:-words] >= 0) & (first[words:] < 0)) + words
            first[new] = len(steps)
            steps.append((i, take))
            free, part = free - take, part * 2
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, take = steps[first[at]]
        taken[i] += take
        at -= take * lengths[i]
    return taken


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per source: whole repeats, and the documents of each length that one more repeat takes."""
    pdf = pdf.sort_values("size")
    size, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
    repeats = min(MOST_REPEATS, int(target // size)) if size else 0
    more = subset_counts(pdf["size"].tolist(), pdf["n"].tolist(), round(target) - repeats * size) if repeats < MOST_REPEATS else [0] * len(pdf)
    return pd.DataFrame({"key": pdf.key, "size": pdf["size"], "repeats": repeats, "more": more})


def mix(docs: DataFrame, seed: int = 7, weights: Sequence[float] = (1, 2, 3), keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    size: runs of characters other than ASCII white space. Sources, ordered by code point with null
    last, weigh ``weights`` in turn and share the sum of all sizes; none gets more than three times
    its size while others can still take the excess. taken: size times the repeats of the document, at most
    three. Sources without words have target 0. Ties in the seeded order are broken by doc_id; rows
    equal in both are interchangeable. A null or blank text has size 0. Extra columns are ignored; an
    empty table gives no rows. Very long texts are split in their task. ``keep`` names short columns to return too. The number of sources is taken as small (one row each reaches the driver).
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~")).alias("key")
    seeded = F.xxhash64(F.lit(seed), "doc_id")
    # the texts are split once
    sized = docs.select("doc_id", *(F.col(c).cast("string").alias(c) for c in keep), F.size(blank_words(F.col("text"))).cast("long").alias("size"), key)
    sized = settle(sized.withColumn("h", seeded).withColumn("part", F.shiftright("h", 58).cast("int")))
    parts = sized.groupBy("key", "size", "part").agg(F.count("*").alias("n"))
    lengths = parts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    per_source = lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rows = sorted(((r["key"], r["source_size"]) for r in per_source.collect()), key=lambda r: r[0])
    goal = targets([n for _, n in rows], weights)
    plan = docs.sparkSession.createDataFrame([(k, n, t) for (k, n), t in zip(rows, goal, strict=True)], "key string, source_size long, target double")
    plan = F.broadcast(plan)  # one row a source, as collected above
    fitted = lengths.join(plan, "key").groupBy("key").applyInPandas(_fit, "key string, size long, repeats long, more long")
    # the seeded order of a length goes through its parts, 64 at most, one by one; only within a part are rows put in order
    ahead = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(fitted, ["key", "size"]).drop("n")
    own = Window.partitionBy("key", "size", "part").orderBy("h", "doc_id")
    out = sized.withColumn("place", F.row_number().over(own)).join(parts, ["key", "size", "part"], "left").join(plan, "key")
    taken = F.col("size") * (F.col("repeats") + (F.col("ahead") + F.col("place") <= F.col("more")).cast("long"))
    return out.select("doc_id", *keep, "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, seed: int = 7, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """``docs`` with the columns ``taken``, ``size``, ``source_size`` and ``target`` of ``mix``, found by doc_id, source and size.

    Rows equal in these three are numbered on both sides and each gets one of their takings. Columns of these names give way.
    """
    names = [c for c in docs.columns if c not in MIXED]
    rows = docs.select(*names, F.size(blank_words(F.col("text"))).cast("long").alias("size"), F.col("source").cast("string").alias("_source"))
    plan = mix(docs, seed, weights, ("source",)).withColumnRenamed("source", "_source")
    same = Window.partitionBy("doc_id", "_source", "size")
    rows = rows.withColumn("_n", F.row_number().over(same.orderBy(F.xxhash64("text"))))
    plan = plan.withColumn("_n", F.row_number().over(same.orderBy(F.desc("taken"))))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "_source", "size", "_n")]
    out = rows.alias("r").join(plan.alias("p"), on)
    return out.select(*(F.col(f"r.{c}") for c in names), *(F.col(f"p.{c}") for c in MIXED))

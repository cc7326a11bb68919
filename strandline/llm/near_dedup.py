"""Near-duplicate documents by HyperMinHash.

Each distinct shingle has one 52-bit hash. Its top 8 bits choose one of 256 buckets; of the smallest
rest in a bucket a 16-bit register keeps the count of leading zeros and 10 mantissa bits. Empty
registers are filled from others for the bands, of which there are 64 of eight registers each.
Documents that share a band are candidates; the collision-corrected estimate from the unfilled registers drops
those that are far below the threshold (five deviations), and the full shingle sets decide about the rest.

Scale. Equal sets collapse to one class first, with partial aggregation, so a group of exact copies of
any size is one row from there on. Within a band every class is compared with the smallest one, its hub (a
star, linear in the band). The texts are fetched once, compressed, and meet their hub in runs of bounded
size, so no hub is too large for a task. What that leaves apart is compared by what sets it off from the other members of the
hub (``apart_pairs``), so texts that only resemble a large group are not compared with all of it.
A pair of similarity 0.85 is missed with odds of about 1e-9, one of 0.8 of about 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import kernels as K
from strandline.llm.meeting import meet, unpack
from strandline.llm.shared import components, is_empty, settle

HASH_BITS, BUCKET_BITS, MANTISSA, BAND = 52, 8, 10, 8
BUCKETS = 1 << BUCKET_BITS
U = np.uint64


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct (row << 52 | hash) of the word k-shingles of each row; a shorter row is one shingle."""
    low = K.LOWER[data]
    starts, ends, first = K.tokens(low, off, ~K.SPACE[low])
    h = K.span(K.prefix(low), starts, ends)
    n = np.diff(first)
    row_of = np.repeat(np.arange(len(n)), n)
    got, at = K.grams(h, first, k)
    rows = row_of[at]
    for short in range(1, k):
        few = np.flatnonzero(n == short)
        if len(few):
            seq = np.full(len(few), U(short), np.uint64)
            for j in range(short):
                seq = K.mix(seq * U(0x9E3779B97F4A7C15) + h[first[few] + j])
            got, rows = np.concatenate([got, seq]), np.concatenate([rows, few])
    key = (rows.astype(np.uint64) << U(HASH_BITS)) | (got >> U(64 - HASH_BITS))
    key.sort()
    return key[np.flatnonzero(np.diff(key, prepend=~key[:1]))] if len(key) else key


def registers(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """256 registers a row: (leading zeros + 1) << 10 | mantissa of the smallest hash, 0 where none."""
    rest = HASH_BITS - BUCKET_BITS
    slot = row.astype(np.int64) * BUCKETS + (h >> U(rest)).astype(np.int64)
    lead = np.flatnonzero(np.diff(slot, prepend=-1))  # sorted: the first of a slot is its smallest
    v = h[lead] & U((1 << rest) - 1)
    zeros = (rest - np.frexp(v.astype(np.float64))[1]).astype(np.uint64)
    reg = ((zeros + U(1)) << U(MANTISSA)) | (((v << zeros) >> U(rest - 1 - MANTISSA)) & U((1 << MANTISSA) - 1))
    out = np.zeros(rows * BUCKETS, np.uint16)
    out[slot[lead]] = reg
    return out.reshape(rows, BUCKETS)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.chunks(batch.column(1)):
                key = shingle_sets(data, off, k)
                row, h = (key >> U(HASH_BITS)).astype(np.int64), key & U((1 << HASH_BITS) - 1)
                size = np.bincount(row, minlength=b - a)
                at = np.concatenate([[0], np.cumsum(size)])
                sums = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(h ^ U(salt)))])
                    sums.append((acc[at[1:]] - acc[at[:-1]]).view(np.int64))
                reg = registers(row, h, b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), *map(pa.array, sums), pa.array(list(map(bytes, reg)), pa.binary())],
                    ["doc_id", "n", "f1", "f2", "reg"],
                )

    return run


#: For each bucket all buckets in an order of its own.
SOURCES = K.mix(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).reshape(BUCKETS, BUCKETS).argsort(1)


def densified(reg: np.ndarray) -> np.ndarray:
    """Registers with each empty one filled from another, chosen by a hash of the bucket and the attempt.

    Two sets then agree in any register with odds near their similarity, however small they are;
    without it the bands of short texts would hold one or two shingles and meet far too often.
    """
    out, used = reg.copy(), reg > 0
    row, slot = np.nonzero(~used & used.any(1)[:, None])
    for attempt in range(1, 33):
        if not len(row):
            return out
        source = (K.mix((slot * 64 + attempt).astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(64 - BUCKET_BITS)).astype(np.int64)
        hit = used[row, source]
        out[row[hit], slot[hit]] = reg[row[hit], source[hit]]
        row, slot = row[~hit], slot[~hit]
    # the rest, of short texts: the first used one in an order of all sources that each bucket has for itself
    for at in range(0, len(row), 8192):
        r, t = row[at : at + 8192], slot[at : at + 8192]
        sources = SOURCES[t]
        source = sources[np.arange(len(r)), used[r[:, None], sources].argmax(1)]
        out[r, t] = reg[r, source]
    return out


#: The registers of the bands: all in their order, and all in a shuffled one.
ORDER = np.concatenate([np.arange(BUCKETS), np.random.default_rng(3).permutation(BUCKETS)])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = K.mix(np.arange(1, len(ORDER) // BAND + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            reg = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            packed = np.ascontiguousarray(densified(reg)[:, ORDER]).view(np.uint64).reshape(len(part), len(salt), -1)
            key = salt[None]
            for k in range(packed.shape[2]):
                key = K.mix(key * U(0x9E3779B97F4A7C15) + packed[:, :, k])
            row = pa.array(np.repeat(np.arange(len(part)), len(salt)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array(key.ravel().view(np.int64))], ["class_id", "band"])


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate without the expected accidental equalities, and the number of buckets in use."""
    used = np.maximum((x > 0) | (y > 0), False).sum(1)
    equal = ((x == y) & (x > 0)).sum(1)
    big, small = np.maximum(nx, ny) / BUCKETS, np.minimum(nx, ny) / BUCKETS
    by_chance = BUCKETS * 0.169919487 * 2.0**-MANTISSA * np.minimum(1, 4 * big * small / (1 + big) ** 2)
    return np.clip((equal - by_chance) / np.maximum(used, 1), 0, 1), used


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("rx", "ry"))
            j, used = estimate(x, y, batch.column("nx").to_numpy(), batch.column("ny").to_numpy())
            keep = j >= least - 5 * np.sqrt(least * (1 - least) / np.maximum(used, 1))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _compared(k: int, percent: int):
    """Rows (hub, part, doc_id, near, packed) in that order, the hub first of each part: every member against its hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, base = None, np.zeros(0, U)
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                hub, part, ids, near = (rows.column(c).to_pylist() for c in ("hub", "part", "doc_id", "near"))
                texts = unpack(rows.column("packed"))
                out: list[tuple] = []
                apart = []
                for a, b, data, off in K.chunks(texts):
                    key = shingle_sets(data, off, k)
                    cut = np.searchsorted(key, np.arange(b - a + 1, dtype=np.uint64) << U(HASH_BITS))
                    h = key & U((1 << HASH_BITS) - 1)
                    for r in range(a, b):
                        own = h[cut[r - a] : cut[r - a + 1]]
                        same, before = before == (hub[r], part[r], ids[r]), (hub[r], part[r], ids[r])
                        if same:  # another row of the doc_id
                            continue
                        if ids[r] == hub[r]:
                            base = own.copy()
                            continue
                        d = np.setxor1d(own, base, assume_unique=True)
                        common = (len(own) + len(base) - len(d)) // 2
                        out.append((hub[r], ids[r], len(own), bool(near[r]) and 100 * common >= percent * (common + len(d))))
                        apart.append(d)
                if out:
                    hubs, members, n, linked = zip(*out, strict=True)
                    cut = np.concatenate([[0], np.cumsum([len(d) for d in apart])])
                    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(apart).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(members), pa.array(n, pa.int64()), pa.array(linked), lists], ["hub", "class_id", "n", "linked", "d"])

    return run


def apart_pairs(sides: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a > b, that connect the rows of ``sides`` (hub, class_id, component, n, d) of one hub.

    d(x) is what x has and the hub has not, and the reverse, then likewise of the usual member of the hub, which
    has what more than half of them have (nothing in a hub of one). Two sets are similar enough exactly if their difference is at most c (|x| + |y|),
    c = (100 - percent) / (100 + percent), so if 2 |d(x) & d(y)| >= w(x) + w(y), where w(x) = |d(x)| - c |x|.
    Where w(x) + w(y) <= 0 both are linked with the member of the smallest w too, and so a star
    is enough. Any other pair shares an element of d; from the first that it shares, the rarest first, both must have enough
    elements left. Elements that only one member has come first and meet nothing. The pairs that
    meet are decided by their whole d.
    """
    either = lambda p, q: F.concat(F.array_except(p, q), F.array_except(q, p))
    members = sides.groupBy("hub").agg(F.count("*").alias("members"))
    held = sides.select("hub", F.explode("d").alias("e")).groupBy("hub", "e").agg(F.count("*").alias("held"))
    # what more than half of the members have is counted with one of two numbers of binary digits, which keeps the rare elements of a large hub apart
    digits = lambda c: F.length(F.bin(c))
    halves = members.withColumn("digits", F.explode(F.array(digits("members") - 1, digits("members"))))
    held = held.filter("held > 1").withColumn("digits", digits("held"))
    usual = held.join(halves, ["hub", "digits"]).filter("2 * held > members").groupBy("hub").agg(F.collect_list("e").alias("usual"))
    sides = sides.join(usual, "hub", "left").withColumn("d", F.when(F.col("usual").isNull(), F.col("d")).otherwise(either("d", "usual")))
    # whole numbers: (100 + percent) * w
    w = (100 + percent) * F.size("d").cast("long") - (100 - percent) * F.col("n")
    sides = settle(sides.select("hub", "class_id", "component", "n", "d", w.alias("w")))

    lows = sides.groupBy("hub").agg(F.min(F.struct("w", "class_id", "component")).alias("low"))
    star = sides.join(lows, "hub").filter("w + low.w <= 0 AND component <> low.component")
    star = star.select(F.col("class_id").alias("x"), F.col("low.class_id").alias("y"))

    each = sides.select("hub", "class_id", "component", "n", "w", F.size("d").alias("m"), F.explode("d").alias("e"))
    each = each.withColumn("held", F.count("*").over(Window.partitionBy("hub", "e")))
    each = each.withColumn("left", F.col("m") + 1 - F.row_number().over(Window.partitionBy("hub", "class_id").orderBy("held", "e")))
    # no partner in the hub has less than the smallest w
    reach = each.filter("held > 1").join(lows.select("hub", F.col("low.w").alias("low")), "hub").filter(f"{2 * (100 + percent)} * left >= w + low")
    reach = settle(reach.select("hub", "e", "class_id", "component", "n", "w", "left"))
    x, y = (reach.select("hub", "e", *(F.col(c).alias(f"{c}_{i}") for c in ("class_id", "component", "n", "w", "left"))) for i in "xy")
    fits = f"class_id_x > class_id_y AND component_x <> component_y AND w_x + w_y > 0 AND 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y) AND {2 * (100 + percent)} * least(left_x, left_y) >= w_x + w_y"
    met = settle(x.join(y, ["hub", "e"]).filter(fits).select("hub", "class_id_x", "class_id_y").distinct())
    for i in "xy":
        met = met.join(sides.select("hub", *(F.col(c).alias(f"{c}_{i}") for c in ("class_id", "d", "w"))), ["hub", f"class_id_{i}"])
    met = met.filter(f"{2 * (100 + percent)} * size(array_intersect(d_x, d_y)) >= w_x + w_y")
    met = met.select(F.col("class_id_x").alias("x"), F.col("class_id_y").alias("y"))
    return star.unionByName(met).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id integer, text).

    Two documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets;
    a component is all that links reach, and its smallest doc_id is kept. Words are runs of bytes
    other than ASCII white space, A-Z lower-cased. A text shorter than ``shingle`` words is one
    shingle. A null or blank text has none: n_shingles 0, its own component, kept. Rows with a null
    doc_id take part in no link: component_id is null, kept is true. Repeated rows all come back,
    each with the component of its text. Extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = settle(docs.mapInArrow(_sketch(shingle), "doc_id long, n long, f1 long, f2 long, reg binary"))
    text_key = ["f1", "f2", "n"]
    some = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    heads = some.groupBy(*text_key).agg(F.min(F.struct("doc_id", "reg")).alias("head"))
    classes = settle(heads.select(*text_key, F.col("head.doc_id").alias("class_id"), "head.reg"))

    band = Window.partitionBy("band")
    members = classes.select("class_id", "reg").mapInArrow(_bands, "class_id long, band long")
    members = members.withColumn("least", F.min("class_id").over(band)).withColumn("most", F.max("class_id").over(band))
    members = settle(members.filter("least <> most"))

    tried = settle(members.filter("class_id <> least").select(F.col("class_id").alias("a"), F.col("least").alias("b")).distinct())
    x, y = (classes.select(F.col("class_id").alias(i), F.col("n").alias(f"n{j}"), F.col("reg").alias(f"r{j}")) for i, j in (("a", "x"), ("b", "y")))
    near = tried.join(x, "a").join(y, "b").filter(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    near = settle(near.select("a", "b", "nx", "ny", "rx", "ry").mapInArrow(_likely(percent / 100), "a long, b long"))

    runs = meet(tried.join(near.distinct().withColumn("near", F.lit(True)), ["a", "b"], "left"), docs, "near")
    compared = settle(runs.mapInArrow(_compared(shingle, percent), "hub long, class_id long, n long, linked boolean, d array<long>"))
    edges = compared.filter("linked").select(F.col("class_id").alias("a"), F.col("hub").alias("b"))
    of = components(edges) if not is_empty(edges) else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))

    named = members.select("class_id", "band", "least").join(of.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = named.withColumn("component", F.coalesce("component", "class_id"))
    named = named.withColumn("lo", F.min("component").over(band)).withColumn("hi", F.max("component").over(band))
    apart = settle(named.filter("lo <> hi AND class_id <> least").select(F.col("least").alias("hub"), "class_id", "component").distinct())
    if not is_empty(apart):
        sides = apart.join(compared.drop("linked"), ["hub", "class_id"])
        more = settle(apart_pairs(sides, percent))
        if not is_empty(more):
            of = components(more.unionByName(of.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    grouped = classes.select(*text_key, "class_id").join(of.withColumnRenamed("node", "class_id"), "class_id", "left")
    grouped = grouped.select(*text_key, F.coalesce("component", "class_id").alias("component_id"))
    # the few columns below, not texts, are what this last join moves
    out = sketches.select("doc_id", *text_key).join(grouped, text_key, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one document of each component is left.

    Of rows that share a doc_id the one with the smallest hash of its text, then of all its columns, stays, on every run. Rows without doc_id, and texts that are
    null or have no words, are linked with nothing and stay; very long texts are compared whole; extra columns come along; an empty table stays empty.
    """
    out = near_duplicates(docs, shingle, percent).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    order = F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))
    one = docs.join(out, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    return one.select("_row.*").unionByName(docs.filter("doc_id IS NULL"))

"""Exact repeated byte strings of a fixed length across all texts.

Every string of ``PASSAGE`` bytes has an anchor, the smallest hash of its 16-byte grams. Equal strings have
equal anchors, so the starts that share an anchor (a stretch, about 110 neighbours) need comparing only
with stretches of the same anchor, wherever they are. A stretch is known by a digest of its bytes: one that occurs twice is
repeated as a whole. Of the others whose anchor occurs again one copy is sent to the shard of the anchor, and there a sort of
the fingerprints of all their strings, in runs of bounded size cut between anchors, brings equal strings side by side; what stands
side by side is compared byte for byte.

Scale. Equal texts are one text (what has a copy is covered wholly and takes part once), equal stretches one stretch. What is
shuffled is a row a stretch, the bytes around those that only resemble each other, and each text twice, compressed; shuffle files go as soon as
a step is written. The strings of an anchor with
more than ``MANY`` different stretches are not gathered: each is a digest, and digests are counted by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import kernels as K
from strandline.llm.meeting import pack, unpack
from strandline.llm.shared import is_empty, settle

LENGTH = 400
#: Repeated strings of this many bytes are told of, in passages of more than ``WORDS`` words, but not removed.
PASSAGE = 256
WORDS = 50
GRAM = 16
#: Different stretches of an anchor that a task compares; beyond, their strings are counted by digest.
MANY = 4096
#: Bytes of stretches that a task sorts at a time, and those of one anchor more.
RUN = 4 << 20
_BITS = 20
U = np.uint64


def stretches(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, anchor occurs twice or more) of every stretch, positions in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none, none.astype(bool)
    sums = K.prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    h = K.span(sums, at, at + GRAM)
    # the position in the lowest bits makes the first of equal grams the minimum and tells where it is
    y = (h >> U(_BITS) << U(_BITS)) | at.astype(np.uint64)
    low = K.sliding_min(y, length - GRAM + 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    starts = np.flatnonzero(row[: len(low)] == row[length - 1 :])
    if not len(starts):
        return none.view(np.uint64), none, none, none.astype(bool)
    low, anchor = low[starts], low[starts] >> U(_BITS)
    new = np.flatnonzero((np.diff(anchor, prepend=~anchor[:1]) != 0) | (np.diff(starts, prepend=-2) != 1) | (np.diff(row[starts], prepend=-1) != 0))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return anchor[new], starts[new], starts[last], low[new] != low[last]


def _anchors(length: int, passage: int):
    step = (1 << _BITS) - length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new.append(key not in seen)  # of the copies of a text in a partition, one
                seen.add(key)
            batch = batch.filter(pa.array(new, pa.bool_()))
            for a, b, data, off in K.chunks(batch.column(2), (1 << _BITS) - 1):
                for base in range(0, max(1, len(data) - passage + 1), step):  # more than one only for a very long text
                    part = data[base : base + (1 << _BITS)]
                    within = off if len(data) <= len(part) else np.array([0, len(part)])
                    anchor, first, last, twice = stretches(part, within, passage)
                    row = np.searchsorted(within, first, "right") - 1
                    if base + len(part) < len(data):  # strings that begin in the overlap are the next part's
                        own = first < step
                        anchor, first, last, twice, row = anchor[own], first[own], np.minimum(last[own], step - 1), twice[own], row[own]
                    start = within[row]
                    stop = np.minimum(last + length, within[row + 1])
                    raw = part.tobytes()
                    digest = np.frombuffer(b"".join(hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(first.tolist(), stop.tolist(), strict=True)), np.int64).reshape(-1, 2)
                    at = pa.array(row + a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), *(pa.array(base + v - start) for v in (first, last, stop)), pa.array(twice), *map(pa.array, digest.T)],
                        ["anchor", "k1", "k2", "first", "last", "stop", "twice", "d1", "d2"],
                    )

    return run


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        data, off = K.buffer(unpack(batch.column(2)))
        lists = batch.column(3)
        at, flat = lists.offsets.to_numpy(), lists.values
        row = np.repeat(np.arange(len(batch)), np.diff(at))
        anchor, first, last, stop, single, many = (flat.field(k).to_numpy(zero_copy_only=False)[at[0] : at[-1]] for k in range(6))
        for i in range(0, len(row), 8192):
            r, f, t = (v[i : i + 8192] for v in (row, first, stop))
            parts = [data[a:b].tobytes() for a, b in zip(off[r] + f, off[r] + t, strict=True)]
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[i : i + 8192]), batch.column(0).take(take), batch.column(1).take(take), pa.array(f), pa.array(last[i : i + 8192]), pa.array(single[i : i + 8192]), pa.array(many[i : i + 8192]), pa.array(parts, pa.binary())],
                ["anchor", "k1", "k2", "first", "last", "single", "many", "bytes"],
            )


def _equal(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int, rows: int = 2048) -> np.ndarray:
    """Whether the ``length`` bytes from x and from y are the same, byte for byte."""
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    return np.concatenate([np.zeros(0, bool), *((view[x[i : i + rows]] == view[y[i : i + rows]]).all(axis=1) for i in range(0, len(x), rows))])


def repeated_starts(parts: list[bytes], anchor: np.ndarray, starts_of: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, start) of every string of ``length`` bytes that starts at two places of the parts of its anchor, among the first ``starts_of`` each."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size) - size
    n = np.maximum(0, np.minimum(starts_of, size - length + 1))
    part = np.repeat(np.arange(len(parts)), n)
    starts = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[part] + starts
    mark = K.span(K.prefix(data), at, at + length) ^ K.mix(anchor.view(np.uint64))[part]
    order = np.argsort(mark, kind="stable")
    if not len(order):
        return part, starts
    at, same = at[order], np.diff(mark[order]) == 0
    held = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    pair = np.flatnonzero(same)
    differ = pair[~_equal(data, at[pair], at[pair + 1], length)]
    if len(differ):  # a mark that different strings have says nothing: its strings are told apart by digest
        group = np.cumsum(np.concatenate([[0], ~same]))
        for g in np.unique(group[differ]):
            lo, hi = np.searchsorted(group, [g, g + 1])
            digests = [hashlib.blake2b(data[p : p + length].tobytes(), digest_size=16).digest() for p in at[lo:hi]]
            times = Counter(digests)
            held[lo:hi] = [times[d] > 1 for d in digests]
    twice = np.sort(order[held])
    return part[twice], starts[twice]


def _covered(lengths: tuple[int, ...]):
    schema = ["k1", "k2", "lo", "hi", "length"]

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, k1, k2, first, last, single, parts = zip(*rows, strict=True)
        first = np.array(first, np.int64)
        starts_of = np.array(last, np.int64) - first + 1
        for length in lengths:
            part, start = repeated_starts(list(parts), np.array(anchor, np.int64), starts_of, length)
            own = np.array(single, bool)[part]  # the others are covered as a whole
            part, start = part[own], start[own]
            new = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
            ends = np.concatenate([new[1:], [len(part)]])[: len(new)] - 1
            p = part[new]
            lo, hi = first[p] + start[new], first[p] + start[ends] + length
            yield pa.RecordBatch.from_arrays([pa.array(np.array(k1, np.int64)[p]), pa.array(np.array(k2, np.int64)[p]), pa.array(lo), pa.array(hi), pa.array(np.full(len(p), length, np.int32))], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= RUN and row[0] != rows[-1][0]:
                    yield from flush(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[6])
        if rows:
            yield from flush(rows)

    return run


def _strings(lengths: tuple[int, ...]):
    """The digest of every string of the stretches, for anchors that have too many of them for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, first, last, single, part in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "first", "last", "single", "bytes")), strict=True):
                for length in lengths:
                    n = max(0, min(last - first + 1, len(part) - length + 1))
                    marks = np.frombuffer(b"".join(hashlib.blake2b(part[i : i + length], digest_size=16).digest() for i in range(n)), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(np.arange(n) + first), pa.array([single] * n, pa.bool_()), pa.array(np.full(n, length, np.int32))],
                        ["m1", "m2", "k1", "k2", "lo", "single", "length"],
                    )

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _words(text: np.ndarray) -> int:
    on = np.concatenate([[False], ~K.SPACE[text]])
    return int((on[1:] & ~on[:-1]).sum())


def _cut(length: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            data, off = K.buffer(unpack(batch.column(1)))
            spans, copies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            removed, runs, digest, passages = [], [], [], []
            for r in range(len(batch)):
                text = data[off[r] : off[r + 1]]
                whole = [(0, len(text))] if copies[r] > 1 else []
                cut = _merged([(s["lo"], s["hi"]) for s in spans[r] or [] if s["length"] == length] + whole * (len(text) >= length))
                told = _merged([(s["lo"], s["hi"]) for s in spans[r] or []] + whole * (len(text) >= passage))
                h, at = hashlib.sha256(), 0
                for lo, hi in cut:
                    h.update(text[at:lo].tobytes())
                    at = hi
                h.update(text[at:].tobytes())
                removed.append(sum(hi - lo for lo, hi in cut))
                runs.append(len(cut))
                digest.append(h.hexdigest())
                passages.append(sum(_words(text[lo:hi]) > WORDS for lo, hi in told))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest), pa.array(passages, pa.int64()), pa.array([n > 0 for n in passages], pa.bool_())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "repeats"],
            )

    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, repeats) of every row of ``docs`` (doc_id, text).

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or
    another, is removed; strings overlap and are judged on the input. n_passages: the maximal runs of more than ``WORDS`` words that
    strings of ``passage`` bytes (at most ``length``) cover that also start elsewhere; they stay, and ``repeats`` tells that there is one. A null text is an empty one: 0
    bytes and the digest of nothing. Repeated rows are texts of their own and so remove each other. A very long text is searched in
    overlapping parts of 1 MB; cutting takes memory in proportion to the longest text.
    Strings of a shard are equal by their bytes, stretches and the strings of a hot anchor by 128-bit digests. Extra columns are ignored; an empty table gives no rows.
    """
    lengths = tuple(sorted({length, passage}))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    anchors = keyed.select("k1", "k2", "text").mapInArrow(_anchors(length, passage), "anchor long, k1 long, k2 long, first long, last long, stop long, twice boolean, d1 long, d2 long")
    # dealt once, by what all that follows has in common
    anchors = anchors.repartition("anchor").dropDuplicates(["anchor", "k1", "k2", "first"])  # copies of a text count once
    own, same = Window.partitionBy("anchor"), Window.partitionBy("anchor", "d1", "d2")
    anchors = anchors.withColumn("n", F.count("*").over(own)).filter("n > 1 OR twice")
    anchors = anchors.withColumn("m", F.count("*").over(same)).withColumn("at", F.row_number().over(same.orderBy("k1", "k2", "first")))
    anchors = settle(anchors.withColumn("kinds", F.sum((F.col("at") == 1).cast("long")).over(own)))
    both = F.array(*(F.when(F.col("stop") - F.col("first") >= n, F.lit(n)) for n in lengths))
    alike = anchors.filter("m > 1").select("k1", "k2", F.col("first").alias("lo"), F.col("stop").alias("hi"), F.explode(F.array_compact(both)).alias("length"))

    wanted = anchors.filter("at = 1 AND (kinds > 1 OR twice)").withColumn("single", F.col("m") == 1).withColumn("many", F.col("kinds") > many)
    per_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "first", "last", "stop", "single", "many")).alias("stretches"))
    texts = pack(keyed, "k1", "k2").hint("merge").join(per_text, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    parts = texts.select("k1", "k2", "packed", "stretches").mapInArrow(_contexts, "anchor long, k1 long, k2 long, first long, last long, single boolean, many boolean, bytes binary")
    few = parts
    if not is_empty(wanted.filter("many")):
        parts = settle(parts)
        few = parts.filter("NOT many")
        strings = settle(parts.filter("many").mapInArrow(_strings(lengths), "m1 long, m2 long, k1 long, k2 long, lo long, single boolean, length int"))
        again = strings.groupBy("m1", "m2", "length").count().filter("count > 1").drop("count")
        found = strings.filter("single").join(again.hint("merge"), ["m1", "m2", "length"]).selectExpr("k1", "k2", "lo", "lo + length AS hi", "length")
        alike = alike.unionByName(found)
    shards = few.drop("many").repartition("anchor").sortWithinPartitions("anchor")
    covered = settle(shards.mapInArrow(_covered(lengths), "k1 long, k2 long, lo long, hi long, length int").unionByName(alike))
    spans = covered.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi", "length")).alias("spans"))
    copies = keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    found = copies.join(spans, ["k1", "k2"], "left")
    rows = pack(keyed, "doc_id", "k1", "k2").hint("merge").join(found, ["k1", "k2"]).select("doc_id", "packed", "spans", "copies")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_cut(length, passage), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, repeats boolean")

"""Importance resampling towards a target by hashed n-grams, their CRCs composed from those of the words.

CRC-32 is linear over GF(2): the CRC of two strings in a row is the CRC of the first, moved on by as many
zero bytes as the second has, xor the CRC of the second. A move by 2**k bytes is a 32 x 32 bit matrix, so
every n-gram comes from the CRCs of its words, each computed once, and no n-gram is ever a string.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import kernels as K
from strandline.llm.shared import settle
from strandline.operators.order import ranked

U32 = np.uint32
#: Generator polynomial of CRC-32, bits reversed (fixed value).
POLYNOMIAL = 0xEDB88320
#: Longer words are not worth a vector step a byte and are taken one by one.
LONG_WORD = 40


def _byte_table() -> np.ndarray:
    """What one byte adds to a CRC: eight steps of the shift register."""
    c = np.arange(256, dtype=U32)
    for _ in range(8):
        c = np.where(c & U32(1), (c >> U32(1)) ^ U32(POLYNOMIAL), c >> U32(1))
    return c


BYTE_TABLE = _byte_table()


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & U32(255)] ^ tables[1][(c >> U32(8)) & U32(255)] ^ tables[2][(c >> U32(16)) & U32(255)] ^ tables[3][c >> U32(24)]


def _by_bytes(matrix: np.ndarray) -> np.ndarray:
    """A matrix, given by the image of each of 32 bits, as four tables, one for each byte of a CRC."""
    out = np.zeros((4, 256), U32)
    for byte in range(4):
        for bit in range(8):
            on = (np.arange(256) >> bit & 1).astype(bool)
            out[byte][on] ^= matrix[8 * byte + bit]
    return out


def _shifts(powers: int = 32) -> list[np.ndarray]:
    """Tables that move a CRC on by 1, 2, 4, ... zero bytes: each matrix is the square of the one before."""
    bits = U32(1) << np.arange(32, dtype=U32)
    matrix = BYTE_TABLE[bits & U32(255)] ^ (bits >> U32(8))
    out = []
    for _ in range(powers):
        out.append(_by_bytes(matrix))
        matrix = _apply(out[-1], matrix)
    return out


SHIFTS = _shifts()


def shift(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its number of zero bytes."""
    crc, k, most = crc.astype(U32), 0, int(by.max(initial=0))
    while most >> k:
        on = np.flatnonzero(by >> k & 1)
        crc[on] = _apply(SHIFTS[k], crc[on])
        k += 1
    return crc


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each word, one vector step for each place in a word."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, length = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, U32)
    for j in range(min(LONG_WORD, int(length[0]) if len(length) else 0)):
        n = int(np.searchsorted(-length, -j, "left"))  # words longer than j come first
        c = crc[:n]
        crc[:n] = BYTE_TABLE[(c ^ data[at[:n] + j]) & U32(255)] ^ (c >> U32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ U32(0xFFFFFFFF)
    for i in order[: int(np.searchsorted(-length, -LONG_WORD, "left"))].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def ngram_crcs(data: np.ndarray, off: np.ndarray, longest: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """CRCs of the runs of 1 to ``longest`` words joined by a space, the row of each, and the words of each row."""
    low = K.LOWER[data]
    starts, ends, first = K.tokens(low, off, K.ALNUM[low])
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    one, size = word_crcs(low, starts, ends), ends - starts
    crcs, rows = [one], [row]
    grown, blank = one, U32(zlib.crc32(b" "))
    for n in range(2, longest + 1):
        m = len(one) - n + 1
        if m <= 0:
            break
        # the run one word shorter, then a space, then the word; what crosses the end of a row is left out last
        spaced = shift(grown[:m], np.ones(m, np.int64)) ^ blank
        grown = shift(spaced, size[n - 1 :]) ^ one[n - 1 :]
        inside = np.flatnonzero(row[:m] == row[n - 1 :])
        crcs.append(grown[inside])
        rows.append(row[inside])
    return crcs, rows, words


def _buckets(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bucket and row of each feature, words of each row) of each chunk of rows."""
    for a, b, data, off in K.chunks(column):
        crcs, rows, words = ngram_crcs(data, off, longest)
        yield a, b, (np.concatenate(crcs) % U32(buckets)).astype(np.int64), np.concatenate(rows), words


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends a row for each bucket at most, whatever it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket, _, _ in _buckets(batch.column(0), longest, buckets):
                n += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Log ratio of target to raw frequency of each bucket, with one added to each count, in thousandths rounded down: ``buckets`` numbers on the driver."""
    raw, wanted = (bucket_counts(x, longest, buckets) for x in (docs, target))
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(wanted.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # a row a bucket
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text): a draw without replacement towards ``target`` (text).

    A text's words are runs of letters, digits and what is not ASCII, A-Z lower-cased; its features the runs of 1 to
    ``longest`` words. weight: sum of the gains of its features' buckets. score: the weight and Gumbel noise from the seeded
    digest of the doc_id. Of the N documents with at least ``least_words`` words the ``percent * N / 100`` (rounded down)
    highest scores are drawn, ties to the smaller doc_id; rank counts them from 1, the others have none. A null or blank text
    has no features and weight 0. A row without doc_id has no score, is not drawn and not counted in N. Rows that share a doc_id
    and score come in any order; each counts. Very long texts are read whole in their task. Extra columns are ignored; an empty table
    gives no rows, an empty target equal gains for what is equally rare.
    """
    gains = bucket_gains(docs, target, longest, buckets)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, bucket, row, words in _buckets(batch.column(1), longest, buckets):
                n = np.bincount(row, minlength=b - a).astype(np.int64)
                weight = np.bincount(row, gains[bucket], b - a).astype(np.int64)  # whole numbers, exact in doubles
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = settle(rows.withColumn("score", F.col("weight") + noise))
    open_ = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = percent * rows.filter(open_).count() // 100
    out = ranked(rows.withColumn("_open", F.when(open_, F.col("score"))), "_open", "doc_id", "rank")
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))



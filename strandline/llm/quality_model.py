"""Quality classifier by attention-based multiple-instance learning, in numpy.

A text is a bag of passages of ``PASSAGE`` bytes, all of them. A passage is a vector of hashed byte
trigrams and passes one encoder; gated attention, learnt from the labels of whole documents, weighs the passages, and the weighted mean
is scored. The model is fitted on the driver on a bounded sample of labelled rows
(``SAMPLE``), and every row is scored where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import kernels as K

PASSAGE, FEATURES, HIDDEN, ATTENTION = 480, 512, 24, 12
#: Bounds of the fit: labelled rows, in the order of a hash of their doc_id, and the bytes of a text; longer ones are not learnt from.
SAMPLE = 1600
LEARNT_BYTES = 1 << 15
PREDICT = 0.7


def bags(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages and the first passage of each row; an empty text is one zero vector."""
    n = np.diff(off)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-n // PASSAGE)))])
    out = np.zeros((int(first[-1]), FEATURES), np.float32)
    if len(data) > 2:
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(data)) - off[row]
        gram = (data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(23)
        inside = np.flatnonzero(row[:-2] == row[2:])
        slot = (first[row[inside]] + at[inside] // PASSAGE) * FEATURES + gram[inside]
        out += np.sqrt(np.bincount(slot, minlength=out.size)).astype(np.float32).reshape(out.shape)
    return out / np.maximum(1e-6, np.sqrt((out * out).sum(1, keepdims=True))), first


class AttentionModel:
    """Encoder, gated attention over a bag, logistic score; Adam on the log loss with balanced classes."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        shapes = {"e": (FEATURES, HIDDEN), "eb": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "w": (ATTENTION,), "o": (HIDDEN,), "ob": (1,)}
        self.p = {k: (r.normal(0, 1 / np.sqrt(s[0]), s) if k[-1] != "b" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.p["e"] *= 4

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["e"] + p["eb"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = (t * g) @ p["w"]
        n = np.diff(first)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first[:-1]), n))
        a = s / np.repeat(np.add.reduceat(s, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return h, t, g, a, z, z @ p["o"] + p["ob"]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._forward(x, first)[5].astype(float))) if len(first) > 1 else np.zeros(0)

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 10, seed: int = 0) -> None:
        r, p, step = np.random.default_rng(seed), self.p, 0
        m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
        weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), 32):
                docs = order[i : i + 32]
                n = (first[docs + 1] - first[docs]).astype(int)
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                f = np.concatenate([[0], np.cumsum(n)])
                xb = x[rows]
                h, t, g, a, z, out = self._forward(xb, f)
                dz = ((1 / (1 + np.exp(-out)) - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
                dh_z = np.repeat(dz[:, None] * p["o"], n, axis=0)
                da = (dh_z * h).sum(1)
                ds = a * (da - np.repeat(np.add.reduceat(a * da, f[:-1]), n))
                dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
                dh = (a[:, None] * dh_z + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
                grad = {"e": xb.T @ dh, "eb": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ ds, "o": z.T @ dz, "ob": dz.sum(keepdims=True)}
                step += 1
                for k, q in p.items():
                    m[k] += 0.1 * (grad[k] - m[k])
                    v[k] += 0.001 * (grad[k] ** 2 - v[k])
                    q -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11) -> AttentionModel | None:
    """The model, from the ``sample`` first labelled rows (doc_id, quality) by hash; None without both classes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("quality IN (0, 1) AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    # twice as many ids as rows are wanted, as some texts are missing or too long
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LEARNT_BYTES)
    rows = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one text of a repeated doc_id
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = sorted((r for r in rows.collect()), key=lambda r: (r["doc_id"], r["text"] or ""))  # at most SAMPLE times LEARNT_BYTES
    y = np.array([r["quality"] for r in rows], np.float32)
    if not 0 < y.sum() < len(y):
        return None
    parts, first = [], [0]
    for _, _, data, off in K.chunks(pa.array([r["text"] for r in rows], pa.string())):
        x, f = bags(data, off)
        parts.append(x)
        first += (f[1:] + first[-1]).tolist()
    model = AttentionModel(seed)
    model.fit(np.concatenate(parts), np.array(first), y, seed=seed)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    The model learns from labelled rows that are not held out, those whose crc32 of the doc_id as text
    is not 2 modulo 4; only texts are its input. A null text is an empty one and has a score too.
    Without labels of both classes every score is 0.5. A null doc_id is not held out. Repeated rows
    come back each; extra columns are ignored; an empty table gives no rows. Very long texts are scored whole, in memory in proportion to the
    longest one.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit_quality(docs, labels.filter(~held))
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.chunks(batch.column(1)):
                score = model.score(*bags(data, off)) if model else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], ["doc_id", "score"])

    rows = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))

"""Runs of words that repeat with a period, by Main and Lorentz's divide and conquer.

Words are interned as numbers within a text. A block is halved; the repetitions that cross its middle come
from four Z-functions, which tell for every period how far the block goes on with it to the left and to the right;
both halves follow. Only stretches in which every eight words in a row occur twice are searched: no other word
can be in a run (see ``stretches``). A text is searched where it lies and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strandline.llm import kernels as K

GRAM = 8
#: Shortest run and fewest periods of one. ``stretches`` holds for these and for anything larger.
LEAST, TIMES = 24, 3


def z_function(s: list[int]) -> list[int]:
    """For every place of ``s`` the length of the longest prefix of ``s`` that starts there; 0 for the first place."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def stretches(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Word ranges that hold every run of ``least`` words and three periods or more.

    In a run of length L and period q, eight words at place i occur again q later if i <= L - q - 8 and q earlier if
    i >= q. These cover the run as L >= 2q + 7, which L >= max(24, 3q) implies. So all eights inside
    a run are repeated ones, and what is no maximal row of repeated eights holds no run. Eights are told by a hash; two
    that collide only widen a stretch.
    """
    if len(ids) < least:
        return []
    h, step = ids.astype(np.uint64) + np.uint64(1), 1
    while step < GRAM:
        h = K.mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        step *= 2
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h) + 2, bool)
    again[1 + order[1:][same]] = again[1 + order[:-1][same]] = True
    edge = np.flatnonzero(again[1:] != again[:-1])
    return [(a, b + GRAM - 1) for a, b in edge.reshape(-1, 2).tolist() if b + GRAM - 1 - a >= least]


def _crossing(w: list[int], lo: int, hi: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the repetitions across the middle of a block, as far as they go in it; one a start and end, with its smallest period."""
    m = (lo + hi) // 2
    x, y = w[lo:m], w[m:hi]
    nx, ny = len(x), len(y)
    back = x[::-1]
    ahead = np.array([*z_function(y), 0])
    behind = np.array([*z_function(back), 0])
    across = np.array(z_function([*y, -1, *x, *y]))
    around = np.array(z_function([*back, -1, *y[::-1], *back]))
    q = np.arange(1, nx + 1)
    # a period wholly before the middle, then one wholly behind it
    start, end = m - q - behind[q], m + across[ny + 1 + nx - q]
    p = np.arange(1, ny + 1)
    start, end, q = np.concatenate([start, m - around[nx + 1 + ny - p]]), np.concatenate([end, m + p + ahead[p]]), np.concatenate([q, p])
    ok = np.flatnonzero(end - start >= np.maximum(least, times * q))
    ok = ok[np.argsort(q[ok], kind="stable")]
    _, one = np.unique(start[ok] * (len(w) + 1) + end[ok], return_index=True)
    for i in ok[one].tolist():
        yield int(start[i]), int(end[i]), int(q[i])


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run by start, then period: at least ``least`` words (24 or more) and ``times`` smallest periods (3 or more), as long as they go.

    A run crosses the middle of the smallest block that holds it and is whole there. A block that holds a part of it finds
    that part too, but the words around the block go on with the period, by which it is told and left out.
    """
    if least < LEAST or times < TIMES:
        raise ValueError(f"runs need {LEAST} words and {TIMES} periods at least")
    found: dict[tuple[int, int], int] = {}
    for a, b in stretches(ids, least):
        w = ids[a:b].tolist()
        blocks = [(0, len(w))]
        while blocks:
            lo, hi = blocks.pop()
            if hi - lo < least:
                continue
            for s, e, q in _crossing(w, lo, hi, least, times):
                if (s == lo > 0 and w[s - 1] == w[s - 1 + q]) or (e == hi < len(w) and w[e] == w[e - q]):
                    continue
                found[a + s, a + e] = min(q, found.get((a + s, a + e), q))
            m = (lo + hi) // 2
            blocks += [(lo, m), (m, hi)]
    return sorted((s, e - s, q) for (s, e), q in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, exactly; of equal ones the first, then the one of the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def interned(words: list[bytes]) -> np.ndarray:
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _suspects(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows in which some eight words in a row occur twice, by hash: no other row has a run."""
    starts, ends, first = K.tokens(data, off, ~K.SPACE[data])
    h, at = K.grams(K.span(K.prefix(data), starts, ends), first, GRAM)
    row = np.searchsorted(first, at, "right") - 1
    h = K.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h)
    h, row = h[order], row[order]
    out = np.zeros(len(off) - 1, bool)
    out[row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])]] = True
    return out


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a periodic end in one of ten documents, for measuring: which, where and how often follow from the CRC of the doc_id.

    Of such a text its words are joined by one space; the others, blank ones and rows without doc_id stay as they are.
    """
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            changed: list[int] = []
            put: list[str] = []
            for i, doc_id in enumerate(ids):
                h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
                words = (texts[i].as_py() or "").encode().split() if h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    changed.append(i)
                    put.append(b" ".join([*words[:a], *(words[a + j % p] for j in range(n - a))]).decode())
            if changed:
                mask = np.zeros(len(ids), bool)
                mask[changed] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(put, texts.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return docs.mapInArrow(run, docs.schema)


RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, strongest, text) of every row of ``docs`` (doc_id, text).

    Words are what ASCII white space parts, numbered from 0. runs: by start, then period, every stretch with smallest period q of at
    least ``least`` words and ``times`` q that no neighbouring word continues. strongest: the one of most periods, the first of equals,
    null without runs. text: the words joined by one space without those that a run holds after its first period. A null or
    blank text has no runs and an empty text. Repeated rows come back each; doc_id is only passed on and may be null;
    extra columns are ignored; an empty table gives no rows. A very long text is searched whole in its task, in memory in proportion to
    its words and n log n steps.
    """
    docs = docs.select("doc_id", "text")
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.chunks(batch.column(1)):
                raw, suspect = data.tobytes(), _suspects(data, off)
                all_runs, tops, texts = [], [], []
                for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    words = raw[s:e].split()
                    runs = runs_of(interned(words), least, times) if suspect[i] else []
                    if runs:
                        cover = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in runs:
                            cover[start + period] += 1
                            cover[start + length] -= 1
                        words = [words[j] for j in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                    top = strongest(runs)
                    all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    tops.append(dict(zip(("start", "length", "period"), top, strict=True)) if top else None)
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(all_runs, pa.list_(triple)), pa.array(tops, triple), pa.array(texts, pa.string())], ["doc_id", "runs", "strongest", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, runs array<{RUN}>, strongest {RUN}, text string")

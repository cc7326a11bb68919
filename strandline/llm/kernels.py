"""Numpy kernels over whole Arrow string columns, used inside Spark tasks.

A column is seen as one byte buffer with row offsets, so the work per byte is a few vector
operations and no Python runs per row or per word. Rows are taken in runs of about ``CHUNK`` bytes,
which bounds the memory of a task by the chunk or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words with good avalanche."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
_BASE = 0x9FB21C651E98DF25
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), U(base), np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, limit: int = CHUNK, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``rows`` rows and ``limit`` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, at + rows, max(at + 1, to))
        yield at, to
        at = to


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each run of rows."""
    data, off = buffer(column)
    for a, b in runs(off, limit):
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def tokens(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the longest runs of ``inside`` bytes in each row, and the first token of each row."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    on = np.zeros(n + 2, bool)
    on[1:-1] = inside
    starts = np.flatnonzero(on[1:-1] & (~on[:-2] | edge[:-1]))
    ends = np.flatnonzero(on[1:-1] & (~on[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: ``span`` reads the hash of any stretch from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * _pow(_BASE, len(data)), out=out[1:])
    return out


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each stretch."""
    h = (sums[ends] - sums[starts]) * _pow(_INV, len(sums))[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k tokens in a row, and the position of each in the token list; rows are cut at ``first``."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out += h[j : j + len(out)] * U((0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1) | 1)
        out ^= out >> U(29)
    left = np.repeat(first[1:], np.diff(first))  # end of the row that each token is in
    at = np.flatnonzero(np.arange(len(out)) + k <= left[: len(out)])
    return mix(out[at]), at


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by block-wise running minima from both sides."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-(-len(x) // w) * w, np.inf if x.dtype.kind == "f" else np.iinfo(x.dtype).max, x.dtype)
    pad[: len(x)] = x
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def chars(data: np.ndarray) -> np.ndarray:
    """Code points before each byte and at the end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out

"""Secrets in texts: fixed patterns, and a character convolutional network over every candidate.

Numpy finds the rows that can hold a pattern or a candidate from byte classes of whole Arrow
columns; only those rows are matched and scored. A row is judged by itself, so nothing is shuffled.
The network is trained when the operator is built, on findings labelled by their making (no table has such
labels): random keys of common forms in prose, code and links against long harmless tokens. On
findings held out from the fit its scores are calibrated and the threshold is the highest that keeps
the wanted recall.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import kernels as K

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "model")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

LEFT, RIGHT = 24, 8
WIDTH, FILTERS, EMBED = 7, 32, 8
#: Weight decay of the fit, and how far its labels keep from 0 and 1: scores that stay moderate can be calibrated.
DECAY, SMOOTH = 3e-2, 0.02
#: Symbols that the convolution reads at a time; a longer candidate is read in overlapping pieces, which have the same maxima.
PIECE = 256


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of a whole candidate and what is around it: 0 none, 1 other, 2.. printable ASCII; +98 inside the candidate."""
    left, body, right = text[max(0, start - LEFT) : start], text[start:end], text[end : end + RIGHT]
    out = np.zeros(LEFT + len(body) + RIGHT, np.int64)
    for at, part, shift in ((LEFT - len(left), left, 0), (LEFT, body, 98), (LEFT + len(body), right, 0)):
        codes = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.int64)
        out[at : at + len(codes)] = np.where((codes >= 32) & (codes < 127), codes - 30, 1) + shift
    return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(n.max(initial=WIDTH))), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, n


def _traits() -> np.ndarray:
    """What a symbol is: its character without case, whether it is an upper or lower letter, a digit or a mark, and whether it is inside.

    Embeddings are sums over these, so that what is learnt of words in one case holds for the other.
    """
    out = np.zeros((196, 98 + 5), np.float32)
    for symbol in range(196):
        inside, code = divmod(symbol, 98)
        char = chr(code + 30) if code >= 2 else ""
        out[symbol, ord(char.lower()) - 30 if char else code] = 1
        kind = 0 if char.isupper() else 1 if char.islower() else 2 if char.isdigit() else 3
        out[symbol, 98 + kind] = 1
        out[symbol, 102] = inside
    return out


TRAITS = _traits()


class Network:
    """Embedding by traits, one convolution, maximum over all positions, one logistic unit; Adam on the log loss with weight decay."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.t = r.normal(0, 0.3, (TRAITS.shape[1], EMBED)).astype(np.float32)
        self.e = TRAITS @ self.t
        self.c = r.normal(0, 0.15, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.w = r.normal(0, 0.3, FILTERS).astype(np.float32)
        self.a = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.0

    def _maxima(self, x: np.ndarray, n: np.ndarray):
        """Windows, the place of each filter's maximum and the maximum, for padded rows of lengths n."""
        emb = self.e[x]
        win = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - WIDTH + 1, -1)
        act = win @ self.c + self.b
        act[np.arange(act.shape[1])[None, :] > (n - WIDTH)[:, None]] = -np.inf
        at = act.argmax(1)
        return win, at, np.take_along_axis(act, at[:, None], 1)[:, 0]

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        step = PIECE - WIDTH + 1
        pieces = [(k, r[i : i + PIECE]) for k, r in enumerate(rows) for i in range(0, max(1, len(r) - WIDTH + 1), step)]
        pieces.sort(key=lambda p: len(p[1]))
        top = np.full((len(rows), FILTERS), -np.inf, np.float32)
        for i in range(0, len(pieces), 256):
            some = pieces[i : i + 256]
            np.maximum.at(top, [k for k, _ in some], self._maxima(*padded([p for _, p in some]))[2])
        return np.maximum(top, 0) @ self.w + self.a if len(rows) else np.zeros(0, np.float32)

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        """Probabilities of logits."""
        return 1 / (1 + np.exp(-(self.scale * logits.astype(float) + self.shift)))

    def fit(self, x: list[np.ndarray], y: np.ndarray, epochs: int, seed: int) -> None:
        r, params, step = np.random.default_rng(seed), [self.t, self.c, self.b, self.w, self.a], 0
        y = np.clip(y, SMOOTH, 1 - SMOOTH)
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 64):
                rows = order[i : i + 64]
                symbols, n = padded([x[k] for k in rows])
                win, at, top = self._maxima(symbols, n)
                z = np.maximum(top, 0) @ self.w + self.a
                dz = (1 / (1 + np.exp(-z)) - y[rows]).astype(np.float32) / len(rows)
                dtop = np.outer(dz, self.w) * (top > 0)
                picked = win[np.arange(len(rows))[:, None], at]  # rows, filters, window
                dc = np.einsum("rf,rfw->wf", dtop, picked)
                de = np.zeros_like(self.e)
                back = (dtop[:, :, None] * self.c.T[None]).reshape(len(rows), FILTERS, WIDTH, EMBED)
                np.add.at(de, symbols[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(WIDTH)], back)
                step += 1
                for k, g in enumerate((TRAITS.T @ de, dc, dtop.sum(0), np.maximum(top, 0).T @ dz, dz.sum(keepdims=True))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    params[k] -= 0.01 * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + DECAY * params[k])
                self.e = TRAITS @ self.t

    def calibrate(self, x: list[np.ndarray], y: np.ndarray, recall: float) -> None:
        """Logistic calibration by Newton steps; the highest threshold of the logits that keeps ``recall``, two deviations of its estimate on the safe side."""
        z, p = self.logits(x).astype(float), np.array([1.0, 0.0])
        f = np.stack([z, np.ones_like(z)], 1)
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(f @ p, -30, 30)))
            p -= np.linalg.solve(f.T @ (f * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2), f.T @ (q - y) + 1e-3 * (p - [1, 0]))
        self.scale, self.shift = p
        good = np.sort(z[y == 1])
        missed = (1 - recall) * len(good) - 2 * np.sqrt(recall * (1 - recall) * len(good))
        self.threshold = float(good[max(0, int(missed))])


#: Names that the made findings leave out, so that they can be asked of what was learnt: upper case with underscores, capitals without a joint.
HELD_OUT = {("_", str.upper), ("", str.capitalize)}


def labelled_findings(n: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """``n`` encoded candidates in context and whether each is a secret."""
    r = np.random.default_rng(seed)
    pick = lambda s, k: "".join(s[i] for i in r.integers(0, len(s), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda a, b: int(r.integers(a, b))
    of = lambda *options: options[some(0, len(options))]
    syllable = lambda: of("b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "br", "ch", "th", "pl", "gr", "tr", "qu", "") + of("a", "e", "i", "o", "u", "ea", "ou", "io") + of("", "", "n", "r", "s", "t", "l", "ng", "nt", "ck", "rd", "m", "x", "y")
    word = lambda: "".join(syllable() for _ in range(some(1, 4))) or "a"
    prose = lambda k: " ".join(word() for _ in range(k))
    path = lambda a, b: "/".join(word() for _ in range(some(a, b)))
    alphabets = (low + dig, low + up + dig, low + up + dig, low + up + dig + "+/", low + up + dig + "-_", up + dig, "abcdef" + dig, low + up)
    key = lambda a, b: pick(of(*alphabets), some(a, b))

    def name() -> str:
        """Words in a case, joined in some way, with a number behind or between: names of things in code, files and links."""
        join, cased = of("_", "-", "/", "", "_", "-"), of(str, str.capitalize, str.upper)
        if (join, cased) in HELD_OUT:
            cased = str
        parts = [cased(word()) for _ in range(some(3, 10))]
        if r.random() < 0.3:
            parts.insert(some(1, len(parts) + 1), pick(dig, some(1, 7)))
        return join.join(parts)

    def grouped_key() -> str:
        letters = of(low + dig, up + dig, "abcdef" + dig, low + up + dig)
        return of("-", "_").join(pick(letters, some(3, 11)) for _ in range(some(4, 8)))

    secrets = (
        lambda: key(20, 65),
        lambda: key(20, 65),
        lambda: pick(low + up + dig + "+/", some(24, 64)) + "=" * some(0, 3),
        lambda: "AKIA" + pick(up + dig, 16),
        lambda: pick(low, 2) + "_" + pick(low, 4) + "_" + key(16, 40),
        lambda: of(pick(low, 3), word()) + of("_", "-") + key(20, 40),
        # groups of a key, a key behind a long path, and one joined to a long name
        lambda: grouped_key(),
        lambda: grouped_key(),
        lambda: path(6, 24) + "/" + key(24, 48),
        lambda: "_".join(word() for _ in range(some(8, 16))) + "=" + key(28, 48),
    )
    harmless = (
        name, name, name, name,
        lambda: path(10, 40),
        lambda: path(8, 24) + "/" + pick(dig, some(1, 9)) + "/" + word(),
        lambda: "_".join(word() for _ in range(some(8, 24))) + "=" + word(),
        lambda: "".join(word() for _ in range(some(5, 9))),
        lambda: pick("=-_+", 1) * some(20, 60),
        lambda: pick(dig, some(20, 40)),
        lambda: of("-", "/", "_").join(pick(dig, some(2, 6)) for _ in range(some(5, 8))),
        lambda: pick(low + up + dig, 1) * some(20, 40),
        lambda: of("sha1", "sha512", "md5", "SHA1", "sha224") + "-" + pick(low + up + dig + "+/", some(24, 64)) + "=" * some(0, 3),
    )
    before = (lambda: prose(3) + " ", lambda: prose(3) + " ", lambda: "key = ", lambda: "secret: '", lambda: '"auth": "', lambda: "Bearer ", lambda: "http://" + word() + ".example.com/", lambda: word() + "(", lambda: "")
    after = (lambda: " " + prose(2), lambda: '"', lambda: "'", lambda: ".", lambda: "\n", lambda: "")
    x, y = [], np.zeros(n, np.float32)
    for k in range(n):
        y[k] = k % 2
        make = secrets if k % 2 else harmless
        left, body, right = (t[r.integers(0, len(t))]() for t in (before, make, after))
        while not CANDIDATE.fullmatch(body):
            body = make[r.integers(0, len(make))]()
        x.append(encode(left + body + right, len(left), len(left) + len(body)))
    return x, y


@lru_cache(maxsize=4)
def trained(seed: int = 17, findings: int = 8000, recall: float = 0.985) -> Network:
    """The network, from ``findings`` labelled findings of which a quarter calibrates it."""
    x, y = labelled_findings(findings, seed)
    cut = findings * 3 // 4
    net = Network(seed)
    net.fit(x[:cut], y[:cut], 6, seed)
    net.calibrate(x[cut:], y[cut:], recall)
    return net


def rows_to_search(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that hold a keyword, or a run long enough for another pattern or a candidate."""
    found = []
    for inside, least in ((_HEX, 24), (_TOKEN, 20)):
        starts, ends, _ = K.tokens(data, off, inside[data])
        found.append(starts[ends - starts >= least])
    low = K.LOWER[data].tobytes()
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            found.append(np.array([at]))
            at = low.find(word, at + 1)
    return np.unique(np.searchsorted(off, np.concatenate(found), "right") - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), k, m.end()) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    return sorted(out)


def spans_of(texts: list[str], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, probability) of each text, in order: the patterns' spans, and the candidates the network accepts."""
    base = [base_spans(t) for t in texts]
    asked = [(k, *span) for k, spans in enumerate(base) for span in spans]
    for k, text in enumerate(texts):
        taken = [(s, e) for s, _, e in base[k]]
        asked += [(k, m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if not any(s < m.end() and m.start() < e for s, e in taken)]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if asked:
        logits = net.logits([encode(texts[k], s, e) for k, s, _, e in asked])
        for (k, s, kind, e), z, p in zip(asked, logits, net.calibrated(logits), strict=True):
            if kind < 3 or z >= net.threshold:
                out[k].append((s, kind, e, float(p)))
    return [sorted(x) for x in out]


def _per_row(column: pa.Array, net: Network) -> list[list[tuple[int, int, int, float]]]:
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(column))]
    for a, _, data, off in K.chunks(column):
        rows = rows_to_search(data, off)
        texts = [data[off[r] : off[r + 1]].tobytes().decode() for r in rows]
        for r, spans in zip(rows, spans_of(texts, net), strict=True):
            out[a + r] = spans
    return out


SPAN = "array<struct<kind:string,start:long,end:long,probability:double>>"


def secret_spans(docs: DataFrame, seed: int = 17, recall: float = 0.985) -> DataFrame:
    """(doc_id, spans): every secret of every row of ``docs``, in code points, the end exclusive.

    Spans of the fixed patterns come back whatever their probability; a candidate that overlaps none
    of them comes back as kind ``model`` if its logit reaches the threshold. A null or empty
    text has none; of a very long one all is searched, and a candidate of any length is read whole. Repeated rows come back each; extra columns are ignored; an empty table gives no rows.
    """
    net = trained(seed, recall=recall)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "probability": p} for s, k, e, p in spans] for spans in _per_row(batch.column(1), net)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def redact_secrets(docs: DataFrame, mark: str = "[secret]", seed: int = 17, recall: float = 0.985) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; ``n_chars``, where there is one, follows the text.

    Overlapping spans become one mark. Texts without secrets, nulls among them, stay as they are, very long ones are searched whole, and
    repeated rows, extra columns and an empty table come back as such.
    """
    net = trained(seed, recall=recall)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = batch.column(at).to_pylist(), {}
            for r, spans in enumerate(_per_row(batch.column(at), net)):
                if spans:
                    out, done = [], 0
                    for s, _, e, _ in spans:
                        if s >= done:
                            out += [texts[r][done:s], mark]
                        done = max(done, e)
                    texts[r] = "".join([*out, texts[r][done:]])
                    lengths[r] = len(texts[r])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in names and lengths:
                have = batch.column(names.index("n_chars"))
                columns[names.index("n_chars")] = pa.array([lengths.get(r, v) for r, v in enumerate(have.to_pylist())], have.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

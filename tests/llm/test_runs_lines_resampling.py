"""Periodic runs, shared lines and resampling against plain versions, with nulls, blanks, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import kernels, periodic_runs, queries, resampling
from strandline.llm.line_dedup import dedup_lines

DOCS = "doc_id long, text string, line string, place string, body string, keeper string, gone string, lines string, runs string, strongest string, rank string, _open string, score string, bucket string, n_words string"
CLASH = ("clash",) * 13
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], DOCS)


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(24, 3 * q) and not any(all(w[j] == w[j + p] for j in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_words_against_every_period():
    r = random.Random(1)
    cases = [[], [1] * 23, [1] * 24, [1] * 500, [0, 1] * 30, fibonacci(700), [1, 2] * 11 + [1], [1, 2, 3, 4, 5, 6, 7, 8] * 3, list(range(9)) * 3, (list(range(9)) * 3)[:26], list(range(200)) * 3]
    for _ in range(250):
        w = []
        while len(w) < r.randrange(20, 260):
            p = [r.randrange(r.choice((2, 3, 50))) for _ in range(r.choice((1, 2, 3, 5, 8, 9, 20)))]
            w += p * r.randrange(1, 9) + p[: r.randrange(len(p))] + [r.randrange(3) for _ in range(r.choice((0, 0, 1, 5)))]
        cases.append(w)
    hits = 0
    for w in cases:
        got = periodic_runs.runs_of(np.array(w, np.int64))
        assert got == plain_runs(w)
        hits += len(got)
    assert hits > 300
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(9, np.int64), 10, 2)


def test_runs_of_other_thresholds_are_those_that_reach_them():
    w = [1] * 30 + [2, 3] * 20 + list(range(20)) * 5
    assert periodic_runs.runs_of(np.array(w), 40, 4) == [x for x in plain_runs(w) if x[1] >= 40 and x[1] >= 4 * x[2]]


def test_z_function():
    r = random.Random(2)
    for _ in range(200):
        s = [r.randrange(2) for _ in range(r.randrange(30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) if i else 0 for i in range(len(s))]
        assert periodic_runs.z_function(s) == want


def plain_op11(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_against_every_period(spark, tmp_path):
    r = random.Random(3)
    words = ["ba", "de", "né", " x", "\x1cz", "日本"]
    rows = [(i, r.choice((" ", "\n ", "\t")).join(r.choice(words) + r.choice(("", str(r.randrange(99)))) for _ in range(r.randrange(1, 300)))) for i in range(150)]
    rows += [(1000 + i, ("one two three " * r.randrange(1, 40)) + " ".join(words * i)) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, "a b " * 30), (rows[3][0], rows[3][1]), (rows[4][0], "a " * 50)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_op11(*x) for x in rows)


def plain_lines(rows, least_docs=3, least_chars=20):
    def key(line):
        return line.encode().translate(LOWER).strip(b"\x20\x09\x0a\x0b\x0c\x0d").decode()

    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(d := held.get(key(x), ())) >= least_docs and i != max(d))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_against_plain_version(spark, tmp_path):
    r = random.Random(5)
    shared = [f"Shared line number {k} of this table" for k in range(6)] + ["ÉCOLE line that is shared by some", "école line that is shared by some", "Kelvin sign in a line that is shared", "ſhort s in a line that is shared by", "short", "x" * 19, "y" * 20, "é" * 20]
    rows = []
    for i in range(80):
        lines = [r.choice(shared) if r.random() < 0.4 else f"own line {r.random()}" for _ in range(r.randrange(1, 15))]
        lines = [r.choice(("", " ", "\t", " ")) + (x.upper() if r.random() < 0.1 and x.isascii() else x) + r.choice(("", "\r", " \x0b")) for x in lines]
        rows.append((i, "\n".join(lines) + r.choice(("", "\n", "\n\n"))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, shared[0] + "\nmine"), (3, rows[3][1]), (4, "\n".join(shared)), (-7, "\n".join(shared[:3] * 2))]
    got = dedup_lines(table(spark, rows))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    want = plain_lines(rows)
    assert Counter(map(tuple, got.collect())) == Counter(want) and sum(x[2] for x in want) > 100
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    query = queries.op12_line_dedup(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, query)) == Counter((i, n, d, sha(t)) for i, n, d, t in want)


def test_crcs_of_runs_of_words_are_those_of_their_strings():
    import pyarrow as pa

    r = random.Random(6)
    texts = [" ".join("".join(r.choice("aBc9é日") for _ in range(r.choice((1, 2, 7, 39, 40, 41, 300)))) for _ in range(r.randrange(0, 12))) for _ in range(60)] + [None, "", "-- --", "one"]
    got, total = Counter(), 0
    for a, b, data, off in kernels.chunks(pa.array(texts, pa.string()), 500):
        crcs, rows, _ = resampling.ngram_crcs(data, off, 4)
        got.update((a + int(i), int(c)) for cs, at in zip(crcs, rows, strict=True) for c, i in zip(cs, at, strict=True))
        total += b - a
    want = Counter()
    for i, t in enumerate(texts):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(LOWER))
        want.update((i, zlib.crc32(b" ".join(w[j : j + n]))) for n in range(1, 5) for j in range(len(w) - n + 1))
    assert total == len(texts) and got == want
    assert resampling.shift(np.array([zlib.crc32(b"ab")], np.uint32), np.array([10**6]))[0] == zlib.crc32(b"ab" + bytes(10**6)) ^ zlib.crc32(bytes(10**6))


def plain_draw(rows, target, percent, least, longest, buckets, seed):
    def features(t):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(LOWER))
        return len(w), [zlib.crc32(b" ".join(w[j : j + n])) % buckets for n in range(1, longest + 1) for j in range(len(w) - n + 1)]

    own = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for (i, _), (n, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= least and x[0] is not None), key=lambda x: (-x[4], x[0]))
    place = {id(x): k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return [(x[0], *x[2:], place.get(id(x))) for x in out]


@pytest.mark.parametrize(("percent", "longest", "buckets"), [(10, 1, 10_000), (37, 3, 50)])
def test_draw_against_plain_version(spark, percent, longest, buckets):
    r = random.Random(7)
    words = [f"w{k}é" for k in range(40)] + ["UPPER", "日本", "K"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice((3, 19, 20, 60))))) for i in range(200)] + [(300, None), (301, ""), (302, "- -"), (None, "x " * 30), (5, "again " * 25)]
    target = [" ".join(words[:9]), None, "", "w1é w2é"]
    got = resampling.resample(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, longest, buckets, 2024)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_draw(rows, target, percent, 20, longest, buckets, 2024)
    assert Counter(map(tuple, got.collect())) == Counter(want) and sum(x[4] is not None for x in want) > 5
    assert {g.rank for g in resampling.resample(table(spark, rows[:50]), spark.createDataFrame([], "text string")).collect()} >= {None, 1}


SOME = random.Random(8)
LONG = [
    " ".join(str(SOME.randrange(10**6)) for _ in range(200_000)),
    "one two three four " * 40_000,
    "a line of twenty characters and more\n" * 20_000,
    "".join(f"line {k} that is of some length\n" for k in range(60_000)),
]


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_line_dedup", "op13_resample"])
def test_empty_tables_and_very_long_texts(spark, tmp_path, name):
    query = queries.QUERIES[name]
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert query(spark, f"{tmp_path}/none").count() == 0
    one, two, three, four, five, six, seven = [i for i in range(20) if zlib.crc32(str(i).encode()) % 10][:7]  # none gets a periodic end
    rows = [*zip((one, two, three, four), LONG, strict=True), (five, LONG[3]), (six, LONG[3]), (seven, LONG[2]), (seven, LONG[2])]
    table(spark, rows).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/some/benchmark.parquet")
    got = query(spark, f"{tmp_path}/some").collect()
    assert len(got) == len(rows)
    own = {g.doc_id: g for g in got}
    if name == "op11_periodic_runs":
        assert own[one].n_runs == 0 and (own[two].start, own[two].length, own[two].period, own[two].exponent_milli) == (0, 160_000, 4, 40_000_000)
        assert own[two].collapsed_sha256 == sha("one two three four") and own[three].length == 7 * 20_000 and own[four].n_runs == 0
    elif name == "op12_line_dedup":
        assert [(i, own[i].n_lines, own[i].n_dropped) for i in (three, four, six)] == [(three, 20_001, 0), (four, 60_001, 60_000), (six, 60_001, 0)]
        assert own[five].kept_sha256 == sha("") and own[six].kept_sha256 == sha(LONG[3])
    else:
        want = plain_draw(rows, ["one two"], 10, 20, 1, 10_000, 2024)
        assert Counter(map(tuple, got)) == Counter(want)

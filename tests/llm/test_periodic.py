"""Periodic runs against every period at every place, sums of squared differences against plain ones, and odd rows."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from fleetward.llm import periodic, queries

SF = "/root/testdata/sf0.001"
NOTHING = hashlib.sha256(b"").hexdigest()


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)  # smaller periods come first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain(doc_id, text, rewrite=True):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    w = [p for p in text.split(" ") if p]
    n = len(w)
    if rewrite and doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def words(rnd, most):
    n, k = rnd.randint(0, most), rnd.choice([1, 2, 3, 5, 50])
    w = [f"w{rnd.randrange(k)}" for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if n > 8:
            a = rnd.randrange(n)
            p = rnd.randint(1, max(1, (n - a) // 4 + 1))
            e = rnd.randint(a, n)
            for i in range(a + p, e):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("most,times", [(12, 300), (60, 300), (900, 12)])
def test_runs_of_sequences(most, times):
    rnd = random.Random(most)
    for _ in range(times):
        w = words(rnd, most)
        numbers = {x: i for i, x in enumerate(dict.fromkeys(w))}
        assert periodic.find_runs(np.array([numbers[x] for x in w], np.int64)) == plain_runs(w)


@pytest.mark.parametrize("width", [1, 2, 4, 64, 512])
def test_sums_are_exact(width):
    rnd = np.random.default_rng(width)
    blocks, windows = rnd.integers(0, 1 << 20, (5, width)), rnd.integers(0, 1 << 20, (5, 2 * width))
    want = np.array([[int(((b - w[i : i + width]) ** 2).sum()) for i in range(width)] for b, w in zip(blocks, windows, strict=True)])
    for prime, generator in periodic._PRIMES:
        got = periodic.mismatches(blocks.astype(np.uint64), windows.astype(np.uint64), prime, generator)
        assert (got.astype(np.int64) == want % prime).all()


def test_rows(spark):
    rnd = random.Random(8)
    rows = [(i, " \t".join(words(rnd, 120))) for i in range(300)]
    rows += [(None, "a a a a a a a"), (None, None), (7, None), (8, ""), (9, " \n "), rows[5], rows[5], (10, "a\xa0b " * 9), (11, "É é " * 5)]
    rows += [(1012, "x " * 40_000), (1013, "x y " * 20_000 + "z")]
    df = spark.createDataFrame([(i, t, "s", 3) for i, t in rows], "doc_id long, text string, id string, start int").repartition(3)
    got = periodic.periodic_runs(df, rewrite=True)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    small = [r for r in rows if r[0] not in (1012, 1013)]
    assert sorted(map(repr, (tuple(r) for r in got.collect() if r.doc_id not in (1012, 1013)))) == sorted(map(repr, (plain(*r) for r in small)))
    long = {r.doc_id: tuple(r)[1:6] for r in periodic.periodic_runs(df).collect() if r.doc_id in (1012, 1013)}
    assert long == {1012: (1, 0, 40_000, 1, 40_000_000), 1013: (1, 0, 40_000, 2, 20_000_000)}
    assert plain(7, None)[6:] == (NOTHING, NOTHING)
    assert {plain(*r) for r in small if r[0] is None} <= {tuple(r) for r in got.collect()}


def test_texts_over_many_sequences(monkeypatch):
    rnd = random.Random(9)
    texts = [(i, [x.encode() for x in words(rnd, 80)]) for i in range(60)]
    together = list(periodic.described(texts))
    apart = [next(iter(periodic.described([t]))) for t in texts]
    assert together == apart == [plain(i, b" ".join(w).decode(), rewrite=False) for i, w in texts]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    small = {i for i, t in docs.items() if len((t or "").split()) < 1500}
    assert len(small) > 0.8 * len(docs)
    assert {i: got[i] for i in small} == {i: plain(i, docs[i]) for i in small}


def test_no_rows(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []

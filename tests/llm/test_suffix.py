"""Repeated passages against a table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fleetward.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rnd, length, n=60):
    def prose(size):
        return "".join(rnd.choice(["the ", "of ", "and ", "é", "ab", "x", "qu", "\n"]) for _ in range(size))

    passages = [prose(length // 2 + rnd.randint(0, length)) for _ in range(5)]
    texts = [None, "", "short", "a" * (length * 3), "ab" * length, "a" * (length - 1), "b" * length, "b" * length, "c" * (length + 1)]
    for _ in range(n):
        texts.append("".join(rnd.choice([prose(rnd.randint(0, length)), rnd.choice(passages)]) for _ in range(rnd.randint(1, 5))))
    texts += texts[10:14] + [texts[20][:-1], "z" + texts[21], texts[22] + texts[22]]
    return texts


def test_cover_meets_every_shift():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))


@pytest.mark.parametrize("seed", range(12))
def test_a_block(seed):
    rnd = random.Random(seed)
    length = rnd.choice([32, 40, 64, 100])
    data = b"".join((t or "").encode() for t in corpus(rnd, length, 25)) * rnd.choice([1, 1, 2])
    at = np.arange(len(data) - length + 1)
    count = Counter(data[i : i + length] for i in at.tolist())
    want = [count[data[i : i + length]] > 1 for i in at.tolist()]
    assert sd.repeated(data, at, length).tolist() == want
    some = np.array(sorted(rnd.sample(at.tolist(), len(at) // 3)))
    count = Counter(data[i : i + length] for i in some.tolist())
    assert sd.repeated(data, some, length).tolist() == [count[data[i : i + length]] > 1 for i in some.tolist()]


def test_a_hot_prefix_with_unlike_ends():
    rnd = random.Random(1)
    head = bytes(rnd.choices(b"abc", k=60))
    data = b"".join(head + bytes(rnd.choices(b"abcdefgh", k=40)) for _ in range(3000))
    at = np.arange(0, len(data) - 63, 1)
    count = Counter(data[i : i + 64] for i in at.tolist())
    assert sd.repeated(data, at, 64).tolist() == [count[data[i : i + 64]] > 1 for i in at.tolist()]


def test_fragments_cover_every_suffix(monkeypatch):
    rnd = random.Random(6)
    data = bytes(rnd.choices(b"abcd", k=5000)) + b"e" * 3000
    for segment in (sd.SEGMENT, 700):
        monkeypatch.setattr(sd, "SEGMENT", segment)
        sd._powers.cache_clear()
        found = list(sd.fragments(data, 100))
        assert [i for _, s, n, _, _ in found for i in range(s, s + n)] == list(range(len(data) - 99))
    sd._powers.cache_clear()


@pytest.mark.parametrize(("length", "block", "hot"), [(400, 1 << 22, 1 << 22), (400, 3000, 1 << 22), (64, 2000, 900), (400, 1 << 22, 1)])
def test_removed_bytes(spark, length, block, hot):
    texts = corpus(random.Random(length + hot), length)
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    rows += [(None, texts[30], 1), rows[31], rows[31]]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    got = sorted(repr(tuple(r)) for r in sd.remove_repeats(df, length=length, block=block, hot=hot).collect())
    want = sorted(repr((r[0], *b)) for r, b in zip(rows, brute([r[1] for r in rows], length), strict=True))
    assert got == want


def test_kept_bytes_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x" * 500 + "tail"), (2, "other")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in sd.remove_repeats(df, keep_bytes=True).collect()}
    assert got == {1: b"tail", 2: None}
    assert sd.remove_repeats(df.limit(0)).count() == 0

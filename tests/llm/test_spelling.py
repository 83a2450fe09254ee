"""Spelling variants against all pairs, SQL, and odd rows."""

import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest

from fleetward.llm import queries, spelling
from fleetward.plans.staging import Run

SF = "/root/testdata/sf0.001"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= 5 and c >= 3}
    out, forms = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (len(close), forms[w])
    result = []
    for w, (k, form) in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        result.append((w, form, root, n[w], k, n.get(form)))
    return sorted(result, key=repr)


def sample(seed):
    rnd = random.Random(seed)
    letters = "abcdeé÷ß"
    stems = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 9))) for _ in range(25)] + ["é" * 80, "q" * 300]
    words = list(stems)
    for stem in stems:
        for _ in range(6):
            i = rnd.randrange(len(stem))
            stem = rnd.choice([stem[:i] + stem[i + 1 :], stem[:i] + rnd.choice(letters) + stem[i + 1 :], stem[:i] + rnd.choice(letters) + stem[i:]])
            words.append(stem)
    weights = [rnd.choice([1, 2, 5, 12, 40]) for _ in words]
    rows = [(i, " ".join(rnd.choices(words, weights, k=60)).title()) for i in range(60)]
    return [*rows, (None, "abcde ABCDE Abcde"), rows[3], rows[3], (900, None), (901, ""), (902, "1 2 -"), (903, "ŒUVRE ÀÉÎÕÜ àéîõü " * 4)]


@pytest.mark.parametrize("seed,most", [(1, spelling.FILTERS), (2, 1)])
def test_all_pairs(spark, seed, most):
    rows = sample(seed)
    df = spark.createDataFrame([(i, t, "x", 4) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = spelling.spelling_variants(df, most=most)  # one piece a pass in the second case
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_chains_of_forms(spark):
    words = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg", "lkjihg"]
    text = " ".join(w for i, w in enumerate(words) for _ in range(3 * 2**i))
    got = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame([(None, text)], "doc_id long, text string")).collect()}
    whole = {w: r for w, r in got.items() if w in words}
    assert [whole[w].form for w in words] == [*words[1:], None]
    assert {r.root for r in whole.values()} == {words[-1]}


def test_pieces_of_filters_hold_every_word(spark):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(30_000)})
    blocks = {8: 3 * spelling.PIECE}
    ranks = next(spelling._by_length(words))[2]
    hashes = spelling._hashes(ranks)
    block = spelling._place(hashes, blocks[8]).astype(np.int64)
    pieces = []
    for piece in range(3):
        import pyarrow as pa

        here = block // spelling.PIECE == piece
        rows = pa.table({"block": (block[here] % spelling.PIECE).astype(np.int32), "h": hashes[here].view(np.int64)})
        pieces.append((8, piece, spelling._built((pa.scalar(8), pa.scalar(piece)), rows)["bits"][0].as_py()))
    whole = spelling.Filters(blocks, pieces)
    assert len(whole.hits(8, hashes)) == len(words)
    parts = [spelling.Filters(blocks, [p]).hits(8, hashes) for p in pieces]
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(words)))
    other = spelling._hashes(next(spelling._by_length(sorted({w[::-1] + "z" for w in words})))[2])
    assert len(whole.hits(8, other)) < 0.01 * len(other)
    assert len(spelling._passes(blocks, 1)) == 3 and len(spelling._passes(blocks, 1 << 30)) == 1


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op11_spelling_variants"])
    assert [d[0] for d in want.description] == COLUMNS
    assert sorted(map(tuple, queries.QUERIES["op11_spelling_variants"](spark, SF).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).collect() == []
    run = Run(spark, "spelling-test")
    assert spelling.near_pairs(spark, spark.createDataFrame([], "word string, n long"), run).collect() == []
    run.drop()

"""Embedding links against all pairs."""

import math

import numpy as np
import pytest

from fleetward.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rep int"


def brute(rows, threshold=0.93):
    """vec_id -> (links, component) over rows with unlike ids."""
    good = {}
    for vec, emb, label, *_ in rows:
        if label is not None and emb and all(x is not None and math.isfinite(x) for x in emb) and any(emb):
            good[vec] = (label, np.array(emb, np.float32).astype(float))
    links = {vec: set() for vec, *_ in rows}
    for a, (la, x) in good.items():
        for b, (lb, y) in good.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for vec in sorted(links):
        if vec not in comp:
            todo = [vec]
            while todo:
                v = todo.pop()
                if v not in comp:
                    comp[v] = vec
                    todo += links[v]
    return {v: (len(links[v]), comp[v]) for v in links}


def sample(seed):
    rng = np.random.default_rng(seed)
    rows, vec = [], 0
    for label in range(3):
        for _ in range(60):
            center = rng.standard_normal(16)
            for k in range(int(rng.integers(1, 5))):
                x = center + rng.standard_normal(16) * (0.0 if k == 2 else 0.25)
                rows.append((vec := vec + 1, [float(v) for v in x.astype(np.float32)], label, "n", 1))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 16, [1.0] * 16, [2.0] * 16, [1.0] * 15]
    rows += [(1000 + i, e, label, "n", 1) for i, e in enumerate(odd) for label in (0,)] + [(2000, [1.0] * 16, None, "n", 1)]
    return rows


@pytest.mark.parametrize("block", [8, 1024])
def test_links_and_components(spark, block):
    rows = sample(block)
    got = {r.vec_id: r for r in ed.embedding_dedup(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    missed = sum(want[v][0] - got[v].n_links for v in want)
    assert all(got[v].n_links <= want[v][0] for v in want)
    assert missed <= 0.01 * sum(n for n, _ in want.values())
    for v, (n, c) in want.items():
        if missed == 0:
            assert (got[v].n_links, got[v].component_id) == (n, c)
        assert got[v].kept == (got[v].component_id == v)


def test_exact_where_buckets_split(spark, monkeypatch):
    """A dense ball of unlike vectors: every pair is found, in blocks, once."""
    rng = np.random.default_rng(2)
    center = rng.standard_normal(32)
    rows = [(i, [float(x) for x in (center + 0.02 * rng.standard_normal(32)).astype(np.float32)], 1, "", 0) for i in range(300)]
    rows += [(500 + i, rows[0][1], 1, "", 0) for i in range(200)]
    got = {r.vec_id: r for r in ed.embedding_dedup(spark.createDataFrame(rows, SCHEMA), block=32).collect()}
    assert {r.n_links for r in got.values()} == {499} and {r.component_id for r in got.values()} == {0}


def test_repeated_ids_null_ids_and_no_rows(spark):
    rows = [(1, [1.0, 0.0], 1, "", 0), (1, [1.0, 0.0], 1, "", 0), (2, [0.0, 1.0], 1, "", 0), (None, [0.0, 1.0], 1, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(repr, map(tuple, ed.embedding_dedup(df).collect())))
    assert got == sorted(map(repr, [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)]))
    assert ed.embedding_dedup(df.limit(0)).count() == 0


def test_tables_follow_size_and_recall():
    for n in (1, 1000, 10**9):
        planes, tables = ed.tables_for(n)
        same = 1 - math.acos(0.93) / math.pi
        assert 1 - (1 - same**planes) ** tables >= ed.RECALL

"""SimHash groups against all pairs, buckets of every size, and odd rows."""

import random

import numpy as np
import pytest
import xxhash

from fleetward.llm import lost, simhash
from fleetward.llm.components import connected_components


def plain_simhash(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    parts = [p for p in low.split(" ") if p]
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, radius=3):
    """prints: (id, fingerprint); component of each row by comparing all pairs."""
    todo, comp = set(range(len(prints))), {}
    while todo:
        queue = [todo.pop()]
        found = list(queue)
        while queue:
            x = queue.pop()
            near = [y for y in todo if (prints[x][1] ^ prints[y][1]).bit_count() <= radius]
            todo.difference_update(near)
            queue += near
            found += near
        ids = [prints[i][0] for i in found if prints[i][0] is not None]
        comp |= {i: min(ids, default=None) for i in found}
    return [comp[i] for i in range(len(prints))]


TEXTS = [None, "", " \t\n", "One", "one", "one two", "a b c", "A  B\tc", "a\x1cb\xa0c d", "ÉCOLE école x y", "x " * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.simhash(text) == plain_simhash(text)


def test_groups_and_odd_rows(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(120):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 200))]
        rows.append((1000 + 10 * i, " ".join(base)))
        for k in range(1, rnd.randint(1, 4)):
            base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            rows.append((1000 + 10 * i - 3 * k, " ".join(base)))
    rows += [(None, "x " * 5000), rows[40], rows[40]]
    df = spark.createDataFrame([(i, t, "a", 7) for i, t in rows], "doc_id long, text string, fp string, component int")
    got = sorted(map(repr, ((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(df).collect())))
    prints = [(i, plain_simhash(t)) for i, t in rows]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, groups(prints), strict=True)]
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("radius", [0, 1, 3, 9])
def test_flat_tree(radius):
    rnd = random.Random(radius)
    center = rnd.getrandbits(64)
    keys = list({center ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 6))) & (1 << 64) - 1 for _ in range(500)})
    tree = simhash.BKTree()
    for key in keys:
        tree.add(key)
    wanted = [*keys[::7], rnd.getrandbits(64)]
    flat, edges, firsts = (np.array(x, t) for x, t in zip(tree.flat(), (np.uint64, np.int64, np.int64), strict=True))
    at, node = simhash.near_nodes(flat.view(np.int64), edges, firsts, np.array(wanted, np.uint64).view(np.int64), radius)
    got = sorted((wanted[a], int(flat[b])) for a, b in zip(at, node, strict=True))
    assert got == sorted((w, k) for w in wanted for k in keys if (w ^ k).bit_count() <= radius)
    assert all(sorted(keys[i] for i in tree.within(w, radius)) == [k for x, k in got if x == w] for w in wanted)


@pytest.mark.parametrize(("shard", "trees"), [(4, 1024), (4, 0), (64, 1024), (4096, 1024)])
def test_hot_buckets(spark, shard, trees):
    rnd = random.Random(shard)
    center, other = rnd.getrandbits(64), rnd.getrandbits(64)
    prints = {center, other, 0, (1 << 64) - 1}
    while len(prints) < 300:  # a dense ball, and a set that shares two blocks
        x = center
        for _ in range(rnd.randint(1, 3)):
            x ^= 1 << rnd.randrange(64)
        prints |= {x, other ^ (rnd.getrandbits(32) << 16)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    comps = {r.id: r.component for r in connected_components(simhash.near_edges(df, 3, shard, trees)).collect()}
    assert [comps.get(s, s) for s in signed] == groups(list(zip(signed, prints, strict=True)))


def test_components_of_paths_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(5000, i) for i in range(5001, 5400)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(chain + star, "a long, b long").repartition(7)
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {i: 5000 for i in range(5000, 5400)}
    assert connected_components(df.limit(0)).count() == 0


def test_empty_table(spark):
    assert simhash.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [lost.BROADCAST_ROWS, 0])
def test_one_of_each_group_stays(spark, monkeypatch, most):
    monkeypatch.setattr(lost, "BROADCAST_ROWS", most)
    rows = [(3, "a b c d", 1), (1, "a b c d", 2), (2, "q w e r t y u i o p", 3), (None, "q w e r t y u i o p", 4)]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, n long, __lost string, first boolean")
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(r.n for r in got.collect()) == [2, 3, 4]

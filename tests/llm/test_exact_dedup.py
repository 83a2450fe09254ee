"""Exact copies against a plain table of texts, hot or not."""

import hashlib
import random
import re

import pytest

from fleetward.llm import exact_dedup as ex
from fleetward.llm import lost


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    ids = {}
    for (i, _), n in zip(rows, norm, strict=True):
        ids.setdefault(n, []).append(i)
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        keep = min((x for x in ids[n] if x is not None), default=None)
        out.append((i, keep, len(ids[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return out


def sample(seed):
    rnd = random.Random(seed)
    texts = [None, "", " ", "\n\t ", "a b", "a \t\r\nb", " a b", "a b ", "a\xa0b", "a\x1cb", "É", "x" * 100_000, "x" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, rnd.choice(["hot text", "hot  text", f"text {rnd.randint(0, 60)}"])) for i in range(400)]
    rows += [(None, "hot text"), (None, "only null"), (None, "only null"), (100, rows[13][1]), (100, "other text")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("counters", [2, 5, 200])
def test_groups(spark, counters):
    rows = sample(counters)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, digest int, id string")
    got = ex.exact_dedup(df.repartition(5), counters=counters)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("most", [lost.BROADCAST_ROWS, 0])
def test_rows_that_stay(spark, monkeypatch, most):
    monkeypatch.setattr(lost, "BROADCAST_ROWS", most)  # broadcast, or not
    rows = sample(1)
    df = spark.createDataFrame([(i, t, k, "x", "y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, digest int, __id string, kept string")
    got = ex.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(r.digest for r in got.collect()) == [k for k, b in enumerate(brute(rows)) if b[3]]


def test_native_plan_and_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ex.exact_dedup(df).count() == 0 and ex.drop_copies(df).count() == 0
    plan = ex.exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan

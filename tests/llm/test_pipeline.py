"""The pipeline, stage by stage, against plain versions."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from fleetward.llm import packing, pii, toxicity
from tests.llm.test_pii import plain
from tests.llm.test_simhash import groups, plain_simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input of the first stage, and the result of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(10_000, None, "en", "s", None), (10_001, "", None, None, 0), (10_002, "mail a.b@c.example.com or +1 (555) 555-0123", "en", "s", 43)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    out = [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_toxicity_stage(spark, steps):
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    gain = model.gain()
    want = {r.doc_id for r in steps[0] if model.score(toxicity.features(gain, r.text)) < 0.5}
    assert by_id(steps[1]).keys() == want and all(by_id(steps[0])[r.doc_id] == r for r in steps[1])


def test_exact_stage(steps):
    first = {}
    for r in steps[1]:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[key] = min(first.get(key, r.doc_id), r.doc_id)
    assert by_id(steps[2]).keys() == set(first.values())


def test_near_stage(steps):
    prints = [(r.doc_id, plain_simhash(r.text)) for r in steps[2]]
    want = {i for (i, _), c in zip(prints, groups(prints), strict=True) if i == c}
    assert by_id(steps[3]).keys() == want


def test_pii_stage(steps):
    before = by_id(steps[3])
    assert by_id(steps[4]).keys() == before.keys()
    for r in steps[4]:
        old = before[r.doc_id].text
        spans = sorted((s, e, k) for k, found in plain(old or "").items() for s, e in found)
        want, at = [], 0
        for s, e, k in spans:
            if s >= at:
                want += [(old or "")[at:s], f"[{k}]"]
                at = e
        want = "".join([*want, (old or "")[at:]])
        if old is None:
            assert r.text is None and r.n_chars is None
        else:
            assert r.n_chars == len(r.text)
            if not any(pii.find(old, pii.Model())[0].values()) or pii.masked(old, pii.Model()) == r.text:
                assert r.text == want
    assert "a.b@c" not in (by_id(steps[4])[10_002].text if 10_002 in before else "")


def test_packing_stage(steps):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = set()
    for r in steps[4]:
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want |= {(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {tuple(r)[:5] for r in steps[5]} == want
    used = len({r.sequence_id for r in steps[5]})
    assert -(-sum(w[3] for w in want) // 1024) <= used <= len(packing.best_fit([w[3] for w in want], 1024))


def test_run_is_all_stages(spark, steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    got = {tuple(r)[:5] for r in cp.run(spark, SF).collect()}
    added = {10_000, 10_001, 10_002}
    assert {g for g in got if g[0] not in added} >= {tuple(r)[:5] for r in steps[5] if r.doc_id not in added}

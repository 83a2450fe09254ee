"""Languages on held-out documents, the filter, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from fleetward.llm import language as lg

SF = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def model(spark):
    return lg.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lg.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    right = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(right) >= 0.97 * len(right)


def test_all_languages_of_a_gram(model):
    own = model.filter()
    for bit, grams in enumerate(model.grams):
        word = np.full(len(grams), ~np.uint64(0))
        for slots in lg._slots(grams):
            word &= own.words[slots]
        assert (word >> np.uint64(bit) & np.uint64(1)).all()
    shared = set(model.grams[0].tolist()) & set(model.grams[1].tolist())
    assert shared  # a gram of two languages has both bits


def test_false_positives_are_corrected(model):
    own = model.filter()
    noise = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(60_000))
    found, total, seen = own.counts(noise)
    assert seen and (found <= 0.003 * total).all()


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 !? \n"), (None, "the and of the with"), (5, "the " * 400_000), (5, "der und die nicht")]
    docs = spark.createDataFrame([(i, t, "xx", 1) for i, t in rows], "doc_id long, text string, lang_pred string, score int")
    got = {(r.doc_id, r.lang_pred) for r in lg.identify(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(got) == 6
    assert (5, "en") in got and (5, "de") in got
    assert {r.lang_pred for r in lg.identify(docs, lg.learn(docs.limit(0).withColumnRenamed("lang_pred", "lang"))).collect()} == {"und"}
    assert lg.identify(docs.limit(0), model).count() == 0


def test_blocks_hold_the_whole_text(model, monkeypatch):
    own = model.filter()
    text = "the and of with a short sentence " * 300
    whole = own.counts(text)[0]
    monkeypatch.setattr(lg, "BLOCK", 1000)
    assert np.allclose(own.counts(text)[0], whole, rtol=0.03)


def words_of(k, rnd):
    """Prose of an invented language: letters of its own."""
    return " ".join("".join(chr(0x4E00 + 40 * k + rnd.randrange(12)) for _ in range(rnd.randint(2, 6))) for _ in range(80))


def test_more_languages_than_bits_of_a_word(spark):
    rnd = random.Random(5)
    names = [f"l{k:03}" for k in range(150)]
    rows = [(len(names) * i + k, words_of(k, rnd), n) for i in range(4) for k, n in enumerate(names)]
    model = lg.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == names
    own = model.filter()
    assert [own.predict(words_of(k, rnd))[0] for k in range(len(names))] == names
    assert own.predict("12 !")[0] == "und" and lg.fit({}).filter().predict("word") == ("und", 0.0)


def test_a_language_fitted_alone_is_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {}
    for r in lg.sampled(docs).collect():
        texts.setdefault(r.lang, []).append(r.text)
    together, apart = lg.fit({k: sorted(v) for k, v in texts.items()}), lg.learn(docs)
    assert together.languages == apart.languages and together.reach == apart.reach
    assert all((a == b).all() for a, b in zip(together.grams, apart.grams, strict=True))


def test_long_texts_shared_ids_and_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(lg, "SAMPLE", 20)
    rnd = random.Random(6)
    rows = [(None, words_of(0, rnd), "many") for _ in range(300)] + [(None, "same words", "many")] * 3000
    rows += [(7 if not held(7) else 8, words_of(1, rnd), "one id") for _ in range(300)]
    rows += [(None, words_of(2, rnd) * 100, "long") for _ in range(30)] + [(None, words_of(3, rnd), "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    got = lg.sampled(docs).collect()
    sizes = {n: sum(r.lang == n for r in got) for n in ("many", "one id", "long", "rare")}
    assert sizes == {"many": 20, "one id": 20, "long": 20, "rare": 1}
    assert len({(r.lang, r.text) for r in got}) == len(got) and max(len(r.text) for r in got) == lg.SAMPLE_CHARS
    assert lg.learn(docs).languages == ["long", "many", "one id", "rare"]


def test_blocks_change_no_count(model, monkeypatch):
    own = model.filter()
    text = "Groß und ΣΑΣ İstanbul, the and of\n" * 50
    whole = own.counts(text)
    monkeypatch.setattr(lg, "BLOCK", 64)
    assert own.counts(text)[1:] == whole[1:] and np.allclose(own.counts(text)[0], whole[0])

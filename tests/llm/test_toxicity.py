"""Toxicity on held-out documents, and odd rows."""

import random
import zlib

import pytest

from fleetward.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def model(spark):
    return tox.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = tox.score_toxicity(docs, model).join(labels, "doc_id").select("held_out", "predicted", "toxic", "doc_id", "score").collect()
    assert all(r.held_out == held(r.doc_id) and (r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)
    toxic = [r.predicted for r in rows if r.held_out and r.toxic]
    clean = [r.predicted for r in rows if r.held_out and not r.toxic]
    # few labels: some 330 toxic documents to learn from
    assert sum(toxic) >= 0.4 * len(toxic)
    assert sum(clean) <= 0.02 * len(clean)


def test_labels_of_held_out_rows_are_not_read(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tox.learn(docs, flipped) == model


def test_odd_rows(spark, model):
    rows = [(1, None, 5), (2, "", 5), (None, " \n", 5), (4, "x" * 300_000, 5), (4, "plain words", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = tox.score_toxicity(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and all(r.predicted == 0 for r in got)
    assert {r.doc_id: r.held_out for r in got} == {1: held(1), 2: held(2), None: False, 4: held(4)}
    assert tox.drop_toxic(docs, model).columns == docs.columns and tox.drop_toxic(docs, model).count() == 5
    assert tox.score_toxicity(docs.limit(0), model).count() == 0


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more words", "x") for i in range(40)], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert tox.score_toxicity(docs, tox.learn(docs, none)).count() == 40
    some = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 0)], "doc_id long, toxic int")
    assert tox.score_toxicity(docs, tox.learn(docs, some)).count() == 40
    empty = docs.limit(0)
    assert tox.score_toxicity(docs, tox.learn(empty, some)).count() == 40


def test_windows_hold_the_whole_text():
    rnd = random.Random(2)
    text = " ".join("ab" * rnd.randint(1, 200) for _ in range(300))
    assert b"".join(b"".join(tox.windows(text)).split()) == text.replace(" ", "").encode()
    assert max(map(len, tox.windows(text))) <= tox.WINDOW


def test_words_of_one_class_are_learned():
    """Invented words that only toxic documents hold, one or two in each, are told from prose never seen."""
    rnd = random.Random(11)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "io", "u", "an")]
    marks = ["zwokkurq", "vyxjimbo", "hjuwkexy", "qozzivak"]

    def prose(marked):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(60, 300))]
        for _ in range(rnd.randint(2, 3) if marked else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(marks))
        return " ".join(words)

    model = tox.fit([prose(False) for _ in range(800)], [prose(True) for _ in range(800)], 0.5)
    gain = model.gain()
    found = [model.score(tox.features(gain, prose(True))) >= 0.5 for _ in range(150)]
    wrong = [model.score(tox.features(gain, prose(False))) >= 0.5 for _ in range(150)]
    assert sum(found) >= 0.9 * len(found) and sum(wrong) <= 0.05 * len(wrong)


def test_an_id_of_many_rows_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(tox, "SAMPLE", 20)
    rows = [(i, f"word{i}") for i in range(10)] + [(3, f"other{i}") for i in range(400)] + [(4, "copy")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    known = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, y int")
    got = [tuple(r) for r in tox.sampled(docs, known).collect()]
    assert len(got) == len(set(got)) and {i for _, i, _ in got} == set(range(10))
    assert sum(y == 1 for y, _, _ in got) == 20 and sum(y == 0 for y, _, _ in got) == 6


def test_ids_without_a_text_and_long_texts_do_not_use_up_the_sample(spark, monkeypatch):
    monkeypatch.setattr(tox, "SAMPLE", 10)
    monkeypatch.setattr(tox, "SAMPLE_CHARS", 50)
    rows = [(i, f"id{i} " + "long " * 40 if i % 2 else f"id{i}") for i in range(20)] + [(i, None) for i in range(20, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(2000)], "id long, y int")
    got = [tuple(r) for r in tox.sampled(docs, known).collect()]
    assert {i for _, i, _ in got} == set(range(20)) and len(got) == 20
    assert all(t == rows[i][1][:50] for _, i, t in got)
    assert tox.sampled(docs.limit(0), known).count() == 0 and tox.sampled(docs, known.limit(0)).count() == 0

"""Toxicity by compression distance.

A window of text is compressed by zstandard twice: with a dictionary of ordinary text, and with the same dictionary
after one of toxic text.  What the toxic dictionary saves (the *gain* of the window, in bytes) is zero for ordinary
prose, since all it has in common with toxic prose is in both.  A document is judged by its two windows of largest gain
and its number of windows, through a logistic curve calibrated on labelled documents that no dictionary was trained on.

Toxic documents are mostly ordinary prose, so their dictionary is trained in rounds.  The first is trained on all windows
of one half of the toxic sample and balanced by an ordinary one of the same size; then the windows of the other half that
gain more than nearly all ordinary windows train the next, and the halves change places.  Repeated windows count once,
and windows that the dictionary explains almost wholly are copied passages, not usage: they train nothing.

The dictionaries and the curve are fitted on a bounded sample: at most ``SAMPLE`` documents of each label, the first ones
in the order of a hash of their id among those that have a text, each up to its first ``SAMPLE_CHARS`` characters; repeated
rows count once, and rows that share an id come after one row of every id.  Only the sample goes to the driver.  Scoring
reads every whole text.

Defined results: a null or blank text has no window and gets the score of no gain; rows that repeat an id are scored one
by one; a row whose id is null is not held out; labels that are null, or whose document is missing, teach nothing; with
no document of one of the labels every score is the share of toxic ones; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most sampled documents of each label, and characters of a sampled document.
SAMPLE, SAMPLE_CHARS = 2000, 20_000
#: Most bytes of a window.
WINDOW = 160
#: Bytes of the dictionaries: of ordinary text, of all toxic text, of the windows that gain.
ORDINARY_BYTES, WHOLE_BYTES, TOXIC_BYTES = 1 << 19, 1 << 16, 6000
#: Segment and word length that dictionary training looks for in toxic text.
SEGMENT, WORD = 20, 8
ROUNDS = 5
#: How many ordinary documents taken for toxic weigh as much as one toxic document that is missed.
MISS = 4
#: Share of ordinary windows below the gain that marks a window, and the part of a window whose saving marks a copy.
QUIET, COPIED = 0.998, 1 / 8
_SEARCH = {
    "window_log": 20, "chain_log": 19, "hash_log": 18, "search_log": 6, "min_match": 4, "target_length": 256, "strategy": 5,
}
_CUT = re.compile(rb"\S(?:.{0,%d}\S)?(?!\S)|\S{1,%d}" % (WINDOW - 2, WINDOW), re.S)


def windows(text: str | None) -> Iterator[bytes]:
    """The whole text in lower case, cut between words; only a longer word is cut itself."""
    return (m.group() for m in _CUT.finditer((text or "").lower().encode("utf-8", "replace")))


def dictionary(samples: list[bytes], size: int, **how: int) -> bytes:
    """A zstandard dictionary's bytes; samples too few to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(**_SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=how)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=how)


class Gain:
    """Bytes that the toxic dictionary saves on a window."""

    def __init__(self, base: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = compressor(base), compressor(toxic)

    def __call__(self, window: bytes) -> int:
        return len(self.ordinary.compress(window)) - len(self.toxic.compress(window))


def features(gain: Gain, text: str | None) -> tuple[float, float, float]:
    """The two largest gains, and the logarithm of the number of windows."""
    first = second = count = 0
    for window in windows(text):
        count += 1
        g = min(gain(window), 12)
        if g > first:
            first, second = g, first
        elif g > second:
            second = g
    return float(first), float(second), math.log1p(count)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])

    def gain(self) -> Gain:
        return Gain(self.ordinary, self.toxic + self.ordinary)

    def score(self, x: tuple[float, float, float]) -> float:
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression with a constant, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(ordinary: list[str], toxic: list[str], share: float) -> Model:
    """``share``: the part of all labelled documents that is toxic, which the curve is calibrated to."""
    seen: set[bytes] = set()

    def fresh(texts: Iterable[str]) -> list[bytes]:
        return [w for t in texts for w in windows(t) if w not in seen and not seen.add(w)]

    if len(ordinary) < 2 or len(toxic) < 2:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(weights=[math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    texts = [toxic[: len(toxic) // 2], toxic[len(toxic) // 2 :]]
    learned, checked = ordinary[: len(ordinary) // 2], ordinary[len(ordinary) // 2 :]
    base_windows, quiet = fresh(learned), fresh(checked)
    halves = [fresh(texts[0]), fresh(texts[1])]
    base = dictionary(base_windows, ORDINARY_BYTES)
    how = {"k": SEGMENT, "d": WORD}
    words = dictionary(halves[0], WHOLE_BYTES, **how)
    against = dictionary(quiet, WHOLE_BYTES, **how) + base
    for turn in range(ROUNDS):
        gain = Gain(against, words + base)
        least = np.quantile([gain(w) for w in quiet] or [0], QUIET)
        marked = [w for w in halves[(turn + 1) % 2] if max(least, 0) < gain(w) <= len(w) * COPIED]
        words, against = dictionary(marked, TOXIC_BYTES, **how), base
    model = Model(base, words)
    gain = model.gain()
    held = texts[(ROUNDS + 1) % 2]
    x = np.array([features(gain, t) for t in [*checked, *held]])
    y = np.array([0] * len(checked) + [1] * len(held))
    weight = np.where(y == 1, MISS * share * len(y) / len(held), (1 - share) * len(y) / len(checked))
    model.weights = logistic(x, y, weight).tolist()
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``y, id, text``: at most ``SAMPLE`` different rows of each label ``id, y``, one of every sampled id before others."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    eligible = known.join(texts.select("id"), "id", "left_semi")
    picked = [eligible.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for y in (0, 1)]
    texts = texts.withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    rows = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").select("y", "id", "text").distinct()
    of_id = F.row_number().over(Window.partitionBy("y", "id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("of_id", of_id).where(F.col("of_id") <= SAMPLE)
    of_label = F.row_number().over(Window.partitionBy("y").orderBy("of_id", F.xxhash64("id"), "id"))
    return rows.withColumn("of_label", of_label).where(F.col("of_label") <= SAMPLE).select("y", "id", "text")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).distinct()
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = sampled(docs, known, id_col, text_col).collect()
    rows = sorted({(r.id, r.y, r.text) for r in rows}, key=lambda r: (shuffled(r[0]), r[2]))
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([t for _, y, t in rows if y == 0], [t for _, y, t in rows if y == 1], share)


def shuffled(doc_id: int) -> int:
    """An order of the sample that has nothing to do with the ids' own."""
    return int(doc_id) * 0x9E3779B97F4A7C15 % (1 << 64)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = model.gain()
        for batch in batches:
            scores = [model.score(features(gain, t.as_py())) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = model.gain()
        for batch in batches:
            keep = [model.score(features(gain, t.as_py())) < 0.5 for t in batch[text_col]]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

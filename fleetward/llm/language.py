"""Language identification with bit-sliced Bloom filters of n-grams.

One Bloom filter holds the most frequent character n-grams of every language: each slot has a bit per language, in as
many 64-bit words as the languages need, so the words at an n-gram's slots, combined by *and*, name all languages that
hold it at once.  Per language,
the bits over all n-grams of a text are counted, the count is corrected for the false positives that the filter's fill
predicts, and divided by what the language's own texts reach; the largest share decides.

Every language is learned.  It is fitted on a sample of its different (id, text) rows: ``SAMPLE`` of them in the order of
a hash, all if there are no more, and of each text the first ``SAMPLE_CHARS`` characters.  Each language is fitted in a
task of its own; only its n-grams go to the driver.
Prediction reads whole texts.  N-grams run over lower-cased letters; each other character counts as a space.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing was learned;
ties go to the language that sorts first; rows that repeat an id are judged one by one; an empty table gives an empty
result; language, source and id are never read by a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetward.plans.staging import materialize

GRAM = 4
#: Languages in a word, sampled documents of each language, characters of a sampled document.
BITS, SAMPLE, SAMPLE_CHARS = 64, 600, 20_000
#: Most frequent n-grams held per language; slots of the filter (a power of two); slots of an n-gram.
HELD, SLOTS, PROBES = 4000, 1 << 18, 2
#: Characters of a text that are looked at at a time.
BLOCK = 1 << 20
_SPACE = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _padded(text: str) -> str:
    return " " + text.lower() + " " * (GRAM - 1)


def gram_hashes(text: str) -> tuple[np.ndarray, bool]:
    """Hashes of the n-grams with a letter, and whether there is a letter."""
    return _hashes(_padded(text))


def _hashes(padded: str) -> tuple[np.ndarray, bool]:
    code = np.frombuffer(padded.encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.uint64), False
    code = np.where(letter, code, _SPACE).astype(np.uint64)
    count = np.concatenate([[0], np.cumsum(code != _SPACE)])
    h = np.zeros(len(code) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = (h + code[i : i + len(h)] + np.uint64(1)) * _STEP
        h ^= h >> np.uint64(29)
    return h[count[GRAM:] > count[:-GRAM]], True


def _slots(h: np.ndarray) -> list[np.ndarray]:
    bits = SLOTS.bit_length() - 1
    return [((h * _STEP) >> np.uint64(64 - bits * (p + 1))) & np.uint64(SLOTS - 1) for p in range(PROBES)]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)
    reach: list[float] = field(default_factory=list)

    def filter(self) -> Filter:
        return Filter(self)


class Filter:
    def __init__(self, model: Model) -> None:
        self.model = model
        # the words of the first BITS languages at every slot, then those of the next
        self.words = np.zeros(SLOTS * -(-len(model.languages) // BITS), np.uint64)
        fill = []
        for k, grams in enumerate(model.grams):
            word, bit = self.words[k // BITS * SLOTS :][:SLOTS], np.uint64(k % BITS)
            for slots in _slots(grams):
                word[slots] |= np.uint64(1) << bit
            fill.append(np.count_nonzero(word >> bit & np.uint64(1)) / SLOTS)
        self.false = np.array([f**PROBES for f in fill])

    def counts(self, text: str) -> tuple[np.ndarray, int, bool]:
        """Corrected numbers of n-grams per language, the number of n-grams, and whether there is a letter."""
        bits = np.zeros(len(self.model.languages))
        total, seen = 0, False
        padded = _padded(text)
        for at in range(0, len(padded) - GRAM + 1, BLOCK):  # blocks share the letters of the n-grams between them
            h, letters = _hashes(padded[at : at + BLOCK + GRAM - 1])
            seen |= letters
            total += len(h)
            at_slots = _slots(h)
            for first in range(0, len(bits), BITS):
                words = self.words[first // BITS * SLOTS :][:SLOTS]
                word = np.full(len(h), ~np.uint64(0))
                for slots in at_slots:
                    word &= words[slots]
                for k in range(first, min(first + BITS, len(bits))):
                    bits[k] += np.count_nonzero(word & np.uint64(1 << k - first))
        return np.maximum(bits - total * self.false, 0) / (1 - self.false), total, seen

    def predict(self, text: str | None) -> tuple[str, float]:
        found, total, seen = self.counts(text or "")
        if not seen or not len(found):
            return "und", 0.0
        share = found / total / np.array(self.model.reach)
        best = int(np.argmax(share))
        sum_ = share.sum()
        return self.model.languages[best], float(share[best] / sum_) if sum_ else 0.0


def fit(texts: dict[str, list[str]]) -> Model:
    """texts by language."""
    model = Model()
    for language in sorted(texts):
        found = [gram_hashes(t)[0] for t in texts[language]]
        grams, counts = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
        if len(grams):
            model.languages.append(language)
            model.grams.append(grams[np.lexsort((grams, -counts))[:HELD]])
    model.reach = [1.0] * len(model.languages)
    own = model.filter()
    for i, language in enumerate(model.languages):
        counted = [own.counts(t) for t in texts[language]]
        model.reach[i] = max(1e-6, sum(c[0][i] for c in counted) / sum(c[1] for c in counted))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, text``: of every language ``SAMPLE`` different rows, or all; counted and picked among the same rows."""
    span = 1 << 40
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    rows = rows.select("lang", F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(span)).alias("key"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    keys = materialize(rows.select("lang", "key").distinct(), "language-keys")
    sizes = materialize(keys.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # keys are spread evenly, so twice the sample lies below this bound and the ranking sees few rows
    some = keys.join(sizes, "lang").where(F.col("key").cast("double") * F.col("n") <= F.lit(float(span * 2 * SAMPLE)))
    ranked = some.select("lang", "key", F.row_number().over(Window.partitionBy("lang").orderBy("key")).alias("rank"))
    picked = materialize(ranked.where(F.col("rank") <= SAMPLE).select("lang", "key"), "language-sample")
    return rows.join(picked, ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows with a language that are not held out."""

    def fit_one(table: pa.Table) -> pa.Table:
        language = table["lang"][0].as_py()
        one = fit({language: sorted(table["text"].to_pylist())})
        grams = [g.astype("<u8").tobytes() for g in one.grams]
        return pa.table([pa.array(one.languages, pa.string()), pa.array(grams, pa.binary()), pa.array(one.reach, pa.float64())], ["lang", "grams", "reach"])

    fitted = sampled(docs, id_col, text_col, lang_col).groupBy("lang").applyInArrow(fit_one, "lang string, grams binary, reach double").collect()
    fitted.sort(key=lambda r: r.lang)
    return Model([r.lang for r in fitted], [np.frombuffer(r.grams, "<u8") for r in fitted], [r.reach for r in fitted])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.filter()
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch["text"]]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score"
    )

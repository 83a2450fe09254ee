"""Text functions over columns: line scan, redaction, entropy, matching."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import Pattern

# Marks around a match while a text is being cut into segments.
_OPEN, _CLOSE, _EXTRA = "\x01", "\x02", "\x03"

MATCH_TYPE = "array<struct<ord:int,line:int,match:string,extra:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: Pattern | Iterable[Pattern]) -> Column:
    """True where the pattern, or any pattern of a list, occurs in ``text``."""
    if isinstance(pattern, Pattern):
        return text.rlike(pattern.java)
    out = F.lit(False)
    for p in pattern:
        out = out | text.rlike(p.java)
    return out


def has_any(text: Column, *words: str) -> Column:
    """Byte-level substring test; the cheap gate put in front of a regex."""
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def group(text: Column, pattern: Pattern, idx: int) -> Column:
    return F.regexp_extract(text, pattern.java, idx)


def all_of(*conditions: Column) -> Column:
    """Conjunction that stops at the first false condition, in the given order.

    Plain ``&`` lets the engine hoist subexpressions that occur twice and evaluate
    them for every row; a condition behind a CASE is only evaluated when reached.
    """
    out = conditions[-1]
    for c in reversed(conditions[:-1]):
        out = F.when(c, out)
    return F.coalesce(out, F.lit(False))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def cut(text: Column, java_pattern: str, replacement: str) -> Column:
    """Split ``text`` into one segment per match of a pattern.

    ``replacement`` states what each segment starts with, between the marks.
    """
    marked = has_any(text, _OPEN, _CLOSE, _EXTRA)
    clean = F.when(marked, F.translate(text, _OPEN + _CLOSE + _EXTRA, "")).otherwise(text)
    return F.split(F.regexp_replace(clean, java_pattern, replacement), _OPEN)


# Segments walked at a time: arrays grow by copying, so a long one is put together from blocks.
_BLOCK = 2048


def _blocks(items: Column) -> Column:
    """An array as an array of arrays of at most ``_BLOCK`` items."""
    last = F.floor((F.size(items) - 1) / _BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))


def line_matches(text: Column, java_pattern: str, extra: str = "") -> Column:
    """All matches in order as ``array<struct<ord, line, match, extra>>``.

    The line is 1-based and counts the newlines before the match, so matches that
    span lines carry the line they start on.  ``extra`` names a capture (``$1``)
    taken in the context of the whole text, for lookaround captures.
    """

    def step(acc: Column, seg: Column) -> Column:
        match = F.substring_index(seg, _CLOSE, 1)
        rest = F.substring_index(seg, _EXTRA, -1)
        captured = F.substring_index(F.substring_index(seg, _EXTRA, 1), _CLOSE, -1)
        is_match = seg.contains(_CLOSE)
        row = F.struct(
            (F.size(acc["out"]) + 1).alias("ord"),
            (acc["n"] + 1).alias("line"),
            match.alias("match"),
            captured.alias("extra"),
        )
        return F.struct(
            (acc["n"] + F.when(is_match, newlines(match) + newlines(rest)).otherwise(newlines(seg))).alias("n"),
            F.when(is_match, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"),
        )

    def in_block(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("n"), F.array().cast(MATCH_TYPE).alias("out")), step)

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(
            block["out"],
            lambda m: F.struct(
                (m["ord"] + acc["k"]).alias("ord"), (m["line"] + acc["n"]).alias("line"), m["match"].alias("match"), m["extra"].alias("extra")
            ),
        )
        return F.struct(
            (acc["n"] + block["n"]).alias("n"),
            (acc["k"] + F.size(block["out"])).alias("k"),
            F.concat(acc["out"], F.array(moved)).alias("out"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.array().cast(f"array<{MATCH_TYPE}>").alias("out"))
    segments = cut(text, java_pattern, f"{_OPEN}$0{_CLOSE}{extra}{_EXTRA}")
    return let(segments, lambda s: F.aggregate(F.transform(_blocks(s), in_block), start, join, lambda acc: F.flatten(acc["out"])))


def scan(text: Column, pattern: Pattern) -> Column:
    """``line_matches`` of a catalogue pattern; empty where it does not occur."""
    return F.when(matches(text, pattern), line_matches(text, pattern.java)).otherwise(
        F.array().cast(MATCH_TYPE)
    )


def redact(value: Column) -> Column:
    """Keep a short recognisable prefix of a secret and mask the rest."""
    v = F.regexp_replace(value, Pattern(r"^\s+|\s+$").java, "")
    keep = F.least(F.lit(10), F.floor(F.length(v) / 3).cast("int"))
    return F.when(F.length(v) <= 8, F.lit("****")).otherwise(
        F.concat(F.substring(v, F.lit(1), keep), F.lit("…" + "*" * 6 + " (redacted)"))
    )


def text_entropy(text: Column) -> Column:
    """``shannon_entropy`` of whole texts, which counts characters in arrays, a batch of texts at a time.

    Not for values inside arrays of a row, which only column expressions reach.
    """

    def bits(raw: bytes | None) -> float | None:
        if raw is None:
            return None
        chars = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        share = np.unique(chars, return_counts=True)[1] / max(len(chars), 1)
        return 0.0 - float((share * np.log2(share)).sum())

    @F.pandas_udf("double")
    def of_batch(texts: pd.Series) -> pd.Series:
        return texts.map(bits)

    return of_batch(text.cast("binary"))


def shannon_entropy(value: Column) -> Column:
    """Bits per character; 0 for the empty string.  One pass over the sorted characters of a short value."""

    def bits(v: Column) -> Column:
        n = F.length(v).cast("double")

        def added(acc: Column) -> Column:
            share = acc["run"].cast("double") / n
            return F.when(acc["run"] > 0, acc["bits"] - share * F.log2(share)).otherwise(acc["bits"])

        def step(acc: Column, char: Column) -> Column:
            same = acc["char"] == char
            return F.struct(
                char.alias("char"),
                F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
                F.when(same, acc["bits"]).otherwise(added(acc)).alias("bits"),
            )

        start = F.struct(F.lit("").alias("char"), F.lit(0).alias("run"), F.lit(0.0).alias("bits"))
        return F.aggregate(F.sort_array(F.split(v, "")), start, step, added)

    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(let(value, bits))

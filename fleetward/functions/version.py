"""Dotted version numbers as ordered columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import patterns as p
from .text import let

_NAMES = ("major", "minor", "patch")
_PART = "decimal(38,0)"


def parse_version(raw: Column) -> Column:
    """First ``x.y.z``, else ``x.y``, else ``x`` after range operators; else NULL.

    The result is ``struct<major, minor, patch>`` of decimals, which compares in
    version order and holds the date-like parts a packed key could not.
    """
    text = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), p.VERSION_PREFIX.java, "")

    def parsed(t: Column, pattern, parts: int) -> Column:
        cells = [F.regexp_extract(t, pattern.java, i) if i <= parts else F.lit("0") for i in (1, 2, 3)]
        return F.struct(*[c.try_cast(_PART).alias(k) for c, k in zip(cells, _NAMES)])

    return let(
        text,
        lambda t: F.when(t.rlike(p.VERSION_3.java), parsed(t, p.VERSION_3, 3))
        .when(t.rlike(p.VERSION_2.java), parsed(t, p.VERSION_2, 2))
        .when(t.rlike(p.VERSION_1.java), parsed(t, p.VERSION_1, 1)),
    )


def version_literal(text: str) -> Column:
    return F.struct(*[F.lit(int(v)).cast(_PART).alias(k) for v, k in zip(text.split("."), _NAMES)])


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))


def in_range(v: Column, lo: Column, fixed: Column) -> Column:
    """Half-open: ``lo <= v < fixed``."""
    return (v >= lo) & (v < fixed)


def format_version(v: Column) -> Column:
    return F.when(v.isNotNull(), F.concat_ws(".", *[v[k].cast("string") for k in _NAMES]))

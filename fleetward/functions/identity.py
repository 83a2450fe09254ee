"""Identities of findings: dedupe keys, stable ids, package names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import patterns as p

_FNV_OFFSET, _FNV_PRIME = 2166136261, 16777619


def dedupe_key(rule_id: Column, file: Column, line: Column, url: Column) -> Column:
    cells = [rule_id, file, line.cast("string"), url]
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cells])


def finding_id(key: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of ``key``, base 36, padded to 7."""
    hexed = F.hex(F.encode(key, "UTF-16BE"))
    encoded = F.transform(
        F.sequence(F.lit(0), (F.length(hexed) / 4).cast("int") - 1),
        lambda i: F.conv(F.substring(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"),
    )
    plain = F.transform(F.split(key, ""), lambda c: F.ascii(c).cast("bigint"))  # a byte each
    units = (
        F.when(F.length(key) == 0, F.array().cast("array<bigint>"))
        .when(F.octet_length(key) == F.length(key), plain)
        .otherwise(encoded)
    )
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    hashed = F.aggregate(
        units,
        F.lit(_FNV_OFFSET).cast("bigint"),
        lambda h, u: (h.bitwiseXOR(u) * F.lit(_FNV_PRIME).cast("bigint")).bitwiseAND(mask),
    )
    return F.lpad(F.lower(F.conv(hashed.cast("string"), 10, 36)), 7, "0")


def canonical_identity(category: Column, file: Column, line: Column) -> Column:
    """One identity per secret location, whichever source reported it; else NULL."""
    return F.when(
        (category == "secrets") & (F.coalesce(file, F.lit("")) != ""),
        F.concat_ws("|", F.lit("secret"), file, F.coalesce(line.cast("string"), F.lit(""))),
    )


def dep_package(url: Column, evidence: Column, title: Column) -> Column:
    """Package name in front of ``@<digit>``, or NULL."""
    text = F.concat(
        F.coalesce(url, F.lit("")), F.lit(" "), F.coalesce(evidence, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))
    )
    return F.nullif(F.lower(F.regexp_extract(text, p.DEP_PACKAGE.java, 1)), F.lit(""))


def advisory_rule_id(prefix: str, advisory: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.regexp_replace(advisory, "[^A-Za-z0-9]", "_")))


def severity_rank(severity: Column) -> Column:
    """5 (critical) to 1 (info)."""
    return (
        F.when(severity == "critical", 5)
        .when(severity == "high", 4)
        .when(severity == "medium", 3)
        .when(severity == "low", 2)
        .when(severity == "info", 1)
    )

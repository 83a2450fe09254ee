"""The finding stream: suppress, contextualize, reconcile, dedupe."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import lists, patterns as p
from ..catalog.texts import VARIANTS, Variant
from ..functions.identity import canonical_identity, dedupe_key, dep_package
from ..functions.paths import path_class
from ..functions.secrets import classify_secret
from ..functions.text import let, matches
from ..plans.staging import shuffled
from ..schema import SIDE_CHANNEL, complete, with_title


def _location_text() -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("file", "url", "evidence")])


def drop_public_secrets(findings: DataFrame) -> DataFrame:
    """Secrets whose raw value is public by design; rows without a side channel pass."""
    if "raw" not in findings.columns:
        return findings
    public = (F.col("category") == "secrets") & (classify_secret(F.nullif("raw", F.lit(""))) == "public")
    public = F.coalesce(public, F.lit(False))
    return findings.where(~public)


def drop_static_rate_limits(findings: DataFrame) -> DataFrame:
    """Missing-rate-limit findings on static assets."""
    return findings.where(
        ~(matches(F.col("rule_id"), p.RATE_LIMIT_RULE) & matches(_location_text(), p.STATIC_ASSET))
    )


def downrank_public_cors(findings: DataFrame) -> DataFrame:
    """Open origins on a documented public API are probably meant."""
    meant = (F.col("rule_id") == "WEB_CONFIG_CORS_WILDCARD_CREDENTIALS") & matches(_location_text(), p.PUBLIC_API)
    return findings.withColumn("confidence", F.when(meant, "low").otherwise(F.col("confidence")))


def strip_side_channel(findings: DataFrame) -> DataFrame:
    """Remove raw values.  Nothing may be persisted or written before this."""
    return findings.drop(*SIDE_CHANNEL)


def suppress(findings: DataFrame, variants: Mapping[str, Variant] = VARIANTS) -> DataFrame:
    found = complete(findings, variants)
    return downrank_public_cors(strip_side_channel(drop_static_rate_limits(drop_public_secrets(found))))


def contextualize(findings: DataFrame) -> DataFrame:
    """Downgrade findings outside production code; never raises anything.

    ``note_class`` keeps the path class whose note goes in front of the impact text.
    """
    engine_secret = (F.col("category") == "secrets") & (F.col("source") != "native")
    prose = F.col("category").isin(*lists.CONTENT_DOWNGRADED) | engine_secret

    def downgraded(cls: Column) -> Column:
        return F.when(cls.isin("docs", "example", "test", "build") | ((cls == "content") & prose), cls)

    cols = findings.columns
    return (
        findings.withColumn("note_class", let(path_class(F.col("file")), downgraded))
        .withColumn(
            "severity",
            F.when(F.col("note_class").isNotNull() & F.col("severity").isin("critical", "high", "medium"), "low")
            .otherwise(F.col("severity")),
        )
        .withColumn("confidence", F.when(F.col("note_class").isNotNull(), "low").otherwise(F.col("confidence")))
        .select(*cols, "note_class")
    )


def route_deps(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependency findings, all others)."""
    is_dep = F.col("category") == "dependencies"
    return findings.where(is_dep), findings.where(~is_dep)


def reconcile_deps(findings: DataFrame, variants: Mapping[str, Variant] = VARIANTS) -> DataFrame:
    """Engine findings of a package replace native ones of the same package.

    A native finding that names no package never matches and stays.  Engine rows
    keep their package key out of the anti join's left side, so a package that is
    frequent across targets is still keyed by (target, package).
    """
    deps, rest = route_deps(findings)
    cols = findings.columns
    keyed = with_title(deps, variants).withColumn("pkg", dep_package(F.col("url"), F.col("evidence"), F.col("title")))
    from_engine = F.col("source") == "osv-scanner"
    reported = keyed.where(from_engine & F.col("pkg").isNotNull()).select("target_id", "pkg").distinct()
    native = keyed.where(~from_engine).join(shuffled(reported), ["target_id", "pkg"], "left_anti")
    return rest.unionByName(native.select(*cols)).unionByName(deps.where(from_engine))


def identity() -> Column:
    """Key two findings of a target share when they are the same issue."""
    return F.coalesce(
        canonical_identity(F.col("category"), F.col("file"), F.col("line")),
        dedupe_key(F.col("rule_id"), F.col("file"), F.col("line"), F.col("url")),
    )


def dedupe(findings: DataFrame) -> DataFrame:
    """First finding per (target, identity): native before engines, then rule order.

    A minimum over ordered structs is combined on the map side, so any number of
    copies of one finding reaches the shuffle as one row per task.
    """
    order = ["phase", "rule_ord", "file", "emit_src", "emit_ord"]
    rest = [c for c in findings.columns if c not in order and c != "target_id"]
    return (
        findings.withColumn("ident", identity())
        .groupBy("target_id", "ident")
        .agg(F.min(F.struct(*order, *rest)).alias("f"))
        .select("target_id", *[f"f.{c}" for c in findings.columns if c != "target_id"])
    )


def judge(raw_findings: DataFrame, variants: Mapping[str, Variant] = VARIANTS) -> DataFrame:
    """What is decided row by row, from rule output alone."""
    return contextualize(suppress(raw_findings, variants))


def settle(judged: DataFrame, variants: Mapping[str, Variant] = VARIANTS) -> DataFrame:
    """From judged findings to final ones; reads its input once per route, so it should be a staged table."""
    return dedupe(reconcile_deps(judged, variants))

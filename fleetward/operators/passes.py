"""Passed checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import lists
from ..plans.staging import shuffled
from ..schema import PASS_COLUMNS, lookup


def mode_match(targets: DataFrame) -> DataFrame:
    """Rules applicable to each target by mode; the rule list is a fixed constant."""
    rows = [(i, *r) for i, r in enumerate(lists.RULES, start=1)]
    rules = lookup(targets.sparkSession, rows, "rule_ord int, rule string, category string, rule_mode string")
    wanted = F.when(F.col("type") == "url", "blackbox").otherwise("whitebox")
    return (
        targets.crossJoin(F.broadcast(rules))
        .where((F.col("rule_mode") == "both") | (F.col("rule_mode") == wanted))
        .select("target_id", "type", "rule_ord", "rule", "category")
    )


def clean_categories(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """"Checked and found nothing" passes of five categories.

    A category counts where a rule of it applied to the target type, and any
    surviving finding denies it.  Found categories are a set of at most ten values
    per target, so one aggregate and one join decide all five passes.
    """
    ran = {
        kind: {c for _, c, m in lists.RULES if m in ("both", mode)}
        for kind, mode in (("url", "blackbox"), ("repo", "whitebox"))
    }
    found = findings.groupBy("target_id").agg(F.collect_set("category").alias("found"))
    rows = targets.join(shuffled(found), "target_id", "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<string>"))
    )
    passes = []
    for category, title, detail in lists.CLEAN_COVERAGE:
        kinds = [k for k, cats in ran.items() if category in cats]
        if not kinds:
            continue
        row = F.struct(
            F.lit(f"PASS_CLEAN_{category.upper()}").alias("id"),
            F.lit(category).alias("category"),
            F.lit(title).alias("title"),
            F.lit(detail).alias("detail"),
            F.when(F.col("type") == "url", "blackbox").otherwise("whitebox").alias("mode"),
        )
        passes.append(F.when(F.col("type").isin(*kinds) & ~F.array_contains("found", category), row))
    return rows.select("target_id", F.inline(F.filter(F.array(*passes), lambda r: r.isNotNull())))


def no_secrets(targets: DataFrame, secret_findings: DataFrame) -> DataFrame:
    """Scanned targets without a hardcoded secret (inferred)."""
    clean = targets.join(shuffled(secret_findings.select("target_id").distinct()), "target_id", "left_anti")
    pid, category, title, detail = lists.PASS_NO_SECRETS
    return clean.select(
        "target_id",
        F.lit(pid).alias("id"),
        F.lit(category).alias("category"),
        F.lit(title).alias("title"),
        F.lit(detail).alias("detail"),
        F.when(F.col("type") == "url", "blackbox").otherwise("whitebox").alias("mode"),
    )


def pass_dedupe(passes: DataFrame) -> DataFrame:
    """One pass per (target, id)."""
    rest = PASS_COLUMNS[2:]
    return passes.groupBy("target_id", "id").agg(F.min(F.struct(*rest)).alias("p")).select("target_id", "id", "p.*")

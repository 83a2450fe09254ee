"""Counts, score and grade per target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import lists
from ..plans.staging import shuffled


def penalty(severity: Column, confidence: Column) -> Column:
    """Weight × confidence in hundredths of a point, as an exact integer."""
    weight = F.lit(0)
    for name, w in lists.SEVERITY_WEIGHT.items():
        weight = F.when(severity == name, F.lit(w)).otherwise(weight)
    percent = F.lit(0)
    for name, c in lists.CONFIDENCE_PERCENT.items():
        percent = F.when(confidence == name, F.lit(c)).otherwise(percent)
    return weight * percent


def score_of(total_penalty: Column) -> Column:
    """100 minus the penalty, rounded half up, at least 0."""
    return F.greatest(F.lit(0), F.floor((F.lit(10_050) - total_penalty) / 100)).cast("int")


def grade_of(score: Column, confirmed_criticals: Column) -> Column:
    """Letter by score; a confirmed critical caps A to C at D."""
    letter = F.lit("F")
    for name, floor in reversed(lists.GRADE_FLOORS):
        letter = F.when(score >= floor, name).otherwise(letter)
    return F.when((confirmed_criticals > 0) & letter.isin("A", "B", "C"), "D").otherwise(letter)


def counts_by_severity(findings: DataFrame) -> DataFrame:
    """Per target with findings: counts, total penalty, confirmed criticals."""
    counts = [
        F.count_if(F.col("severity") == s).cast("int").alias(s) for s in lists.SEVERITIES
    ]
    confirmed = (F.col("severity") == "critical") & (F.col("confidence") != "low")
    return findings.groupBy("target_id").agg(
        *counts,
        F.sum(penalty(F.col("severity"), F.col("confidence"))).alias("penalty"),
        F.count_if(confirmed).alias("confirmed_criticals"),
    )


def grade(findings: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Counts, score and grade; with ``targets`` also for targets without findings."""
    counted = counts_by_severity(findings)
    if targets is not None:
        counted = targets.select("target_id").join(shuffled(counted), "target_id", "left").fillna(0)
    score = score_of(F.col("penalty"))
    return counted.select(
        "target_id",
        *lists.SEVERITIES,
        score.alias("score"),
        grade_of(score, F.col("confirmed_criticals")).alias("grade"),
    )


def ci_gate(graded: DataFrame) -> DataFrame:
    """Exit code 2 where the grade is F or any critical exists, whatever its confidence."""
    failing = (F.col("grade") == "F") | (F.col("critical") > 0)
    return graded.select("target_id", "grade", "critical", F.when(failing, 2).otherwise(0).alias("exit_code"))

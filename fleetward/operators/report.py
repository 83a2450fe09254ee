"""Reports: nested per target, flat listings, validation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import lists
from ..functions.identity import severity_rank
from ..schema import PUBLIC


class Reports(NamedTuple):
    summary: DataFrame  # one row per target
    details: DataFrame  # one row per finding, in report order


def location(findings: DataFrame) -> Column:
    """``file:line``, the file alone, else the URL, else nothing."""
    with_line = F.when(F.coalesce("line", F.lit(0)) != 0, F.concat_ws(":", "file", F.col("line").cast("string")))
    return F.when(F.coalesce("file", F.lit("")) != "", F.coalesce(with_line, F.col("file"))).otherwise(
        F.coalesce("url", F.lit(""))
    )


def listing(published: DataFrame) -> DataFrame:
    """The rows of the summary listing."""
    rank = severity_rank(F.col("severity"))
    return published.select("target_id", rank.alias("severity_rank"), "severity", "title", location(published).alias("location"))


def in_order(rows: DataFrame) -> DataFrame:
    """The listing, most severe first; a range sort, so no target is one task."""
    return rows.orderBy("target_id", F.desc("severity_rank"), "title", "location")


def findings_by_severity(published: DataFrame) -> DataFrame:
    """Summary listing in order."""
    return in_order(listing(published))


def order_key(findings: DataFrame) -> Column:
    """Report order inside a target: severity, then order of emission."""
    cells = [-severity_rank(F.col("severity")), "phase", "rule_ord", "file", "emit_src", "emit_ord", "rule_id", "line", "url"]
    names = ("rank", *cells[1:])
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(cells, names)])


def assemble(
    targets: DataFrame,
    graded: DataFrame,
    findings: DataFrame,
    passes: DataFrame,
    engines: DataFrame,
    started_at: str,
    finished_at: str,
) -> Reports:
    """A summary row per target (grade, counts, passes, engines) and the findings as its detail table.

    Details are range-sorted by target and report order, so a target with any number of findings has the same shape
    as all others and is no task of its own.  Passes are a list: a target has at most one of each of a fixed set of ids.
    ``findings`` are published rows that kept their ordering columns.
    """
    details = findings.withColumn("report_order", order_key(findings)).orderBy("target_id", "report_order").select(*PUBLIC, "report_order")
    pass_key = F.struct(
        F.collate("category", "UNICODE").alias("c"), F.collate("title", "UNICODE").alias("t"), F.col("id").alias("i")
    )
    passed = (
        passes.groupBy("target_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(pass_key.alias("k"), F.struct("id", "category", "title", "detail", "mode").alias("p")))),
                lambda x: x["p"],
            ).alias("passed")
        )
    )
    flags = F.struct(
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("semgrep", "gitleaks", "osv_scanner")]
    )
    summary = (
        targets.join(graded, "target_id")
        .join(passed, "target_id", "left")
        .join(engines, "target_id", "left")
        .select(
            "target_id",
            F.struct("type", "value").alias("target"),
            F.lit(started_at).alias("started_at"),
            F.lit(finished_at).alias("finished_at"),
            "grade",
            "score",
            F.struct(*lists.SEVERITIES, F.coalesce(F.size("passed"), F.lit(0)).alias("passed")).alias("counts"),
            F.coalesce("passed", F.array()).alias("passed"),
            flags.alias("engines"),
        )
    )
    return Reports(summary, details)


def write_reports(reports: Reports, path: str, run_date: str) -> None:
    """Summaries and details as JSON lines, one folder each per run date.

    Only the folders of this run are replaced, so a failed run can be repeated.
    """
    reports.summary.write.mode("overwrite").json(f"{path}/summary/run_date={run_date}")
    reports.details.drop("report_order").write.mode("overwrite").json(f"{path}/details/run_date={run_date}")


_ENUMS = {
    "category": lists.CATEGORIES,
    "severity": lists.SEVERITIES,
    "confidence": lists.CONFIDENCES,
    "mode": lists.MODES,
    "source": lists.SOURCES,
}
_REQUIRED = ("target_id", "rule_id", "title", "why")
#: Every field of a published finding that is checked, and those that compact rows have.
ALL_FIELDS = (*_ENUMS, *_REQUIRED, "line")
COMPACT_FIELDS = ("category", "severity", "confidence", "source", "target_id", "rule_id", "line")
PASS_FIELDS = ("category", "mode", "target_id", "id", "title")
GRADE_FIELDS = ("target_id", "grade", "score")


def _check(field: str) -> Column:
    """True where the field keeps to the report schema."""
    value = F.col(field)
    if field in _ENUMS:
        return value.isin(*_ENUMS[field])
    if field == "grade":
        return value.isin(*lists.GRADES)
    if field == "score":
        return value.between(0, 100)
    if field == "line":
        return value.isNull() | (value >= 0)
    return value.isNotNull()


def violations(fields: Sequence[str] = ALL_FIELDS) -> Column:
    """Names of the fields of a row that break the report schema, in the given order; every field has to be there."""
    return F.concat_ws(",", *[F.when(F.coalesce(_check(f), F.lit(False)), F.lit(None)).otherwise(f) for f in fields])


def split_valid(rows: DataFrame, fields: Sequence[str] = ALL_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``violations``)."""
    checked = rows.withColumn("violations", violations(fields))
    return checked.where("violations = ''").drop("violations"), checked.where("violations <> ''")


def require_valid(rows: DataFrame, fields: Sequence[str] = ALL_FIELDS) -> DataFrame:
    """Fail the job on the first row that breaks the schema."""
    bad = violations(fields)
    ok = F.assert_true(bad == "", F.concat(F.lit("invalid finding fields: "), bad))
    return rows.where(ok.isNull())

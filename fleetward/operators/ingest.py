"""Reports of external engines (JSON text per target) to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.texts import GITLEAKS_HISTORY_NOTE, OSV_UNFIXED_NOTE
from ..functions.paths import relative_path
from ..functions.secrets import classify_secret
from ..functions.version import parse_version
from ..schema import hit, one_hit

_RANGES = "array<struct<events:array<struct<introduced:string,fixed:string>>>>"
_AFFECTED = f"array<struct<package:struct<name:string>,database_specific:struct<severity:string>,ranges:{_RANGES}>>"
_VULN = (
    "struct<id:string,database_specific:struct<severity:string>,"
    f"severity:array<struct<type:string>>,affected:{_AFFECTED}>"
)
GITLEAKS_SCHEMA = (
    "array<struct<Secret:string,Match:string,RuleID:string,Description:string,File:string,StartLine:int,Commit:string>>"
)
SEMGREP_SCHEMA = (
    "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,"
    "extra:struct<severity:string,message:string>>>,_broken:string>"
)
OSV_SCHEMA = (
    "struct<results:array<struct<packages:array<struct<package:struct<name:string,version:string>,"
    f"database_specific:struct<severity:string>,vulnerabilities:array<{_VULN}>>>>>,_broken:string>"
)


def parse_reports(reports: DataFrame, engine: str) -> DataFrame:
    """``target_id, root, report_id, data`` of the reports that are valid JSON."""
    schema = {"gitleaks": GITLEAKS_SCHEMA, "semgrep": SEMGREP_SCHEMA, "osv-scanner": OSV_SCHEMA}[engine]
    options = {} if engine == "gitleaks" else {"columnNameOfCorruptRecord": "_broken"}
    # ``inline`` keeps the filters below from parsing the text once more each
    parsed = F.inline(F.array(F.struct(F.from_json("raw", schema, options).alias("data"))))
    rows = reports.where((F.col("engine") == engine) & F.col("raw").isNotNull()).select("target_id", "root", "report_id", parsed)
    if engine == "gitleaks":
        return rows.where(F.col("data").isNotNull())
    return rows.where(F.col("data._broken").isNull()).withColumn("data", F.col("data.results")).where(
        F.col("data").isNotNull()
    )


def report_items(reports: DataFrame, engine: str) -> DataFrame:
    """One row per entry of the valid reports, in report order."""
    return parse_reports(reports, engine).select(
        "target_id", "root", "report_id", F.posexplode("data").alias("pos", "r")
    )


def engine_flags(reports: DataFrame) -> DataFrame:
    """Which engines ran per target."""

    def ran(engine: str) -> Column:
        return F.bool_or(F.col("engine") == engine)

    return reports.groupBy("target_id").agg(
        ran("semgrep").alias("semgrep"), ran("gitleaks").alias("gitleaks"), ran("osv-scanner").alias("osv_scanner")
    )


def report_order() -> Column:
    """Reports of a target in the order of their ids: numbers by value, then other ids by text."""
    text = F.col("report_id").cast("string")
    return F.when(text.rlike("^[0-9]{1,38}$"), F.concat(F.lit("0"), F.lpad(text, 38, "0"))).otherwise(F.concat(F.lit("1"), text))


def ingest_gitleaks(reports: DataFrame) -> DataFrame:
    """Secrets of the report whose value is not public, graded by that value."""
    r = F.col("r")
    rows = (
        report_items(reports, "gitleaks")
        .withColumn("value", F.coalesce(r["Secret"], r["Match"], F.lit("")))
        .select("*", F.explode(F.array(classify_secret(F.col("value")))).alias("verdict"))
        .where((F.col("value") != "") & (F.col("verdict") != "public"))
    )
    history = F.when(F.coalesce(r["Commit"], F.lit("")) != "", GITLEAKS_HISTORY_NOTE).otherwise("")
    described = F.coalesce(r["Description"], r["RuleID"], F.lit("credential"))

    def as_hit(variant: str) -> Column:
        return hit(
            variant,
            rule_id=F.concat(F.lit("GITLEAKS_"), F.upper(F.coalesce(r["RuleID"], F.lit("SECRET")))),
            evidence=F.concat(F.substring("value", 1, 8), F.lit("… (redacted)")),
            file=relative_path(F.col("root"), r["File"]), line=r["StartLine"], params=[described, history],
            ord=F.col("pos"), src=report_order(), raw=F.col("value"), raw_line=r["Match"],
        )

    return one_hit(
        rows, F.when(F.col("verdict") == "dangerous", as_hit("gitleaks_dangerous")).otherwise(as_hit("gitleaks_other"))
    )


def ingest_semgrep(reports: DataFrame) -> DataFrame:
    r = F.col("r")
    level = r["extra"]["severity"]
    severity = F.when(level == "ERROR", "high").when(level == "WARNING", "medium").when(level == "INFO", "low")
    message = F.nullif(r["extra"]["message"], F.lit(""))
    return one_hit(
        report_items(reports, "semgrep"),
        hit(
            "semgrep",
            rule_id=F.concat(
                F.lit("SEMGREP_"), F.upper(F.element_at(F.split(F.coalesce(r["check_id"], F.lit("FINDING")), r"\."), -1))
            ),
            severity=F.coalesce(severity, F.lit("medium")), file=relative_path(F.col("root"), r["path"]),
            line=r["start"]["line"],
            params=[F.coalesce(F.substring(message, 1, 120), F.lit("Semgrep finding"))], ord=F.col("pos"), src=report_order(),
        ),
    )


# ---- dependency reports -----------------------------------------------------


def advisory_severity(vuln: Column, pkg: Column) -> Column:
    """Band of one advisory from its own label, its package's, or its first affected entry's."""
    label = F.upper(
        F.coalesce(
            vuln["database_specific"]["severity"],
            pkg["database_specific"]["severity"],
            F.get(vuln["affected"], F.lit(0))["database_specific"]["severity"],
            F.lit(""),
        )
    )
    rated = F.coalesce(F.size(vuln["severity"]) > 0, F.lit(False))
    return (
        F.when(label.contains("CRITICAL"), "critical")
        .when(label.contains("HIGH"), "high")
        .when(label.contains("MODERATE") | label.contains("MEDIUM"), "medium")
        .when(label.contains("LOW"), "low")
        .when(rated, "high")
        .otherwise("medium")
    )


def fixed_version(vuln: Column, name: Column) -> Column:
    """First ``fixed`` event for the package; entries without a name count too."""
    affected = F.filter(
        F.coalesce(vuln["affected"], F.array().cast(_AFFECTED)),
        lambda a: F.coalesce(a["package"]["name"], F.lit("")).isin("") | (a["package"]["name"] == name),
    )
    ranges = F.flatten(F.transform(affected, lambda a: F.coalesce(a["ranges"], F.array().cast(_RANGES))))
    events = F.flatten(
        F.transform(ranges, lambda g: F.coalesce(g["events"], F.array().cast("array<struct<introduced:string,fixed:string>>")))
    )
    fixes = F.filter(F.transform(events, lambda e: e["fixed"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.get(fixes, F.lit(0))


def advisory_rows(reports: DataFrame) -> DataFrame:
    """One row per advisory of a reported package, with its band and first fix."""
    packages = report_items(reports, "osv-scanner").select(
        "target_id", "report_id", "pos", F.posexplode(F.col("r.packages")).alias("pkg_pos", "pkg")
    )
    vulns = packages.select(
        "target_id", "report_id", "pos", "pkg_pos", "pkg", F.posexplode(F.col("pkg.vulnerabilities")).alias("v_pos", "vuln")
    )
    name = F.coalesce(F.col("pkg.package.name"), F.lit("dependency"))
    return vulns.select(
        "target_id", "report_id", "pos", "pkg_pos", "v_pos",
        name.alias("name"),
        F.coalesce(F.col("pkg.package.version"), F.lit("unknown")).alias("version"),
        F.coalesce(F.col("vuln.id"), F.lit("ADVISORY")).alias("advisory"),
        advisory_severity(F.col("vuln"), F.col("pkg")).alias("severity"),
        fixed_version(F.col("vuln"), name).alias("fixed"),
    )


def max_fix(versions: Column) -> Column:
    """Highest parseable version of an array, the earliest of equals; NULL if none."""
    keyed = F.filter(
        F.transform(versions, lambda v, i: F.struct(parse_version(v).alias("k"), (-i).alias("i"), v.alias("v"))),
        lambda x: x["k"].isNotNull(),
    )
    return F.array_max(keyed)["v"]


_BANDS = ("low", "medium", "high", "critical")


def ingest_osv(reports: DataFrame) -> DataFrame:
    """One finding per reported package, computed inside its report row.

    A package and its advisories sit in one JSON entry, so grouping them is array
    work without any shuffle.
    """
    vuln_type = "array<struct<id:string,severity:string,fixed:string>>"
    packages = (
        report_items(reports, "osv-scanner")
        .select("target_id", "report_id", "pos", F.posexplode(F.col("r.packages")).alias("pkg_pos", "pkg"))
        .where(F.size("pkg.vulnerabilities") > 0)
        .withColumn("name", F.coalesce(F.col("pkg.package.name"), F.lit("dependency")))
        .withColumn("version", F.coalesce(F.col("pkg.package.version"), F.lit("unknown")))
        .withColumn(
            "vulns",
            F.transform(
                F.col("pkg.vulnerabilities"),
                lambda v: F.struct(
                    F.coalesce(v["id"], F.lit("ADVISORY")).alias("id"),
                    advisory_severity(v, F.col("pkg")).alias("severity"),
                    fixed_version(v, F.col("name")).alias("fixed"),
                ),
            ).cast(vuln_type),
        )
        .drop("pkg")
    )
    ids = F.transform("vulns", lambda v: v["id"])
    bands = F.transform("vulns", lambda v: F.array_position(F.array(*[F.lit(b) for b in _BANDS]), v["severity"]))
    fixes = F.filter(F.transform("vulns", lambda v: v["fixed"]), lambda x: x.isNotNull())
    rows = packages.select(
        "*",
        F.size("vulns").alias("n"),
        F.array_join(ids, ", ").alias("id_list"),
        F.array_min(ids).alias("first_id"),
        F.element_at(F.array(*[F.lit(b) for b in _BANDS]), F.array_max(bands).cast("int")).alias("worst"),
        F.size(F.filter("vulns", lambda v: v["severity"] == "critical")).alias("n_critical"),
        F.size(fixes).alias("n_fixed"),
        max_fix(fixes).alias("target"),
    )
    n = F.col("n").cast("string")
    ending = F.when(F.col("n") == 1, "y").otherwise("ies")
    critical = F.when(
        F.col("n_critical") > 0, F.concat(F.lit(" ("), F.col("n_critical").cast("string"), F.lit(" critical)"))
    ).otherwise("")
    counted = F.concat(n, F.lit(" known vulnerabilit"), ending, critical)
    published = F.concat(n, F.lit(" known published vulnerabilit"), ending, critical)
    unfixed = F.when(F.col("n_fixed") < F.col("n"), OSV_UNFIXED_NOTE).otherwise("")

    def as_hit(variant: str) -> Column:
        return hit(
            variant, rule_id=F.concat(F.lit("OSV_"), F.upper("first_id")), severity=F.col("worst"),
            evidence=F.concat(n, F.lit(" advisor"), ending, F.lit("; worst "), "worst"),
            url=F.concat("name", F.lit("@"), "version"),
            params=[F.col("name"), counted, published, F.col("id_list"), F.col("target"), unfixed],
            ord=(F.col("pos"), F.col("pkg_pos")), src=report_order(),
        )

    return one_hit(
        rows, F.when(F.col("target").isNotNull(), as_hit("osv_fixable")).otherwise(as_hit("osv_unfixed"))
    )


def ingest_reports(reports: DataFrame) -> DataFrame:
    return ingest_gitleaks(reports).unionByName(ingest_osv(reports)).unionByName(ingest_semgrep(reports))

import pytest
from pyspark.sql import functions as F

from fleetward.operators import grading, passes, pipeline
from fleetward.schema import complete, hit, one_hit
from fleetward.sources.snippets import LIVE_KEY, PUBLIC_KEY


def findings(spark, rows):
    """Completed hits from (target, variant, file, line, url, evidence, ord, raw)."""
    cols = "target_id bigint, variant string, file string, line int, url string, evidence string, ord bigint, raw string"
    df = spark.createDataFrame(rows, cols)
    made = one_hit(
        df, hit("x", file=F.col("file"), line=F.col("line"), url=F.col("url"), evidence=F.col("evidence"), ord=F.col("ord"), raw=F.col("raw"))
        .withField("variant", F.col("variant"))
        .withField("params", F.array(F.lit("next"), F.lit("13.4.0"), F.lit("CVE"), F.lit("s")))
        .withField("rule_id", F.when(F.col("variant").isin("known_cve", "osv_fixable"), "DEP").when(F.col("variant").startswith("gitleaks"), "GITLEAKS_X"))
        .withField("severity", F.when(F.col("variant").isin("known_cve", "osv_fixable"), "high")),
    )
    return complete(made)


def row(target, variant, file=None, line=None, url=None, evidence=None, ord=1, raw=None):
    return (target, variant, file, line, url, evidence, ord, raw)


def test_public_secrets_are_dropped_and_raw_values_stripped(spark):
    df = findings(spark, [row(1, "secret_generic", "a", 1, raw=PUBLIC_KEY), row(1, "secret_stripe", "a", 2, raw=LIVE_KEY), row(1, "xss_user", "a", 3)])
    out = pipeline.suppress(df)
    assert not {"raw", "raw_line"} & set(out.columns)
    assert sorted(r.line for r in out.collect()) == [2, 3]


def test_context_only_downgrades(spark):
    rows = [
        row(1, "xss_user", "src/content/x.ts", 1), row(2, "xss_user", "src/app/x.ts", 1), row(3, "secret_stripe", "src/content/x.ts", 1),
        row(4, "gitleaks_dangerous", "src/content/x.ts", 1), row(5, "secret_stripe", "docs/x.md", 1), row(6, "xss_user"),
    ]
    out = {r.target_id: (r.severity, r.confidence, r.note_class) for r in pipeline.contextualize(findings(spark, rows)).collect()}
    assert out == {
        1: ("low", "low", "content"), 2: ("high", "high", None), 3: ("critical", "high", None), 4: ("low", "low", "content"),
        5: ("low", "low", "docs"), 6: ("high", "high", None),
    }


def test_dedupe_prefers_native_and_the_earlier_rule(spark):
    rows = [
        row(1, "gitleaks_dangerous", "a.ts", 4), row(1, "secret_stripe", "a.ts", 4), row(1, "secret_generic", "a.ts", 4, ord=2),
        row(1, "sql_concat", "a.ts", 4, evidence="b", ord=100001), row(1, "sql_concat", "a.ts", 4, evidence="a", ord=1),
        row(2, "secret_stripe", "a.ts", 4), row(1, "weak_cookie", url="u", evidence="one", ord=100), row(1, "weak_cookie", url="u", evidence="two", ord=101),
    ]
    out = sorted((r.target_id, r.variant, r.evidence or "") for r in pipeline.dedupe(pipeline.suppress(findings(spark, rows))).collect())
    assert out == [(1, "secret_stripe", ""), (1, "sql_concat", "a"), (1, "weak_cookie", "one"), (2, "secret_stripe", "")]


def test_engine_findings_replace_native_dependency_findings(spark):
    rows = [
        row(1, "known_cve", "package.json", evidence="next@13.4.0 (CVE)"), row(1, "osv_fixable", url="next@13.4.0"),
        row(2, "known_cve", "package.json", evidence="next@13.4.0 (CVE)"), row(3, "osv_fixable", url="next@13.4.0"),
        row(1, "xss_user", "a", 1),
    ]
    out = pipeline.reconcile_deps(pipeline.suppress(findings(spark, rows))).collect()
    assert sorted((r.target_id, r.variant) for r in out) == [(1, "osv_fixable"), (1, "xss_user"), (2, "known_cve"), (3, "osv_fixable")]


def test_native_range_declaration_is_not_superseded(spark):
    df = findings(spark, [row(1, "known_cve", "package.json", evidence="next@^13.4.0 (CVE)"), row(1, "osv_fixable", url="next@13.4.0")])
    df = df.withColumn("params", F.array(F.lit("next"), F.lit("^13.4.0"), F.lit("CVE"), F.lit("s")))
    assert pipeline.reconcile_deps(pipeline.suppress(df)).count() == 2


def test_a_hot_identity_is_combined_before_the_shuffle(spark):
    """A third of all rows are copies of one finding; another third sits in one target."""
    n = 90_000
    base = spark.range(0, n, 1, 16)
    hot = base.where("id % 3 = 0").select(F.lit(1).cast("bigint").alias("t"), F.lit("hot.ts").alias("f"), F.lit(1).alias("l"))
    target = base.where("id % 3 = 1").select(F.lit(1).cast("bigint").alias("t"), F.concat(F.lit("f"), "id").alias("f"), F.lit(2).alias("l"))
    rest = base.where("id % 3 = 2").select(F.col("id").alias("t"), F.lit("x.ts").alias("f"), F.lit(3).alias("l"))
    rows = hot.unionByName(target).unionByName(rest).select(F.col("t").alias("target_id"), "f", "l")
    df = pipeline.suppress(one_hit(rows, hit("secret_stripe", file=F.col("f"), line=F.col("l"))))
    out = pipeline.dedupe(df)
    assert out.count() == 1 + n // 3 + n // 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") >= 1 and "Window" not in plan


@pytest.mark.parametrize(
    "rows,score,grade",
    [
        ([("critical", "low")], 95, "A"), ([("critical", "high")], 65, "D"), ([("high", "low")], 98, "A"), ([("high", "high")], 85, "B"),
        ([("critical", "high")] * 3, 0, "F"), ([("info", "high")] * 9, 100, "A"), ([("medium", "medium")] * 3 + [("low", "low")], 91, "A"),
        ([("high", "high")] * 2 + [("medium", "high")], 64, "C"), ([("high", "high")] * 4, 40, "D"), ([], 100, "A"),
    ],
)
def test_grades(spark, rows, score, grade):
    df = spark.createDataFrame([(1, s, c) for s, c in rows], "target_id bigint, severity string, confidence string")
    targets = spark.createDataFrame([(1,)], "target_id bigint")
    got = grading.grade(df, targets).collect()[0]
    assert (got.score, got.grade) == (score, grade)


def test_ci_gate_ignores_confidence(spark):
    df = spark.createDataFrame([(1, "critical", "low"), (2, "low", "low")], "target_id bigint, severity string, confidence string")
    out = {r.target_id: r.exit_code for r in grading.ci_gate(grading.grade(df)).collect()}
    assert out == {1: 2, 2: 0}


def test_clean_passes_only_for_repositories_without_any_finding(spark):
    targets = spark.createDataFrame([(1, "repo", "a"), (2, "url", "b"), (3, "repo", "c")], "target_id bigint, type string, value string")
    found = spark.createDataFrame([(3, "injection")], "target_id bigint, category string")
    out = passes.clean_categories(targets, found).collect()
    assert {t: len([r for r in out if r.target_id == t]) for t in (1, 2, 3)} == {1: 5, 2: 0, 3: 4}

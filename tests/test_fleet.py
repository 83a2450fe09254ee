import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import fleetward
from fleetward.catalog.texts import Variant
from fleetward.operators import report
from fleetward.operators.file_rules import FileRule, no_hits
from fleetward.plans import fleet as fp
from fleetward.plans.registry import Rule, known_variants, run_isolated

from . import apps

NAMES = {1: apps.VULNERABLE, 2: apps.CLEAN, 3: apps.DOCS, 4: apps.PUBLIC_VALUES, 5: {"index.js": "export const x = 1;"}}


@pytest.fixture(scope="module")
def scanned(spark, make_files):
    targets = spark.createDataFrame([(i, "repo", f"/repo/{i}") for i in NAMES], "target_id bigint, type string, value string")
    fleet = fp.Fleet(targets, make_files(NAMES))
    result = fleetward.run_scan(fleet)
    findings = result.published().collect()
    passes = result.passes.collect()
    summary = {r.target_id: r for r in fp.summary(fleet, result).collect()}
    made = fp.reports(fleet, result, "t0", "t1")
    reports = {r["target_id"]: r | {"findings": []} for r in map(json.loads, made.summary.toJSON().collect())}
    for row in map(json.loads, made.details.drop("report_order").toJSON().collect()):
        reports[row["target_id"]]["findings"].append(row)
    assert result.quarantine.count() == 0
    return findings, passes, summary, reports


def test_vulnerable_app(scanned):
    findings, _, summary, _ = scanned
    mine = [f for f in findings if f.target_id == 1]
    assert sorted((f.rule_id, f.file, f.line) for f in mine) == sorted([
        ("AUTH_NEXTJS_MIDDLEWARE_BYPASS", "package.json", None), ("DEPENDENCIES_CVE_2024_34351", "package.json", None),
        ("INJECTION_SQL", "lib/db.js", 2), ("INJECTION_SQL", "lib/db.js", 6),
        ("WEB_CONFIG_CORS_WILDCARD_CREDENTIALS", "next.config.js", None), ("WEB_CONFIG_MISSING_SECURITY_HEADERS", "next.config.js", None),
        ("API_MASS_ASSIGNMENT", "pages/api/profile.js", 3), ("API_WEBHOOK_UNVERIFIED", "pages/api/webhook.js", None),
        ("API_WEBHOOK_NO_IDEMPOTENCY", "pages/api/webhook.js", None), ("DATABASE_RLS_DISABLED", "supabase/migrations/1.sql", 1),
        ("DATABASE_RLS_PERMISSIVE_POLICY", "supabase/migrations/1.sql", 4), ("DATABASE_FIREBASE_RULES_OPEN", "firestore.rules", 3),
        ("SECRETS_STRIPE_SECRET_KEY", "lib/shop.js", 1), ("SECRETS_SUPABASE_SERVICE_ROLE_JWT", "lib/root.js", 2),
        ("AI_RISKY_RULES_FILE", ".cursorrules", 1),
    ]) or sorted(f.rule_id for f in mine if f.rule_id.startswith("SECRETS_SUPABASE")) == ["SECRETS_SUPABASE_SERVICE_ROLE"]
    assert len(mine) == 15
    assert (summary[1].grade, summary[1].score, summary[1].critical) == ("F", 0, 9)
    table = next(f for f in mine if f.rule_id == "DATABASE_RLS_DISABLED")
    assert table.title == 'Table "routes" has no Row Level Security'


def test_clean_docs_and_public_apps(scanned):
    findings, _, summary, _ = scanned
    by_target = {t: [f for f in findings if f.target_id == t] for t in NAMES}
    assert by_target[2] == [] and summary[2].grade == "A" and summary[2].score == 100
    assert summary[3].critical == 0 and summary[3].grade == "A"
    assert not [f for f in by_target[3] if f.category == "secrets" or f.confidence != "low"]
    assert [f for f in by_target[4] if f.category == "secrets"] == []


def test_passes(scanned):
    _, passes, summary, _ = scanned
    mine = {p.id for p in passes if p.target_id == 2}
    clean = {f"PASS_CLEAN_{c}" for c in ("INJECTION", "AUTH", "API_WEBHOOKS", "BUSINESS_LOGIC", "DEPENDENCIES")}
    assert mine == clean | {"PASS_SECURITY_HEADERS_CONFIG", "PASS_SECRETS_NONE_EXPOSED"}
    assert summary[2].passed == len(mine)
    assert {p.id for p in passes if p.target_id == 1} == {"PASS_CLEAN_BUSINESS_LOGIC"}
    assert "PASS_SECRETS_NONE_EXPOSED" in {p.id for p in passes if p.target_id == 5}


def test_report_order_and_shape(scanned):
    _, _, _, reports = scanned
    r = reports[1]
    rank = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
    ranks = [rank[f["severity"]] for f in r["findings"]]
    assert ranks == sorted(ranks, reverse=True) and len(ranks) == 15
    assert r["counts"]["critical"] == 9 and r["engines"] == {"semgrep": False, "gitleaks": False, "osv_scanner": False}
    assert [(p["category"], p["title"]) for p in reports[2]["passed"]] == sorted(
        ((p["category"], p["title"]) for p in reports[2]["passed"]), key=lambda x: (x[0], x[1].lower())
    )
    assert "n0t-a-real-0ne" not in json.dumps(reports) and apps.LIVE_KEY not in json.dumps(reports)


def test_no_practice_is_praised_without_a_manifest(spark, make_files):
    from fleetward.operators import target_rules
    from fleetward.sources import files as fs

    files = make_files({
        1: {"package.json": json.dumps({"dependencies": {"zod": "^3", "@prisma/client": "^5", "express-rate-limit": "^7"}})},
        2: {"package.json": json.dumps({"dependencies": {"lodash": "^4"}})},
        3: {"package.json": "{broken", "next.config.js": apps.CLEAN["next.config.js"]},
        4: {"app/package.json": json.dumps({"devDependencies": {"@clerk/nextjs": "1"}}), "z/package.json": "{}"},
    })
    rows = target_rules.good_practices(fs.manifests(files), target_rules.facts_of(files, "config")).collect()
    got = {t: sorted(r.id for r in rows if r.target_id == t) for t in (1, 2, 3, 4)}
    assert got == {1: ["PASS_INPUT_VALIDATION", "PASS_ORM_PARAMETERIZED", "PASS_RATE_LIMITING"], 2: [], 3: [], 4: ["PASS_AUTH_LIBRARY"]}


def test_a_broken_rule_does_not_stop_the_others(spark):
    ok = Rule("OK", "auth", "both", 1, lambda t: t["x"])
    bad = Rule("BAD", "auth", "both", 2, lambda t: t["missing"])
    assert len(run_isolated([bad, ok], {"x": spark.range(3)})) == 1
    assert ok.applies_to("url") and not Rule("W", "auth", "whitebox", 1, None).applies_to("url")


def test_registry_lists_every_rule():
    assert [r[0] for r in fleetward.rules()][:2] == ["SECRETS_HARDCODED", "SECRETS_COMMITTED_ENV"]
    assert len(fleetward.rules()) == 24


def test_require_valid_fails_the_job(spark):
    rows = spark.createDataFrame([("R", "urgent", "t", "w")], "rule_id string, severity string, title string, why string")
    fields = ("severity", "rule_id", "title", "why")
    with pytest.raises(Exception, match="invalid finding fields: severity"):
        report.require_valid(rows, fields).collect()
    good = rows.withColumn("severity", F.lit("high"))
    assert report.require_valid(good, fields).count() == 1
    with pytest.raises(Exception, match="category"):  # a field that is missing altogether
        report.require_valid(good).collect()


def test_every_field_is_checked(spark):
    good = {"category": "auth", "severity": "high", "confidence": "low", "mode": "whitebox", "source": "native", "target_id": "1", "rule_id": "R", "title": "t", "why": "w", "line": 3}
    assert set(good) == set(report.ALL_FIELDS)
    rows = [good] + [good | {k: -1 if k == "line" else None if k in ("target_id", "rule_id", "title", "why") else "odd"} for k in report.ALL_FIELDS]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {'int' if k == 'line' else 'string'}" for k in good))
    valid, bad = report.split_valid(df)
    assert valid.count() == 1 and sorted(r.violations for r in bad.collect()) == sorted(report.ALL_FIELDS)
    grades = spark.createDataFrame([(1, "A", 90), (2, "E", 101)], "target_id bigint, grade string, score int")
    assert [r.violations for r in report.split_valid(grades, report.GRADE_FIELDS)[1].collect()] == ["grade,score"]


OWN = Variant(None, "auth", "high", "high", None, None, "whitebox", "Own title <<0>>", "Own reason", None, None)


def test_added_rules_are_published(spark, make_files):
    from fleetward.schema import hit, one_hit

    def file_rule(key, hits):
        return FileRule(key, key, lambda path: path.endswith(".ts"), hits, variants={"own_file": OWN._replace(rule_id="OWN_FILE")})

    good = file_rule("good", lambda f: F.when(f.content.contains("odd"), F.array(hit("own_file", file=f.path, params=[F.lit("x")]))).otherwise(no_hits()))
    broken = file_rule("broken", lambda f: f.nothing_like_it)
    raising = file_rule("raising", lambda f: F.array(hit("own_file", file=F.raise_error(F.lit("at run time")))))
    target = Rule("OWN", "auth", "both", 99, lambda t: one_hit(t["facts"].select("target_id").distinct(), hit("own_target", file=F.lit("f"))),
                  {"own_target": OWN._replace(rule_id="OWN_TARGET")})
    bad_target = Rule("BAD", "auth", "both", 98, lambda t: t["no such table"])
    targets = spark.createDataFrame([(1, "repo", "v")], "target_id bigint, type string, value string")
    files = make_files({1: {"a.ts": "odd", "b.ts": "exec(`ls ${folder}`)", "package.json": "{}"}})
    fleet = fp.Fleet(targets, files, extra_rules=[target, bad_target], extra_file_rules=[broken, good, raising])
    result = fleetward.run_scan(fleet)
    got = {(r.rule_id, r.title, r.category, r.mode) for r in result.published().collect()}
    assert {("OWN_FILE", "Own title x", "auth", "whitebox"), ("OWN_TARGET", "Own title ", "auth", "whitebox")} <= got
    assert any(r[0] == "INJECTION_COMMAND" for r in got)
    assert [tuple(r) for r in result.failed.orderBy("rule").collect()] == [(1, "raising", 2)]
    result.run.drop()


def test_a_failing_rule_costs_no_second_scan(spark, make_files):
    """Errors are caught per file and rule in the one pass; what a rule finds on other files stands."""
    def file_rule(key, hits):
        return FileRule(key, key, lambda path: path.endswith(".ts"), hits, variants={"own_file": OWN._replace(rule_id="OWN_FILE")})

    def divides(f):
        from fleetward.schema import hit

        return F.array(hit("own_file", file=f.path, line=(F.lit(6) / (F.length(f.content) - 3)).cast("int"), params=[f.calls[0]["callee"]]))

    def raises(f):
        from fleetward.schema import hit

        return F.array(hit("own_file", file=F.raise_error(F.concat(F.lit("no "), f.path))))

    files = make_files({1: {"a.ts": "exec(x)", "b.ts": "odd"}, 2: {"c.ts": "odd", "d.txt": "odd"}, 3: {"e.ts": "exec(yy)"}})
    scans = spark.sparkContext.accumulator(0)
    counted = spark.createDataFrame(files.collect(), files.schema).mapInArrow(_counting(scans), files.schema)
    targets = spark.createDataFrame([(i, "repo", "v") for i in (1, 2, 3)], "target_id bigint, type string, value string")
    rules = [file_rule("divides", divides), file_rule("raises", raises)]
    result = fp.scan_fleet(fp.Fleet(targets, counted, extra_file_rules=rules))
    own = sorted((r.target_id, r.file, r.line, r.params[0]) for r in result.findings.where("rule_id = 'OWN_FILE'").collect())
    assert own == [(1, "a.ts", 1, "exec"), (3, "e.ts", 1, "exec")]
    failed = sorted(tuple(r) for r in result.failed.collect())
    assert failed == [(1, "divides", 1), (1, "raises", 2), (2, "divides", 1), (2, "raises", 1), (3, "raises", 1)]
    assert scans.value == 5  # every file was read once
    result.run.drop()


def _counting(scans):
    def run(batches):
        for rows in batches:
            scans.add(rows.num_rows)
            yield rows

    return run


def test_unknown_variants_are_errors(spark, make_files):
    from fleetward.schema import complete, hit, one_hit

    rows = spark.createDataFrame([(1,)], "target_id bigint")
    with pytest.raises(Exception, match="unknown finding variant: nobody_knows"):
        complete(one_hit(rows, hit("nobody_knows"))).collect()
    with pytest.raises(ValueError, match="lacks"):
        known_variants([Rule("R", "auth", "both", 1, None, {"v": OWN._replace(why="")})])


def test_tables_of_a_scan_are_dropped(spark, make_files):
    targets = spark.createDataFrame([(1, "repo", "v")], "target_id bigint, type string, value string")
    result = fleetward.run_scan(fp.Fleet(targets, make_files({1: {"a.ts": "x"}})))
    folder = Path(result.run.path.removeprefix("file:"))
    left = {p.name.rsplit("-", 1)[0] for p in folder.parent.iterdir()}
    assert folder.exists() and "scan-work" not in left
    result.run.drop()
    assert not folder.exists()


def test_reports_have_one_shape_at_any_size(spark):
    from fleetward.operators import grading
    from fleetward.schema import complete, hit, one_hit, publish

    rows = spark.range(45).select(F.lit(1).cast("bigint").alias("target_id"), F.col("id").cast("string").alias("f"))
    found = complete(one_hit(rows, hit("firebase_open", file=F.col("f"), line=F.lit(1)))).drop("raw", "raw_line")
    targets = spark.createDataFrame([(1, "repo", "v"), (2, "repo", "w")], "target_id bigint, type string, value string")
    empty = spark.createDataFrame([], "target_id bigint, id string, category string, title string, detail string, mode string")
    engines = targets.select("target_id", *[F.lit(False).alias(c) for c in ("semgrep", "gitleaks", "osv_scanner")])
    made = report.assemble(
        targets, grading.grade(found, targets), publish(found, ("phase", "rule_ord", "emit_src", "emit_ord")), empty, engines, "a", "b"
    )
    assert sorted(r.target_id for r in made.summary.collect()) == [1, 2]
    assert [r.file for r in made.details.collect()] == sorted(str(i) for i in range(45))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_findings_are_judged_once_and_dealt_evenly(spark, make_files, monkeypatch):
    """Routing reads the staged findings several times, so nothing of a single row is decided behind them."""
    staged, settled = {}, []
    stage, settle = fp.Run.stage, fp.pipeline.settle
    monkeypatch.setattr(fp.Run, "stage", lambda run, df, name: staged.setdefault(name, df) and stage(run, df, name))
    monkeypatch.setattr(fp.pipeline, "settle", lambda rows, *args: settled.append(settle(rows, *args)) or settled[-1])
    targets = spark.createDataFrame([(1, "repo", "v")], "target_id bigint, type string, value string")
    result = fp.scan_fleet(fp.Fleet(targets, make_files({1: {"docs/a.ts": "exec(`ls ${folder}`)", "a.ts": "exec(`ls ${folder}`)"}})))
    assert "note_class" in staged["emitted"].columns and "RebalancePartitions" in _plan(staged["emitted"])
    assert "readme" in _plan(staged["emitted"]).lower() and "readme" not in _plan(settled[0]).lower()  # a pattern of the path classes
    found = {(r.file, r.severity, r.confidence, r.note_class) for r in result.findings.where("rule_id = 'INJECTION_COMMAND'").collect()}
    assert {(f, c) for f, _, _, c in found} == {("docs/a.ts", "docs"), ("a.ts", None)}
    assert ("docs/a.ts", "low", "low", "docs") in found
    result.run.drop()


def _broadcast_sources(df):
    """Scans below the broadcasts that are planned before any row is counted."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depths = [len(line) - len(line.lstrip(" :+-|")) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            found += [x.strip(" :+-|")[:120] for x in lines[i:below] if re.search(r"FileScan|Scan ExistingRDD", x)]
    return found


def test_no_staged_table_is_broadcast_by_the_size_of_its_files(spark, make_files, monkeypatch):
    """A staged table of few bytes may hold any number of rows, and a list of scripts is many rows more."""
    planned, stage = {}, fp.Run.stage

    def planned_first(run, df, name):
        planned[name] = _broadcast_sources(df)
        return stage(run, df, name)

    monkeypatch.setattr(fp.Run, "stage", planned_first)
    repos = [(1, "repo", "/repo/1"), (2, "repo", "/repo/2")]
    targets = spark.createDataFrame([*repos, (7, "url", "https://a.example/")], "target_id bigint, type string, value string")
    home = [(7, "https://a.example/", {"x-frame-options": "DENY"}, "<script src='/app.js'></script>")]
    db = "https://abcdefghijklmnopqrst.supabase.co"
    answers = [
        (7, "https://a.example/app.js.map", 200, '{"version": 3, "sources": ["a.ts"], "mappings": "AA"}'),
        (7, "https://a.example/.env", 200, f"STRIPE_KEY={apps.LIVE_KEY}"),
    ]
    body = f'var u="{db}"; k="sb_publishable_KKKKKKKKKKKKKKKK7"'
    fleet = fp.Fleet(
        targets, make_files({1: apps.VULNERABLE, 2: apps.CLEAN}),
        spark.createDataFrame(home, "target_id bigint, url string, headers map<string,string>, body string"),
        spark.createDataFrame([(7, "https://a.example/app.js", 200, body)], "target_id bigint, url string, status int, body string"),
        spark.createDataFrame(answers, "target_id bigint, url string, status int, body string"),
    )
    result = fp.scan_fleet(fleet)
    summary = fp.summary(fleet, result)
    planned["summary"] = _broadcast_sources(summary)
    assert {"bundles", "discovered", "emitted", "settled", "passes"} <= planned.keys()
    assert {name: scans for name, scans in planned.items() if scans} == {}
    assert {r.rule_id for r in result.findings.where("target_id = 7").collect()} >= {"WEB_CONFIG_EXPOSED_SOURCEMAP", "WEB_CONFIG_EXPOSED_FILE"}
    assert {r.target_id for r in summary.collect()} == {1, 2, 7}
    result.run.drop()

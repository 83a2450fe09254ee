import json

import pytest

from fleetward.operators import ingest, live_rules
from fleetward.schema import publish
from fleetward.sources import probes
from fleetward.sources.snippets import EXAMPLE_CONN, LIVE_KEY, PUBLIC_KEY

HEADERS = {h: "x" for h in ("content-security-policy", "strict-transport-security", "x-frame-options", "x-content-type-options", "referrer-policy", "permissions-policy")}


@pytest.fixture(scope="module")
def home(spark):
    rows = [
        (1, "https://a.test/", {}, ""), (2, "https://b.test/x/", HEADERS, ""),
        (3, "https://c.test/", {"x-frame-options": "DENY", "set-cookie": "sid=1; Secure\nauth=2; HttpOnly; Secure\ntheme=1"}, ""),
    ]
    return spark.createDataFrame(rows, "target_id bigint, url string, headers map<string,string>, body string")


def test_headers_and_cookies(home):
    missing = publish(live_rules.missing_headers(home)).collect()
    assert {t: len([r for r in missing if r.target_id == t]) for t in (1, 2, 3)} == {1: 6, 2: 0, 3: 5}
    assert {r.severity for r in missing} == {"medium", "low"}
    assert [r.id for r in live_rules.pass_headers(home).where("target_id = 3").collect()] == ["PASS_WEB_CONFIG_X_FRAME_OPTIONS"]
    assert [(r.target_id, r.evidence) for r in publish(live_rules.weak_cookies(home)).collect()] == [(3, "sid")]


def test_exposed_files_need_file_shaped_bodies(spark, home):
    rows = [
        (1, "https://a.test/.env", 200, f"STRIPE={LIVE_KEY}"), (1, "https://a.test/.env.local", 200, "<!doctype html>"),
        (2, "https://b.test/.git/config", 200, "[core]\n"), (2, "https://b.test/.env", 404, "A=1"), (3, "https://c.test/.env", 200, "A=1"),
    ]
    answers = spark.createDataFrame(rows, "target_id bigint, url string, status int, body string")
    out = publish(live_rules.exposed_files(home, answers)).collect()
    assert sorted((r.target_id, r.severity, "contains secrets" in r.why) for r in out) == [(1, "critical", True), (2, "high", False), (3, "critical", False)]


def test_open_tables(spark):
    url, key = "https://" + "a" * 20 + ".supabase.co", "sb_publishable_abc"
    found = spark.createDataFrame([(1, url, key), (2, url, key), (3, url, None), (4, url, key)], "target_id bigint, db_url string, db_key string")
    plan = probes.plan_tables(found)
    assert plan.count() == 36 and all(r.url.endswith("?select=*&limit=1") for r in plan.collect())
    rows = [
        (1, f"{url}/rest/v1/users?select=*&limit=1", 200, '[{"id":1,"email":"secret@user.test"}]'), (1, f"{url}/rest/v1/orders?select=*&limit=1", 200, "[]"),
        (2, f"{url}/rest/v1/users?select=*&limit=1", 401, '[{"id":1}]'), (2, f"{url}/rest/v1/orders?select=*&limit=1", 200, "<html>"),
    ]
    answers = spark.createDataFrame(rows, "target_id bigint, url string, status int, body string")
    out = publish(live_rules.open_tables(found, answers)).collect()
    assert [(r.target_id, r.severity, r.mode) for r in out] == [(1, "critical", "blackbox")]
    assert "secret@user.test" not in str(out) and "row content discarded" in out[0].evidence
    assert sorted(r.target_id for r in live_rules.pass_closed_tables(found, answers).collect()) == [2, 4]


def test_source_maps(spark):
    real = json.dumps({"version": 3, "sources": ["a.ts"], "mappings": ""})
    bundles = spark.createDataFrame(
        [(1, 0, "https://a.test/x.js"), (1, 1, "https://a.test/y.mjs?v=1"), (2, 0, "https://b.test/x.js"), (3, 0, "https://c.test/x.css")],
        "target_id bigint, ord int, script_url string",
    )
    answers = spark.createDataFrame(
        [(1, "https://a.test/y.mjs.map", 200, real), (1, "https://a.test/x.js.map", 200, real), (2, "https://b.test/x.js.map", 200, "<!doctype html>")],
        "target_id bigint, url string, status int, body string",
    )
    assert [(r.target_id, r.url) for r in publish(live_rules.source_maps(bundles, answers)).collect()] == [(1, "https://a.test/x.js.map")]
    assert [r.target_id for r in live_rules.pass_source_maps(bundles, answers).collect()] == [2]


def vuln(id, severity=None, fixed=None, name="lodash"):
    v = {"id": id, "affected": [{"package": {"name": name}, "ranges": [{"events": [{"introduced": "0"}] + ([{"fixed": fixed}] if fixed else [])}]}]}
    if severity:
        v["database_specific"] = {"severity": severity}
    return v


@pytest.fixture(scope="module")
def reports(spark):
    osv = {"results": [{"packages": [
        {"package": {"name": "lodash", "version": "4.17.11"}, "vulnerabilities": [vuln("G-j", "CRITICAL", "4.17.12"), vuln("G-p", "HIGH", "4.17.19"), vuln("G-2", "MODERATE", "4.18.0")]},
        {"package": {"name": "minimist", "version": "1.2.0"}, "vulnerabilities": [vuln("G-v", "HIGH", "1.2.6", "minimist")]},
        {"package": {"name": "odd", "version": "1"}, "vulnerabilities": [vuln("G-o", None, "9.0.0", "other"), {"id": "G-r", "severity": [{"type": "CVSS_V3"}]}]},
        {"package": {"name": "none", "version": "1"}, "vulnerabilities": []},
    ]}]}
    leaks = [
        {"RuleID": "stripe", "Description": "Stripe", "Secret": LIVE_KEY, "File": "/r/a.ts", "StartLine": 3, "Commit": "abc"},
        {"RuleID": "pk", "Secret": PUBLIC_KEY, "File": "/r/b.ts"}, {"Match": EXAMPLE_CONN, "File": "/r/c.ts"}, {"RuleID": "x", "Match": "0badc0de0badc0de", "File": "/r/d.ts"},
        {"RuleID": "empty", "Secret": ""},
    ]
    semgrep = {"results": [{"check_id": "a.b.my-rule", "path": "/r/x.js", "start": {"line": 4}, "extra": {"severity": "WARNING", "message": "m" * 200}}, {}]}
    rows = [
        (1, 1, "osv-scanner", "/r", json.dumps(osv)), (2, 1, "gitleaks", "/r", json.dumps(leaks)), (3, 1, "semgrep", "/r", json.dumps(semgrep)),
        (4, 2, "osv-scanner", "/r", '{"results": [{'), (5, 2, "gitleaks", "/r", "not json"), (6, 2, "semgrep", "/r", None), (7, 3, "semgrep", "/r", "{}"),
    ]
    return spark.createDataFrame(rows, "report_id bigint, target_id bigint, engine string, root string, raw string")


def test_dependency_report_is_grouped_per_package(reports):
    out = {r.url: r for r in publish(ingest.ingest_osv(reports)).collect()}
    assert set(out) == {"lodash@4.17.11", "minimist@1.2.0", "odd@1"}
    lodash = out["lodash@4.17.11"]
    assert (lodash.severity, lodash.rule_id, lodash.title) == ("critical", "OSV_G-2", "lodash@4.17.11 has 3 known vulnerabilities (1 critical)")
    assert "4.18.0" in lodash.fix and "G-j, G-p, G-2" in lodash.why and lodash.evidence == "3 advisories; worst critical"
    assert out["minimist@1.2.0"].title == "minimist@1.2.0 has 1 known vulnerability"
    assert (out["odd@1"].severity, out["odd@1"].fix) == ("high", "Upgrade odd to a patched release, then re-run your tests.")


def test_secret_report_is_graded_by_value(reports):
    out = sorted(publish(ingest.ingest_gitleaks(reports)).collect(), key=lambda r: r.file)
    assert [(r.rule_id, r.severity, r.confidence, r.file, r.line) for r in out] == [
        ("GITLEAKS_STRIPE", "critical", "high", "a.ts", 3), ("GITLEAKS_X", "high", "medium", "d.ts", None)]
    assert "git history — purge" in out[0].fix and "purge" not in out[1].fix and out[0].evidence == "sk_live_… (redacted)"


def test_pattern_report(reports):
    out = sorted(publish(ingest.ingest_semgrep(reports)).collect(), key=lambda r: r.rule_id)
    assert [(r.rule_id, r.severity, r.file, r.line, len(r.title)) for r in out] == [
        ("SEMGREP_FINDING", "medium", None, None, 15), ("SEMGREP_MY-RULE", "medium", "x.js", 4, 120)]


def test_engine_flags(reports):
    out = {r.target_id: (r.semgrep, r.gitleaks, r.osv_scanner) for r in ingest.engine_flags(reports).collect()}
    assert out == {1: (True, True, True), 2: (True, True, True), 3: (True, False, False)}


def test_bundle_secrets(spark):
    df = spark.createDataFrame([(1, "https://a.test/x.js", f'k="{LIVE_KEY}"'), (2, "https://a.test/y.js", f'k="{PUBLIC_KEY}"')], "target_id bigint, script_url string, content string")
    out = publish(live_rules.bundle_secrets(df)).collect()
    assert [r.mode for r in out] == ["blackbox"]
    assert [(r.target_id, r.rule_id, r.url, r.line) for r in out] == [(1, "SECRETS_STRIPE_SECRET_KEY", "https://a.test/x.js", 1)]
    assert LIVE_KEY not in str(out)


@pytest.mark.parametrize("ids", [["200000000000", "abc-1", "9", "10"], [str(2**63 + 5), "", "x"]])
def test_report_ids_of_any_kind_keep_their_order(spark, ids):
    from fleetward.operators import pipeline

    osv = json.dumps({"results": [{"packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": [vuln("G-1", "LOW", "2.0.0", "p")]}]}]})
    rows = [(i, n, "osv-scanner", "/r", osv) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "report_id string, target_id bigint, engine string, root string, raw string")
    out = ingest.ingest_reports(df).select("target_id", "emit_src", "emit_ord").collect()
    assert len(out) == len(ids)
    by_src = [ids[r.target_id] for r in sorted(out, key=lambda r: (r.emit_src, r.emit_ord))]
    numbers = sorted((i for i in ids if i.isdigit()), key=int)
    assert by_src == numbers + sorted(i for i in ids if not i.isdigit())
    assert pipeline.dedupe(pipeline.suppress(ingest.ingest_reports(df))).count() == len(ids)


def test_no_script_or_map_is_left_out(spark):
    from fleetward.sources import http

    html = "".join(f'<script src="/s{i}.js"></script>' for i in range(40))
    pages = spark.createDataFrame([(1, "https://a.test/", html)], "target_id bigint, url string, body string")
    scripts = http.extract_scripts(pages)
    assert scripts.count() == 40
    assert http.map_candidates(scripts).count() == 40


@pytest.mark.parametrize("engine", ["gitleaks", "semgrep", "osv-scanner"])
def test_a_report_is_parsed_once(reports, engine):
    plan = ingest.report_items(reports.localCheckpoint(), engine)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1

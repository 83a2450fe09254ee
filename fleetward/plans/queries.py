"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import lists
from ..functions import identity, paths, secrets, text, version
from ..functions.calls import call_sites, tainted_arg
from ..functions.dialect import Pattern
from ..catalog import patterns as p
from ..operators import file_rules, grading, ingest, live_rules, passes, pipeline, report, target_rules
from ..schema import PASS_COLUMNS, complete, one_hit, publish
from ..sources import corpus, files as file_source, http, probes
from ..streaming import streams
from . import fleet as fleet_plan
from .staging import materialize, staging_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE_PATTERN = Pattern(r"\b(\w+)\.\s+(\w+)")


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _files(spark: SparkSession, d: str) -> DataFrame:
    return file_source.scannable(corpus.files(spark, d))


def _facts(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    return target_rules.facts_of(_files(spark, d), *kinds)


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    return file_source.manifests(_files(spark, d))


def _deps_of_files(spark: SparkSession, d: str) -> DataFrame:
    return file_source.manifest_deps(_manifests(spark, d))


# ---- §2.1 sources -----------------------------------------------------------


@query("target_classify")
def _(spark, d):
    t = corpus.targets(spark, d)
    return t.select("target_id", "value", paths.target_type(F.col("value")).alias("type"))


@query("files_source")
def _(spark, d):
    """A stored table of files, whichever layout it was written in."""
    path = staging_path(spark, "files")
    corpus.files(spark, d).write.parquet(path)
    files = file_source.read_table(spark, path)
    return files.select("target_id", "path", F.octet_length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("digest"))


@query("files_ignore")
def _(spark, d):
    return corpus.files(spark, d).where(~paths.is_ignored(F.col("path"))).select("target_id", "path")


@query("files_size_cap")
def _(spark, d):
    big = F.repeat("text", F.lit(60))
    rows = corpus.table(spark, d, "documents").select("doc_id", big.alias("content"))
    return rows.select(
        "doc_id",
        F.octet_length("content").cast("bigint").alias("n_bytes"),
        file_source.size_cap(F.col("content")).isNotNull().alias("kept"),
    )


@query("files_kinds")
def _(spark, d):
    return file_source.with_kinds(corpus.files(spark, d)).drop("content")


@query("manifest_pick")
def _(spark, d):
    return file_source.pick_manifest(_files(spark, d))


@query("manifest_deps")
def _(spark, d):
    return _deps_of_files(spark, d)


@query("headers_normalize")
def _(spark, d):
    maps = http.normalize_headers(corpus.raw_headers(spark, d))
    return maps.select("target_id", "url", F.explode("headers").alias("name", "value"))


@query("cookies_split")
def _(spark, d):
    return http.split_cookies(http.normalize_headers(corpus.raw_headers(spark, d)))


@query("script_src_extract")
def _(spark, d):
    return http.extract_scripts(corpus.homepages(spark, d))


def _bundles(spark, d):
    return http.select_bundles(http.extract_scripts(corpus.homepages(spark, d)), corpus.responses(spark, d))


def _discovered(spark, d):
    return http.discover_config(http.haystack_values(corpus.homepages(spark, d), corpus.responses(spark, d)))


@query("bundle_select")
def _(spark, d):
    return _bundles(spark, d)


@query("discover_config")
def _(spark, d):
    return _discovered(spark, d)


@query("probe_plan_tables")
def _(spark, d):
    return probes.plan_tables(_discovered(spark, d))


@query("probe_plan_dotfiles")
def _(spark, d):
    return probes.plan_dotfiles(corpus.homepages(spark, d))


@query("probe_plan_sourcemaps")
def _(spark, d):
    return http.map_candidates(_bundles(spark, d))


@query("reports_source")
def _(spark, d):
    reports = corpus.engine_reports(spark, d)
    out = None
    for engine in ("gitleaks", "semgrep", "osv-scanner"):
        rows = ingest.parse_reports(reports, engine).select(
            "report_id", "target_id", F.lit(engine).alias("engine"), F.size("data").alias("n_items")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- §2.2 functions ---------------------------------------------------------


@query("regex_scan_lines")
def _(spark, d):
    docs = corpus.spread(corpus.table(spark, d, "documents"))
    rows = docs.select("doc_id", F.inline(text.scan(F.col("text"), LINE_PATTERN)))
    return rows.select(
        "doc_id", "ord", "line", "match",
        text.group(F.col("match"), LINE_PATTERN, 1).alias("g1"), text.group(F.col("match"), LINE_PATTERN, 2).alias("g2"),
    )


@query("redact_value")
def _(spark, d):
    docs = corpus.spread(corpus.table(spark, d, "documents"))
    return docs.select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query("shannon_entropy")
def _(spark, d):
    docs = corpus.spread(corpus.table(spark, d, "documents"))
    return docs.select("doc_id", F.round(text.text_entropy(F.col("text")), 6).alias("entropy"))


def _versions(spark, d):
    return corpus.deps(spark, d).withColumn("v", version.parse_version(F.col("declared")))


@query("parse_version")
def _(spark, d):
    rows = _versions(spark, d).select("target_id", "pkg", "declared", "v.*")
    return rows.select("target_id", "pkg", "declared", *[F.col(c).cast("bigint").alias(c) for c in ("major", "minor", "patch")])


@query("version_compare")
def _(spark, d):
    rows = _versions(spark, d)
    other = version.version_literal("7.3.10")
    return rows.select(
        "target_id", "pkg", "declared",
        version.compare(F.col("v"), other).alias("cmp"),
        (F.col("v") < other).alias("lt"),
        (F.col("v") >= other).alias("gte"),
    )


@query("version_in_range")
def _(spark, d):
    inside = version.in_range(F.col("v"), version.version_literal("3.2.0"), version.version_literal("9.4.5"))
    return _versions(spark, d).select("target_id", "pkg", "declared", inside.alias("inside"))


@query("version_format")
def _(spark, d):
    return _versions(spark, d).select("target_id", "pkg", "declared", version.format_version(F.col("v")).alias("formatted"))


def _events(spark, d):
    return corpus.finding_events(corpus.table(spark, d, "events"))


def _key() -> Column:
    return identity.dedupe_key(F.col("rule_id"), F.col("file"), F.col("line"), F.col("url"))


@query("dedupe_key")
def _(spark, d):
    return _events(spark, d).select("event_id", _key().alias("dedupe_key"))


@query("finding_id")
def _(spark, d):
    return _events(spark, d).select("event_id", identity.finding_id(_key()).alias("finding_id"))


@query("canonical_identity")
def _(spark, d):
    ident = identity.canonical_identity(F.col("category"), F.col("file"), F.col("line"))
    return _events(spark, d).select("event_id", ident.alias("identity"))


@query("dep_package")
def _(spark, d):
    rows = corpus.deps(spark, d)
    named = F.concat(F.lit("Uses "), F.lit("@Scope/"), "pkg", F.lit("@"), "declared")
    return rows.select("target_id", "pkg", "declared", identity.dep_package(F.lit(None).cast("string"), named, F.col("pkg")).alias("package"))


@query("severity_rank")
def _(spark, d):
    return _events(spark, d).select("event_id", "severity", identity.severity_rank(F.col("severity")).alias("severity_rank"))


@query("path_class")
def _(spark, d):
    return corpus.files(spark, d).select("target_id", "path", paths.path_class(F.col("path")).alias("path_class"))


def _predicate(name: str, make: Callable[[], Column]) -> None:
    def run(spark, d):
        return corpus.files(spark, d).select("target_id", "path", make().alias(name))

    QUERIES[name] = run


_predicate("is_source_file", lambda: paths.is_source(F.col("path")))
_predicate("is_code_or_config", lambda: paths.is_code_or_config(F.col("path")))
_predicate("is_handler", lambda: paths.is_body_handler(F.col("content")))
_predicate("is_react_view", lambda: paths.is_react_view(F.col("content")))
_predicate("is_server_route", lambda: paths.is_server_route(F.col("path"), F.col("content")))


@query("looks_like_supabase")
def _(spark, d):
    return target_rules.looks_hosted(_facts(spark, d, "hosted_db"), _deps_of_files(spark, d))


def _calls(spark, d):
    sources = _files(spark, d).where(paths.is_source(F.col("path")))
    found = sources.select("target_id", "path", F.inline(call_sites(F.col("content"))))
    return found.select("target_id", "path", "ord", "line", "callee", "arg0")


@query("call_sites")
def _(spark, d):
    return _calls(spark, d)


@query("tainted_arg")
def _(spark, d):
    return _calls(spark, d).select("target_id", "path", "ord", "callee", "arg0", tainted_arg(F.col("arg0")).alias("tainted"))


def _secret_values(spark, d):
    """The value of every secret shape in every whole file."""
    found = _files(spark, d).select("target_id", "path", F.inline(text.scan(F.col("content"), p.SECRET_SHAPES)))
    assigned = text.group(F.col("match"), p.ASSIGNED_VALUE, 1)
    return found.select("target_id", "path", "ord", "line", F.when(assigned != "", assigned).otherwise(F.col("match")).alias("value"))


@query("classify_secret")
def _(spark, d):
    return _secret_values(spark, d).select("target_id", "path", "ord", secrets.classify_secret(F.col("value")).alias("verdict"))


@query("example_conn_string")
def _(spark, d):
    return _secret_values(spark, d).select("target_id", "path", "ord", secrets.example_conn_string(F.col("value")).alias("is_example"))


# ---- §2.3 file rules --------------------------------------------------------


def _file_rule(rule: file_rules.FileRule) -> None:
    def run(spark, d):
        return publish(file_rules.run_rule(_files(spark, d), rule))

    QUERIES[rule.key] = run


for _rule in file_rules.FILE_RULES + file_rules.PATTERN_PACK_RULES:
    _file_rule(_rule)


@query("rule_committed_env")
def _(spark, d):
    return publish(target_rules.committed_env(_facts(spark, d, "env_values", "gitignore_env")))


@query("rule_image_wildcard")
def _(spark, d):
    return publish(target_rules.image_wildcard(_facts(spark, d, "config")))


@query("rule_config_headers")
def _(spark, d):
    return publish(target_rules.config_headers(_facts(spark, d, "config")))


# ---- §2.4 target rules ------------------------------------------------------


@query("sql_tables_created")
def _(spark, d):
    return target_rules.tables_created(_facts(spark, d, "sql_created"))


@query("sql_tables_rls")
def _(spark, d):
    return target_rules.tables_secured(_facts(spark, d, "sql_rls"))


@query("rls_missing_tables")
def _(spark, d):
    return target_rules.tables_missing(_facts(spark, d, "sql_created", "sql_rls"))


@query("rule_rls_disabled")
def _(spark, d):
    facts = _facts(spark, d, "sql_created", "sql_rls", "hosted_db")
    return publish(target_rules.rls_disabled(facts, _deps_of_files(spark, d)))


@query("webhook_verified_flags")
def _(spark, d):
    return target_rules.verified_flags(_facts(spark, d, "verified"))


@query("rule_webhook_unverified")
def _(spark, d):
    return publish(target_rules.webhook_unverified(_facts(spark, d, "webhook", "verified")))


@query("rule_middleware_cve")
def _(spark, d):
    return publish(target_rules.middleware_cve(_deps_of_files(spark, d)))


@query("rule_known_cve")
def _(spark, d):
    return publish(target_rules.known_cve(corpus.deps(spark, d).distinct(), corpus.advisories(spark, d)))


@query("rule_known_cve_floor")
def _(spark, d):
    return publish(target_rules.known_cve(_deps_of_files(spark, d)))


@query("pass_good_practices")
def _(spark, d):
    return target_rules.good_practices(_manifests(spark, d), _facts(spark, d, "config"))


# ---- §2.5 live rules --------------------------------------------------------


@query("rule_headers_live")
def _(spark, d):
    return publish(live_rules.missing_headers(corpus.homepages(spark, d)))


@query("pass_headers_live")
def _(spark, d):
    return live_rules.pass_headers(corpus.homepages(spark, d))


@query("rule_weak_cookie")
def _(spark, d):
    return publish(live_rules.weak_cookies(corpus.homepages(spark, d)))


@query("rule_exposed_file")
def _(spark, d):
    return publish(live_rules.exposed_files(corpus.homepages(spark, d), corpus.probe_responses(spark, d)))


@query("rule_sourcemap")
def _(spark, d):
    return publish(live_rules.source_maps(_bundles(spark, d), corpus.probe_responses(spark, d)))


@query("pass_sourcemap")
def _(spark, d):
    return live_rules.pass_source_maps(_bundles(spark, d), corpus.probe_responses(spark, d))


@query("rule_rls_probe")
def _(spark, d):
    return publish(live_rules.open_tables(_discovered(spark, d), corpus.probe_responses(spark, d)))


@query("pass_rls_probe")
def _(spark, d):
    return live_rules.pass_closed_tables(_discovered(spark, d), corpus.probe_responses(spark, d))


@query("rule_bundle_secrets")
def _(spark, d):
    return publish(live_rules.bundle_secrets(_bundles(spark, d)))


# ---- §2.6 ingestion ---------------------------------------------------------


@query("ingest_gitleaks")
def _(spark, d):
    return publish(ingest.ingest_gitleaks(corpus.engine_reports(spark, d)))


@query("ingest_semgrep")
def _(spark, d):
    return publish(ingest.ingest_semgrep(corpus.engine_reports(spark, d)))


def _advisory_rows(spark, d):
    return ingest.advisory_rows(corpus.engine_reports(spark, d))


@query("osv_severity")
def _(spark, d):
    return _advisory_rows(spark, d).select("report_id", "v_pos", "name", "advisory", "severity")


@query("osv_fixed_version")
def _(spark, d):
    return _advisory_rows(spark, d).select("report_id", "v_pos", "name", "advisory", "fixed")


@query("osv_max_fix")
def _(spark, d):
    grouped = _advisory_rows(spark, d).groupBy("report_id", "name", "version").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("v_pos", "fixed"))), lambda x: x["fixed"]).alias("fixes")
    )
    fixes = F.filter("fixes", lambda x: x.isNotNull())
    return grouped.select("report_id", "name", "version", ingest.max_fix(fixes).alias("max_fix"))


@query("ingest_osv")
def _(spark, d):
    return publish(ingest.ingest_osv(corpus.engine_reports(spark, d)))


@query("engine_flags")
def _(spark, d):
    return ingest.engine_flags(corpus.engine_reports(spark, d))


@query("path_relative")
def _(spark, d):
    items = ingest.report_items(corpus.engine_reports(spark, d), "gitleaks")
    return items.select(
        "report_id", "pos", F.col("r.File").alias("path"), paths.relative_path(F.col("root"), F.col("r.File")).alias("relative")
    )


# ---- §2.7 pipeline ----------------------------------------------------------


def _raw_secret_hits(spark, d):
    """Every secret shape of every file as a finding that still carries its raw value."""
    from ..schema import hit

    return one_hit(
        _secret_values(spark, d),
        hit("secret_generic", evidence=text.redact(F.col("value")), file=F.col("path"), line=F.col("line"), ord=F.col("ord"), raw=F.col("value")),
    )


def _rule_hits(spark, d, *keys: str) -> DataFrame:
    files = _files(spark, d)
    rules = [file_rules.RULES_BY_KEY[k] for k in keys]
    applies = F.lit(False)
    for r in rules:
        applies = applies | r.applies(F.col("path"))
    prepared = file_rules.file_columns(files.where(applies), any(r.needs_calls for r in rules))
    return prepared.select("target_id", F.inline(file_rules.hits_of(rules)))


@query("suppress_public_secrets")
def _(spark, d):
    return publish(pipeline.drop_public_secrets(complete(_raw_secret_hits(spark, d))))


@query("strip_side_channel")
def _(spark, d):
    return pipeline.strip_side_channel(complete(_raw_secret_hits(spark, d))).drop("params", "emit_src", "emit_ord")


@query("suppress_static_rate_limit")
def _(spark, d):
    rows = _events(spark, d).select(
        "target_id", "event_id",
        F.when(F.col("event_id") % 2 == 0, "RATE_LIMIT_MISSING").otherwise(F.col("rule_id")).alias("rule_id"),
        "file",
        F.when(F.col("event_id") % 3 == 0, "https://x.test/_next/static/chunks/main.js")
        .when(F.col("event_id") % 3 == 1, "https://x.test/api/login").alias("url"),
        F.lit(None).cast("string").alias("evidence"),
    )
    return pipeline.drop_static_rate_limits(rows)


@query("downrank_public_cors")
def _(spark, d):
    rows = _events(spark, d).select(
        "target_id", "event_id",
        F.when(F.col("event_id") % 2 == 0, "WEB_CONFIG_CORS_WILDCARD_CREDENTIALS").otherwise(F.col("rule_id")).alias("rule_id"),
        F.when(F.col("event_id") % 3 == 0, "app/api/public/route.ts").otherwise(F.col("file")).alias("file"),
        F.when(F.col("event_id") % 5 == 0, "https://x.test/v2/public").alias("url"),
        F.lit(None).cast("string").alias("evidence"),
        "confidence",
    )
    return pipeline.downrank_public_cors(rows)


def _reported(spark, d):
    """Engine findings plus native dependency and code findings."""
    native = target_rules.known_cve(_deps_of_files(spark, d))
    return complete(
        ingest.ingest_reports(corpus.engine_reports(spark, d))
        .unionByName(native)
        .unionByName(_rule_hits(spark, d, "rule_insecure_defaults", "rule_sql_injection", "rule_hardcoded_secrets"))
    )


@query("contextualize")
def _(spark, d):
    return publish(pipeline.contextualize(pipeline.suppress(_reported(spark, d))))


@query("dedupe_findings")
def _(spark, d):
    return publish(pipeline.dedupe(pipeline.suppress(_reported(spark, d))))


def _dependency_findings(spark, d):
    native = target_rules.known_cve(_deps_of_files(spark, d))
    declared = _deps_of_files(spark, d).where(F.col("pkg") == "next")
    plain = declared.withColumn("declared", F.regexp_replace("declared", "^\\^", ""))
    return complete(
        ingest.ingest_osv(corpus.engine_reports(spark, d)).unionByName(native).unionByName(target_rules.known_cve(plain))
    )


@query("reconcile_deps")
def _(spark, d):
    return publish(pipeline.reconcile_deps(pipeline.suppress(_dependency_findings(spark, d))))


@query("route_deps")
def _(spark, d):
    deps, rest = pipeline.route_deps(pipeline.suppress(_reported(spark, d)))
    cols = ["target_id", "rule_id", "category", "file", "line", "url"]
    return deps.select(*cols, F.lit("held").alias("route")).unionByName(rest.select(*cols, F.lit("stream").alias("route")))


# ---- §2.8 grade and report --------------------------------------------------


@query("counts_by_severity")
def _(spark, d):
    return grading.counts_by_severity(_events(spark, d)).select("target_id", *lists.SEVERITIES)


@query("score")
def _(spark, d):
    daily = _events(spark, d).withColumn("target_id", F.col("target_id") * 1000 + F.dayofyear("ts"))
    return grading.grade(daily).select("target_id", "score")


@query("grade")
def _(spark, d):
    daily = _events(spark, d).withColumn("target_id", F.col("target_id") * 1000 + F.dayofyear("ts"))
    return grading.grade(daily)


@query("ci_gate")
def _(spark, d):
    daily = _events(spark, d).withColumn("target_id", F.col("target_id") * 1000 + F.dayofyear("ts"))
    return grading.ci_gate(grading.grade(daily))


def _all_passes(spark, d):
    home = corpus.homepages(spark, d)
    return live_rules.pass_headers(home).unionByName(live_rules.pass_headers(home)).unionByName(
        target_rules.good_practices(_manifests(spark, d), _facts(spark, d, "config"))
    )


@query("pass_dedupe")
def _(spark, d):
    return passes.pass_dedupe(_all_passes(spark, d)).select(*PASS_COLUMNS)


@query("pass_clean_category")
def _(spark, d):
    found = complete(_rule_hits(spark, d, "rule_sql_injection", "rule_missing_auth", "rule_mass_assignment", "rule_insecure_upload"))
    return passes.clean_categories(corpus.targets(spark, d), found)


@query("mode_match")
def _(spark, d):
    return passes.mode_match(corpus.targets(spark, d))


@query("schema_validate")
def _(spark, d):
    e = F.col("event_id")
    def spoiled(every: int, value: Column, bad=None) -> Column:
        return F.when(e % every == 0, F.lit(bad)).otherwise(value)

    dirty = _events(spark, d).select(
        "event_id",
        spoiled(41, F.col("target_id")).alias("target_id"),
        spoiled(11, F.col("rule_id")).alias("rule_id"),
        spoiled(13, F.col("category"), "other").alias("category"),
        spoiled(17, F.col("severity"), "urgent").alias("severity"),
        spoiled(19, F.col("confidence")).alias("confidence"),
        spoiled(23, F.lit("whitebox")).alias("mode"),
        spoiled(43, F.col("source"), "hearsay").alias("source"),
        spoiled(29, F.concat(F.lit("Title "), "rule_id")).alias("title"),
        spoiled(31, F.concat(F.lit("Why "), "rule_id")).alias("why"),
        spoiled(37, F.col("line"), -1).alias("line"),
    )
    return report.split_valid(dirty)[1]


@query("findings_by_severity")
def _(spark, d):
    """Staged before it is sorted: a range sort reads its input twice, once to find the bounds."""
    return report.in_order(materialize(report.listing(publish(pipeline.suppress(_reported(spark, d)))), "listing"))


def fleet_of(spark: SparkSession, d: str) -> fleet_plan.Fleet:
    return fleet_plan.Fleet(
        targets=corpus.targets(spark, d),
        files=corpus.files(spark, d),
        homepages=corpus.homepages(spark, d),
        responses=corpus.responses(spark, d),
        probe_responses=corpus.probe_responses(spark, d),
        engine_reports=corpus.engine_reports(spark, d),
    )


@query("fleet_scan")
def _(spark, d):
    fleet = fleet_of(spark, d)
    return fleet_plan.summary(fleet, fleet_plan.scan_fleet(fleet))


def _reports(spark, d):
    fleet = fleet_of(spark, d)
    return fleet_plan.reports(fleet, fleet_plan.scan_fleet(fleet), "2024-01-01T00:00:00Z", "2024-01-01T00:10:00Z")


@query("report_assemble")
def _(spark, d):
    made = _reports(spark, d)
    head = made.summary.select(
        "target_id", "grade", "score",
        F.array_join(F.array_sort(F.transform("passed", lambda x: x["id"])), ">").alias("passed"),
        F.col("counts.passed").alias("n_passed"),
        F.col("engines.gitleaks").alias("gitleaks"),
    )
    return head.join(made.details.select("target_id", "severity", "rule_id", "file", "line", "url", "mode"), "target_id", "left")


@query("report_sink")
def _(spark, d):
    made = _reports(spark, d)
    path = staging_path(spark, "reports")
    report.write_reports(made, path, "2024-01-01")
    summary = spark.read.schema(made.summary.schema).json(f"{path}/summary/run_date=2024-01-01")
    details = spark.read.schema(made.details.drop("report_order").schema).json(f"{path}/details/run_date=2024-01-01")
    counted = details.groupBy("target_id").agg(F.count("*").alias("n_findings"))
    return summary.select("target_id", "grade", "score").join(counted, "target_id", "left").withColumn(
        "n_findings", F.coalesce("n_findings", F.lit(0)).cast("bigint")
    )


# ---- §2.9 streaming ---------------------------------------------------------


@query("stream_findings")
def _(spark, d):
    return streams.run_findings(spark, d)


@query("stream_progress")
def _(spark, d):
    return streams.run_progress(spark, d)


@query("stream_upsert")
def _(spark, d):
    return streams.run_upsert(spark, d)


@query("stream_backpressure")
def _(spark, d):
    return streams.run_backpressure(spark, d)


@query("stream_deps_hold")
def _(spark, d):
    return streams.run_deps_hold(spark, d)

"""The fleet scan: every rule over every target, down to one grade per target.

``files`` is read once.  All file rules and all facts come out of one projection and
are staged; what follows works on rows that are orders of magnitude smaller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.texts import VARIANTS, Variant
from ..functions.secrets import classify_secret
from ..operators import file_rules, grading, ingest, live_rules, passes as pass_rules, pipeline, report, target_rules
from ..operators.file_rules import FileRule
from ..schema import HIT_FIELDS, SIDE_CHANNEL, publish
from ..sources import files as file_source, http
from .registry import RULE_META, Rule, known_variants, log, run_isolated, union_all
from .staging import Run, shuffled


_HIT_COLUMNS = [c for c in HIT_FIELDS if c not in SIDE_CHANNEL]


@dataclass
class Fleet:
    """Input tables; any part but ``targets`` may be missing."""

    targets: DataFrame
    files: DataFrame | None = None
    homepages: DataFrame | None = None
    responses: DataFrame | None = None
    probe_responses: DataFrame | None = None
    engine_reports: DataFrame | None = None
    advisories: DataFrame | None = None
    extra_rules: Sequence[Rule] = field(default_factory=tuple)  # over staged tables
    extra_file_rules: Sequence[FileRule] = field(default_factory=tuple)  # join the one pass over the files


@dataclass
class FleetResult:
    findings: DataFrame  # settled compact rows that keep to the schema
    quarantine: DataFrame  # those that do not, with ``violations``
    passes: DataFrame
    graded: DataFrame
    engines: DataFrame
    failed: DataFrame  # added file rules that could not be computed, by target, with the number of files
    run: Run  # holds the tables above; drop it once the results are written
    variants: Mapping[str, Variant] = field(default_factory=lambda: VARIANTS)

    def published(self) -> DataFrame:
        return publish(self.findings, variants=self.variants)


def _without_raw(hits: Column) -> Column:
    """Drop public secrets and the raw values, so that hits may be staged."""
    # Only secret rules set a raw value.
    kept = F.filter(hits, lambda h: h["raw"].isNull() | (classify_secret(h["raw"]) != "public"))
    return F.transform(kept, lambda h: h.dropFields(*SIDE_CHANNEL))


def _checked(hits: DataFrame) -> DataFrame:
    """Hits of a table without public secrets."""
    return hits.where(F.col("raw").isNull() | (classify_secret(F.col("raw")) != "public"))


def _emitted(hits: DataFrame) -> DataFrame:
    """The columns all rules share, without raw values, ready to be staged."""
    return hits.select("target_id", *_HIT_COLUMNS)


_scan_expressions: dict[str, tuple[Column, Column]] = {}


def _scan_columns(spark: SparkSession) -> tuple[Column, Column]:
    """(hits, facts) over the prepared file columns, built once per application."""
    app = spark.sparkContext.applicationId
    if app not in _scan_expressions:
        kinds = [r.kind for r in target_rules.FACT_RULES]
        _scan_expressions[app] = (
            _without_raw(file_rules.hits_of(file_rules.FILE_RULES)),
            target_rules.facts_column(kinds),
        )
    return _scan_expressions[app]


def _buildable(prepared: DataFrame, rules: Sequence[FileRule]) -> list[tuple[str, Column]]:
    """Guarded hits of the added rules whose expressions can be built over the file columns."""
    out = []
    for rule in rules:
        try:
            hits = file_rules.guarded_hits(rule)
            prepared.select(hits)
            out.append((rule.key, hits))
        except Exception as error:  # noqa: BLE001 - a broken rule must not stop the others
            log.warning("file rule %s skipped: %s", rule.key, error)
    return out


def scan_files(files: DataFrame, extra: Sequence[FileRule] = ()) -> DataFrame:
    """One pass: ``target_id, hits, facts, failed`` for each file that has any.

    ``failed`` names the added rules that could not be computed on a file; the file's other hits stand.
    """
    prepared = file_rules.file_columns(file_source.scannable(files), True)
    hits, facts = _scan_columns(files.sparkSession)
    added = _buildable(prepared, extra)
    failed = F.array().cast("array<string>")
    if added:
        # every rule is computed once: its hits first, what follows reads them
        results = F.struct(*[h.alias(f"rule{i}") for i, (_, h) in enumerate(added)])
        prepared = prepared.select("*", F.inline(F.array(F.struct(results.alias("added")))))
        own = [F.col(f"added.rule{i}") for i in range(len(added))]
        hits = F.flatten(F.array(hits, *[_without_raw(F.coalesce(h, file_rules.no_hits())) for h in own]))
        failed = F.filter(F.array(*[F.when(h.isNull(), F.lit(key)) for h, (key, _) in zip(own, added, strict=True)]), lambda k: k.isNotNull())
    # ``inline`` keeps the filter from being pushed into the arrays, which would
    # compute them a second time.
    both = F.inline(F.array(F.struct(hits.alias("hits"), facts.alias("facts"), failed.alias("failed"))))
    return prepared.select("target_id", both).where((F.size("hits") > 0) | (F.size("facts") > 0) | (F.size("failed") > 0))


def failures(staged: DataFrame) -> DataFrame:
    """``target_id, rule, files``: on how many files of a target an added rule failed."""
    return staged.select("target_id", F.explode("failed").alias("rule")).groupBy("target_id", "rule").agg(F.count("*").alias("files"))


def whitebox_rules() -> list[Rule]:
    """Rules over staged hits, facts and dependencies."""

    def rule(rule_id: str, run) -> Rule:
        category, mode, ord = RULE_META[rule_id]
        return Rule(rule_id, category, mode, ord, run)

    return [
        rule("SECRETS_HARDCODED", lambda t: t["hits"]),
        rule("SECRETS_COMMITTED_ENV", lambda t: target_rules.committed_env(t["facts"])),
        rule("DATABASE_SUPABASE_RLS", lambda t: target_rules.rls_disabled(t["facts"], t["deps"])),
        rule("AUTH_NEXTJS_MIDDLEWARE_BYPASS", lambda t: target_rules.middleware_cve(t["deps"])),
        rule("API_WEBHOOK_UNVERIFIED", lambda t: target_rules.webhook_unverified(t["facts"])),
        rule(
            "WEB_CONFIG_NEXTCONFIG",
            lambda t: target_rules.image_wildcard(t["facts"]).unionByName(target_rules.config_headers(t["facts"])),
        ),
        rule("DEPENDENCIES_KNOWN_CVE", lambda t: target_rules.known_cve(t["deps"], t.get("advisories"))),
    ]


def blackbox_rules() -> list[Rule]:
    """Rules over staged homepages, bundles and probe answers."""

    def rule(rule_id: str, run) -> Rule:
        category, mode, ord = RULE_META[rule_id]
        return Rule(rule_id, category, mode, ord, run)

    return [
        rule("SECRETS_HARDCODED", lambda t: t["bundle_hits"]),
        rule("DATABASE_SUPABASE_RLS_OPEN_LIVE", lambda t: live_rules.open_tables(t["discovered"], t["probes"])),
        rule(
            "WEB_CONFIG_HEADERS_LIVE",
            lambda t: live_rules.missing_headers(t["homepages"]).unionByName(live_rules.weak_cookies(t["homepages"])),
        ),
        rule("WEB_CONFIG_EXPOSED_FILE", lambda t: live_rules.exposed_files(t["homepages"], t["probes"])),
        rule("WEB_CONFIG_EXPOSED_SOURCEMAP", lambda t: live_rules.source_maps(t["bundles"], t["probes"])),
    ]


def _whitebox(fleet: Fleet, run: Run) -> tuple[list[DataFrame], list[DataFrame], DataFrame, DataFrame]:
    staged = run.stage(scan_files(fleet.files, fleet.extra_file_rules), "scan")
    facts = staged.select("target_id", F.inline("facts"))
    hits = staged.select("target_id", F.inline("hits"))
    manifests = file_source.manifests(
        facts.where(F.col("kind") == "manifest").select("target_id", "path", F.col("text").alias("content"))
    )
    tables = {"hits": hits, "facts": facts, "deps": file_source.manifest_deps(manifests)}
    if fleet.advisories is not None:
        tables["advisories"] = fleet.advisories
    findings = [
        _emitted(df)
        for df in run_isolated([*whitebox_rules(), *(r for r in fleet.extra_rules if r.applies_to("repo"))], tables)
    ]
    secrets = hits.where(F.startswith(F.col("variant"), F.lit("secret_")))
    return findings, [target_rules.good_practices(manifests, facts)], secrets, failures(staged)


def _blackbox(fleet: Fleet, run: Run) -> tuple[list[DataFrame], list[DataFrame], DataFrame, DataFrame]:
    home = fleet.homepages.select(
        "target_id",
        "url",
        "headers",
        F.lit(-1).alias("ord"),
        http.script_urls(F.col("url"), F.col("body")).alias("scripts"),
        *http.config_values(F.col("body")),
    )
    home = run.stage(home, "homepages")
    scripts = home.select("target_id", F.posexplode("scripts").alias("ord", "script_url"))
    low = F.lower("body")
    shrunk = http.select_bundles(
        scripts,
        fleet.responses,
        *http.config_values(F.col("body")),
        _without_raw(live_rules.secret_hits(F.col("body"), low, url=F.col("url"))).alias("hits"),
    )
    bundles = run.stage(shrunk, "bundles")
    probes = run.stage(live_rules.judge_probes(fleet.probe_responses), "probes")
    values = ["target_id", "ord", *http.CONFIG_VALUES]
    discovered = run.stage(http.discover_config(home.select(*values).unionByName(bundles.select(*values))), "discovered")
    tables = {
        "homepages": home,
        "bundles": bundles,
        "bundle_hits": bundles.select("target_id", F.inline("hits")),
        "discovered": discovered,
        "probes": probes,
    }
    findings = [
        _emitted(df)
        for df in run_isolated([*blackbox_rules(), *(r for r in fleet.extra_rules if r.applies_to("url"))], tables)
    ]
    passes = [
        live_rules.pass_headers(home),
        live_rules.pass_source_maps(bundles, probes),
        live_rules.pass_closed_tables(discovered, probes),
    ]
    return findings, passes, tables["bundle_hits"], home


def scan_fleet(fleet: Fleet, skip_engines: bool = False) -> FleetResult:
    """Run everything the fleet's tables allow.

    All results are staged in one folder of the run, so the caller's tables are read once, and the working tables
    behind the results are dropped here already.
    """
    spark = fleet.targets.sparkSession
    variants = known_variants([*fleet.extra_rules, *fleet.extra_file_rules])
    work, run = Run(spark, "scan-work"), Run(spark, "scan-result")
    findings: list[DataFrame] = []
    passes: list[DataFrame] = []
    failed = spark.createDataFrame([], "target_id bigint, rule string, files bigint")
    if fleet.files is not None:
        found, passed, secrets, failed = _whitebox(fleet, work)
        findings += found
        passes += passed
        passes.append(pass_rules.no_secrets(fleet.targets.where(F.col("type") == "repo"), secrets))
    if fleet.homepages is not None:
        found, passed, secrets, home = _blackbox(fleet, work)
        findings += found
        passes += passed
        reached = fleet.targets.join(shuffled(home.select("target_id")), "target_id", "left_semi")
        passes.append(pass_rules.no_secrets(reached, secrets))
    if fleet.engine_reports is not None and not skip_engines:
        findings.append(_emitted(_checked(ingest.ingest_reports(fleet.engine_reports))))
        engines = ingest.engine_flags(fleet.engine_reports)
    else:
        engines = fleet.targets.select("target_id", *[F.lit(False).alias(c) for c in ("semgrep", "gitleaks", "osv_scanner")])
    # judged where they are made, once, and dealt evenly: files of the same size may hold very different numbers of rows
    emitted = work.stage(pipeline.judge(union_all(findings), variants).hint("rebalance"), "emitted")
    settled = work.stage(pipeline.settle(emitted, variants).withColumn("violations", report.violations(report.COMPACT_FIELDS)), "settled")
    valid = run.stage(settled.where("violations = ''").drop("violations"), "findings")
    passes.append(pass_rules.clean_categories(fleet.targets, valid))
    result = FleetResult(
        findings=valid,
        quarantine=run.stage(settled.where("violations <> ''"), "quarantine"),
        passes=run.stage(pass_rules.pass_dedupe(union_all(passes)), "passes"),
        graded=grading.grade(valid, fleet.targets),
        engines=run.stage(engines, "engines"),
        failed=run.stage(failed, "failed"),
        run=run,
        variants=variants,
    )
    work.drop()
    return result


def summary(fleet: Fleet, result: FleetResult) -> DataFrame:
    """One row per target: counts, passed checks, score, grade."""
    passed = result.passes.groupBy("target_id").agg(F.count("*").cast("int").alias("passed"))
    return (
        fleet.targets.join(shuffled(result.graded), "target_id")
        .join(shuffled(passed), "target_id", "left")
        .withColumn("passed", F.coalesce("passed", F.lit(0)))
    )


def reports(fleet: Fleet, result: FleetResult, started_at: str, finished_at: str) -> report.Reports:
    """One summary row per target, and all findings in report order as its detail table."""
    return report.assemble(
        fleet.targets,
        result.graded,
        publish(result.findings, ("phase", "rule_ord", "emit_src", "emit_ord"), result.variants),
        result.passes,
        result.engines,
        started_at,
        finished_at,
    )

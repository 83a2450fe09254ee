"""Black-box rules over crawled snapshots.

Inputs: ``homepages(target_id, url, headers, body)`` holds reachable targets only,
``responses(target_id, url, status, body)`` what a crawler fetched, and
``probe_responses`` the answers to the plans of ``sources.probes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import lists, patterns as p
from ..functions.secrets import classify_secret
from ..functions.text import matches
from ..plans.staging import shuffled
from ..schema import PASS_COLUMNS, hit, lookup, one_hit
from ..sources.http import map_candidates, split_cookies
from ..sources.probes import plan_dotfiles, plan_tables
from .file_rules import secret_hits


def _pass(row: tuple, mode: str = "blackbox") -> list[Column]:
    return [F.lit(x).alias(k) for k, x in zip(PASS_COLUMNS[1:], (*row, mode))]


def _header_grid(homepages: DataFrame) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(lists.REQUIRED_HEADERS)]
    required = lookup(
        homepages.sparkSession, rows, "ord int, header string, label string, sev string, pass_title string"
    )
    return (
        homepages.select("target_id", "url", F.map_keys("headers").alias("names"))
        .crossJoin(F.broadcast(required))
        .withColumn("present", F.array_contains("names", F.col("header")))
    )


def _header_id() -> Column:
    return F.upper(F.replace(F.col("header"), F.lit("-"), F.lit("_")))


def missing_headers(homepages: DataFrame) -> DataFrame:
    return one_hit(
        _header_grid(homepages).where(~F.col("present")),
        hit(
            "header_missing", rule_id=F.concat(F.lit("WEB_CONFIG_MISSING_"), _header_id()),
            severity=F.col("sev"), url=F.col("url"), params=[F.col("label")], ord=(0, F.col("ord")),
        ),
    )


def pass_headers(homepages: DataFrame) -> DataFrame:
    return _header_grid(homepages).where("present").select(
        "target_id",
        F.concat(F.lit("PASS_WEB_CONFIG_"), _header_id()).alias("id"),
        F.lit("web_config").alias("category"),
        F.col("pass_title").alias("title"),
        F.concat(F.lit("Your site sends the "), "label", F.lit(" response header.")).alias("detail"),
        F.lit("blackbox").alias("mode"),
    )


def weak_cookies(homepages: DataFrame) -> DataFrame:
    low = F.lower("cookie")
    weak = matches(low, p.SESSION_COOKIE) & (~low.contains("httponly") | ~low.contains("secure"))
    return one_hit(
        split_cookies(homepages).where(weak),
        hit(
            "weak_cookie", evidence=F.split_part("cookie", F.lit("="), F.lit(1)),
            url=F.col("url"), ord=(1, F.col("ord")),
        ),
    )


def _answers(plan: DataFrame, answers: DataFrame, how: str = "inner") -> DataFrame:
    return plan.join(shuffled(answers), ["target_id", "url"], how)


def judge_probes(probe_responses: DataFrame) -> DataFrame:
    """What the bodies of answered probes look like: one pass, after which no body is needed.

    ``kind`` is told by the URL; the verdicts of other kinds are NULL.  Judged answers are returned as they are.
    """
    if "kind" in probe_responses.columns:
        return probe_responses
    url, body, dotfile = F.col("url"), F.col("body"), F.lit(False)
    for path in lists.PROBED_DOTFILES:
        dotfile = dotfile | F.endswith(url, F.lit(path))
    kind = F.when(dotfile, "dotfile").when(F.endswith(url, F.lit(".map")), "map").when(url.contains("/rest/v1/"), "table")

    def of(name: str, verdict: Column) -> Column:
        return F.when(F.col("kind") == name, verdict)

    return (
        probe_responses.where(F.col("status") == 200)
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "target_id",
            "url",
            "kind",
            of("dotfile", matches(body, p.DOTFILE_ENV)).alias("env_shaped"),
            of("dotfile", matches(body, p.DOTFILE_GIT)).alias("git_shaped"),
            of("dotfile", matches(body, p.DOTFILE_VALUE) & (classify_secret(body) == "dangerous")).alias("secret"),
            F.coalesce(
                of("map", matches(body, p.MAP_VERSION) & matches(body, p.MAP_SOURCES)),
                of("table", F.size(F.from_json("body", "array<string>")) > 0),
                F.lit(False),
            ).alias("leaked"),
        )
    )


def _dotfile_answers(probe_responses: DataFrame) -> DataFrame:
    return judge_probes(probe_responses).where("kind = 'dotfile'").select("target_id", "url", "env_shaped", "git_shaped", "secret")


def exposed_files(homepages: DataFrame, probe_responses: DataFrame) -> DataFrame:
    path, secret = F.col("file_path"), F.col("secret")
    is_env = F.startswith(path, F.lit("/.env"))
    real = (is_env & F.col("env_shaped")) | ((path == "/.git/config") & F.col("git_shaped"))

    def as_hit(variant: str) -> Column:
        return hit(variant, url=F.col("url"), params=[F.col("label")], ord=F.col("ord"))

    return one_hit(
        _answers(plan_dotfiles(homepages), _dotfile_answers(probe_responses)).where(real),
        F.when(is_env & secret, as_hit("exposed_env_secret"))
        .when(is_env, as_hit("exposed_env"))
        .when(secret, as_hit("exposed_git_secret"))
        .otherwise(as_hit("exposed_git")),
    )


def _leaks(probe_responses: DataFrame, kind: str) -> DataFrame:
    """URLs that served a real source map, or rows of a table."""
    return judge_probes(probe_responses).where((F.col("kind") == kind) & F.col("leaked")).select("target_id", "url", "leaked")


def source_maps(bundles: DataFrame, probe_responses: DataFrame) -> DataFrame:
    """At most one finding per target: the first leaking bundle in page order."""
    first = (
        _answers(map_candidates(bundles), _leaks(probe_responses, "map"))
        .groupBy("target_id")
        .agg(F.min(F.struct("ord", "url")).alias("m"))
        .select("target_id", "m.url")
    )
    return one_hit(first, hit("sourcemap", evidence=F.col("url"), url=F.col("url")))


def _unleaked(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """Probed targets without a leaking answer, answered or not."""
    leaked = _answers(plan, answers, "left").groupBy("target_id").agg(
        F.bool_or(F.coalesce("leaked", F.lit(False))).alias("leaked")
    )
    return leaked.where(~F.col("leaked"))


def pass_source_maps(bundles: DataFrame, probe_responses: DataFrame) -> DataFrame:
    clean = _unleaked(map_candidates(bundles), _leaks(probe_responses, "map"))
    return clean.select("target_id", *_pass(lists.PASS_SOURCEMAPS))


def open_tables(discovered: DataFrame, probe_responses: DataFrame) -> DataFrame:
    """Probed tables that returned rows to the public key."""
    return one_hit(
        _answers(plan_tables(discovered), _leaks(probe_responses, "table")),
        hit(
            "rls_open_live",
            evidence=F.concat(
                F.lit('"'), "table_name",
                F.lit('" returned row data to an unauthenticated request (limit=1; row content discarded)'),
            ),
            url=F.col("url"), params=[F.col("table_name")], ord=F.col("ord"),
        ),
    )


def pass_closed_tables(discovered: DataFrame, probe_responses: DataFrame) -> DataFrame:
    """Probed targets without a leak, also when every probe went unanswered."""
    clean = _unleaked(plan_tables(discovered), _leaks(probe_responses, "table"))
    return clean.select("target_id", *_pass(lists.PASS_RLS_PROBE))


def bundle_secrets(bundles: DataFrame) -> DataFrame:
    """Hardcoded secrets in fetched scripts."""
    rows = bundles.withColumn("lower", F.lower("content"))
    return rows.select(
        "target_id", F.inline(secret_hits(F.col("content"), F.col("lower"), url=F.col("script_url")))
    )

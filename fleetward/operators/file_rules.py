"""White-box rules that look at one file at a time.

Each rule is a column expression over one row of ``files``: an array of hits.  Any
set of rules can therefore run in ONE projection over one scan of ``files``
(``scan_files``), which is what the fleet plan does; a single rule runs alone with
its path test pushed in front of the text tests (``run_rule``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import patterns as p
from ..catalog.texts import PATTERN_PACK, Variant
from ..functions import paths
from ..functions.calls import CALL_TYPE, call_sites
from ..functions.secrets import classify_secret
from ..functions.text import MATCH_TYPE, all_of, group, has_any, let, line_matches, matches, redact, scan, shannon_entropy
from ..schema import NO_HITS, explode_hits, hit

ENTROPY_FLOOR = 3.5  # bits per character of a generic credential (inferred)

# The calls any rule asks for.
CALL_NAMES = "|".join(f"(?:{q.source})" for q in (p.RAW_UNSAFE_CALL, p.QUERY_CALL, p.SHELL_CALL, p.REQUEST_CALL))


@dataclass(frozen=True)
class FileColumns:
    """Columns a rule may use; ``lower`` and ``calls`` are computed once per file."""

    path: Column
    content: Column
    lower: Column
    calls: Column


@dataclass(frozen=True)
class FileRule:
    key: str
    rule: str
    applies: Callable[[Column], Column]
    hits: Callable[[FileColumns], Column]
    needs_calls: bool = False
    variants: Mapping[str, Variant] = field(default_factory=dict)  # of findings that the catalogue does not know


def no_hits() -> Column:
    return F.array().cast(NO_HITS)


def _one(cond: Column, finding: Column) -> Column:
    return F.when(cond, F.array(finding)).otherwise(no_hits())


def _each(found: Column, make: Callable[[Column], Column]) -> Column:
    return F.transform(found, make)


def _scan(gate: Column, content: Column, pattern) -> Column:
    return F.when(gate, scan(content, pattern)).otherwise(F.array().cast(MATCH_TYPE))


# ---- secrets ----------------------------------------------------------------


def secret_hits(content: Column, lower: Column, *, file: Column | None = None, url: Column | None = None) -> Column:
    """Secret shapes in a text whose value is not public; the raw value rides along."""
    gate = (
        has_any(content, "_live_", "sb_secret_", "PRIVATE KEY-----", "eyJ")
        | (content.contains("://") & has_any(lower, "postgres", "mysql", "mongodb", "redis:", "amqp:"))
        | matches(content, p.LONG_QUOTED_VALUE)
    )
    found = _scan(gate, content, p.SECRET_SHAPES)

    def judge(m: Column) -> Column:
        assigned = group(m["match"], p.ASSIGNED_VALUE, 1)
        value = F.when(assigned != "", assigned).otherwise(m["match"])
        return F.struct(
            m["ord"].alias("ord"),
            m["line"].alias("line"),
            m["match"].alias("match"),
            value.alias("value"),
            (assigned != "").alias("assigned"),
            classify_secret(value).alias("verdict"),
        )

    def make(j: Column) -> Column:
        value, named = j["value"], j["match"].rlike("(?i)^service_role")

        def as_hit(variant: str) -> Column:
            return hit(
                variant, evidence=redact(value), file=file, line=j["line"], url=url,
                ord=j["ord"], raw=value, raw_line=j["match"],
            )

        dangerous = j["verdict"] == "dangerous"
        return (
            F.when(dangerous & value.rlike("(?:sk|rk)_live_"), as_hit("secret_stripe"))
            .when(dangerous & value.contains("sb_secret_"), as_hit("secret_service_role"))
            .when(dangerous & value.contains("PRIVATE KEY"), as_hit("secret_private_key"))
            .when(dangerous & value.contains("://"), as_hit("secret_conn_string"))
            .when(dangerous & named, as_hit("secret_service_role"))
            .when(dangerous, as_hit("secret_service_role_jwt"))
            .when(
                (j["verdict"] == "other") & j["assigned"] & (shannon_entropy(value) >= ENTROPY_FLOOR),
                as_hit("secret_generic"),
            )
        )

    return F.filter(_each(F.transform(found, judge), make), lambda h: h.isNotNull())


def _hardcoded_secrets(f: FileColumns) -> Column:
    return secret_hits(f.content, f.lower, file=f.path)


def _public_secret_var(f: FileColumns) -> Column:
    found = F.filter(
        _scan(f.content.contains("PUBLIC_") | has_any(f.content, "VITE_", "REACT_APP_"), f.content, p.PUBLIC_SECRET_NAME),
        lambda m: matches(m["match"], p.SECRET_NAME),
    )
    return _each(
        found,
        lambda m: hit(
            "public_secret_var", evidence=m["match"], file=f.path, line=m["line"],
            params=[m["match"]], ord=m["ord"],
        ),
    )


# ---- database ---------------------------------------------------------------


def _firebase_open(f: FileColumns) -> Column:
    return _each(
        _scan(f.lower.contains("allow"), f.content, p.FIREBASE_OPEN),
        lambda m: hit(
            "firebase_open", evidence=m["match"], file=f.path, line=m["line"], ord=m["ord"]
        ),
    )


def _rls_permissive(f: FileColumns) -> Column:
    return _each(
        _scan(f.lower.contains("using"), f.content, p.PERMISSIVE_POLICY),
        lambda m: hit(
            "rls_permissive", evidence=m["match"], file=f.path, line=m["line"], ord=(0, m["ord"])
        ),
    )


def _definer_view(f: FileColumns) -> Column:
    # The 400 characters from the start of the match are captured by a lookahead.
    windowed = r"(?i)(?=create)(?=([\s\S]{0,400}))" + p.CREATE_VIEW.java
    found = F.when(f.lower.contains("view") & matches(f.content, p.CREATE_VIEW), line_matches(f.content, windowed, "$1"))
    bare = F.filter(
        F.coalesce(found, F.array().cast(MATCH_TYPE)), lambda m: ~matches(m["extra"], p.SECURITY_INVOKER)
    )
    return _each(
        bare,
        lambda m: hit(
            "definer_view", evidence=m["match"], file=f.path, line=m["line"],
            ord=(1, m["ord"]),
        ),
    )


# ---- auth -------------------------------------------------------------------


def _missing_auth(f: FileColumns) -> Column:
    return _one(
        all_of(
            has_any(f.content, "export", "use server"),
            matches(f.content, (p.AUTH_HANDLER, p.USE_SERVER)),
            matches(f.content, p.AUTH_MUTATION),
            ~matches(f.content, p.AUTH_SIGNAL),
        ),
        hit("missing_auth", file=f.path),
    )


# ---- injection --------------------------------------------------------------


def judged_calls(content: Column) -> Column:
    """The call sites some rule asks for, with verdicts on their first arguments."""
    return F.coalesce(call_sites(F.when(content.contains("("), content), CALL_NAMES), F.array().cast(CALL_TYPE))


def _sql_injection(f: FileColumns) -> Column:
    def call(c: Column) -> Column:
        evidence = F.concat(c["callee"], F.lit("(…)"))

        def as_hit(variant: str) -> Column:
            return hit(
                variant, evidence=evidence, file=f.path, line=c["line"], ord=(0, c["ord"])
            )

        return F.when(matches(c["callee"], p.RAW_UNSAFE_CALL), as_hit("sql_raw_unsafe")).when(
            matches(c["callee"], p.QUERY_CALL) & c["tainted"], as_hit("sql_concat")
        )

    calls = F.filter(F.transform(f.calls, call), lambda h: h.isNotNull())
    texts = _each(
        _scan(has_any(f.lower, "select", "insert", "update", "delete", "drop"), f.content, p.SQL_CONCAT),
        lambda m: hit(
            "sql_concat", evidence=F.concat(F.substring(m["match"], 1, 44), F.lit("…")),
            file=f.path, line=m["line"], ord=(1, m["ord"]),
        ),
    )
    return F.concat(calls, texts)


def _command_injection(f: FileColumns) -> Column:
    return _each(
        F.filter(f.calls, lambda c: matches(c["callee"], p.SHELL_CALL) & c["tainted"]),
        lambda c: hit(
            "command", evidence=F.concat(c["callee"], F.lit("(…)")), file=f.path,
            line=c["line"], ord=c["ord"],
        ),
    )


def _xss(f: FileColumns) -> Column:
    found = F.transform(
        _scan(f.content.contains("dangerouslySetInnerHTML"), f.content, p.RAW_HTML),
        lambda m: F.struct(
            m["ord"].alias("ord"),
            m["line"].alias("line"),
            F.regexp_replace(group(m["match"], p.RAW_HTML, 1), r"^\s+|\s+$", "").alias("expr"),
        ),
    )

    def dynamic(m: Column) -> Column:
        e = m["expr"]
        static = matches(e, (p.HTML_JSON, p.HTML_QUOTED)) | (matches(e, p.HTML_PLAIN_TEMPLATE) & ~e.contains("${"))
        return ~matches(e, p.HTML_SANITIZER) & ~static

    def make(m: Column) -> Column:
        e = m["expr"]
        short = F.when(F.length(e) > 48, F.concat(F.substring(e, 1, 48), F.lit("…"))).otherwise(e)

        def as_hit(variant: str) -> Column:
            return hit(
                variant, evidence=F.concat(F.lit("__html: "), short), file=f.path, line=m["line"],
                params=[short], ord=m["ord"],
            )

        return F.when(matches(e, p.USER_DERIVED), as_hit("xss_user")).otherwise(as_hit("xss_unknown"))

    return _each(F.filter(found, dynamic), make)


def _ssrf_metadata(f: FileColumns) -> Column:
    gate = has_any(f.lower, "169.254.169.254", "metadata.google.internal", "100.100.100.200")
    return _each(
        F.slice(_scan(gate, f.content, p.METADATA_URL), 1, 1),
        lambda m: hit(
            "ssrf_metadata", evidence=F.concat(F.lit("request to "), F.substring(m["match"], 1, 48)),
            file=f.path, line=m["line"],
        ),
    )


def _ssrf_tainted(f: FileColumns) -> Column:
    return _each(
        F.filter(
            f.calls,
            lambda c: matches(c["callee"], p.REQUEST_CALL) & c["tainted"] & matches(c["arg0"], p.REQUEST_INPUT),
        ),
        lambda c: hit(
            "ssrf_tainted", evidence=F.concat(c["callee"], F.lit("(<user-controlled url>)")),
            file=f.path, line=c["line"], ord=c["ord"] + 1,
        ),
    )


# ---- webhooks and request bodies --------------------------------------------


def _webhook_idempotency(f: FileColumns) -> Column:
    financial = matches(f.content, (p.FINANCIAL, p.CREDIT_ASSIGN))
    # A write without a money or access effect counts unless it only logs.
    acts = F.when(financial, True).otherwise(matches(f.content, p.STATE_CHANGE) & ~matches(f.content, p.LOG_TARGET))
    return _one(
        all_of(
            matches(f.path, p.WEBHOOK_PATH) | f.lower.contains("webhook"),
            paths.is_server_route(f.path, f.content),
            acts,
            ~matches(f.content, p.DEDUPE_GUARDS),
        ),
        hit("webhook_replay", file=f.path),
    )


# The write verb must lie within the 60 characters before or the 40 from the spread.
_SPREAD_NEAR_WRITE = (
    r"(?=\.\.\.req)(?:(?<=(?i:update|insert|create)[\s\S]{0,54}|(?i:set)[\s\S]{0,57}|(?i:save)[\s\S]{0,56})"
    r"|(?=[\s\S]{0,34}(?i:update|insert|create)|[\s\S]{0,37}(?i:set)|[\s\S]{0,36}(?i:save)))"
    + p.SPREAD_BODY.java
)


def _mass_assignment(f: FileColumns) -> Column:
    def as_hit(line: Column, evidence: Column, ord: int) -> Column:
        return hit("mass_assignment", evidence=evidence, file=f.path, line=line, ord=F.lit(ord))

    body = has_any(f.lower, "req.body", "request.body")
    def privileged(found: Column) -> Column:
        fields = F.array_distinct(F.transform(found, lambda m: group(m["match"], p.TAMPER, 1)))
        evidence = F.concat(F.lit("Privileged fields set from the request body: "), F.array_join(fields, ", "))
        return _one(F.size(found) > 0, as_hit(F.get(found, F.lit(0))["line"], evidence, 1))

    def whole_body(found: Column) -> Column:
        evidence = F.lit("The entire request body is written to the database (…req.body)")
        return F.transform(F.slice(found, 1, 1), lambda m: as_hit(m["line"], evidence, 2))

    spread = F.when(
        all_of(body, matches(f.content, p.SPREAD_BODY)), line_matches(f.content, _SPREAD_NEAR_WRITE)
    ).otherwise(F.array().cast(MATCH_TYPE))
    return F.concat(let(_scan(body, f.content, p.TAMPER), privileged), whole_body(spread))


# ---- uploads ----------------------------------------------------------------

_UPLOAD_WORDS = (
    "multer", "formdata()", "multipart/form-data", ".upload(", "busboy", "createreadstream", "req.file", ".files[",
)


def _insecure_upload(f: FileColumns) -> Column:
    typed = matches(f.content, p.UPLOAD_TYPE_CHECK)
    sized = matches(f.content, p.UPLOAD_SIZE_CHECK)
    make = lambda variant: F.array(hit(variant, file=f.path))
    return (
        F.when(~has_any(f.lower, *_UPLOAD_WORDS), no_hits())
        .when(~matches(f.content, p.UPLOAD), no_hits())
        .when(typed & sized, no_hits())
        .when(~typed & ~sized, make("upload_both"))
        .when(~typed, make("upload_type"))
        .otherwise(make("upload_size"))
    )


# ---- assistant settings -----------------------------------------------------


def _ai_rules_file(f: FileColumns) -> Column:
    def found(i: int, pattern, label: str) -> Column:
        return _each(
            scan(f.content, pattern),
            lambda m: hit(
                "ai_rules_file", evidence=F.substring(m["match"], 1, 80), file=f.path,
                line=m["line"], params=[F.lit(label)], ord=(i, m["ord"]),
            ),
        )

    return F.concat(*[found(i, pattern, label) for i, (pattern, label) in enumerate(p.RISKY_INSTRUCTIONS)])


def _insecure_defaults(f: FileColumns) -> Column:
    def found(i: int, variant: str, pattern, word: str) -> Column:
        return _each(
            _scan(f.content.contains(word), f.content, pattern),
            lambda m: hit(
                variant, evidence=m["match"], file=f.path, line=m["line"],
                ord=(i, m["ord"]),
            ),
        )

    return F.concat(
        found(0, "tls_off_option", p.TLS_OFF_OPTION, "rejectUnauthorized"),
        found(1, "tls_off_env", p.TLS_OFF_ENV, "NODE_TLS_REJECT_UNAUTHORIZED"),
    )


# ---- web configuration ------------------------------------------------------


def _cors_wildcard(f: FileColumns) -> Column:
    return _one(
        all_of(
            f.lower.contains("credentials") & f.lower.contains("origin"),
            matches(f.content, p.CORS_ORIGIN),
            matches(f.content, p.CORS_CREDENTIALS),
        ),
        hit("cors_wildcard", file=f.path),
    )


# ---- extra pattern pack -----------------------------------------------------

_SEVERITY_OF_LABEL = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}


def _pack_hit(index: int, f: FileColumns, line: Column, ord: Column) -> Column:
    rule_id, label, message = PATTERN_PACK[index]
    return hit(
        "semgrep", rule_id=F.lit("SEMGREP_" + rule_id.upper()),
        severity=F.lit(_SEVERITY_OF_LABEL[label]), file=f.path, line=line, params=[F.lit(message[:120])], ord=ord,
    )


def _pack_sql(f: FileColumns) -> Column:
    found = F.filter(
        f.calls,
        lambda c: c["callee"].rlike(r"\.\$(?:queryRawUnsafe|executeRawUnsafe)\z")
        | (c["callee"].rlike(r"\.query\z") & c["glued"]),
    )
    return _each(found, lambda c: _pack_hit(0, f, c["line"], c["ord"]))


def _pack_exec(f: FileColumns) -> Column:
    found = F.filter(
        f.calls,
        lambda c: ((c["callee"] == "exec") & c["glued"]) | ((c["callee"] == "execSync") & c["interpolated"]),
    )
    return _each(found, lambda c: _pack_hit(1, f, c["line"], c["ord"]))


def _pack_html(f: FileColumns) -> Column:
    found = _scan(f.content.contains("dangerouslySetInnerHTML"), f.content, p.RAW_HTML)
    return _each(found, lambda m: _pack_hit(2, f, m["line"], m["ord"]))


# ---- registry ---------------------------------------------------------------


def _env_or_source(path: Column) -> Column:
    return paths.is_source(path) | matches(path, p.ENV_ANY)


def _any_config(path: Column) -> Column:
    return paths.is_code_or_config(path) | paths.is_env(path)


FILE_RULES: tuple[FileRule, ...] = (
    FileRule("rule_hardcoded_secrets", "hardcoded_secrets", paths.is_code_or_config, _hardcoded_secrets),
    FileRule("rule_rls_permissive", "row_security", paths.is_sql, _rls_permissive),
    FileRule("rule_definer_view", "row_security", paths.is_sql, _definer_view),
    FileRule(
        "rule_firebase_open", "firebase_rules", lambda c: matches(c, p.FIREBASE_RULES_FILE), _firebase_open
    ),
    FileRule(
        "rule_missing_auth", "missing_auth", lambda c: paths.is_source(c) & matches(c, p.AUTH_PATH), _missing_auth
    ),
    FileRule("rule_sql_injection", "sql_injection", paths.is_source, _sql_injection, True),
    FileRule("rule_command_injection", "command_injection", paths.is_source, _command_injection, True),
    FileRule("rule_xss", "xss", paths.is_source, _xss),
    FileRule("rule_ssrf_metadata", "ssrf", paths.is_source, _ssrf_metadata),
    FileRule("rule_ssrf_tainted", "ssrf", paths.is_source, _ssrf_tainted, True),
    FileRule("rule_webhook_idempotency", "webhook_idempotency", paths.is_source, _webhook_idempotency),
    FileRule("rule_mass_assignment", "mass_assignment", paths.is_source, _mass_assignment),
    FileRule("rule_cors_wildcard", "framework_config", paths.is_source, _cors_wildcard),
    FileRule(
        "rule_ai_rules_file", "assistant_rules", lambda c: matches(c, p.ASSISTANT_RULES_FILE), _ai_rules_file
    ),
    FileRule("rule_insecure_defaults", "insecure_defaults", _env_or_source, _insecure_defaults),
    FileRule("rule_public_secret_var", "public_secret_var", _any_config, _public_secret_var),
    FileRule("rule_insecure_upload", "insecure_upload", paths.is_source, _insecure_upload),
)

PATTERN_PACK_RULES: tuple[FileRule, ...] = (
    FileRule("semgrep_concat_sql", "semgrep", paths.is_source, _pack_sql, True),
    FileRule("semgrep_exec", "semgrep", paths.is_source, _pack_exec, True),
    FileRule("semgrep_html_sink", "semgrep", paths.is_source, _pack_html),
)


_calls_expressions: dict[str, Column] = {}


def _calls_column(app: str) -> Column:
    """The judged calls of source files, built once per application."""
    if app not in _calls_expressions:
        _calls_expressions[app] = judged_calls(F.when(paths.is_source(F.col("path")), F.col("content")))
    return _calls_expressions[app]


def file_columns(files: DataFrame, with_calls: bool) -> DataFrame:
    """``files`` plus the derived columns the rules share."""
    out = files.withColumn("lower", F.lower("content"))
    if with_calls:
        out = out.withColumn("calls", _calls_column(files.sparkSession.sparkContext.applicationId))
    else:
        out = out.withColumn("calls", F.lit(None).cast("string"))
    return out


def columns() -> FileColumns:
    return FileColumns(F.col("path"), F.col("content"), F.col("lower"), F.col("calls"))


def hits_of(rules: Sequence[FileRule]) -> Column:
    """All hits of ``rules`` on one file, in rule order."""
    c = columns()
    readable = F.coalesce(c.content, F.lit("")) != ""
    arrays = [F.when(readable & r.applies(c.path), r.hits(c)).otherwise(no_hits()) for r in rules]
    return F.flatten(F.array(*arrays)) if len(arrays) > 1 else arrays[0]


def guarded_hits(rule: FileRule) -> Column:
    """Hits of a rule on one file, empty where it does not apply, and null where it fails.

    The rule is evaluated as the argument of a function that yields null if its argument cannot be computed, inside a
    lambda, so that no part of it is computed before.
    """
    c = columns()
    fields = {"path": c.path, "content": c.content, "lower": c.lower, "calls": c.calls}

    def judged(f: Column) -> Column:
        inside = FileColumns(*[f[name] for name in fields])
        applies = (F.coalesce(inside.content, F.lit("")) != "") & rule.applies(inside.path)
        return F.try_to_binary(F.to_json(F.when(applies, rule.hits(inside)).otherwise(no_hits())), F.lit("utf-8"))

    made = let(F.struct(*[v.alias(k) for k, v in fields.items()]), judged)
    return F.from_json(made.cast("string"), NO_HITS)


def run_rule(files: DataFrame, rule: FileRule) -> DataFrame:
    """One rule alone: path test first, text tests on what is left."""
    gated = files.where(rule.applies(F.col("path")) & (F.col("content") != ""))
    return explode_hits(file_columns(gated, rule.needs_calls), rule.hits(columns()))


RULES_BY_KEY = {r.key: r for r in FILE_RULES + PATTERN_PACK_RULES}

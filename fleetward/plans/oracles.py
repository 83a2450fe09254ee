"""SQL statement per query, for a second engine on the same tables."""

from __future__ import annotations

from ..catalog import lists, patterns as p
from ..catalog.texts import GITLEAKS_HISTORY_NOTE, OSV_UNFIXED_NOTE, PATTERN_PACK
from ..sources import corpus
from . import oracle_sql as o
from .oracle_sql import lit, m, rx

ORACLES: dict[str, str] = {}


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


FILES = o.files()
ORACLES["target_classify"] = _with(
    o.TARGETS, "SELECT target_id, value, CASE WHEN regexp_matches(value, '(?i)^https?://') THEN 'url' ELSE 'repo' END AS type FROM targets"
)
ORACLES["files_source"] = _with(o.files_raw(), "SELECT target_id, path, strlen(content)::BIGINT AS n_bytes, md5(content) AS digest FROM files_raw")
ORACLES["files_ignore"] = _with(o.files_raw(), f"SELECT target_id, path FROM files_raw WHERE NOT {o.IGNORED}")
ORACLES["files_size_cap"] = (
    "SELECT doc_id, strlen(repeat(text, 60))::BIGINT AS n_bytes, "
    f"strlen(repeat(text, 60)) < {lists.MAX_FILE_BYTES} AS kept FROM documents"
)
_LOCK = " OR ".join(f"ends_with(path, {lit(f)})" for f in lists.LOCKFILES)
ORACLES["files_kinds"] = _with(
    o.files_raw(),
    f"SELECT target_id, path, {o.IS_SQL} AS is_sql, {o.IS_ENV} AS is_env, ({_LOCK}) AS is_lockfile, {o.IS_SOURCE} AS is_source, "
    f"{o.IS_CODE} AS is_code_or_config FROM files_raw",
)
ORACLES["manifest_pick"] = _with(f"{FILES}, {o.MANIFESTS}", "SELECT target_id, path, content FROM picked")
ORACLES["manifest_deps"] = _with(f"{FILES}, {o.MANIFESTS}", "SELECT target_id, manifest_path, pkg, declared FROM manifest_deps")
_HEADERS = f"{o.pages()}, {o.raw_headers()}, {o.HEADERS}"
ORACLES["headers_normalize"] = _with(_HEADERS, "SELECT * FROM headers")
_COOKIES = (
    "(SELECT target_id, url, unnest(string_split(value, chr(10))) AS cookie, "
    "(generate_subscripts(string_split(value, chr(10)), 1) - 1)::INTEGER AS ord FROM headers WHERE name = 'set-cookie' AND value <> '')"
)
ORACLES["cookies_split"] = _with(_HEADERS, f"SELECT target_id, url, ord, cookie FROM {_COOKIES} c")
CRAWL = o.crawl()
ORACLES["script_src_extract"] = _with(f"{o.pages()}, {o.homepages()}, {o.scripts()}", "SELECT target_id, ord, script_url FROM scripts")
ORACLES["bundle_select"] = _with(CRAWL, "SELECT target_id, ord, script_url, content FROM bundles")
ORACLES["discover_config"] = _with(CRAWL, "SELECT * FROM discovered")
ORACLES["probe_plan_tables"] = _with(f"{CRAWL}, {o.plan_tables()}", "SELECT * FROM plan_tables")
ORACLES["probe_plan_dotfiles"] = _with(f"{o.pages()}, {o.plan_dotfiles()}", "SELECT * FROM plan_dotfiles")
ORACLES["probe_plan_sourcemaps"] = _with(f"{CRAWL}, {o.PLAN_MAPS}", "SELECT target_id, ord, url FROM plan_maps")
REPORTS = o.engine_reports()
ORACLES["reports_source"] = _with(
    REPORTS,
    "SELECT report_id, target_id, engine, json_array_length(CASE WHEN engine = 'gitleaks' THEN raw ELSE json_extract(raw, '$.results')::VARCHAR END)::INTEGER "
    "AS n_items FROM reports WHERE raw IS NOT NULL AND json_valid(raw)",
)

# ---- functions --------------------------------------------------------------
def _line_scan() -> str:
    from .queries import LINE_PATTERN as pattern

    found = o.scan("documents", pattern.re2, "doc_id", "text")
    return (
        f"SELECT doc_id, ord::INTEGER AS ord, line::INTEGER AS line, match, regexp_extract(match, {rx(pattern)}, 1) AS g1, "
        f"regexp_extract(match, {rx(pattern)}, 2) AS g2 FROM {found} s"
    )


ORACLES["regex_scan_lines"] = _line_scan()
ORACLES["redact_value"] = f"SELECT doc_id, {o.redact('text')} AS redacted FROM documents"
ORACLES["shannon_entropy"] = f"SELECT doc_id, round({o.entropy('text')}, 6) AS entropy FROM documents"
_V = f"{o.DEPS}, vs AS (SELECT target_id, pkg, declared, {o.version('declared')} AS v FROM deps)"
ORACLES["parse_version"] = _with(_V, "SELECT target_id, pkg, declared, v[1] AS major, v[2] AS minor, v[3] AS patch FROM vs")
ORACLES["version_compare"] = _with(
    _V,
    "SELECT target_id, pkg, declared, (CASE WHEN v < [7, 3, 10] THEN -1 WHEN v > [7, 3, 10] THEN 1 ELSE 0 END)::INTEGER AS cmp, "
    "v < [7, 3, 10] AS lt, v >= [7, 3, 10] AS gte FROM vs",
)
ORACLES["version_in_range"] = _with(_V, "SELECT target_id, pkg, declared, v >= [3, 2, 0] AND v < [9, 4, 5] AS inside FROM vs")
ORACLES["version_format"] = _with(_V, f"SELECT target_id, pkg, declared, {o.vfmt('v')} AS formatted FROM vs")
FE = o.FINDING_EVENTS
ORACLES["dedupe_key"] = _with(FE, f"SELECT event_id, {o.DEDUPE_KEY} AS dedupe_key FROM fe")
_FNV = (
    f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({o.DEDUPE_KEY}, ''), lambda c: unicode(c)::BIGINT)), "
    "lambda h, u: (xor(h, u) * 16777619) & 4294967295::BIGINT)"
)
_B36 = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // {36 ** k}) % 36 + 1)::INTEGER, 1)" for k in range(6, -1, -1))
FID = f"fid AS (SELECT *, {_B36} AS finding_id FROM (SELECT *, {_FNV} AS h FROM fe) z)"
ORACLES["finding_id"] = _with(f"{FE}, {FID}", "SELECT event_id, finding_id FROM fid")
ORACLES["canonical_identity"] = _with(FE, f"SELECT event_id, {o.IDENTITY} AS identity FROM fe")
ORACLES["dep_package"] = _with(
    o.DEPS, f"SELECT target_id, pkg, declared, {o.dep_package(chr(39) + ' Uses @Scope/' + chr(39) + ' || pkg || ' + chr(39) + '@' + chr(39) + ' || declared || ' + chr(39) + ' ' + chr(39) + ' || pkg')} AS package FROM deps"
)
ORACLES["severity_rank"] = _with(FE, f"SELECT event_id, severity, ({o.RANK})::INTEGER AS severity_rank FROM fe")
ORACLES["path_class"] = _with(o.files_raw(), f"SELECT target_id, path, {o.path_class('path')} AS path_class FROM files_raw")
IS_REACT = m("content", p.CLIENT_DIRECTIVE, p.REACT_IMPORT, p.CLOSING_TAG)
IS_ROUTE = f"({m('path', p.API_ROUTE_PATH, p.ROUTE_FILE)} OR ({m('content', p.SERVER_EXPORT)} AND NOT {IS_REACT}))"
for _name, _expr in (
    ("is_source_file", o.IS_SOURCE), ("is_code_or_config", o.IS_CODE), ("is_handler", m("content", p.BODY_HANDLER)),
    ("is_react_view", IS_REACT), ("is_server_route", IS_ROUTE),
):
    ORACLES[_name] = _with(o.files_raw(), f"SELECT target_id, path, {_expr} AS {_name} FROM files_raw")
MAN = f"{FILES}, {o.MANIFESTS}"
HOSTED = (
    f"hosted AS (SELECT target_id FROM files WHERE {m('path', p.HOSTED_DB_PATH)} OR ({o.IS_SQL} AND {m('content', p.HOSTED_DB_SQL)}) "
    "UNION SELECT target_id FROM manifest_deps WHERE starts_with(pkg, '@supabase/') OR pkg = 'supabase')"
)
ORACLES["looks_like_supabase"] = _with(f"{MAN}, {HOSTED}", "SELECT target_id FROM hosted")
SRC = f"{FILES}, src AS (SELECT * FROM files WHERE {o.IS_SOURCE})"
CALLS = f"{SRC}, calls AS MATERIALIZED (SELECT * FROM {o.call_sites('src')} cs)"
ORACLES["call_sites"] = _with(CALLS, "SELECT target_id, path, ord, line, callee, arg0 FROM calls")
ORACLES["tainted_arg"] = _with(CALLS, f"SELECT target_id, path, ord, callee, arg0, {o.tainted('arg0')} AS tainted FROM calls")


SV = f"""{FILES}, sv AS MATERIALIZED (SELECT target_id, path, ord::INTEGER AS ord, line::INTEGER AS line, CASE WHEN assigned <> '' THEN assigned ELSE match END AS value
  FROM (SELECT *, regexp_extract(match, {rx(p.ASSIGNED_VALUE)}, 1) AS assigned FROM {o.scan('files', p.SECRET_SHAPES.re2)} a) b)"""
ORACLES["classify_secret"] = _with(SV, f"SELECT target_id, path, ord, {o.classify('value')} AS verdict FROM sv")
_CONN = f"regexp_extract(value, {rx(p.CONN_STRING)})"
ORACLES["example_conn_string"] = _with(
    SV,
    f"SELECT target_id, path, ord, regexp_matches({_CONN}, {rx(p.CONN_PASSWORD)}) AND regexp_matches(regexp_extract({_CONN}, {rx(p.CONN_PASSWORD)}, 1), "
    f"{rx(p.CONN_PLACEHOLDER)}) AS is_example FROM sv",
)

# ---- file rules: name -> (CTEs, SELECT of hits) -----------------------------
HITS: dict[str, tuple[str, str]] = {}


def _simple(key: str, variant: str, where: str, frm: str = "files", **kw) -> None:
    HITS[key] = (FILES, o.hits(lit(variant), f"(SELECT * FROM {frm} WHERE {where}) s", file="path", **kw))


def _scan_hits(variant: str, where: str, pattern, **kw) -> str:
    kw = {"evidence": "match", "line": "line", "file": "path", "ord": "ord", **kw}
    return o.hits(lit(variant), o.scan(f"(SELECT * FROM files WHERE {where}) f0", pattern if isinstance(pattern, str) else pattern.re2) + " s", **kw)


HITS["rule_hardcoded_secrets"] = (
    FILES, o.secret_hits(f"(SELECT * FROM files WHERE {o.IS_CODE}) f0", "target_id, path", file="path")
)
HITS["rule_public_secret_var"] = (
    FILES,
    f"SELECT * FROM ({_scan_hits('public_secret_var', f'({o.IS_CODE} OR {o.IS_ENV})', p.PUBLIC_SECRET_NAME, params=['match'])}) z "
    f"WHERE {m('evidence', p.SECRET_NAME)}",
)
HITS["rule_firebase_open"] = (FILES, _scan_hits("firebase_open", m("path", p.FIREBASE_RULES_FILE), p.FIREBASE_OPEN))
HITS["rule_rls_permissive"] = (FILES, _scan_hits("rls_permissive", o.IS_SQL, p.PERMISSIVE_POLICY, ord="0, ord"))
HITS["rule_definer_view"] = (
    FILES,
    o.hits(
        lit("definer_view"),
        f"(SELECT * FROM {o.scan(f'(SELECT * FROM files WHERE {o.IS_SQL}) f0', p.CREATE_VIEW.re2)} q "
        f"WHERE NOT regexp_matches(substr(content, start0 + 1, 400), {rx(p.SECURITY_INVOKER)})) s",
        evidence="match", file="path", line="line", ord="1, ord",
    ),
)
_simple(
    "rule_missing_auth", "missing_auth",
    f"{o.IS_SOURCE} AND {m('path', p.AUTH_PATH)} AND {m('content', p.AUTH_HANDLER, p.USE_SERVER)} AND {m('content', p.AUTH_MUTATION)} "
    f"AND NOT {m('content', p.AUTH_SIGNAL)}",
)
_EV = "callee || '(…)'"
_CALL_SQL = o.hits(
    f"CASE WHEN {m('callee', p.RAW_UNSAFE_CALL)} THEN 'sql_raw_unsafe' ELSE 'sql_concat' END",
    f"(SELECT * FROM calls WHERE {m('callee', p.RAW_UNSAFE_CALL)} OR ({m('callee', p.QUERY_CALL)} AND {o.tainted('arg0')})) c",
    evidence=_EV, file="path", line="line", ord="0, ord",
)
HITS["rule_sql_injection"] = (
    CALLS,
    f"{_CALL_SQL} UNION ALL "
    + _scan_hits("sql_concat", o.IS_SOURCE, p.SQL_CONCAT, evidence="substr(match, 1, 44) || '…'", ord="1, ord"),
)
HITS["rule_command_injection"] = (
    CALLS,
    o.hits(lit("command"), f"(SELECT * FROM calls WHERE {m('callee', p.SHELL_CALL)} AND {o.tainted('arg0')}) c",
           evidence=_EV, file="path", line="line", ord="ord"),
)
_EXPR = o.trim(f"regexp_extract(match, {rx(p.RAW_HTML)}, 1)")
_SHORT = "(CASE WHEN length(expr) > 48 THEN substr(expr, 1, 48) || '…' ELSE expr END)"
HITS["rule_xss"] = (
    FILES,
    o.hits(
        f"CASE WHEN {m('expr', p.USER_DERIVED)} THEN 'xss_user' ELSE 'xss_unknown' END",
        f"(SELECT * FROM (SELECT *, {_EXPR} AS expr FROM {o.scan(f'(SELECT * FROM files WHERE {o.IS_SOURCE}) f0', p.RAW_HTML.re2)} q) q2 "
        f"WHERE NOT {m('expr', p.HTML_SANITIZER, p.HTML_JSON, p.HTML_QUOTED)} AND NOT ({m('expr', p.HTML_PLAIN_TEMPLATE)} AND NOT contains(expr, '${{'))) s",
        evidence=f"'__html: ' || {_SHORT}", file="path", line="line", ord="ord", params=[_SHORT],
    ),
)
HITS["rule_ssrf_metadata"] = (
    FILES,
    f"SELECT * FROM ({_scan_hits('ssrf_metadata', o.IS_SOURCE, p.METADATA_URL, evidence=chr(39) + 'request to ' + chr(39) + ' || substr(match, 1, 48)')}) z WHERE emit_ord = [1]",
)
HITS["rule_ssrf_tainted"] = (
    CALLS,
    o.hits(
        lit("ssrf_tainted"),
        f"(SELECT * FROM calls WHERE {m('callee', p.REQUEST_CALL)} AND {o.tainted('arg0')} AND {m('arg0', p.REQUEST_INPUT)}) c",
        evidence="callee || '(<user-controlled url>)'", file="path", line="line", ord="ord + 1",
    ),
)
_FIN = m("content", p.FINANCIAL, p.CREDIT_ASSIGN)
_simple(
    "rule_webhook_idempotency", "webhook_replay",
    f"{o.IS_SOURCE} AND ({m('path', p.WEBHOOK_PATH)} OR {m('content', p.WEBHOOK_TEXT)}) AND {IS_ROUTE} AND ({m('content', p.STATE_CHANGE)} OR {_FIN}) "
    f"AND NOT (NOT {_FIN} AND {m('content', p.LOG_TARGET)}) AND NOT {m('content', *p.DEDUPE_GUARDS)}",
)
_TAMPER = o.scan(f"(SELECT * FROM files WHERE {o.IS_SOURCE}) f0", p.TAMPER.re2)
_SPREAD = o.scan(f"(SELECT * FROM files WHERE {o.IS_SOURCE}) f0", p.SPREAD_BODY.re2)
_NEAR = "substr(content, greatest(0, start0 - 60) + 1, start0 + 40 - greatest(0, start0 - 60))"
HITS["rule_mass_assignment"] = (
    FILES,
    o.hits(
        lit("mass_assignment"),
        f"(SELECT target_id, path, min(line) AS line, string_agg(field, ', ' ORDER BY first_ord) AS fields FROM ("
        f"SELECT target_id, path, field, min(ord) AS first_ord, min(line) AS line FROM (SELECT *, regexp_extract(match, {rx(p.TAMPER)}, 1) AS field FROM {_TAMPER} a) b "
        "GROUP BY ALL) c GROUP BY target_id, path) s",
        evidence="'Privileged fields set from the request body: ' || fields", file="path", line="line", ord="1",
    )
    + " UNION ALL "
    + o.hits(
        lit("mass_assignment"),
        f"(SELECT target_id, path, min(line) AS line FROM {_SPREAD} q WHERE regexp_matches({_NEAR}, {rx(p.SPREAD_WRITE)}) GROUP BY ALL) s",
        evidence="'The entire request body is written to the database (…req.body)'", file="path", line="line", ord="2",
    ),
)
_simple("rule_cors_wildcard", "cors_wildcard", f"{o.IS_SOURCE} AND {m('content', *p.CORS_ORIGIN)} AND {m('content', *p.CORS_CREDENTIALS)}")


def _rules_file() -> str:
    parts = []
    for i, (pattern, label) in enumerate(p.RISKY_INSTRUCTIONS):
        local = "(?!localhost)"
        text = pattern.re2.replace(local, "")
        sel = _scan_hits(
            "ai_rules_file", m("path", p.ASSISTANT_RULES_FILE), text, evidence="match", params=[lit(label)], ord="ord"
        )
        if local in pattern.re2:
            sel = f"SELECT * FROM ({sel}) z WHERE NOT regexp_matches(evidence, '(?i)://localhost')"
        cols = ", ".join(c for c in o.HIT_COLUMNS if c not in ("evidence", "emit_ord"))
        parts.append(
            f"SELECT {cols}, substr(evidence, 1, 80) AS evidence, "
            f"[{i}, row_number() OVER (PARTITION BY target_id, file ORDER BY emit_ord)]::BIGINT[] AS emit_ord FROM ({sel}) y"
        )
    cols = ", ".join(o.HIT_COLUMNS)
    return " UNION ALL ".join(f"SELECT {cols} FROM ({x}) x{i}" for i, x in enumerate(parts))


HITS["rule_ai_rules_file"] = (FILES, _rules_file())
_ENV_OR_SRC = f"({o.IS_SOURCE} OR {m('path', p.ENV_ANY)})"
HITS["rule_insecure_defaults"] = (
    FILES,
    _scan_hits("tls_off_option", _ENV_OR_SRC, p.TLS_OFF_OPTION, ord="0, ord")
    + " UNION ALL "
    + _scan_hits("tls_off_env", _ENV_OR_SRC, p.TLS_OFF_ENV, ord="1, ord"),
)
_TYPED, _SIZED = m("content", p.UPLOAD_TYPE_CHECK), m("content", p.UPLOAD_SIZE_CHECK)
HITS["rule_insecure_upload"] = (
    FILES,
    o.hits(
        f"CASE WHEN NOT {_TYPED} AND NOT {_SIZED} THEN 'upload_both' WHEN NOT {_TYPED} THEN 'upload_type' ELSE 'upload_size' END",
        f"(SELECT * FROM files WHERE {o.IS_SOURCE} AND {m('content', p.UPLOAD)} AND NOT ({_TYPED} AND {_SIZED})) s", file="path",
    ),
)


def _pack(index: int, frm: str) -> str:
    rule_id, label, message = PATTERN_PACK[index]
    severity = {"ERROR": "high", "WARNING": "medium"}[label]
    return o.hits(
        lit("semgrep"), frm, rule_id=lit("SEMGREP_" + rule_id.upper()), severity=lit(severity), file="path", line="line",
        params=[lit(message[:120])], ord="ord",
    )


_TEMPLATE_ARG = f"(regexp_matches(arg0, {lit('^(?:' + o._TPL + ')$')}) AND contains(arg0, '${{'))"
_GLUED = f"(regexp_matches(arg0, {lit('^(?:' + o._STR + ')' + chr(92) + 's*' + chr(92) + '+')}) OR {_TEMPLATE_ARG})"
HITS["semgrep_concat_sql"] = (
    CALLS,
    _pack(0, f"(SELECT * FROM calls WHERE regexp_matches(callee, '\\.\\$(?:queryRawUnsafe|executeRawUnsafe)$') "
             f"OR (regexp_matches(callee, '\\.query$') AND {_GLUED})) c"),
)
HITS["semgrep_exec"] = (
    CALLS, _pack(1, f"(SELECT * FROM calls WHERE (callee = 'exec' AND {_GLUED}) OR (callee = 'execSync' AND {_TEMPLATE_ARG})) c")
)
HITS["semgrep_html_sink"] = (
    FILES, _pack(2, o.scan(f"(SELECT * FROM files WHERE {o.IS_SOURCE}) f0", p.RAW_HTML.re2) + " s")
)

# ---- target rules -----------------------------------------------------------
_IGNORES = (
    f"ignores AS (SELECT DISTINCT target_id FROM files WHERE path = '.gitignore' AND {m('content', p.GITIGNORE_ENV_LINE, p.GITIGNORE_ENV_PREFIX)})"
)
HITS["rule_committed_env"] = (
    f"{FILES}, {_IGNORES}",
    o.hits(
        "CASE WHEN target_id IN (SELECT target_id FROM ignores) THEN 'env_ignored' ELSE 'env_not_ignored' END",
        f"(SELECT * FROM files WHERE {o.IS_ENV} AND NOT {m('path', p.ENV_TEMPLATE)} AND {m('content', p.ENV_ASSIGNMENT)}) s", file="path",
    ),
)
_LOWC = "lower(coalesce(content, ''))"
_PRESENT = (
    "list_filter([" + ", ".join(lit(h[0]) for h in lists.REQUIRED_HEADERS) + f"], lambda h: contains({_LOWC}, h))"
)
CONFIG = (
    f"config AS (SELECT target_id, path, coalesce(content, '') AS content, {_PRESENT} AS present FROM files WHERE {o.IS_CONFIG} "
    "QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY path) = 1)"
)
HITS["rule_image_wildcard"] = (
    f"{FILES}, {CONFIG}",
    o.hits(lit("image_wildcard"), f"(SELECT * FROM config WHERE {m('content', *p.IMAGE_WILDCARD)}) s",
           evidence="'images.remotePatterns hostname \"**\" (or domains: [\"*\"])'", file="path", ord="2"),
)
HITS["rule_config_headers"] = (
    f"{FILES}, {CONFIG}",
    o.hits(lit("config_headers"), f"(SELECT * FROM config WHERE NOT {m('content', p.HEADERS_FUNCTION)} OR len(present) < 2) s",
           evidence="CASE WHEN len(present) > 0 THEN 'only found: ' || array_to_string(present, ', ') ELSE 'no security headers configured' END",
           file="path", ord="3"),
)
_CREATED = o.scan(f"(SELECT * FROM files WHERE {o.IS_SQL}) f0", p.CREATE_TABLE.re2)
_SECURED = o.scan(f"(SELECT * FROM files WHERE {o.IS_SQL}) f0", p.ENABLE_RLS.re2)
RLS = f"""created AS MATERIALIZED (SELECT target_id, lower(regexp_extract(match, {rx(p.CREATE_TABLE)}, 1)) AS table_name, path AS file, line::INTEGER AS line, ord::INTEGER AS ord FROM {_CREATED} a),
secured AS (SELECT DISTINCT target_id, lower(regexp_extract(match, {rx(p.ENABLE_RLS)}, 1)) AS table_name FROM {_SECURED} a),
missing AS MATERIALIZED (SELECT * FROM created c WHERE NOT EXISTS (SELECT 1 FROM secured s WHERE s.target_id = c.target_id AND s.table_name = c.table_name)
  QUALIFY row_number() OVER (PARTITION BY target_id, table_name ORDER BY file, ord) = 1)"""
ORACLES["sql_tables_created"] = _with(f"{FILES}, {RLS}", "SELECT * FROM created")
ORACLES["sql_tables_rls"] = _with(f"{FILES}, {RLS}", "SELECT * FROM secured")
ORACLES["rls_missing_tables"] = _with(f"{FILES}, {RLS}", "SELECT target_id, table_name, file, line, ord FROM missing")
HITS["rule_rls_disabled"] = (
    f"{MAN}, {HOSTED}, {RLS}",
    o.hits(
        "CASE WHEN n = 1 THEN 'rls_disabled_one' ELSE 'rls_disabled_many' END",
        """(SELECT target_id, count(*) AS n, arg_min(file, (file, ord)) AS file, arg_min(line, (file, ord)) AS line, arg_min(table_name, (file, ord)) AS first_table,
          string_agg(table_name, ', ' ORDER BY file, ord) AS names, string_agg('"' || table_name || '"', ', ' ORDER BY file, ord) AS quoted
          FROM missing WHERE target_id IN (SELECT target_id FROM hosted) GROUP BY target_id) s""",
        evidence="CASE WHEN n > 1 THEN names END", file="file", line="line", params=["first_table", "n", "quoted"], ord="2, 0",
    ),
)
FLAGS = f"""flags AS (SELECT target_id, bool_or({m('content', p.STRIPE_VERIFY)}) AS stripe_ok,
  bool_or({m('content', p.HMAC_CREATE)} AND {m('content', p.HMAC_COMPARE)} AND {m('content', p.HMAC_CONTEXT)}) AS github_ok
  FROM files WHERE {o.IS_SOURCE} GROUP BY target_id)"""
ORACLES["webhook_verified_flags"] = _with(f"{FILES}, {FLAGS}", "SELECT * FROM flags WHERE stripe_ok OR github_ok")
HITS["rule_webhook_unverified"] = (
    f"{FILES}, {FLAGS}",
    o.hits(
        "CASE WHEN stripe THEN 'webhook_stripe' ELSE 'webhook_github' END",
        f"""(SELECT * FROM (SELECT f.target_id, f.path, {m('content', p.STRIPE_TEXT)} AND NOT g.stripe_ok AS stripe,
          {m('content', p.GITHUB_TEXT)} AND {m('content', p.WEBHOOK_TEXT)} AND NOT g.github_ok AS github
          FROM files f JOIN flags g ON f.target_id = g.target_id WHERE {o.IS_SOURCE} AND {IS_ROUTE}
            AND ({m('path', p.WEBHOOK_PATH)} OR {m('content', p.WEBHOOK_TEXT)}) AND {m('content', p.BODY_HANDLER)}) z WHERE stripe OR github) s""",
        file="path",
    ),
)
_MID = " OR ".join(f"(v >= [{a.replace('.', ', ')}] AND v < [{b.replace('.', ', ')}])" for a, b in lists.MIDDLEWARE_RANGES)
HITS["rule_middleware_cve"] = (
    MAN,
    o.hits(
        lit("middleware_bypass"),
        f"(SELECT * FROM (SELECT *, {o.version('declared')} AS v FROM manifest_deps WHERE pkg = 'next') z WHERE {_MID}) s",
        evidence="'next@' || declared", file="manifest_path", params=[o.vfmt("v")],
    ),
)


def _cve_hits(deps: str, advisories: str) -> str:
    return o.hits(
        lit("known_cve"),
        f"""(SELECT DISTINCT d.target_id, d.manifest_path, d.pkg, d.declared, a.id, a.severity AS sev, a.summary, {o.vfmt('d.v')} AS cur
          FROM (SELECT *, {o.version('declared')} AS v FROM {deps}) d
          JOIN (SELECT *, {o.version('lo')} AS lo_v, {o.version('fixed')} AS fixed_v FROM {advisories}) a
            ON d.pkg = a.pkg AND d.v >= a.lo_v AND d.v < a.fixed_v) s""",
        rule_id="'DEPENDENCIES_' || upper(regexp_replace(id, '[^A-Za-z0-9]', '_', 'g'))", severity="sev",
        evidence="pkg || '@' || declared || ' (' || id || '), current parsed ' || cur", file="manifest_path",
        params=["pkg", "declared", "id", "summary"],
    )


HITS["rule_known_cve"] = (f"{o.DEPS}, {o.ADVISORIES}, udeps AS (SELECT DISTINCT * FROM deps)", _cve_hits("udeps", "advisories"))
FLOOR = o.values("adv_floor", "pkg, id, severity, lo, fixed, summary", lists.ADVISORY_FLOOR)
HITS["rule_known_cve_floor"] = (f"{MAN}, {FLOOR}", _cve_hits("manifest_deps", "adv_floor"))


def _practices() -> str:
    parts = []
    for pid, category, title, detail, deps in lists.PRACTICE_SIGNALS:
        tests = " OR ".join(
            f"starts_with(d.pkg, {lit(x[:-1])})" if x.endswith("*") else f"d.pkg = {lit(x)}" for x in deps
        )
        cond = f"EXISTS (SELECT 1 FROM manifest_deps d WHERE d.target_id = mf.target_id AND ({tests}))"
        if pid == "PASS_SECURITY_HEADERS_CONFIG":
            cond += (
                f" OR EXISTS (SELECT 1 FROM config c WHERE c.target_id = mf.target_id AND {m('c.content', p.HEADERS_CALL)} "
                f"AND {m('c.content', p.HEADERS_STRONG)})"
            )
        parts.append(
            f"SELECT mf.target_id, {lit(pid)} AS id, {lit(category)} AS category, {lit(title)} AS title, {lit(detail)} AS detail, "
            f"'whitebox' AS mode FROM manifests mf WHERE {cond}"
        )
    return " UNION ALL ".join(parts)


ORACLES["pass_good_practices"] = _with(f"{MAN}, {CONFIG}", _practices())

# ---- live rules -------------------------------------------------------------
REQ = o.values("req", "ord, header, label, sev, pass_title", [(i, *r) for i, r in enumerate(lists.REQUIRED_HEADERS)])
_GRID = f"{_HEADERS}, {REQ}, grid AS (SELECT pg.target_id, pg.url, req.*, EXISTS (SELECT 1 FROM headers h WHERE h.target_id = pg.target_id AND h.name = req.header) AS present FROM pg, req)"
HITS["rule_headers_live"] = (
    _GRID,
    o.hits(lit("header_missing"), "(SELECT * FROM grid WHERE NOT present) s",
           rule_id="'WEB_CONFIG_MISSING_' || upper(replace(header, '-', '_'))", severity="sev", url="url", params=["label"], ord="0, ord"),
)
_PASS_HEADERS = (
    "SELECT target_id, 'PASS_WEB_CONFIG_' || upper(replace(header, '-', '_')) AS id, 'web_config' AS category, pass_title AS title, "
    "'Your site sends the ' || label || ' response header.' AS detail, 'blackbox' AS mode FROM grid WHERE present"
)
ORACLES["pass_headers_live"] = _with(_GRID, _PASS_HEADERS)
HITS["rule_weak_cookie"] = (
    _HEADERS,
    o.hits(
        lit("weak_cookie"),
        f"(SELECT * FROM {_COOKIES} c WHERE {m('lower(cookie)', p.SESSION_COOKIE)} AND NOT (contains(lower(cookie), 'httponly') AND contains(lower(cookie), 'secure'))) s",
        evidence="split_part(cookie, '=', 1)", url="url", ord="1, ord",
    ),
)
PROBES = o.probe_responses()
_REAL = (
    f"((starts_with(file_path, '/.env') AND {m('answer', p.DOTFILE_ENV)}) OR (file_path = '/.git/config' AND {m('answer', p.DOTFILE_GIT)}))"
)
_HAS_SECRET = f"({m('answer', p.DOTFILE_VALUE)} AND ({o.classify('answer')}) = 'dangerous')"
HITS["rule_exposed_file"] = (
    f"{o.pages()}, {o.plan_dotfiles()}, {PROBES}",
    o.hits(
        f"CASE WHEN starts_with(file_path, '/.env') THEN 'exposed_env' ELSE 'exposed_git' END || CASE WHEN {_HAS_SECRET} THEN '_secret' ELSE '' END",
        f"(SELECT d.*, p.answer FROM plan_dotfiles d JOIN probes p ON p.target_id = d.target_id AND p.url = d.url WHERE p.status = 200 AND {_REAL}) s",
        url="url", params=["label"], ord="ord",
    ),
)
_LEAK = f"(p.status = 200 AND {m('p.answer', p.MAP_VERSION)} AND {m('p.answer', p.MAP_SOURCES)})"
_MAPS = f"{CRAWL}, {o.PLAN_MAPS}, {PROBES}"
HITS["rule_sourcemap"] = (
    _MAPS,
    o.hits(
        lit("sourcemap"),
        f"(SELECT d.* FROM plan_maps d JOIN probes p ON p.target_id = d.target_id AND p.url = d.url WHERE {_LEAK} "
        "QUALIFY row_number() OVER (PARTITION BY d.target_id ORDER BY d.ord) = 1) s",
        evidence="url", url="url",
    ),
)


def _pass_select(row: tuple, frm: str) -> str:
    pid, category, title, detail = row
    return (
        f"SELECT target_id, {lit(pid)} AS id, {lit(category)} AS category, {lit(title)} AS title, {lit(detail)} AS detail, "
        f"'blackbox' AS mode FROM {frm}"
    )


_PASS_MAPS = _pass_select(
    lists.PASS_SOURCEMAPS,
    f"(SELECT d.target_id FROM plan_maps d LEFT JOIN probes p ON p.target_id = d.target_id AND p.url = d.url GROUP BY 1 "
    f"HAVING NOT bool_or(coalesce({_LEAK}, false))) z",
)
ORACLES["pass_sourcemap"] = _with(_MAPS, _PASS_MAPS)
_ROWS = "(p.status = 200 AND json_valid(p.answer) AND json_type(CASE WHEN json_valid(p.answer) THEN p.answer ELSE '0' END) = 'ARRAY' AND json_array_length(CASE WHEN json_valid(p.answer) THEN p.answer ELSE '[]' END) > 0)"
_TABLES = f"{CRAWL}, {o.plan_tables()}, {PROBES}"
HITS["rule_rls_probe"] = (
    _TABLES,
    o.hits(
        lit("rls_open_live"),
        f"(SELECT d.* FROM plan_tables d JOIN probes p ON p.target_id = d.target_id AND p.url = d.url WHERE {_ROWS}) s",
        evidence="'\"' || table_name || '\" returned row data to an unauthenticated request (limit=1; row content discarded)'",
        url="url", params=["table_name"], ord="ord",
    ),
)
_PASS_TABLES = _pass_select(
    lists.PASS_RLS_PROBE,
    f"(SELECT d.target_id FROM plan_tables d LEFT JOIN probes p ON p.target_id = d.target_id AND p.url = d.url GROUP BY 1 "
    f"HAVING NOT bool_or(coalesce({_ROWS}, false))) z",
)
ORACLES["pass_rls_probe"] = _with(_TABLES, _PASS_TABLES)
HITS["rule_bundle_secrets"] = (CRAWL, o.secret_hits("bundles", "target_id, script_url", url="script_url"))

# ---- ingestion --------------------------------------------------------------
_GL = f"(SELECT *, coalesce({o.js('r', 'Secret')}, {o.js('r', 'Match')}, '') AS value FROM {o.items('gitleaks')} i)"
HITS["ingest_gitleaks"] = (
    REPORTS,
    o.hits(
        "CASE WHEN verdict = 'dangerous' THEN 'gitleaks_dangerous' ELSE 'gitleaks_other' END",
        f"(SELECT * FROM (SELECT *, {o.classify('value')} AS verdict FROM {_GL} g) g2 WHERE value <> '' AND verdict <> 'public') s",
        rule_id=f"'GITLEAKS_' || upper(coalesce({o.js('r', 'RuleID')}, 'SECRET'))", evidence="substr(value, 1, 8) || '… (redacted)'",
        file=o.relative("root", o.js("r", "File")), line=o.js("r", "StartLine"),
        params=[f"coalesce({o.js('r', 'Description')}, {o.js('r', 'RuleID')}, 'credential')",
                f"CASE WHEN coalesce({o.js('r', 'Commit')}, '') <> '' THEN {lit(GITLEAKS_HISTORY_NOTE)} ELSE '' END"],
        ord=o.emit_order(),
    ),
)
_LEVEL = o.js("r", "extra.severity")
HITS["ingest_semgrep"] = (
    REPORTS,
    o.hits(
        lit("semgrep"), f"{o.items('semgrep')} s",
        rule_id=f"'SEMGREP_' || upper(string_split(coalesce({o.js('r', 'check_id')}, 'FINDING'), '.')[-1])",
        severity=f"CASE {_LEVEL} WHEN 'ERROR' THEN 'high' WHEN 'WARNING' THEN 'medium' WHEN 'INFO' THEN 'low' ELSE 'medium' END",
        file=o.relative("root", o.js("r", "path")), line=o.js("r", "start.line"),
        params=[f"coalesce(substr(nullif({o.js('r', 'extra.message')}, ''), 1, 120), 'Semgrep finding')"], ord=o.emit_order(),
    ),
)
_LABEL = "upper(coalesce(json_extract_string(v, '$.database_specific.severity'), json_extract_string(pk, '$.database_specific.severity'), json_extract_string(v, '$.affected[0].database_specific.severity'), ''))"
_SEV = f"""CASE WHEN contains({_LABEL}, 'CRITICAL') THEN 'critical' WHEN contains({_LABEL}, 'HIGH') THEN 'high'
  WHEN contains({_LABEL}, 'MODERATE') OR contains({_LABEL}, 'MEDIUM') THEN 'medium' WHEN contains({_LABEL}, 'LOW') THEN 'low'
  WHEN coalesce(json_array_length(v, '$.severity'), 0) > 0 THEN 'high' ELSE 'medium' END"""
# First fixed event over the affected entries of the package, in document order.
_FIXED = """list_filter(flatten(list_transform(list_filter(coalesce(json_extract(v, '$.affected[*]'), []),
    lambda a: coalesce(json_extract_string(a, '$.package.name'), '') IN ('', name)),
    lambda a: coalesce(json_extract_string(a, '$.ranges[*].events[*].fixed'), []))), lambda x: coalesce(x, '') <> '')[1]"""
OSV = f"""{REPORTS},
pk AS (SELECT target_id, report_id, pos, unnest(json_extract(r, '$.packages[*]')) AS pk, generate_subscripts(json_extract(r, '$.packages[*]'), 1) - 1 AS pkg_pos FROM {o.items('osv-scanner')} i),
vu AS (SELECT target_id, report_id, pos, pkg_pos, pk, unnest(json_extract(pk, '$.vulnerabilities[*]')) AS v, (generate_subscripts(json_extract(pk, '$.vulnerabilities[*]'), 1) - 1)::INTEGER AS v_pos,
  coalesce(json_extract_string(pk, '$.package.name'), 'dependency') AS name, coalesce(json_extract_string(pk, '$.package.version'), 'unknown') AS version FROM pk),
adv AS MATERIALIZED (SELECT target_id, report_id, pos, pkg_pos, v_pos, name, version, coalesce(json_extract_string(v, '$.id'), 'ADVISORY') AS advisory, {_SEV} AS severity, {_FIXED} AS fixed FROM vu)"""
ORACLES["osv_severity"] = _with(OSV, "SELECT report_id, v_pos, name, advisory, severity FROM adv")
ORACLES["osv_fixed_version"] = _with(OSV, "SELECT report_id, v_pos, name, advisory, fixed FROM adv")
_MAXFIX = f"arg_max(fixed, ({o.version('fixed')}, -v_pos)) FILTER (fixed IS NOT NULL AND {o.version('fixed')} IS NOT NULL)"
ORACLES["osv_max_fix"] = _with(OSV, f"SELECT report_id, name, version, {_MAXFIX} AS max_fix FROM adv GROUP BY ALL")
_ENDING = "CASE WHEN n = 1 THEN 'y' ELSE 'ies' END"
_CRIT = "CASE WHEN n_critical > 0 THEN ' (' || n_critical || ' critical)' ELSE '' END"
HITS["ingest_osv"] = (
    OSV,
    o.hits(
        "CASE WHEN target IS NOT NULL THEN 'osv_fixable' ELSE 'osv_unfixed' END",
        f"""(SELECT target_id, report_id, pos, pkg_pos, name, version, count(*) AS n, string_agg(advisory, ', ' ORDER BY v_pos) AS ids, min(advisory) AS first_id,
          CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS worst,
          count(*) FILTER (severity = 'critical') AS n_critical, count(fixed) AS n_fixed, {_MAXFIX} AS target FROM adv GROUP BY target_id, report_id, pos, pkg_pos, name, version) s""",
        rule_id="'OSV_' || upper(first_id)", severity="worst", evidence=f"n || ' advisor' || {_ENDING} || '; worst ' || worst",
        url="name || '@' || version",
        params=["name", f"n || ' known vulnerabilit' || {_ENDING} || {_CRIT}", f"n || ' known published vulnerabilit' || {_ENDING} || {_CRIT}",
                "ids", "target", f"CASE WHEN n_fixed < n THEN {lit(OSV_UNFIXED_NOTE)} ELSE '' END"],
        ord=o.emit_order("pkg_pos"),
    ),
)
ENGINES = (
    "engines AS (SELECT target_id, bool_or(engine = 'semgrep') AS semgrep, bool_or(engine = 'gitleaks') AS gitleaks, "
    "bool_or(engine = 'osv-scanner') AS osv_scanner FROM reports GROUP BY target_id)"
)
ORACLES["engine_flags"] = _with(f"{REPORTS}, {ENGINES}", "SELECT * FROM engines")
ORACLES["path_relative"] = _with(
    REPORTS,
    f"SELECT report_id, pos::INTEGER AS pos, {o.js('r', 'File')} AS path, {o.relative('root', o.js('r', 'File'))} AS relative FROM {o.items('gitleaks')} i",
)

for _key, (_ctes, _select) in HITS.items():
    ORACLES[_key] = o.finding_query(_ctes, _select)

# ---- pipeline ---------------------------------------------------------------


def _merge(*names: str) -> tuple[str, str]:
    """CTEs of several rules without repeats, and the union of their hits."""
    seen: dict[str, None] = {}
    for n in names:
        for cte in _split_ctes(HITS[n][0]):
            seen.setdefault(cte)
    cols = ", ".join(o.HIT_COLUMNS)
    union = " UNION ALL ".join(f"SELECT {cols} FROM ({HITS[n][1]}) u{i}" for i, n in enumerate(names))
    return ", ".join(seen), union


def _split_ctes(ctes: str) -> list[str]:
    """Top-level commas of a CTE list, outside of brackets and strings."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(ctes):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "([{":
            depth += 1
        elif not quoted and ch in ")]}":
            depth -= 1
        elif not quoted and depth == 0 and ch == ",":
            out.append(ctes[start:i].strip())
            start = i + 1
    out.append(ctes[start:].strip())
    return out


def _completed(names: tuple[str, ...], extra: str = "") -> str:
    ctes, union = _merge(*names)
    more = f", {extra}" if extra else ""
    return f"{o.variants()}, {ctes}{more}, completed AS MATERIALIZED (SELECT * FROM {o.complete(union)} q)"


_RAW = o.hits(lit("secret_generic"), "sv s", evidence=o.redact("value"), file="path", line="line", params=["value"], ord="ord")
_RAW_CTES = f"{o.variants()}, {SV}, raw AS (SELECT * FROM {o.complete(_RAW)} q)"
ORACLES["suppress_public_secrets"] = _with(
    _RAW_CTES, f"{o.publish(f'(SELECT * FROM raw WHERE ({o.classify(chr(112) + chr(48))}) <> {lit(chr(112) + chr(117) + chr(98) + chr(108) + chr(105) + chr(99))})')}"
)
ORACLES["strip_side_channel"] = _with(
    _RAW_CTES,
    "SELECT target_id, rule_id, variant, category, severity, confidence, source, evidence, file, line, url, phase, rule_ord FROM raw",
)
_RL = (
    f"{FE}, rl AS (SELECT target_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'RATE_LIMIT_MISSING' ELSE rule_id END AS rule_id, file, "
    "CASE event_id % 3 WHEN 0 THEN 'https://x.test/_next/static/chunks/main.js' WHEN 1 THEN 'https://x.test/api/login' END AS url, "
    "NULL::VARCHAR AS evidence FROM fe)"
)
_LOC = "concat_ws(' ', coalesce(file, ''), coalesce(url, ''), coalesce(evidence, ''))"
ORACLES["suppress_static_rate_limit"] = _with(
    _RL, f"SELECT * FROM rl WHERE NOT ({m('rule_id', p.RATE_LIMIT_RULE)} AND {m(_LOC, p.STATIC_ASSET)})"
)
_CO = (
    f"{FE}, co AS (SELECT target_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'WEB_CONFIG_CORS_WILDCARD_CREDENTIALS' ELSE rule_id END AS rule_id, "
    "CASE WHEN event_id % 3 = 0 THEN 'app/api/public/route.ts' ELSE file END AS file, CASE WHEN event_id % 5 = 0 THEN 'https://x.test/v2/public' END AS url, "
    "NULL::VARCHAR AS evidence, confidence FROM fe)"
)
ORACLES["downrank_public_cors"] = _with(
    _CO,
    f"SELECT * REPLACE (CASE WHEN rule_id = 'WEB_CONFIG_CORS_WILDCARD_CREDENTIALS' AND {m(_LOC, p.PUBLIC_API)} THEN 'low' ELSE confidence END AS confidence) FROM co",
)
_REPORTED = (
    "ingest_gitleaks", "ingest_osv", "ingest_semgrep", "rule_known_cve_floor", "rule_insecure_defaults", "rule_sql_injection",
    "rule_hardcoded_secrets",
)
REPORTED = _completed(_REPORTED)
ORACLES["contextualize"] = _with(REPORTED, o.publish(o.contextualized(o.suppressed("completed")), note=o.NOTE))
ORACLES["dedupe_findings"] = _with(REPORTED, o.publish(o.deduped(o.suppressed("completed"))))
_PLAIN = "plain_next AS (SELECT target_id, manifest_path, pkg, regexp_replace(declared, '^\\^', '') AS declared FROM manifest_deps WHERE pkg = 'next')"
HITS["_plain"] = (f"{MAN}, {FLOOR}, {_PLAIN}", _cve_hits("plain_next", "adv_floor"))
ORACLES["reconcile_deps"] = _with(
    _completed(("ingest_osv", "rule_known_cve_floor", "_plain")), o.publish(o.reconciled("completed"))
)
ORACLES["route_deps"] = _with(
    REPORTED,
    "SELECT target_id, rule_id, category, file, line, url, CASE WHEN category = 'dependencies' THEN 'held' ELSE 'stream' END AS route FROM completed",
)

# ---- grade and report -------------------------------------------------------
_COUNTS = ", ".join(f"(count(*) FILTER (severity = '{s}'))::INTEGER AS {s}" for s in lists.SEVERITIES)
ORACLES["counts_by_severity"] = _with(FE, f"SELECT target_id, {_COUNTS} FROM fe GROUP BY target_id")
_DAILY = f"{FE}, daily AS (SELECT * REPLACE (target_id * 1000 + dayofyear(ts) AS target_id) FROM fe)"
ORACLES["score"] = _with(_DAILY, f"SELECT target_id, score FROM {o.graded('daily')} g")
ORACLES["grade"] = _with(_DAILY, f"SELECT * FROM {o.graded('daily')} g")
ORACLES["ci_gate"] = _with(
    _DAILY,
    f"SELECT target_id, grade, critical, (CASE WHEN grade = 'F' OR critical > 0 THEN 2 ELSE 0 END)::INTEGER AS exit_code FROM {o.graded('daily')} g",
)
ORACLES["pass_dedupe"] = _with(
    f"{_GRID}, {MAN}, {CONFIG}", f"SELECT DISTINCT * FROM ({_PASS_HEADERS} UNION ALL {_PASS_HEADERS} UNION ALL {_practices()}) z"
)


def _clean(targets: str, found: str) -> str:
    rows = o.values("coverage", "category, title, detail", lists.CLEAN_COVERAGE)
    return (
        f"{rows}, clean AS (SELECT t.target_id, 'PASS_CLEAN_' || upper(c.category) AS id, c.category, c.title, c.detail, 'whitebox' AS mode "
        f"FROM {targets} t, coverage c WHERE t.type = 'repo' AND NOT EXISTS (SELECT 1 FROM {found} f WHERE f.target_id = t.target_id AND f.category = c.category))"
    )


ORACLES["pass_clean_category"] = _with(
    f"{_completed(('rule_sql_injection', 'rule_missing_auth', 'rule_mass_assignment', 'rule_insecure_upload'))}, {o.TARGETS}, {_clean('targets', 'completed')}",
    "SELECT * FROM clean",
)
ORACLES["mode_match"] = _with(
    f"{o.TARGETS}, {o.values('rules', 'rule_ord, rule, category, mode', [(i, *r) for i, r in enumerate(lists.RULES, start=1)])}",
    "SELECT t.target_id, t.type, r.rule_ord::INTEGER AS rule_ord, r.rule, r.category FROM targets t, rules r "
    "WHERE r.mode = 'both' OR r.mode = CASE WHEN t.type = 'url' THEN 'blackbox' ELSE 'whitebox' END",
)
def _spoiled(every: int, value: str, bad: str = "NULL") -> str:
    return f"CASE WHEN event_id % {every} = 0 THEN {bad} ELSE {value} END"


_BROKEN = {  # field: (divisor of the spoiled ids, value, what it becomes), in the order in which violations are listed
    "category": (13, "category", "'other'"), "severity": (17, "severity", "'urgent'"), "confidence": (19, "confidence", "NULL"),
    "mode": (23, "'whitebox'", "NULL"), "source": (43, "source", "'hearsay'"), "target_id": (41, "target_id", "NULL"),
    "rule_id": (11, "rule_id", "NULL"), "title": (29, "'Title ' || rule_id", "NULL"), "why": (31, "'Why ' || rule_id", "NULL"),
    "line": (37, "line", "-1"),
}
ORACLES["schema_validate"] = _with(
    FE,
    f"SELECT * FROM (SELECT event_id, {', '.join(f'{_spoiled(n, v, b)} AS {k}' for k, (n, v, b) in _BROKEN.items())}, "
    f"concat_ws(',', {', '.join(f'CASE WHEN event_id % {n} = 0 THEN {lit(k)} END' for k, (n, _, _) in _BROKEN.items())}) AS violations FROM fe) z "
    "WHERE violations <> ''",
)
_LOCATION = "CASE WHEN coalesce(file, '') <> '' THEN file || CASE WHEN coalesce(line, 0) <> 0 THEN ':' || line ELSE '' END ELSE coalesce(url, '') END"
ORACLES["findings_by_severity"] = _with(
    REPORTED,
    f"SELECT target_id, ({o.RANK})::INTEGER AS severity_rank, severity, title, {_LOCATION} AS location FROM ({o.publish(o.suppressed('completed'))}) z",
)
_FLEET_RULES = (
    *[k for k in HITS if k.startswith("rule_") and k != "rule_known_cve"], "ingest_gitleaks", "ingest_osv", "ingest_semgrep",
)


def _settled(names: tuple[str, ...], extra: str = "") -> str:
    return (
        f"{_completed(names, extra)}, context AS MATERIALIZED (SELECT * FROM {o.contextualized(o.suppressed('completed'))} q), "
        f"settled AS MATERIALIZED (SELECT * FROM {o.deduped(o.reconciled('context'))} q)"
    )


def _fleet() -> str:
    grid = _split_ctes(_GRID)
    known = set(_split_ctes(_merge(*_FLEET_RULES)[0]))
    missing = [c for c in grid + _split_ctes(CONFIG) + _split_ctes(_MAPS) if c not in known]
    pid, category, title, detail = lists.PASS_NO_SECRETS
    no_secret = f"""SELECT t.target_id, {lit(pid)} AS id, {lit(category)}, {lit(title)}, {lit(detail)}, CASE t.type WHEN 'url' THEN 'blackbox' ELSE 'whitebox' END
      FROM targets t WHERE (t.type = 'repo' OR t.target_id IN (SELECT target_id FROM pg)) AND NOT EXISTS (SELECT 1 FROM completed c WHERE c.target_id = t.target_id AND starts_with(c.variant, 'secret_'))"""
    passes = f"""allp AS (SELECT DISTINCT target_id, id FROM ({_PASS_HEADERS} UNION ALL {_practices()} UNION ALL {_PASS_MAPS} UNION ALL {_PASS_TABLES}
      UNION ALL {no_secret} UNION ALL SELECT * FROM clean) z)"""
    seen = list(dict.fromkeys(missing))
    return (
        f"{_settled(_FLEET_RULES, ', '.join(seen))}, {o.TARGETS}, {_clean('targets', 'settled')}, {passes}, "
        "np AS (SELECT target_id, count(*) AS passed FROM allp GROUP BY target_id)"
    )


_COUNT_COLS = ", ".join(f"g.{s}" for s in lists.SEVERITIES)
ORACLES["fleet_scan"] = _with(
    _fleet(),
    f"SELECT t.target_id, t.type, t.value, {_COUNT_COLS}, g.score, g.grade, coalesce(np.passed, 0)::INTEGER AS passed FROM targets t "
    f"JOIN {o.graded('settled', 'targets')} g ON t.target_id = g.target_id LEFT JOIN np ON np.target_id = t.target_id",
)
_REPORT = f"{_fleet()}, {ENGINES}, g AS (SELECT * FROM {o.graded('settled', 'targets')} z)"
ORACLES["report_assemble"] = _with(
    f"{_REPORT}, pl AS (SELECT target_id, string_agg(id, '>' ORDER BY id) AS passed, count(*)::INTEGER AS n_passed FROM allp GROUP BY target_id)",
    f"SELECT t.target_id, g.grade, g.score, coalesce(pl.passed, '') AS passed, coalesce(pl.n_passed, 0) AS n_passed, coalesce(e.gitleaks, false) AS gitleaks, "
    f"f.severity, f.rule_id, f.file, f.line, f.url, CASE WHEN f.variant IS NOT NULL THEN {o.MODE} END AS mode FROM targets t JOIN g ON g.target_id = t.target_id "
    "LEFT JOIN pl ON pl.target_id = t.target_id LEFT JOIN engines e ON e.target_id = t.target_id LEFT JOIN settled f ON f.target_id = t.target_id "
    "LEFT JOIN variants v ON v.variant = f.variant",
)
ORACLES["report_sink"] = _with(
    _REPORT,
    "SELECT g.target_id, g.grade, g.score, count(f.target_id) AS n_findings FROM g LEFT JOIN settled f ON f.target_id = g.target_id GROUP BY ALL",
)

# ---- streaming --------------------------------------------------------------
ORACLES["stream_findings"] = _with(
    FE,
    f"SELECT target_id, coalesce({o.IDENTITY}, {o.DEDUPE_KEY}) AS ident, event_id, rule_id, category, severity, confidence, file, line, url, source FROM fe "
    "QUALIFY row_number() OVER (PARTITION BY target_id, ident ORDER BY ts, event_id) = 1",
)
ORACLES["stream_progress"] = _with(
    FE,
    f"SELECT target_id, scan, count(*)::INTEGER AS done, {len(corpus.EVENT_RULES)}::INTEGER AS total, arg_max(category, (ts, event_id)) AS phase FROM ("
    "SELECT target_id, dayofyear(ts)::INTEGER AS scan, rule_id, arg_min(category, (ts, event_id)) AS category, min((ts, event_id)) AS at, min(ts) AS ts, "
    "arg_min(event_id, (ts, event_id)) AS event_id FROM fe GROUP BY target_id, dayofyear(ts), rule_id) z GROUP BY target_id, scan",
)
ORACLES["stream_upsert"] = _with(
    f"{FE}, {FID}",
    "SELECT target_id, finding_id, event_id, rule_id, severity, file, line FROM fid "
    "QUALIFY row_number() OVER (PARTITION BY target_id, finding_id ORDER BY ts DESC, event_id DESC) = 1",
)
ORACLES["stream_backpressure"] = _with(
    FE, "SELECT event_id, target_id, rule_id, count(*) OVER (PARTITION BY event_id % 4) AS batch_rows FROM fe"
)
ORACLES["stream_deps_hold"] = """WITH k AS (SELECT event_id, user_id AS target_id, event_type, 'pkg' || (event_id % 11) AS pkg FROM events)
SELECT event_id, target_id, pkg FROM k n WHERE event_type = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM k e WHERE e.event_type = 'error' AND e.target_id = n.target_id AND e.pkg = n.pkg)"""

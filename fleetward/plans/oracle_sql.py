"""SQL building blocks of the oracles: the derived tables and scans in ANSI-style SQL.

The statements are independent of the Spark plans: line numbers come from the text
before a match, calls from token positions, and lookarounds from extract-then-filter.
"""

from __future__ import annotations

from ..catalog import lists, patterns as p
from ..catalog.texts import MAX_PARAMS, VARIANTS
from ..schema import ENGINE_OF, RULE_ORDER, _by_prefix
from ..sources import corpus
from ..sources.snippets import ANON_TOKEN, EXAMPLE_CONN, LIVE_KEY, PUBLIC_KEY, SNIPPETS


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(name: str, cols: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(c) for c in r) + ")" for r in rows)
    return f"{name}({cols}) AS (SELECT * FROM (VALUES {body}) AS v({cols}))"


def rx(pattern) -> str:
    return lit(pattern.re2)


def m(col: str, *patterns) -> str:
    """Any of the patterns occurs in ``col``."""
    return "(" + " OR ".join(f"regexp_matches({col}, {rx(q)})" for q in patterns) + ")"


def nl(expr: str) -> str:
    return f"(length({expr}) - length(replace({expr}, chr(10), '')))"


def trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


# ---- files ------------------------------------------------------------------


def files_raw() -> str:
    k, t = len(SNIPPETS), corpus.TARGETS
    rows = [(i, s.path, s.root, s.pure, s.text) for i, s in enumerate(SNIPPETS)]
    return (
        values("snips", "kind, spath, root, pure, snippet", rows)
        + f""",
docs AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % {t} AS target_id, doc_id // {t} AS cyc,
  '{{"description": "' || regexp_replace(coalesce(text, ''), '["\\\x00-\x1f]', ' ', 'g') AS described FROM documents),
files_raw AS MATERIALIZED (
  SELECT d.target_id,
    CASE WHEN s.root AND d.cyc < {k} THEN s.spath ELSE 'f' || d.doc_id || '/' || s.spath END AS path,
    CASE WHEN s.pure AND length(d.text) % 11 = 0 THEN d.described
         WHEN s.pure THEN d.described || '", ' || substr(replace(s.snippet, '@V@', (d.doc_id % 6 + 10)::VARCHAR), 2)
         ELSE d.text || chr(10) || replace(s.snippet, '@V@', (d.doc_id % 6 + 10)::VARCHAR) END AS content
  FROM docs d JOIN snips s ON s.kind = (d.cyc + d.target_id * 5) % {k})"""
    )


def _ignored() -> str:
    dirs = " OR ".join(f"contains('/' || path, {lit('/' + d + '/')})" for d in lists.IGNORED_DIRS)
    ends = " OR ".join(f"ends_with(path, {lit(s)})" for s in lists.IGNORED_SUFFIXES)
    name = "regexp_extract(path, '[^/]*$')"
    mids = " OR ".join(f"contains({name}, {lit(s)})" for s in lists.IGNORED_INFIXES)
    return f"({dirs} OR {ends} OR {mids})"


IGNORED = _ignored()


def files() -> str:
    return (
        files_raw()
        + f""",
files AS MATERIALIZED (
  SELECT target_id, path, content
  FROM files_raw WHERE NOT {IGNORED})"""
    )


REPO_TARGETS = (
    f"repo_targets AS (SELECT DISTINCT doc_id % {corpus.TARGETS} AS target_id, 'repo' AS type, "
    f"'/repo/t' || (doc_id % {corpus.TARGETS}) AS value FROM documents)"
)
URL_TARGETS = (
    f"url_targets AS (SELECT page_id + {corpus.URL_TARGET_BASE} AS target_id, 'url' AS type, url AS value FROM pages)"
)
TARGETS = f"{REPO_TARGETS}, {URL_TARGETS}, targets AS (SELECT * FROM repo_targets UNION ALL SELECT * FROM url_targets)"

IS_SOURCE = m("path", p.SOURCE_FILE)
IS_SQL = "ends_with(path, '.sql')"
IS_ENV = m("path", p.ENV_FILE)
IS_CONFIG = m("path", p.FRAMEWORK_CONFIG)
IS_CODE = m("path", p.CODE_OR_CONFIG)


def scan(src: str, pattern: str, cols: str = "target_id, path", text: str = "content") -> str:
    """Matches of an RE2 pattern: ``cols, content, ord, match, start0`` (0-based) and ``line``."""
    seg = "list_sum(list_transform({}, lambda x: length(x)))"
    return f"""(SELECT *, 1 + {nl('substr(content, 1, start0)')} AS line FROM (
    SELECT {cols}, content, i AS ord, ms[i] AS match,
      (coalesce({seg.format('segs[1:i]')}, 0) + coalesce({seg.format('ms[1:i-1]')}, 0))::BIGINT AS start0
    FROM (SELECT {cols}, {text} AS content, string_split_regex({text}, {lit(pattern)}) AS segs,
            regexp_extract_all({text}, {lit(pattern)}) AS ms FROM {src} WHERE regexp_matches({text}, {lit(pattern)})) z,
      LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i) y) w)"""


# ---- findings ---------------------------------------------------------------

HIT_COLUMNS = (
    "target_id", "variant", "rule_id", "severity", "evidence", "file", "line", "url",
    *[f"p{i}" for i in range(MAX_PARAMS)], "emit_ord",
)


def hits(variant: str, frm: str, *, rule_id="NULL", severity="NULL", evidence="NULL", file="NULL", line="NULL",
         url="NULL", params=(), ord="1") -> str:
    """SELECT of hit rows; ``variant`` is an SQL expression, ``ord`` a list of numbers."""
    ps = list(params) + ["NULL"] * (MAX_PARAMS - len(params))
    cells = [
        "target_id", f"{variant} AS variant", f"{rule_id}::VARCHAR AS rule_id", f"{severity}::VARCHAR AS severity",
        f"{evidence}::VARCHAR AS evidence", f"{file}::VARCHAR AS file", f"{line}::INTEGER AS line",
        f"{url}::VARCHAR AS url", *[f"{x}::VARCHAR AS p{i}" for i, x in enumerate(ps)], f"[{ord}]::BIGINT[] AS emit_ord",
    ]
    return f"SELECT {', '.join(cells)} FROM {frm}"


def variants() -> str:
    rows = [
        (
            k, v.rule_id, v.category, v.severity, v.confidence, _by_prefix(ENGINE_OF, k, "native"),
            0 if _by_prefix(ENGINE_OF, k) is None else 1, _by_prefix(RULE_ORDER, k), v.cwe, v.owasp, v.mode,
            v.title, v.why, v.fix, v.fix_prompt,
        )
        for k, v in VARIANTS.items()
    ]
    cols = (
        "variant, rule_id_v, category, severity_v, confidence, source, phase, rule_ord, cwe, owasp, mode, "
        "title_t, why_t, fix_t, prompt_t"
    )
    return values("variants", cols, rows)


def fill(template: str) -> str:
    out = template
    for i in range(MAX_PARAMS):
        out = f"replace({out}, '<<{i}>>', coalesce(p{i}, ''))"
    return f"replace(replace({out}, '<<file>>', coalesce(file, '')), '<<url>>', coalesce(url, ''))"


def complete(src: str) -> str:
    """Hit rows with everything their variant determines."""
    ps = ", ".join(f"h.p{i}" for i in range(MAX_PARAMS))
    return f"""(SELECT h.target_id, coalesce(h.rule_id, v.rule_id_v) AS rule_id, h.variant, v.category,
    coalesce(h.severity, v.severity_v) AS severity, v.confidence, v.source, h.evidence, h.file, h.line, h.url, {ps},
    v.phase, v.rule_ord, h.emit_ord FROM ({src}) h JOIN variants v ON h.variant = v.variant)"""


MODE = "CASE WHEN starts_with(f.variant, 'secret_') AND f.file IS NULL AND f.url IS NOT NULL THEN 'blackbox' ELSE v.mode END"


def publish(completed: str, extra: str = "", note: str = "''") -> str:
    """Public columns of completed rows."""
    return f"""SELECT f.target_id, f.rule_id, f.category, f.severity, v.cwe, v.owasp, {fill('v.title_t')} AS title,
  {note} || {fill('v.why_t')} AS why, f.evidence, f.file, f.line, f.url, {fill('v.fix_t')} AS fix,
  {fill('v.prompt_t')} AS fix_prompt, f.confidence, {MODE} AS mode, f.source{extra}
FROM {completed} f JOIN variants v ON f.variant = v.variant"""


def finding_query(ctes: str, hit_select: str) -> str:
    return f"WITH {variants()}, {ctes} {publish(complete(hit_select))}"


# ---- secrets ----------------------------------------------------------------


def classify(v: str) -> str:
    """Verdict on the SQL expression ``v``."""
    payload = f"translate(split_part(regexp_extract({v}, {rx(p.JWT)}), '.', 2), '-_', '+/')"
    padded = f"({payload} || repeat('=', (4 - length({payload}) % 4) % 4))"
    role = f"regexp_extract(coalesce(try(decode(from_base64({padded}))), ''), '\"role\"\\s*:\\s*\"([^\"]*)\"', 1)"
    conn = f"regexp_extract({v}, {rx(p.CONN_STRING)})"
    has_pw = f"regexp_matches({conn}, {rx(p.CONN_PASSWORD)})"
    example = f"regexp_matches(regexp_extract({conn}, {rx(p.CONN_PASSWORD)}, 1), {rx(p.CONN_PLACEHOLDER)})"
    return f"""CASE WHEN {m(v, p.DANGEROUS_VALUE)} OR ({role}) = 'service_role' OR ({has_pw} AND NOT {example}) THEN 'dangerous'
      WHEN {m(v, p.PUBLIC_VALUE, p.PLACEHOLDER_VALUE)} OR ({role}) = 'anon' OR ({has_pw} AND {example}) THEN 'public'
      ELSE 'other' END"""


def entropy(v: str) -> str:
    share = f"((length({v}) - length(replace({v}, c, '')))::DOUBLE / length({v}))"
    return (
        f"CASE WHEN length({v}) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_distinct(string_split({v}, '')), "
        f"lambda c: -{share} * log2({share}))), 0.0) END"
    )


def redact(v: str) -> str:
    t = trim(v)
    return (
        f"CASE WHEN length({t}) <= 8 THEN '****' ELSE substr({t}, 1, least(10, length({t}) // 3)) || "
        f"'…****** (redacted)' END"
    )


def secret_hits(src: str, cols: str, *, file: str = "NULL", url: str = "NULL") -> str:
    found = scan(src, p.SECRET_SHAPES.re2, cols)
    return f"""SELECT * FROM ({hits(
        '''CASE WHEN verdict = 'dangerous' AND regexp_matches(value, '(?:sk|rk)_live_') THEN 'secret_stripe'
        WHEN verdict = 'dangerous' AND contains(value, 'sb_secret_') THEN 'secret_service_role'
        WHEN verdict = 'dangerous' AND contains(value, 'PRIVATE KEY') THEN 'secret_private_key'
        WHEN verdict = 'dangerous' AND contains(value, '://') THEN 'secret_conn_string'
        WHEN verdict = 'dangerous' AND regexp_matches(match, '(?i)^service_role') THEN 'secret_service_role'
        WHEN verdict = 'dangerous' THEN 'secret_service_role_jwt'
        WHEN verdict = 'other' AND assigned <> '' AND ''' + entropy('value') + ''' >= 3.5 THEN 'secret_generic' END''',
        f'''(SELECT *, {classify("value")} AS verdict FROM (
          SELECT *, CASE WHEN assigned <> '' THEN assigned ELSE match END AS value FROM (
            SELECT *, regexp_extract(match, {rx(p.ASSIGNED_VALUE)}, 1) AS assigned FROM {found} a) b) c) d''',
        evidence=redact('value'), file=file, url=url, line='line', ord='ord')}) e WHERE variant IS NOT NULL"""


# ---- calls ------------------------------------------------------------------

_STR = r""""(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'"""
_PLAIN = r"`(?:[^`\\]|\\[\s\S])*`"
_TPL = (
    r"`(?:[^`\\$]|\\[\s\S]|\$\{(?:[^{}`\"']|" + _STR + "|" + _PLAIN + r"|\{[^{}]*\})*\}|\$[^{`\\])*`|" + _PLAIN
)
_LITERAL = f"{_STR}|{_TPL}"


def _brackets(depth: int) -> str:
    inner = rf"[^()\[\]{{}}\"'`]|{_LITERAL}"
    if depth:
        inner += rf"|[(\[{{]{_brackets(depth - 1)}[)\]}}]"
    return f"(?:{inner})*"


_ARG = rf"(?:[^()\[\]{{}},\"'`]|{_LITERAL}|[(\[{{]{_brackets(2)}[)\]}}])*"
_NAME = r"[\p{L}_$][\w$\p{L}\p{N}]*"
_CALL = rf"((?:\??\.\s*)?{_NAME}(?:\s*[?!]?\.\s*#?{_NAME})*)\s*(?:<[^<>()]*>)?\("
_TOKENS = (
    r"//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|" + _LITERAL
    + rf"|\b(?:new\s+|function\s*\*?\s*){_NAME}(?:\s*\.\s*{_NAME})*|{_CALL}"
)
_KEYWORDS = (
    "if", "for", "while", "switch", "catch", "return", "typeof", "await", "void", "delete", "throw", "case", "do",
    "else", "yield", "in", "of", "function", "async", "import", "super",
)


_LEADING_DOT = r"^\.\s*"


def call_sites(src: str) -> str:
    """``target_id, path, ord, line, callee, arg0`` of all plain calls."""
    keywords = ", ".join(lit(k) for k in _KEYWORDS)
    toks = scan(src, _TOKENS)
    # a dot right behind a word does not begin the callee: "3.", a line break and a name are a sentence's end and a call
    after_word = f"CASE WHEN start0 > 0 AND regexp_matches(substr(content, start0, 1), {lit(r'[\w$\p{L}\p{N}]')}) THEN {nl(f'regexp_extract(raw, {lit(_LEADING_DOT)})')} ELSE 0 END"
    return f"""(SELECT target_id, path, row_number() OVER (PARTITION BY target_id, path ORDER BY start0)::INTEGER AS ord,
      (line + {after_word})::INTEGER AS line, callee, regexp_replace(regexp_extract(rest, {lit(r'^\s*(' + _ARG + ')')}, 1), '\\s+$', '') AS arg0
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '\\s', '', 'g'), '^.*!\\.', ''), '^\\.|^this\\.|^this$', '') AS callee,
        substr(content, start0 + length(match) + 1) AS rest
      FROM (SELECT *, regexp_extract(match, {lit('^' + _CALL + '$')}, 1) AS raw FROM {toks} a
            WHERE regexp_matches(match, {lit('^' + _CALL + '$')})) b) c
    WHERE NOT contains(raw, '?') AND regexp_extract(raw, {lit(_NAME)}) NOT IN ({keywords})
      AND NOT regexp_matches(rest, {lit('^' + _brackets(2) + r'\)\s*\{')}))"""


def tainted(arg: str) -> str:
    """Taint of the first-argument text ``arg``."""
    literal = r"""\$\{\s*(?:"[^"]*"|'[^']*'|[\d.]+)\s*\}"""
    template = (
        f"(regexp_matches({arg}, {lit('^(?:' + _TPL + ')$')}) AND "
        f"contains(regexp_replace({arg}, {lit(literal)}, '', 'g'), '${{'))"
    )
    flat = f"regexp_replace({arg}, {lit(_STR)}, '\"\"', 'g')"
    flat = f"regexp_replace({flat}, {lit(_TPL)}, '``', 'g')"
    for _ in range(3):
        flat = f"regexp_replace({flat}, {lit(r'([\w$)\]])\s*(?:\([^()\[\]{}]*\)|\[[^()\[\]{}]*\])')}, '\\1', 'g')"
    top = flat
    for _ in range(2):
        top = f"regexp_replace({top}, '\\([^()]*\\)', '\"\"', 'g')"
    skip = ", ".join(lit(k) for k in ("await", "new", "typeof", "void", "delete", "true", "false", "null", "function", "async", "class", "this"))
    operands = f"regexp_extract_all({flat}, '(?:^|[-+*/%(])\\s*([\\p{{L}}_$][\\w$.\\p{{L}}]*)', 1)"
    concat = (
        f"(regexp_matches({top}, {lit(r'^[\w$\p{L}\p{N}.\s+\-*/%' + chr(34) + '`!]*$')}) AND "
        f"regexp_matches({top}, {lit(r'[\w$\p{L}\p{N}' + chr(34) + r'`)]\s*\+\s*[^+\s][^+\-]*$')}) AND "
        f"len(list_filter({operands}, lambda o: o NOT IN ({skip}))) > 0)"
    )
    return f"({template} OR (contains({arg}, '+') AND {concat}))"


# ---- dependencies -----------------------------------------------------------

DEPS = """deps AS (SELECT l_orderkey AS target_id, 'package.json' AS manifest_path, 'pkg' || l_partkey AS pkg,
  ['^', '~', '>=', '', 'v'][l_linenumber % 5 + 1] || (l_quantity::INTEGER % 16) || '.' || l_linenumber || '.' || (l_suppkey % 30)
  AS declared FROM lineitem)"""
ADVISORIES = """advisories AS (
  SELECT pkg, 'ADV-' || k || '-' || s AS id, severity, lo, fixed, 'Flaw ' || s || ' in ' || pkg || '.' AS summary
  FROM (SELECT 'pkg' || p_partkey AS pkg, p_partkey::VARCHAR AS k, p_size % 14 AS major,
          ['low', 'medium', 'high', 'critical'][(p_size % 14) % 4 + 1] AS severity FROM part) b,
    LATERAL (VALUES ('A', major || '.0.0', (major + 1) || '.2.3'),
      ('A', ((major + 7) % 14) || '.1.0', ((major + 7) % 14) || '.4.9'),
      ('B', major || '.3.0', (major + 3) || '.0.0')) r(s, lo, fixed))"""


def version(v: str) -> str:
    """``[major, minor, patch]`` or NULL."""
    clean = f"regexp_replace({trim(v)}, {rx(p.VERSION_PREFIX)}, '')"

    def part(q, i, n):
        return f"regexp_extract({clean}, {rx(q)}, {i})::BIGINT" if i <= n else "0"

    arms = " ".join(
        f"WHEN regexp_matches({clean}, {rx(q)}) THEN [{', '.join(part(q, i, n) for i in (1, 2, 3))}]"
        for q, n in ((p.VERSION_3, 3), (p.VERSION_2, 2), (p.VERSION_1, 1))
    )
    return f"(CASE {arms} END)"


def vfmt(v: str) -> str:
    return f"({v}[1] || '.' || {v}[2] || '.' || {v}[3])"


# ---- manifests --------------------------------------------------------------

MANIFESTS = """picked AS (SELECT target_id, path, content FROM (
    SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY (path <> 'package.json'), path) AS rn
    FROM files WHERE ends_with(path, 'package.json')) z WHERE rn = 1),
manifests AS (SELECT target_id, path, content FROM picked WHERE json_valid(content)),
manifest_deps AS (
  SELECT target_id, path AS manifest_path, pkg, coalesce(dev, run) AS declared FROM (
    SELECT target_id, path, pkg, json_extract_string(content, '$.dependencies."' || pkg || '"') AS run,
      json_extract_string(content, '$.devDependencies."' || pkg || '"') AS dev
    FROM (SELECT DISTINCT target_id, path, content, pkg FROM (
      SELECT target_id, path, content, unnest(list_concat(coalesce(json_keys(content, '$.dependencies'), []),
        coalesce(json_keys(content, '$.devDependencies'), []))) AS pkg FROM manifests) a) b) c)"""

# ---- crawled pages ----------------------------------------------------------


def _script(i: str, absolute: bool) -> str:
    host, folder, scheme = ("origin ||", "folder ||", "scheme ||") if absolute else ("", "", "")
    rel = "'rel/'" if absolute else "'./rel/'"
    return (
        f"CASE {i} % 5 WHEN 0 THEN {host} '/static/app' || {i} || '.js' WHEN 1 THEN {folder} 'chunk' || {i} || '.mjs?v=2' "
        f"WHEN 2 THEN {scheme} '//cdn.example.net/lib' || {i} || '.js' WHEN 3 THEN 'https://cdn.example.org/x' || {i} || '.js' "
        f"ELSE {folder} {rel} || ({i} % 2) || '.css' END"
    )


def pages() -> str:
    plain = "split_part(split_part(url, '#', 1), '?', 1)"
    origin = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
    return (
        f"pg AS (SELECT page_id, page_id + {corpus.URL_TARGET_BASE} AS target_id, url, html, {origin} AS origin, "
        f"regexp_extract({plain}, '^(https?://[^/]+/(?:[^/]*/)*)', 1) AS folder, regexp_extract(url, '^(https?:)', 1) AS scheme, "
        f"range(0, page_id % {corpus.MAX_SCRIPTS}) AS nums FROM pages WHERE coalesce(html, '') <> '')"
    )


def raw_headers() -> str:
    return (
        values("hrules", "ord, name, value, div, mod, r1, r2", corpus.HEADER_RULES)
        + ", raw_headers AS (SELECT target_id, url, ord, name, value FROM pg, hrules "
        "WHERE (page_id // div) % mod IN (r1, r2))"
    )


HEADERS = (
    "headers AS (SELECT target_id, url, lower(name) AS name, string_agg(value, chr(10) ORDER BY ord) AS value "
    "FROM raw_headers GROUP BY ALL)"
)


def homepages() -> str:
    tag = (
        f"CASE WHEN i % 2 = 0 THEN '<script defer src=\"' || ({_script('i', False)}) || '\"></script>' "
        f"ELSE '<SCRIPT src = ''' || ({_script('i', False)}) || '''></SCRIPT>' END"
    )
    return f"""home AS MATERIALIZED (SELECT target_id, url, html || chr(10) || '<!-- <script src=''/old.js''></script> -->' || chr(10)
    || array_to_string(list_transform(nums, lambda i: {tag}), chr(10))
    || CASE WHEN page_id % 10 = 3 THEN '<script>var c = {{ apiKey: "AIza' || lpad(page_id::VARCHAR, 35, 'k') || '" }};</script>' ELSE '' END
    AS body FROM pg)"""


_DB_URL = "'https://' || lpad(page_id::VARCHAR, 20, 'a') || '.supabase.co'"


def responses() -> str:
    config = f"""CASE WHEN page_id % 3 = 0 AND i = 1 THEN ' var u="' || {_DB_URL} || '";'
      WHEN page_id % 6 = 0 AND i = 2 THEN ' k="sb_publishable_' || lpad(page_id::VARCHAR, 16, 'K') || '"'
      WHEN page_id % 4 < 3 AND i = 3 THEN ' t="{ANON_TOKEN}"'
      WHEN page_id % 9 = 5 AND i = 0 THEN ' s="{LIVE_KEY}"'
      WHEN page_id % 5 = 0 AND i = 5 THEN ' var f={{"apiKey":"AIza' || lpad(page_id::VARCHAR, 35, 'z') || '"}}' ELSE '' END"""
    return f"""responses AS (SELECT target_id, {_script('i', True)} AS url,
    CASE WHEN (page_id + i) % 7 = 0 THEN 404 ELSE 200 END AS status,
    CASE WHEN (page_id + i) % 13 = 0 THEN '' ELSE 'bundle ' || i || ({config}) END AS body
  FROM (SELECT *, unnest(nums) AS i FROM pg) z WHERE i % 5 <> 4 OR i < 10)"""


def _resolve(ref: str) -> str:
    """Only the reference shapes the corpus holds: dot segments are a leading ``./``."""
    return (
        f"CASE WHEN regexp_matches({ref}, '^https?://') THEN {ref} WHEN starts_with({ref}, '//') THEN scheme || {ref} "
        f"WHEN starts_with({ref}, '/') THEN origin || {ref} ELSE folder || regexp_replace({ref}, '^\\./', '') END"
    )


def scripts() -> str:
    live = "regexp_replace(body, '<!--(?:[^-]|-[^-]|--[^>])*-->', '', 'g')"
    refs = (
        f"list_transform(regexp_extract_all({live}, {rx(p.SCRIPT_SRC)}), lambda t: "
        f"coalesce(nullif(regexp_extract(t, {rx(p.SCRIPT_SRC)}, 1), ''), nullif(regexp_extract(t, {rx(p.SCRIPT_SRC)}, 2), ''), "
        f"regexp_extract(t, {rx(p.SCRIPT_SRC)}, 3)))"
    )
    return f"""refs AS (SELECT h.target_id, pg.origin, pg.folder, pg.scheme, unnest({refs}) AS ref,
    generate_subscripts({refs}, 1) AS pos FROM home h JOIN pg ON h.target_id = pg.target_id),
scripts AS MATERIALIZED (SELECT target_id, (row_number() OVER (PARTITION BY target_id ORDER BY pos) - 1)::INTEGER AS ord, script_url
  FROM (SELECT target_id, {_resolve('ref')} AS script_url, min(pos) AS pos FROM refs GROUP BY 1, 2) z)"""


BUNDLES = (
    "bundles AS MATERIALIZED (SELECT s.target_id, s.ord, s.script_url, r.body AS content FROM scripts s JOIN responses r "
    "ON r.target_id = s.target_id AND r.url = s.script_url WHERE r.status = 200 AND r.body <> '')"
)


def discovered() -> str:
    def found(pattern, idx):
        return f"nullif(regexp_extract(text, {rx(pattern)}, {idx}), '')"

    def first(col):
        return f"arg_min({col}, ord) FILTER ({col} IS NOT NULL) AS {col}"

    return f"""hay AS (SELECT target_id, -1 AS ord, body AS text FROM home UNION ALL SELECT target_id, ord, content FROM bundles),
vals AS (SELECT target_id, ord, {found(p.HOSTED_DB_URL, 0)} AS db_url, {found(p.PUBLISHABLE_KEY, 1)} AS pub_key,
  {found(p.ANON_JWT, 1)} AS token, {found(p.WEB_API_KEY, 1)} AS web_api_key FROM hay),
firsts AS (SELECT target_id, {first('db_url')}, {first('pub_key')}, {first('token')}, {first('web_api_key')} FROM vals GROUP BY target_id),
discovered AS (SELECT target_id, db_url, CASE WHEN db_url IS NOT NULL THEN coalesce(pub_key, token) END AS db_key, web_api_key FROM firsts)"""


def crawl() -> str:
    """Everything up to the discovered configuration."""
    return ", ".join([pages(), homepages(), responses(), scripts(), BUNDLES, discovered()])


def plan_tables() -> str:
    return (
        values("probe_words", "ord, table_name", list(enumerate(lists.PROBED_TABLES)))
        + ", plan_tables AS (SELECT target_id, ord::INTEGER AS ord, table_name, db_url || '/rest/v1/' || table_name || "
        "'?select=*&limit=1' AS url FROM discovered, probe_words WHERE db_url IS NOT NULL AND db_key IS NOT NULL)"
    )


def plan_dotfiles() -> str:
    return (
        values("dot_words", "ord, file_path, label", [(i, f, f[1:]) for i, f in enumerate(lists.PROBED_DOTFILES)])
        + ", plan_dotfiles AS (SELECT target_id, ord::INTEGER AS ord, file_path, label, origin || file_path AS url FROM pg, dot_words)"
    )


PLAN_MAPS = (
    "plan_maps AS (SELECT target_id, ord, regexp_replace(script_url, '\\?.*$', '') || '.map' AS url FROM bundles "
    f"WHERE {m('script_url', p.BUNDLE_URL)} AND NOT {m('script_url', p.MAP_URL)})"
)


def probe_responses() -> str:
    r = "(page_id * 7 + o) % 6"
    q = "(page_id + o * 3) % 7"
    mm = "(page_id * 3 + i) % 11"
    return (
        values("pw", "o, w", list(enumerate(lists.PROBED_TABLES)))
        + ", "
        + values("dw", "o, w", list(enumerate(lists.PROBED_DOTFILES)))
        + f""",
probes AS (
  SELECT target_id, {_DB_URL} || '/rest/v1/' || w || '?select=*&limit=1' AS url,
    CASE WHEN {r} = 4 OR ({r} = 0 AND page_id % 2 = 1) THEN 401 ELSE 200 END AS status,
    CASE {r} WHEN 0 THEN '[{{"id": 1, "email": "x"}}]' WHEN 1 THEN '[]' WHEN 2 THEN '<!doctype html><html></html>'
      WHEN 3 THEN '{{"message": "no"}}' ELSE 'denied' END AS answer
  FROM pg, pw WHERE {r} <> 5
  UNION ALL
  SELECT target_id, origin || w, CASE WHEN {q} = 5 THEN 404 ELSE 200 END,
    CASE {q} WHEN 0 THEN 'STRIPE_KEY={LIVE_KEY}' || chr(10) || 'B=1' WHEN 1 THEN '<!doctype html><html></html>'
      WHEN 2 THEN '[core]' || chr(10) || chr(9) || 'bare = false'
      WHEN 3 THEN '# env' || chr(10) || 'PUBLIC={PUBLIC_KEY}' || chr(10) || 'DB={EXAMPLE_CONN}' ELSE 'not found' END
  FROM pg, dw WHERE {q} <> 6
  UNION ALL
  SELECT target_id, regexp_replace({_script('i', True)}, '\\?.*$', '') || '.map', CASE WHEN {mm} = 8 THEN 404 ELSE 200 END,
    CASE WHEN {mm} = 0 AND page_id % 4 <> 1 THEN '{{"version": 3, "sources": ["../src/app.tsx"], "mappings": "AAAA"}}'
      WHEN {mm} = 1 THEN '{{"version": 2, "sources": []}}' ELSE '<!doctype html><html></html>' END
  FROM (SELECT *, unnest(nums) AS i FROM pg) z WHERE i % 5 <> 4 AND {mm} < 9)"""
    )


# ---- engine reports ---------------------------------------------------------


def engine_reports() -> str:
    k, t = "p_partkey", corpus.TARGETS
    root = f"'/repo/t' || ({k} % {t})"
    secret = (
        f"CASE {k} % 5 WHEN 0 THEN '{LIVE_KEY}' WHEN 1 THEN '{PUBLIC_KEY}' WHEN 2 THEN '0badc0de0badc0de' || {k} "
        f"WHEN 3 THEN '{EXAMPLE_CONN}' ELSE '' END"
    )
    gitleaks = f"""'[{{"RuleID": "generic-api-key", "Description": "Generic key", "Secret": "' || ({secret}) || '", "Match": "key = x", "File": "' || {root}
      || '/src/f' || ({k} % 40) || '.ts", "StartLine": ' || p_size || CASE WHEN {k} % 3 = 0 THEN ', "Commit": "abc123"' ELSE '' END
      || '}}, {{"RuleID": "db-url", "Match": "0badc0de0badc0de' || {k} || '", "File": "' || {root} || '/docs/n' || ({k} % 7) || '.md", "StartLine": 3}}]'"""
    semgrep = f"""'{{"results": [{{"check_id": "pack.rules.check-' || ({k} % 9) || '", "path": "' || {root} || '/lib/s' || ({k} % 30)
      || '.js", "start": {{"line": ' || p_size || '}}, "extra": {{"severity": "' || ['ERROR', 'WARNING', 'INFO', 'OTHER'][{k} % 4 + 1]
      || '", "message": "Dangerous pattern ' || ({k} % 9) || '"}}}}, {{"path": "' || {root} || '/examples/e' || ({k} % 5) || '.js", "start": {{"line": 1}}}}]}}'"""
    name = f"(CASE WHEN {k} % 50 = 0 THEN 'next' ELSE 'pkg' || {k} END)"
    extra = f"""CASE {k} % 3 WHEN 0 THEN ', {{"id": "GHSA-b' || {k} || '", "severity": [{{"type": "CVSS_V3"}}], "affected": [{{"package": {{"name": "other"}}, "ranges": [{{"events": [{{"fixed": "99.0.0"}}]}}]}}]}}'
      WHEN 1 THEN ', {{"id": "GHSA-0' || {k} || '", "affected": [{{"database_specific": {{"severity": "low"}}, "ranges": [{{"events": [{{"introduced": "0"}}, {{"fixed": "'
        || ({k} % 4 + 2) || '.0.1"}}]}}]}}]}}, {{"id": "GHSA-z' || {k} || '"}}' ELSE '' END"""
    osv = f"""'{{"results": [{{"packages": [{{"package": {{"name": "' || {name} || '", "version": "' || ({k} % 3 + 1) || '.' || p_size
      || '.0"}}, "vulnerabilities": [{{"id": "GHSA-m' || {k} || '", "database_specific": {{"severity": "' || ['CRITICAL', 'HIGH', 'MODERATE', 'LOW'][{k} % 4 + 1]
      || '"}}, "affected": [{{"package": {{"name": "' || {name} || '"}}, "ranges": [{{"events": [{{"introduced": "0"}}, {{"fixed": "' || ({k} % 4 + 1) || '.' || p_size || '.2"}}]}}]}}]}}'
      || ({extra}) || ']}}, {{"package": {{"name": "quiet"}}, "vulnerabilities": []}}]}}]}}'"""
    return f"""reports AS MATERIALIZED (
  SELECT p_partkey AS report_id, p_partkey % {t} AS target_id, engine, {root} AS root,
    CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN substr(text, 1, 60) ELSE text END AS raw
  FROM (SELECT *, 'gitleaks' AS engine, {gitleaks} AS text FROM part UNION ALL SELECT *, 'semgrep', {semgrep} FROM part
    UNION ALL SELECT *, 'osv-scanner', {osv} FROM part) z)"""


def items(engine: str) -> str:
    """Entries of the valid reports: ``target_id, root, report_id, pos, r``."""
    path = "$[*]" if engine == "gitleaks" else "$.results[*]"
    return f"""(SELECT target_id, root, report_id, unnest(json_extract(raw, '{path}')) AS r,
      generate_subscripts(json_extract(raw, '{path}'), 1) - 1 AS pos
    FROM reports WHERE engine = '{engine}' AND raw IS NOT NULL AND json_valid(raw))"""


def js(col: str, path: str) -> str:
    return f"json_extract_string({col}, '$.{path}')"


def relative(root: str, path: str) -> str:
    return f"CASE WHEN starts_with({path}, {root} || '/') THEN substr({path}, length({root}) + 2) ELSE {path} END"


def emit_order(pkg: str = "0") -> str:
    return f"report_id, pos, {pkg}"


# ---- finding stream ---------------------------------------------------------

FINDING_EVENTS = (
    values("erules", "event_type, rule_id, category, severity, confidence", corpus.EVENT_RULES)
    + ", fe AS (SELECT event_id, ts, user_id AS target_id, rule_id, category, severity, confidence, 'f' || (event_id % 7) AS file, "
    "(event_id % 3)::INTEGER AS line, NULL::VARCHAR AS url, CASE WHEN e.event_type = 'error' THEN 'gitleaks' ELSE 'native' END AS source "
    "FROM events e JOIN erules r ON e.event_type = r.event_type)"
)
RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 END"


def path_class(col: str) -> str:
    q = f"replace({col}, chr(92), '/')"
    arms = [
        ("example", (p.PATH_EXAMPLE,)), ("test", (p.PATH_TEST,)), ("docs", p.PATH_DOCS), ("credential", (p.PATH_CREDENTIAL,)),
        ("content", (p.PATH_CONTENT,)), ("build", (p.PATH_BUILD,)), ("config", p.PATH_CONFIG), ("source", (p.PATH_SOURCE,)),
    ]
    body = " ".join(f"WHEN {m(q, *ps)} THEN '{name}'" for name, ps in arms)
    return f"CASE WHEN coalesce({col}, '') = '' THEN 'unknown' {body} ELSE 'unknown' END"


def contextualized(src: str) -> str:
    """Completed rows after the path-context step; adds ``note_class``."""
    cats = ", ".join(lit(c) for c in lists.CONTENT_DOWNGRADED)
    note = (
        f"CASE WHEN cls IN ('docs', 'example', 'test', 'build') OR (cls = 'content' AND (category IN ({cats}) OR "
        "(category = 'secrets' AND source <> 'native'))) THEN cls END"
    )
    return f"""(SELECT * EXCLUDE (cls) REPLACE (
      CASE WHEN note_class IS NOT NULL AND severity IN ('critical', 'high', 'medium') THEN 'low' ELSE severity END AS severity,
      CASE WHEN note_class IS NOT NULL THEN 'low' ELSE confidence END AS confidence)
    FROM (SELECT *, {note} AS note_class FROM (SELECT *, {path_class('file')} AS cls FROM {src} a) b) c)"""


def suppressed(src: str) -> str:
    """Completed rows after suppression (public secrets never become hits)."""
    text = "concat_ws(' ', coalesce(file, ''), coalesce(url, ''), coalesce(evidence, ''))"
    return f"""(SELECT * REPLACE (CASE WHEN rule_id = 'WEB_CONFIG_CORS_WILDCARD_CREDENTIALS' AND {m(text, p.PUBLIC_API)}
      THEN 'low' ELSE confidence END AS confidence)
    FROM {src} s WHERE NOT ({m('rule_id', p.RATE_LIMIT_RULE)} AND {m(text, p.STATIC_ASSET)}))"""


NOTE = (
    "coalesce(CASE note_class "
    + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in lists.CONTEXT_NOTES.items())
    + " END, '')"
)
DEDUPE_KEY = "concat_ws('|', rule_id, coalesce(file, ''), coalesce(line::VARCHAR, ''), coalesce(url, ''))"
IDENTITY = (
    "CASE WHEN category = 'secrets' AND coalesce(file, '') <> '' THEN concat_ws('|', 'secret', file, coalesce(line::VARCHAR, '')) END"
)


def dep_package(text: str) -> str:
    return f"nullif(lower(regexp_extract({text}, {rx(p.DEP_PACKAGE)}, 1)), '')"


def reconciled(src: str) -> str:
    """Completed rows without native dependency findings an engine restates."""
    title = f"(SELECT {fill('title_t')} FROM variants v WHERE v.variant = d.variant)"
    text = f"coalesce(url, '') || ' ' || coalesce(evidence, '') || ' ' || coalesce({title}, '')"
    return f"""(WITH d AS MATERIALIZED (SELECT *, CASE WHEN category = 'dependencies' THEN {dep_package(text)} END AS pkg FROM {src} d)
    SELECT * EXCLUDE (pkg) FROM d WHERE NOT (category = 'dependencies' AND source <> 'osv-scanner' AND pkg IS NOT NULL AND EXISTS (
      SELECT 1 FROM d e WHERE e.source = 'osv-scanner' AND e.target_id = d.target_id AND e.pkg = d.pkg)))"""


def deduped(src: str) -> str:
    order = "phase, rule_ord, file NULLS FIRST, emit_ord, rule_id, variant"
    return f"""(SELECT * FROM {src} s QUALIFY row_number() OVER (
      PARTITION BY target_id, coalesce({IDENTITY}, {DEDUPE_KEY}) ORDER BY {order}) = 1)"""


def penalty() -> str:
    w = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in lists.SEVERITY_WEIGHT.items())
    c = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in lists.CONFIDENCE_PERCENT.items())
    return f"(CASE severity {w} END * CASE confidence {c} END)"


def graded(src: str, targets: str | None = None) -> str:
    """Counts, score and grade per target of ``src``."""
    counts = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in lists.SEVERITIES)
    rows = f"""(SELECT target_id, {counts}, sum({penalty()}) AS pen,
      count(*) FILTER (severity = 'critical' AND confidence <> 'low') AS confirmed FROM {src} s GROUP BY target_id)"""
    if targets:
        cells = ", ".join(f"coalesce({s}, 0) AS {s}" for s in lists.SEVERITIES)
        rows = f"(SELECT t.target_id, {cells}, coalesce(pen, 0) AS pen, coalesce(confirmed, 0) AS confirmed FROM {targets} t LEFT JOIN {rows} r ON t.target_id = r.target_id)"
    letter = "CASE " + " ".join(f"WHEN score >= {f} THEN '{g}'" for g, f in lists.GRADE_FLOORS) + " ELSE 'F' END"
    cells = ", ".join(f"{s}::INTEGER AS {s}" for s in lists.SEVERITIES)
    return f"""(SELECT target_id, {cells}, score, CASE WHEN confirmed > 0 AND {letter} IN ('A', 'B', 'C') THEN 'D' ELSE {letter} END AS grade
    FROM (SELECT *, greatest(0, floor((10050 - pen) / 100.0))::INTEGER AS score FROM {rows} a) b)"""

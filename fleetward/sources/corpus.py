"""Working tables derived from the given test tables.

Each one covers its whole base table.  Lookups joined in are fixed-size constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import lookup
from .http import normalize_headers
from .snippets import ANON_TOKEN, EXAMPLE_CONN, LIVE_KEY, PUBLIC_KEY, SNIPPETS

TARGETS = 125
URL_TARGET_BASE = 1_000_000_000  # url targets follow the repository targets

# ord, name, value, divisor, modulus, remainders: present iff floor(page/div) % mod in remainders
HEADER_RULES = (
    (0, "Content-Security-Policy", "default-src 'self'", 1, 2, 1, 1),
    (1, "Strict-Transport-Security", "max-age=1", 2, 2, 1, 1),
    (2, "X-Frame-Options", "DENY", 4, 2, 1, 1),
    (3, "x-content-type-options", "nosniff", 8, 2, 1, 1),
    (4, "Referrer-Policy", "no-referrer", 16, 2, 1, 1),
    (5, "Permissions-Policy", "geolocation=()", 32, 2, 1, 1),
    (6, "Set-Cookie", "session_id=abc; Path=/; HttpOnly", 1, 5, 0, 1),
    (7, "set-cookie", "auth_token=x; Secure; HttpOnly", 1, 5, 1, 2),
    (8, "SET-COOKIE", "theme=dark", 1, 5, 3, 3),
    (9, "Set-Cookie", "sid=1; secure", 1, 5, 1, 4),
)
MAX_SCRIPTS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a core reads on its own; tables below are dealt over all cores.
_SHARE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small stored table over all cores: one row group is one task.  A large one is read as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if n_bytes < cores * _SHARE else df


def _div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("bigint")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as the prose of source files, one snippet appended to each."""
    k = len(SNIPPETS)
    snippets = lookup(
        spark,
        [(i, s.path, s.root, s.pure, s.text) for i, s in enumerate(SNIPPETS)],
        "kind bigint, spath string, root boolean, pure boolean, snippet string",
    )
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        (F.col("doc_id") % TARGETS).alias("target_id"),
        _div(F.col("doc_id"), TARGETS).alias("cycle"),
    )
    docs = docs.withColumn("kind", (F.col("cycle") + F.col("target_id") * 5) % k)
    body = F.replace("snippet", F.lit("@V@"), (F.col("doc_id") % 6 + 10).cast("string"))
    # JSON files carry the prose in a string; where its length allows, the file breaks off after it
    described = F.concat(F.lit('{"description": "'), F.regexp_replace("text", r'["\\\x00-\x1f]', " "))
    whole = F.when(F.length("text") % 11 == 0, described).otherwise(F.concat(described, F.lit('", '), F.substring(body, F.lit(2), F.length(body))))
    prefixed = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("/"), F.col("spath"))
    return docs.join(F.broadcast(snippets), "kind").select(
        "target_id",
        F.when(F.col("root") & (F.col("cycle") < k), F.col("spath")).otherwise(prefixed).alias("path"),
        F.when(F.col("pure"), whole).otherwise(F.concat("text", F.lit("\n"), body)).alias("content"),
    )


def repo_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select((F.col("doc_id") % TARGETS).alias("target_id")).distinct()
    return ids.select(
        "target_id", F.lit("repo").alias("type"), F.concat(F.lit("/repo/t"), F.col("target_id").cast("string")).alias("value")
    )


def url_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        (F.col("page_id") + URL_TARGET_BASE).alias("target_id"), F.lit("url").alias("type"), F.col("url").alias("value")
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_targets(spark, sf_dir).unionByName(url_targets(spark, sf_dir))


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declared dependency per order line; the operator in front varies."""
    operator = F.element_at(F.array(*[F.lit(x) for x in ("^", "~", ">=", "", "v")]), F.col("l_linenumber") % 5 + 1)
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("target_id"),
        F.lit("package.json").alias("manifest_path"),
        F.concat(F.lit("pkg"), F.col("l_partkey").cast("string")).alias("pkg"),
        F.concat(
            operator,
            F.concat_ws(
                ".",
                (F.col("l_quantity").cast("int") % 16).cast("string"),
                F.col("l_linenumber").cast("string"),
                (F.col("l_suppkey") % 30).cast("string"),
            ),
        ).alias("declared"),
    )


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two advisories per part, the first with two ranges."""
    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("pkg"), F.col("p_partkey").cast("string")).alias("pkg"),
        F.col("p_partkey").cast("string").alias("k"),
        (F.col("p_size") % 14).alias("major"),
    )
    severity = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), F.col("major") % 4 + 1)

    def version(major, rest):
        return F.concat(major.cast("string"), F.lit(rest))

    ranges = F.array(
        F.struct(F.lit("A").alias("s"), version(F.col("major"), ".0.0").alias("lo"), version(F.col("major") + 1, ".2.3").alias("fixed")),
        F.struct(F.lit("A").alias("s"), version((F.col("major") + 7) % 14, ".1.0").alias("lo"), version((F.col("major") + 7) % 14, ".4.9").alias("fixed")),
        F.struct(F.lit("B").alias("s"), version(F.col("major"), ".3.0").alias("lo"), version(F.col("major") + 3, ".0.0").alias("fixed")),
    )
    return part.select("pkg", "k", severity.alias("severity"), F.inline(ranges)).select(
        "pkg",
        F.concat(F.lit("ADV-"), F.col("k"), F.lit("-"), F.col("s")).alias("id"),
        "severity",
        "lo",
        "fixed",
        F.concat(F.lit("Flaw "), F.col("s"), F.lit(" in "), F.col("pkg"), F.lit(".")).alias("summary"),
    )


# ---- crawled pages ----------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    origin = F.regexp_extract(url, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(url, "[?#].*", ""), "^(https?://[^/]+/(?:[^/]*/)*)", 1)
    return (
        table(spark, sf_dir, "pages")
        .where(F.coalesce("html", F.lit("")) != "")  # a page without a body was not reached
        .select(
            "page_id",
            (F.col("page_id") + URL_TARGET_BASE).alias("target_id"),
            "url",
            "html",
            origin.alias("origin"),
            folder.alias("folder"),
            F.regexp_extract(origin, "^(https?:)", 1).alias("scheme"),
        )
    )


def _numbers() -> Column:
    n = (F.col("page_id") % MAX_SCRIPTS).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def raw_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = lookup(
        spark, HEADER_RULES, "ord int, name string, value string, div int, mod int, r1 int, r2 int"
    )
    bit = F.floor(F.col("page_id") / F.col("div")) % F.col("mod")
    return (
        _pages(spark, sf_dir)
        .crossJoin(F.broadcast(rules))
        .where((bit == F.col("r1")) | (bit == F.col("r2")))
        .select("target_id", "url", "ord", "name", "value")
    )


def _script_ref(i: Column) -> Column:
    s = i.cast("string")
    return (
        F.when(i % 5 == 0, F.concat(F.lit("/static/app"), s, F.lit(".js")))
        .when(i % 5 == 1, F.concat(F.lit("chunk"), s, F.lit(".mjs?v=2")))
        .when(i % 5 == 2, F.concat(F.lit("//cdn.example.net/lib"), s, F.lit(".js")))
        .when(i % 5 == 3, F.concat(F.lit("https://cdn.example.org/x"), s, F.lit(".js")))
        .otherwise(F.concat(F.lit("./rel/"), (i % 2).cast("string"), F.lit(".css")))
    )


def _script_url(i: Column) -> Column:
    s = i.cast("string")
    return (
        F.when(i % 5 == 0, F.concat("origin", F.lit("/static/app"), s, F.lit(".js")))
        .when(i % 5 == 1, F.concat("folder", F.lit("chunk"), s, F.lit(".mjs?v=2")))
        .when(i % 5 == 2, F.concat("scheme", F.lit("//cdn.example.net/lib"), s, F.lit(".js")))
        .when(i % 5 == 3, F.concat(F.lit("https://cdn.example.org/x"), s, F.lit(".js")))
        .otherwise(F.concat("folder", F.lit("rel/"), (i % 2).cast("string"), F.lit(".css")))
    )


def _db_url() -> Column:
    return F.concat(F.lit("https://"), F.lpad(F.col("page_id").cast("string"), 20, "a"), F.lit(".supabase.co"))


def homepages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachable homepages with script tags added to the page."""
    tags = F.array_join(
        F.transform(
            _numbers(),
            lambda i: F.when(
                i % 2 == 0, F.concat(F.lit('<script defer src="'), _script_ref(i), F.lit('"></script>'))
            ).otherwise(F.concat(F.lit("<SCRIPT src = '"), _script_ref(i), F.lit("'></SCRIPT>"))),
        ),
        "\n",
    )
    key = F.when(
        F.col("page_id") % 10 == 3, F.concat(F.lit('<script>var c = { apiKey: "AIza'), F.lpad(F.col("page_id").cast("string"), 35, "k"), F.lit('" };</script>'))
    ).otherwise("")
    pages = _pages(spark, sf_dir).select(
        "target_id",
        "url",
        F.lit(200).alias("status"),
        F.concat("html", F.lit("\n<!-- <script src='/old.js'></script> -->\n"), tags, key).alias("body"),
    )
    headers = normalize_headers(raw_headers(spark, sf_dir))
    empty = F.create_map().cast("map<string,string>")
    return pages.join(headers, ["target_id", "url"], "left").withColumn("headers", F.coalesce("headers", empty))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched scripts: status by page and position, configuration in some bodies."""
    i = F.col("i")
    config = (
        F.when((F.col("page_id") % 3 == 0) & (i == 1), F.concat(F.lit(' var u="'), _db_url(), F.lit('";')))
        .when((F.col("page_id") % 6 == 0) & (i == 2), F.concat(F.lit(' k="sb_publishable_'), F.lpad(F.col("page_id").cast("string"), 16, "K"), F.lit('"')))
        .when((F.col("page_id") % 4 < 3) & (i == 3), F.lit(f' t="{ANON_TOKEN}"'))
        .when((F.col("page_id") % 9 == 5) & (i == 0), F.lit(f' s="{LIVE_KEY}"'))
        .when((F.col("page_id") % 5 == 0) & (i == 5), F.concat(F.lit(' var f={"apiKey":"AIza'), F.lpad(F.col("page_id").cast("string"), 35, "z"), F.lit('"}')))
        .otherwise("")
    )
    return (
        _pages(spark, sf_dir)
        .select("*", F.explode(F.filter(_numbers(), lambda n: (n % 5 != 4) | (n < 10))).alias("i"))
        .select(
            "target_id",
            _script_url(i).alias("url"),
            F.when((F.col("page_id") + i) % 7 == 0, 404).otherwise(200).alias("status"),
            F.when((F.col("page_id") + i) % 13 == 0, "").otherwise(F.concat(F.lit("bundle "), i.cast("string"), config)).alias("body"),
        )
    )


def probe_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to table, dotfile and source-map probes; some probes have no answer."""
    from ..catalog import lists

    words = lookup(spark, list(enumerate(lists.PROBED_TABLES)), "o int, w string")
    dots = lookup(spark, list(enumerate(lists.PROBED_DOTFILES)), "o int, w string")
    page = F.col("page_id")
    pages = _pages(spark, sf_dir)
    r = (page * 7 + F.col("o")) % 6
    tables = (
        pages.crossJoin(F.broadcast(words))
        .where(r != 5)
        .select(
            "target_id",
            F.concat(_db_url(), F.lit("/rest/v1/"), "w", F.lit("?select=*&limit=1")).alias("url"),
            F.when((r == 4) | ((r == 0) & (page % 2 == 1)), 401).otherwise(200).alias("status"),
            F.when(r == 0, '[{"id": 1, "email": "x"}]')
            .when(r == 1, "[]")
            .when(r == 2, "<!doctype html><html></html>")
            .when(r == 3, '{"message": "no"}')
            .otherwise("denied")
            .alias("body"),
        )
    )
    q = (page + F.col("o") * 3) % 7
    dotfiles = (
        pages.crossJoin(F.broadcast(dots))
        .where(q != 6)
        .select(
            "target_id",
            F.concat("origin", "w").alias("url"),
            F.when(q == 5, 404).otherwise(200).alias("status"),
            F.when(q == 0, f"STRIPE_KEY={LIVE_KEY}\nB=1")
            .when(q == 1, "<!doctype html><html></html>")
            .when(q == 2, "[core]\n\tbare = false")
            .when(q == 3, f"# env\nPUBLIC={PUBLIC_KEY}\nDB={EXAMPLE_CONN}")
            .otherwise("not found")
            .alias("body"),
        )
    )
    m = (page * 3 + F.col("i")) % 11
    maps = (
        pages.select("*", F.explode(_numbers()).alias("i"))
        .where((F.col("i") % 5 != 4) & (m < 9))
        .select(
            "target_id",
            F.concat(F.regexp_replace(_script_url(F.col("i")), r"\?.*", ""), F.lit(".map")).alias("url"),
            F.when(m == 8, 404).otherwise(200).alias("status"),
            F.when((m == 0) & (page % 4 != 1), '{"version": 3, "sources": ["../src/app.tsx"], "mappings": "AAAA"}')
            .when(m == 1, '{"version": 2, "sources": []}')
            .otherwise("<!doctype html><html></html>")
            .alias("body"),
        )
    )
    return tables.unionByName(dotfiles).unionByName(maps)


# ---- engine reports ---------------------------------------------------------


def _json(*pieces) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in pieces])


def engine_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per part; some are NULL or cut off."""
    k = F.col("p_partkey")
    # a few bytes of a part become three reports
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        "p_partkey", "p_size", (k % TARGETS).alias("target_id"), F.concat(F.lit("/repo/t"), (k % TARGETS).cast("string")).alias("root")
    )
    secret = (
        F.when(k % 5 == 0, F.lit(LIVE_KEY))
        .when(k % 5 == 1, F.lit(PUBLIC_KEY))
        .when(k % 5 == 2, _json("0badc0de0badc0de", k))
        .when(k % 5 == 3, F.lit(EXAMPLE_CONN))
        .otherwise("")
    )
    commit = F.when(k % 3 == 0, ', "Commit": "abc123"').otherwise("")
    gitleaks = _json(
        '[{"RuleID": "generic-api-key", "Description": "Generic key", "Secret": "', secret, '", "Match": "key = x", "File": "',
        F.col("root"), "/src/f", k % 40, '.ts", "StartLine": ', F.col("p_size"), commit,
        '}, {"RuleID": "db-url", "Match": "0badc0de0badc0de', k, '", "File": "', F.col("root"), "/docs/n", k % 7, '.md", "StartLine": 3}]',
    )
    severity = F.element_at(F.array(*[F.lit(x) for x in ("ERROR", "WARNING", "INFO", "OTHER")]), (k % 4 + 1).cast("int"))
    semgrep = _json(
        '{"results": [{"check_id": "pack.rules.check-', k % 9, '", "path": "', F.col("root"), "/lib/s", k % 30,
        '.js", "start": {"line": ', F.col("p_size"), '}, "extra": {"severity": "', severity, '", "message": "Dangerous pattern ', k % 9,
        '"}}, {"path": "', F.col("root"), "/examples/e", k % 5, '.js", "start": {"line": 1}}]}',
    )
    label = F.element_at(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MODERATE", "LOW")]), (k % 4 + 1).cast("int"))
    extra = F.when(
        k % 3 == 0,
        _json(', {"id": "GHSA-b', k, '", "severity": [{"type": "CVSS_V3"}], "affected": [{"package": {"name": "other"}, "ranges": [{"events": [{"fixed": "99.0.0"}]}]}]}'),
    ).when(
        k % 3 == 1,
        _json(', {"id": "GHSA-0', k, '", "affected": [{"database_specific": {"severity": "low"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "',
              k % 4 + 2, '.0.1"}]}]}]}, {"id": "GHSA-z', k, '"}'),
    ).otherwise("")
    name = F.when(k % 50 == 0, F.lit("next")).otherwise(_json("pkg", k))
    osv = _json(
        '{"results": [{"packages": [{"package": {"name": "', name, '", "version": "', k % 3 + 1, ".", F.col("p_size"),
        '.0"}, "vulnerabilities": [{"id": "GHSA-m', k, '", "database_specific": {"severity": "', label,
        '"}, "affected": [{"package": {"name": "', name, '"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "',
        k % 4 + 1, ".", F.col("p_size"), '.2"}]}]}]}', extra, ']}, {"package": {"name": "quiet"}, "vulnerabilities": []}]}]}',
    )
    # a branch per engine: a filter on the engine leaves one of them, and no text of the others is made
    reports = None
    for engine, text in (("gitleaks", gitleaks), ("semgrep", semgrep), ("osv-scanner", osv)):
        rows = part.select("p_partkey", "target_id", "root", F.inline(F.array(F.struct(text.alias("text"))))).select(
            F.col("p_partkey").alias("report_id"), "target_id", F.lit(engine).alias("engine"), "root",
            F.when(k % 17 == 0, F.lit(None)).when(k % 13 == 0, F.substring("text", 1, 60)).otherwise(F.col("text")).cast("string").alias("raw"),
        )
        reports = rows if reports is None else reports.unionByName(rows)
    return reports


# ---- finding stream ---------------------------------------------------------

# event type, rule, category, severity, confidence
EVENT_RULES = (
    ("view", "AUTH_MISSING_CHECK", "auth", "high", "low"),
    ("click", "INJECTION_XSS", "injection", "high", "high"),
    ("purchase", "SECRETS_STRIPE_SECRET_KEY", "secrets", "critical", "high"),
    ("signup", "WEB_CONFIG_WEAK_COOKIE", "web_config", "medium", "medium"),
    ("error", "GITLEAKS_GENERIC", "secrets", "info", "medium"),
)


def finding_events(events: DataFrame) -> DataFrame:
    """``events`` (batch or stream) as finding events."""
    rules = lookup(
        events.sparkSession, EVENT_RULES,
        "event_type string, rule_id string, category string, severity string, confidence string",
    )
    return events.join(F.broadcast(rules), "event_type").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("target_id"),
        "rule_id",
        "category",
        "severity",
        "confidence",
        F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("file"),
        (F.col("event_id") % 3).cast("int").alias("line"),
        F.lit(None).cast("string").alias("url"),
        F.when(F.col("event_type") == "error", "gitleaks").otherwise("native").alias("source"),
    )

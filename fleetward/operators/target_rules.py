"""White-box rules that need more than one file of a target.

Files first shrink to *facts*: short rows about one file (a table it creates, a
provider it verifies, what a configuration file lacks).  The rules then join and
aggregate facts, so file contents never cross a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import lists, patterns as p
from ..functions import paths
from ..functions.identity import advisory_rule_id
from ..functions.text import MATCH_TYPE, all_of, group, has_any, matches, scan
from ..functions.version import format_version, in_range, parse_version, version_literal
from ..plans.staging import materialize, shuffled
from ..schema import PASS_COLUMNS, hit, lookup, one_hit
from .file_rules import FileColumns, columns, file_columns

FACT_TYPE = "struct<kind:string,path:string,name:string,line:int,ord:int,flag:boolean,other:boolean,text:string>"


@dataclass(frozen=True)
class FactRule:
    kind: str
    applies: Callable[[Column], Column]
    facts: Callable[[FileColumns], Column]


def _fact(kind: str, f: FileColumns, *, name=None, line=None, ord=None, flag=None, other=None, text=None) -> Column:
    null = F.lit(None)

    def col(c, t):
        return (null if c is None else c).cast(t)

    return F.struct(
        F.lit(kind).alias("kind"),
        f.path.alias("path"),
        col(name, "string").alias("name"),
        col(line, "int").alias("line"),
        col(ord, "int").alias("ord"),
        col(flag, "boolean").alias("flag"),
        col(other, "boolean").alias("other"),
        col(text, "string").alias("text"),
    ).cast(FACT_TYPE)


def no_facts() -> Column:
    return F.array().cast(f"array<{FACT_TYPE}>")


def _one(cond: Column, fact: Column) -> Column:
    return F.when(cond, F.array(fact)).otherwise(no_facts())


def _names(kind: str, word: str, pattern) -> Callable[[FileColumns], Column]:
    def facts(f: FileColumns) -> Column:
        found = F.when(f.lower.contains(word), scan(f.content, pattern)).otherwise(F.array().cast(MATCH_TYPE))
        return F.transform(
            found,
            lambda m: _fact(kind, f, name=F.lower(group(m["match"], pattern, 1)), line=m["line"], ord=m["ord"]),
        )

    return facts


def _hosted_db(f: FileColumns) -> Column:
    by_sql = paths.is_sql(f.path) & matches(F.coalesce(f.content, F.lit("")), p.HOSTED_DB_SQL)
    return _one(matches(f.path, p.HOSTED_DB_PATH) | by_sql, _fact("hosted_db", f))


def _env_values(f: FileColumns) -> Column:
    return _one(matches(f.content, p.ENV_ASSIGNMENT), _fact("env_values", f))


def _gitignore(f: FileColumns) -> Column:
    return _one(matches(f.content, (p.GITIGNORE_ENV_LINE, p.GITIGNORE_ENV_PREFIX)), _fact("gitignore_env", f))


def _verified(f: FileColumns) -> Column:
    stripe = matches(f.content, p.STRIPE_VERIFY)
    hmac = all_of(
        f.content.contains("createHmac"),
        matches(f.content, p.HMAC_CREATE),
        matches(f.content, p.HMAC_COMPARE),
        matches(f.content, p.HMAC_CONTEXT),
    )
    verified = has_any(f.content, "constructEvent", "createHmac") & (stripe | hmac)
    return _one(verified, _fact("verified", f, flag=stripe, other=hmac))


def _webhook(f: FileColumns) -> Column:
    text_says = f.lower.contains("webhook")
    stripe = f.lower.contains("stripe")
    github = matches(f.content, p.GITHUB_TEXT) & text_says
    return _one(
        all_of(
            matches(f.path, p.WEBHOOK_PATH) | text_says,
            stripe | github,
            paths.is_server_route(f.path, f.content),
            paths.is_body_handler(f.content),
        ),
        _fact("webhook", f, flag=stripe, other=github),
    )


def _framework_config(f: FileColumns) -> Column:
    content = F.coalesce(f.content, F.lit(""))
    low = F.lower(content)
    names = F.filter(
        F.array(*[F.lit(h) for h, *_ in lists.REQUIRED_HEADERS]), lambda h: low.contains(h)
    )
    lacking = ~matches(content, p.HEADERS_FUNCTION) | (F.size(names) < 2)
    evidence = F.when(
        F.size(names) > 0, F.concat(F.lit("only found: "), F.array_join(names, ", "))
    ).otherwise("no security headers configured")
    sets_headers = matches(content, p.HEADERS_CALL) & matches(content, p.HEADERS_STRONG)
    return F.array(
        _fact(
            "config", f, flag=matches(content, p.IMAGE_WILDCARD), other=sets_headers,
            text=F.when(lacking, evidence),
        )
    )


def _manifest(f: FileColumns) -> Column:
    return F.array(_fact("manifest", f, text=f.content))


FACT_RULES: tuple[FactRule, ...] = (
    FactRule("sql_created", paths.is_sql, _names("sql_created", "create", p.CREATE_TABLE)),
    FactRule("sql_rls", paths.is_sql, _names("sql_rls", "row", p.ENABLE_RLS)),
    FactRule("hosted_db", lambda c: paths.is_sql(c) | matches(c, p.HOSTED_DB_PATH), _hosted_db),
    FactRule("env_values", lambda c: paths.is_env(c) & ~matches(c, p.ENV_TEMPLATE), _env_values),
    FactRule("gitignore_env", lambda c: c == ".gitignore", _gitignore),
    FactRule("verified", paths.is_source, _verified),
    FactRule("webhook", paths.is_source, _webhook),
    FactRule("config", paths.is_framework_config, _framework_config),
    FactRule("manifest", paths.is_manifest, _manifest),
)


def facts_column(kinds: Sequence[str]) -> Column:
    c = columns()
    arrays = [
        F.when(r.applies(c.path), F.coalesce(r.facts(c), no_facts())).otherwise(no_facts())
        for r in FACT_RULES
        if r.kind in kinds
    ]
    return F.flatten(F.array(*arrays)) if len(arrays) > 1 else arrays[0]


def facts_of(files: DataFrame, *kinds: str) -> DataFrame:
    """Facts of the given kinds straight from ``files``; only matching paths are read on."""
    applies = F.lit(False)
    for r in FACT_RULES:
        if r.kind in kinds:
            applies = applies | r.applies(F.col("path"))
    prepared = file_columns(files.where(applies), False)
    return prepared.select("target_id", F.inline(facts_column(kinds)))


def _kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind)


# ---- committed environment files --------------------------------------------


def committed_env(facts: DataFrame) -> DataFrame:
    ignored = _kind(facts, "gitignore_env").select("target_id").distinct().withColumn("ignored", F.lit(True))
    env = _kind(facts, "env_values").select("target_id", "path")

    def as_hit(variant: str) -> Column:
        return hit(variant, file=F.col("path"))

    return one_hit(
        env.join(shuffled(ignored), "target_id", "left"),
        F.when(F.col("ignored"), as_hit("env_ignored")).otherwise(as_hit("env_not_ignored")),
    )


# ---- row security -----------------------------------------------------------


def tables_created(facts: DataFrame) -> DataFrame:
    return _kind(facts, "sql_created").select(
        "target_id", F.col("name").alias("table_name"), F.col("path").alias("file"), "line", "ord"
    )


def tables_secured(facts: DataFrame) -> DataFrame:
    return _kind(facts, "sql_rls").select("target_id", F.col("name").alias("table_name")).distinct()


def tables_missing(facts: DataFrame) -> DataFrame:
    """First creation of every table that is never secured.

    Both sides are keyed by (target, table) and pre-aggregated, so a target with
    very many tables spreads over all partitions.
    """
    first = (
        tables_created(facts)
        .groupBy("target_id", "table_name")
        .agg(F.min(F.struct("file", "ord", "line")).alias("at"))
        .select("target_id", "table_name", "at.file", "at.line", "at.ord")
    )
    return first.join(shuffled(tables_secured(facts)), ["target_id", "table_name"], "left_anti")


def looks_hosted(facts: DataFrame, deps: DataFrame) -> DataFrame:
    """Targets whose tables a public API would expose."""
    by_dep = deps.where(F.startswith(F.col("pkg"), F.lit("@supabase/")) | (F.col("pkg") == "supabase"))
    return _kind(facts, "hosted_db").select("target_id").unionByName(by_dep.select("target_id")).distinct()


def rls_disabled(facts: DataFrame, deps: DataFrame) -> DataFrame:
    """One grouped finding per target.  Its text lists the table names, so the list
    is part of the result row; only the distinct names of a target are gathered."""
    t = F.transform("tables", lambda x: x["table_name"])
    quoted = F.array_join(F.transform(t, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ", ")
    first = F.get("tables", F.lit(0))
    grouped = (
        tables_missing(facts)
        .join(shuffled(looks_hosted(facts, deps)), "target_id", "left_semi")
        .groupBy("target_id")
        .agg(F.array_sort(F.collect_list(F.struct("file", "ord", "line", "table_name"))).alias("tables"))
    )
    one = hit(
        "rls_disabled_one", file=first["file"], line=first["line"],
        params=[first["table_name"]], ord=(2, 0),
    )
    many = hit(
        "rls_disabled_many", evidence=F.array_join(t, ", "), file=first["file"],
        line=first["line"], params=[first["table_name"], F.size("tables").cast("string"), quoted], ord=(2, 0),
    )
    return one_hit(grouped, F.when(F.size("tables") == 1, one).otherwise(many))


# ---- webhooks ---------------------------------------------------------------


def verified_flags(facts: DataFrame) -> DataFrame:
    return (
        _kind(facts, "verified")
        .groupBy("target_id")
        .agg(F.bool_or("flag").alias("stripe_ok"), F.bool_or("other").alias("github_ok"))
    )


def webhook_unverified(facts: DataFrame) -> DataFrame:
    """Handlers of a provider that no file of the target verifies; one per file."""
    handlers = _kind(facts, "webhook").select(
        "target_id", "path", F.col("flag").alias("stripe"), F.col("other").alias("github")
    )
    joined = handlers.join(shuffled(verified_flags(facts)), "target_id", "left")
    stripe = F.col("stripe") & ~F.coalesce("stripe_ok", F.lit(False))
    github = F.col("github") & ~F.coalesce("github_ok", F.lit(False))

    def as_hit(variant: str) -> Column:
        return hit(variant, file=F.col("path"))

    return one_hit(
        joined.where(stripe | github),
        F.when(stripe, as_hit("webhook_stripe")).otherwise(as_hit("webhook_github")),
    )


# ---- framework configuration ------------------------------------------------


def picked_config(facts: DataFrame) -> DataFrame:
    """The first framework configuration file of each target by path."""
    return (
        _kind(facts, "config")
        .groupBy("target_id")
        .agg(F.min(F.struct("path", "flag", "other", "text")).alias("c"))
        .select("target_id", "c.*")
    )


def image_wildcard(facts: DataFrame) -> DataFrame:
    return one_hit(
        picked_config(facts).where("flag"),
        hit(
            "image_wildcard",
            evidence=F.lit('images.remotePatterns hostname "**" (or domains: ["*"])'), file=F.col("path"),
            ord=F.lit(2),
        ),
    )


def config_headers(facts: DataFrame) -> DataFrame:
    return one_hit(
        picked_config(facts).where(F.col("text").isNotNull()),
        hit("config_headers", evidence=F.col("text"), file=F.col("path"), ord=F.lit(3)),
    )


# ---- dependencies -----------------------------------------------------------


def middleware_cve(deps: DataFrame) -> DataFrame:
    """The declared framework version against three fixed ranges, without a join."""
    parsed = deps.where(F.col("pkg") == lists.MIDDLEWARE_PACKAGE).withColumn("v", parse_version(F.col("declared")))
    affected = F.lit(False)
    for lo, fixed in lists.MIDDLEWARE_RANGES:
        affected = affected | in_range(F.col("v"), version_literal(lo), version_literal(fixed))
    return one_hit(
        parsed.where(affected),
        hit(
            "middleware_bypass", evidence=F.concat(F.lit("next@"), "declared"),
            file=F.col("manifest_path"), params=[format_version(F.col("v"))],
        ),
    )


def advisory_floor(spark) -> DataFrame:
    """The fixed list of confirmed advisories, one row per range."""
    return lookup(
        spark,
        lists.ADVISORY_FLOOR,
        "pkg string, id string, severity string, lo string, fixed string, summary string",
    )


#: Most advisories that are broadcast; beyond it, parts that the declarations of a package with more than ``HOT`` are dealt over.
BROADCAST_ROWS, SALT, HOT = 100_000, 16, 1_000_000
#: Ranges of a package up to which each of its declarations is compared with all of them; beyond, versions are looked up.
WIDE = 64


def match_advisories(deps: DataFrame, advisories: DataFrame, few: bool = False) -> DataFrame:
    """``deps`` inside any range of an advisory, once per (dependency, advisory).

    Dependencies are read once and their versions parsed in place.  The ranges of an advisory are gathered into one row
    first, so that no grouping follows the join.  Up to ``BROADCAST_ROWS`` advisories are counted and broadcast; beyond,
    both sides are shuffled, and a package of more than ``HOT`` declarations is dealt over ``SALT`` keys, each with its
    own copy of the package's advisories.  Packages of more than ``WIDE`` ranges have an index of their own
    (``search_versions``), so that the work follows the findings, not the declarations times the advisories.  ``few`` says
    that the advisories are a constant of this package.
    """
    ranges = F.struct(
        parse_version(F.col("lo")).alias("lo_v"), parse_version(F.col("fixed")).alias("fixed_v"), "severity", "summary"
    )
    gathered = advisories.groupBy("pkg", "id").agg(F.collect_list(ranges).alias("ranges"))
    parsed = deps.withColumn("v", parse_version(F.col("declared"))).where(F.col("v").isNotNull())
    looked_up = hot = None
    if not few:
        gathered = materialize(gathered, "advisories")
        sizes = gathered.groupBy("pkg").agg(F.sum(F.size("ranges")).alias("n"))
        wide = materialize(sizes.where(F.col("n") > WIDE).select("pkg"), "wide-packages")
        if not wide.isEmpty():
            hot = _hot(deps)
            looked_up = _looked_up(parsed, hot, gathered.join(shuffled(wide), "pkg", "left_semi"), deps.columns)
            gathered = materialize(gathered.join(shuffled(wide), "pkg", "left_anti"), "narrow-advisories")
        few = gathered.count() <= BROADCAST_ROWS
    if few:
        joined = parsed.join(F.broadcast(gathered), "pkg")
    else:
        hot = _hot(deps) if hot is None else hot
        joined = _dealt(parsed, hot).join(shuffled(_copies(gathered, hot)), ["pkg", "salt"])
    inside = F.filter("ranges", lambda r: in_range(F.col("v"), r["lo_v"], r["fixed_v"]))
    matched = joined.select(*deps.columns, "v", "id", F.inline(F.array(F.struct(inside.alias("hits")))))
    compared = matched.where(F.size("hits") > 0).select(
        *deps.columns,
        "id",
        F.array_min(F.transform("hits", lambda r: r["severity"])).alias("severity"),
        F.array_min(F.transform("hits", lambda r: r["summary"])).alias("summary"),
        format_version(F.col("v")).alias("version"),
    )
    return compared if looked_up is None else compared.unionByName(looked_up)


def _hot(deps: DataFrame) -> DataFrame:
    """Packages of more than ``HOT`` declarations: so few that they may be broadcast, one for each ``HOT`` rows at most."""
    counted = deps.groupBy("pkg").agg(F.count("*").alias("n"))
    return materialize(counted.where(F.col("n") > HOT).select("pkg", F.lit(True).alias("hot")), "hot-packages")


def _copies(rows: DataFrame, hot: DataFrame) -> DataFrame:
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(F.broadcast(hot), "pkg", "left").withColumn("salt", F.explode(parts)).drop("hot")


def _dealt(parsed: DataFrame, hot: DataFrame) -> DataFrame:
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("target_id", "manifest_path"), F.lit(SALT)).cast("int")).otherwise(0)
    return parsed.join(F.broadcast(hot), "pkg", "left").withColumn("salt", part).drop("hot")


def _looked_up(parsed: DataFrame, hot: DataFrame, gathered: DataFrame, columns: list[str]) -> DataFrame:
    """Declarations of wide packages: every version is looked up once, and its advisories go to all who declare it."""
    versions = parsed.select("pkg", "v").join(shuffled(gathered.select("pkg").distinct()), "pkg", "left_semi").distinct()
    found = materialize(search_versions(materialize(versions, "versions"), gathered), "found-advisories")
    joined = _dealt(parsed, hot).join(shuffled(_copies(found, hot)), ["pkg", "v", "salt"])
    return joined.select(*columns, "id", "severity", "summary", format_version(F.col("v")).alias("version"))


def _disjoint(ranges: Column) -> Column:
    """The ranges of one advisory cut where they overlap, each part with the least severity and summary that cover it."""
    sound = F.filter(ranges, lambda r: r["lo_v"] < r["fixed_v"])
    bounds = F.array_sort(F.array_distinct(F.flatten(F.transform(sound, lambda r: F.array(r["lo_v"], r["fixed_v"])))))

    def part(lo: Column, i: Column) -> Column:
        fixed = F.get(bounds, i + 1)
        over = F.filter(sound, lambda r: (r["lo_v"] <= lo) & (r["fixed_v"] >= fixed))
        return F.struct(
            lo.alias("lo_v"), fixed.alias("fixed_v"),
            F.array_min(F.transform(over, lambda r: r["severity"])).alias("severity"),
            F.array_min(F.transform(over, lambda r: r["summary"])).alias("summary"),
            F.size(over).alias("n"),
        )

    return F.filter(F.transform(bounds, part), lambda r: r["n"] > 0)


def search_versions(versions: DataFrame, gathered: DataFrame) -> DataFrame:
    """``pkg, v, id, severity, summary``: the advisories (``pkg, id, ranges``) that hold each of ``versions`` (``pkg, v``).

    The index of a package is a segment tree over its sorted bounds: a range is the union of at most two nodes a level, a
    version lies in one node of every level, and the two meet in an equi-join that yields nothing but matches.
    """
    parts = gathered.select("pkg", "id", F.inline(_disjoint(F.col("ranges"))))
    parts = materialize(parts.select("pkg", "id", "lo_v", "fixed_v", "severity", "summary"), "ranges")
    bounds = parts.select("pkg", F.explode(F.array("lo_v", "fixed_v")).alias("v")).distinct()
    points = bounds.withColumn("bound", F.lit(1)).unionByName(versions.withColumn("bound", F.lit(0)))
    so_far = Window.partitionBy("pkg").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = materialize(points.select("pkg", "v", "bound", F.sum("bound").over(so_far).cast("int").alias("rank")), "ranks")
    at = ranked.where("bound = 1").select("pkg", "v", "rank")
    placed = parts.join(shuffled(at.withColumnsRenamed({"v": "lo_v", "rank": "low"})), ["pkg", "lo_v"]).join(
        shuffled(at.withColumnsRenamed({"v": "fixed_v", "rank": "high"})), ["pkg", "fixed_v"]
    )

    def level(k: Column) -> Column:
        low = F.ceil(F.col("low") / F.pow(F.lit(2.0), k)).cast("int")
        high = F.floor(F.col("high") / F.pow(F.lit(2.0), k)).cast("int")
        own = lambda odd, node: F.when((low < high) & (odd % 2 == 1), F.struct(k.alias("level"), node.alias("node")))
        return F.array(own(low, low), own(high, high - 1))

    nodes = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), level)), lambda n: n.isNotNull())
    covered = materialize(placed.select("pkg", "id", "severity", "summary", F.inline(nodes)), "nodes")
    levels = covered.groupBy("pkg").agg(F.max("level").alias("top"))
    asked = ranked.where("bound = 0").join(shuffled(levels), "pkg").select("pkg", "v", "rank", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))
    asked = asked.select("pkg", "v", "level", F.floor(F.col("rank") / F.pow(F.lit(2.0), F.col("level"))).cast("int").alias("node"))
    return asked.join(shuffled(covered), ["pkg", "level", "node"]).select("pkg", "v", "id", "severity", "summary")


def known_cve(deps: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Advisory findings; the confirmed floor unless a larger table is given."""
    rows = match_advisories(deps, advisory_floor(deps.sparkSession), few=True) if advisories is None else match_advisories(deps, advisories)
    evidence = F.concat(
        "pkg", F.lit("@"), "declared", F.lit(" ("), "id", F.lit("), current parsed "), "version"
    )
    return one_hit(
        rows,
        hit(
            "known_cve", rule_id=advisory_rule_id("DEPENDENCIES_", F.col("id")),
            severity=F.col("severity"), evidence=evidence, file=F.col("manifest_path"),
            params=[F.col("pkg"), F.col("declared"), F.col("id"), F.col("summary")],
        ),
    )


# ---- passes -----------------------------------------------------------------


def good_practices(manifests: DataFrame, facts: DataFrame) -> DataFrame:
    """Practices visible in the manifest or the framework configuration.

    The signal list is a constant, so each target is tested in place with array
    expressions and emits its passes without a join against the signals.
    """
    names = F.map_keys("deps")

    def has(deps: Sequence[str]) -> Column:
        exact = [d for d in deps if not d.endswith("*")]
        out = F.arrays_overlap(names, F.array(*[F.lit(d) for d in exact]))
        for d in deps:
            if d.endswith("*"):
                out = out | _prefixed(names, d[:-1])
        return out

    config = picked_config(facts).select("target_id", F.col("other").alias("sets_headers"))
    rows = manifests.join(shuffled(config), "target_id", "left")
    passes = []
    for pid, category, title, detail, deps in lists.PRACTICE_SIGNALS:
        cond = has(deps)
        if pid == "PASS_SECURITY_HEADERS_CONFIG":
            cond = cond | F.coalesce("sets_headers", F.lit(False))
        row = F.struct(*[F.lit(x).alias(k) for k, x in zip(PASS_COLUMNS[1:], (pid, category, title, detail, "whitebox"))])
        passes.append(F.when(cond, row))
    return rows.select("target_id", F.inline(F.filter(F.array(*passes), lambda r: r.isNotNull())))


def _prefixed(names: Column, prefix: str) -> Column:
    return F.exists(names, lambda n: F.startswith(n, F.lit(prefix)))

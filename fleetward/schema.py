"""Row shapes shared by every stage.

Rules emit *compact* finding rows: identity, verdict and parameters, but not the
long report texts, so that shuffles stay narrow.  ``publish`` attaches the texts
from a fixed-size lookup at the very end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import lists
from .catalog.texts import MAX_PARAMS, VARIANTS, Variant

# What a rule emits; everything a variant determines is added by ``complete``.
HIT_FIELDS = {
    "variant": "string", "rule_id": "string", "severity": "string", "evidence": "string", "file": "string", "line": "int",
    "url": "string", "params": "array<string>", "emit_src": "string", "emit_ord": "array<bigint>", "raw": "string", "raw_line": "string",
}
HIT_TYPE = f"struct<{','.join(f'{k}:{v}' for k, v in HIT_FIELDS.items())}>"
SIDE_CHANNEL = ("raw", "raw_line")
COMPACT = (
    "target_id", "rule_id", "variant", "category", "severity", "confidence", "source", "evidence",
    "file", "line", "url", "params", "phase", "rule_ord", "emit_src", "emit_ord",
)
PUBLIC = (
    "target_id", "rule_id", "category", "severity", "cwe", "owasp", "title", "why", "evidence",
    "file", "line", "url", "fix", "fix_prompt", "confidence", "mode", "source",
)
PASS_COLUMNS = ("target_id", "id", "category", "title", "detail", "mode")

# Registry order decides which of two equal findings wins.
RULE_ORDER = {
    "secret_": 1, "env_": 2, "rls_open_live": 5, "rls_": 3, "definer_": 3, "firebase_": 4, "middleware_": 6,
    "missing_auth": 7, "sql_": 8, "command": 9, "xss_": 10, "ssrf_": 11, "webhook_replay": 13, "webhook_": 12,
    "mass_": 14, "cors_": 15, "image_": 15, "config_": 15, "header_": 16, "weak_": 16, "exposed_": 17,
    "sourcemap": 18, "known_": 19, "ai_": 20, "tls_": 21, "public_secret_": 22, "upload_": 23,
    "gitleaks_": 25, "osv_": 26, "semgrep": 27,
}
ENGINE_OF = {"gitleaks_": "gitleaks", "osv_": "osv-scanner", "semgrep": "semgrep"}


def _by_prefix(table: dict, variant: str, default=None):
    return next((v for k, v in table.items() if variant.startswith(k)), default)


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed-size table of constants as a local relation."""
    fields = T.StructType.fromDDL(schema).fields
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    columns = list(zip(*rows))
    table = pa.table(
        {f.name: pa.array(col, arrow[f.dataType.simpleString()]) for f, col in zip(fields, columns)}
    )
    return spark.createDataFrame(table, schema=T.StructType(fields))


def hit(
    variant: str,
    *,
    rule_id: Column | None = None,
    severity: Column | None = None,
    evidence: Column | None = None,
    file: Column | None = None,
    line: Column | None = None,
    url: Column | None = None,
    params: Sequence[Column] = (),
    ord: Column | Sequence[Column | int] = 1,
    src: Column | None = None,
    raw: Column | None = None,
    raw_line: Column | None = None,
) -> Column:
    """One finding as a struct of ``HIT_TYPE``; ids and severities only where computed.

    Findings of a rule and file are ordered by ``src``, the report they came from, and then by the numbers ``ord``.
    """
    null = F.lit(None)
    texts = [null if c is None else c for c in (rule_id, severity, evidence, file, line, url)]
    given = F.array(*params) if params else F.array()
    order = F.array(*[o if isinstance(o, Column) else F.lit(o) for o in (ord if isinstance(ord, Sequence) else (ord,))])
    tail = [null if c is None else c for c in (raw, raw_line)]
    return F.struct(F.lit(variant), *texts, given, null if src is None else src, order, *tail).cast(HIT_TYPE)


NO_HITS = f"array<{HIT_TYPE}>"


def explode_hits(df: DataFrame, hits: Column) -> DataFrame:
    """Rows ``target_id`` + hit columns from an array of hits per row."""
    return df.select("target_id", F.inline(hits))


def one_hit(df: DataFrame, finding: Column) -> DataFrame:
    """One hit per row of ``df``.

    ``inline`` instead of a struct projection keeps later filters from being pushed
    into (and copying) the expressions a hit is made of.
    """
    return df.select("target_id", F.inline(F.array(finding)))


def known(hits: DataFrame, column: str) -> Column:
    """``column`` of the variant lookup; a variant that is in no catalogue ends the job with its name."""
    missing = F.raise_error(F.concat(F.lit("unknown finding variant: "), F.coalesce("variant", F.lit("NULL")))).cast("string")
    return F.coalesce(column, missing)


def complete(hits: DataFrame, variants: Mapping[str, Variant] = VARIANTS) -> DataFrame:
    """Add what the variant determines; the lookup has one row per variant.

    Variants that rules of others bring along are ordered after all rules of this package.
    """
    if "category" in hits.columns:
        return hits
    rows = [
        (
            k, v.rule_id, v.category, v.severity, v.confidence, _by_prefix(ENGINE_OF, k, "native") if k in VARIANTS else "native",
            0 if k not in VARIANTS or _by_prefix(ENGINE_OF, k) is None else 1,
            _by_prefix(RULE_ORDER, k) if k in VARIANTS else 100 + i,
        )
        for i, (k, v) in enumerate(variants.items())
    ]
    constants = lookup(
        hits.sparkSession,
        rows,
        "variant string, rule_id_v string, category string, severity_v string, confidence string, source string, "
        "phase int, rule_ord int",
    )
    side = [c for c in SIDE_CHANNEL if c in hits.columns]
    return (
        hits.join(F.broadcast(constants), "variant", "left")
        .withColumn("category", known(hits, "category"))
        .withColumn("rule_id", F.coalesce("rule_id", "rule_id_v"))
        .withColumn("severity", F.coalesce("severity", "severity_v"))
        .select(*COMPACT, *side)
    )


def variants_table(spark: SparkSession, variants: Mapping[str, Variant] = VARIANTS) -> DataFrame:
    rows = [
        (k, v.cwe, v.owasp, v.mode, v.title, v.why, v.fix, v.fix_prompt) for k, v in variants.items()
    ]
    return lookup(
        spark,
        rows,
        "variant string, cwe string, owasp string, mode string, title_t string, why_t string, fix_t string, prompt_t string",
    )


def fill(template: Column) -> Column:
    """Put a finding's parameters and location into a text template."""
    out = template
    for i in range(MAX_PARAMS):
        out = F.replace(out, F.lit(f"<<{i}>>"), F.coalesce(F.get(F.col("params"), F.lit(i)), F.lit("")))
    out = F.replace(out, F.lit("<<file>>"), F.coalesce(F.col("file"), F.lit("")))
    return F.replace(out, F.lit("<<url>>"), F.coalesce(F.col("url"), F.lit("")))


def with_title(findings: DataFrame, variants: Mapping[str, Variant] = VARIANTS) -> DataFrame:
    """Add the rendered title; the lookup holds one row per variant."""
    titles = variants_table(findings.sparkSession, variants).select("variant", "title_t")
    joined = findings.join(F.broadcast(titles), "variant", "left")
    return joined.withColumn("title", fill(known(findings, "title_t"))).drop("title_t")


def publish(findings: DataFrame, keep: Sequence[str] = (), variants: Mapping[str, Variant] = VARIANTS) -> DataFrame:
    """Final finding rows with report texts; working columns go unless kept."""
    findings = complete(findings, variants)
    texts = variants_table(findings.sparkSession, variants)
    # a secret in a fetched script was seen from outside
    outside = F.startswith("variant", F.lit("secret_")) & F.col("file").isNull() & F.col("url").isNotNull()
    note = F.lit("")
    if "note_class" in findings.columns:
        note = F.coalesce(
            F.element_at(F.create_map(*[F.lit(x) for kv in lists.CONTEXT_NOTES.items() for x in kv]), F.col("note_class")),
            F.lit(""),
        )
    return (
        findings.join(F.broadcast(texts), "variant", "left")
        .withColumn("title", fill(known(findings, "title_t")))
        .withColumn("mode", F.when(outside, "blackbox").otherwise(F.col("mode")))
        .withColumn("why", F.concat(note, fill(F.col("why_t"))))
        .withColumn("fix", fill(F.col("fix_t")))
        .withColumn("fix_prompt", fill(F.col("prompt_t")))
        .select(*PUBLIC, *keep)
    )

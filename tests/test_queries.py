"""Queries against their SQL oracles at the smallest scale, plans, and streams."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fleetward.operators import target_rules
from fleetward.plans import fleet as fp
from fleetward.plans.oracles import ORACLES
from fleetward.plans.queries import fleet_of
from fleetward.sources import corpus

SF = os.environ.get("FLEETWARD_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(norm(r[i]) for i in order)) for r in cur.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_read_and_matched_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    text = plan(fp.scan_files(corpus.files(spark, SF)))
    assert text.count("FileScan parquet") == 1
    assert text.count("NODE_TLS_REJECT_UNAUTHORIZED[") == 2  # once as a test, once as the scan behind it


def test_path_tests_run_before_text_tests(spark):
    from fleetward.operators.file_rules import RULES_BY_KEY, run_rule
    from fleetward.sources import files as fs

    files = fs.read_table(spark, _stored(spark))
    text = plan(run_rule(files, RULES_BY_KEY["rule_firebase_open"]))
    assert "Filter" in text and text.index("allow") < text.index("Filter")  # parents are printed first


def _stored(spark):
    from fleetward.plans.staging import staging_path

    path = staging_path(spark, "files")
    corpus.files(spark, SF).write.parquet(path)
    return path


def test_no_cross_joins_between_tables(spark):
    text = plan(target_rules.match_advisories(corpus.deps(spark, SF), corpus.advisories(spark, SF)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_fleet_parts_may_be_missing(spark):
    whole = fleet_of(spark, SF)
    only_pages = fp.Fleet(corpus.url_targets(spark, SF), None, whole.homepages, whole.responses, whole.probe_responses)
    result = fp.scan_fleet(only_pages)
    assert {r.source for r in result.findings.select("source").distinct().collect()} == {"native"}
    skipped = fp.scan_fleet(fp.Fleet(corpus.repo_targets(spark, SF), engine_reports=whole.engine_reports, files=whole.files), skip_engines=True)
    assert skipped.engines.where("semgrep or gitleaks or osv_scanner").count() == 0


def test_the_listing_is_computed_once(spark, tmp_path):
    """A range sort looks at its input twice, so it sorts a stored table."""
    spark.range(30).selectExpr("id as p_partkey", "3 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(30).selectExpr("id as doc_id", "'some words' as text").write.parquet(f"{tmp_path}/documents.parquet")
    text = plan(entry.queries()["findings_by_severity"](spark, str(tmp_path)))
    assert text.count("FileScan parquet") == 1 and "listing-" in text and "from_json" not in text

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetward.operators import file_rules, target_rules
from fleetward.plans.staging import materialize, shared_dir
from fleetward.schema import publish
from fleetward.sources import corpus, files as fs, http


def test_directory_reader_keeps_dotfiles_and_large_files(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.ts").write_text("exec(`a ${b}`)\n")
    (tmp_path / ".env").write_text("NAME=1\n")
    (tmp_path / "bad.ts").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "big.ts").write_text("x" * 2_000_000)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("exec(`a ${b}`)")
    rows = {r.path: r for r in fs.read_directory(spark, str(tmp_path), 7).collect()}
    assert set(rows) == {"lib/a.ts", ".env", "bad.ts", "big.ts", "node_modules/x.js"}
    assert rows["big.ts"].content == "x" * 2_000_000 and rows["big.ts"].n_bytes == 2_000_000
    assert rows["bad.ts"].content == "ok �� end" and rows[".env"].target_id == 7
    found = file_rules.run_rule(fs.scannable(fs.read_directory(spark, str(tmp_path))), file_rules.RULES_BY_KEY["rule_command_injection"])
    assert [r.file for r in publish(found).collect()] == ["lib/a.ts"]


def test_manifest_choice_and_dev_override(make_files):
    files = make_files({
        1: {"a/package.json": json.dumps({"dependencies": {"x": "1"}}), "package.json": json.dumps({"dependencies": {"x": "2", "y": "1"}, "devDependencies": {"x": "3"}})},
        2: {"b/package.json": json.dumps({"dependencies": {"x": "5"}}), "a/package.json": json.dumps({})},
        3: {"package.json": "{\"dependencies\": {"}, 4: {"package.json": "[]"},
    })
    deps = {(r.target_id, r.pkg): r.declared for r in fs.manifest_deps(fs.manifests(files)).collect()}
    assert deps == {(1, "x"): "3", (1, "y"): "1"}
    assert {r.target_id for r in fs.manifests(files).collect()} == {1, 2}


def test_row_security_across_files(make_files):
    files = make_files({
        1: {"a.sql": 'create table "public"."tags" (id int);\ncreate table if not exists notes (id int);', "b.sql": "alter table only tags enable row level security; create policy p on tags using (auth.uid() = u);"},
        2: {"a.sql": "create table t (id int);"},
        3: {"supabase/a.sql": "create table one (id int);\ncreate table two (id int);\ncreate table one (id int);"},
    })
    facts = target_rules.facts_of(files, "sql_created", "sql_rls", "hosted_db")
    deps = fs.manifest_deps(fs.manifests(files))
    out = {r.target_id: r for r in publish(target_rules.rls_disabled(facts, deps)).collect()}
    assert set(out) == {1, 3}
    assert (out[1].title, out[1].line, out[1].evidence) == ('Table "notes" has no Row Level Security', 2, None)
    assert (out[3].title, out[3].evidence) == ("2 tables have no Row Level Security", "one, two")


def test_webhook_verification_is_decided_per_target(make_files):
    hook = "import {stripe} from '../s'; export async function POST(req){ const event = req.body; }"
    files = make_files({
        1: {"pages/api/webhook.ts": hook},
        2: {"pages/api/webhook.ts": hook, "lib/v.ts": "stripe.webhooks.constructEvent(body, sig, secret)"},
        3: {"src/server/stripeWebhook.ts": hook},
        4: {"src/app/docs/page.tsx": "export default () => (<p>Stripe webhook handlers: never pass req.body straight on.</p>);"},
        5: {"pages/api/hooks/gh.ts": "const s = req.headers['x-hub-signature']; const b = req.body; // github webhook"},
        6: {"pages/api/hooks/gh.ts": "const b = req.body; // github webhook", "v.ts": "createHmac('sha256', s); timingSafeEqual(a, b); // x-hub-signature"},
    })
    out = publish(target_rules.webhook_unverified(target_rules.facts_of(files, "webhook", "verified"))).collect()
    assert sorted((r.target_id, r.title.split(" ")[1]) for r in out) == [(1, "Stripe"), (3, "Stripe"), (5, "GitHub")]


def test_committed_env_text_depends_on_gitignore(make_files):
    files = make_files({
        1: {".env": "A=1"}, 2: {".env": "A=1", ".gitignore": "dist\n.env*\n"}, 3: {".env.example": "A=1"}, 4: {".env": "# none\na=1"},
        5: {"app/.env.production": "A_B=x", ".gitignore": "dist"},
    })
    out = publish(target_rules.committed_env(target_rules.facts_of(files, "env_values", "gitignore_env"))).collect()
    assert sorted((r.target_id, "history" in r.why) for r in out) == [(1, False), (2, True), (5, False)]


@pytest.mark.parametrize("names", [1, 7, 10_000])
def test_large_repositories_are_listed_by_many_tasks(spark, tmp_path, monkeypatch, names):
    monkeypatch.setattr(fs, "_FRONTIER_NAMES", names)
    rnd = random.Random(names)
    folders = [tmp_path / "one", tmp_path / "two"]
    for _ in range(25):
        folders.append(rnd.choice(folders) / f".d{rnd.randint(0, 9)}")
    want = set()
    for i, folder in enumerate(folders):
        folder.mkdir(parents=True, exist_ok=True)
        for k in range(i % 4):
            (folder / f"f{k}.txt").write_text("x" * i)
    (tmp_path / "one" / "link").symlink_to(tmp_path / "two")
    (tmp_path / "empty").mkdir()
    for t, name in enumerate(["one", "two", "empty"]):
        want |= {(t, str(p.relative_to(tmp_path / name)), p.stat().st_size) for p in (tmp_path / name).rglob("*") if p.is_file()}
    roots = spark.createDataFrame([(0, f"{tmp_path}/one"), (1, f"{tmp_path}/two/"), (2, f"{tmp_path}/empty")], "target_id bigint, root string")
    listed = fs.list_repositories(roots)
    assert {(r.target_id, r.path, r.n_bytes) for r in listed.collect()} == want and listed.count() == len(want)
    assert (listed._jdf.queryExecution().optimizedPlan().toString().count("Relation") > 1) == (names < 10_000)  # rounds


def test_advisory_ranges_equal_brute_force(spark):
    import itertools

    versions = [f"{a}.{b}.0" for a, b in itertools.product(range(4), range(3))] + ["latest", "^2", "~1.1"]
    deps = spark.createDataFrame([(i, "package.json", "p" if i % 2 else "q", v) for i, v in enumerate(versions)], "target_id bigint, manifest_path string, pkg string, declared string")
    ranges = [("p", "X", "high", "1.0.0", "2.1.0", "s"), ("p", "X", "high", "3.0.0", "3.2.0", "s"), ("q", "Y", "low", "0.1.0", "1.2.0", "s")]
    adv = spark.createDataFrame(ranges, "pkg string, id string, severity string, lo string, fixed string, summary string")

    def key(v):
        digits = [int(x) for x in v.lstrip("^~").split(".") if x.isdigit()]
        return tuple(digits + [0] * (3 - len(digits))) if digits else None

    want = {
        (i, r[1]) for i, v in enumerate(versions) for r in ranges
        if r[0] == ("p" if i % 2 else "q") and key(v) and key(r[3]) <= key(v) < key(r[4])
    }
    out = target_rules.match_advisories(deps, adv).collect()
    assert sorted((r.target_id, r.id) for r in out) == sorted(want)


@pytest.mark.parametrize("rows_broadcast", [100_000, 0])
def test_a_hot_declaration(spark, monkeypatch, rows_broadcast):
    monkeypatch.setattr(target_rules, "BROADCAST_ROWS", rows_broadcast)
    n = 20_000
    deps = spark.range(n).select(
        F.col("id").alias("target_id"), F.lit("package.json").alias("manifest_path"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("pkg"), F.lit("1.2.0").alias("declared"),
    )
    rows = [("hot", "A", "high", "1.0.0", "2.0.0", "s"), ("hot", "A", "low", "1.1.0", "3.0.0", "r"), ("hot", "B", "low", "2.0.0", "3.0.0", "s"), ("p2", "C", "low", "0.1.0", "9.0.0", "s")]
    adv = spark.createDataFrame(rows, "pkg string, id string, severity string, lo string, fixed string, summary string")
    out = target_rules.match_advisories(deps, adv)
    got = out.groupBy("pkg", "id").agg(F.count("*").alias("n"), F.min("severity").alias("s"), F.min("summary").alias("t")).collect()
    hot = sum(1 for i in range(n) if i % 3 < 2)
    assert {(r.pkg, r.id, r.n, r.s, r.t) for r in got} == {("hot", "A", hot, "high", "r"), ("p2", "C", 1, "low", "s")}
    salts = deps.where("pkg = 'hot'").select(F.pmod(F.xxhash64("target_id", "manifest_path"), F.lit(target_rules.SALT)).alias("k")).groupBy("k").count().collect()
    assert len(salts) == target_rules.SALT and max(r["count"] for r in salts) < 2 * hot / target_rules.SALT
    stored = _stored_deps(spark, deps)
    plan = target_rules.match_advisories(stored, adv)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/deps-") == 1 and ("salt" in plan) == (rows_broadcast == 0)


def _dotted(key):
    return ".".join(map(str, key))


def test_versions_are_looked_up_in_wide_packages(spark):
    """One package of 10,000 advisories, some of which nest and overlap, and one version that all targets declare."""
    rnd = random.Random(7)
    n = 10_000
    ranges = []
    for i in range(n):
        lo = (rnd.randint(0, 200), rnd.randint(0, 9), rnd.randint(0, 3))
        size = rnd.choice([0, 0, 0, 1, 150])
        ranges.append(("wide", f"A{i}", rnd.choice(["high", "low"]), lo, (lo[0] + size, lo[1] + 1, rnd.randint(0, 3)), f"s{i % 7}"))
    ranges += [("wide", "A0", "critical", (0, 0, 0), (300, 0, 0), "a"), ("wide", "A0", "low", (5, 0, 0), (6, 0, 0), "zz")]
    ranges += [("narrow", "N", "high", (1, 0, 0), (2, 0, 0), "s"), ("wide", "odd", "high", (9, 0, 0), (3, 0, 0), "never")]
    versions = [(rnd.randint(0, 360), rnd.randint(0, 9), rnd.randint(0, 3)) for _ in range(40)] + [(5, 0, 0), (6, 0, 0), (0, 0, 0)]
    everywhere = (500, 1, 0)
    rows = [(k, "m", "wide", f"^{_dotted(v)}") for k, v in enumerate(versions)]
    rows += [(k, "m", "wide", _dotted(everywhere)) for k in range(1000, 3000)] + [(5000, "m", "narrow", "1.5.0"), (5001, "m", "other", "1.5.0"), (5002, "m", "wide", "latest")]
    ranges.append(("wide", "last", "low", (500, 0, 0), (501, 0, 0), "t"))
    deps = spark.createDataFrame(rows, "target_id bigint, manifest_path string, pkg string, declared string")
    adv = spark.createDataFrame([(p, i, s, _dotted(lo), _dotted(fixed), t) for p, i, s, lo, fixed, t in ranges], "pkg string, id string, severity string, lo string, fixed string, summary string")
    want = {}
    for k, _, pkg, declared in rows:
        v = tuple(map(int, declared.lstrip("^").split("."))) if declared != "latest" else None
        for p, i, s, lo, fixed, t in ranges if k < 1000 or k >= 3000 else ranges[-1:]:
            if v and p == pkg and lo <= v < fixed:
                old = want.get((k, i), (s, t))
                want[k, i] = (min(old[0], s), min(old[1], t))
    out = target_rules.match_advisories(deps, adv)
    assert out.columns == [*deps.columns, "id", "severity", "summary", "version"]
    got = out.collect()
    assert len(got) == len(want) and {(r.target_id, r.id): (r.severity, r.summary) for r in got} == want


def _stored_deps(spark, deps):
    return materialize(deps, "deps")


def test_discovered_configuration(spark):
    url, pub, token = "https://" + "a" * 20 + ".supabase.co", "sb_publishable_" + "K" * 12, ".".join(["eyJ" + "a" * 20, "b" * 20, "c" * 20])
    rows = [(1, -1, f'x "{url}" {token}'), (1, 0, f"{pub}"), (2, -1, f"only {token}"), (3, 0, f"{url} {token}"), (3, -1, "none"), (4, -1, 'apiKey: "AIza' + "z" * 35 + '"')]
    df = spark.createDataFrame(rows, "target_id bigint, ord int, text string")
    out = {r.target_id: r for r in http.discover_config(df.select("target_id", "ord", *http.config_values(F.col("text")))).collect()}
    assert (out[1].db_url, out[1].db_key) == (url, pub)
    assert (out[2].db_url, out[2].db_key) == (None, None)
    assert out[3].db_key == token and out[4].web_api_key == "AIza" + "z" * 35


def test_staging_uses_the_shared_folder(spark):
    folder = shared_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    out = materialize(spark.range(5), "probe")
    assert out.count() == 5 and out.inputFiles()[0].replace("file://", "").startswith(folder)


@pytest.mark.parametrize("hot", [1_000, 1_000_000])
def test_stored_advisories_beyond_the_count_are_not_broadcast(spark, monkeypatch, hot):
    """Copies of a small stored table are no small table."""
    monkeypatch.setattr(target_rules, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(target_rules, "HOT", hot)
    deps = spark.range(6_000).select(
        F.col("id").alias("target_id"), F.lit("package.json").alias("manifest_path"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("pkg"), F.lit("1.2.0").alias("declared"),
    )
    rows = [(p, f"{p}-{i}", "high", "1.0.0", f"{i}.0.0", "s") for p in ("hot", "p1", "p3", "absent") for i in (1, 2)]
    adv = spark.createDataFrame(rows, "pkg string, id string, severity string, lo string, fixed string, summary string")
    out = target_rules.match_advisories(deps, adv)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert {tuple(r) for r in out.groupBy("id").count().collect()} == {("hot-2", 3000), ("p1-2", 120), ("p3-2", 120)}


def test_reports_of_few_part_rows_are_made_by_all_cores(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    reports = corpus.engine_reports(spark, str(tmp_path)).where("engine = 'osv-scanner'")
    assert reports.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert reports._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1  # other texts are not made

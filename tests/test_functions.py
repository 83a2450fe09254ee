import math
import random
import string
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetward.functions import identity, paths, secrets, text, tokens, urls, version
from fleetward.functions.calls import call_sites, tainted_arg
from fleetward.functions.dialect import Pattern
from fleetward.operators.ingest import max_fix
from fleetward.sources.snippets import ANON_TOKEN, EXAMPLE_CONN, LIVE_KEY, PUBLIC_KEY, REAL_CONN, SERVICE_TOKEN


def values(spark, rows, schema="s string"):
    return spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)


def column(spark, rows, make, schema="s string"):
    df = values(spark, rows, schema).withColumn("i", F.monotonically_increasing_id())
    return [r.x for r in df.select("i", make().alias("x")).orderBy("i").collect()]


def test_scan_counts_lines_before_a_match(spark):
    p = Pattern(r"off\s*:\s*false")
    body = "a off:\n false\n\x01x\noff: false z off :false"
    got = values(spark, [body]).select(F.inline(text.scan(F.col("s"), p))).collect()
    assert [(r.ord, r.line, r.match) for r in got] == [(1, 1, "off:\n false"), (2, 4, "off: false"), (3, 4, "off :false")]


def test_scan_equals_brute_force_on_random_text(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    import re

    want = [[(t[: m.start()].count("\n") + 1, m.group()) for m in re.finditer(r"a\s+b", t)] for t in texts]
    got = column(spark, texts, lambda: text.scan(F.col("s"), Pattern(r"a\s+b")))
    assert [[(h.line, h.match) for h in hits] for hits in got] == want


def test_word_boundary_is_ascii_and_dollar_is_end_of_text(spark):
    p = Pattern(r"\bauth$")
    assert column(spark, ["é auth", "éauth", "xauth", "auth\n"], lambda: text.matches(F.col("s"), p)) == [True, True, False, False]


def test_space_class_includes_no_break_space(spark):
    assert column(spark, ["a b", "a​b"], lambda: text.matches(F.col("s"), Pattern(r"a\sb"))) == [True, False]


def test_entropy_equals_definition(spark):
    rng = random.Random(3)
    words = ["", "a", "aab"] + ["".join(rng.choice(string.ascii_letters) for _ in range(rng.randrange(1, 60))) for _ in range(30)]

    def want(w):
        return -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values()) if w else 0.0

    got = column(spark, words, lambda: text.shannon_entropy(F.col("s")))
    assert got == pytest.approx([want(w) for w in words])


def test_redact_keeps_a_short_prefix(spark):
    got = column(spark, [" short ", "abcdefghi", "x" * 60], lambda: text.redact(F.col("s")))
    assert got == ["****", "abc…****** (redacted)", "x" * 10 + "…****** (redacted)"]


def test_versions(spark):
    raw = ["^1.2.3", ">=2.5", "v7", "latest", "20240101.1.2", ">=1.2.0 <2.0.0", " ~ 3.1.4-beta", "", None]
    got = column(spark, raw, lambda: version.format_version(version.parse_version(F.col("s"))))
    assert got == ["1.2.3", "2.5.0", "7.0.0", None, "20240101.1.2", "1.2.0", "3.1.4", None, None]
    inside = column(
        spark, ["13.5.8", "13.5.9", "13.0.0", "12.9.9", "20240101.0.0"],
        lambda: version.in_range(version.parse_version(F.col("s")), version.version_literal("13.0.0"), version.version_literal("13.5.9")),
    )
    assert inside == [True, False, True, False, False]


def test_max_fix_prefers_the_first_of_equals(spark):
    got = column(spark, [(["1.2.0", "v1.10.0", "1.10.0", "none"],), ([],), (["none"],)], lambda: max_fix(F.col("s")), "s array<string>")
    assert got == ["v1.10.0", None, None]


def test_finding_id_is_fnv_over_utf16_units(spark):
    def want(key):
        h = 2166136261
        units = key.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
        digits = ""
        while h:
            h, r = divmod(h, 36)
            digits = (string.digits + string.ascii_lowercase)[r] + digits
        return digits.rjust(7, "0")

    keys = ["", "A|b|3|", "é|src/ü.ts||", "😀|x|1|", "X|" + "p" * 500]
    assert column(spark, keys, lambda: identity.finding_id(F.col("s"))) == [want(k) for k in keys]


def test_identities(spark):
    key = column(spark, [("R", "f", 3, None), ("R", None, None, "u")],
                 lambda: identity.dedupe_key(F.col("r"), F.col("f"), F.col("l"), F.col("u")), "r string, f string, l int, u string")
    assert key == ["R|f|3|", "R|||u"]
    got = column(
        spark, [("lodash@4.17.11", None, "t"), (None, "next@^13.4.0 (X)", "uses @Scope/Pkg@1.0"), (None, None, "none")],
        lambda: identity.dep_package(F.col("u"), F.col("e"), F.col("t")), "u string, e string, t string",
    )
    assert got == ["lodash", "@scope/pkg", None]


def test_path_classes_and_predicates(spark):
    cases = {
        "src/content/landing.ts": "content", "docs/guide.md": "docs", "README.md": "docs", "examples/demo.ts": "example",
        "src/app/api/pay/route.ts": "source", ".env": "credential", ".env.example": "example", ".env.local": "example",
        "tests/a.ts": "test", "dist\\x.js": "build", "next.config.js": "config", "a.json": "config", "Makefile": "unknown",
    }
    assert column(spark, list(cases), lambda: paths.path_class(F.col("s"))) == list(cases.values())
    ignored = {
        "node_modules/x.js": True, "a/dist/b.js": True, "distx/b.js": False, "src/a.test.ts": True, "a.test.d/b.ts": False,
        "lib/x.min.js": True, "tests/a.ts": False, ".git/config": True, ".gitignore": False, "e2e/a.ts": True,
    }
    assert column(spark, list(ignored), lambda: paths.is_ignored(F.col("s"))) == list(ignored.values())
    routes = [("pages/api/a.ts", ""), ("src/x/route.ts", "<p></p>"), ("src/a.ts", "export async function POST(r) {}"),
              ("src/a.tsx", "export async function POST(r) { return <p></p> }"), ("src/a.ts", "const x = 1")]
    got = column(spark, routes, lambda: paths.is_server_route(F.col("p"), F.col("c")), "p string, c string")
    assert got == [True, True, True, False, False]


def test_relative_path(spark):
    rows = [("/repo/t1", "/repo/t1/src/a.ts"), ("/repo/t1/", "/repo/t1/a"), ("/repo/t1", "/repo/t10/a"), ("/repo/t1", "src/a")]
    got = column(spark, rows, lambda: paths.relative_path(F.col("r"), F.col("p")), "r string, p string")
    assert got == ["src/a.ts", "a", "/repo/t10/a", "src/a"]


def test_secret_verdicts(spark):
    cases = {
        ANON_TOKEN: "public", SERVICE_TOKEN: "dangerous", PUBLIC_KEY: "public", LIVE_KEY: "dangerous",
        "sb_publishable_inventedForTests01": "public", "sb_secret_inventedForFleetTests01": "dangerous",
        EXAMPLE_CONN: "public", REAL_CONN: "dangerous", "postgres://ledger:${LEDGER_PASSWORD}@db.invalid/ledger": "public",
        "mysql://demo:<your-password>@localhost/demo": "public", "AIza-invented-web-key-0123456789-0123": "public",
        f"A=1\nSTRIPE={LIVE_KEY}": "dangerous", "0badc0de0bad": "other", "eyJhbGciOi_______.eyJyb2xlIjoi____.abcdefghijk": "other",
        "postgres://localhost/ledger": "other", "": "other",
    }
    assert column(spark, list(cases), lambda: secrets.classify_secret(F.col("s"))) == list(cases.values())
    example = column(spark, [EXAMPLE_CONN, REAL_CONN, "plain"], lambda: secrets.example_conn_string(F.col("s")))
    assert example == [True, False, False]


def test_url_resolution(spark):
    from urllib.parse import urljoin

    base = "https://shop.example.com/en/list/page.html?x=1#top"
    refs = ["a.js", "./a.js", "../a.js", "../../../a.js", "/s/a.js?v=1", "//cdn.example.net/a.js", "https://o.example.org/a.js", "?q=1", "x/./y/../z.js"]
    got = column(spark, refs, lambda: urls.resolve_url(F.lit(base), F.col("s")))
    assert got == [urljoin(base, r) for r in refs]


CALLS = [
    ("exec(`ping ${host}`)", [("exec", True)]),
    ("db.query('SELECT ' + id)", [("db.query", True)]),
    ("pool.query('SELECT * FROM o WHERE id = $1', [id])", [("pool.query", False)]),
    ("foo(bar(x), 2)", [("foo", False), ("bar", False)]),
    ("// exec(`a ${b}`)\nq.exec('x')", [("q.exec", False)]),
    ("const s = 'exec(`a ${b}`)';\n/* raw(a + b) */ fetch(`https://${req.query.url}/d`);", [("fetch", True)]),
    ("a?.query(`x ${y}`)", []),
    ("new Foo(x).query(`x ${y}`)", [("query", True)]),
    ("function query(a) { return raw(a + b); }", [("raw", True)]),
    ("if (x) { y(); }", [("y", False)]),
    ("this.db.query(\n  'a' +\n  b,\n c)", [("db.query", True)]),
    ("prisma.$queryRawUnsafe('S' + id)", [("prisma.$queryRawUnsafe", True)]),
    ("x.from('x').raw('a' + f(b, c) + 'd')", [("x.from", False), ("raw", True), ("f", False)]),
    ("x.execute(a ? b : c + 'd')", [("x.execute", False)]),
    ("x.execute('a' + `t${z}`)", [("x.execute", False)]),
    ("exec(`a ${'lit'} ${3}`)", [("exec", False)]),
    ("exec(`a ${cond ? `b` : c}`)", [("exec", True)]),
    ("class A { query(sql) { return 1 } }", []),
    ("x.exec(('a' + b) + 'c')", [("x.exec", True)]),
    ("exec('a' + (b))", [("exec", True)]),
    ("await fetch<T>(u + q)", [("fetch", True)]),
    ("exec('a' + 'b' + 1)", [("exec", False)]),
    ("exec('a' + b - c)", [("exec", False)]),
    ("exec(!a + 'x')", [("exec", False)]),
    ("if (/['\"`]/.test(a)) exec('x' + y)", [("exec", True)]),
    ("orm.$queryRawUnsafe<Array<{id:number}>>(q)", [("orm.$queryRawUnsafe", False)]),
    ("const t = `${exec(`du ${folder}`)}`;", [("exec", True)]),
    ("db.query(build(a, [b(c(d(e)))]) + id)", [("db.query", True), ("build", False), ("b", False), ("c", False), ("d", False)]),
    ("db.query<Array<Row>>('select ' + id)", [("db.query", True)]),
    ("x(`${a(`${b(`${c('x' + y)}`)}`)}`); z(1)", [("x", True), ("a", True), ("b", True), ("c", True), ("z", False)]),
    ("if (a < b && c > (d)) e(f)", [("e", False)]),
    ("call<(x: A) => Promise<B>, 'k' | 'l'>(u + v)", [("call", True)]),
    ("a `stray tick; exec('du ' + folder)", [("exec", True)]),
]


def test_call_sites_and_taint(spark):
    df = values(spark, [(i, s) for i, (s, _) in enumerate(CALLS)], "i int, s string")
    rows = df.select("i", F.inline(call_sites(F.col("s")))).withColumn("t", tainted_arg(F.col("arg0"))).collect()
    got = {i: [] for i in range(len(CALLS))}
    for r in sorted(rows, key=lambda r: (r.i, r.ord)):
        if r.callee != "test":
            got[r.i].append((r.callee, r.t))
    assert got == {i: want for i, (_, want) in enumerate(CALLS)}


def seconds(df):
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


@pytest.mark.parametrize("kind", ["scan", "calls"])
def test_time_grows_with_the_number_of_matches(spark, kind):
    """Four times the matches in one text take less than five times as long."""
    unit = "ab.  cd\n" if kind == "scan" else "exec('a' + b);\n"
    make = (lambda: text.scan(F.col("s"), Pattern(r"\b(\w+)\.\s+(\w+)"))) if kind == "scan" else (lambda: call_sites(F.col("s"), "^exec$"))
    frames = [values(spark, [unit * n]).select(F.size(make()).alias("n")) for n in (1000, 10_000, 40_000)]
    assert [f.first().n for f in frames] == [1000, 10_000, 40_000]
    small, large = (seconds(f) for f in frames[1:])
    assert large < 5 * small


def test_long_text_needs_no_recursion(spark):
    body = "const a = `" + "x ${y} " * 60_000 + "`;\nexec('ls ' + '" + "q" * 200_000 + "' + dir);\n" + "/* c */ " * 20_000
    rows = values(spark, [body]).select(F.inline(call_sites(F.col("s"), r"^exec$"))).collect()
    assert [(r.line, r.callee) for r in rows] == [(2, "exec")]


@pytest.mark.parametrize("fields", [10, 400, 20_000])
def test_type_arguments_of_any_length(spark, fields):
    types = "{" + "; ".join(f"field{i}: Array<string>" for i in range(fields)) + "}"
    rows = values(spark, [f"db.$queryRawUnsafe<{types}>('a' + q); f<{types}(x); g(1)"]).select(F.inline(call_sites(F.col("s")))).collect()
    assert [(r.callee, r.tainted) for r in rows] == [("db.$queryRawUnsafe", True), ("g", False)]


#: Text with a backtick that closes nothing, and the calls in it.
UNCLOSED = {"`f('a' + b) ${": "f", "`x${f('a' + b)": "f", "`${": "", "`'${f('a' + b) '": "", "`x${f(`a${g(b)}`)": "fg"}


@pytest.mark.parametrize("unit", UNCLOSED)
@pytest.mark.parametrize("count", [2, 12, 300])
def test_unclosed_templates_are_text_however_many(unit, count):
    body = unit * count + "\nexec('du ' + folder)"
    assert [body[c[0] : c[1]] for c in tokens.positions(body)[0]] == [*UNCLOSED[unit] * count, "exec"]


@pytest.mark.parametrize("unit", [*UNCLOSED, "a<b<", "\\\\`"])
def test_time_of_a_walk_grows_with_the_text(unit):
    def least(n):
        text = "`" + unit * n
        took = []
        for _ in range(3):
            start = time.perf_counter()
            tokens.positions(text)
            took.append(time.perf_counter() - start)
        return min(took)

    assert least(32_000) < 9 * least(8_000) + 0.05


#: First arguments, and whether something variable is added to or put into them.
TAINTED = [
    ("'a' + b", True), ("'a' + 'b'", False), ("a + 1", True), ("1 + 2", False), ("`a`", False), ("`a ${b}`", True), ("`a ${'b'} ${ 12.5 }`", False),
    ("`a ${b}` + 'c'", False), ("`a` + c", True), ("f('a' + b)", False), ("f('a' + b) + c", True), ("x[a + b]", False), ("x[i] + 'a'", True),
    ("(a + b)", False), ("'x' + (a + b)", True), ("'x' + ('a' + 'b')", False), ("(f(a))(b) + 'x'", True), ("f (a) (b) + 'x'", True),
    ("[a + b]", False), ("'x' + [a]", False), ("{a: b + c}", False), ("a - b", False), ("'it\\'s ' + x", True), ("'a+b'", False), ("a++", False),
    ("'x' + await", False), ("'x' + typeof y", False), ("'x' + awaiting", True), ("'x' + this", False), ("'é' + ü", True), ("f(g(h(i + j))) + k", True),
    ("a ? 'b' + c : d", False), ("'x' + f((a), [b], `${c(d)}`)", True), ("`it's ${a} don't` + b", True), ("'a' +", False), ("f(a + b", False),
    ("'x' + `${`${y}`}`", False), ("'select ' +\n  id", True), ("", False), ("\"q\" + ((((((((z))))))))", True),
]


def test_taint_of_arguments(spark):
    rows = values(spark, [(i, a) for i, (a, _) in enumerate(TAINTED)] + [(99, None)], "i int, s string")
    got = {r.i: r.t for r in rows.select("i", tainted_arg(F.col("s")).alias("t")).collect()}
    assert [(TAINTED[i][0], got[i]) for i in range(len(TAINTED))] == TAINTED and got[99] is None


def test_glued_interpolated_and_lines(spark):
    body = "exec('é' + b)\n\nexec(`ü ${b}`); exec(`x`)\r\nexec(`${a}` + c); exec(\"a\"\n + b, 'c' + d)\nexec(d + 'e')"
    rows = values(spark, [body, "", None]).select(F.inline(call_sites(F.col("s"), "^exec$"))).collect()
    assert [(r.ord, r.line, r.arg0, r.glued, r.interpolated) for r in rows] == [
        (1, 1, "'é' + b", True, False), (2, 3, "`ü ${b}`", True, True), (3, 3, "`x`", False, False),
        (4, 4, "`${a}` + c", False, False), (5, 4, '"a"\n + b', True, False), (6, 6, "d + 'e'", False, False),
    ]


def test_lines_by_the_newline_index(spark):
    body = "".join(f"{'x' * (i % 7)}{chr(10) * (i % 3)}f{i}(a)" for i in range(500))
    rows = values(spark, [body]).select(F.inline(call_sites(F.col("s")))).collect()
    assert [r.line for r in rows] == [body.count("\n", 0, body.index(f"f{i}(")) + 1 for i in range(500)]


def test_entropy_of_whole_texts_equals_that_of_values(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "aa", "é\U0001f600é", "\n \t"] + ["".join(rng.choice("abcdeé日本語 \n") for _ in range(rng.randrange(1, 5000))) for _ in range(20)]
    got = column(spark, texts, lambda: text.text_entropy(F.col("s")))
    want = column(spark, texts, lambda: text.shannon_entropy(F.col("s")))
    assert got[:4] == [None, 0.0, 0.0, 0.0] and got[1:] == pytest.approx(want[1:], abs=1e-12) and want[0] is None

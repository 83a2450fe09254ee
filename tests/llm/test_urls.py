"""Rules against a plain reading of them, and scores against dense PageRank."""

import random

import numpy as np
import pytest

from fleetward.llm import url_filter as uf

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def ruled(host, path):
    fit = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda f: len(f[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?q=/y#z", "http://sub.www.example.com/en/",
    "http://example.com/en/1", "http://notexample.com/en/1", "http://com/", "http://xcom/", "https://a.net/es/1?u=http://b.com/", "https://a.net/fr",
    "https://a.net/fr/", "https://net/es/", "http://É.com/É", "http://İ.net/es/", "a://b?c/d", "a://b#c", "x://y/en?://z.com/",
]


def test_hosts_paths_rules(spark):
    rows = [(i, u, "<p>") for i, u in enumerate(URLS)] + [(None, URLS[5], None), (5, URLS[5], None)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string")
    got = sorted(map(repr, ((r.page_id, r.host, r.path, r.rule) for r in uf.filter_urls(df).collect())))
    assert got == sorted(repr((i, *split(u), ruled(*split(u))[0])) for i, u, _ in rows)
    for r in uf.filter_urls(df).collect():
        assert r.verdict == (ruled(r.host, r.path)[1] or "allow") or r.host in ("a.net", "b")
    assert uf.filter_urls(df.limit(0)).count() == 0


def dense(edges, seeds, hosts, damping=uf.DAMPING):
    index = {h: i for i, h in enumerate(hosts)}
    step = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        step[index[b], index[a]] += n
    out = step.sum(axis=0)
    step = step / np.where(out > 0, out, 1)
    seed = np.array([seeds.get(h, 0.0) for h in hosts])
    rank = seed.copy()
    for _ in range(400):
        rank = damping * (step @ rank) + seed * (1 - damping * rank[out > 0].sum())
    return dict(zip(hosts, rank.tolist(), strict=True))


def test_scores_are_personalised_pagerank(spark):
    rnd = random.Random(3)
    hosts = [f"h{i}" for i in range(40)]
    edges = {}
    for _ in range(160):
        a, b = rnd.choice(hosts[:30]), rnd.choice(hosts)
        if a != b:
            edges[a, b] = edges.get((a, b), 0) + rnd.randint(1, 3)
    trust, distrust = {"h0": 0.7, "h1": 0.3}, {"h5": 1.0}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, links long")
    seeds = spark.createDataFrame(
        [("trust", h, s) for h, s in trust.items()] + [("distrust", h, s) for h, s in distrust.items()], "kind string, host string, seed double"
    )
    got = {(r.kind, r.host): r.score for r in uf.propagate(df, seeds, rounds=200, still=1e-9).collect()}
    along = dense(edges, trust, hosts)
    against = dense({(b, a): n for (a, b), n in edges.items()}, distrust, hosts)
    for h in hosts:
        assert got.get(("trust", h), 0.0) == pytest.approx(along[h], abs=1e-6)
        assert got.get(("distrust", h), 0.0) == pytest.approx(against[h], abs=1e-6)


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    """Hosts 35 links away from a blocked one: rounds have no cap, so the sums are those of the whole chain."""
    n, pages = 35, 5
    chain = [(f"h{i}", f"h{i - 1}", 1) for i in range(1, n + 1)]
    seeds = spark.createDataFrame([("distrust", "h0", 1.0)], "kind string, host string, seed double")
    df = spark.createDataFrame(chain, "src string, dst string, links long")
    got = {r.host: r.score * pages for r in uf.propagate(df, seeds, still=uf.PRECISION / pages).collect()}
    want = dense({(b, a): k for a, b, k in chain}, {"h0": 1.0}, [f"h{i}" for i in range(n + 1)])
    assert sum(abs(got.get(h, 0.0) - want[h] * pages) for h in want) < uf.PRECISION and got[f"h{n}"] > 0


def test_links_to_blocked_hosts_block(spark):
    def page(*links):
        return "<html>" + "".join(f'<A class=x HREF="{u}">t</a>' for u in links) + '<a href="/own">o</a><a href=mailto:a@b.c>'

    rows = [(i, f"http://bad.net/es/{i}", page()) for i in range(20)]
    rows += [(100, "http://farm.org/1", page("http://bad.net/es/1", "//BAD.net:80/es/2"))]
    rows += [(101, "http://fine.org/1", page("http://good.com/"))] + [(200 + i, f"http://good.com/{i}", page("http://fine.org/1")) for i in range(5)]
    rows += [(300, "http://bad.net/en/1", page())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r.src, r.dst): r.links for r in uf.host_edges(df, "url", "html").collect()}
    assert edges == {("farm.org", "bad.net"): 2, ("fine.org", "good.com"): 1, ("good.com", "fine.org"): 5}
    got = {r.page_id: r.verdict for r in uf.filter_urls(df).collect()}
    assert got[100] == "block" and got[101] == "allow" and got[300] == "block" and got[1] == "block" and got[200] == "allow"


LINKERS = {
    "none": {},
    "one": {"l1.org": ["bad.net"]},
    "chain": {"l1.org": ["bad.net"], "l2.org": ["l1.org"]},
    "long chain": {"l1.org": ["bad.net"]} | {f"l{i}.org": [f"l{i - 1}.org"] for i in range(2, 8)},
    "cycle": {"l1.org": ["bad.net", "l2.org"], "l2.org": ["bad.net", "l1.org"]},
    "cycle behind one": {"l1.org": ["bad.net"], "l2.org": ["l1.org", "l3.org"], "l3.org": ["l2.org"]},
    "linked back": {"bad.net": ["l1.org"], "l1.org": ["bad.net"]},
}


def test_linkers_do_not_clear_a_blocked_host(spark):
    """Every shape has hosts of its own, named after its place in ``LINKERS``."""
    rows = [(0, "http://good.com/", "")]
    last = {}
    for k, links in enumerate(LINKERS.values()):
        html = {host: "".join(f"<a href='http://{k}{to}/'>t</a>" for to in targets) for host, targets in links.items()}
        rows += [(1, f"http://{k}bad.net/es/{i}", "") for i in range(20)] + [(100 + k, f"http://{k}bad.net/en/1", html.pop("bad.net", ""))]
        rows += [(2, f"http://{k}{host}/", text) for host, text in html.items()]
        last[100 + k] = list(LINKERS)[k]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in uf.filter_urls(df).collect()}
    assert got[0] == "allow"
    assert [name for k, name in last.items() if got[k] != "block"] == []

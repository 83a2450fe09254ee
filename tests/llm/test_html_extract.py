"""Wrappers and main text: pages built from parts whose text is known."""

import html
import random
import re

import pytest

from fleetward.llm import html_extract as h
from fleetward.llm import queries

SF = "/root/testdata/sf0.001"
WORDS = "lamp river stone cloud paper garden window silver morning table harbour winter".split()


def sentence(rnd, n=12):
    return " ".join(rnd.choice(WORDS) for _ in range(n)) + "."


def wrapper(pages):
    out = None
    for page in pages:
        new = h.wrapper_of(page)
        out = new if out is None else h._merged(out, new)
    return out


def shape(item):
    """A wrapper as a regular expression; constants by ``=``, slots by ``#``."""
    mark = ("+" if item[h.REP] else "") + ("?" if item[h.OPT] else "")
    if item[h.KEY] == "#":
        return ("#" if item[h.SAME] is None else "=") + mark
    inner = " ".join(map(shape, item[h.KIDS]))
    return (f"({inner})" if item[h.KEY] in ("", "()") else f"{item[h.KEY]}[{inner}]") + mark


def test_slots_repetitions_and_options():
    a = "<div><h1>One</h1><p>x</p><p>y</p><hr></div>"
    b = "<div><h1>Two</h1><blockquote>q</blockquote><p>z</p></div>"
    assert shape(wrapper([a])) == "(div[h1[=] p[#]+])"
    assert shape(wrapper([a, b])) == shape(wrapper([a, b, a])) == "(div[h1[#] blockquote[=]? p[#]+])"
    assert shape(wrapper(["<div><p>x</p></div>", "<div><p>x</p><p>y</p></div>"])) == "(div[p[#]+])"
    lists = "<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd><dt>e</dt><dd>f</dd></dl>"
    assert shape(wrapper([lists])) == "(dl[(dt[#]? dd[#]?)+])"


def test_wrappers_stay_small():
    rnd = random.Random(1)
    tags = ["p", "h2", "ul", "pre", "blockquote", "table", "div"]
    pages = ["<body>" + "".join(f"<{t}>{sentence(rnd, 3)}</{t}>" for t in rnd.choices(tags, k=rnd.randint(1, 60))) + "</body>" for _ in range(200)]
    whole = wrapper(pages)
    assert len(h.json.dumps(whole)) < 2500
    halves = h._merged(wrapper(pages[:100]), wrapper(pages[100:]))
    assert halves[h.CHARS] == whole[h.CHARS] and halves[h.N] == whole[h.N]


def page(rnd, kind, k):
    """A page of one of several sites, and the text of its article."""
    blocks = [sentence(rnd) for _ in range(rnd.randint(2, 9))]
    title = f"Title {k} &amp; more"
    body = "".join(f"<p class=x>{b.replace('stone', '<b>stone</b>')}{rnd.choice(['', '</p>'])}\n" for b in blocks)
    text = [html.unescape(title), *blocks]
    menu = "<ul>" + "".join(f"<li><a href='/{w}'>{w}</a>" for w in WORDS[:5]) + "</ul>"
    notice = rnd.choice(["", '<div class="cookie-notice"><p>We use cookies on this site to remember you.</div>'])
    readers = "<section id=comments><h3>Replies</h3>" + "".join(f"<div class=comment><p>{sentence(rnd)}</p></div>" for _ in range(rnd.randint(0, 6))) + "</section>"
    form = "<form action=/s><label>Search</label><input name=q><button>Go</button></form>"
    script = "<script>if (a < b) document.write('<p>no</p>');</script><style>p > b {}</style>"
    if kind == "article":
        out = f"<html><head><title>t</title>{script}</head><body>{notice}<nav>{menu}</nav><article><header><h1>{title}</h1></header>{body}<footer>By us</footer></article>{readers}<aside>{sentence(rnd)}</aside><footer>&copy; us</footer>"
    elif kind == "plain":
        out = f"<body><div id=header><a href=/>Home</a></div><div class=menu>{menu}</div><div class='content has-sidebar'><h1>{title}</h1>{body}</div><div class=sidebar>{sentence(rnd)}</div>{readers}{form}<div id=footer>Imprint</div>{script}"
    elif kind == "table":
        out = f"<TABLE><TR><TD class=nav>{menu}<TD><H1>{title}</H1>{body}<TR><TD colspan=2 class='copyright'>All rights reserved</TABLE>"
    else:
        out = f"<form id=page><div class='ad' title='a > b'>{sentence(rnd)}</div><main><h1>{title}</h1>{body}<div class=share><a href=/x>x</a></div></main></form><!-- <p>no</p> --> <noscript>no</noscript>"
    return out, "\n".join(text)


@pytest.mark.parametrize("kind", ["article", "plain", "table", "main"])
def test_sites(kind):
    rnd = random.Random(kind)
    pages = [page(rnd, kind, k) for k in range(30)]
    judged = h.Judged(wrapper([p for p, _ in pages]))
    for source, text in pages:
        assert h.main_text(source, judged) == text
    for source, text in pages[:5]:  # a host of one page
        if kind != "table":
            assert h.main_text(source, h.Judged(wrapper([source]))) == text


def test_template_text_goes_where_paragraphs_vary():
    rnd = random.Random(3)
    pages = [f"<article><h1>News</h1><p>{sentence(rnd)}</p><div>Read our magazine every week</div><p>{sentence(rnd)}</p></article>" for _ in range(8)]
    judged = h.Judged(wrapper(pages))
    assert all("magazine" not in h.main_text(p, judged) and h.main_text(p, judged).count("\n") == 2 for p in pages)
    copies = h.Judged(wrapper(pages[:1] * 9))  # nothing varies: nothing is known to be the template
    assert "magazine" in h.main_text(pages[0], copies)


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("just text &lt;b&gt; &#233;&nbsp;x", "just text <b> é x"),
        ("<p>a<br>b <i>c</i>d<p>e", "a b cd\ne"),
        ("<p>a</p><p", "a"),
        ("<p>1 < 2 <3</p>", "1 < 2 <3"),
        ("<div>a<p>b</p>c</div>", "a\nb\nc"),
        ("<!-- x --><p>a<!-- <p>no</p> -->b</p><!-- open", "ab"),
        ("<p>a</p><script>'</p>'", "a"),
        ("<article><p>a</article><p>b", "a"),
        ("<nav><a>m</a><article><p>a</p></article>", "a"),
        ("<div hidden><p>no</p></div><p style='display: none'>no</p><p>a</p>", "a"),
        ("</p></div><p>a</b></p>", "a"),
    ],
)
def test_markup(source, text):
    assert h.main_text(source, h.Judged(wrapper([source]))) == text


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "<p>a</p>" + "</div>" * 5000
    assert h.main_text(deep, h.Judged(wrapper([deep]))) == "a"
    long = "<article>" + "<p>word " * 200_000 + "</article>"
    assert h.main_text(long, h.Judged(wrapper([long]))).count("word") == 200_000


def expected(source):
    """The article of the given pages, whose paragraphs may be unclosed."""
    m = re.search(r"<article>(.*?)(</article>|$)", source or "", re.DOTALL)
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"<br>|</?(?:p|h1)>", m[1])] if m else []
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("broadcast", [h.BROADCAST, 0])
def test_given_pages_and_odd_rows(spark, broadcast):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = [(None, None, "<p>a</p>"), (9001, "no host", None), (9002, None, ""), (9003, "http://one.example/", "<article><p>x</article>")] * 2
    df = pages.unionByName(spark.createDataFrame(more, pages.schema)).selectExpr("*", "1 as text", "'x' as host", "2 as wrapper")
    got = h.extract_text(df.repartition(40), broadcast=broadcast)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(r.page_id, r.url, expected(r.html)) for r in pages.collect()]
    want += [(None, None, "a"), (9001, "no host", ""), (9002, None, ""), (9003, "http://one.example/", "x")] * 2
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*w, len(w[2]))) for w in want)


def test_hosts_of_many_wrappers(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(k, "https://big.example/p", *page(rnd, "article", k)) for k in range(400)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(100)
    monkeypatch.setattr(h, "MEET", 4)  # several rounds
    got = {r.page_id: r.text for r in h.extract_text(df).collect()}
    assert got == {k: text for k, _, _, text in rows}


def test_query_and_no_rows(spark):
    got = queries.QUERIES["op12_html_extract"](spark, SF)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in got.collect()} == {i: expected(t) for i, t in pages.items()}
    assert h.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []

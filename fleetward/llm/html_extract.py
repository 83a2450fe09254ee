"""Main text of pages: wrappers inferred per host as union-free regular expressions.

A page becomes a stream of tokens: block tags, with the ends that HTML implies, and texts; inline tags only mark links.
A wrapper is a sequence of items over them: an element with a sequence of its own, a text that is constant or a slot, or
a repeated group; each may be optional.  Pages of a host are aligned with its wrapper one after the other.  Where the
streams differ, unlike texts become a slot, a repetition of what came before a repeated item or group, and all else is
optional.  Squares are folded, and a sequence that names a tag a third time becomes one repeated group, so a wrapper's
size follows its tags, not the pages.  Items add up their occurrences, characters and characters in links.

The main region is found on the wrapper: its ``article``, else its ``main``, else the element into which most text that
is no link falls.  Left out are menus, headers outside of the article, footers, sidebars, forms, scripts and styles by
their tags; adverts, notices, comments and the like by words of class, id and role, unless most of the host's text lies
there; lists that are mostly links; and, among paragraphs that vary, texts that are the same on all of the host's pages.
A page's text is then read by matching its stream with the wrapper.

Every task folds its pages into one wrapper per host; wrappers of a host meet in groups of about ``MEET``, round by
round, so no task sees a whole host.  Wrappers are joined to the pages again, broadcast only below ``BROADCAST`` bytes.

Defined results: null or empty HTML has an empty text; a null url has the empty host; rows that repeat are judged one by
one; an empty table gives an empty result; other columns are not read.  HTML of any length is read to its end: tags cut
off there are no text.  Elements deeper than ``DEEP`` levels are taken as children of that level.
"""

from __future__ import annotations

import html
import json
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.llm.url_filter import host_of
from fleetward.plans.staging import Run, materialize

#: Wrappers merged in one group, hosts held by a task, bytes of wrappers sent to every executor, deepest level.
MEET, HELD, BROADCAST, DEEP = 32, 2000, 32 << 20, 64
#: Pages of a host from which on what is the same on all of them is taken for part of the template.
PAGES = 5

# ---- tokens -----------------------------------------------------------------

_MARKUP = re.compile(
    r"<!--(?:.*?-->|-?>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|(?P<cut>\Z))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike"
    " strong sub sup time tt u var".split()
)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Elements that never hold main text.
_NEVER = frozenset(
    "aside audio button canvas datalist dialog footer frameset head iframe map menu meter nav noembed noframes noscript object"
    " progress script select style svg template textarea title video xmp".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Start tag: open elements that it ends, and those behind which it does not look.
_ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_BLOCKS = _ENDS_P | _NEVER | frozenset("body caption dd dt html legend li picture search tbody td tfoot th thead tr".split())
#: Words of class, id or role that name what is not main text.
_CHROME = frozenset(
    "ad ads adsense advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion breadcrumb breadcrumbs"
    " menu nav navbar navigation navigationbar pager pagination sidebar widget widgets toolbar topbar masthead footer copyright"
    " cookie cookies consent gdpr notice notices alert alertdialog popup modal overlay disclaimer newsletter subscribe subscription"
    " signup login share sharing social related recommended recommendations search skip complementary contentinfo".split()
)
_READERS = frozenset("comment comments commentlist disqus respond responses replies reply discussion".split())
#: Words of class and id that tell containers apart, the first of them that occurs.
_PARTS = (
    "article content post entry story main text body title meta author byline date tags caption gallery image list item card row"
    " column col section block page container wrapper wrap inner left right center top bottom"
).split()
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TURNED = frozenset("has with no without hide show".split())  # "has-sidebar" is about the rest of the page


@lru_cache(maxsize=4096)
def _key(name: str, rest: str) -> str:
    """The token of a start tag: its name, for containers a word of its class, and a mark.

    ``!`` marks words of chrome, ``?`` readers' words, ``~`` what is not shown.  Names and words come from fixed lists, so
    the number of tokens is bounded.
    """
    if name in ("html", "body"):
        return name
    flag, named = "", set()
    if rest.strip(" /"):
        for m in _ATTRIBUTE.finditer(rest):
            attribute, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if attribute in ("class", "id", "role"):
                words = [w.lower() for part in value.split() for w in (*_WORDS.findall(part), "")]
                named.update(words)
                if "header" in words and named <= {"header", "site", "page", "global", "main", "top", "banner", "role", ""}:
                    name = "header"
                for before, word in zip(["", *words], words, strict=False):
                    if before not in _TURNED and (word in _READERS or word in _CHROME):
                        flag = max(flag, "?" if word in _READERS else "!")
                if attribute == "role" and value.lower() in ("main", "article"):
                    name = value.lower()
            elif attribute == "hidden" or (attribute, value.lower()) == ("aria-hidden", "true"):
                flag = "~"
            elif attribute == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                flag = "~"
    if name not in _BLOCKS and name not in _INLINE:
        name = "block"
    if name in ("div", "section", "block", "td"):
        name += next((f".{part}" for part in _PARTS if part in named), "")
    return name + flag


class Node:
    """An element with its children, or a text (key ``#``) with its characters in links."""

    __slots__ = ("key", "kids", "text", "links")

    def __init__(self, key: str, text: str = "", links: int = 0) -> None:
        self.key, self.kids, self.text, self.links = key, [], text, links


def parse(page: str) -> Node:
    """The page as a tree of block elements and texts, white space in one space, character references decoded."""
    root = Node("")
    stack: list[tuple[str, Node | None]] = [("", root)]  # name, and node; None below what never holds text
    parts: list[tuple[str, bool]] = []  # pieces of the text at hand, whether in a link
    links = 0  # open links

    def text() -> None:
        if not parts:
            return
        node = stack[-1][1]
        if node is not None:
            joined = _SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
            if joined:
                node.kids.append(Node("#", joined, sum(len(p) for p, linked in parts if linked)))
        parts.clear()

    def open_(name: str, key: str) -> None:
        text()
        parent = stack[-1][1]
        if parent is None or name in _NEVER or key[-1:] == "~":
            stack.append((name, None))
            return
        node = Node(key)
        parent.kids.append(node)
        stack.append((name, node if len(stack) < DEEP else parent))

    def close_to(place: int) -> None:
        nonlocal links
        text()
        del stack[place:]
        links = 0

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            parts.append((page[at:begin], links > 0))
        if begin == n:
            break
        m = _MARKUP.match(page, begin)
        if m is None:
            parts.append(("<", links > 0))
            at = begin + 1
            continue
        at = m.end()
        if m["name"] is None or m["cut"] is not None:
            continue
        name = m["name"].lower()
        if name in ("br", "wbr", "hr", "img"):
            if name == "hr":
                text()
            elif name == "br":
                parts.append((" ", False))
            continue
        if m["end"]:
            if name in _INLINE:
                links = max(0, links - (name == "a"))
                place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name or stack[i][0] not in _INLINE), 0)
                if stack[place][0] == name:
                    close_to(place)
                continue
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if place:
                close_to(place)
            elif name == "p":
                text()
            continue
        if name in _VOID:
            continue
        key = _key(name, m["rest"])
        if name in _INLINE:
            links += name == "a"
            if key != name:  # an inline element that its words make chrome
                open_(name, key)
            continue
        if name in ("html", "body") and len(stack) > 1 and name != "body":
            continue
        if stack[-1][0] == "head" and name not in _IN_HEAD:
            close_to(len(stack) - 1)
        if name in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close_to(i)
                    break
                if stack[i][0] not in _INLINE:
                    break
        if name in _ENDS:
            ended, fence = _ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in fence:
                    break
                if stack[i][0] in ended:
                    close_to(i)
        if name in ("article", "main"):  # what holds it was never closed
            low = next((i for i, (held, node) in enumerate(stack) if node is None and held in ("nav", "footer", "button", "map")), 0)
            if low:
                close_to(low)
        if name in _RAW:
            text()
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        open_(name, key)
    text()
    return root


# ---- wrappers ---------------------------------------------------------------
# An item is a list: key, optional, repeated, occurrences, characters, characters in links, digest of a constant text or
# None, items.  The key is a tag's, ``#`` for a text, ``()`` for a repeated group.

KEY, OPT, REP, N, CHARS, LINKS, SAME, KIDS = range(8)


def _item(node: Node) -> list:
    if node.key == "#":
        return ["#", False, False, 1, len(node.text), min(node.links, len(node.text)), crc32(node.text.encode("utf-8", "replace")), []]
    kids = _normal([_item(k) for k in node.kids])
    return [node.key, False, False, 1, sum(k[CHARS] for k in kids), sum(k[LINKS] for k in kids), None, kids]


def _keys(item: list) -> list[str]:
    return [k[KEY] for k in item[KIDS]] if item[KEY] == "()" else [item[KEY]]


def _merged(a: list, b: list) -> list:
    """One item for two of one key."""
    kids = a[KIDS] if not b[KIDS] and a[KEY] == "#" else _aligned(a[KIDS], b[KIDS])
    same = a[SAME] if a[SAME] == b[SAME] else None
    return [a[KEY], a[OPT] or b[OPT], a[REP] or b[REP], a[N] + b[N], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], same, kids]


def _group(items: list[list]) -> list:
    """A repeated group over all tags of ``items``, each optional."""
    inner: OrderedDict[str, list] = OrderedDict()
    for item in items:
        for one in item[KIDS] if item[KEY] == "()" else [item]:
            one = [*one[:OPT], True, *one[REP:]]
            inner[one[KEY]] = _merged(inner[one[KEY]], one) if one[KEY] in inner else one
    kids = list(inner.values())
    return ["()", all(i[OPT] for i in items), True, max(k[N] for k in kids), sum(k[CHARS] for k in kids), sum(k[LINKS] for k in kids), None, kids]


def _alike(a: list, b: list) -> bool:
    """Whether two items of one key may be repetitions: they share half of the smaller one's tags."""
    x, y = {k for kid in a[KIDS] for k in _keys(kid)}, {k for kid in b[KIDS] for k in _keys(kid)}
    return 2 * len(x & y) >= min(len(x), len(y))


def _normal(items: list[list]) -> list[list]:
    """Squares folded: like neighbours of one key first, then what repeats a tag a third time."""
    out: list[list] = []
    for item in items:
        if out and out[-1][KEY] == item[KEY] != "()" and item[KEY] != "#" and _alike(out[-1], item):
            out[-1] = _merged(out[-1], item)
            out[-1][REP] = True
        else:
            out.append(item)
    while True:
        places: dict[str, list[int]] = {}
        groups = [i for i, item in enumerate(out) if item[KEY] == "()"]
        for i, item in enumerate(out):
            for key in _keys(item):
                places.setdefault(key, []).append(i)
        wide = [(p[0], p[-1]) for p in places.values() if len(p) > 2 or (len(p) == 2 and (p[0] in groups or p[1] in groups))]
        if not wide:
            return out
        begin, end = min(wide)
        end = max(e for b, e in wide if b == begin)
        out[begin : end + 1] = [_group(out[begin : end + 1])]


def _next(items: list[list], keys: list[str], start: int) -> int:
    """First place from ``start`` on whose item shares a key; the length if there is none."""
    for i in range(start, len(items)):
        if any(k in keys for k in _keys(items[i])):
            return i
    return len(items)


def _aligned(a: list[list], b: list[list]) -> list[list]:
    """One sequence for two, aligned from the left."""
    if not a or not b:
        return [[*i[:OPT], True, *i[REP:]] for i in a or b]
    out: list[list] = []
    i = j = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x[KEY] == y[KEY] != "()":
            out.append(_merged(x, y))
            i, j = i + 1, j + 1
            continue
        if "()" in (x[KEY], y[KEY]) and set(_keys(x)) & set(_keys(y)):
            both = [x, y]
            i, j = i + 1, j + 1
            keys = set(_keys(x)) | set(_keys(y))
            while i < len(a) and keys & set(_keys(a[i])):
                both.append(a[i])
                i += 1
            while j < len(b) and keys & set(_keys(b[j])):
                both.append(b[j])
                j += 1
            out.append(_group(both))
            continue
        if out and out[-1][KEY] == y[KEY] not in ("()", "#") and _alike(out[-1], y):  # a repetition of what came before
            out[-1] = _merged(out[-1], y)
            out[-1][REP], j = True, j + 1
            continue
        skip_a, skip_b = _next(a, _keys(y), i) - i, _next(b, _keys(x), j) - j
        found_a, found_b = i + skip_a < len(a), j + skip_b < len(b)
        if found_a and (not found_b or skip_a <= skip_b):
            out += [[*item[:OPT], True, *item[REP:]] for item in a[i : i + skip_a]]
            i += skip_a
        elif found_b:
            out += [[*item[:OPT], True, *item[REP:]] for item in b[j : j + skip_b]]
            j += skip_b
        else:
            out += [[*x[:OPT], True, *x[REP:]], [*y[:OPT], True, *y[REP:]]]
            i, j = i + 1, j + 1
    out += [[*item[:OPT], True, *item[REP:]] for item in a[i:] + b[j:]]
    return _normal(out)


def wrapper_of(page: str) -> list:
    return _item(parse(page))


# ---- the main region of a wrapper -------------------------------------------


class Judged:
    """A wrapper with its verdicts: which items are of the main region, and which of those are left out."""

    def __init__(self, wrapper: list) -> None:
        self.wrapper, self.pages = wrapper, wrapper[N]
        self.spared: set[int] = set()  # items that their tag or words speak against, but that hold most of the text
        self._spare(wrapper, wrapper[CHARS])
        named = self._find(wrapper, "article") or self._find(wrapper, "main")
        most = max((i[CHARS] for i in named), default=0)
        chosen = [i for i in named if i[CHARS] * 3 >= most] or [self._densest()]
        self.named = bool(named)
        self.region = {id(item) for item in chosen}
        self.dropped: set[int] = set()
        for item in chosen:
            self._drop(item)

    def _spare(self, item: list, total: int) -> None:
        for kid in item[KIDS]:
            if kid[CHARS] * 2 > total:
                if kid[KEY][-1:] == "!" or kid[KEY] == "form":
                    self.spared.add(id(kid))
                self._spare(kid, total)

    def _chrome(self, item: list) -> bool:
        return (item[KEY][-1:] in ("!", "?") or item[KEY] == "form") and id(item) not in self.spared

    def _find(self, item: list, name: str) -> list[list]:
        """Topmost items of a tag outside of what is left out."""
        out = []
        for kid in item[KIDS]:
            if kid[KEY] == name:
                out.append(kid)
            elif not self._chrome(kid):
                out += self._find(kid, name)
        return out

    def _plain(self, item: list) -> int:
        """Characters that are no link and in no element left out."""
        if item[KEY] == "#":
            return item[CHARS] - item[LINKS]
        if self._chrome(item) or item[KEY] == "header":
            return 0
        return sum(map(self._plain, item[KIDS]))

    def _densest(self) -> list:
        """The element into which most plain text falls, over and over."""
        item = self.wrapper
        while True:
            best = max(item[KIDS], key=self._plain, default=None)
            if best is None or 10 * self._plain(best) < 7 * self._plain(item) or (best[REP] and best[KEY] != "()"):
                return item
            if best[KEY] in ("#", "p", "ul", "ol", "dl", "pre", "blockquote"):
                return item
            item = best

    def _drop(self, item: list) -> None:
        texts = list(_texts(item))
        fixed = self.pages >= PAGES and item[KEY] != "()" and any(k[SAME] is None for k in texts)
        for kid in item[KIDS]:
            key = kid[KEY]
            links = kid[LINKS] * 2 > kid[CHARS] and key.partition(".")[0] in ("ul", "ol", "dl", "table", "div", "section", "block")
            same = fixed and not kid[REP] and key[0] not in "#(h" and kid[N] == item[N] and kid[CHARS] and all(k[SAME] is not None for k in _texts(kid))
            if self._chrome(kid) or (key == "header" and not self.named) or links or same:
                self.dropped.add(id(kid))
            else:
                self._drop(kid)


def _texts(item: list) -> Iterator[list]:
    for kid in item[KIDS]:
        if kid[KEY] == "#":
            yield kid
        else:
            yield from _texts(kid)


def main_text(page: str, judged: Judged) -> str:
    """Blocks of the page that the wrapper's main region matches, in order."""
    out: list[str] = []

    def match(nodes: list[Node], items: list[list], inside: bool) -> None:
        at = 0
        for node in nodes:
            item, place = _matching(items, node.key, at)
            if item is None:  # the wrapper knows all of its host's pages; others are judged by their tags
                if inside and node.key[-1:] not in "!?" and node.key != "form":
                    if node.key == "#":
                        out.append(node.text)
                    match(node.kids, [], True)
                continue
            at = place
            if id(item) in judged.dropped:
                continue
            here = inside or id(item) in judged.region or id(items[place]) in judged.region
            if node.key == "#":
                if here:
                    out.append(node.text)
            else:
                match(node.kids, item[KIDS], here)

    tree = parse(page)
    match(tree.kids, judged.wrapper[KIDS], id(judged.wrapper) in judged.region)
    return "\n".join(out)


def _matching(items: list[list], key: str, at: int) -> tuple[list | None, int]:
    """The item for a tag from a place on, else before it; and its place."""
    for order in (range(at, len(items)), range(at - 1, -1, -1)):
        for i in order:
            item = items[i]
            if item[KEY] == key:
                return item, i
            if item[KEY] == "()":
                for inner in item[KIDS]:
                    if inner[KEY] == key:
                        return inner, i
    return None, at


# ---- on Spark ---------------------------------------------------------------

_WRAPPERS = "host string, id long, wrapper string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a task as one wrapper per host, as far as ``HELD`` hosts can be held."""

    def rows() -> pa.RecordBatch:
        texts = [json.dumps(w, separators=(",", ":")) for w in held.values()]
        ids = [crc32(t.encode()) for t in texts]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["host", "id", "wrapper"])

    held: dict[str, list] = {}
    for batch in batches:
        for host, page in zip(batch["host"].to_pylist(), batch["html"], strict=True):
            if not page.is_valid:
                continue
            new = wrapper_of(page.as_py())
            held[host] = _merged(held[host], new) if host in held else new
            if len(held) >= HELD:
                yield rows()
                held.clear()
    if held:
        yield rows()


def _met(key: tuple, table: pa.Table) -> pa.Table:
    merged = None
    for text in sorted(table["wrapper"].to_pylist()):
        one = json.loads(text)
        merged = one if merged is None else _merged(merged, one)
    text = json.dumps(merged, separators=(",", ":"))
    return pa.table({"host": [key[0].as_py()], "id": [crc32(text.encode())], "wrapper": [text]}, pa.schema([("host", pa.string()), ("id", pa.int64()), ("wrapper", pa.string())]))


def infer(pages: DataFrame, run: Run, url_col: str, html_col: str) -> DataFrame:
    """``host, wrapper``: one row per host."""
    rows = pages.select(host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))
    at = run.stage(rows.mapInArrow(_fold, _WRAPPERS), "wrappers-0")
    for i in range(1, 64):
        counts = run.stage(at.groupBy("host").agg(F.count("*").alias("n")).where("n > 1"), f"counts-{i}")
        if counts.isEmpty():
            break
        many = at.join(counts, "host").withColumn("block", F.pmod(F.xxhash64("id", F.lit(i)), F.ceil(F.col("n") / MEET)))
        met = many.select("host", "block", "wrapper").groupBy("host", "block").applyInArrow(_met, _WRAPPERS)
        at = run.stage(at.join(counts, "host", "left_anti").unionByName(met), f"wrappers-{i}")
    return at.select("host", "wrapper")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    judged: OrderedDict[str, Judged] = OrderedDict()
    for batch in batches:
        texts: list[str] = []
        for host, page, wrapper in zip(batch["host"].to_pylist(), batch["html"], batch["wrapper"], strict=True):
            if not page.is_valid:
                texts.append("")
                continue
            if host not in judged:
                judged[host] = Judged(json.loads(wrapper.as_py()))
                if len(judged) > 256:
                    judged.popitem(last=False)
            texts.append(main_text(page.as_py(), judged[host]))
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """One row per row of ``pages``: ``id_col, url_col, text, n_chars``."""
    run = Run(pages.sparkSession, "wrappers")
    wrappers = materialize(infer(pages, run, url_col, html_col), "wrappers")
    run.drop()
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    ).withColumn("host", host_of(F.col("url")))
    joined = rows.join(F.broadcast(wrappers) if size <= broadcast else wrappers, "host", "left")
    found = joined.select("page_id", "url", "html", "host", "wrapper").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
    return found.withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)

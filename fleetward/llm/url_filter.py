"""URL filters: rules on hosts and paths, and trust and distrust along links between hosts.

Rules decide where one fits: it fits its host and all subdomains if the url's path starts with the rule's path, and the
longest that fits wins.  Elsewhere the host decides.  Pages that rules allow make their hosts trusted seeds, pages that
rules block make them blocked seeds, each by number of pages.  Personalised PageRank carries trust from trusted seeds
along the links, and distrust from blocked seeds against them: a host that links to blocked hosts is suspect.  Scores
are scaled to pages; as propagation moves mass away from the seeds, a host's own ruled pages count where they are more
than the score it ends with.  A host is blocked if its distrust is above its trust and reaches ``SHARE`` of its own pages.

Edges are hosts of pages and of the links in their HTML, with the number of links; links without a host of their own
stay on their page's and are no edge.  Each round is a join and a sum over edges, written to a table.  Rounds go on,
however long the chains of links are, until all that may still move is less than ``PRECISION`` pages.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed, as are
hosts that neither trust nor distrust reaches; null HTML has no link; rows that repeat an id are judged one by one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetward.plans.staging import materialize


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: Part of the score that a link passes on, pages to which scores are exact, share of pages that blocks a host.
DAMPING, PRECISION, SHARE = 0.85, 0.1, 0.5
#: Movement, as a part of all score, below which rounding is all that is left.
_ROUNDING = 1e-14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)<a\s[^>]*?\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #``, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _choose(rules: Sequence[Rule], host: Column, path: Column, value: str) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``src, dst, links`` between unlike hosts."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(_LINK), F.lit(1))).alias("link"))
    target = F.regexp_replace(F.regexp_extract("link", r"//([^/?#]*)", 1), r"^.*@|:[0-9]*$", "")
    links = links.select("src", F.translate(target, _UPPER, _LOWER).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, still: float = _ROUNDING, rounds: int | None = None) -> DataFrame:
    """``kind, host, score``: personalised PageRank of ``trust`` along, and of ``distrust`` against ``src, dst, links``.

    ``seeds``: ``kind, host, seed``, summing to 1 per kind.  Score that reaches a host without a way on returns to the
    seeds, so scores keep summing to 1.  A round passes on ``damping`` of what moved in the one before, so rounds end by
    themselves; they end when all later ones together move less than ``still``, or after ``rounds`` if that is given.
    """
    edges = materialize(edges, "host-edges")
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links")
    )
    totals = materialize(both.groupBy("kind", "host").agg(F.sum("links").alias("total")), "host-degrees")
    flow = materialize(both.join(totals, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("total")).alias("part")), "flow")
    seeds = materialize(seeds, "seeds")
    ranks = seeds.withColumnRenamed("seed", "score")
    if not flow.head(1):
        return ranks
    for _ in count() if rounds is None else range(rounds):
        moved = ranks.join(flow, ["kind", "host"]).groupBy("kind", "to").agg(F.sum(F.col("score") * F.col("part")).alias("moved"))
        moved = materialize(moved.withColumnRenamed("to", "host"), "moved")
        kept = {r.kind: r.all for r in moved.groupBy("kind").agg(F.sum("moved").alias("all")).collect()}
        back = F.lit(1.0)
        for kind, part in kept.items():
            back = F.when(F.col("kind") == kind, F.lit(1 - damping * part)).otherwise(back)
        new = seeds.join(moved, ["kind", "host"], "full").select(
            "kind", "host", (F.coalesce("seed", F.lit(0.0)) * back + damping * F.coalesce("moved", F.lit(0.0))).alias("score")
        )
        new = materialize(new, "ranks")
        change = new.join(ranks.withColumnRenamed("score", "old"), ["kind", "host"], "full").agg(
            F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
        )
        ranks = new
        if (change.first()[0] or 0.0) * damping / (1 - damping) < max(still, _ROUNDING):
            break
    return ranks


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    share: float = SHARE,
) -> DataFrame:
    """One row per row of ``pages``: ``id_col, host, path, rule, verdict``."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.select(
        "*", _choose(rules, F.col("host"), F.col("path"), "name").alias("rule"), _choose(rules, F.col("host"), F.col("path"), "verdict").alias("ruled")
    )
    rows = materialize(rows, "ruled-pages")
    hosts = rows.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("trust"), F.count_if(F.col("ruled") == "block").alias("distrust")
    )
    hosts = materialize(hosts, "hosts")
    sums = hosts.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    total = {"trust": sums.trust or 0, "distrust": sums.distrust or 0}
    seeds = [
        hosts.where(F.col(kind) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(kind) / F.lit(max(1, total[kind]))).alias("seed"))
        for kind in total
    ]
    ranks = propagate(host_edges(pages, url_col, html_col), seeds[0].unionByName(seeds[1]), still=PRECISION / max(1, *total.values()))
    scores = ranks.groupBy("host").agg(
        *(F.sum(F.when(F.col("kind") == kind, F.col("score") * total[kind]).otherwise(0.0)).alias(f"{kind}_score") for kind in total)
    )
    judged = hosts.join(scores, "host", "left")
    distrust, trust = (F.greatest(kind, F.coalesce(f"{kind}_score", F.lit(0.0))) for kind in ("distrust", "trust"))
    blocked = (distrust > trust) & (distrust >= share * F.col("pages"))
    judged = materialize(judged.select("host", F.when(blocked, "block").otherwise("allow").alias("judged")), "judged-hosts")
    return rows.join(judged, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "judged", F.lit("allow")).alias("verdict")
    )

"""Crawled responses: headers, cookies, scripts, public configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import patterns as p
from ..functions.text import group, matches
from ..functions.urls import resolve_url
from ..plans.staging import shuffled


def normalize_headers(raw: DataFrame) -> DataFrame:
    """``raw(target_id, url, ord, name, value)`` to one header map per response.

    Names are lowercased and repeated values joined by newlines in arrival order.
    A group is the header list of one response, which the protocol bounds.
    """
    entries = F.array_sort(F.collect_list(F.struct("ord", F.lower("name").alias("name"), "value")))
    names = F.array_distinct(F.transform("e", lambda x: x["name"]))
    joined = F.transform(
        names,
        lambda n: F.array_join(
            F.transform(F.filter("e", lambda x: x["name"] == n), lambda x: x["value"]), "\n"
        ),
    )
    return (
        raw.groupBy("target_id", "url")
        .agg(entries.alias("e"))
        .select("target_id", "url", F.map_from_arrays(names, joined).alias("headers"))
    )


def split_cookies(responses: DataFrame) -> DataFrame:
    """One row per cookie of the ``set-cookie`` header."""
    header = F.element_at("headers", F.lit("set-cookie"))
    return responses.where(F.coalesce(header, F.lit("")) != "").select(
        "target_id", "url", F.posexplode(F.split(header, "\n")).alias("ord", "cookie")
    )


def script_urls(base: Column, html: Column) -> Column:
    """Absolute URLs of all external scripts in page order, distinct."""
    live = F.regexp_replace(html, r"<!--(?:[^-]|-(?!->))*+-->", "")
    tags = F.regexp_extract_all(live, F.lit(p.SCRIPT_SRC.java), F.lit(0))
    refs = F.transform(
        tags, lambda t: F.concat(*[group(t, p.SCRIPT_SRC, i) for i in (1, 2, 3)])
    )
    refs = F.transform(F.filter(refs, lambda r: r != ""), lambda r: F.replace(r, F.lit("&amp;"), F.lit("&")))
    return F.array_distinct(F.transform(refs, lambda r: resolve_url(base, r)))


def extract_scripts(homepages: DataFrame) -> DataFrame:
    """``homepages(target_id, url, body)`` to ``target_id, ord, script_url``; no shuffle."""
    return homepages.select(
        "target_id", F.posexplode(script_urls(F.col("url"), F.col("body"))).alias("ord", "script_url")
    )


def usable(responses: DataFrame) -> DataFrame:
    return responses.where((F.col("status") == 200) & (F.coalesce("body", F.lit("")) != ""))


def select_bundles(scripts: DataFrame, responses: DataFrame, *extra: Column) -> DataFrame:
    """Referenced scripts that were fetched with status 200 and a body.

    ``extra`` columns are computed on the response before the join; without them the
    text itself travels along.
    """
    kept = extra or (F.col("body").alias("content"),)
    ok = usable(responses).select("target_id", F.col("url").alias("script_url"), *kept)
    return scripts.join(shuffled(ok), ["target_id", "script_url"])


CONFIG_VALUES = ("db_url", "pub_key", "token", "web_api_key")


def config_values(text: Column) -> list[Column]:
    """What one text says about the backend: short strings or NULL."""

    def found(pattern, idx):
        return F.nullif(F.regexp_extract(text, pattern.java, idx), F.lit(""))

    values = (
        found(p.HOSTED_DB_URL, 0), found(p.PUBLISHABLE_KEY, 1), found(p.ANON_JWT, 1), found(p.WEB_API_KEY, 1)
    )
    return [v.alias(k) for v, k in zip(values, CONFIG_VALUES)]


def discover_config(values: DataFrame) -> DataFrame:
    """Public backend configuration per target over ``target_id, ord`` + config values.

    The first text in order wins (homepage, then bundles).  A publishable key beats
    a token, and either counts only where a database URL was found.
    """

    def first(name):
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("ord"))).alias(name)

    return (
        values.groupBy("target_id")
        .agg(*[first(c) for c in CONFIG_VALUES])
        .select(
            "target_id",
            "db_url",
            F.when(F.col("db_url").isNotNull(), F.coalesce("pub_key", "token")).alias("db_key"),
            "web_api_key",
        )
    )


def haystack_values(homepages: DataFrame, responses: DataFrame) -> DataFrame:
    """Config values of the homepage (first) and of its bundles in page order."""
    home = homepages.select("target_id", F.lit(-1).alias("ord"), *config_values(F.col("body")))
    bundles = select_bundles(extract_scripts(homepages), responses, *config_values(F.col("body")))
    return home.unionByName(bundles.drop("script_url"))


def map_candidates(bundles: DataFrame) -> DataFrame:
    """The source-map URL of every bundle that is not a map itself; no shuffle."""
    url = F.col("script_url")
    return bundles.where(matches(url, p.BUNDLE_URL) & ~matches(url, p.MAP_URL)).select(
        "target_id", "ord", F.concat(F.regexp_replace("script_url", r"\?.*\z", ""), F.lit(".map")).alias("url")
    )

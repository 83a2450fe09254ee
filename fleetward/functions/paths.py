"""Predicates and classes of file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import lists, patterns as p
from .text import matches


def target_type(value: Column) -> Column:
    return F.when(matches(value, p.URL_TARGET), F.lit("url")).otherwise(F.lit("repo"))


def is_ignored(path: Column) -> Column:
    """Build output, vendored code and test artefacts that are never scanned."""
    dirs = "|".join(re.escape(d) for d in lists.IGNORED_DIRS)
    ends = "|".join(re.escape(s) for s in lists.IGNORED_SUFFIXES)
    mids = "|".join(re.escape(s) for s in lists.IGNORED_INFIXES)
    return path.rlike(rf"(?:^|/)(?:{dirs})/|(?:{ends})\z|(?:{mids})[^/]*\z")


def is_source(path: Column) -> Column:
    return matches(path, p.SOURCE_FILE)


def is_code_or_config(path: Column) -> Column:
    return matches(path, p.CODE_OR_CONFIG)


def is_sql(path: Column) -> Column:
    return path.endswith(".sql")


def is_env(path: Column) -> Column:
    return matches(path, p.ENV_FILE)


def is_manifest(path: Column) -> Column:
    return path.endswith("package.json")


def is_lockfile(path: Column) -> Column:
    out = F.lit(False)
    for name in lists.LOCKFILES:
        out = out | path.endswith(name)
    return out


def is_framework_config(path: Column) -> Column:
    return matches(path, p.FRAMEWORK_CONFIG)


def path_class(path: Column) -> Column:
    """Class of a path; the first class that matches wins, safest first."""
    q = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(path.isNull() | (path == ""), "unknown")
        .when(matches(q, p.PATH_EXAMPLE), "example")
        .when(matches(q, p.PATH_TEST), "test")
        .when(matches(q, p.PATH_DOCS), "docs")
        .when(matches(q, p.PATH_CREDENTIAL), "credential")
        .when(matches(q, p.PATH_CONTENT), "content")
        .when(matches(q, p.PATH_BUILD), "build")
        .when(matches(q, p.PATH_CONFIG), "config")
        .when(matches(q, p.PATH_SOURCE), "source")
        .otherwise("unknown")
    )


def is_body_handler(content: Column) -> Column:
    """The file reads a request body or exports a POST handler."""
    return matches(content, p.BODY_HANDLER)


def is_react_view(content: Column) -> Column:
    return matches(content, (p.CLIENT_DIRECTIVE, p.REACT_IMPORT, p.CLOSING_TAG))


def is_server_route(path: Column, content: Column) -> Column:
    """Route locations always count; other modules must export a handler and render nothing."""
    return (
        matches(path, (p.API_ROUTE_PATH, p.ROUTE_FILE))
        | (matches(content, p.SERVER_EXPORT) & ~is_react_view(content))
    )


def relative_path(root: Column, path: Column) -> Column:
    """Strip the target's root directory from an absolute report path."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)

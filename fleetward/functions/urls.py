"""URL resolution over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1))


def _path(url: Column) -> Column:
    """Path of an absolute URL without query and fragment; at least ``/``."""
    p = F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def _without_dots(path: Column) -> Column:
    segments = F.split(path, "/")
    folded = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)),
        F.array(F.lit("")),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(folded, "/"), tail)
    return F.when(path.contains("/."), joined).otherwise(path)


def resolve_url(base: Column, ref: Column) -> Column:
    """``ref`` as seen from the page ``base``, as an absolute URL."""
    ref = F.regexp_replace(ref, r"^\s+|\s+$", "")
    host = origin(base)
    scheme = F.regexp_extract(host, "^(https?:)", 1)
    folder = F.regexp_extract(_path(base), "^(.*/)", 1)
    absolute = (
        F.when(ref.rlike(r"(?i)^https?://"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(host, ref))
        .when(ref.startswith("?"), F.concat(host, _path(base), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*", ""), ref))
        .otherwise(F.concat(host, folder, ref))
    )
    suffix = F.regexp_extract(absolute, r"([?#].*)$", 1)
    full = F.concat(origin(absolute), _without_dots(_path(absolute)), F.replace(suffix, F.lit(" "), F.lit("%20")))
    return F.when(ref.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~ref.rlike(r"(?i)^https?://"), ref).otherwise(full)

"""Verdicts on secret-like values.

No published definition exists for these verdicts; they follow the documented
examples: publishable keys, anonymous tokens, web API keys, analytics project keys,
placeholders and example connection strings are public; live keys, service-role
tokens, private keys and connection strings with a real password are dangerous.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import patterns as p
from .text import group, let, matches


def jwt_role(value: Column) -> Column:
    """The ``role`` claim of the first token in ``value``, or NULL."""
    token = F.regexp_extract(value, p.JWT.java, 0)

    def role(payload: Column) -> Column:
        padded = F.concat(payload, F.repeat(F.lit("="), F.pmod(-F.length(payload), F.lit(4))))
        raw = F.try_to_binary(padded, F.lit("base64"))
        return F.get_json_object(F.try_validate_utf8(raw.cast("string")), "$.role")

    return let(F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/"), role)


def _conn_verdict(value: Column) -> Column:
    """``public`` or ``dangerous`` by the password of a connection string; else NULL."""
    return let(
        F.regexp_extract(value, p.CONN_STRING.java, 0),
        lambda conn: F.when(
            matches(conn, p.CONN_PASSWORD),
            F.when(matches(group(conn, p.CONN_PASSWORD, 1), p.CONN_PLACEHOLDER), "public").otherwise("dangerous"),
        ),
    )


def example_conn_string(value: Column) -> Column:
    """A connection string whose password is a placeholder or an interpolation."""
    return F.coalesce(_conn_verdict(value) == "public", F.lit(False))


def classify_secret(value: Column) -> Column:
    """``dangerous``, ``public`` or ``other``."""

    def verdict(v: Column) -> Column:
        by_role = let(
            jwt_role(v), lambda r: F.when(r == "service_role", "dangerous").when(r == "anon", "public")
        )
        own = F.when(matches(v, p.DANGEROUS_VALUE), "dangerous").when(
            matches(v, (p.PUBLIC_VALUE, p.PLACEHOLDER_VALUE)), "public"
        )
        # The most dangerous verdict of any part wins.
        return let(
            F.array(
                own,
                F.when(v.contains("eyJ"), by_role),
                F.when(v.contains("://"), _conn_verdict(v)),
            ),
            lambda all: F.when(F.array_contains(all, "dangerous"), "dangerous")
            .when(F.array_contains(all, "public"), "public")
            .otherwise("other"),
        )

    return let(value, verdict)

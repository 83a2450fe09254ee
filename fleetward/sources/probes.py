"""Read-only request plans.  The engine never sends them; a crawler does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import lists
from ..functions.urls import origin
from ..schema import lookup


def plan_tables(discovered: DataFrame) -> DataFrame:
    """Twelve single-row reads per target whose database URL and public key are known."""
    words = lookup(
        discovered.sparkSession, list(enumerate(lists.PROBED_TABLES)), "ord int, table_name string"
    )
    return (
        discovered.where(F.col("db_url").isNotNull() & F.col("db_key").isNotNull())
        .crossJoin(F.broadcast(words))
        .select(
            "target_id",
            "ord",
            "table_name",
            F.concat("db_url", F.lit("/rest/v1/"), "table_name", F.lit("?select=*&limit=1")).alias("url"),
        )
    )


def plan_dotfiles(homepages: DataFrame) -> DataFrame:
    """Four dotfile reads per reachable target."""
    words = lookup(
        homepages.sparkSession,
        [(i, path, path[1:]) for i, path in enumerate(lists.PROBED_DOTFILES)],
        "ord int, file_path string, label string",
    )
    return homepages.select("target_id", "url").crossJoin(F.broadcast(words)).select(
        "target_id", "ord", "file_path", "label", F.concat(origin(F.col("url")), "file_path").alias("url")
    )

"""Leaving out rows without moving those that stay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.plans.staging import materialize

#: Most rows that are broadcast.
BROADCAST_ROWS = 500_000


def bounded(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows``, written and counted; broadcast if they are few, else left to a shuffled join."""
    written = materialize(rows, "lost-rows")
    return F.broadcast(written) if written.count() <= (BROADCAST_ROWS if most is None else most) else written


def unused(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex}"

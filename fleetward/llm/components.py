"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.plans.staging import materialize

_EDGE = "u long, v long"


class Forest:
    """Union-find over hashable ids; the smallest id of a set is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """(id, root) of every id that is not its set's root."""
        return [(x, r) for x in self.parent if (r := self.find(x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by a spanning forest: fewer rows, same components."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            forest.union(a, b)
        pairs = forest.stars()
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"]
        )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: every id on an edge, and the smallest id it can reach.

    Each round writes a table, so a lost executor costs one round at most, and rounds grow with the logarithm of the
    longest path.  Minima combine before the shuffle; the join back to a hub's edges reads two plain exchanges, so the
    engine can split a hub.  Null ends and loops are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    stars = materialize(pairs.mapInArrow(_contract, _EDGE).distinct(), "edges")  # u > v
    mark = _mark(stars)
    while mark[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "lowest")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "small-star")
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)

"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, connected components.

Vectors are compared only within a label.  Each of several tables hashes a vector to the signs of its products with some
random hyperplanes; vectors with equal signs in a table meet in a bucket, where all cosines are computed in double
precision.  Two vectors at an angle t agree on one sign with probability 1 - t / pi, so the numbers of hyperplanes and
tables follow from the largest label and from the share of links at the threshold that has to be found (``RECALL``).

Equal vectors of a label are collapsed first: they link without hashing, and a class stands for all its copies.  A bucket
over ``block`` classes is cut into blocks, and every pair of blocks is a task of its own, so no group is held at once.
A pair that meets in several tables counts in the first one only, which the signs carried by both vectors tell.  Tasks
report, per class, how many vectors they linked it to and a spanning star; pairs are never written out.

Defined results: a row whose label or vector is null, or whose vector is empty, zero, or holds a null or a non-finite
component, has no link and stays; vectors of unlike lengths are not compared; rows that repeat an id are separate
vectors of one id, each counted; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.llm.components import connected_components
from fleetward.plans.staging import materialize

THRESHOLD = 0.93
#: Share of the links at exactly the threshold that the tables have to find; links above it are found more often.
RECALL = 0.999
#: Classes per bucket that the number of hyperplanes aims at, and most classes of one block.
PER_BUCKET, BLOCK = 64, 1024
SEED = 20240


def tables_for(largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(hyperplanes, tables) for a largest label of so many classes."""
    same = 1 - math.acos(threshold) / math.pi
    planes = min(30, max(4, round(math.log2(max(1, largest / PER_BUCKET)))))
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - same**planes))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision with a digest of what they were made from; null where there is none."""
    for batch in batches:
        units, digests = [], []
        for row in batch["vector"]:
            raw = None
            if row.is_valid and len(row) and not row.values.null_count:
                raw = np.asarray(row.values.to_numpy(zero_copy_only=False), np.float64)
                norm = math.sqrt(float(raw @ raw)) if np.isfinite(raw).all() else 0.0
                if norm and not math.isfinite(norm):
                    raw = raw / np.abs(raw).max()
                    norm = math.sqrt(float(raw @ raw))
                raw = raw / norm if norm else None
            units.append(raw)
            digests.append(None if raw is None else hashlib.blake2b(raw.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [
                batch["id"].cast(pa.int64()),
                batch["label"].cast(pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(units, pa.list_(pa.float64())),
            ],
            ["id", "label", "digest", "vector"],
        )


def _sign(planes: int, tables: int):
    """Add the signs of every table as one number each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(planes, dtype=np.int64)
        for batch in batches:
            codes = []
            for row in batch["vector"]:
                unit = row.values.to_numpy()
                if len(unit) not in normals:
                    normals[len(unit)] = np.random.default_rng(SEED).standard_normal((tables * planes, len(unit)))
                codes.append(((normals[len(unit)] @ unit > 0).reshape(tables, planes) * weights).sum(axis=1))
            arrays = [*batch.columns, pa.array(codes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "codes"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        values = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
        start = 0
        for i, value in enumerate(values):
            if value != at:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, at = [], i, value
        if len(values) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each of ``n`` positions reaches over the edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(threshold: float):
    """Rows sorted by bucket, pair of blocks and side to ``rep, links, root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket", "first", "second"]):
            if group.num_rows < 2:
                continue
            side = group["side"].to_numpy()
            rep, size, table = group["rep"].to_numpy(), group["size"].to_numpy(), group["tbl"][0].as_py()
            unit, codes = _matrix(group, "vector"), _matrix(group, "codes")
            within = group["first"][0].as_py() == group["second"][0].as_py()
            left = np.arange(len(rep)) if within else np.flatnonzero(side == 0)
            right = left if within else np.flatnonzero(side == 1)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for part in np.array_split(left, max(1, len(left) // 256)):
                a, b = np.nonzero(unit[part] @ unit[right].T >= threshold)
                a, b = part[a], right[b]
                keep = rep[a] < rep[b] if within else np.ones(len(a), bool)
                if table:
                    keep &= ~(codes[a, :table] == codes[b, :table]).any(axis=1)
                found.append((a[keep], b[keep]))
            a, b = (np.concatenate(ends) for ends in zip(*found, strict=True))
            if not len(a):
                continue
            links = np.zeros(len(rep), np.int64)
            np.add.at(links, a, size[b])
            np.add.at(links, b, size[a])
            linked = np.flatnonzero(links)
            arrays = [rep[linked], links[linked], rep[_roots(len(rep), a, b)[linked]]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["rep", "links", "root"])

    return run


def embedding_dedup(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row: ``id_col, n_links, component_id, kept``."""
    picked = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")
    )
    clean = materialize(picked.mapInArrow(_clean, "id long, label long, digest binary, vector array<double>"), "vectors")
    comparable = clean.where("label is not null and digest is not null and id is not null")
    # a class is named by its smallest id; repeated ids with unlike vectors need a name of their own, fixed by the written table
    classes = comparable.groupBy("label", "digest").agg(
        F.min("id").alias("least"), F.count("*").alias("size"), F.first("vector").alias("vector")
    )
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    planes, tables = tables_for(largest, threshold, recall)
    signed = classes.select("rep", "size", "label", "vector").mapInArrow(
        _sign(planes, tables), "rep long, size long, label long, vector array<double>, codes array<int>"
    )
    signed = materialize(signed, "signed")
    keyed = signed.select("*", F.posexplode("codes").alias("tbl", "code"))
    keyed = keyed.withColumn("bucket", F.xxhash64("tbl", "label", F.size("vector"), "code"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "bucket-sizes")
    met = keyed.join(sizes, "bucket")
    met = met.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "bucket",
        F.least("own", "other").alias("first"),
        F.greatest("own", "other").alias("second"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "tbl",
        "rep",
        "size",
        "vector",
        "codes",
    )
    dealt = met.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
    linked = materialize(dealt.mapInArrow(_verify(threshold), "rep long, links long, root long"), "links")
    counted = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    rooted = classes.drop("vector").join(comps, classes["rep"] == comps["id"], "left").join(counted, "rep", "left")
    rooted = rooted.select("label", "digest", "size", "links", "least", F.coalesce("component", "rep").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component")), "named")
    found = rooted.join(named, "root").select(
        "label", "digest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component"
    )
    found = materialize(found, "found")
    mine = clean.select("id", F.when(F.col("id").isNotNull(), F.col("label")).alias("label"), "digest")
    return mine.join(found, ["label", "digest"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )

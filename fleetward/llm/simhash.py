"""SimHash near-duplicates: fingerprints, BK-trees over shards, components.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``words`` words joined by one space (a shorter
text is one shingle), each hashed by XXH64 with seed 42; a bit is 1 if set in more than half of the hashes.

Search: two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` blocks of bits, so distinct
fingerprints are dealt into buckets by (block, value).  A bucket over ``shard`` fingerprints is dealt again by a block of
its remaining bits; one that is still over is cut into shards.  Each shard's BK-tree is built once, as flat lists, and
broadcast to the blocks of fingerprints of its bucket (shuffled to them where there are more than ``TREES`` of them): trees
and blocks of lookups hold about ``shard / 2`` fingerprints, whatever the size of the bucket.  A lookup follows only edges
whose distance lies within the radius of the distance at hand.  Tasks report spanning stars, never all pairs.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; rows are linked by their
fingerprints alone, so rows that repeat an id are in as many components as their texts say; a null id never names a
component (a component of null ids only has a null one).  An empty table gives an empty result.  A text of any length is
read whole, its hashes counted in chunks.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.llm.components import Forest, connected_components
from fleetward.llm.lost import bounded, unused
from fleetward.plans.staging import materialize

BITS = 64
#: Shingle length in words and largest distance in bits.
WORDS, RADIUS = 3, 3
#: Most fingerprints of one tree, and of one block of lookups.
SHARD = 2048
#: Most trees that are broadcast (about 24 KB each); more are shuffled to their lookups.
TREES = 1024
#: Hashes whose bits are counted at a time.
_CHUNK = 1 << 16


def simhash(text: str | None, words: int = WORDS) -> int:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    whole, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(whole, 42)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    hashes = [digest(whole[s : e - 1], 42) for s, e in zip(starts, ends[words - 1 :], strict=False)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        block = np.array(hashes[i : i + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, fp``: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(simhash(t.as_py(), words)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"].cast(pa.int64()), pa.array(prints, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, key: int) -> None:
        new, node = len(self.keys), 0
        self.keys.append(key)
        self.kids.append({})
        while new:
            distance = (self.keys[node] ^ key).bit_count()
            child = self.kids[node].setdefault(distance, new)
            if child == new:
                return
            node = child

    def within(self, key: int, radius: int) -> list[int]:
        """Positions of the keys at most ``radius`` bits away."""
        found, todo = [], [0] if self.keys else []
        keys, kids = self.keys, self.kids
        while todo:
            node = todo.pop()
            distance = (keys[node] ^ key).bit_count()
            if distance <= radius:
                found.append(node)
            low, high = distance - radius, distance + radius
            for edge, child in kids[node].items():
                if low <= edge <= high:
                    todo.append(child)
        return found


    def flat(self) -> tuple[list[int], list[int], list[int]]:
        """Keys level by level, each node's distance to its parent, and where its children start (they follow one another)."""
        order, edges, firsts = [0], [0], []
        for node in order:
            firsts.append(len(order))
            order += self.kids[node].values()
            edges += self.kids[node].keys()
        return [self.keys[n] for n in order], edges, [*firsts, len(order)]


def near_nodes(keys: np.ndarray, edges: np.ndarray, firsts: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``wanted``, node) of all keys at most ``radius`` bits away: all lookups go down a flat tree together."""
    at, node = np.arange(len(wanted)), np.zeros(len(wanted), np.int64)
    found = []
    while len(at):
        # of signed numbers the bits of the absolute value would be counted
        distance = np.bitwise_count((wanted[at] ^ keys[node]).view(np.uint64)).astype(np.int64)
        hit = distance <= radius
        found.append((at[hit], node[hit]))
        width = firsts[node + 1] - firsts[node]
        up = np.repeat(np.arange(len(at)), width)
        child = np.arange(len(up)) - np.repeat(np.cumsum(width) - width, width) + firsts[node][up]
        follow = np.abs(edges[child] - distance[up]) <= radius
        at, node = at[up][follow], child[follow]
    return tuple(np.concatenate(ends) for ends in zip(*found, strict=True)) if found else (at, node)


_EDGE = "a long, b long"
_TREE = "bucket long, shard int, keys array<long>, edges array<long>, firsts array<long>"


def _stars(forest: Forest) -> pa.RecordBatch:
    pairs = forest.stars()
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _search(radius: int):
    """Rows sorted by bucket to stars of fingerprints: each is looked up in the tree of those before it, then added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, prints, forest = None, BKTree(), [], Forest()
        for batch in batches:
            for bucket, fp in zip(batch["bucket"].to_pylist(), batch["fp"].to_pylist(), strict=True):
                if bucket != at:
                    at, tree, prints = bucket, BKTree(), []
                bits = fp & ((1 << BITS) - 1)
                for hit in tree.within(bits, radius):
                    forest.union(fp, prints[hit])
                tree.add(bits)
                prints.append(fp)
            yield _stars(forest)
            forest = Forest()

    return run


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and shard to one flat tree per shard."""

    def row(at: tuple[int, int], tree: BKTree) -> pa.RecordBatch:
        keys, edges, firsts = tree.flat()
        lists = [pa.array([x], pa.list_(pa.int64())) for x in ([_signed(k) for k in keys], edges, firsts)]
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), *lists], ["bucket", "shard", "keys", "edges", "firsts"]
        )

    at, tree = None, BKTree()
    for batch in batches:
        for bucket, shard, fp in zip(*(batch[c].to_pylist() for c in ("bucket", "shard", "fp")), strict=True):
            if (bucket, shard) != at:
                if at:
                    yield row(at, tree)
                at, tree = (bucket, shard), BKTree()
            tree.add(fp & ((1 << BITS) - 1))
    if at:
        yield row(at, tree)


def _look_up(radius: int):
    """Rows of a tree and a block of fingerprints to stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, edges, firsts, wanted = (batch[c][i].values.to_numpy() for c in ("keys", "edges", "firsts", "wanted"))
                forest = Forest()
                for a, b in zip(*(x.tolist() for x in near_nodes(keys, edges, firsts, wanted, radius)), strict=True):
                    forest.union(int(wanted[a]), int(keys[b]))
                yield _stars(forest)

    return run


def _blocks(free: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` blocks that cover ``free`` bits."""
    cuts = [free * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _bits(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _sized(rows: DataFrame, shard: int) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets up to ``shard`` fingerprints, and those of larger ones with their bucket's size."""
    over = materialize(rows.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > shard), "full-buckets")
    return rows.join(over, "bucket", "left_anti"), rows.join(over, "bucket")


def near_edges(prints: DataFrame, radius: int, shard: int = SHARD, most_trees: int = TREES) -> DataFrame:
    """``a, b``: edges that connect all distinct fingerprints ``fp`` at most ``radius`` bits apart."""
    parts = radius + 1
    first = [
        F.struct(F.lit(i).alias("block"), _bits(F.col("fp"), shift, width).alias("value"))
        for i, (shift, width) in enumerate(_blocks(BITS, parts))
    ]
    rows = prints.select("fp", F.explode(F.array(*first)).alias("b")).select(
        "fp", F.col("b.block").alias("block"), F.xxhash64("b.block", "b.value").alias("bucket")
    )
    rows = materialize(rows, "buckets")
    fit, over = _sized(rows, shard)
    # what is left of a fingerprint once its block is cut out
    rest = F.lit(None)
    for i, (shift, width) in enumerate(_blocks(BITS, parts)):
        low = _bits(F.col("fp"), 0, shift) if shift else F.lit(0).cast("long")
        high = F.shiftrightunsigned("fp", shift + width) if shift + width < BITS else F.lit(0).cast("long")
        rest = F.when(F.col("block") == i, low.bitwiseOR(F.shiftleft(high, shift))).otherwise(rest)
    free = BITS - BITS // parts
    second = [
        F.xxhash64(F.col("bucket"), F.lit(i), _bits(F.col("rest"), shift, width)) for i, (shift, width) in enumerate(_blocks(free, parts))
    ]
    finer = over.withColumn("rest", rest).select("fp", F.explode(F.array(*second)).alias("bucket"))
    finer = materialize(finer, "finer-buckets")
    fit2, over2 = _sized(finer, shard)
    small = fit.select("bucket", "fp").unionByName(fit2.select("bucket", "fp")).repartition("bucket").sortWithinPartitions("bucket", "fp")
    shards = F.ceil(F.col("size") / (shard // 2))
    cut = over2.select("bucket", F.pmod(F.xxhash64("fp"), shards).cast("int").alias("shard"), "fp").repartition("bucket", "shard")
    trees = materialize(cut.sortWithinPartitions("bucket", "shard", "fp").mapInArrow(_plant, _TREE), "trees")
    # every pair of a bucket's shards once: the later one's fingerprints go through the earlier one's tree
    blocks = trees.select("bucket", F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("shard"), F.col("keys").alias("wanted"))
    met = blocks.join(F.broadcast(trees) if trees.count() <= most_trees else trees, ["bucket", "shard"])
    return small.mapInArrow(_search(radius), _EDGE).unionByName(met.mapInArrow(_look_up(radius), _EDGE))


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, shard: int = SHARD
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, fingerprint, component_id``."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    comps = connected_components(near_edges(prints.select("fp"), radius, shard)).withColumnRenamed("id", "fp")
    rooted = prints.join(comps, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "named")
    merged = materialize(rooted.join(named, "root").select("fp", "component_id"), "merged")
    return rows.join(merged, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the document with the smallest id.

    A document that repeats with unlike texts goes only if none of them is its group's first; rows without an id stay.
    """
    key = unused("id")
    found = simhash_dedup(docs, id_col, text_col, words, radius).where(F.col(id_col).isNotNull())
    firsts = found.groupBy(F.col(id_col).alias(key)).agg(F.bool_or(F.col(id_col) == F.col("component_id")).alias("first"))
    return docs.join(bounded(firsts.where("not first").select(key)), docs[id_col] == F.col(key), "left_anti")

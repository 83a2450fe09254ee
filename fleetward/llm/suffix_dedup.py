"""Repeated passages by suffix sorting, one bucket of suffixes at a time.

A byte goes if it is covered by a string of ``length`` bytes that starts anywhere else too.  So of the suffixes of all
texts only order up to ``length`` bytes matters, and only suffixes that share that much with another one.

1. *Buckets.*  The suffix starting at i belongs to the bucket named by the least hash of the k-grams of its first
   ``length`` bytes: equal strings are in one bucket.  Neighbouring suffixes mostly share theirs, so a bucket holds
   *fragments*: stretches of text that hold some consecutive suffixes.  Buckets of one fragment are unique text and are
   left at once; equal fragments of one bucket are counted instead of sorted.
2. *Sorting.*  Tasks sort the fragments that are left, some whole buckets of at most ``BLOCK`` bytes at a time.  Within
   a block, suffixes are sorted by their first 32 bytes; ties are resolved by ranks of a difference cover sample: for any
   two positions some shift of less than 31 moves both into the sample, whose suffixes were ranked before, so a tie of
   any length costs one comparison.  Neighbours in the sorted order that agree on ``length`` bytes are repeated.
3. *Hot buckets.*  A bucket of more than ``HOT`` bytes of unlike fragments is not sorted in one task: its strings of
   ``length`` bytes are counted by 128-bit digests, which combine before the shuffle.

Texts are moved once, those with a shared bucket only are moved again; everything else is narrow.

Defined results: a null text counts as empty; a row whose text repeats another row's loses all if it has ``length``
bytes; rows that repeat an id are separate rows; texts shorter than ``length`` stay whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.plans.staging import materialize

LENGTH = 400
#: Bytes of text that a task sorts at a time; bytes of one bucket above which it is counted by digests.
BLOCK, HOT = 1 << 21, 1 << 21
#: Bytes of a text whose k-grams are hashed at a time.
SEGMENT = 1 << 20
#: A planar difference set: every shift modulo 31 is the difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_size(length: int) -> int:
    return max(8, min(32, length // 4))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, and the powers of the base and of its inverse modulo 2**64."""
    values = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size = SEGMENT + (1 << 12)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return values, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-gram, equal for equal ones."""
    values, up, down = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)])
    h = (sums[k:] - sums[:-k]) * down[: len(sums) - k]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    low, span = h, 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def fragments(data: bytes, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(bucket, start, suffixes, digest, k-grams that name the bucket) of the fragments of a text."""
    k = gram_size(length)
    for base in range(0, len(data) - length + 1, SEGMENT):
        part = np.frombuffer(data[base : base + SEGMENT + length - 1], np.uint8)
        grams = gram_hashes(part, k)
        low = sliding_min(grams, length - k + 1)
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])).tolist()
        for i, j in zip(starts, [*starts[1:], len(low)], strict=True):
            name = low[i]
            named = np.count_nonzero(grams[i : j + length - k] == name)
            digest = xxhash.xxh3_64_intdigest(data[base + i : base + j + length - 1])
            yield int(name) - (1 << 63), base + i, j - i, digest - (1 << 63), named


def _outline(length: int):
    """One row per document with its fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                data = (text.as_py() or "").encode("utf-8", "replace")
                found = list(zip(*fragments(data, length), strict=True)) or [()] * 5
                rows.append((hashlib.sha256(data).hexdigest(), len(data), *found))
            types = [pa.string(), pa.int64(), *map(pa.list_, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
            names = ["id", "sha", "n_bytes", "bucket", "start", "suffixes", "digest", "named"]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], names)

    return run


# sorting a block


@lru_cache(maxsize=1)
def _cover() -> tuple[np.ndarray, np.ndarray]:
    """Place of each residue in the cover (or -1), and the least shift that moves two residues into it."""
    place = np.full(PERIOD, -1, np.int64)
    place[list(COVER)] = np.arange(len(COVER))
    shift = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            shift[a, b] = next(d for d in range(PERIOD) if place[(a + d) % PERIOD] >= 0 and place[(b + d) % PERIOD] >= 0)
    return place, shift


def _ranks(words: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the cover sample's suffixes by more than ``length`` bytes, in order of position."""
    at = (np.arange(0, len(words) - 32, PERIOD)[:, None] + np.array(COVER)).ravel()
    at = np.minimum(at, len(words) - 25)
    order = np.lexsort([words[at + o] for o in (24, 16, 8, 0)])
    new = np.zeros(len(at), bool)
    for o in (0, 8, 16, 24):
        w = words[at[order] + o]
        new[1:] |= w[1:] != w[:-1]
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(new)
    depth, step = 32, 1
    while depth < length + PERIOD:
        ahead = step * len(COVER)
        later = np.concatenate([rank[ahead:] + 1, np.zeros(min(ahead, len(rank)), np.int64)])[: len(rank)]
        rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)[1]
        depth, step = depth + step * PERIOD, step * 2
    return rank


def repeated(data: bytes, suffixes: np.ndarray, length: int) -> np.ndarray:
    """Whether the first ``length`` bytes of each suffix also start another one; all of them lie within the data."""
    place, shifts = _cover()
    padded = np.frombuffer(data + b"\0" * (length + PERIOD + 40), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)
    rank = _ranks(words, length)
    short = min(length, 32)
    keys = [words[suffixes + o] for o in range(0, short - 7, 8)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    pos, tie = suffixes[order], np.cumsum(new)
    group, same = tie.copy(), np.zeros(len(pos), bool)  # same: agrees with the one before by rank
    todo = np.arange(len(pos))
    while True:
        first = np.concatenate([[True], group[todo][1:] != group[todo][:-1]]) if len(todo) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        sizes = np.diff(np.append(begin, len(todo)))
        several = np.repeat(sizes > 1, sizes)
        todo = todo[several]
        if not len(todo):
            break
        sizes = sizes[sizes > 1]
        begin = np.cumsum(sizes) - sizes
        p = pos[todo]
        pivot = np.repeat(p[begin + sizes // 2], sizes)
        shift = shifts[p % PERIOD, pivot % PERIOD]
        a, b = p + shift, pivot + shift
        a = rank[a // PERIOD * len(COVER) + place[a % PERIOD]]
        b = rank[b // PERIOD * len(COVER) + place[b % PERIOD]]
        side = np.repeat(np.arange(len(sizes)), sizes) * 3 + np.sign(a - b) + 1
        by = np.argsort(side, kind="stable")
        pos[todo], side = p[by], side[by]
        middle = side % 3 == 1
        same[todo[1:]] |= middle[1:] & (side[1:] == side[:-1])
        group[todo] = side
        todo = todo[~middle]
    pairs = np.flatnonzero((tie[1:] == tie[:-1]) & ~same[1:]) + 1
    left, right = pos[pairs - 1], pos[pairs]
    alike = np.ones(len(pairs), bool)
    open_ = np.arange(len(pairs))
    for o in [*range(short - short % 8, length - 7, 8), length - 8]:
        equal = words[left[open_] + o] == words[right[open_] + o]
        alike[open_[~equal]] = False
        open_ = open_[equal]
    same[pairs] = alike
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros(len(pos), bool)
    out[np.searchsorted(suffixes, pos)] = twice
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _sort_block(rows: list[dict], length: int) -> Iterator[tuple[bytes, int, int]]:
    data = b"".join(r["data"] for r in rows)
    ends = np.cumsum([len(r["data"]) for r in rows])
    starts = [np.arange(e - len(r["data"]), e - length + 1) for e, r in zip(ends.tolist(), rows, strict=True)]
    flags = repeated(data, np.concatenate(starts), length)
    at = 0
    for r, own in zip(rows, starts, strict=True):
        if r["copies"] == 1:
            for first, last in _spans(flags[at : at + len(own)]):
                yield r["text"], r["start"] + first, r["start"] + last + length
        at += len(own)


_SPAN = "text binary, first long, last long"


def _span_batch(spans: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], t) for i, t in enumerate(types)], ["text", "first", "last"])


def _sort(length: int, block: int):
    """Fragments sorted by bucket to repeated spans, some whole buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []
        bucket: list[dict] = []
        size = 0
        at, seen = None, set()

        def close() -> None:
            # a lone fragment repeats only within itself
            if len(bucket) > 1 or (bucket and bucket[0]["copies"] == 1):
                ready.extend(bucket)

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != at:
                    close()
                    bucket, at, seen = [], row["bucket"], set()
                    if size >= block:
                        yield _span_batch(list(_sort_block(ready, length)) if ready else [])
                        ready, size = [], 0
                if row["digest"] not in seen:
                    seen.add(row["digest"])
                    bucket.append(row)
                    size += len(row["data"])
        close()
        if ready:
            yield _span_batch(list(_sort_block(ready, length)))

    return run


def _cut_out(length: int):
    """Texts with lists of fragments to the fragments' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, name, cuts in zip(batch["body"], batch["text"].to_pylist(), batch["cold"].to_pylist(), strict=True):
                data = text.as_py().encode("utf-8", "replace")
                for c in cuts:
                    piece = data[c["start"] : c["start"] + c["suffixes"] + length - 1]
                    rows.append((c["bucket"], c["digest"], name, c["start"], c["copies"], piece))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            names = ["bucket", "digest", "text", "start", "copies", "data"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return run


def _digests(length: int):
    """Texts with lists of hot fragments to digests of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, name, cuts in zip(batch["body"], batch["text"].to_pylist(), batch["hot"].to_pylist(), strict=True):
                data = text.as_py().encode("utf-8", "replace")
                for c in cuts:
                    at = range(c["start"], c["start"] + c["suffixes"])
                    arrays = [
                        pa.array([xxhash.xxh3_128_digest(data[i : i + length]) for i in at], pa.binary()),
                        pa.array([name] * len(at), pa.binary()),
                        pa.array(list(at), pa.int64()),
                        pa.array([c["copies"]] * len(at), pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["string", "text", "start", "copies"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with spans to what is left of them."""
    for batch in batches:
        rows = []
        for text, spans in zip(batch["body"], batch["spans"].to_pylist(), strict=True):
            data = text.as_py().encode("utf-8", "replace")
            kept, removed, runs, at = hashlib.sha256(), 0, 0, 0
            left = bytearray()
            for first, last in sorted((s["first"], s["last"]) for s in spans):
                if first > at or not runs:
                    kept.update(data[at:first])
                    left += data[at:first]
                    runs, removed, at = runs + 1, removed + last - first, last
                elif last > at:
                    removed, at = removed + last - at, last
            kept.update(data[at:])
            left += data[at:]
            rows.append((removed, runs, kept.hexdigest(), bytes(left)))
        types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch["text"], *columns], ["text", "n_removed", "n_spans", "kept_sha256", "kept"])


def _name(sha):
    return F.unhex(F.substring(sha, 1, 32))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    block: int = BLOCK,
    hot: int = HOT,
    keep_bytes: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_bytes, n_removed, n_spans, kept_sha256``.

    With ``keep_bytes`` also ``kept``: the bytes that are left where something went, else null.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lists = "bucket array<long>, start array<long>, suffixes array<long>, digest array<long>, named array<int>"
    outline = materialize(read.mapInArrow(_outline(length), f"id long, sha string, n_bytes long, {lists}"), "outlines")
    zipped = F.explode(F.arrays_zip("bucket", "start", "suffixes", "digest", "named"))
    every = outline.select(_name("sha").alias("text"), zipped.alias("f")).select("text", "f.*")
    shared = materialize(every.groupBy("bucket").agg(F.sum("named").alias("n")).where("n > 1").select("bucket"), "shared-buckets")
    # a text's fragments, once each, with the number of rows that have this text
    parts = every.join(shared, "bucket").groupBy("text", "start", "bucket", "digest", "suffixes", "named").agg(F.count("*").alias("rows"))
    parts = materialize(parts, "fragments")
    kinds = parts.groupBy("bucket", "digest").agg(
        F.sum("rows").alias("copies"),
        F.min(F.struct("text", "start")).alias("at"),
        F.first("suffixes").alias("suffixes"),
        F.first("named").alias("named"),
    )
    kinds = materialize(kinds, "kinds")
    buckets = kinds.groupBy("bucket").agg(
        F.count("*").alias("kinds"), F.sum(F.col("suffixes") + length - 1).alias("bytes"), F.max("named").alias("most"), F.min("copies").alias("few")
    )
    buckets = buckets.where("kinds > 1 or (few = 1 and most > 1)").select("bucket", (F.col("bytes") > hot).alias("is_hot"))
    wanted = kinds.join(materialize(buckets, "open-buckets"), "bucket").select(
        F.col("at.text").alias("text"),
        "is_hot",
        F.struct("bucket", "digest", F.col("at.start").alias("start"), "suffixes", "copies").alias("cut"),
    )
    cuts = wanted.groupBy("text").agg(
        F.collect_list(F.when(~F.col("is_hot"), F.col("cut"))).alias("cold"), F.collect_list(F.when(F.col("is_hot"), F.col("cut"))).alias("hot")
    )
    # of all rows with a text that has a shared bucket, one brings the text along
    touched = parts.select("text").distinct().join(
        outline.groupBy(_name("sha").alias("text")).agg(F.min("id").alias("rep")), "text"
    )
    touched = materialize(touched.join(cuts, "text", "left"), "cuts")
    bodies = read.where("text is not null").select("id", F.col("text").alias("body"), _name(F.sha2("text", 256)).alias("text"))
    bodies = bodies.join(touched, (bodies["text"] == touched["text"]) & bodies["id"].eqNullSafe(touched["rep"]))
    bodies = materialize(bodies.select(touched["text"], "body", "cold", "hot"), "touched-texts")
    cold = bodies.where(F.size("cold") > 0).select("text", "body", "cold").mapInArrow(
        _cut_out(length), "bucket long, digest long, text binary, start long, copies long, data binary"
    )
    cold = cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort(length, block), _SPAN)
    strings = bodies.where(F.size("hot") > 0).select("text", "body", "hot").mapInArrow(
        _digests(length), "string binary, text binary, start long, copies long"
    )
    strings = materialize(strings.distinct(), "hot-strings")
    again = materialize(strings.groupBy("string").agg(F.sum("copies").alias("n")).where("n > 1").select("string"), "hot-repeats")
    found = strings.where("copies = 1").join(again, "string")
    found = found.select("text", F.col("start").alias("first"), (F.col("start") + length).alias("last"))
    copied = materialize(kinds.where("copies > 1").select("bucket", "digest"), "copied")
    whole = parts.join(copied, ["bucket", "digest"]).select(
        "text", F.col("start").alias("first"), (F.col("start") + F.col("suffixes") + length - 1).alias("last")
    )
    spans = cold.unionByName(found).unionByName(whole).groupBy("text").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = materialize(spans, "spans")
    texts = bodies.select("text", "body").join(spans, "text").select("text", "body", "spans")
    cleaned = texts.mapInArrow(_remove, "text binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cleaned = cleaned if keep_bytes else cleaned.drop("kept")
    cleaned = materialize(cleaned.dropDuplicates(["text"]), "cleaned")
    rows = outline.select("id", "n_bytes", "sha", _name("sha").alias("text")).join(cleaned, "text", "left")
    return rows.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *(["kept"] if keep_bytes else []),
    )

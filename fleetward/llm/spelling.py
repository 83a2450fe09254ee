"""Spelling variants: neighbourhoods of edits, probed against Bloom filters of the vocabulary.

Words: maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z lower-cased.  A run whose CRC-32 of ``<id>:<run>`` 97
divides loses the code point at that CRC-32 modulo its length.  Results of at least ``LEAST`` code points that occur at
least ``TIMES`` times are the vocabulary; two of its words are near if one inserted, deleted or replaced code point parts
them.  A word's form is its most frequent near word if that is at least twice as frequent, its root where the forms end.

Search: the vocabulary is kept as blocked Bloom filters, sharded by the words' lengths and cut into pieces of
``PIECE`` blocks, each of which a group builds.  Passes broadcast at most ``FILTERS`` bytes of pieces each, and every word
that has edits there probes them, so what is broadcast never grows with the vocabulary; passes do.  Of the edits of a word
deletions and replacements by a smaller letter do: every pair has one of them in one direction.  Only positives are
shuffled, to an exact join with the vocabulary, which removes the false ones.  Forms are followed by pointer doubling:
each step at least doubles the count, so chains are short.

Defined results: a null text has no words; a null id counts as the empty string before the colon; rows that repeat count
each time; ties of forms go to the smallest word in code-point order; an empty table gives an empty result.  Texts and
words may have any length: words of ``LONG`` and more code points share a shard.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetward.plans.staging import Run, materialize

#: Runs of UTF-8 text whose A-Z are lower-cased: U+00C0 to U+00FF are C3 80 to C3 BF.
_RUN = re.compile(rb"[a-z]+(?:\xc3[\x80-\xbf][a-z]*)*|(?:\xc3[\x80-\xbf][a-z]*)+")
LEAST, TIMES, EVERY = 5, 3, 97
#: Letters in code-point order, and their ranks by code point.
_LETTERS = np.frombuffer(bytes([*range(97, 123), *range(0xC0, 0x100)]), np.uint8)
_RANK = np.zeros(256, np.int64)
_RANK[_LETTERS] = np.arange(len(_LETTERS))
#: Words of this many and more code points share a shard.
LONG = 64
#: Bits per word, bits set per word, blocks of 512 bits per piece, bytes of filters broadcast at a time.
BITS, SET, PIECE, FILTERS = 20, 7, 1 << 12, 32 << 20
_BLOCK = 512
#: Distinct words counted in a task before they are handed on; letters probed at a time.
_COUNTED, _CELLS = 1 << 19, 1 << 16
_U = np.uint64


# ---- words and their counts -------------------------------------------------


def runs_of(doc_id: str, text: bytes) -> Counter:
    """Words with their counts, as UTF-8, of one text."""
    found: Counter = Counter()
    before = crc32(doc_id.encode() + b":")
    for run, n in Counter(_RUN.findall(text.lower())).items():
        h = crc32(run, before)
        if h % EVERY == 0:
            points = run.decode()
            at = h % len(points)
            run = (points[:at] + points[at + 1 :]).encode()
        if len(run) - run.count(b"\xc3") >= LEAST:
            found[run] += n
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted() -> pa.RecordBatch:
        words = pa.array(list(total), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], ["word", "n"])

    total: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
            if text.is_valid:
                total.update(runs_of(doc_id, text.as_py()))
            if len(total) >= _COUNTED:
                yield counted()
                total.clear()
    if total:
        yield counted()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: counts combine in every task before the shuffle."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


# ---- hashes and filters -----------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _key(pos: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A random number per place and letter; a word's hash is the exclusive or of its letters'."""
    return _mix(((pos.astype(_U) << _U(8)) | rank.astype(_U)) + _U(0x9E3779B97F4A7C15))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places in ``words``, and the letters' ranks as a matrix, for each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for part in np.array_split(at, max(1, len(at) * int(length) // (1 << 20))):
            if len(part):
                joined = "".join(words[i] for i in part).encode("latin-1")
                yield int(length), part, _RANK[np.frombuffer(joined, np.uint8)].reshape(len(part), length)


def _hashes(ranks: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(_key(np.arange(ranks.shape[1])[None, :], ranks), axis=1)


def _place(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each hash."""
    return ((_mix(hashes) >> _U(32)) * _U(blocks)) >> _U(32)


def _marks(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of each hash in its block."""
    h = _mix(hashes ^ _U(0xD6E8FEB86659FD93))
    for i in range(SET):
        yield (h >> _U(9 * i)) & _U(_BLOCK - 1)


def shard_of(length: int) -> int:
    return min(length, LONG)


def _blocks(words: int) -> int:
    return max(1, -(-words * BITS // _BLOCK))


def _addressed(blocks: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, ranks in _by_length(batch["word"].to_pylist()):
                shard, hashes = shard_of(length), _hashes(ranks)
                block = _place(hashes, blocks[shard]).astype(np.int64)
                columns = [np.full(len(block), shard, np.int32), (block // PIECE).astype(np.int32), (block % PIECE).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(hashes.view(np.int64))], ["shard", "piece", "block", "h"])

    return run


def _built(key: tuple, rows: pa.Table) -> pa.Table:
    bits = np.zeros(PIECE * _BLOCK // 64, _U)
    block = rows["block"].to_numpy().astype(np.int64) * (_BLOCK // 64)
    for mark in _marks(rows["h"].to_numpy().view(_U)):
        np.bitwise_or.at(bits, block + (mark >> _U(6)).astype(np.int64), _U(1) << (mark & _U(63)))
    return pa.table({"shard": [key[0].as_py()], "piece": [key[1].as_py()], "bits": [bits.tobytes()]}, _PIECES)


_PIECES = pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("bits", pa.binary())])


class Filters:
    """Consecutive pieces of some shards."""

    def __init__(self, blocks: dict[int, int], pieces: list[tuple[int, int, bytes]]) -> None:
        self.blocks = blocks
        self.first: dict[int, int] = {}
        held: dict[int, list[bytes]] = {}
        for shard, piece, bits in sorted(pieces):
            self.first.setdefault(shard, piece * PIECE)
            held.setdefault(shard, []).append(bits)
        self.bits = {shard: np.frombuffer(b"".join(parts), _U) for shard, parts in held.items()}

    def hits(self, shard: int, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that the pieces at hand may hold."""
        if shard not in self.bits:
            return np.zeros(0, np.int64)
        bits = self.bits[shard]
        block = _place(hashes, self.blocks[shard]).astype(np.int64) - self.first[shard]
        at = np.flatnonzero((block >= 0) & (block < len(bits) * 64 // _BLOCK))
        block, rest = block[at] * (_BLOCK // 64), hashes[at]
        for i in range(SET):  # few hashes outlive the first marks
            h = _mix(rest ^ _U(0xD6E8FEB86659FD93))
            mark = (h >> _U(9 * i)) & _U(_BLOCK - 1)
            there = (bits[block + (mark >> _U(6)).astype(np.int64)] >> (mark & _U(63))) & _U(1) != 0
            at, block, rest = at[there], block[there], rest[there]
        return at


def edits(length: int, ranks: np.ndarray, filters: Filters) -> Iterator[tuple[int, int, int]]:
    """(row, place, rank) of each edit that the filters may hold: a replacement by a smaller letter, -1 for a deletion."""
    keys = _key(np.arange(length)[None, :], ranks)
    if shard_of(length - 1) in filters.bits and length > LEAST:
        shifted = _key(np.arange(-1, length - 1)[None, :].clip(0), ranks)
        before = np.zeros_like(keys)
        before[:, 1:] = np.bitwise_xor.accumulate(keys, axis=1)[:, :-1]
        after = np.zeros_like(keys)
        after[:, :-1] = np.bitwise_xor.accumulate(shifted[:, :0:-1], axis=1)[:, ::-1]
        last = np.ones(ranks.shape, bool)  # of equal letters in a row one deletion does
        last[:, :-1] = ranks[:, 1:] != ranks[:, :-1]
        row, place = np.nonzero(last)
        at = filters.hits(shard_of(length - 1), (before ^ after)[row, place])
        yield from zip(row[at].tolist(), place[at].tolist(), [-1] * len(at), strict=True)
    if shard_of(length) in filters.bits:
        whole = np.bitwise_xor.reduce(keys, axis=1)
        flat, flat_keys = ranks.ravel(), keys.ravel()
        for begin in range(0, flat.size, _CELLS):
            rank = flat[begin : begin + _CELLS]
            cell = np.repeat(np.arange(begin, begin + len(rank)), rank)
            new = np.arange(len(cell)) - np.repeat(np.cumsum(rank) - rank, rank)
            row, place = cell // length, cell % length
            at = filters.hits(shard_of(length), whole[row] ^ flat_keys[cell] ^ _key(place, new))
            yield from zip(row[at].tolist(), place[at].tolist(), new[at].tolist(), strict=True)


def _probe(filters: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filters.value
        for batch in batches:
            words, counts = batch["word"].to_pylist(), batch["n"].to_pylist()
            found: list[tuple[str, str, int]] = []
            for length, at, ranks in _by_length(words):
                for row, place, rank in edits(length, ranks, held):
                    word = words[at[row]]
                    letter = chr(_LETTERS[rank]) if rank >= 0 else ""
                    found.append((word[:place] + letter + word[place + 1 :], word, counts[at[row]]))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["guess", "word", "n"]
            )

    return run


def _passes(blocks: dict[int, int], most: int) -> list[list[tuple[int, int]]]:
    """(shard, piece) in order, in passes of at most ``most`` bytes."""
    pieces = [(shard, piece) for shard in sorted(blocks) for piece in range(-(-blocks[shard] // PIECE))]
    step = max(1, most * 8 // (PIECE * _BLOCK))
    return [pieces[i : i + step] for i in range(0, len(pieces), step)]


def near_pairs(spark: SparkSession, words: DataFrame, run: Run, most: int = FILTERS) -> DataFrame:
    """``word, n, other, other_n``: every pair of near words of ``words`` (``word, n``) once."""
    shard = F.least(F.length("word"), F.lit(LONG)).cast("int")
    sizes = {r["shard"]: r["count"] for r in words.groupBy(shard.alias("shard")).count().collect()}  # at most LONG
    blocks = {s: _blocks(n) for s, n in sizes.items()}
    addressed = words.select("word").mapInArrow(_addressed(blocks), "shard int, piece int, block int, h long")
    built = addressed.groupBy("shard", "piece").applyInArrow(_built, "shard int, piece int, bits binary")
    pieces = run.stage(built.repartitionByRange("shard", "piece").sortWithinPartitions("shard", "piece"), "filters")
    guesses = None
    for i, group in enumerate(_passes(blocks, most)):
        (s0, p0), (s1, p1) = group[0], group[-1]
        here = F.col("shard").between(s0, s1) & ((F.col("shard") > s0) | (F.col("piece") >= p0)) & ((F.col("shard") < s1) | (F.col("piece") <= p1))
        held = [(r["shard"], r["piece"], bytes(r["bits"])) for r in pieces.where(here).collect()]  # at most FILTERS bytes
        shared = spark.sparkContext.broadcast(Filters(blocks, held))
        asking = words.where((shard >= s0) & (shard <= s1 + 1))
        found = run.stage(asking.mapInArrow(_probe(shared), "guess string, word string, n long"), f"guesses-{i}")
        shared.destroy()
        guesses = found if guesses is None else guesses.unionByName(found)
    if guesses is None:
        guesses = spark.createDataFrame([], "guess string, word string, n long")
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return guesses.join(known, guesses["guess"] == known["other"]).select("word", "n", "other", "other_n")


# ---- forms and roots --------------------------------------------------------


def follow(forms: DataFrame, run: Run) -> DataFrame:
    """``word, root``: where the forms (``word, form``, without cycles) lead from each word that has one."""
    at = run.stage(forms.select("word", F.col("form").alias("root")), "roots-0")
    for i in range(1, 64):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = run.stage(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved")), f"roots-{i}")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FILTERS) -> DataFrame:
    """One row per word of the vocabulary: ``word, form, root, n, n_near, form_n``."""
    spark = docs.sparkSession
    run = Run(spark, "spelling")
    words = run.stage(vocabulary(docs, id_col, text_col), "vocabulary")
    pairs = run.stage(near_pairs(spark, words, run, most), "pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    twice = -F.col("best.less") >= 2 * F.col("n")
    near = run.stage(near.select("word", "n_near", F.when(twice, F.col("best.other")).alias("form"), F.when(twice, -F.col("best.less")).alias("form_n")), "near")
    roots = follow(near.where("form is not null"), run)
    rows = words.join(near, "word", "left").join(roots, "word", "left")
    result = rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    result = materialize(result, "spelling-variants")
    run.drop()
    return result

"""Periodic runs of words: block convolution at dyadic scales.

A run of a text is a stretch of words with smallest period q that is at least ``EXPONENT`` q and ``SHORTEST`` words long
and that no neighbouring word extends.  If B is the largest power of two up to q, such a stretch holds a whole block
``[mB, mB + B)`` together with the block's copy q words on, and B <= q < 2B.  So for B = 1, 2, 4, ... every block is
looked for at the distances B to 2B - 1: the sum of squared differences of word numbers at each distance comes from one
convolution of the block with the window that follows it, by number-theoretic transforms modulo two primes, and is zero
just where the block occurs.  Distances found seed extensions by comparing words, which give the runs and would refuse a
sum that is only zero modulo both primes.  A block that cannot occur, because one of its words does not, is left out;
so is one that lies, window and all, in a run of a smaller period, whose distances are multiples of that period.

The texts of a task are joined into sequences of about ``JOINED`` words, with separators that equal nothing, and handled
together; a longer text is a sequence of its own.

Defined results: a null, empty or blank text has no words and no run, and its digests are those of nothing; a null id
rewrites nothing; rows that repeat are judged one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest run in words, and in periods.
SHORTEST, EXPONENT = 6, 4
#: Words of texts handled together, and numbers transformed at a time.
JOINED, _CHUNK = 1 << 19, 1 << 20
#: Primes with long power-of-two roots, and a generator of each.
_PRIMES = ((998244353, 3), (2013265921, 31))

Run = tuple[int, int, int]  # start, length, period


# ---- exact convolutions -----------------------------------------------------


@lru_cache(maxsize=64)
def _roots(size: int, prime: int, generator: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a primitive root of unity of order ``size``, and of its inverse."""
    root = pow(generator, (prime - 1) // size, prime)
    out = []
    for r in (root, pow(root, prime - 2, prime)):
        powers = np.ones(max(1, size // 2), np.uint64)
        done = 1
        while done < len(powers):  # by doubling: the second half is the first times a power
            step = min(done, len(powers) - done)
            powers[done : done + step] = powers[:step] * np.uint64(pow(r, done, prime)) % np.uint64(prime)
            done += step
        out.append(powers)
    return out[0], out[1]


def _transform(rows: np.ndarray, prime: int, powers: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in natural order (self-sorting butterflies)."""
    p = np.uint64(prime)
    m, size = rows.shape
    x, span = rows.reshape(m, size, 1), 1
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        a, b = x[:, :half], x[:, half:]
        twiddle = powers[::span][:half].reshape(1, half, 1)
        # a block of ``half`` values of ``span`` places each becomes one of twice the places
        out = np.empty((m, half, 2, span), np.uint64)
        out[:, :, 0] = (a + b) % p
        out[:, :, 1] = (a + p - b) % p * twiddle % p
        x, span = out.reshape(m, half, 2 * span), 2 * span
    return x.reshape(m, size)


def mismatches(blocks: np.ndarray, windows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Sums of squared differences of each block (width B) and its window (width 2B) at the places 0 to B - 1, modulo a prime."""
    m, width = blocks.shape
    size, p = 2 * width, np.uint64(prime)
    forward, back = _roots(size, prime, generator)
    turned = np.zeros((m, size), np.uint64)
    turned[:, (-np.arange(width)) % size] = blocks
    product = _transform(windows % p, prime, forward) * _transform(turned % p, prime, forward) % p
    cross = _transform(product, prime, back)[:, :width] * np.uint64(pow(size, prime - 2, prime)) % p
    squares = np.cumsum(windows * windows % p, axis=1)  # fewer than 2^31 terms below 2^31
    before = np.zeros((m, width), np.uint64)
    before[:, 1:] = squares[:, : width - 1]
    there = (squares[:, width - 1 : 2 * width - 1] - before) % p
    own = (blocks * blocks % p).sum(axis=1)[:, None] % p
    return (own + there + np.uint64(2) * (p - cross)) % p


# ---- runs of a sequence of numbers ------------------------------------------


class _Later:
    """Where a word occurs again, by binary search among all places sorted by word."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.n = words, len(words)
        self.keys = np.sort(words.astype(np.int64) * self.n + np.arange(self.n))

    def within(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the words at ``at`` occur again ``low`` to ``high`` places on."""
        base = self.words[at].astype(np.int64) * self.n
        found = np.searchsorted(self.keys, base + np.minimum(at + low, self.n))
        return (self.keys[np.minimum(found, self.n - 1)] <= base + np.minimum(at + high, self.n - 1)) & (found < self.n)


def _candidates(later: _Later, width: int, reach: np.ndarray) -> np.ndarray:
    """Starts of the blocks all of whose words occur again at a distance of this scale, but for those within a known run."""
    starts = np.arange(0, later.n - 2 * width + 1, width)
    if width == 1:
        return starts[later.words[starts] == later.words[starts + 1]]
    starts = starts[reach[starts] < np.minimum(starts + 3 * width, later.n)]
    done, step = 0, 1
    while done < width and len(starts):
        offsets = np.arange(done, min(done + step, width))
        asked = (starts[:, None] + offsets[None, :]).ravel()
        starts = starts[later.within(asked, width, 2 * width - 1).reshape(len(starts), -1).all(axis=1)]
        done, step = done + len(offsets), 2 * step
    return starts


def _seeds(words: np.ndarray, starts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks and the distances at which they occur, in chunks."""
    nothing = np.uint64(words.max() + 1)  # behind the end; equals no word
    step = max(1, _CHUNK // (2 * width))
    for i in range(0, len(starts), step):
        part = starts[i : i + step]
        at = part[:, None] + np.arange(3 * width)[None, :]
        values = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], nothing).astype(np.uint64)
        zero = np.ones((len(part), width), bool)
        for prime, generator in _PRIMES:
            zero &= mismatches(values[:, :width], values[:, width:], prime, generator) == 0
        row, place = np.nonzero(zero)
        yield part[row], place + width


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays of one length."""
    done, step = 0, 64
    while done < len(a):
        same = a[done : done + step] == b[done : done + step]
        if not same.all():
            return done + int(np.argmin(same))
        done, step = done + len(same), 4 * step
    return len(a)


def find_runs(words: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers from 0, by start, then period."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}  # start and end: smallest period
    if n < SHORTEST:
        return []
    later = _Later(words)
    ends = np.zeros(n, np.int64)  # by start: the furthest end of a known run
    reach = ends  # by place: the furthest end of a known run that starts there or before
    width = 1
    while EXPONENT * width <= n:
        known = len(found)
        reached: dict[int, int] = {}  # by distance: end of the last stretch with that period
        for at, distance in _seeds(words, _candidates(later, width, reach), width):
            new = reach[at] < at + distance + width  # in a run of a smaller period the distance is a multiple of it
            for i, d in zip(at[new].tolist(), distance[new].tolist(), strict=True):
                if i + d < reached.get(d, 0):
                    continue
                end = i + d + _agree(words[i : n - d], words[i + d :])
                start = i - _agree(words[:i][::-1], words[d : i + d][::-1])
                reached[d] = end
                if end - start >= max(SHORTEST, EXPONENT * d) and (start, end) not in found:
                    found[start, end] = d
                    ends[start] = max(ends[start], end)
        if len(found) > known:
            reach = np.maximum.accumulate(ends)
        width *= 2
    return sorted((start, end - start, d) for (start, end), d in found.items())


# ---- texts ------------------------------------------------------------------


def rewritten(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, by a digest of its id, repeated from some word on; others as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _described(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    kept: list[bytes] = []
    done = 0
    dropped = sorted((start + q, start + length) for start, length, q in runs)
    for begin, end in dropped:
        if begin > done:
            kept += words[done:begin]
        done = max(done, end)
    kept += words[done:]
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    top: tuple = (None, None, None, None)
    if runs:
        best = runs[0]
        for run in runs[1:]:  # exact ratios; runs come by start, then period
            if run[1] * best[2] > best[1] * run[2]:
                best = run
        top = (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *top, sha256(lines.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest())


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def described(texts: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
    """Rows of some texts, whose words are numbered and searched together."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    bounds, parts = [0], []
    for i, (_, words) in enumerate(texts):
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([-1 - i]))  # a separator
        bounds.append(bounds[-1] + len(words) + 1)
    joined = np.concatenate(parts)
    joined = np.where(joined < 0, len(numbers) - 1 - joined, joined)
    runs: list[list[Run]] = [[] for _ in texts]
    for start, length, q in find_runs(joined):
        at = int(np.searchsorted(bounds, start, side="right")) - 1
        runs[at].append((start - bounds[at], length, q))
    for (doc_id, words), own in zip(texts, runs, strict=True):
        yield _described(doc_id, words, own)


def _search(rewrite: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            columns = zip(*described(held), strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _SCHEMA.split(", ")])

        held: list[tuple[int | None, list[bytes]]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()
                words = rewritten(doc_id, words) if rewrite else words
                if held and size + len(words) > JOINED:
                    yield flush()
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words) + 1
        if held:
            yield flush()

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False) -> DataFrame:
    """One row per row of ``docs``: its runs counted, the one of the greatest exponent, and digests of runs and kept words.

    A word is kept unless some run holds it behind its first period.  With ``rewrite`` one document in ten is made
    periodic first (``rewritten``).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_search(rewrite), _SCHEMA).withColumnRenamed("doc_id", id_col)

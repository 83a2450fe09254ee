"""Best-fit packing of documents into sequences by bin completion.

Documents are cut into pieces of at most ``capacity`` tokens; packing the pieces into as few sequences as possible is bin
packing with integer sizes.  The pieces are dealt evenly over tasks, ``PER_TASK`` to each, and every task packs its own:
on average that wastes less than one sequence per task, some hundredths of a percent, and bounds memory at any size.

Within a task, best-fit decreasing gives the first incumbent.  Bin completion then fills one sequence after another
around the largest document left, trying all undominated fillings (a filling is dominated if one of its documents, or
two of them together, could be replaced by a larger one that still fits, or if another document still fits).  They are
enumerated as they are asked for, those of the largest documents first.  A branch is cut once the waste so far exceeds
what a better solution than the incumbent may waste; a better solution becomes the incumbent.  The search ends when the
incumbent meets the bound ``ceil(tokens / capacity)``, when everything has been tried, or after ``steps`` documents tried
per piece: nothing else limits it.

Token ids are those of the ``tokenizers`` library for the given file, without special tokens around the text.
``tiktoken`` computes them from that file's vocabulary, four times as fast; a test compares the two libraries over texts
of every kind.  With ``added`` the strings of the file's added tokens become their ids, as that library does unless told
otherwise; without, as with its ``encode_special_tokens``, they are read as ordinary text.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.plans.staging import materialize

CAPACITY = 1024
#: Pieces packed by one task.
PER_TASK = 20_000
#: Documents tried per piece; sizes tried at each place of a filling before more are, steps between two fillings.
STEPS, WIDTH, BURST = 32, 3, 64


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Ids of the vocabulary in a ``tokenizers`` file with byte-level pieces; ``added`` finds its added tokens in texts."""

    def __init__(self, path: str, pattern: str, added: bool = False) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, w)): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        if added and any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that depend on the text around them are not supported")
        self.found = set(special) if added else set()

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=self.found, disallowed_special=()).astype("<u4")


@lru_cache(maxsize=2)
def tokens(path: str, pattern: str, added: bool = False) -> Tokens:
    return Tokens(path, pattern, added)


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be shorter than ``capacity``."""
    first = len(ids) % capacity or capacity
    start = 0
    for end in range(first, len(ids) + 1, capacity):
        yield start, end - start
        start = end


def pieces(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int, id_col: str, text_col: str, added: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path, pattern, added)
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(own.ids(text.as_py() or ""), np.array([end_id], "<u4"))
                raw = ids.tobytes()
                for k, (start, length) in enumerate(cut(ids, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    schema = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: every size goes to the fullest sequence that still takes it."""
    filled: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: there is a sequence with room r
    for size in sorted(sizes, reverse=True):
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
            filled[at].append(size)
        else:
            at, room = len(filled), capacity
            filled.append([size])
        with_room[room - size].append(at)
        mask |= 1 << (room - size)
    return filled


class Sizes:
    """A multiset of sizes with the largest one up to a bound at hand."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.count, self.mask = [0] * (capacity + 1), 0
        for s in sizes:
            self.put(s)

    def put(self, size: int) -> None:
        self.count[size] += 1
        self.mask |= 1 << size

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.mask ^= 1 << size

    def up_to(self, bound: int) -> int:
        """The largest size up to ``bound``, or 0."""
        return (self.mask & ((2 << bound) - 1)).bit_length() - 1 if bound > 0 and self.mask & ((2 << bound) - 1) else 0

    def between(self, low: int, high: int) -> bool:
        return bool(self.mask >> low & ((1 << (high - low + 1)) - 1)) if low <= high else False


class Budget:
    """Steps that are left."""

    def __init__(self, steps: int) -> None:
        self.left = steps


def _maximal(left: Sizes, room: int, width: int, budget: Budget) -> Iterator[tuple[int, list[int]] | None]:
    """(waste, sizes) that take no further size, with the ``width`` largest that fit at each place; None if sizes were left out.

    ``left`` is only read, so it may change while the next one is not yet asked for, as long as it changes back.
    """
    chosen: list[int] = []
    tried = [0]
    rest = top = room
    narrow = False
    while budget.left > 0:
        size = left.up_to(min(rest, top))
        if chosen and size == chosen[-1] and chosen.count(size) >= left.count[size]:
            size = left.up_to(size - 1)
        if size and tried[-1] < width:
            budget.left -= 1
            tried[-1] += 1
            tried.append(0)
            chosen.append(size)
            rest -= size
            top = size
            continue
        if size:
            narrow = True
        elif not tried[-1]:
            yield rest, list(chosen)
        if not chosen:
            break
        tried.pop()
        last = chosen.pop()
        rest += last
        top = last - 1
    if narrow and budget.left > 0:
        yield None


def _dominated(left: Sizes, chosen: list[int], waste: int) -> bool:
    for size in chosen:
        left.take(size)
    found = (
        left.between(1, waste)
        or (waste > 0 and any(left.between(c + 1, c + waste) for c in chosen))
        or any(left.between(p, p + waste) for p in {a + b for i, a in enumerate(chosen) for b in chosen[:i]})
    )
    for size in chosen:
        left.put(size)
    return found


def fillings(left: Sizes, room: int, most: int, budget: Budget) -> Iterator[tuple[int, list[int]]]:
    """All undominated fillings of ``room`` with a waste up to ``most``, as (waste, sizes).

    Those of the largest sizes at each place are looked at first, then of more and more sizes, until all have been.  One
    without waste is handed out at once; otherwise the least wasteful of every ``BURST`` steps.
    """
    width, seen = WIDTH, set()
    while True:
        found: list[tuple[int, list[int]]] = []
        narrow, since = False, budget.left
        for leaf in _maximal(left, room, width, budget):
            if leaf is None:
                narrow = True
                break
            waste, chosen = leaf
            if waste <= most and tuple(chosen) not in seen and not _dominated(left, chosen, waste):
                seen.add(tuple(chosen))
                if not waste:
                    yield leaf
                    since = budget.left
                else:
                    heappush(found, leaf)
            if found and since - budget.left > BURST:
                yield heappop(found)
                since = budget.left
        while found:
            yield heappop(found)
        if not narrow:
            return
        width *= 2


def bin_completion(sizes: list[int], capacity: int = CAPACITY, steps: int = STEPS) -> list[list[int]]:
    """Sequences of sizes: depth-first over fillings, cut by waste, from a best-fit incumbent."""
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = -(-total // capacity)
    budget = Budget(steps * len(sizes))
    left = Sizes(sizes, capacity)
    path: list[list[int]] = []  # sequences filled so far
    options: list[tuple[int, Iterator[tuple[int, list[int]]]]] = []  # the largest size of each, and what may fill the rest
    wasted = [0]

    def allowed() -> int:
        """What a solution with one sequence less may still waste."""
        return (len(best) - 1) * capacity - total - wasted[-1]

    def descend() -> None:
        largest = left.up_to(capacity)
        left.take(largest)
        options.append((largest, fillings(left, capacity - largest, allowed(), budget)))

    if sizes:
        descend()
    while len(best) > bound and budget.left > 0 and options:
        largest, more = options[-1]  # its largest size is taken; what fills the rest of an earlier choice is not
        found = next(more, None)
        if found is None or found[0] > allowed():
            options.pop()
            left.put(largest)
            if path:
                for size in path.pop()[1:]:
                    left.put(size)
                wasted.pop()
            continue
        budget.left -= 1
        waste, chosen = found
        for size in chosen:
            left.take(size)
        path.append([largest, *chosen])
        wasted.append(wasted[-1] + waste)
        if left.mask:
            descend()
            continue
        if len(path) < len(best):
            best = [list(p) for p in path]
        for size in path.pop()[1:]:
            left.put(size)
        wasted.pop()
    return best


def _pack(capacity: int, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        order = np.lexsort([rows[c].to_numpy() for c in ("ids_crc32", "start")] + [rows["length"].to_numpy()])
        by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
        lengths = rows["length"].to_pylist()
        for i in reversed(order.tolist()):
            by_size[lengths[i]].append(i)
        sequence = np.zeros(len(lengths), np.int64)
        offset = np.zeros(len(lengths), np.int64)
        first = TaskContext.get().partitionId() << 32
        filled = [[capacity]] * len(by_size[capacity])
        filled += bin_completion([n for n in lengths if n < capacity], capacity, steps)
        for k, sizes in enumerate(filled):
            at = 0
            for size in sizes:
                i = by_size[size].pop()
                sequence[i], offset[i] = first + k, at
                at += size
        table = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from table.combine_chunks().to_batches()

    return run


def pack_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    per_task: int = PER_TASK,
    steps: int = STEPS,
    id_col: str = "doc_id",
    text_col: str = "text",
    added: bool = False,
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Defined results: a null text counts as empty and is a document of one token, the end id; rows that repeat an id are
    separate documents; an empty table gives an empty result; other columns are not read.
    """
    cut_up = materialize(pieces(docs, path, pattern, end_id, capacity, id_col, text_col, added), "pieces")
    tasks = max(1, -(-cut_up.count() // per_task))
    schema = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return cut_up.repartition(tasks).mapInArrow(_pack(capacity, steps), schema)

"""Byte-level BPE by longest matches and backtracking: exact merges in linear time.

A piece's bytes are mapped to Latin-1, so that one pass of an Aho-Corasick automaton over the vocabulary finds the
longest token at every position.  The encoding is built from the left: take the longest token that is *compatible* with
the one before it, fall back to shorter prefixes, and step back over a token when no prefix fits.  A position that failed
once is closed, so the work is linear in the piece.  Two adjacent tokens are compatible if encoding their joined bytes
gives these two tokens again; that is decided by undoing their merges in turn and is memoised.  An encoding all of whose
neighbours are compatible is the one that merging by rank makes.

Like the public libraries, a piece that is itself a token becomes that token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces, and pairs of neighbours, remembered by one worker; a piece over the second bound is not remembered.
MEMO, LONG_PIECE = 300_000, 64
#: Longest text, in characters, whose pieces are listed at once.
AT_ONCE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file, which every worker must be able to open."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Memo(dict):
    """piece -> ids, computed on first use, emptied when full."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece.encode("utf-8", "replace")))
        if len(self) >= MEMO:
            self.clear()
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.token}
        self.split_text = regex.compile(pattern)
        self.made_of: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for rank, token in sorted(self.token.items()):
            self._learn(rank, token)
        if never := {r for r, (left, _) in self.made_of.items() if left == r and len(self.token[r]) > 1}:
            for rank, prefix in self.shorter.items():
                while prefix in never:
                    prefix = self.shorter[prefix]
                self.shorter[rank] = prefix
        self.automaton.make_automaton()
        self.fits.clear()
        self.memo = _Memo(self.encode_piece)

    def _prefix(self, token: bytes) -> int | None:
        return next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), None)

    def _learn(self, rank: int, token: bytes) -> None:
        """The two tokens whose merge makes this one; a longer token that no merge makes only stands for a whole piece."""
        self.shorter[rank] = left = self._prefix(token)
        self.made_of[rank] = (rank, rank)
        while left is not None:
            right = self.ranks.get(token[len(self.token[left]) :])
            if right is not None and left < rank and right < rank and self._compatible(left, right):
                self.merged[left, right] = rank
                self.made_of[rank] = (left, right)
                break
            left = self.shorter[left] if left in self.shorter else self._prefix(self.token[left])
        if left is not None or len(token) == 1:
            self.automaton.add_word(token.decode("latin-1"), rank)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between two neighbours alone.

        Undo the merges in the reverse of the order in which they were made: if the tokens that met at the border at some
        time could be merged before the next merge on either side, that merge came first and the border is not there.
        """
        bound = None  # merges of this rank and later ones are undone
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and (bound is None or joint < bound):
                return False
            parts_left, parts_right = self.made_of[left], self.made_of[right]
            whole_left, whole_right = parts_left[1] == left, parts_right[0] == right
            if whole_left and whole_right:
                return True
            if whole_right or (not whole_left and left > right):
                bound, left = left, parts_left[1]
            else:
                bound, right = right + 1, parts_right[0]

    def _next_to(self, left: int, right: int) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            found = self.fits[left, right] = self._compatible(left, right)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [0] * len(piece)
        token_bytes = self.token
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - len(token_bytes[token])] = token  # ends ascend, so the last one is the longest
        unfit = bytearray(len(piece) + 1)
        ids: list[int] = []
        at = 0
        token: int | None = longest[0] if piece else None
        while at < len(piece):
            while token is not None:
                end = at + len(token_bytes[token])
                if not unfit[end] and (not ids or self._next_to(ids[-1], token)):
                    break
                token = self.shorter[token]
            if token is None:
                unfit[at] = 1
                token = ids.pop()
                at -= len(token_bytes[token])
                token = self.shorter[token]
                continue
            ids.append(token)
            at = end
            token = longest[at] if at < len(piece) else None
        return ids

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in blocks."""
        if len(text) <= AT_ONCE:
            yield list(chain.from_iterable(map(self.memo.__getitem__, self.split_text.findall(text))))
            return
        pieces = (m.group() for m in self.split_text.finditer(text))
        while block := list(islice(pieces, AT_ONCE >> 3)):
            yield list(chain.from_iterable(map(self.memo.__getitem__, block)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder per worker and vocabulary."""
    return BytePairEncoder(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids``: the token ids of every whole text; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                ids = list(chain.from_iterable(bpe.encode(text.as_py() or "")))
                one = pa.array([ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, 1).cast(pa.int64()), one], [id_col, "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids: ``id_col, n_tokens, ids_sha256, decoded_sha256``.

    Defined results: a null text counts as empty, which has no ids; rows that repeat an id are coded one by one; an empty
    table gives an empty result; other columns are not read.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for text in batch["text"]:
                count, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in bpe.encode(text.as_py() or ""):
                    ids_hash.update((("," if count and ids else "") + ",".join(map(bpe.decimal.__getitem__, ids))).encode())
                    bytes_hash.update(bpe.decode(ids))
                    count += len(ids)
                rows.append((count, ids_hash.hexdigest(), bytes_hash.hexdigest()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].cast(pa.int64()), *columns], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)

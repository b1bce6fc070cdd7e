"""Byte-level BPE encoding and decoding over whole documents.

Each match of the pre-token pattern is encoded by itself. A pre-token that is a vocabulary entry is one id.
Any other is a linked list of parts; a *rank queue* says which neighbours merge next. The queue holds a
bucket of list positions for each merge rank and a two-level bitmap of the ranks whose buckets have
entries: find-first-set on the upper level, then on one block of the lower, gives the least rank in
constant time, so a pre-token of n bytes takes n log n steps, however long it is. An entry is stale, and is
skipped, when its position has been merged away or now begins a pair of another rank. In a bucket the
leftmost position comes first, which is the order of the reference merge rule.

Null and empty texts have no ids and decode to nothing. Repeated rows each get a row. The ranks and the
pattern are parameters; the vocabulary has a fixed size and each Python worker loads it once.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

BLOCK = 256
BIT = [1 << k for k in range(BLOCK)]
#: Encoded pre-tokens that a worker keeps; beyond that it starts afresh.
KEPT = 1_000_000
ARROW = {"array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}


@functools.lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Pieces(dict):
    """Ids of the pre-tokens met so far; others are encoded when they are asked for."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(self) >= KEPT:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.text = {rank: str(rank) for rank in self.tokens}
        self.blocks = [0] * (max(ranks.values()) // BLOCK + 1)  # all 0 between pre-tokens
        self.known = Pieces(self.piece)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token that is not itself in the vocabulary.

        ``buckets`` maps a rank to its positions, ``blocks`` and ``upper`` are the two levels of the bitmap.
        """
        rank_of, blocks, bit, n = self.ranks.get, self.blocks, BIT, len(piece)
        buckets: dict[int, list[int]] = {}
        upper = 0
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    blocks[rank >> 8] |= bit[rank & 255]
                    upper |= bit[rank >> 8]
        while upper:
            block = (upper & -upper).bit_length() - 1
            bits = blocks[block]
            rank = (block << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                blocks[block] = bits = bits & (bits - 1)
                if not bits:
                    upper &= upper - 1
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            after[i] = end = after[gone]
            pair[gone] = None
            left = before[i]
            if end < n:
                before[end] = i
                pair[i] = new = rank_of(piece[i : after[end]])
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        blocks[new >> 8] |= bit[new & 255]
                        upper |= bit[new >> 8]
            else:
                pair[i] = None
            if left >= 0:
                new = rank_of(piece[left:end])
                if new != pair[left]:
                    pair[left] = new
                    if new is not None:
                        if new in buckets:
                            heappush(buckets[new], left)
                        else:
                            buckets[new] = [left]
                            blocks[new >> 8] |= bit[new & 255]
                            upper |= bit[new >> 8]
        ids, i = [], 0
        while i < n:
            ids.append(rank_of(piece[i : after[i]]))
            i = after[i]
        return ids

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else tuple(self.merge(raw))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without special tokens."""
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary file."""
    gc.set_threshold(200_000)  # the codec makes many small lists and no cycles
    return Codec(load_ranks(path), pattern)


def _map(df: DataFrame, out: str, path: str, pattern: str, row: Callable) -> DataFrame:
    """Apply ``row(codec, second column)`` to each row, keeping the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                columns = list(zip(*(row(own, x.as_py()) for x in part.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns, kinds)], names=fields)

    schema = f"`{df.columns[0]}` {df.dtypes[0][1]}, {out}"
    fields = [df.columns[0], *(x.split()[0] for x in out.split(", "))]
    kinds = [ARROW[x.split()[1]] for x in out.split(", ")]
    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    return _map(docs.select(id_col, text_col), "ids array<int>", path, pattern, lambda own, text: (own.encode(text or ""),))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of every row of ids; a null list decodes to nothing."""
    return _map(encoded.select(id_col, ids_col), "decoded binary", path, pattern, lambda own, ids: (own.decode(ids or []),))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary): both directions in one pass, so the ids do not travel twice."""

    def both(own: Codec, text: str | None) -> tuple:
        ids = own.encode(text or "")
        return ids, own.decode(ids)

    return _map(docs.select(id_col, text_col), "ids array<int>, decoded binary", path, pattern, both)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the round trip, digested where it is made."""

    def digest(own: Codec, text: str | None) -> tuple:
        ids = own.encode(text or "")
        joined = ",".join(map(own.text.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _map(docs.select(id_col, text_col), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", path, pattern, digest)

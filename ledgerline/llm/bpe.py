"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of parts. For every adjacent pair with a merge rank, its left position is
put in the bucket of that rank; a three-level bitmap over ranks finds the lowest non-empty bucket by
find-first-set. Entries are never deleted: a popped position counts only if its pair still has that rank.
Within a bucket the leftmost position goes first, so merges run in the order of the reference library's.
A pre-token of n bytes costs O(n log n), whatever its length.

Defined results: a null text is empty; empty text has no tokens; repeated rows are encoded one by one;
a text of any length is handled whole; of equal pairs the leftmost is merged first; an empty table gives no rows; only doc_id and text are
read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"
#: Pre-tokens whose ids a worker remembers, and the longest of them in code points.
CACHE_TOKENS, CACHE_LENGTH = 600_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by rank under a bitmap of 64-bit words, itself under two more levels."""

    def __init__(self, n_ranks: int) -> None:
        self.low = [0] * (n_ranks // 64 + 1)
        self.mid = [0] * (n_ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int]:
        """(lowest rank, its leftmost position); rank -1 if all buckets are empty."""
        if not self.top:
            return -1, -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[b] &= ~(1 << (rank & 63))
            if not self.low[b]:
                self.mid[a] &= ~(1 << (b & 63))
                if not self.mid[a]:
                    self.top &= ~(1 << a)
        return rank, position


class ByteBpe:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.size = max(self.ranks.values(), default=0) + 1
        self.bytes_of = [b""] * self.size
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.text_of = [str(i) for i in range(self.size)]
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(self.size)
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ends, before, rank_at = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        queue, get = self.queue, ranks.get
        for i in range(n - 1):
            r = get(piece[i : i + 2], -1)
            if r >= 0:
                rank_at[i] = r
                queue.push(r, i)
        # ends[i] is where the part that starts at i ends, and 0 once it has been merged into its left neighbour.
        while True:
            r, i = queue.pop()
            if r < 0:
                break
            if not ends[i] or rank_at[i] != r:
                continue
            j = ends[i]
            ends[i], ends[j] = ends[j], 0
            stop = ends[i]
            rank_at[i] = rank_at[j] = -1
            if stop < n:
                before[stop] = i
                r = get(piece[i : ends[stop]], -1)
                if r >= 0:
                    rank_at[i] = r
                    queue.push(r, i)
            h = before[i]
            if h >= 0:
                r = get(piece[h:stop], -1)
                rank_at[h] = r
                if r >= 0:
                    queue.push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def encode(self, text: str) -> list[int]:
        cache = self.cache
        pieces = self.split(text)
        if len(cache) > CACHE_TOKENS:
            cache.clear()
        long = {}
        for piece in set(pieces).difference(cache):
            ids = tuple(self.encode_piece(piece.encode("utf-8")))
            if len(piece) <= CACHE_LENGTH:
                cache[piece] = ids
            else:
                long[piece] = ids
        if long:
            return list(chain.from_iterable(cache.get(p) or long[p] for p in pieces))
        return list(chain.from_iterable(map(cache.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return K.held(("bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The operator's real output: doc_id and its array of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in K.slices(batches):
            rows = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _input(docs).mapInArrow(K.tidy(run), "doc_id long, ids array<int>")


def decode_tokens(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of its array of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            rows = [bpe.decode(i or ()) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(K.tidy(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the encoded ids and of the bytes decoded from those ids; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        text_of, sha = bpe.text_of, hashlib.sha256
        for b in K.slices(batches):
            counts, of_ids, of_bytes, sizes = [], [], [], []
            for t in b.column("text").to_pylist():
                ids = bpe.encode(t or "")
                back = bpe.decode(ids)
                counts.append(len(ids))
                of_ids.append(sha(" ".join(map(text_of.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(sha(back).hexdigest())
                sizes.append(len(back))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (counts, of_ids, of_bytes, sizes))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return _input(docs).mapInArrow(K.tidy(run), SCHEMA)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

"""Exact top-k search over an impact-ordered, score-at-a-time index.

Components become integers floor(1024 * x). In each block of vectors and each dimension, postings are parted
into segments of equal quantised value (value >> SHIFT). For a query, a segment's impact is the most that it can
add over the least value of its dimension, in the direction of the query's weight. Segments are processed
by descending impact, in rounds under a falling bound. After a round, a vector's score lies between what it
has gathered and that plus the bound for every dimension in which it hasn't been met. Processing stops only
when this proves that all vectors but a few lie under the k-th best lower bound (or under the k-th exact
score of the task's earlier blocks); those few are scored exactly.

Queries are the stated set of rows, taken in blocks of a fixed size: only such a block is sent to the tasks.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a shorter vector
counts as filled up with zeros; a null id takes no part; a query's own row is any row with its id; rows that share an id but not a
vector are queries of their own, equal query rows count once, repeated candidates each; extra columns are ignored, whatever their names; with fewer candidates than k all are returned; equal scores go by the smaller id; an empty
table gives no rows. Blocks whose numbers are too large for exact bounds in floating point are scored directly in
integers of any size; a score beyond a long counts as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import ragged, tidy

SHIFT = 5
#: Vectors in a block of the index, queries sent at once, and vectors that may be left to exact scoring, at a share of the block.
BLOCK, QUERIES, RESCORE_SHARE = 16_384, 2048, 1 / 16
#: The bound of each round, as a share of the largest impact.
ROUNDS = (0.6, 0.45, 0.35, 0.25, 0.18, 0.12, 0.08, 0.0)
#: Components under SAFE become int64, inner products under EXACT are sums of whole numbers that floating point holds, LONG is the largest score.
SAFE, EXACT, LONG = 2.0**50, 1 << 52, (1 << 63) - 1
PART = "query_no long, query_id long, vec_id long, score long"


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x): as int64 where that holds all of them, else as Python's integers."""
    if not values.size or np.abs(values).max() < SAFE:
        return np.floor(1024.0 * values).astype(np.int64)
    exact = [math.floor(1024.0 * x) if abs(x) < SAFE else 1024 * int(x) for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as whole numbers, padded with zeros)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.asarray(pa.compute.list_value_length(column).fill_null(-1))
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(np.maximum(lens, 0))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    rows = np.flatnonzero((lens >= 0) & (bad[at[1:]] == bad[at[:-1]]))
    padded = np.zeros((len(rows), int(lens.max(initial=0))))
    for width in np.unique(lens[rows]):
        own = np.flatnonzero(lens[rows] == width)
        if width:
            padded[own, :width] = values[at[rows[own]][:, None] + np.arange(width)]
    return rows, _whole(padded)


def _magnitude(m: np.ndarray) -> int:
    return max((abs(int(m.min())), abs(int(m.max())))) if m.size else 0


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """All inner products in Python's integers, brought into the range of a long."""
    full = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), -LONG), LONG) for x in np.atleast_1d(full)], np.int64)


class ImpactIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        self.levels = vectors >> SHIFT
        self.lowest, self.highest = self.levels.min(0), self.levels.max(0)
        self.least, self.most = vectors.min(0), vectors.max(0)
        dim, level, first, last, self.postings = [], [], [], [], np.empty((dims, n), np.int32)
        for d in range(dims):
            order = np.argsort(self.levels[:, d], kind="stable").astype(np.int32)
            self.postings[d] = order
            own = self.levels[order, d]
            cut = np.flatnonzero(np.diff(own)) + 1
            begin = np.concatenate([[0], cut])
            dim.append(np.full(len(begin), d))
            level.append(own[begin])
            first.append(d * n + begin)
            last.append(d * n + np.concatenate([cut, [n]]))
        self.dim, self.level, self.first, self.last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (dim, level, first, last))
        self.postings = self.postings.ravel()

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, exact scores, postings processed) of the rows that may be among the k best; a row under `floor` needn't be returned."""
        n, dims = self.vectors.shape
        q = query[self.dim]
        low = np.maximum(self.level << SHIFT, self.least[self.dim])
        high = np.minimum((self.level << SHIFT) + (1 << SHIFT) - 1, self.most[self.dim])
        worst = np.where(q > 0, self.least[self.dim], self.most[self.dim])
        surely = np.where(q > 0, q * (low - worst), q * (high - worst))
        impact = np.where(q > 0, q * (high - worst), q * (low - worst))
        base = int((query * np.where(query > 0, self.least, self.most)).sum())
        order = np.argsort(-impact, kind="stable")
        own = self.ids == query_id
        gathered, spread, met = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32)
        gathered[own] = np.iinfo(np.int64).min // 4
        weight = query != 0
        met += int((~weight).sum())  # a dimension without weight adds nothing
        at, done, top = 0, 0, int(impact[order[0]]) if len(order) else 0
        possible = np.flatnonzero(~own)
        for share in ROUNDS:
            bound = int(share * top)
            stop = int(np.searchsorted(-impact[order], -bound, "left"))
            if stop > at:
                s = order[at:stop]
                size = self.last[s] - self.first[s]
                rows = self.postings[ragged(self.first[s], size)]
                # sums of whole numbers under EXACT are exact in floating point
                gathered += np.bincount(rows, np.repeat(surely[s], size), n).astype(np.int64)
                spread += np.bincount(rows, np.repeat(impact[s] - surely[s], size), n).astype(np.int64)
                met += np.bincount(rows, minlength=n).astype(np.int32)
                done += len(rows)
                at = stop
            upper = gathered + spread + (dims - met).astype(np.int64) * bound
            least = None if floor is None else floor - base
            if n - own.sum() >= k:
                kth = int(np.partition(gathered, n - k)[n - k])
                least = kth if least is None else max(least, kth)
            possible = np.flatnonzero(~own & (upper >= least)) if least is not None else np.flatnonzero(~own)
            if len(possible) <= max(4 * k, n * RESCORE_SHARE):
                break
        return self.ids[possible], self.vectors[possible] @ query, done


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def top_k(spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by `every`."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    queries = rows.filter(F.col("vec_id") % every == 0)
    blocks = -(-queries.count() // QUERIES) or 1
    parts = None
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        take, matrix = integers(own.column("embedding"))
        # equal rows once, in an order of their own, so that a query has the same number whenever the block is read
        asked = sorted({(i, tuple(v)) for i, v in zip(np.asarray(own.column("vec_id"), np.int64)[take].tolist(), matrix.tolist(), strict=True)})
        ids = np.array([i for i, _ in asked], np.int64)
        sent = spark.sparkContext.broadcast((ids, np.array([v for _, v in asked], matrix.dtype).reshape(len(asked), matrix.shape[1])))
        found = rows.mapInArrow(tidy(_scan(sent, k, block << 32)), PART)
        parts = found if parts is None else parts.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query_no").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(sent, k: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

        def block(own: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(own)
            take, vectors = integers(table.column("embedding"))
            if not len(take) or not len(ids):
                return
            width = max(vectors.shape[1], queries.shape[1])
            vectors, asked = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (vectors, queries))
            own_ids = np.asarray(table.column("vec_id"), np.int64)[take]
            # an impact spans twice a component and a quantum; a score and its bounds add up as many as there are dimensions
            fits = 2 * width * _magnitude(asked) * (2 * _magnitude(vectors) + (2 << SHIFT)) < EXACT
            index = ImpactIndex(own_ids, vectors) if fits else None
            for i, (query_id, query) in enumerate(zip(ids, asked, strict=True)):
                old_ids, old = kept[i]
                if index:
                    floor = int(old[-1]) if len(old) == k else None
                    new_ids, new, _ = index.search(int(query_id), query, k, floor)
                else:
                    others = own_ids != query_id
                    new_ids, new = own_ids[others], exact_scores(vectors[others], query)
                all_ids, scores = np.concatenate([old_ids, new_ids]), np.concatenate([old, new])
                order = best(all_ids, scores, k)
                kept[i] = all_ids[order], scores[order]

        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                held.append(b.slice(at, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    block(held)
                    held, n = [], 0
        if held:
            block(held)
        for i, (own, scores) in enumerate(kept):
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x)) for x in (first + i, ids[i])] + [pa.array(own), pa.array(scores)], names=["query_no", "query_id", "vec_id", "score"])

    return run


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

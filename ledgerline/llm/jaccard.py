"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents are sets of 5-word shingles; two link when their Jaccard similarity is at least 0.75. Documents
with equal sets form a class, and only classes are compared. What follows loses no link:

1. Screening. In the order of shingle hashes, two linked sets share a known number of their first half or so.
   Those parts are sent, packed by bucket of hash, to count for each class how many of its shingles some
   other class also has there; a class with too few can't have a link. A class goes by 64 bits there, as a shingle does.
2. Document frequencies. The full sets of the classes left are sent likewise. Shingles of one class only
   are dropped (the set's size is kept); the others are put in the order of (frequency, hash).
3. Candidates. With required overlap T, a set's T - 1 most frequent shingles are its long lists; any partner
   is met in one of the others, the short ones. The members of a short list are first compared with one
   pivot each, which settles groups of near copies in steps linear in their size; classes found linked are
   then contracted. Lists that still join different components go on with more pivots, in rounds that grow,
   until every pair of different components has been compared or ruled out by size or position.
4. T-occurrence search. Pivots are gathered in blocks, each with an inverted index. A set is looked up
   with DivideSkip: its short lists are merged by a heap of their heads, which skips what can't be in enough of
   them, the long ones are probed by binary search for what reaches the count, and what reaches the required
   overlap is a link. A pivot that very many sets are compared with is copied to several blocks.

Components come from contraction rounds over the links: every node points to its least neighbour, pointers
are followed to their roots, and links are taken between roots until none is left.

Defined results: null or empty text, or one without words, has an empty set, links with nothing and is its
own component; fewer than five words are one shingle; documents with equal ids count as several documents
whose component bears the least id; a null id is never the least unless there is no other; an empty table gives no
rows; texts of any length are read whole, in pieces of bounded size; only doc_id and text are read, so other columns
may have any names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import BROADCAST_ROWS, Workspace, as_row, buckets_of, lookup, rows_of, sweep

WORDS = 5
#: The similarity asked for, as a fraction.
NUM, DEN = 3, 4
#: Shingles in a bucket or a block of the index, so that a task's memory is bounded.
BUCKET = 2 << 20
BLOCK = 1 << 20
#: The last bytes of a digest, which name a class while it is screened.
NAME = 8
#: Bytes of text whose sets are packed together.
PACK_BYTES = 2 << 20
#: Classes whose counts meet in one group.
CLASSES = 50_000
#: DivideSkip's weight of a probe against a merge step.
MU = 0.01


def least_overlap(n: np.ndarray) -> np.ndarray:
    """ceil(0.75 n): no partner overlaps less."""
    return -(-NUM * n // DEN)


def pair_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least overlap o with o / (n + m - o) >= 0.75."""
    return -(-NUM * (n + m) // (NUM + DEN))


def shared_prefix(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of the prefix in hash order, shingles of it that must be shared at least).

    The prefixes of lengths |x| - T + k of two linked sets share k shingles. k is a quarter of the set; the
    partner may be smaller by a quarter and has its own k.
    """
    k = np.maximum(1, n // 4)
    return np.minimum(n, n - least_overlap(n) + k), np.maximum(1, least_overlap(n) // 4)


def distinct_sets(text: pa.Array) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """(sorted distinct shingle hashes of each text, their numbers, digests of the sets: the number in 32 bits, so that they order by it, and 96 bits of hash)."""
    data, off = K.buffers(text)
    starts, ends, before = K.spans(data, off)
    hashes, at = K.shingles(K.hash_spans(data, starts, ends, lower=True), before, WORDS)
    sets = [np.unique(hashes[at[d] : at[d + 1]]) for d in range(len(at) - 1)]
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    cut = np.concatenate([[0], np.cumsum(n)])
    digests = []
    for salt in (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(flat ^ salt), dtype=np.uint64)])
        digests.append(K.mix(sums[cut[1:]] - sums[cut[:-1]] + n.astype(np.uint64)))
    sizes = np.minimum(n, 0xFFFFFFFF).astype(">u4").tobytes()
    return sets, n, [sizes[4 * d : 4 * d + 4] + a.tobytes()[4:] + b.tobytes() for d, (a, b) in enumerate(zip(*digests, strict=True))]


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, n, cid (the digest of its set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            _, n, cid = distinct_sets(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(cid, pa.binary())], names=["doc_id", "n", "cid"])

    return docs.mapInArrow(K.tidy(run), "doc_id long, n long, cid binary")


PACKED = "bucket int, cids binary, counts binary, tokens binary"


def packed(docs: DataFrame, buckets: int, whole: bool) -> DataFrame:
    """The sets (or their prefixes in hash order, as 32 bits a shingle, by short names) by bucket, a row for each bucket and batch; sets that a batch has twice go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, limit=PACK_BYTES):
            sets, n, cid = distinct_sets(b.column("text"))
            own = [d for d in {c: d for d, c in enumerate(cid)}.values() if n[d]]
            if not own:
                continue
            take = n[own] if whole else shared_prefix(n[own])[0]
            flat = np.concatenate([sets[d][:k] for d, k in zip(own, take, strict=True)])
            doc = np.repeat(np.arange(len(own)), take)
            bucket = (flat % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            flat, doc = flat[order], doc[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            names = [cid[d] if whole else cid[d][-NAME:] for d in own]
            rows = []
            for k in range(buckets):
                lo, hi = cuts[k], cuts[k + 1]
                if lo == hi:
                    continue
                here, counts = np.unique(doc[lo:hi], return_counts=True)
                tokens = flat[lo:hi] if whole else (flat[lo:hi] // np.uint64(buckets)).astype(np.uint32)
                rows.append((k, b"".join(names[d] for d in here), counts.astype("<u4").tobytes(), tokens.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "cids", "counts", "tokens"])

    return docs.mapInArrow(K.tidy(run), PACKED)


def _unpacked(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct digests as pairs of numbers, or short names, class of each shingle, shingles) by class; of a class that came several times, the first."""
    join = lambda c: b"".join(table.column(c).to_pylist())
    ids = np.frombuffer(join("cids"), "<u8").reshape(-1, 2 if kind == "<u8" else NAME // 8)
    distinct, first, inverse = np.unique(ids, axis=0, return_index=True, return_inverse=True)
    inverse, counts = inverse.ravel(), np.frombuffer(join("counts"), "<u4").astype(np.int64)
    starts = np.cumsum(counts) - counts
    size = counts[first]
    return distinct, np.repeat(np.arange(len(distinct)), size), np.frombuffer(join("tokens"), kind)[K.ragged(starts[first], size)]


def _frequency(tokens: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    return counts[inverse]


RETURNED = "grp int, cids binary, counts binary, tokens binary, df binary"


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of classes in which a class's parts from all buckets meet again."""
    return (ids[:, -1] % np.uint64(groups)).astype(np.int64)


def _stretches(g: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal values."""
    starts = np.flatnonzero(np.diff(g, prepend=-1)).tolist()
    return list(zip(starts, [*starts[1:], len(g)], strict=False))


def _returned(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.table({n: pa.array(c, pa.int32() if n == "grp" else pa.binary()) for n, c in zip(("grp", "cids", "counts", "tokens", "df"), columns, strict=True)})


def _count_shared(groups: int) -> Callable:
    """A row for each group of classes: how many of their shingles some other class has in this bucket."""

    def run(table: pa.Table) -> pa.Table:
        distinct, owner, tokens = _unpacked(table, "<u4")
        shared = np.bincount(owner[_frequency(tokens) > 1], minlength=len(distinct))
        own = np.flatnonzero(shared)
        own = own[np.argsort(_group(distinct[own], groups), kind="stable")]
        g = _group(distinct[own], groups)
        return _returned([(int(g[a]), distinct[own[a:b]].tobytes(), shared[own[a:b]].astype("<u4").tobytes(), b"", b"") for a, b in _stretches(g)])

    return run


def _sum_shared(table: pa.Table) -> pa.Table:
    join = lambda c: b"".join(table.column(c).to_pylist())
    distinct, inverse = np.unique(np.frombuffer(join("cids"), "<u8"), return_inverse=True)
    shared = np.bincount(inverse, np.frombuffer(join("counts"), "<u4"), len(distinct)).astype(np.int64)
    return pa.table({"name": pa.array([d.tobytes() for d in distinct], pa.binary()), "shared": pa.array(shared)})


def _with_frequency(groups: int) -> Callable:
    """A row for each group of classes: their shingles of this bucket that another class has too, with their frequency."""

    def run(table: pa.Table) -> pa.Table:
        distinct, owner, tokens = _unpacked(table, "<u8")
        df = _frequency(tokens)
        keep = df > 1
        owner, tokens, df = owner[keep], tokens[keep], df[keep].astype("<u4")
        g = _group(distinct, groups)[owner]
        order = np.argsort(g, kind="stable")
        owner, tokens, df, g = owner[order], tokens[order], df[order], g[order]
        rows = []
        for a, b in _stretches(g):
            here, counts = np.unique(owner[a:b], return_counts=True)
            rows.append((int(g[a]), distinct[here].tobytes(), counts.astype("<u4").tobytes(), tokens[a:b].tobytes(), df[a:b].tobytes()))
        return _returned(rows)

    return run


def _assemble(table: pa.Table) -> pa.Table:
    """cid, n, tokens (those that another class has too, by frequency and hash) of the classes of a group that have enough of them."""
    join = lambda c: b"".join(table.column(c).to_pylist())
    distinct, inverse = np.unique(np.frombuffer(join("cids"), "<u8").reshape(-1, 2), axis=0, return_inverse=True)
    owner = np.repeat(inverse.ravel(), np.frombuffer(join("counts"), "<u4"))
    tokens, df = np.frombuffer(join("tokens"), "<u8"), np.frombuffer(join("df"), "<u4")
    order = np.lexsort((tokens, df, owner))
    owner, tokens = owner[order], tokens[order]
    cuts = np.searchsorted(owner, np.arange(len(distinct) + 1))
    n = np.array([int.from_bytes(d.tobytes()[:4], "big") for d in distinct], np.int64)
    good = np.flatnonzero(np.diff(cuts) >= least_overlap(n))
    return pa.table({"cid": pa.array([distinct[i].tobytes() for i in good], pa.binary()), "n": pa.array(n[good]), "tokens": pa.array([tokens[cuts[i] : cuts[i + 1]].tobytes() for i in good], pa.binary())})


def short_lists(sets: DataFrame) -> DataFrame:
    """token, cid, n, pos (its place in the set's order) of every set's short lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(b.column("n"), np.int64)
            raw = b.column("tokens").to_pylist()
            size = np.array([len(t) // 8 for t in raw], np.int64)
            take = np.maximum(size - least_overlap(n) + 1, 0)
            flat = [np.frombuffer(t, "<i8")[:k] for t, k in zip(raw, take, strict=True)]
            tokens = np.concatenate(flat) if flat else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(n)), take)
            pos = K.ragged(n - size, take)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), b.column("cid").take(pa.array(row)), pa.array(n[row]), pa.array(pos)], names=["token", "cid", "n", "pos"])

    return sets.mapInArrow(K.tidy(run), "token long, cid binary, n long, pos long")


class InvertedIndex:
    """Shingle -> ascending numbers of the sets that have it."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.sizes = sizes
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.lexsort((owner, flat))
        flat, self.owner = flat[order], owner[order]
        self.members = self.owner.tolist()
        self.tokens, first = np.unique(flat, return_index=True)
        self.at = np.append(first, len(flat))

    def merge_skip(self, slots: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets in `need` of these lists or more, in how many), by a heap of the lists' heads.

        Lists whose head is the least are popped together. If they are too few, lists are popped until one more would
        suffice: what lies before the next head can't be in enough lists, so the popped ones skip to it.
        """
        members, low = self.members, 32
        place, stop = self.at[slots].tolist(), self.at[slots + 1].tolist()
        heads = [members[p] << low | k for k, p in enumerate(place)]
        heapify(heads)
        found, counts = [], []
        while len(heads) >= need:
            least, popped = heads[0] >> low, []
            while heads and heads[0] >> low == least:
                popped.append(heappop(heads) & 0xFFFFFFFF)
            if len(popped) >= need:
                found.append(least)
                counts.append(len(popped))
                to = least + 1
            else:
                while heads and len(popped) < need - 1:
                    popped.append(heappop(heads) & 0xFFFFFFFF)
                if not heads:
                    break
                to = heads[0] >> low
            for k in popped:
                p = place[k] + 1
                if p < stop[k] and members[p] < to:
                    p = bisect_left(members, to, p, stop[k])
                place[k] = p
                if p < stop[k]:
                    heappush(heads, members[p] << low | k)
        return np.array(found, np.int64), np.array(counts, np.int64)

    def divide_skip(self, query: np.ndarray, n: int) -> np.ndarray:
        """The sets that overlap the query (of n shingles in all) as much as a link needs."""
        need = int(least_overlap(np.int64(n)))
        if not len(self.tokens) or len(query) < need:
            return np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        slot = slot[self.tokens[slot] == query]
        if len(slot) < need:
            return np.zeros(0, np.int64)
        lengths = self.at[slot + 1] - self.at[slot]
        longest = int(lengths.max())
        n_long = min(need - 1, int(need / (MU * np.log2(longest + 1) + 1)))
        by = np.argsort(lengths, kind="stable")
        short, long = slot[by[: len(by) - n_long]], slot[by[len(by) - n_long :]]
        found, counts = self.merge_skip(short, need - n_long)
        # probe the long lists for what is left, by a binary search in the list
        for s in long:
            if not len(found):
                break
            own = self.owner[self.at[s] : self.at[s + 1]]
            place = np.minimum(np.searchsorted(own, found), len(own) - 1)
            counts = counts + (own[place] == found)
        return found[counts >= pair_overlap(np.int64(n), self.sizes[found])]


def _search(table: pa.Table) -> pa.Table:
    role = np.asarray(table.column("role"))
    cid, n = table.column("cid").to_pylist(), np.asarray(table.column("n"), np.int64)
    sets = [np.frombuffer(t, "<u8") for t in table.column("tokens").to_pylist()]
    pivots, asked = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
    index = InvertedIndex([sets[i] for i in pivots], n[pivots])
    a, b = [], []
    for i in asked:
        for j in pivots[index.divide_skip(sets[i], int(n[i]))]:
            if cid[i] != cid[j]:
                a.append(cid[i])
                b.append(cid[j])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def verified(pairs: DataFrame, sets: DataFrame, space: Workspace, name: str) -> DataFrame:
    """a, b: the links among (cid, pivot, n), and any that the search meets besides."""
    weights = space.save(pairs.groupBy("pivot").agg(F.sum("n").alias("w"), F.count("*").alias("pairs")), f"{name}-weights")
    total = weights.agg(F.count("*"), F.sum("w"), F.sum("pairs")).first()
    blocks = int((total[1] or 0) // BLOCK + spark_tasks(pairs.sparkSession))
    salts = F.greatest(F.lit(1), F.ceil(F.col("w") / BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("pivot"), F.lit(blocks)).alias("block")
    asked = lookup(pairs, weights, "pivot", int(total[2] or 0), int(total[0]), "pairs")
    asked = space.save(asked.select(block, F.pmod(F.xxhash64("cid"), salts).cast("int").alias("salt"), "cid").distinct(), f"{name}-asked")
    held = weights.select(block, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("pivot").alias("cid"))
    # few are named to the sets where they lie; else the sets are shuffled
    few = max(asked.count(), int(total[0]) + int((total[1] or 0) // BLOCK)) <= BROADCAST_ROWS
    ask = lambda who, role: sets.join(F.broadcast(who) if few else who, "cid").select("block", "salt", F.lit(role).alias("role"), "cid", "n", "tokens")
    return space.save(ask(asked, 0).unionByName(ask(held, 1)).groupBy("block", "salt").applyInArrow(K.tidy(_search), "a binary, b binary"), name)


def spark_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """node, root: the least node of each linked node's component."""
    labels, step = None, 0
    edges = space.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-edges0")
    while True:
        n_edges = edges.count()
        if not n_edges:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = space.save(both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("uses")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"), "uses"), f"{name}-point{step}")
        n_nodes = point.count()
        jump = 0
        while True:
            up = point.groupBy("root").agg(F.count("*").alias("n")).withColumnRenamed("root", "up")
            up = up.join(point.select(F.col("node").alias("up"), F.col("root").alias("top")), "up").filter("top <> up")
            up = space.save(up, f"{name}-up{step}-{jump}")
            n_up = up.count()
            if not n_up:
                break
            moved = lookup(point.withColumnRenamed("root", "up"), up, "up", n_nodes, n_up, "n")
            point = space.save(moved.select("node", F.coalesce("top", "up").alias("root"), "uses"), f"{name}-point{step}-{jump}")
            jump += 1
        of = lambda c: lookup(edges.withColumnRenamed(c, "node"), point, "node", 2 * n_edges, n_nodes, "uses").drop("uses", "node").withColumnRenamed("root", c)  # noqa: B023, E731
        edges = of("a")
        edges = of("b")
        edges = space.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-edges{step + 1}")
        own = point.select("node", "root")
        if labels is None:
            labels = own
        else:
            sizes = labels.groupBy("root").agg(F.count("*").alias("n"))
            nexts = sizes.join(own.select(F.col("node").alias("root"), F.col("root").alias("top")), "root")
            moved = lookup(labels, nexts, "root", labels.count(), nexts.count(), "n")
            labels = space.save(moved.select("node", F.coalesce("top", "root").alias("root")), f"{name}-labels{step}")
        step += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _possible(n: str, m: str, i: str, j: str):
    """Sizes and places that leave room for a link whose first common shingle this is."""
    need = F.ceil(NUM * (F.col(n) + F.col(m)) / (NUM + DEN))
    return (F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= need) & (F.least(n, m) * DEN >= F.greatest(n, m) * NUM)


def links(sets: DataFrame, space: Workspace) -> DataFrame:
    """node, root of all linked classes."""
    spark = sets.sparkSession
    postings = space.save(short_lists(sets), "postings")
    pivots = postings.groupBy("token").agg(F.min(F.struct("n", "cid", "pos")).alias("p"), F.count("*").alias("members")).filter("members > 1")
    pivots = space.save(pivots.select("token", "members", F.col("p.cid").alias("pivot"), F.col("p.n").alias("m"), F.col("p.pos").alias("j")), "pivots")
    size = pivots.agg(F.count("*"), F.sum("members")).first()
    if not size[0]:
        return components(sets.select(F.col("cid").alias("a"), F.col("cid").alias("b")).filter("false"), space, "cc")
    pairs = lookup(postings, pivots, "token", int(size[1]), int(size[0]), "members").filter((F.col("cid") != F.col("pivot")) & _possible("n", "m", "pos", "j"))
    edges = verified(space.save(pairs.select("cid", "pivot", "n").distinct(), "pairs0"), sets, space, "links0")
    labels = components(edges, space, "cc0")
    open_, done, width, turn = postings, 1, 8, 1
    while True:
        own = labels.select(F.col("node").alias("cid"), "root")
        own = F.broadcast(own) if labels.count() <= BROADCAST_ROWS else own
        open_ = open_.join(own, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        tokens = open_.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("members")).filter(f"r0 <> r1 AND members > {done + 1}")
        ranked = open_.join(tokens.select("token"), "token")
        if turn == 1:  # a list keeps all its members, so a member's rank is the same in every turn
            ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy("n", "cid")))
        ranked = space.save(ranked, f"open{turn}")
        # what is closed stays so, as components only grow: the next turn needs nothing but these lists
        open_ = ranked.drop("root")
        space.drop(*(["postings", "pivots", "pairs0"] if turn == 1 else [f"open{turn - 1}", f"pairs{turn - 1}"]))
        if ranked.isEmpty():
            return labels
        sweep(spark)
        p = ranked.filter((F.col("rank") > done) & (F.col("rank") <= done + width))
        p = p.select("token", F.col("cid").alias("pivot"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("root").alias("r"), F.col("rank").alias("k"))
        pairs = ranked.join(p, "token").filter((F.col("rank") > F.col("k")) & (F.col("root") != F.col("r")) & _possible("n", "m", "pos", "j"))
        pairs = space.save(pairs.select("cid", "pivot", "n").distinct(), f"pairs{turn}")
        if not pairs.isEmpty():
            edges = edges.unionByName(verified(pairs, sets, space, f"links{turn}"))
            labels = components(edges, space, f"cc{turn}")
        done, width, turn = done + width, width * 8, turn + 1


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    space = Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = space.save(classes_of(docs), "rows")
    classes = rows.filter("n > 0").groupBy("cid").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = space.save(classes, "classes")
    n_classes, n_rows, n_tokens = (int(x or 0) for x in classes.agg(F.count("*"), F.sum("copies"), F.sum("n")).first())
    tasks = spark_tasks(spark)
    groups = int(max(tasks, n_classes // CLASSES))
    shared = packed(docs, buckets_of(spark, n_tokens // 2, BUCKET), whole=False).groupBy("bucket").applyInArrow(K.tidy(_count_shared(groups)), RETURNED)
    shared = shared.groupBy("grp").applyInArrow(K.tidy(_sum_shared), "name binary, shared long")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * NUM / DEN) / 4))
    sweep(spark)
    left = space.save(classes.withColumn("name", F.substring("cid", 17 - NAME, NAME)).join(shared, "name").filter(F.col("shared") >= least).select("cid", "n", "least"), "screened")
    sweep(spark)
    n_left, n_tokens = (int(x or 0) for x in left.agg(F.count("*"), F.sum("n")).first())
    reps = left.select(F.col("least").alias("rep")).distinct()
    reps = F.broadcast(reps) if n_left <= BROADCAST_ROWS else reps
    own = packed(docs.join(reps, docs.doc_id.eqNullSafe(reps["rep"]), "left_semi"), buckets_of(spark, n_tokens, BUCKET), whole=True)
    groups = int(max(tasks, n_tokens // BLOCK))
    parts = own.groupBy("bucket").applyInArrow(K.tidy(_with_frequency(groups)), RETURNED)
    sets = space.save(parts.groupBy("grp").applyInArrow(K.tidy(_assemble), "cid binary, n long, tokens binary"), "sets")
    sweep(spark)
    labels = links(sets, space)
    of = classes.join(labels.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = of.join(labels.select(F.col("node").alias("cid")), "cid", "left_semi")
    heads = named.groupBy("root").agg(F.min("least").alias("head"))
    heads = of.join(heads, "root", "left").select("cid", F.coalesce("head", "least").alias("component_id"), "copies")
    heads = space.save(heads, "heads")
    found = lookup(rows.filter("n > 0"), heads, "cid", n_rows, n_classes, "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(spark: SparkSession, docs: DataFrame, find: Callable = jaccard_components) -> DataFrame:
    """The rows with all their columns, of each group of linked rows exactly one: that of the least id, null last, then of the least hash.

    Rows go by a hash of their columns and of which are null, so no copy of them is needed; rows that repeat one another go by the
    same and are counted, and of those only one stays. Rows without words link with nothing and stay.
    """
    space = Workspace(spark, "keep")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    r = F.xxhash64(*plain, *[c.isNull() for c in plain]).alias("r")
    id_ = F.col("doc_id")
    own = docs.select(r, F.struct(id_.isNull().alias("none"), id_.cast("long").alias("id"), F.xxhash64(*plain).alias("h"), r).alias("rank"))
    own = own.groupBy("r").agg(F.min("rank").alias("rank"), F.count("*").alias("times"))
    found = find(spark, docs.select(r.alias("doc_id"), "text")).filter("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("r")).agg(F.min("component_id").alias("group"))
    found = space.save(found.join(own, "r"), "found")
    kept = found.groupBy("group").agg(F.min(F.struct("rank", "times")).alias("first"), F.count("*").alias("members"))
    kept = kept.select("group", F.col("first.rank.r").alias("kept"), F.col("first.times").alias("times"), "members").filter("members > 1 OR times > 1")
    kept = space.save(kept, "kept")
    n, linked, n_twice = (int(x or 0) for x in kept.agg(F.count("*"), F.sum("members"), F.count_if(F.col("times") > 1)).first())
    gone = space.save(lookup(found.select("r", "group"), kept, "group", linked, n, "members").filter("r <> kept").select("r"), "gone")
    if linked - n <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    rows = docs.select(r, as_row(docs)).join(gone, "r", "left_anti")
    if n_twice:
        twice = kept.filter("times > 1").select(F.col("kept").alias("r"))
        twice = F.broadcast(twice) if n_twice <= BROADCAST_ROWS else twice
        one = rows.join(twice, "r", "left_semi").groupBy("r").agg(F.first("_row").alias("_row"))
        rows = rows.join(twice, "r", "left_anti").unionByName(one)
    return rows_of(rows, docs)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT u.b, r.c FROM r JOIN u ON r.doc_id = u.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""

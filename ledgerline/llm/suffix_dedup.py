"""Suffix-array dedup: removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of `depth` bytes that covers it also starts anywhere else. Places are first parted so
that equal strings meet: of the `depth - GRAM + 1` grams of GRAM bytes in a string, the one of least hash is
its minimizer; equal strings have the same. Runs of places with one minimizer form a piece.

1. Minimizers are counted, packed by bucket of hash. One that occurs once in the corpus can't be in a repeated
   string; only the pieces of the others go on.
2. Pieces are gathered by bucket of minimizer. A task sends each distinct piece once, and once more that it
   has seen it again, so that copies, however many, are aggregated before the shuffle; such a piece is repeated
   as a whole. In each bucket the distinct pieces are dealt to shards, each shard is sorted and transformed, and the
   transforms are merged (see bwt); the blocks of the merged order give the repeated places of each piece.
3. The places go back to the texts. Texts that occur twice or more go as a whole without that, if they have
   `depth` bytes.

Defined results: a null text is empty; texts shorter than `depth` stay; rows with the same id and text are
two texts that are equal, so both go if they are long enough; ties don't arise, as all copies of a string go; an empty
table gives no rows; matches never cross texts; strings are judged on the input; very long texts are read in pieces
that overlap by a string; `cut_repeats` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .bwt import repeated_places
from .shared import Workspace, as_row, buckets_of, lookup, rows_of, sweep

DEPTH, GRAM = 200, 48
#: Minimizers in a bucket of the first step, bytes of pieces in one of the second.
MINIMIZERS, PIECES = 1 << 20, 3 << 18
#: Windows whose minimizers are found at once.
WINDOWS = 1 << 18
#: A table of places is broadcast to the texts up to so many bytes; beyond, both are shuffled.
BROADCAST_BYTES = 4 << 20


def _least_grams(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the grams, place of each window's least gram: the leftmost of those with the least upper half of a hash)."""
    w = depth - GRAM + 1
    value = K.hash_grams(data, GRAM)
    grams = len(value)
    key = value >> np.uint64(32) << np.uint64(32) | np.arange(grams, dtype=np.uint64)
    # least of w neighbours: of two blocks, from one's end backwards and from the next one's start
    padded = np.full(-(-grams // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = key
    square = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - depth + 1
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])
    return value, (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def minimizers(data: np.ndarray, off: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first place, number of places, hash of the minimizer) of every piece; places are counted from a text's start.

    Windows are taken in blocks, so memory doesn't grow with a text; a piece that goes on in the next block is put together.
    """
    found = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
    for lo in range(0, len(data) - depth + 1, WINDOWS):
        value, at = _least_grams(data[lo : lo + WINDOWS + depth - 1], depth)
        place = np.arange(lo, lo + len(at))
        text = np.searchsorted(off[1:], place, "right")
        valid = np.flatnonzero(place + depth <= off[1:][text])
        new = np.ones(len(valid), bool)
        new[1:] = (at[valid[1:]] != at[valid[:-1]]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        begin = valid[first]
        found.append((text[begin], place[begin], np.diff(np.append(first, len(valid))), at[begin] + lo, value[at[begin]]))
    text, start, count, at, value = (np.concatenate(x) for x in zip(*found, strict=True))
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (at[1:] == at[:-1]) & (start[1:] == start[:-1] + count[:-1])
    first = np.flatnonzero(~goes_on)
    count = np.add.reduceat(count, first) if len(first) else count
    return text[first], start[first] - off[text[first]], count, value[first]


PLACE = np.dtype([("start", "<u4"), ("count", "<u4"), ("hash", "<u4")])


def _packed(texts: DataFrame, buckets: int, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, limit=2 << 20):
            data, off = K.buffers(b.column("text"))
            digests = b.column("digest").to_pylist()
            # a text that the batch has twice goes once
            once = np.zeros(len(digests), bool)
            once[list({d: i for i, d in enumerate(digests)}.values())] = True
            text, start, count, value = minimizers(data, off, depth)
            keep = once[text]
            text, start, count, value = text[keep], start[keep], count[keep], value[keep]
            bucket = (value % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            places = np.empty(len(text), PLACE)
            places["start"], places["count"], places["hash"] = start, count, (value // np.uint64(buckets)).astype(np.uint32)
            rows = []
            for k in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[k] : cuts[k + 1]]
                here, counts = np.unique(text[own], return_counts=True)
                rows.append((int(k), b"".join(digests[t] for t in here), counts.astype("<u4").tobytes(), places[own].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "digests", "counts", "places"])

    return texts.mapInArrow(K.tidy(run), "bucket int, digests binary, counts binary, places binary")


def _repeated_minimizers(table: pa.Table) -> pa.Table:
    join = lambda c: b"".join(table.column(c).to_pylist())
    ids = np.frombuffer(join("digests"), "<u8").reshape(-1, 2)
    distinct, inverse = np.unique(ids, axis=0, return_inverse=True)
    owner = np.repeat(inverse.ravel(), np.frombuffer(join("counts"), "<u4"))
    places = np.frombuffer(join("places"), PLACE)
    order = np.lexsort((places["start"], owner))
    owner, places = owner[order], places[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (places["start"][1:] != places["start"][:-1])
    owner, places = owner[new], places[new]
    _, which, counts = np.unique(places["hash"], return_inverse=True, return_counts=True)
    keep = counts[which] > 1
    owner, places = owner[keep], places[keep]
    own = np.unique(owner)
    lo, hi = np.searchsorted(owner, own), np.searchsorted(owner, own, "right")
    total = [int(places["count"][a:b].sum()) + DEPTH * int(b - a) for a, b in zip(lo, hi, strict=True)]
    return pa.table({"digest": pa.array([distinct[i].tobytes() for i in own], pa.binary()), "places": pa.array([places[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()), "size": pa.array(total, pa.int64())})


def _pieces(texts: DataFrame, buckets: int, depth: int) -> DataFrame:
    """occurrences (content null) and contents: a task sends a distinct piece once, and once more without its bytes if it sees it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = {}
        done: set[bytes] = set()
        for b in K.slices(batches, limit=2 << 20):
            rows = []
            for digest, text, parts in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), b.column("parts").to_pylist(), strict=True):
                raw = text.encode("utf-8")
                first, _ = digest not in done, done.add(digest)
                for start, count, h in np.frombuffer(b"".join(parts), PLACE).tolist():
                    content = raw[start : start + count + depth - 1]
                    piece = hashlib.md5(content).digest()
                    again = seen.get(piece)
                    if again is None:
                        seen[piece] = False
                        rows.append((1, h % buckets, piece, None, None, count, content))
                    elif not again:
                        seen[piece] = True
                        rows.append((1, h % buckets, piece, None, None, count, None))
                    if first:
                        rows.append((0, None, piece, digest, start, count, None))
            if rows:
                types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "bucket", "piece", "digest", "start", "count", "content"])

    return texts.mapInArrow(K.tidy(run), "kind int, bucket int, piece binary, digest binary, start long, count long, content binary")


def _runs(mask: np.ndarray) -> bytes:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.astype("<u4").tobytes()


def _find(depth: int):
    def find(table: pa.Table) -> pa.Table:
        pieces, contents, count = (table.column(c).to_pylist() for c in ("piece", "content", "count"))
        text: dict[bytes, bytes] = {}
        often: dict[bytes, int] = {}
        size: dict[bytes, int] = {}
        for p, c, k in zip(pieces, contents, count, strict=True):
            often[p] = often.get(p, 0) + 1
            size[p] = k
            if c is not None:
                text[p] = c
        names = list(text)
        mask, at = repeated_places([text[p] for p in names], depth)
        out = []
        for p, a in zip(names, at.tolist(), strict=True):
            own = np.ones(size[p], bool) if often[p] > 1 else mask[a : a + size[p]]
            if own.any():
                out.append((p, _runs(own)))
        columns = zip(*out, strict=True) if out else ((), ())
        return pa.table({n: pa.array(c, pa.binary()) for n, c in zip(("piece", "runs"), columns, strict=True)})

    return find


def covered(starts: list[int], runs: list[bytes], depth: int) -> np.ndarray:
    """Ascending (from, to) of the bytes that repeated strings cover, neighbours joined."""
    spans = []
    for start, own in zip(starts, runs, strict=True):
        edge = np.frombuffer(own, "<u4").astype(np.int64).reshape(-1, 2) + start
        edge[:, 1] += depth - 1
        spans.append(edge)
    all_ = np.concatenate(spans)
    all_ = all_[np.argsort(all_[:, 0], kind="stable")]
    reach = np.maximum.accumulate(all_[:, 1])
    new = np.ones(len(all_), bool)
    new[1:] = all_[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([all_[first, 0], reach[np.append(first[1:], len(all_)) - 1]], 1)


def _named(texts: DataFrame, side: DataFrame, n: int, how: str) -> DataFrame:
    """The texts that the side, of n rows, has (left_semi) or hasn't (left_anti); its digests alone are broadcast if their bytes are few."""
    names = side.select("digest")
    return texts.join(F.broadcast(names) if 24 * n <= BROADCAST_BYTES else names, "digest", how)


def _joined(texts: DataFrame, side: DataFrame, n: int, size: int) -> DataFrame:
    """texts with the side's columns by digest: the side is broadcast if its bytes are few, else it is shuffled with those texts that it has."""
    if size <= BROADCAST_BYTES:
        return texts.join(F.broadcast(side), "digest")
    return (_named(texts, side, n, "left_semi") if 24 * n <= BROADCAST_BYTES else texts).join(side, "digest")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def repeated_spans(spark: SparkSession, docs: DataFrame, space: Workspace, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_bytes, sha, copies (of its text) of every row; digest, hits, bytes of every text in which strings are repeated)."""
    texts = _texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = space.save(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "rows")
    n_rows, n_bytes = (int(x or 0) for x in rows.agg(F.count("*"), F.sum("n_bytes")).first())
    copies = space.save(rows.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    size = copies.agg(F.count("*"), F.sum("copies")).first()
    rows = lookup(rows, copies, "digest", n_rows, int(size[0]), "copies")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = texts.filter(F.octet_length("text") >= depth).select("digest", "text")
    found = _packed(own, buckets_of(spark, n_bytes // 75, MINIMIZERS), depth).groupBy("bucket").applyInArrow(K.tidy(_repeated_minimizers), "digest binary, places binary, size long")
    found = space.save(found.groupBy("digest").agg(F.collect_list("places").alias("parts"), F.sum("size").alias("size")), "minimizers")
    sweep(spark)
    n, total = (int(x or 0) for x in found.agg(F.count("*"), F.sum("size")).first())
    # a place takes 12 bytes and stands for 60 bytes of pieces or more
    pieces = _pieces(_joined(own, found.drop("size"), n, 32 * n + total // 5), int(max(tasks, total // PIECES)), depth)
    pieces.write.mode("overwrite").partitionBy("kind").parquet(space.path("pieces"))
    pieces = spark.read.schema(pieces.schema).parquet(space.path("pieces"))
    runs = pieces.filter("kind = 1").select("bucket", "piece", "count", "content").groupBy("bucket").applyInArrow(K.tidy(_find(depth)), "piece binary, runs binary")
    hits = pieces.filter("kind = 0").select("piece", "digest", "start").distinct().join(runs, "piece")
    hits = hits.groupBy("digest").agg(F.collect_list(F.struct("start", "runs")).alias("hits"), F.sum(F.octet_length("runs") + 24).alias("bytes"))
    hits = space.save(hits, "hits")
    space.drop("pieces", "minimizers")
    sweep(spark)
    return rows, hits


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(spark: SparkSession, docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per input row: bytes, removed bytes, maximal removed runs and the digest of what is left."""
    space = Workspace(spark, "suffixes")
    rows, hits = repeated_spans(spark, docs, space, depth)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= depth)
    whole = F.coalesce(whole, F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    gone = rows.filter(whole).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"))
    n, size = (int(x or 0) for x in hits.agg(F.count("*"), F.sum("bytes")).first())
    kept = _named(rows.filter(~whole), hits, n, "left_anti")
    kept = kept.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            out = []
            for doc, text, own in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("hits").to_pylist(), strict=True):
                raw = text.encode("utf-8")
                spans = covered([h["start"] for h in own], [h["runs"] for h in own], depth)
                sha, at = hashlib.sha256(), 0
                for lo, hi in spans.tolist():
                    sha.update(raw[at:lo])
                    at = hi
                sha.update(raw[at:])
                out.append((doc, len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    # texts that occur twice go as a whole; what is left of the others is cut here
    once = hits.join(_multiple(rows), "digest", "left_anti")
    cut = _joined(_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), once.drop("bytes"), n, size).select("doc_id", "text", "hits").mapInArrow(K.tidy(run), RESULT)
    return gone.unionByName(kept).unionByName(cut)


def _multiple(rows: DataFrame) -> DataFrame:
    return rows.filter("copies > 1").select("digest").distinct()


def cut_repeats(spark: SparkSession, docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The rows with all their columns, repeated strings cut from text; n_chars follows. Bytes of a character that is cut in part go too.

    Here the first of equal texts is not spared either: the rule is the operator's own.
    """
    space = Workspace(spark, "cut")
    rows, hits = repeated_spans(spark, docs, space, depth)
    copied = rows.filter((F.col("copies") > 1) & (F.col("n_bytes") >= depth)).agg(F.count_distinct("digest")).first()[0]
    n, size = (int(x or 0) for x in hits.agg(F.count("*"), F.sum("bytes")).first())
    n, size = n + copied, size + 40 * copied
    side = hits.select("digest", "hits").join(_multiple(rows.filter(F.col("n_bytes") >= depth)).withColumn("whole", F.lit(True)), "digest", "full")
    keyed = docs.select(as_row(docs), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("digest"))
    few = 24 * n <= BROADCAST_BYTES
    joined = _joined(keyed, side, n, size) if few else keyed.join(side, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, column in K.row_slices(batches):
            texts, changed = column.to_pylist(), [None] * b.num_rows
            for i, (hits_, whole) in enumerate(zip(b.column("hits").to_pylist(), b.column("whole").to_pylist(), strict=True)):
                if whole:
                    changed[i] = ""
                elif hits_:
                    raw, at, left = texts[i].encode("utf-8"), 0, []
                    for lo, hi in covered([h["start"] for h in hits_], [h["runs"] for h in hits_], depth).tolist():
                        left.append(raw[at:lo])
                        at = hi
                    left.append(raw[at:])
                    changed[i] = "".join(p.decode("utf-8", "ignore") for p in left)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(changed, pa.string())], names=["_row", "cut"])

    columns = T.StructType([keyed.schema["_row"], T.StructField("cut", T.StringType())])
    done = joined.select("_row", "hits", "whole").mapInArrow(K.tidy(run), columns)
    if few:  # the other rows stay where they are
        done = done.unionByName(_named(keyed, side, n, "left_anti").select("_row", F.lit(None).cast("string").alias("cut")))
    text = F.coalesce("cut", F.col("_row.text"))
    new = {"text": text} | ({"n_chars": F.when(F.col("cut").isNull(), F.col("_row.n_chars")).otherwise(F.length("cut"))} if "n_chars" in docs.columns else {})
    return rows_of(done, docs, **new)

"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: payloads of at least `least` bytes that occur more than once have one response record, that of the
largest page id; the others become revisit records of the HTTP head alone. Records are written by Spark's own
text writer, whose line separator is the record end, so any store that Spark can write will do.

Reading: files are read in byte ranges by Spark's own text reader, with the start of a record's version line as the
separator, so a file of any size is read by as many tasks as it has ranges. Every fragment behind a separator is a
candidate, if a version line and a head with a length begin it, and has the offset of the record that would follow.
Fragments know their place within a range; the ranges' sizes, added up, give places in the file. Payloads may hold such
places too; only candidates that the chain of successors reaches from offset 0, across all ranges, are records. The
chain is followed by pointer jumping: with J the successor of each candidate, R <- R + J[R], J <- J[J] reaches all
records in as many steps as their number has bits. One task follows the chains of a file; it holds some numbers and
a head's fields of each candidate, and no payload. Payloads are hashed where they are read; those that hold a
separator come in several fragments, which are gathered by record in a second pass over those alone.

Defined results: a null html is an empty payload; rows without a page id are never the target of a revisit;
rows that repeat the largest page id of a payload are all responses; an empty table gives no archive and no
rows; a file whose chain breaks fails, with the place; only page_id, url and html are read, so other columns may have
any names. A head may not hold the separator: where an address does, it is escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import BROADCAST_ROWS, Workspace, lookup

#: The end of a record, what its version line begins with, and the rest of that line (fixed values of the format).
END, START, VERSION = "\r\n\r\n", "WARC/1.", re.compile(rb"[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records, as pages have none.
DATE = "2000-01-01T00:00:00Z"
#: Records in a file at most, which bounds what one task holds to follow a file's chain.
RECORDS_PER_FILE = 100_000
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def records(pages: DataFrame, space: Workspace, least: int = 1000) -> DataFrame:
    """One row per page: the whole record as text, without the record end."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "%0A"), F.lit(START), F.lit("WARC%2F1.")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    base = base.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "n": F.octet_length("payload").cast("long")})
    copies = base.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("copies")).filter("copies > 1")
    copies = space.save(copies, "copies")
    totals = copies.agg(F.count("*"), F.sum("copies")).first()
    base = lookup(base, copies, "digest", int(totals[1] or 0), int(totals[0]), "copies")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit(END))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    head = [
        F.lit(START + "1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name("page_id")), F.lit("WARC-Date: " + DATE),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("target"))), F.when(revisit, F.lit("WARC-Profile: " + PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), size),
    ]
    return base.select(F.concat(F.concat_ws("\r\n", *head), F.lit(END), http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, space: Workspace, least: int = 1000) -> str:
    folder = space.path("warc")
    records(pages, space, least).write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)
    return folder


_FIELD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)(?:\r\n|\Z)")
_BREAK = END.encode()


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v for k, v in _FIELD.findall(head)}


def _number(value: bytes) -> str | None:
    """The digits of a page id; as text, since numbers with gaps are no whole numbers in pandas."""
    digits = value.removeprefix(b"<urn:page:").removesuffix(b">")
    return digits.decode() if re.fullmatch(rb"-?\d+", digits) else None


def payload_figures(kind: str, fields: dict[bytes, bytes], block: bytes) -> tuple[int | None, str]:
    """(bytes, SHA-1) of a record's payload: its block without the HTTP head, if it has one; a revisit tells them of what it refers to."""
    http, gap, body = block.partition(_BREAK) if fields.get(b"content-type", b"").startswith(b"application/http") else (b"", b"", block)
    if kind == "revisit":
        size = _fields(http).get(b"content-length", b"")
        return int(size) if size.isdigit() else None, fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
    return len(body), hashlib.sha1(body).hexdigest()


FRAGMENT = "path string, file_size long, block long, rel long, bytes long, skip long, length long, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, head binary"


def fragment(raw: bytes) -> tuple:
    """Of what stands behind a separator: (bytes from there to the record's block, length of that or -1 if this is no candidate, fields; the payload's figures if it is all here, else the head)."""
    none = (0, -1, None, None, None, None, None, None)
    stop = raw.find(_BREAK) if VERSION.match(raw) else -1
    if stop < 0:
        return none
    fields = _fields(raw[3:stop])
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        return none
    length, block = int(size), stop + len(_BREAK)
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    whole = block + length <= len(raw)
    figures = payload_figures(kind, fields, raw[block : block + length]) if whole else (None, None)
    return block, length, _number(fields.get(b"warc-record-id", b"")), *figures, kind, _number(fields.get(b"warc-refers-to", b"")), None if whole else raw[:stop]


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """The batches with each fragment's place in its range; a range's fragments come one after another, each followed by a separator."""
    at: dict[tuple[str, int], int] = {}
    for b in K.slices(batches, "value"):
        keys = list(zip(b.column("path").to_pylist(), b.column("block").to_pylist(), strict=True))
        sizes = np.diff(K.buffers(b.column("value"))[1]).tolist()
        places = []
        for key, size in zip(keys, sizes, strict=True):
            if key not in at:
                at = {key: 0}
            places.append(at[key])
            at[key] += size + len(START)
        yield b, places


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.option("lineSep", START).option("pathGlobFilter", "part-*").text(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Mask of the candidates (by ascending offset) that the chain reaches from offset 0."""
    n = len(offsets)
    jump = np.full(n + 1, n, np.int64)  # n: the end
    at = np.searchsorted(offsets, successors)
    found = (at < n) & (offsets[np.minimum(at, n - 1)] == successors) if n else np.zeros(0, bool)
    jump[:n][found] = at[found]
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0 and offsets[0] == 0
    for _ in range(n.bit_length()):
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    return reached[:n]


VERIFIED = FRAGMENT + ", offset long, owner long"


def _verify(own: pd.DataFrame) -> pd.DataFrame:
    """The fragments of one file: of records those that the chain reaches, and of records in several fragments all, by their owner."""
    own = own.sort_values(["block", "rel"], ignore_index=True)
    sizes = own.groupby("block").bytes.sum() + len(START) * own.groupby("block").size()
    base = sizes.cumsum() - sizes
    # a record begins with the separator before its fragment
    own["offset"] = own.block.map(base) + own.rel - len(START)
    heads = own[own.length >= 0]
    offsets, size = heads.offset.to_numpy(), int(own.file_size.iloc[0])
    following = offsets + len(START) + heads.skip.to_numpy() + heads.length.to_numpy() + len(END)
    kept = reachable(offsets, following)
    last = int(following[kept].max(initial=0))
    if last != size:
        raise ValueError(f"{own.path.iloc[0]}: no record begins at {last}, where the one before ends")
    starts = offsets[kept]
    owner = starts[np.maximum(np.searchsorted(starts, own.offset.to_numpy(), "right") - 1, 0)] if len(starts) else np.zeros(len(own), np.int64)
    own["owner"] = owner
    is_record = np.zeros(len(own), bool)
    is_record[heads.index.to_numpy()[kept]] = True
    parted = pd.Series(owner).isin(own.owner[is_record & own["head"].notna()]).to_numpy() & (own.offset.to_numpy() >= 0)
    return own[is_record | parted].assign(record_type=lambda f: f.record_type.where(pd.Series(is_record, own.index)[f.index]))[[c.split()[0] for c in VERIFIED.split(", ")]]


def _gathered(own: pa.Table) -> pa.Table:
    """The figures of a record that came in several fragments."""
    rows = sorted(own.select(["offset", "value", "head", "skip", "length", "record_type"]).to_pylist(), key=lambda r: r["offset"])
    first = rows[0]
    raw = START.encode().join(r["value"] for r in rows)
    figures = payload_figures(first["record_type"], _fields(first["head"][3:]), raw[first["skip"] : first["skip"] + first["length"]])
    return pa.table({"path": own.column("path").slice(0, 1), "owner": own.column("owner").slice(0, 1), "n": pa.array([figures[0]], pa.int64()), "digest": pa.array([figures[1]], pa.string())})


def read_archives(spark: SparkSession, folder: str, space: Workspace | None = None) -> DataFrame:
    names = [c.split()[0] for c in FRAGMENT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in FRAGMENT.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, places in _fragments(batches):
            raws = b.column("value").to_pylist()
            rows = list(zip(*(fragment(r) for r in raws), strict=True))
            columns = [b.column("path"), b.column("file_size"), b.column("block"), places, [len(r) for r in raws], *rows]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, places in _fragments(batches):
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("block"), pa.array(places, pa.int64()), b.column("value")], names=["path", "block", "rel", "value"])

    space = space or Workspace(spark, "warc")
    found = space.save(_scan(spark, folder).mapInArrow(K.tidy(emit), FRAGMENT).groupBy("path").applyInPandas(_verify, VERIFIED), "verified")
    file: Column = F.substring_index("path", "/", -1).alias("file")
    plain = [F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), file, "offset"]
    whole = found.filter("head IS NULL AND record_type IS NOT NULL AND owner = offset").select(*plain)
    spread = found.filter("head IS NOT NULL AND record_type IS NOT NULL AND owner = offset")
    key = ["path", "owner"]
    parts = found.join(spread.select(*key), key, "left_semi").select("path", "block", "rel", "owner", "offset", "head", "skip", "length", "record_type")
    n = parts.count()
    if not n:
        return whole
    texts = _scan(spark, folder).mapInArrow(K.tidy(place), "path string, block long, rel long, value binary")
    texts = texts.join(F.broadcast(parts) if n <= BROADCAST_ROWS else parts, ["path", "block", "rel"])
    figures = texts.groupBy(*key).applyInArrow(K.tidy(_gathered), "path string, owner long, n long, digest string")
    spread = spread.join(figures, key).withColumns({"payload_bytes": F.col("n"), "payload_digest": F.col("digest")}).select(*plain)
    return whole.unionByName(spread)


def archive_round_trip(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    space = Workspace(spark, "warc")
    return read_archives(spark, write_archives(pages, space, least), space)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
t AS (SELECT digest, max(page_id) AS target FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN target IS NOT NULL AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN target IS NOT NULL AND page_id IS DISTINCT FROM target THEN target END AS refers_to
FROM p LEFT JOIN t ON p.digest = t.digest AND p.n >= 1000
"""

"""Releases: staged Parquet, checks that must all be zero, a logical digest, a content-addressed folder and a pointer.

Parquet bytes aren't the same from write to write, so a release is named by the hash of a manifest whose
digests are of logical rows. All of it lies on a store that the cluster shares. A staged folder is moved to its address once; pointers
are numbered files of which each can be written once, so of two publishers that saw the same pointer one fails and nothing is lost.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.digests import keyed_digest
from ledgerline.plans.store import Store

RECALL_GATE, GATE_CASES = 0.90, 10


class ReleaseError(RuntimeError):
    pass


def canonical(value: object) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def build(
    spark: SparkSession, tables: dict[str, DataFrame], output: str, *, keys: dict[str, list[str]] | None = None, checks: DataFrame | None = None,
    lineage: dict | None = None, limit: int | None = None, publish: bool = False,
) -> dict:
    """Writes the tables to a staging folder, checks, digests, and moves them to their address; a limited build can't be published.

    keys: of the tables, by name; without one all columns are. The pointer that is replaced is the one that was there at the start.
    """
    if limit is not None and publish:
        raise ReleaseError("a limited build can't be published")
    store, staging = Store(spark, output), f".staging-{uuid.uuid4().hex}"
    seen = newest_pointer(store)
    try:
        digests = {}
        for name, frame in sorted(tables.items()):
            own = frame.limit(limit) if limit is not None else frame
            own.write.parquet(store.place(f"{staging}/{name}"))
            digests[name] = {"key": (keys or {}).get(name) or sorted(frame.columns)}
            digests[name]["sha256"] = keyed_digest(spark.read.parquet(store.place(f"{staging}/{name}")), digests[name]["key"])
        if checks is not None and (bad := [tuple(r) for r in checks.filter("n <> 0").collect()]):
            raise ReleaseError(f"checks failed: {bad}")
        manifest = {"tables": digests, "lineage": lineage or {}, "limited": limit is not None}
        address = hashlib.sha256(canonical(manifest)).hexdigest()
        store.write_new(f"{staging}/manifest.json", canonical(manifest))
        try:
            store.move(staging, address)
        except FileExistsError:  # the same rows have been built before, or are being moved by another build
            if store.read(f"{address}/manifest.json") != canonical(manifest):
                raise ReleaseError("another release has this address") from None
        if publish:
            point(store, address, seen)
        return {"release": address, **manifest}
    finally:
        store.delete(staging)


def newest_pointer(store: Store) -> int:
    """The number of the pointer that holds; 0 before the first."""
    return max((int(n.removesuffix(".json")) for n in store.names("pointers") if n.endswith(".json") and n[:-5].isdigit()), default=0)


def point(store: Store, address: str, seen: int) -> None:
    """The next pointer, if none has come since the one that was seen."""
    try:
        store.write_new(f"pointers/{seen + 1:08d}.json", canonical({"release": address}))
    except FileExistsError:
        raise ReleaseError("another release was published meanwhile") from None


def load(spark: SparkSession, output: str, *, verify: bool = True) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, tables) of the release that the newest pointer names; every table's digest is checked."""
    store = Store(spark, output)
    number = newest_pointer(store)
    if not number:
        raise ReleaseError("nothing has been published")
    address = json.loads(store.read(f"pointers/{number:08d}.json"))["release"]
    if not (len(address) == 64 and set(address) <= set("0123456789abcdef")):
        raise ReleaseError("the pointer names no release")
    raw = store.read(f"{address}/manifest.json")
    if hashlib.sha256(raw).hexdigest() != address:
        raise ReleaseError("the manifest isn't the pointer's")
    manifest = json.loads(raw)
    tables = {name: spark.read.parquet(store.place(f"{address}/{name}")) for name in manifest["tables"]}
    for name, frame in tables.items() if verify else ():
        told = manifest["tables"][name]
        if keyed_digest(frame, told["key"]) != told["sha256"]:
            raise ReleaseError(f"{name} was changed")
    return manifest | {"release": address}, tables


def smoke_recall(hits: DataFrame, cases: DataFrame) -> tuple[float, int]:
    """(recall, cases): of the smoke cases (case_id, chunk_id) those whose chunk is among their hits (case_id, chunk_id, rank up to 10)."""
    found = cases.distinct().join(hits.filter("rank <= 10").select("case_id", "chunk_id", F.lit(True).alias("hit")).distinct(), ["case_id", "chunk_id"], "left")
    by = found.groupBy("case_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit")).agg(F.count("*").alias("n"), F.count_if("hit").alias("k")).first()
    return (by.k / by.n if by.n else 0.0), by.n


def publish_index(spark: SparkSession, folder: str, chunks: DataFrame, cases: DataFrame, search, output: str, pipeline_release: str) -> dict:
    """A stored index as a release, if it holds the chunks, the pipeline's release still holds, and its own recall of the smoke cases passes.

    cases: case_id, query, chunk_id; search(folder, query) -> hits with chunk_id and rank. The recall is computed here, on the index that is published.
    """
    from functools import reduce

    from ledgerline.operators.retrieval import index_faults

    asked = cases.select("case_id", "query").distinct().collect()  # the smoke cases, a few dozen
    hits = [search(folder, r["query"]).select(F.lit(r["case_id"]).alias("case_id"), "chunk_id", "rank") for r in asked]
    recall, n = smoke_recall(reduce(DataFrame.unionByName, hits), cases.select("case_id", "chunk_id")) if hits else (0.0, 0)
    gate(recall, n)
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("chunks", "postings", "figures")}
    lineage = {"pipeline": pipeline_release, "recall": round(recall, 6), "cases": n}
    keys = {"chunks": ["chunk_id"], "postings": ["term", "chunk_id"]}
    return build(spark, tables, output, keys=keys, checks=index_faults(spark, folder, chunks.select("chunk_id")), lineage=lineage, publish=True)


def gate(recall: float, cases: int) -> None:
    """An index is published with enough smoke cases and recall only."""
    if cases < GATE_CASES or recall < RECALL_GATE:
        raise ReleaseError(f"recall {recall:.3f} of {cases} cases; at least {RECALL_GATE} of {GATE_CASES} is needed")


def same_lineage(index_manifest: dict, pipeline_release: str) -> None:
    if index_manifest.get("lineage", {}).get("pipeline") != pipeline_release:
        raise ReleaseError("the index was built on another release")


def input_hashes(files: DataFrame) -> DataFrame:
    """name, sha256 of every input file, by name."""
    return files.select("receipt", "name", F.sha2("content", 256).alias("sha256")).orderBy("receipt", "name")


def audit(spark: SparkSession, files: DataFrame, expected: dict[str, int], output: str) -> dict:
    """Publishes a report of the input files and their hashes; counts by suffix must be those expected."""
    suffix = F.lower(F.element_at(F.split("name", r"\."), -1))
    report = files.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
    want = spark.createDataFrame(list(expected.items()), "suffix string, expected long")
    faults = report.join(want, "suffix", "full").select(F.concat(F.lit("files."), "suffix").alias("check"), F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("expected", F.lit(0))).alias("n"))
    return build(spark, {"report": report, "input_sha256": input_hashes(files)}, output, checks=faults, publish=True)


#: Rows of a table that a report shows.
SHOWN = 200


def report_page(title: str, parts: dict[str, DataFrame]) -> str:
    """A page of named tables, the first SHOWN rows of each, for people to look at."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, frame in parts.items():
        rows = frame.limit(SHOWN + 1).collect()
        cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
        out.append(f"<h2>{escape(name)}</h2><table>{cells('th', frame.columns)}{''.join(cells('td', r) for r in rows[:SHOWN])}</table>")
        if len(rows) > SHOWN:
            out.append(f"<p>more than {SHOWN} rows</p>")
    return "".join(out)


#: Receipts of filings that aren't read, as their only file is a PDF.
UNSUPPORTED = ("20260619000667", "20240514001522", "20260513000860")


def supported(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filings that are read, those of the list that aren't)."""
    listed = F.col("rcept_no").isin(*UNSUPPORTED)
    return docs.filter(~listed), docs.filter(listed)

"""File sources: manifest, universe, raw filings, archives, catalogs, listings and statements.

Rows that break a rule stay visible: readers return what is good, and `*_faults` what isn't, by rule.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import schemas as S

_SAFE_PATH = r"^(?!.*(^|/)\.\.(/|$))raw/[^\\:*?\x00-\x1f]+$"
TEXT_SUFFIXES = (".xml", ".html", ".htm", ".txt")
#: Bytes of an archive's members at most.
ARCHIVE_BYTES = 32 << 20


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a fixed schema; a line that is no JSON object of it is in _bad."""
    return spark.read.schema(S.MANIFEST_DDL + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def manifest_faults(rows: DataFrame) -> DataFrame:
    """rule, n: broken lines, missing fields, repeated keys, unknown values, unsafe paths."""
    good = rows.filter("_bad IS NULL")
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in S.MANIFEST_REQUIRED))
    rules = {
        "broken_line": rows.filter("_bad IS NOT NULL"), "missing_field": good.filter(missing), "bad_group": good.filter(~F.col("doc_group").isin(*S.DOC_GROUPS)), "bad_format": good.filter(~F.col("file_format").isin(*S.FILE_FORMATS)),
        "no_files": good.filter("n_files < 1"), "unsafe_path": good.filter(~F.col("file_path").rlike(_SAFE_PATH)), **{f"repeated_{k}": good.groupBy(k).count().filter("count > 1") for k in ("doc_id", "rcept_no")},
    }
    return reduce(DataFrame.unionByName, (f.agg(F.lit(k).alias("rule"), F.count("*").alias("n")) for k, f in rules.items()))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all strings, so that leading zeros stay; the byte order mark is dropped by the reader."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def universe_faults(rows: DataFrame) -> DataFrame:
    rules = {"no_code": rows.filter("corp_code IS NULL OR corp_code = ''"), "no_name": rows.filter("corp_name IS NULL OR corp_name = ''"), "repeated_code": rows.groupBy("corp_code").count().filter("count > 1")}
    return reduce(DataFrame.unionByName, (f.agg(F.lit(k).alias("rule"), F.count("*").alias("n")) for k, f in rules.items()))


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """receipt (the folder's name), name, length, modificationTime, content of every raw file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("receipt"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def ordered_sources(files: DataFrame) -> DataFrame:
    """Main file first (named as the receipt, else the largest), then the others by name, numbered from 1."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    main = F.row_number().over(Window.partitionBy("receipt").orderBy((stem == F.col("receipt")).desc(), F.col("length").desc(), "name")) == 1
    rows = files.filter(F.lower("name").rlike(r"\.(xml|html|htm|txt)$")).withColumn("main", main)
    return rows.withColumn("document_sequence", F.row_number().over(Window.partitionBy("receipt").orderBy(F.col("main").desc(), "name"))).withColumn("attachment", ~F.col("main"))


def largest_xml(files: DataFrame) -> DataFrame:
    rows = files.filter(F.lower("name").endswith(".xml"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("receipt").orderBy(F.col("length").desc(), "name"))).filter("_n = 1").drop("_n")


def decode(raw: bytes) -> str:
    """By byte order mark, by the declared encoding, as UTF-8 or CP949, else with replacements."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    declared = re.search(rb"(?i)(?:encoding|charset)\s*=\s*[\"']?([a-z0-9_-]+)", raw[:1024])
    for name in dict.fromkeys([*([declared[1].decode()] if declared else []), "utf-8", "cp949"]):
        try:
            return raw.decode("cp949" if name.lower() in ("euc-kr", "ks_c_5601-1987") else name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


def decoded(files: DataFrame) -> DataFrame:
    """content replaced by the text in `source`."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.drop("content").schema) + ", source string"
    names = files.drop("content").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([decode(c or b"") for c in b.column("content").to_pylist()], pa.string())], names=[*names, "source"])

    return files.select(*names, "content").mapInArrow(run, schema)


def archive_members(archives: DataFrame, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """receipt, content (zip) -> receipt, name, length, content of its text members, main first; a broken or too large archive has one row with its fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for receipt, raw in zip(b.column("receipt").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                        own = [i for i in z.infolist() if i.filename.lower().endswith(TEXT_SUFFIXES) and ".." not in i.filename.split("/")]
                        if sum(i.file_size for i in own) > limit:
                            rows.append((receipt, None, None, None, "too_large"))
                            continue
                        own.sort(key=lambda i: (i.filename.rsplit("/")[-1].rsplit(".")[0] != receipt, -i.file_size if i.filename.rsplit("/")[-1].rsplit(".")[0] == receipt else 0, i.filename))  # noqa: B023
                        rows += [(receipt, i.filename.rsplit("/")[-1], i.file_size, z.read(i), None) for i in own]
                except zipfile.BadZipFile:
                    rows.append((receipt, None, None, None, "broken"))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["receipt", "name", "length", "content", "fault"])

    return archives.select("receipt", "content").mapInArrow(run, "receipt string, name string, length long, content binary, fault string")


#: Fields of the company catalog.
CATALOG = ("corp_code", "corp_name", "corp_eng_name", "stock_code", "modify_date")
#: Bytes of the catalog at most, and the status that the service answers in its place.
CATALOG_BYTES = 64 << 20


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The company catalog's rows: of its XML, or of the one XML member of each zip.

    A file that is no zip and no catalog but an answer with a status raises that status's error.
    """
    if not path.lower().endswith(".zip"):
        return spark.read.format("xml").option("rowTag", "list").schema(", ".join(f"{c} string" for c in CATALOG)).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                rows = []
                for _, item in ElementTree.iterparse(io.BytesIO(catalog_xml(raw))):
                    if item.tag == "list":
                        rows.append(tuple(item.findtext(c) for c in CATALOG))
                        item.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [()] * len(CATALOG))], names=list(CATALOG))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{c} string" for c in CATALOG))


def catalog_xml(raw: bytes) -> bytes:
    """The catalog's XML out of its zip."""
    from ledgerline.sources.paged import SourceError, rows_of

    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            own = [i for i in z.infolist() if i.filename.lower().endswith(".xml")]
            if len(own) != 1 or own[0].file_size > CATALOG_BYTES:
                raise SourceError("a catalog is one XML file of at most 64 MB")
            return z.read(own[0])
    except zipfile.BadZipFile:
        status = re.search(rb"<status>\s*([0-9]{3})\s*</status>", raw)
        rows_of({"status": status[1].decode() if status and status[1] != b"000" else "broken"})
        raise SourceError("the catalog is empty") from None


def catalog_rows(rows: DataFrame) -> DataFrame:
    """Rows with a code of at most eight digits and a name of at most 200 characters; an odd stock code is blank."""
    stock = F.trim(F.coalesce("stock_code", F.lit("")))
    good = rows.filter(F.trim("corp_code").rlike("^[0-9]{1,8}$") & F.length(F.trim("corp_name")).between(1, 200))
    return good.withColumns({"corp_code": F.trim("corp_code"), "corp_name": F.trim("corp_name"), "stock_code": F.when(stock.rlike("^[0-9A-Za-z]{1,6}$"), stock).otherwise("")})


def import_events(old: DataFrame, docs: DataFrame) -> DataFrame:
    """Columns that the event relation has, numbers as strings, JSON written anew or null, known documents only."""
    known = [c.strip().split()[0] for c in S.EVENT_DDL.split(",")]
    text = lambda c: F.to_json(F.try_parse_json(F.col(c).cast("string"))) if c.endswith("_json") else F.col(c).cast("string") if c != "is_correction" else F.col(c).cast("boolean")
    return old.select(*(text(c).alias(c) for c in known if c in old.columns)).join(docs.select("doc_id"), "doc_id", "left_semi")


def layout_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Filings whose number of files or suffixes don't fit their format, or that aren't on both sides."""
    found = files.groupBy("receipt").agg(F.count("*").alias("found"), F.array_sort(F.collect_set(F.lower(F.element_at(F.split("name", r"\."), -1)))).alias("suffixes"))
    both = manifest.select(F.col("rcept_no").alias("receipt"), "n_files", "file_format").join(found, "receipt", "full")
    odd = F.when(F.col("found").isNull(), "missing").when(F.col("n_files").isNull(), "unlisted").when(F.col("found") != F.col("n_files"), "file_count").when((F.col("file_format") == "xml") & (F.size(F.array_except("suffixes", F.array(F.lit("xml")))) > 0), "suffix")
    return both.withColumn("fault", odd).filter("fault IS NOT NULL").select("receipt", "fault")

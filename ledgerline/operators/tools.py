"""The read-only lookups: citations, events, filings, sections, section text."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import loose_decimal
from ledgerline.functions.text import plain_key


def link_status() -> Column:
    """Originals have no link; corrections carry their link's status."""
    return F.when(~F.col("is_correction"), "original").otherwise(F.col("status"))


def with_citation(facts: DataFrame, docs: DataFrame, status: DataFrame, links: DataFrame, section: Column | None = None) -> DataFrame:
    """facts (with doc_id) with the twelve citation columns as one struct; the filing's metadata is joined once, with its status and, if there is one, its link."""
    meta = docs.select("doc_id", "rcept_no", "corp_code", "report_nm", "rcept_dt", "is_correction", *[c for c in ("corp_name",) if c in docs.columns])
    meta = meta.join(status, "rcept_no").join(links.select(F.col("correction_rcept_no").alias("rcept_no"), "status", "method"), "rcept_no", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = text("corp_name") if "corp_name" in docs.columns else F.lit("")
    cite = F.struct(
        F.col("doc_id"), F.col("rcept_no"), text("corp_code").alias("corp_code"), name.alias("corp_name"), text("report_nm").alias("report_nm"), F.regexp_replace(text("rcept_dt"), "-", "").alias("rcept_dt"),
        F.lit("").alias("section"), F.col("is_latest"), text("root_rcept_no").alias("root_rcept_no"), text("latest_rcept_no").alias("latest_rcept_no"), F.coalesce(link_status(), F.lit("")).alias("correction_status"), text("method").alias("correction_method"),
    )
    out = facts.join(meta.select("doc_id", cite.alias("citation")), "doc_id")
    return out if section is None else out.withColumn("citation", F.col("citation").withField("section", section))


def equal_filters(frame: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal all values that aren't None."""
    for name, value in wanted.items():
        if value is not None:
            frame = frame.filter(F.col(name) == F.lit(value))
    return frame


def _plain(c: str) -> Column:
    return F.regexp_replace(F.col(c), "-", "")


def query_events(
    events: DataFrame, corp_code: str | None = None, *, event_types: Iterable[str] | None = None, rcept_from: str | None = None, rcept_to: str | None = None, event_from: str | None = None, event_to: str | None = None,
    min_amount: str | None = None, max_amount: str | None = None, latest_only: bool = False, limit: int | None = None,
) -> DataFrame:
    """Events by all filters that are given, newest first; amounts are compared as exact decimals and before the limit."""
    out = equal_filters(events, corp_code=corp_code)
    if event_types is not None:
        out = out.filter(F.col("event_type").isin(list(event_types)))
    for name, lo, hi in (("rcept_dt", rcept_from, rcept_to), ("event_date", event_from, event_to)):
        if lo:
            out = out.filter(_plain(name) >= lo)
        if hi:
            out = out.filter(_plain(name) <= hi)
    if latest_only:
        out = out.filter("is_latest")
    if min_amount is not None or max_amount is not None:
        amount = loose_decimal(F.col("amount"))
        if min_amount is not None:
            out = out.filter(amount >= F.lit(min_amount).cast("decimal(38,6)"))
        if max_amount is not None:
            out = out.filter(amount <= F.lit(max_amount).cast("decimal(38,6)"))
    out = out.orderBy(F.coalesce("event_date", "rcept_dt").desc(), F.col("rcept_no").desc(), F.col("doc_id").desc())
    return out if limit is None else out.limit(limit)


def of_event_types(rows: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Rows whose event type or report name holds one of the wanted types, both without marks and blanks and in lower case."""
    keys = [F.lit(re.sub("[^0-9A-Za-z가-힣]", "", w).lower()) for w in wanted]
    if not keys:
        return rows
    hit = reduce(lambda a, b: a | b, (F.contains(plain_key(F.col(c)), k) for c in ("event_type", "report_nm") for k in keys))
    return rows.filter(hit)


def include_details(n_rows: int, asked: bool | None) -> bool:
    """Details are shown if asked for, or if nothing was said and there are five rows at most."""
    return n_rows <= 5 if asked is None else asked


def within_budget(rows: DataFrame, order: list, size: Column, budget: int = 60_000, base: int = 64) -> DataFrame:
    """Leading rows while their sizes, two more each and the base stay within the budget; one row at least.

    A row takes two characters at least, so rows beyond that many can't be among them and needn't be added up.
    """
    rows = rows.orderBy(*order).limit(budget // 2 + 1)
    w = Window.orderBy(*order)
    used = F.sum(size + 2).over(w.rowsBetween(Window.unboundedPreceding, 0)) + base
    return rows.withColumns({"_used": used, "_n": F.row_number().over(w)}).filter(f"_used <= {budget} OR _n = 1").drop("_used", "_n")


def list_filings(docs: DataFrame, corp_code: str | None = None, *, doc_group: str | None = None, doc_subtype: str | None = None, base_year: int | None = None, base_month: int | None = None, rcept_from: str | None = None, rcept_to: str | None = None, latest_only: bool = False, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1..200")
    out = equal_filters(docs, corp_code=corp_code, doc_group=doc_group, doc_subtype=doc_subtype, base_year=base_year, base_month=base_month)
    if rcept_from:
        out = out.filter(F.col("rcept_dt") >= rcept_from)
    if rcept_to:
        out = out.filter(F.col("rcept_dt") <= rcept_to)
    if latest_only:
        out = out.filter("is_latest")
    return out.orderBy(F.col("rcept_dt").desc(), F.col("rcept_no").desc(), F.col("doc_id").desc()).limit(limit)


def basis_filter(path: Column, basis: str | None) -> Column:
    """consolidated: names both words; separate: a statement that isn't consolidated."""
    if basis is None:
        return F.lit(True)
    joint = F.contains(path, F.lit("연결"))
    return (joint if basis == "consolidated" else ~joint) & F.contains(path, F.lit("재무제표"))


def list_sections(chunks: DataFrame, *, by: list[str] = ["doc_id"], basis: str | None = None, limit: int | None = None) -> DataFrame:  # noqa: B006
    """Inventory of sections, in document order, the first `limit` of each key if asked for; the text isn't read."""
    rows = chunks.filter(basis_filter(F.col("path"), basis)).select(*by, "path", "n_chars", "n_tables", "document_sequence", "part", "chunk_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("document_sequence", "part", "chunk_id"))), lambda x: x["part"])
    out = rows.groupBy(*by, "path").agg(F.count("*").alias("n_chunks"), F.sum("n_chars").alias("n_chars"), F.sum("n_tables").alias("n_tables"), parts.alias("parts"), F.min("document_sequence").alias("first_sequence"))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("first_sequence", "path")))
    return out if limit is None else out.filter(F.col("place") <= limit)


def read_section(chunks: DataFrame, *, by: list[str] = ["doc_id", "path"], max_chars: int = 12_000) -> DataFrame:  # noqa: B006
    """Chunks of a section in order, cut where the text with line ends between reaches max_chars."""
    w = Window.partitionBy(*by).orderBy("document_sequence", "part", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    left = F.lit(max_chars) - F.col("_before")
    rows = chunks.withColumn("_before", before).filter(F.col("_before") < max_chars)
    return rows.withColumns({"truncated": F.length("text") > left, "text": F.substring(F.col("text"), F.lit(1), left.cast("int"))}).drop("_before")


def latest_per_root(rows: DataFrame, amount: Column) -> DataFrame:
    """Exact totals of the latest versions by company and event type."""
    return rows.filter("is_latest").groupBy("corp_code", "event_type").agg(F.sum(amount).alias("total"), F.count("*").alias("n_events"))

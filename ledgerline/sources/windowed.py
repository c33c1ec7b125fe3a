"""Listings of a period, complete whatever their length: date windows that are halved until each fits the service's bound on pages.

A window's first page tells how many there are. Planning asks for that page alone, halves windows with more pages than may be read, and makes a
partition of every page of the others, so pages are read in parallel and nothing beyond the last page is ever asked for. A first page's
rows go with its partition, so no page is asked for twice. Only a single day that doesn't fit stays bounded, and is named.

Statement requests are parted likewise: a partition for each batch of companies, after the checks of year and report.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.schemas import LIST_DDL, STATEMENT_DDL
from ledgerline.sources.paged import MAX_PAGES, MOST_PAGES, PAGE_SIZE, SourceError, rows_of

#: Windows that a plan may have; beyond, the period is too long for one read.
MOST_WINDOWS = 4096
#: First year of statements, report codes, companies of one request.
FIRST_YEAR, REPORT_CODES, BATCH = 2015, ("11011", "11012", "11013", "11014"), 100


def _day(text: str) -> dt.date:
    return dt.datetime.strptime(str(text), "%Y%m%d").date()


def _fetcher(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def total_pages(answer: dict, rows: int, size: int) -> int:
    """Pages that a first page tells of; one that isn't full is the only one, whatever it tells."""
    if rows < size:
        return 1
    told = str(answer.get("total_page", "1"))
    if not told.isdecimal():
        raise SourceError(f"total_page is {told!r}")
    return max(1, int(told))


class Page(InputPartition):
    """A page of a window, with its rows if planning has read them."""

    def __init__(self, query: dict, number: int, rows: list[dict] | None = None) -> None:
        super().__init__((json.dumps(query, sort_keys=True), number))
        self.query, self.number, self.rows = query, number, rows


def plan(fetch, query: dict, pages: int, size: int) -> tuple[list[Page], list[str]]:
    """(pages of all windows of the query's period in its order, days that stay bounded)."""
    out: list[Page] = []
    bounded: list[str] = []
    open_ = [(_day(query["bgn_de"]), _day(query["end_de"]))]
    if open_[0][0] > open_[0][1]:
        raise ValueError("the period ends before it begins")
    asked = 0
    while open_:
        first, last = open_.pop()
        asked += 1
        if asked > 2 * MOST_WINDOWS:
            raise SourceError(f"the period needs more than {MOST_WINDOWS} windows")
        own = query | {"bgn_de": first.strftime("%Y%m%d"), "end_de": last.strftime("%Y%m%d")}
        answer = fetch(own, 1, size)
        rows = rows_of(answer)
        n = total_pages(answer, len(rows), size) if rows else 0
        if n > pages and first < last:
            middle = first + (last - first) // 2
            open_ += [(middle + dt.timedelta(days=1), last), (first, middle)]
            continue
        if n > pages:
            bounded.append(own["bgn_de"])
        if n:
            out += [Page(own, 1, rows), *(Page(own, i) for i in range(2, min(n, pages) + 1))]
    return out, bounded


def _tuples(rows: list[dict], names: list[str]) -> Iterator[tuple]:
    for row in rows:
        yield tuple(None if row.get(n) is None else str(row[n]) for n in names)


class _WindowReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.names, self.query, self.fetch = names, json.loads(options["query"]), options["fetch"]
        self.pages, self.size = int(options.get("pages", MAX_PAGES)), int(options.get("pagesize", PAGE_SIZE))
        if not 1 <= self.pages <= MOST_PAGES:
            raise ValueError(f"pages must be 1..{MOST_PAGES}")

    def partitions(self) -> list[InputPartition]:
        found = plan(_fetcher(self.fetch), self.query, self.pages, self.size)[0]
        return found or [Page(self.query, 0, [])]

    def read(self, partition: Page) -> Iterator[tuple]:
        rows = partition.rows
        if rows is None:
            rows = rows_of(_fetcher(self.fetch)(partition.query, partition.number, self.size))
        yield from _tuples(rows, self.names)


class WindowedListing(DataSource):
    """format("windowed_listing"): all filings of a period. query: bgn_de, end_de and whatever else the fetcher takes."""

    @classmethod
    def name(cls) -> str:
        return "windowed_listing"

    def schema(self) -> str:
        return LIST_DDL

    def reader(self, schema) -> DataSourceReader:
        return _WindowReader(self.options, schema.fieldNames())


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.names, self.fetch = names, options["fetch"]
        codes = list(dict.fromkeys(json.loads(options["companies"])))
        year, report = int(options["year"]), str(options["report"])
        if bad := [c for c in codes if not (isinstance(c, str) and len(c) == 8 and c.isdecimal())]:
            raise ValueError(f"company codes have eight digits: {bad[:3]}")
        if not codes or year < FIRST_YEAR or report not in REPORT_CODES:
            raise ValueError(f"statements need companies, a year from {FIRST_YEAR} on and a report of {', '.join(REPORT_CODES)}")
        self.queries = [{"corp_code": ",".join(codes[i : i + BATCH]), "bsns_year": str(year), "reprt_code": report} for i in range(0, len(codes), BATCH)]

    def partitions(self) -> list[InputPartition]:
        return [Page(q, 1) for q in self.queries]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _tuples(rows_of(_fetcher(self.fetch)(partition.query, 1, BATCH)), self.names)


class BatchedStatements(DataSource):
    """format("batched_statements"): statement rows of many companies, BATCH of them a request. companies: a JSON list of codes."""

    @classmethod
    def name(cls) -> str:
        return "batched_statements"

    def schema(self) -> str:
        return STATEMENT_DDL

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    for source in (WindowedListing, BatchedStatements):
        spark.dataSource.register(source)


def listing(spark: SparkSession, fetch: str, query: dict, pages: int = MAX_PAGES, size: int = PAGE_SIZE) -> tuple[DataFrame, list[str]]:
    """(all rows of the period, what to say of days that don't fit in the pages)."""
    register(spark)
    bounded = plan(_fetcher(fetch), query, pages, size)[1]
    rows = spark.read.format("windowed_listing").options(fetch=fetch, query=json.dumps(query), pages=str(pages), pagesize=str(size)).load()
    return rows, [f"listing of {day} was bounded at {pages} pages of {size}" for day in bounded]

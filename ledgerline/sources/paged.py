"""Paged list source as a Python data source: a partition per page, so pages are read in parallel.

The pages come from a fetcher, `module:function` taking (query, page number, page size) and returning the
service's answer as a dict; landed JSON files serve through the same reader with `path`. Status codes become
exceptions of their own, so that an error is never taken for no data.
"""

from __future__ import annotations

import importlib
import json
import warnings
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.schemas import LIST_DDL, STATEMENT_DDL

#: Pages read if none are asked for, and the most that may be.
PAGE_SIZE, MAX_PAGES, MOST_PAGES = 100, 5, 10


class SourceError(RuntimeError):
    kind = "api_error"


class AuthError(SourceError):
    kind = "auth"


class QuotaError(SourceError):
    kind = "quota"


class ServiceError(SourceError):
    kind = "service"


#: Status codes of the service.
_ERRORS = dict.fromkeys(("010", "011", "012"), AuthError) | dict.fromkeys(("020", "021"), QuotaError) | {"800": ServiceError}
_EMPTY = ("013", "014")


def rows_of(answer: dict) -> list[dict]:
    status = str(answer.get("status", ""))
    if status in _EMPTY:
        return []
    if status != "000":
        raise _ERRORS.get(status, SourceError)(f"status {status}: {answer.get('message', '')}")
    return list(answer.get("list") or [])


class _Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.names = names
        self.query = json.loads(options.get("query", "{}"))
        self.fetch, self.path = options.get("fetch"), options.get("path")
        self.pages = int(options.get("pages", MAX_PAGES))
        if not 1 <= self.pages <= MOST_PAGES:
            raise ValueError(f"pages must be 1..{MOST_PAGES}")
        self.size = int(options.get("pagesize", PAGE_SIZE))

    def partitions(self) -> list[InputPartition]:
        return [_Page(i + 1) for i in range(self.pages)]

    def _answer(self, page: int) -> dict:
        if self.fetch:
            module, _, name = self.fetch.partition(":")
            return getattr(importlib.import_module(module), name)(self.query, page, self.size)
        try:
            with open(f"{self.path}/page-{page}.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"status": "013"}

    def _bound(self, answer: dict) -> str | None:
        """What to say if there may be rows beyond the last page, which gave this answer."""
        rows = len(rows_of(answer))
        if rows and str(answer.get("total_page", "")).isdecimal():
            rows = self.size if int(answer["total_page"]) > self.pages else 0
        return scan_limit_reached((self.pages - 1) * self.size + rows, self.pages, self.size)

    def limitation(self) -> str | None:
        return self._bound(self._answer(self.pages))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        answer = self._answer(partition.value)
        if partition.value == self.pages and (said := self._bound(answer)):
            warnings.warn(said, stacklevel=1)
        for row in rows_of(answer):
            yield tuple(None if row.get(n) is None else str(row[n]) for n in self.names)


class PagedListing(DataSource):
    """format("paged_listing"): filings of a company or a period."""

    ddl = LIST_DDL

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return self.ddl

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema.fieldNames())


class PagedStatements(PagedListing):
    """format("paged_statements"): statement rows; the companies of a page are those of one request."""

    ddl = STATEMENT_DDL

    @classmethod
    def name(cls) -> str:
        return "paged_statements"


def register(spark) -> None:
    for source in (PagedListing, PagedStatements):
        spark.dataSource.register(source)


def read_bounded(spark, source: str = "paged_listing", **options: str) -> tuple:
    """(rows of the source, what to say if its bound was reached, else None); the last page is asked for once more, on the driver."""
    reader = _Reader({k.lower(): str(v) for k, v in options.items()}, [])
    return spark.read.format(source).options(**options).load(), reader.limitation()


def scan_limit_reached(rows: int, pages: int = MAX_PAGES, size: int = PAGE_SIZE) -> str | None:
    return f"listing was bounded at {pages} pages of {size}" if rows >= pages * size else None

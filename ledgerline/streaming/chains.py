"""Lineage of listed filings on a stream, chain by chain, with the same result as in batch.

A chain is what a company files under one report name. Its filings are the state of its key; a batch of a stream only touches the chains that it
has filings for, and nothing is read again. Filings may come late, in any order, again, and with flags that were added since: the chain is
worked out anew from its own state and whatever has changed is told, so the last row of each receipt is the batch result.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). With `keep_ms`, a filing that hasn't been seen again for that long
leaves the state; what was told of it stays, and its chain goes on without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerline.functions.text import base_report_name

OUT = "corp_code string, chain string, rcept_no string, predecessor_rcept_no string, root_rcept_no string, latest_rcept_no string, is_latest boolean, withdrawn boolean, version long"
#: Flags of a withdrawn and of a corrected filing.
WITHDRAWN, CORRECTED = "철", "정"


def chain_lineage(filings: list[tuple[str, bool, str]]) -> list[tuple]:
    """(receipt, is_correction, flags) of one chain -> (receipt, predecessor, root, latest, is_latest, withdrawn), by receipt."""
    last: str | None = None
    root: dict[str, str] = {}
    newest: dict[str, str] = {}
    links: dict[str, str | None] = {}
    for receipt, corrects, flags in sorted(filings):
        links[receipt] = last if corrects else None
        root[receipt] = root[links[receipt]] if links[receipt] else receipt
        if WITHDRAWN not in flags:
            newest[root[receipt]] = receipt
            last = receipt if CORRECTED in flags else last
    return [(r, links[r], root[r], newest.get(root[r]), newest.get(root[r]) == r, WITHDRAWN in flags) for r, _, flags in sorted(filings)]


class Chains(StatefulProcessor):
    """State of a chain: its filings by receipt with what was last told of each, and how often the chain has changed."""

    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = lambda *names: StructType([StructField(n, StringType()) for n in names])
        self.filings = handle.getMapState("filings", text("rcept_no"), text("corrects", "flags", "told"), self.keep_ms)
        self.version = handle.getValueState("version", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        held = {r[0]: tuple(v) for r, v in self.filings.iterator()}
        for frame in rows:
            # of one receipt in a batch, the listing with the most flags is the newest: flags are only ever added
            for r in sorted(frame[["rcept_no", "corrects", "rm"]].itertuples(index=False), key=lambda r: len(r.rm or "")):
                before = held.get(r.rcept_no, ("", "", ""))
                held[r.rcept_no] = (str(int(r.corrects)), r.rm or before[1], before[2])
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        out = []
        for told in chain_lineage([(r, c == "1", flags) for r, (c, flags, _) in held.items()]):
            corrects, flags, before = held[told[0]]
            now = "|".join(map(str, told))
            if now != before:
                out.append((*key, *told, version))
            self.filings.updateValue((told[0],), (corrects, flags, now))
        self.version.update((version,))
        names = [c.split()[0] for c in OUT.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"version": "int64"}) if out else pd.DataFrame({n: pd.Series(dtype="object") for n in names}).astype({"version": "int64", "is_latest": "bool", "withdrawn": "bool"})

    def close(self) -> None:
        pass


def lineage_changes(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """corp_code, report_nm, rcept_no, rm -> a row for each filing whose lineage is new or has changed, numbered by its chain's version."""
    chain = F.lower(F.regexp_replace(base_report_name(F.col("report_nm")), "[^0-9A-Za-z가-힣]", ""))
    rows = stream.select("corp_code", chain.alias("chain"), "rcept_no", F.col("report_nm").rlike(r"^\s*\[[^\]]*정정").alias("corrects"), "rm")
    mode = "ProcessingTime" if keep_ms else "None"
    return rows.groupBy("corp_code", "chain").transformWithStateInPandas(Chains(keep_ms), OUT, "Update", mode)


def current(changes: DataFrame) -> DataFrame:
    """The last row of each receipt out of all that was told."""
    last = F.max(F.struct("version", *[c.split()[0] for c in OUT.split(", ")[3:-1]])).alias("x")
    return changes.groupBy("corp_code", "chain", "rcept_no").agg(last).select("corp_code", "chain", "rcept_no", "x.*").drop("version")

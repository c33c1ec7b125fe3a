"""Incremental lineage and dialogue state on streams: extensions, with the same results as in batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.operators.lineage import listed_lineage


def lineage_by_company(stream: DataFrame, history: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """foreachBatch over listed filings: the lineage of the companies that a batch touches is worked out anew over their history and the batch.

    Corrections are late versions of what came before, so a chain can change far back; a company is the unit that contains it.
    history() reads what has been written so far; write() replaces the companies' rows.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        touched = batch.select("corp_code").distinct()
        rows = history().select(*batch.columns).join(F.broadcast(touched), "corp_code", "left_semi").unionByName(batch).dropDuplicates(["rcept_no"])
        write(listed_lineage(rows), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_mark(rows: DataFrame) -> DataFrame:
    """The mark by which cached answers age: the greatest receipt date and receipt."""
    return rows.agg(F.max(F.concat_ws(":", "rcept_dt", "rcept_no")).alias("mark"))


CONTEXT = "company string, year int, turns int"


def dialogue(turns: DataFrame, companies: list[str]) -> DataFrame:
    """conv_id, turn, text -> the company and year that each turn is about, carried from turn to turn."""
    import re

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        company, year, n = state.get if state.exists else (None, None, 0)
        out = []
        for b in batches:
            for r in b.sort_values("turn").itertuples():
                company = next((c for c in companies if c in (r.text or "")), company)
                years = re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", r.text or "")
                if years:
                    year = int(years[-1])
                elif year is not None and re.search("전년|작년|previous year", r.text or ""):
                    year -= 1
                n += 1
                out.append((key[0], r.turn, company, year))
        state.update((company, year, n))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "company", "year"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn int, company string, year int", CONTEXT, "append", GroupStateTimeout.NoTimeout)

"""Totals of tables that must add up, investments executed in a year, sums of announced investments, and contracts that were ended later.

A total is only told if its table proves it: every row can be read, the rows that it adds up are there, and the sums agree to the last unit.
Everything else abstains and says why in `state`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import DECIMAL, WON, accounting, in_won, strict_accounting
from ledgerline.functions.text import compact, plain_key
from ledgerline.operators.extractors import table_cells
from ledgerline.session import dealt

#: Labels of a table's total row, and words in the label of a part's total.
TOTALS = ("합계", "총계")
SUBTOTAL = "소계|부분합"
#: Headers of executed amounts, words that rule a header out, headers of the period.
EXECUTED = (r"^당\s*기\s*투\s*자\s*액$", r"^제\s*[0-9]+\s*기\s*투\s*자\s*액$", r"^투\s*자\s*실\s*적$", r"^당\s*기\s*실\s*적$", r"^실\s*적\s*금\s*액$")
NOT_EXECUTED = (r"예\s*상", r"계\s*획", r"향\s*후", r"기\s*초", r"기\s*말", r"감\s*가\s*상\s*각", r"장\s*부\s*금\s*액", r"손\s*상\s*차\s*손")
PERIOD_HEADERS = ("투자기간", "기간", "사업연도", "대상기간")
#: Event types and the amount of an investment; events of a company above which no sum is given.
INVESTMENT, CONTRACT, TERMINATION = "신규시설투자등", "단일판매공급계약체결", "단일판매공급계약해지"
MOST_EVENTS = 3
#: Characters of names that types may be written with or without.
_MARKS = r"[\s·ㆍ]"


def row_kind(label: Column) -> Column:
    """total, subtotal or member."""
    bare = F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)\s+", "")
    return F.when(bare.isin(*TOTALS), "total").when(bare.rlike(SUBTOTAL), "subtotal").otherwise("member")


def reconciled_totals(cells: DataFrame, about: int | None = None) -> DataFrame:
    """chunk_id, table_no, column_no, header, unit, members, subtotals, total, state: which rows add up to which total.

    A subtotal is the sum of the members since the subtotal before it, the total the sum of all members. State: unreadable (a number
    can't be read or is negative), uneven (rows of other widths), no_single_total, no_member, total_not_last, subtotal_differs, sum_differs, ok.
    about: how many cells there are at most, if that is known; they are dealt by it. A column is sorted once, for all that follows.
    """
    key = ["chunk_id", "table_no", "column_no"]
    rows = cells.select(*key, "header", "row_no", "unit", "even", row_kind(F.col("label")).alias("kind"), strict_accounting(F.col("value")).alias("v"))
    rows = dealt(rows, about, *key) if about else rows
    down, member = Window.partitionBy(*key, "header").orderBy("row_no"), F.when(F.col("kind") == "member", F.col("v"))
    rows = rows.withColumn("so_far", F.struct(F.sum(member).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.count(member).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("n")))
    # what stood at the subtotal before is not this one's
    rows = rows.withColumn("before", F.last(F.when(F.col("kind") == "subtotal", F.col("so_far")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    zero = F.lit(0).cast(DECIMAL)
    rows = rows.withColumn("own", F.when(F.col("so_far.n") > F.coalesce("before.n", F.lit(0)), F.col("so_far.s") - F.coalesce("before.s", zero)))
    out = rows.groupBy(*key, "header").agg(
        F.sum(F.when(F.col("kind") == "member", F.col("v"))).alias("members"), F.max(F.when(F.col("kind") == "total", F.col("v"))).alias("total"), F.min("unit").alias("unit"),
        F.count_if(F.col("kind") == "total").alias("n_totals"), F.count_if(F.col("kind") == "subtotal").alias("subtotals"), F.count_if(F.col("kind") == "member").alias("n_members"),
        F.count_if(F.col("v").isNull()).alias("bad"), F.bool_or(~F.col("even")).alias("uneven"), (F.max(F.when(F.col("kind") == "total", F.col("row_no"))) < F.max("row_no")).alias("early"),
        F.count_if((F.col("kind") == "subtotal") & ~F.coalesce(F.col("v") == F.col("own"), F.lit(False))).alias("off"),
    )
    state = (
        F.when(F.col("uneven"), "uneven").when(F.col("bad") > 0, "unreadable").when(F.col("n_totals") != 1, "no_single_total").when(F.col("n_members") == 0, "no_member").when(F.col("early"), "total_not_last")
        .when(F.col("off") > 0, "subtotal_differs").when(F.col("members") != F.col("total"), "sum_differs").otherwise("ok")
    )
    return out.withColumn("state", state).drop("n_totals", "n_members", "bad", "uneven", "early", "off")


def checked_totals(cells: DataFrame) -> DataFrame:
    """The same for tables that may not have parts: one with subtotals is refused as such."""
    out = reconciled_totals(cells)
    return out.withColumn("state", F.when(F.col("subtotals") > 0, "subtotal").otherwise(F.col("state")))


def is_annual_period(period: Column, year: int) -> Column:
    """Exactly the months or days of one calendar year."""
    bare, y = F.regexp_replace(F.coalesce(period, F.lit("")), r"(?U)\s+", ""), rf"(?:{year}|['’]{year % 100:02d})"
    forms = (
        rf"{y}[.\-/]0?1[.\-/]0?1[~-]+(?:{y}[.\-/])?12[.\-/]31", rf"{y}[.\-/]0?1[~-]+(?:{y}[.\-/])?12", rf"{y}년(?:0?1월(?:0?1일)?)?[~-]+(?:{y}년)?12월(?:31일)?", rf"{y}년(?:당기)?",
    )
    return bare.rlike("^(?:" + "|".join(forms) + ")$")


def executed_investments(chunks: DataFrame, year: int) -> DataFrame:
    """corp_code -> amount, unit, won, state (ok, conflict) from annual reports of that year, latest versions, in sections of the business.

    A table counts if a column of executed amounts and one of periods are there, every member's period is the year, and the total is proven. A text
    with two such tables counts for none; all texts of a company must agree in amount and unit.
    """
    fit = chunks.filter(
        F.contains("report_nm", F.lit("사업보고서")) & F.contains("report_nm", F.lit(f"({year}.12)")) & ~F.col("report_nm").rlike("분기|반기") & F.col("is_latest") & (F.col("latest_rcept_no") == F.col("rcept_no"))
        & F.col("correction_status").isin("original", "linked") & F.col("path").startswith("II. 사업의 내용")
    )
    bare = F.regexp_replace(F.col("header"), r"(?U)\s+", "")
    any_of = lambda patterns: F.coalesce(bare.rlike("|".join(patterns)), F.lit(False))
    cells = table_cells(fit).withColumns({"executed": any_of(EXECUTED) & ~any_of(NOT_EXECUTED), "is_period": bare.isin(*PERIOD_HEADERS)})
    table = ["chunk_id", "table_no"]
    chosen = cells.groupBy(*table).agg(F.min(F.when(F.col("executed"), F.col("column_no"))).alias("amount_at"), F.min(F.when(F.col("is_period"), F.col("column_no"))).alias("period_at"))
    rows = cells.join(chosen.filter("amount_at IS NOT NULL AND period_at IS NOT NULL"), table)
    off = rows.filter((F.col("column_no") == F.col("period_at")) & (row_kind(F.col("label")) == "member") & ~is_annual_period(F.col("value"), year)).select(*table).distinct()
    good = checked_totals(rows.filter(F.col("column_no") == F.col("amount_at"))).filter("state = 'ok' AND unit IS NOT NULL").join(off, table, "left_anti")
    single = good.groupBy("chunk_id").agg(F.count("*").alias("k"), F.max("total").alias("total"), F.max(compact(F.col("unit"))).alias("unit")).filter("k = 1")
    by = single.join(fit.select("chunk_id", "corp_code"), "chunk_id").groupBy("corp_code").agg(F.count_distinct("total", "unit").alias("k"), F.max("total").alias("total"), F.max("unit").alias("unit"))
    known = F.col("k") == 1
    return by.select("corp_code", F.when(known, F.col("total")).alias("amount"), F.when(known, F.col("unit")).alias("unit"), F.when(known & F.col("unit").isin(*WON), in_won(F.col("total"), F.col("unit"))).alias("won"), F.when(known, "ok").otherwise("conflict").alias("state"))


def investment_sums(events: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: request_id, corp_code -> total of a company's announced investments, its rank in the request, difference to the next, state.

    Events: corp_code, event_type, amount, amount_type, root_rcept_no, rcept_no, is_latest. A version that isn't the latest makes the company abstain
    (stale), so do different amounts of one root, amounts that can't be read, and more than MOST_EVENTS roots. A request's companies are compared only if all have a total.
    """
    own = events.filter(F.regexp_replace("event_type", _MARKS, "") == INVESTMENT).filter(F.coalesce(F.col("amount_type").startswith("투자금액"), F.lit(False)))
    value = accounting(F.col("amount"))
    roots = own.groupBy("corp_code", "root_rcept_no").agg(F.max(value).alias("v"), F.count_distinct(value).alias("k"), F.count_if(value.isNull() | (value < 0)).alias("bad"), F.count_if(~F.col("is_latest")).alias("stale"))
    sums = roots.groupBy("corp_code").agg(F.sum("v").alias("total"), F.count("*").alias("n"), F.max("k").alias("k"), F.sum("bad").alias("bad"), F.sum("stale").alias("stale"))
    rows = asked.join(sums, "corp_code", "left")
    state = F.when(F.col("n").isNull(), "absent").when(F.col("stale") > 0, "stale").when(F.col("bad") > 0, "unreadable").when(F.col("k") > 1, "conflict").when(F.col("n") > MOST_EVENTS, "too_many").otherwise("ok")
    rows = rows.withColumn("state", state).withColumn("total", F.when(F.col("state") == "ok", F.col("total")))
    request = Window.partitionBy("request_id")
    order = request.orderBy(F.col("total").desc_nulls_last(), "corp_code")
    whole = F.min(F.col("state") == "ok").over(request)
    rows = rows.withColumns({"rank": F.when(whole, F.row_number().over(order)), "difference": F.when(whole, F.col("total") - F.lead("total").over(order))})
    return rows.select("request_id", "corp_code", "total", "n", "rank", "difference", "state")


def contract_followups(events: DataFrame) -> DataFrame:
    """A row per contract and per termination: what ended it, or which contract it ended. One pass over each company's title, no pairs.

    Events: corp_code, event_type, title, counterparty, amount, event_date, rcept_no, is_latest. A contract is ended by the next termination of the same
    company, title and counterparty. A termination after several contracts that are still open is ambiguous for all of them; one after none has
    no known contract. Versions that aren't the latest are left out; what a termination says is its own amount and date.
    """
    kind = F.regexp_replace("event_type", _MARKS, "")
    rows = events.filter("is_latest").withColumn("kind", kind).filter(F.col("kind").isin(CONTRACT, TERMINATION))
    rows = rows.withColumns({"chain": plain_key(F.coalesce("title", F.lit(""))), "party": plain_key(F.coalesce("counterparty", F.lit(""))), "ends": F.col("kind") == TERMINATION})
    key = ["corp_code", "chain", "party"]
    w = Window.partitionBy(*key).orderBy("event_date", "ends", "rcept_no")
    rows = rows.withColumn("stretch", F.coalesce(F.sum(F.when(F.col("ends"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy(*key, "stretch")
    last = F.max(F.when(F.col("ends"), F.struct("rcept_no", "event_date", "amount"))).over(whole)
    rows = rows.withColumns({"n_open": F.count_if(~F.col("ends")).over(whole), "end": last, "begin": F.max(F.when(~F.col("ends"), F.col("rcept_no"))).over(whole)})
    state = (
        F.when(~F.col("ends") & F.col("end").isNull(), "open").when(F.col("n_open") == 0, "no_contract").when(F.col("n_open") > 1, "ambiguous").otherwise("ended")
    )
    sure = state == "ended"
    out = rows.withColumn("state", state)
    told = lambda f: F.when(F.col("ends") | sure, F.col(f"end.{f}"))
    return out.select(
        "rcept_no", "corp_code", F.col("kind").alias("event_type"), "title", "state", F.when(sure, F.col("begin")).alias("contract_rcept_no"),
        told("rcept_no").alias("termination_rcept_no"), told("event_date").alias("ended_on"), told("amount").alias("ended_amount"),
    )

"""Dates and periods, which the relations keep as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Period words of a question and the month in which the period ends.
PERIOD_MONTHS = ((r"1\s*분기|1Q", 3), (r"반기|2\s*분기|2Q", 6), (r"3\s*분기|3Q", 9), (r"4\s*분기|4Q|연간|사업보고서|annual", 12))


def first_date(c: Column) -> Column:
    """The first year-month-day as YYYY-MM-DD, without a calendar check."""
    pattern = r"([0-9]{4})[-./년\s]+([0-9]{1,2})[-./월\s]+([0-9]{1,2})"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def digits8(c: Column) -> Column:
    """The first eight digits."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), 1, 8)


def dashed(c: Column) -> Column:
    d = digits8(c)
    return F.when(F.length(d) == 8, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(F.substring(c, 1, 10))


def is_calendar_date(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{8}$") & F.try_to_timestamp(c, F.lit("yyyyMMdd")).isNotNull(), F.lit(False))


def question_month(c: Column) -> Column:
    """The month of the only period that a question names; null if it names none or several."""
    hits = F.array_compact(F.array(*(F.when(c.rlike("(?i)" + p), F.lit(m)) for p, m in PERIOD_MONTHS)))
    return F.when(F.size(hits) == 1, F.get(hits, 0))


def report_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\(([0-9]{4})[.\-/]?[0-9]{0,2}\)", 1), F.lit("")).cast("int")


def report_month(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\([0-9]{4}[.\-/]([0-9]{2})\)", 1), F.lit("")).cast("int")


def is_full_year(c: Column, year: Column) -> Column:
    """A period from the first to the last day of that calendar year."""
    found = F.regexp_extract_all(F.regexp_replace(c, r"[년월./]", "-"), F.lit(r"([0-9]{4}-\s*[0-9]{1,2}-\s*[0-9]{1,2})"), F.lit(1))
    pad = lambda x: F.concat_ws("-", *(F.lpad(F.trim(F.split(x, "-")[i]), 4 if i == 0 else 2, "0") for i in range(3)))
    y = year.cast("string")
    return F.coalesce((F.size(found) == 2) & (pad(F.get(found, 0)) == F.concat(y, F.lit("-01-01"))) & (pad(F.get(found, 1)) == F.concat(y, F.lit("-12-31"))), F.lit(False))


def month_end(year: Column, month: Column) -> Column:
    """Last day of the month as YYYYMMDD."""
    return F.date_format(F.last_day(F.make_date(year, month, F.lit(1))), "yyyyMMdd")


def receipt_date(c: Column) -> Column:
    return F.substring(c, 1, 8)


def search_window(text: str, start: str | None, end: str | None, today: str, lookback_days: int = 1825) -> tuple[str, str]:
    """(from, to): what is given; the days before a given end; the years that a text names, and the one after; else the last days."""
    import datetime as dt
    import re

    day = lambda s: dt.date(int(s[:4]), int(s[4:6]), int(s[6:8]))
    back = dt.timedelta(days=lookback_days)
    if start:
        return start, end or today
    if end:
        return (day(end) - back).strftime("%Y%m%d"), end
    years = sorted({int(y) for y in re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", text or "")})
    if years:
        return f"{years[0]}0101", min(f"{years[-1] + 1}1231", today) if f"{years[-1] + 1}1231" > today else f"{years[-1] + 1}1231"
    return (day(today) - back).strftime("%Y%m%d"), today

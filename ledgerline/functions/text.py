"""Text functions on columns; only NFKC needs Python, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trailing particles, longest first.
PARTICLES = (
    "으로써", "으로서", "이라는", "이라고", "이라", "이란", "이나", "라는", "라고", "으로", "에서", "에게", "에도", "에는", "와의", "과의", "까지", "부터", "보다", "처럼", "만큼", "께서",
    "의", "은", "는", "이", "가", "을", "를", "와", "과", "에", "로", "도", "만", "라", "나", "란", "및",
)
#: Endings of English company names.
COMPANY_ENDINGS = ("corporation", "incorporated", "incorporation", "company", "limited", "holdings", "group", "coltd", "corp", "inc", "ltd", "co", "plc")
#: How Latin letters are read.
LETTER_READINGS = {
    "a": "에이", "b": "비", "c": "씨", "d": "디", "e": "이", "f": "에프", "g": "지", "h": "에이치", "i": "아이",
    "j": "제이", "k": "케이", "l": "엘", "m": "엠", "n": "엔", "o": "오", "p": "피", "q": "큐", "r": "알",
    "s": "에스", "t": "티", "u": "유", "v": "브이", "w": "더블유", "x": "엑스", "y": "와이", "z": "제트",
}
#: Flags of listed filings in their order.
RM_FLAGS = ("유", "코", "채", "넥", "공", "연", "정", "철")


def norm_text(c: Column) -> Column:
    """No-break space to space, middle dots unified, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, "\u00a0ㆍ", " ·"), r"(?U)\s+", " "))


def normal_lines(c: Column) -> Column:
    """Blanks inside lines collapsed, blank lines dropped, line ends kept."""
    lines = F.transform(F.split(F.regexp_replace(F.translate(c, "\u00a0", " "), r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\f\x0B]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normal_key(c: Column) -> Column:
    """NFKC, case folded, letters and digits only."""
    return F.regexp_replace(nfkc_casefold(c), r"[^\p{L}\p{N}]", "")


def plain_key(c: Column) -> Column:
    """The same without NFKC, for text that is in normal form already: stays in the JVM."""
    return F.lower(F.regexp_replace(c, "[^0-9A-Za-z가-힣]", ""))


def compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def base_report_name(c: Column) -> Column:
    """Without the tag in brackets at the front."""
    return F.trim(F.regexp_replace(c, r"^\[[^\]]+\]", ""))


def event_type_of_report(c: Column) -> Column:
    """What stands in parentheses after the name of a major-matters report, else the name itself."""
    base = base_report_name(c)
    inner = F.regexp_extract(base, r"주요사항보고서\s*\((.+)\)", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(base)


def strip_particle(c: Column) -> Column:
    """One trailing particle off, the longest that fits, if something is left."""
    return F.regexp_replace(c, "(?<=.)(?:" + "|".join(PARTICLES) + ")$", "")


def strip_company_endings(c: Column) -> Column:
    """Endings of company names off, again and again, while two characters are left."""
    return F.regexp_replace(c, "(?<=..)(?:" + "|".join(COMPANY_ENDINGS) + ")+$", "")


def letter_reading(c: Column) -> Column:
    """Runs of at most three Latin letters spelt out as they are read; longer runs are words and stay."""
    runs = F.regexp_extract_all(c, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    letters = F.create_map(*(F.lit(x) for pair in LETTER_READINGS.items() for x in pair))
    read = lambda x: F.when(x.rlike("^[A-Za-z]{1,3}$"), F.array_join(F.transform(F.split(F.lower(x), ""), lambda ch: F.coalesce(letters[ch], ch)), "")).otherwise(x)
    return F.array_join(F.transform(runs, read), "")


def query_tokens(c: Column, most: int = 32) -> Column:
    """Distinct tokens of 2 to 64 characters in their order, at most `most`."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([0-9a-z가-힣]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x).between(2, 64))), 1, most)


#: Most tokens of a query, and most characters of the match that they make.
MOST_TOKENS, MOST_MATCH = 32, 4096


def match_phrases(c: Column) -> Column:
    """(token, whether it is a prefix) of a query: tokens of four characters or more match as prefixes. A query with too many tokens, or too long ones, matches nothing."""
    found = query_tokens(c, 1_000_000)
    size = F.aggregate(found, F.lit(-4), lambda n, x: n + F.length(x) + 6 + F.when(F.length(x) >= 4, 1).otherwise(0))  # quotes, a star, " OR " between
    phrases = F.transform(found, lambda x: F.struct(x.alias("token"), (F.length(x) >= 4).alias("prefix")))
    return F.when((F.size(found) <= MOST_TOKENS) & (size <= MOST_MATCH), phrases).otherwise(F.filter(phrases, lambda x: F.lit(False)))


def receipts_in(c: Column) -> Column:
    """Distinct numbers of exactly 14 digits, none if there are more than 8."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![0-9])([0-9]{14})(?![0-9])"), F.lit(1)))
    return F.when(F.size(found) <= 8, found).otherwise(F.array().cast("array<string>"))


def count_of(c: Column, part: Column, most: int = 8) -> Column:
    """How often part occurs, without overlaps, at most `most`."""
    return F.least(F.lit(most), ((F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.length(part)).cast("int"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def table_cells(c: Column) -> Column:
    """Cells of a Markdown row."""
    return F.transform(F.split(F.regexp_replace(F.trim(c), r"^\||\|$", ""), r"(?<!\\)\|"), lambda x: F.trim(x))


def fixed_parts(c: Column, size: int) -> Column:
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def public_text(c: Column) -> Column:
    """Line-break marks and entities as plain text."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(mark))
    return c


def citation_safe(c: Column) -> Column:
    """Characters that delimit citations in their full-width forms, control characters as %XX."""
    plain = F.translate(c, "[]|", "［］｜")
    control = "[\\x00-\\x1F\\x7F]"
    spelt = F.transform(F.split(plain, ""), lambda x: F.when(x.rlike(control), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(x)), 2, "0"))).otherwise(x))
    return F.when(plain.rlike(control), F.array_join(spelt, "")).otherwise(plain)


def csv_safe(c: Column) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def is_correction_name(c: Column) -> Column:
    return c.rlike(r"^\s*\[[^\]]*(정정|correction)[^\]]*\]")


def rm_flags(c: Column) -> Column:
    return F.filter(F.array(*map(F.lit, RM_FLAGS)), lambda x: F.contains(F.coalesce(c, F.lit("")), x))


def row_label(c: Column) -> Column:
    """Without notes, leading enumerators and blanks."""
    c = F.regexp_replace(c, r"\(\s*주\s*[0-9,\s]*\)", "")
    c = F.regexp_replace(c, r"^\s*(?:[0-9]+[.)]|[IVXⅠ-Ⅻ]+[.)]|[가-하][.)]|[-*·])\s*", "")
    return F.regexp_replace(c, r"(?U)\s+", "")


def drop_repeats(cells: Column) -> Column:
    """Blank cells and cells equal to the one before dropped."""
    full = F.filter(cells, lambda x: x != "")
    return F.filter(full, lambda x, i: (i == 0) | (x != F.get(full, i - 1)))


#: Endings of predicates that don't tell terms apart.
ENDINGS = ("했습니다", "하였습니다", "합니다", "입니다", "됩니다", "되었습니다", "하는", "한다", "했다", "된다", "하고", "하며", "한", "된", "할")


def term_key(c: Column) -> Column:
    """A term without particles and endings at its end, as long as two characters are left."""
    return F.regexp_replace(F.lower(c), "(?<=..)(?:" + "|".join(sorted({*ENDINGS, *PARTICLES}, key=len, reverse=True)) + ")+$", "")


def visible_text(c: Column) -> Column:
    """Markup without scripts, styles and tags, entities read: enough where no structure is needed."""
    bare = F.regexp_replace(c, r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    return compact(public_text(F.regexp_replace(F.regexp_replace(bare, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n"), r"(?s)<[^>]*>", " ")))


def section_fragments(fragments: Column, most: int) -> Column:
    """Distinct fragments of a section joined by bars, cut at `most` characters."""
    return F.substring(F.array_join(F.array_distinct(F.filter(F.transform(fragments, norm_text), lambda x: x != "")), " | "), 1, most)

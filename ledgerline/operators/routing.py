"""What a question asks for: section, report, basis, period, refusal. Driver-side, one question at a time."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass

from ledgerline.operators.workflows import RATIOS

#: Report codes of the service by kind of report.
REPORT_CODES = {"annual": "11011", "half": "11012", "q1": "11013", "q3": "11014"}
#: Words that ask for figures of statements.
FINANCIAL = re.compile(r"매출|영업이익|순이익|자산|부채|자본|현금흐름|EPS|주당이익|비율|ROE|revenue|profit|assets", re.I)
#: Refused kinds of questions and the words that show them, in the order in which they are tried.
REFUSALS = (
    ("injection", r"ignore (?:all|previous)|이전 지시|시스템 프롬프트|system prompt"), ("secret", r"api[ _-]?key|비밀번호|password|인증키"), ("opinion", r"살까|팔까|매수|매도|추천|투자해도|should i (?:buy|sell)"),
    ("future", r"내년|전망|예측|목표 ?주가|will .* rise|forecast"), ("outside", r"날씨|환율 알려|뉴스|weather|recipe"),
)


@dataclass(frozen=True)
class Route:
    kind: str
    detail: dict


def explicit_section(question: str) -> str | None:
    """The section that a question names in quotes or after the words for it; only together with one receipt."""
    if len(set(re.findall(r"(?<!\d)\d{14}(?!\d)", question))) != 1:
        return None
    m = re.search(r"(?:section|섹션|항목)\s*[\"'“‘「]([^\"'”’」]{1,300})[\"'”’」]", question, re.I) or re.search(r"fact is stated in section (.{1,300}?)\s*\?", question, re.I)
    return m[1].strip() if m else None


def refusal(question: str) -> str | None:
    return next((kind for kind, words in REFUSALS if re.search(words, question, re.I)), None)


def basis(question: str) -> str | None:
    joint, own = "연결" in question, bool(re.search("별도|개별", question))
    return None if joint == own else "consolidated" if joint else "separate"


def statement(question: str) -> str | None:
    for code, words in (("CF", "현금흐름"), ("BS", "재무상태|자산|부채|자본총계"), ("IS", "손익|매출|이익")):
        if re.search(words, question):
            return code
    return None


def report_kind(subtype: str | None, month: int | None, question: str) -> str | None:
    """annual, half, q1 or q3, by what is known best: the subtype with its month, the month, the words."""
    by_month = {3: "q1", 6: "half", 9: "q3", 12: "annual"}
    if subtype in ("annual", "half"):
        return subtype
    if month in by_month:
        return by_month[month]
    named = [k for k, words in (("q1", r"1\s*분기|1Q"), ("half", r"반기|2\s*분기|2Q"), ("q3", r"3\s*분기|3Q"), ("annual", "연간|사업보고서|annual")) if re.search(words, question, re.I)]
    return named[0] if len(named) == 1 else None


def search_route(question: str, *, corp_code: str | None = None, year: int | None = None, subtype: str | None = None, month: int | None = None) -> Route:
    """Statements first if the question is about figures of a known company, year and report; text search otherwise, or if they are empty."""
    kind = report_kind(subtype, month, question)
    if corp_code and year and kind and year >= 2015 and FINANCIAL.search(question):
        return Route("statements", {"corp_code": corp_code, "bsns_year": year, "reprt_code": REPORT_CODES[kind], "basis": basis(question), "statement": statement(question), "fallback": "text"})
    return Route("text", {"section": explicit_section(question)})


def statement_score(question: str, chunk_basis: str, chunk_statement: str) -> float:
    """Statement chunks stand before all text; those of the asked basis and statement first."""
    return -100.0 - 10.0 * (basis(question) == chunk_basis or (basis(question) is None and chunk_basis == "consolidated")) - 5.0 * (statement(question) == chunk_statement)


def date_range(question: str) -> tuple[str, str] | None:
    """The range that a question names as year and month, or year, by the real end of its month."""
    m = re.search(r"((?:19|20)\d{2})년?\s*[-./]?\s*(\d{1,2})월(?:\s*(?:부터|~|-)\s*(?:((?:19|20)\d{2})년?\s*)?(\d{1,2})월)?", question)
    if m:
        y1, m1 = int(m[1]), int(m[2])
        y2, m2 = int(m[3] or y1), int(m[4] or m1)
        if 1 <= m1 <= 12 and 1 <= m2 <= 12 and (y1, m1) <= (y2, m2):
            return f"{y1}{m1:02d}01", f"{y2}{m2:02d}{calendar.monthrange(y2, m2)[1]:02d}"
        return None
    years = sorted(set(re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", question)))
    return (f"{years[0]}0101", f"{years[-1]}1231") if years else None


def year_of_what(question: str) -> str:
    """filing: when something was filed; fiscal: the year that it is about."""
    return "filing" if re.search(r"제출|접수|공시(?:한|된|일)", question) else "fiscal"


def asked_ratio(question: str) -> str | None:
    words = {"debt_ratio": "부채비율", "current_ratio": "유동비율", "roe": r"\bROE\b|자기자본이익률", "operating_margin": "영업이익률"}
    hits = [r for r in RATIOS if re.search(words[r], question, re.I)]
    return hits[0] if len(hits) == 1 else None

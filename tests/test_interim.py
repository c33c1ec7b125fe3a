"""Interim statements: header forms, conflicts, and a round trip of texts."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.numbers import accounting_text
from ledgerline.operators import interim

HEAD = "| 연결 손익계산서 |\n|---|\n| (단위 : 백만원) |\n|  | 제 56 기 3분기 | 제 56 기 3분기 | 제 55 기 3분기 | 제 55 기 3분기 |\n|---|---|---|---|---|\n|  | 3개월 | 누적 | 3개월 | 누적 |\n"
PATH = "III. 재무에 관한 사항 > 2. 연결재무제표"
CASES = {
    # text -> (three months, cumulative) of revenue, operating profit or net income, or the state
    "plain": (HEAD + "| 매출액 (주26) | 79,098 | 225,082 | 67,404 | 191,155 |", "revenue", 79098, 225082),
    "notes twice": (HEAD + "| 수익(매출액) (주26,33) | 900 | 2,538 | 800 | 2,000 |", "revenue", 900, 2538),
    "empty row of the same name": (HEAD + "| 분기순이익(손실) | 44 | 123 | 36 | 107 |\n| 분기순이익 |  |  |  |  |\n| 기타포괄손익 | 1 | 2 | 3 | 4 |", "net_income", 44, 123),
    "enumerator": (HEAD + "| XI.매출액 | 18 | 58 | 21 | 65 |", "revenue", 18, 58),
    "roman letter": (HEAD + "| Ⅰ.매출액 | 18 | 58 | 21 | 65 |", "revenue", 18, 58),
    "equal rows": (HEAD + "| 영업수익 | 4 | 13 | 4 | 12 |\n| 매출액 | 4 | 13 | 4 | 12 |", "revenue", 4, 13),
    "rows that differ": (HEAD + "| 영업수익 | 4 | 13 | 4 | 12 |\n| 매출액 | 5 | 13 | 4 | 12 |", "revenue", "conflict", None),
    "turned letters": (HEAD + "| 분기손이익(손실) | (49,543) | (47,544) | 21 | 184 |", "net_income", -49543, -47544),
    "consolidated in the name": (HEAD + "| 연결분기순이익 | 3 | 9 | 2 | 7 |", "net_income", 3, 9),
    "blank three months": (HEAD + "| 영업이익 |  | 32,289 |  | 63 |", "operating_profit", None, 32289),
    "no terms": ("| (단위 : 백만원) |\n|  | 3개월 | 누적 | 3개월 | 누적 |\n| 매출액 | 1 | 2 | 3 | 4 |", "revenue", "missing", None),
    "dollars": (HEAD.replace("백만원", "달러") + "| 매출액 | 1 | 2 | 3 | 4 |", "revenue", "unit_unknown", None),
    "fewer cells": (HEAD + "| 매출액 | 1 | 2 | 3 |", "revenue", "missing", None),
    "one header row": ("(단위 : 원)\n| 계정과목 | 당기 반기 3개월 | 당기 반기 누적 | 전기 반기 3개월 | 전기 반기 누적 |\n|---|---|---|---|---|\n| 영업이익 | 7 | 15 | 6 | 11 |", "operating_profit", 7, 15),
}


@pytest.fixture(scope="module")
def figures(spark):
    rows = [(name, PATH, 1, text) for name, (text, *_) in CASES.items()]
    head, row = HEAD.rsplit("|  | 제 56", 1)[0].rstrip("\n"), "|  | 제 56" + HEAD.rsplit("|  | 제 56", 1)[1] + "| 매출액 | 20 | 21 | 49 | 48 |"
    rows += [("split", PATH, 8, head), ("split", PATH, 9, row), ("too far", PATH, 7, head), ("too far", PATH, 8, "text"), ("too far", PATH, 9, row), ("other section", "x", 8, head), ("other section", PATH, 9, row), ("nothing", PATH, 1, None), ("nothing", PATH, 2, "")]
    chunks = spark.createDataFrame(rows, "doc_id string, path string, sequence int, text string").repartition(3)
    return interim.interim_figures(interim.statement_values(chunks))


def test_columns_of_headers(spark, figures):
    got = {(r.doc_id, r.measure): r for r in figures.filter("term = 0").collect()}
    prior = {(r.doc_id, r.measure): r for r in figures.filter("term = 1").collect()}
    for name, (_, measure, a, b) in CASES.items():
        r = got.get((name, measure))
        if isinstance(a, str):
            assert (r.state if r else "missing") == a, name
        else:
            assert r and (r.state, r.three_months, r.cumulative) == ("ok", a, b), name
    assert prior["plain", "revenue"].cumulative == 191155 and prior["one header row", "operating_profit"].three_months == 6
    assert got["split", "revenue"].unit == "백만원" and got["split", "revenue"].cumulative == 21
    assert got["too far", "revenue"].state == got["other section", "revenue"].state == "unit_unknown"


def test_answers(spark, figures):
    ask = [("plain", "revenue", 3, False, 79098, "ok"), ("plain", "revenue", 3, True, 225082, "ok"), ("blank three months", "operating_profit", 1, False, 32289, "ok"), ("blank three months", "operating_profit", 3, False, None, "missing"),
           ("rows that differ", "revenue", 3, False, None, "conflict"), ("nothing", "revenue", 3, False, None, "missing"), ("dollars", "revenue", 3, True, None, "unit_unknown")]
    asked = spark.createDataFrame([(d, "consolidated", m, q, c, k) for k, (d, m, q, c, _, _) in enumerate(ask)], "doc_id string, basis string, measure string, quarter int, cumulative_asked boolean, k int")
    got = {r.k: (r.value, r.state) for r in interim.interim_answers(asked, figures).collect()}
    assert [got[k] for k in range(len(ask))] == [(v, s) for *_, v, s in ask]


def test_texts_are_read_back(spark):
    rows = [("R1", "11014", "CFS", "IS", "매출액", "1", "1000", "3000", "900", "2700"), ("R1", "11014", "CFS", "CIS", "영업이익", "2", "(50)", "", "-40", None), ("R1", "11014", "CFS", "BS", "자산총계", "x", "9000", None, "8000", None), ("R1", "11014", "", "", "당기순이익", "3", "7", "21", "", "")]
    frame = spark.createDataFrame([(*r, "KRW", "제 9 기", "2024.09.30") for r in rows], "rcept_no string, reprt_code string, fs_div string, sj_div string, account_nm string, ord string, thstrm_amount string, thstrm_add_amount string, frmtrm_amount string, frmtrm_add_amount string, currency string, thstrm_nm string, thstrm_dt string")
    texts = interim.statement_texts(frame)
    got = {r.statement: r.text for r in texts.collect()}
    assert got["IS"].split("\n") == ["[연결재무제표 > 손익계산서]", "당기: 제 9 기 · 2024.09.30", "(단위 : 원)", "| 계정과목 | 당기 3분기 3개월 | 당기 3분기 누적 | 전기 3분기 3개월 | 전기 3분기 누적 |", "|---|---|---|---|---|", "| 매출액 | 1,000 | 3,000 | 900 | 2,700 |", "| 영업이익 | -50 | -50 | -40 | -40 |", "| 당기순이익 | 7 | 21 | - | - |"]
    assert got["BS"].split("\n")[2:] == ["(단위 : 원)", "| 계정과목 | 당기 3분기말 | 전기말 |", "|---|---|---|", "| 자산총계 | 9,000 | 8,000 |"]
    chunks = texts.select(F.col("rcept_no").alias("doc_id"), "path", F.lit(1).alias("sequence"), "text")
    back = {(r.measure, r.term): (r.three_months, r.cumulative, r.single, r.state) for r in interim.interim_figures(interim.statement_values(chunks)).collect()}
    assert back["revenue", 0] == (1000, 3000, None, "ok") and back["operating_profit", 1] == (-40, -40, None, "ok") and back["assets", 1] == (None, None, 8000, "ok")


def test_amounts_as_text(spark):
    want = {None: "-", "": "-", " - ": "-", "1234567": "1,234,567", "(1,234.50)": "-1,234.50", "-0012": "-12", "n/a": "n/a", ".5": ".5", "1" * 40: f"{int('1' * 40):,}", "12.": "12.", "△5": "5"}
    frame = spark.createDataFrame([(k,) for k in want], "x string").select("x", accounting_text(F.col("x")).alias("y"))
    assert {r.x: r.y for r in frame.collect()} == want

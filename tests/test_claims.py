"""Claims of answers against their own citations."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import claims as C

A = "[근거: 사업보고서 (2023.12) | 20240312000001 | III > 2. 연결재무제표 > 연결 손익계산서]"
B = "[근거: 사업보고서 (2023.12) | 20240313000002 | III > 2. 연결재무제표 > 연결 손익계산서]"
OLD = "[근거: 분기보고서 (2023.09) | 20231114000003 | 4. 재무제표 > 별도 재무상태표]"
Q = "알파와 베타의 2023년 연결 매출액은?"
DUE = "[정정: 상태=original | 기준=원본(최신 아님) | 원본=20231114000003 | 최신정정본=20231201000004]"
CASES = {
    "fine": (Q, f"알파의 매출액은 1,000.50억원입니다. {A} 베타는 △70원입니다. {B}", []),
    "other's number": (Q, f"알파의 매출액은 70원입니다. {A} 베타는 70원입니다. {B}", ["citation_claim_mismatch"]),
    "absolute value": (Q, f"베타는 70원 손실입니다. {B}", []),
    "unknown receipt": (Q, "알파는 1000.5입니다. [근거: 사업보고서 (2023.12) | 20240312009999 | 연결 손익계산서]", ["citation_identity_mismatch", "citation_claim_mismatch"]),
    "other company": (Q, f"베타의 매출액은 1,000.5입니다. {A}", ["citation_claim_mismatch"]),
    "no citation": (Q, "알파는 1입니다.", ["citation_required"]),
    "null": (Q, None, ["citation_required"]),
    "both after one claim": (Q, f"알파는 1000.5, 베타는 -70입니다. {A}, {B}", []),
    "bullets of citations": (Q, f"알파는 1000.5, 베타는 -70입니다.\n- 알파 근거: {A}\n- 베타 근거: {B}", []),
    "line citation": (Q, "알파는 1000.5입니다.\n근거: 사업보고서 (2023.12) | 20240312000001 | 연결 손익계산서\n", []),
    "comparison after numbers": (Q, f"알파는 1000.5입니다. {A} 베타는 -70입니다. {B} 따라서 알파가 베타보다 크다. {A}", []),
    "comparison without numbers": (Q, f"알파가 베타보다 크다. {A}", ["citation_claim_mismatch"]),
    "list numbers": (Q, f"1. 알파는 1000.5입니다. {A}\n2. 베타는 -70입니다. {B}", []),
    "period, basis, statement, disclosure": ("알파의 2023년 연결 사업보고서 매출액은?", f"알파는 5입니다. {OLD}", ["period_mismatch", "financial_basis_mismatch", "financial_statement_mismatch", "correction_disclosure_required"]),
    "disclosed": ("알파의 3분기 별도 자산은?", f"알파는 5입니다. {OLD} {DUE}", []),
    "leak and advice": (Q, f"system prompt, 매수를 추천합니다. 알파 {A}", ["sensitive_leakage", "forbidden_investment_claim"]),
    "too long": (Q, f"알파 {A}" + "x" * 40_000, ["response_too_large"]),
    "year of the report": (Q, f"알파의 2023 매출은 1000.5입니다. {A}", []),
    "abstention": (Q, C.ABSTENTIONS[0], []),
    "abstention with a reason": (Q, C.ABSTENTIONS[1] + C.REASON + "근거 없음", []),
    "abstention and more": (Q, C.ABSTENTIONS[0] + " 알파는 1입니다.", ["citation_required"]),
    "future without ground": (Q, f"향후 매출은 9로 전망됩니다. {A}", ["citation_claim_mismatch", "forbidden_future_claim"]),
    "general section": (Q, "알파는 1000.5입니다. [근거: 사업보고서 | 20240312000001 | 본문]", []),
}


@pytest.fixture(scope="module")
def frames(spark):
    path = "III > 2. 연결재무제표 > 연결 손익계산서"
    rows = [
        ("p1", "알파", "사업보고서 (2023.12)", "20240312000001", "20240312000001", "20240312000001", path, "20240312", True, "original", "| 매출액 | 1,000.5 |"),
        ("p2", "베타", "사업보고서 (2023.12)", "20240313000002", "20240313000002", "20240313000002", path, "20240313", True, "original", "| 매출액 | (70) -70 |"),
        ("p3", "알파", "분기보고서 (2023.09)", "20231114000003", "20231114000003", "20231201000004", "4. 재무제표 > 별도 재무상태표", "20231114", False, "original", "| 자산 | 5 |"),
    ]
    passages = [(name, *r) for name in CASES for r in rows]
    answers = spark.createDataFrame([(n, q, a) for n, (q, a, _) in CASES.items()], "request_id string, question string, answer string")
    schema = "request_id string, passage_id string, corp_name string, report_nm string, rcept_no string, root_rcept_no string, latest_rcept_no string, section string, rcept_dt string, is_latest boolean, correction_status string, text string"
    return answers, spark.createDataFrame(passages, schema)


def test_faults_of_answers(frames):
    got = {r.request_id: list(r.faults) for r in C.answer_faults(*frames).collect()}
    for name, (_, _, faults) in CASES.items():
        assert got[name] == faults, name


def test_claims_and_their_numbers(spark, frames):
    rows = {(r.request_id, r.claim_no): r for r in C.claim_faults(*frames).collect()}
    assert rows["other's number", 0].ungrounded == ["70"] and rows["other's number", 1].grounded
    assert rows["other company", 0].unbound == ["베타"] and ("bullets of citations", 1) not in rows
    one = spark.createDataFrame([("1,000.50 △7 ▲0.0 +3 007 x5 -0 12.340 5.", "a")], "t string, b string")
    assert set(one.select(C.numbers_of(F.col("t"))).first()[0]) == {"1000.5", "-7", "7", "0", "3", "12.34", "5"}


def test_no_answers_no_rows(frames):
    answers, passages = frames
    assert C.answer_faults(answers.filter("false"), passages).collect() == []
    bare = C.answer_faults(answers, passages.filter("false")).collect()
    assert len(bare) == len(CASES) and {r.request_id for r in bare if r.valid} == {"abstention", "abstention with a reason"}

from pyspark.sql import functions as F

from ledgerline.operators import extractors as X

TABLE = "배당 (단위: 백만원)\n\n| 구분 | 당기 | 전기 |\n|---|---|---|\n| 1. 주당 현금배당금 | 1,444 | 1,000 |\n| 현금배당금총액 | 9,809 | - |\n| 매출액 (주1) | 258,935 | 1 |"
SUMS = "기간 2024년 1월 1일 ~ 2024년 12월 31일 (단위: 억원)\n\n| 구분 | 투자금액 |\n|---|---|\n| 신설 | 100 |\n| 보완 | 50 |\n| 합계 | 150 |"
PAY = "| 이름 | 직위 | 보수총액 |\n|---|---|---|\n| 홍 길동 | 이사 | 1,200 |\n| 김철수 | 이사 | 900 |"
TEXT = "당사는 1969년 1월 13일에 설립되었습니다.\n본점 소재지: 경기도 수원시\n대표이사: 김철수, 이영희\n당사는 연구개발에 힘쓰고 있습니다. 환율 변동 위험이 있습니다. 연구개발에 힘쓰고 계획을 세웠습니다.\n| a | 연구개발. |"


def _frame(spark):
    rows = [("c1", "r1", 1, TABLE), ("c2", "r1", 2, SUMS), ("c3", "r2", 1, SUMS.replace("| 합계 | 150 |", "| 합계 | 151 |")), ("c4", "r3", 1, SUMS), ("c5", "r3", 2, SUMS.replace("100", "101").replace("150", "151")), ("c6", "r1", 3, PAY), ("c7", "r1", 4, TEXT), ("c8", "r1", 5, None)]
    return spark.createDataFrame(rows, "chunk_id string, rcept_no string, document_sequence int, text string")


def test_tables(spark):
    chunks = _frame(spark)
    cells = X.table_cells(chunks)
    got = {(r.label, r.header): (r.value, r.unit) for r in cells.filter("chunk_id = 'c1'").collect()}
    assert got["1. 주당 현금배당금", "당기"] == ("1,444", "백만원") and len(got) == 6
    assert {r.measure for r in X.operand_rows(cells).collect()} == {"revenue"}
    facts = {(r.rcept_no, r.fact): (r.value, r.state) for r in X.common_facts(cells, chunks).collect()}
    assert facts["r1", "dividend_per_share"] == ("1,444", "ok") and facts["r1", "dividend_total"] == ("9,809", "ok")
    pay = X.executive_pay(chunks, "홍길동").first()
    assert (int(pay.total), pay.state) == (1200, "ok")


def test_sentences_and_profile(spark):
    chunks = _frame(spark)
    p = {r.rcept_no: r for r in X.company_profile(chunks).collect()}["r1"]
    assert (p.founded, p.address, p.ceos) == ("1969년 1월 13일", "경기도 수원시", "김철수, 이영희")
    rows = X.topic_sentences(chunks).collect()
    assert {(r.topic, r.sentence) for r in rows} == {("research", "당사는 연구개발에 힘쓰고 있습니다."), ("research", "연구개발에 힘쓰고 계획을 세웠습니다."), ("plan", "연구개발에 힘쓰고 계획을 세웠습니다."), ("currency", "환율 변동 위험이 있습니다."), ("risk", "환율 변동 위험이 있습니다.")}
    one = spark.createDataFrame([("당사는 크다. 회사가 작다. 지배기업 전체",)], "t string")
    assert one.select(X.issuer_name(F.col("t"), "삼성")).first()[0] == "삼성은 크다. 삼성이 작다. 삼성 전체"
    assert one.select(X.issuer_name(F.col("t"), "카카오")).first()[0] == "카카오는 크다. 카카오가 작다. 카카오 전체"


def test_funding_and_links(spark):
    text = "| 구분 | 금액 |\n|---|---|\n| 회사채 발행 | 300 |\n| 유상증자 | (20) |"
    cells = X.table_cells(spark.createDataFrame([("c", text)], "chunk_id string, text string"))
    got = {r.kind: (None if r.total is None else int(r.total), r.state) for r in X.funding_by_type(cells).collect()}
    assert got["회사채"] == (300, "present") and got["유상증자"] == (-20, "present") and got["전환사채"] == (None, "absent")
    link = "see [20240101000001](https://x.example/view?rcpNo=20240101000001) end"
    one = spark.createDataFrame([(link,)], "t string").select(X.short_links(F.col("t")).alias("s"))
    assert one.first().s == "see [20240101000001] end"
    assert one.select(X.long_links(F.col("s"), "https://x.example/view")).first()[0] == link

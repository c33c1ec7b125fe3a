import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline import service
from ledgerline.functions import dates, jsons, numbers, text


def _one(spark, value, f, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(f(F.col("v"))).first()[0]


def test_text(spark):
    cases = [
        ("a  b\n ㆍc ", text.norm_text, "a b ·c"), ("a  b\n\n \t\nc d", text.normal_lines, "a b\nc d"), ("ＡＢＣ-(주)1 ", text.normal_key, "abc주1"), ("[기재정정]사업보고서 (2024.12)", text.base_report_name, "사업보고서 (2024.12)"),
        ("[정정]주요사항보고서(유상증자결정)", text.event_type_of_report, "유상증자결정"), ("단일판매", text.event_type_of_report, "단일판매"), ("삼성전자의", text.strip_particle, "삼성전자"), ("의", text.strip_particle, "의"),
        ("samsungelectronicscoltd", text.strip_company_endings, "samsungelectronics"), ("coinc", text.strip_company_endings, "co"), ("SK하이닉스", text.letter_reading, "에스케이하이닉스"), ("POSCO", text.letter_reading, "POSCO"),
        ("수소 수소 전기차 a", text.query_tokens, ["수소", "전기차"]), ("x 20240101000001 120240101000001 20240101000001", text.receipts_in, ["20240101000001"]), ("| a | b\\|c |", text.table_cells, ["a", "b\\|c"]),
        ("abcdefg", lambda c: text.fixed_parts(c, 3), ["abc", "def", "g"]), ("", lambda c: text.fixed_parts(c, 3), []), ("=1+1", text.csv_safe, "'=1+1"), ("[a|b]", text.citation_safe, "［a｜b］"), ("유정", text.rm_flags, ["유", "정"]),
        ("Ⅱ. 영업이익 (주 1, 2)", text.row_label, "영업이익"), ("aaaa", lambda c: text.count_of(c, F.lit("aa")), 2), ("매출액을", text.term_key, "매출액"), ("<p>a&amp;b</p><script>x</script><b>c", text.visible_text, "a&b c"),
    ]
    for value, f, want in cases:
        assert _one(spark, value, f) == want, (value, want)
    assert [tuple(x) for x in _one(spark, "삼성전자 매출", text.match_phrases)] == [("삼성전자", True), ("매출", False)]
    assert len(_one(spark, " ".join(f"t{k:02d}" for k in range(32)), text.match_phrases)) == 32 and _one(spark, " ".join(f"t{k:02d}" for k in range(33)), text.match_phrases) == []
    assert _one(spark, "[a\tb|c\x7f]", text.citation_safe) == "［a%09b｜c%7F］"
    assert _one(spark, ["a", "a", "", "b", "a"], text.drop_repeats, "v array<string>") == ["a", "b", "a"]
    assert _one(spark, [" x ", "x", "y"], lambda c: text.section_fragments(c, 3), "v array<string>") == "x |"


def test_dates(spark):
    assert _one(spark, "계약일 2024년 1월 5일", dates.first_date) == "2024-01-05" and _one(spark, "none", dates.first_date) is None
    assert _one(spark, "20250728", dates.dashed) == "2025-07-28" and _one(spark, "2025-07", dates.dashed) == "2025-07"
    assert _one(spark, "20240229", dates.is_calendar_date) and not _one(spark, "20230229", dates.is_calendar_date) and not _one(spark, None, dates.is_calendar_date)
    assert _one(spark, "3분기 실적", dates.question_month) == 9 and _one(spark, "1분기와 3분기", dates.question_month) is None
    for period, want in (("2024.01.01 ~ 2024.12.31", True), ("2024년 1월 1일 ~ 2024년 12월 30일", False), (None, False)):
        assert _one(spark, period, lambda c: dates.is_full_year(c, F.lit(2024))) is want
    assert dates.search_window("2022년 매출", None, None, "20240601") == ("20220101", "20231231") and dates.search_window("", None, "20240101", "x") == ((dt.date(2024, 1, 1) - dt.timedelta(1825)).strftime("%Y%m%d"), "20240101")


def test_numbers(spark):
    for value, f, want in [
        ("1,234.5", numbers.decimal_text, Decimal("1234.5")), ("12,34", numbers.decimal_text, None), ("398,800,000,000 104.56", numbers.first_amount, Decimal(398800000000)), ("(1,000)", numbers.accounting, Decimal(-1000)), ("△5", numbers.accounting, Decimal(-5)),
        ("-", numbers.accounting, None), ("-5", numbers.strict_accounting, None), ("5,000", numbers.strict_accounting, Decimal(5000)), ("a -1,200 b 3", numbers.number_set, ["-1200", "3", "1200"]),
    ]:
        assert _one(spark, value, f) == want, value
    for rounding, want in (("ROUND_HALF_UP", -3), ("ROUND_HALF_EVEN", -2), ("ROUND_DOWN", -2), ("ROUND_UP", -3)):
        assert _one(spark, Decimal("-2.5"), lambda c: numbers.round_as(c, 0, rounding), "v decimal(10,1)") == want
    assert _one(spark, Decimal(5), lambda c: numbers.in_hundred_millions(c, F.lit("조원")), "v decimal(10,0)") == Decimal("50000.00") and _one(spark, Decimal(5), lambda c: numbers.in_won(c, F.lit("?")), "v decimal(10,0)") is None


def test_json(spark):
    fields = '[["1. 계약 > 2. 금액","100"],["x > 금액","200"],["a","-"],["상대","B"]]'
    assert _one(spark, fields, jsons.compact_fields) == {"금액": "100", "상대": "B"}
    assert _one(spark, "{bad", jsons.valid) is None and _one(spark, '{"b":1, "a":[1]}', jsons.valid) in ('{"a":[1],"b":1}', '{"b":1,"a":[1]}')
    assert [d.item for d in _one(spark, '[{"item":"x","before":"1","after":"2"},{"item":"y","before":"1","after":"1"}]', jsons.changed)] == ["x"]


def test_catalog_cache_and_reranker(tmp_path):
    now = [1000.0]
    cache = service.CatalogCache(str(tmp_path / "c.json"), 60, lambda: now[0])
    assert cache.read() is None and cache.write([{"a": 1}]) and cache.read() == [{"a": 1}]
    now[0] += 61
    assert cache.read() is None
    (tmp_path / "c.json").write_text("{")
    assert cache.read() is None and not service.CatalogCache("/nonexistent/x/c.json", 60).write([])
    assert service.reranked({"a": "x", "b": "y"}, [{"id": "b", "text": "y"}]) == ["b"]
    for bad in ([{"id": "a", "text": "z"}], [{"id": "c", "text": "x"}], [{"id": "a", "text": "x"}] * 2):
        with pytest.raises(service.RerankError):
            service.reranked({"a": "x"}, bad)

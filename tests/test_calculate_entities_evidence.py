import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import calculate as C
from ledgerline.operators import entities, evidence
from ledgerline.schemas import CITATION_FIELDS


@pytest.mark.parametrize(("op", "xs", "want"), [
    ("add", ["1,000", "2.5"], "1002.50"), ("divide", ["1", "3"], "0.33"), ("ratio_percent", ["92,228,115", "363,677,865"], "25.36"), ("ratio_percent", ["195936557", "75719452"], "258.77"),
    ("ratio_percent", ["6708129", "75788269"], "8.85"), ("percent_change", ["100", "116.2"], "16.20"), ("subtract", ["300,000,000", "225,000,000"], "75000000.00"), ("sum", ["100", "200", "300"], "600.00"),
])
def test_results(op, xs, want):
    assert C.calculate(op, xs)["data"]["result"] == want


def test_rounding_ranking_and_errors():
    by = {r: C.calculate("divide", ["-25", "10"], scale=0, rounding=r)["data"]["result"] for r in C.ROUNDINGS}
    assert by == {"ROUND_HALF_UP": "-3", "ROUND_HALF_EVEN": "-2", "ROUND_DOWN": "-2", "ROUND_UP": "-3"}
    assert C.calculate("rank_desc", ["1", "3", "3", "2"])["data"]["ordered_indices"] == [1, 2, 3, 0]
    big = "1" + "0" * 30
    assert C.calculate("rank_ratio_desc", [big, big + "1", big + "0", big + "00", "1", "3"])["data"]["ordered_indices"][0] == 2
    for op, xs in (("divide", ["1", "0"]), ("add", ["1"]), ("sum", []), ("nope", ["1", "2"]), ("add", ["1e5", "2"]), ("add", ["1,00", "2"]), ("rank_ratio_desc", ["1", "0", "2", "1"]), ("multiply", ["9" * 60, "9" * 60])):
        assert C.calculate(op, xs)["status"] == "error"
    assert C.calculate("add", ["1", "2"], scale=13)["status"] == "error"


def test_results_equal_wide_decimals():
    """Against Python's decimals with room for every digit."""
    import decimal
    import random

    rnd, kinds = random.Random(5), {"ROUND_HALF_UP": "ROUND_HALF_UP", "ROUND_HALF_EVEN": "ROUND_HALF_EVEN", "ROUND_DOWN": "ROUND_DOWN", "ROUND_UP": "ROUND_UP"}
    number = lambda: rnd.choice(["", "-"]) + rnd.choice([f"{rnd.randint(0, 10**rnd.randint(1, 9)):,}", str(rnd.randint(0, 999))]) + rnd.choice(["", f".{rnd.randint(0, 9999)}", ".5", ".125"])
    with decimal.localcontext(prec=400):
        for _ in range(3000):
            xs, scale, rounding = [number(), number()], rnd.randint(0, 12), rnd.choice(list(kinds))
            a, b = (decimal.Decimal(x.replace(",", "")) for x in xs)
            for op, f in (("add", lambda: a + b), ("subtract", lambda: a - b), ("multiply", lambda: a * b), ("divide", lambda: a / b), ("ratio_percent", lambda: a / b * 100), ("percent_change", lambda: (b - a) / a * 100)):
                got = C.calculate(op, xs, scale=scale, rounding=rounding)
                try:
                    want = format(f().quantize(decimal.Decimal(1).scaleb(-scale), rounding=kinds[rounding]), "f")
                except (decimal.DivisionByZero, decimal.InvalidOperation):
                    want = None
                if want is None or len(want.replace("-", "").replace(".", "").lstrip("0")) > C.DIGITS:
                    assert got["status"] == "error"
                else:
                    assert got["data"]["result"].lstrip("-") == want.lstrip("-"), (op, xs, scale, rounding)
            pairs = [str(rnd.randint(-50, 50)) if k % 2 == 0 else str(rnd.randint(1, 9)) for k in range(8)]
            order = C.calculate("rank_ratio_desc", pairs)["data"]["ordered_indices"]
            value = [decimal.Decimal(pairs[2 * i]) / decimal.Decimal(pairs[2 * i + 1]) for i in range(4)]
            assert order == sorted(range(4), key=lambda i: (-value[i], i)) or len(set(round(v, 300) for v in value)) < 4


def test_rows_in_decimals_and_in_python_agree(spark):
    rows = [("add", ["1,000.5", "-1000.500001"]), ("subtract", ["0.004", "0.005"]), ("subtract", ["999999999999.999999", "-1"]), ("sum", ["1"] * 20), ("sum", ["1"] * 21), ("add", ["1" * 20, "2"]), ("add", ["1", None]), ("sum", []), ("subtract", ["1,00", "2"]), ("multiply", ["3", "4"]), (None, ["1", "2"]), ("add", None)]
    frame = spark.createDataFrame(list(zip(range(len(rows)), *zip(*rows))), "i int, op string, xs array<string>")
    got = {r.i: (r.status, r.result) for r in frame.select("i", C.calculated(F.col("op"), F.col("xs")).alias("r")).select("i", "r.*").collect()}
    for i, (op, xs) in enumerate(rows):
        want = C.calculate(op, xs or [])
        assert got[i] == (want["status"], want["data"].get("result")), (op, xs)


def test_over_rows(spark):
    frame = spark.createDataFrame([("add", ["1", "2"]), ("rank_desc", ["1", "5"]), ("divide", ["1", "0"]), ("sum", None)], "op string, xs array<string>")
    rows = frame.select("op", C.calculated(F.col("op"), F.col("xs")).alias("r")).select("op", "r.*").collect()
    assert [(r.status, r.result, r.ordered_indices) for r in rows] == [("ok", "3.00", None), ("ok", "5.00", [1, 0]), ("error", None, None), ("error", None, None)]


def test_companies(spark):
    universe = spark.createDataFrame([
        ("00126380", "005930", "삼성전자", "삼성전자", "SAMSUNG ELECTRONICS CO,.LTD", "전기·전자", "구 삼성전자공업 (1984)"), ("00164779", "000660", "SK하이닉스", "SK하이닉스", "SK hynix Inc.", "전기·전자", None),
        ("00258801", "035720", "카카오", "카카오", "Kakao Corp.", "IT 서비스", ""), ("00999999", "293490", "카카오게임즈", "카카오게임즈", "Kakao Games Corp.", "게임", ""), ("00111111", "111111", "카카오", "카카오우", "Other", "게임", ""),
    ], "corp_code string, stock_code string, corp_name string, listed_name string, corp_eng_name string, sector string, note string")
    asked = ["005930", "삼성전자", "Samsung Electronics", "에스케이하이닉스", "삼전", "삼성전자의 매출은?", "하이닉스 영업이익", "카카오게임즈", "카카오", "없는회사", "삼성전자공업", "SAMSUNG ELECTRONICS 2024"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    rows = {r.query: (r.status, r.corp_codes) for r in entities.resolve_companies(q, universe).collect()}
    sam, hynix = ("ok", ["00126380"]), ("ok", ["00164779"])
    assert [rows[x] for x in asked[:8]] == [sam, sam, sam, hynix, sam, sam, hynix, ("ok", ["00999999"])]
    assert rows["카카오"] == ("ambiguous", ["00111111", "00258801"]) and rows["없는회사"] == ("not_found", []) and rows["삼성전자공업"] == sam and rows["SAMSUNG ELECTRONICS 2024"] == sam
    s = spark.createDataFrame(list(enumerate(["게임 업종 순위", "전자 기업", "조선", "전기·전자 산업과 게임 회사", "카카오게임즈 업종", "전기 전자 10사 중", "IT 서비스 업체", "IT서비스 업체", " ", None])), "query_id long, query string")
    resolved = entities.resolve_sectors(s, universe)
    got = {r.query_id: (r.status, r.sector) for r in resolved.collect()}
    ok = lambda x: ("ok", x)
    assert [got[i] for i in range(10)] == [
        ok("게임"), ok("전기·전자"), ("not_found", None), ("ambiguous", None), ("not_found", None), ok("전기·전자"), ok("IT 서비스"), ("not_found", None), ("error", None), ("error", None),
    ]
    members = {(r.query_id, r.place): r.corp_code for r in entities.sector_candidates(resolved, universe).collect()}
    assert (members[0, 1], members[0, 2]) == ("00111111", "00999999") and members[1, 1] == "00126380"


def test_companies_at_boundaries(spark):
    names = [("1", "LG씨엔에스", "LG CNS Co., Ltd."), ("2", "카카오", "Kakao Corp."), ("3", "기아", "Kia Corporation"), ("4", "삼성전자", "SAMSUNG ELECTRONICS CO,.LTD"), ("5", "SK하이닉스", "SK hynix Inc."), ("6", "가나다라마바사", "Alpha Beta Gamma Delta Works Inc.")]
    universe = spark.createDataFrame([(f"{int(c):08d}", n, e) for c, n, e in names], "corp_code string, corp_name string, corp_eng_name string")
    asked = {
        "LG CNS Co., Ltd.의 매출": ["1"], "CompareSamsungElectronics와에스케이하이닉스의매출을": ["4", "5"], "삼성전자매출액": ["4"], "카카오게임즈매출": [], "Nokia revenue": [], "2024년삼성전자사업보고서": ["4"],
        "showKiaRevenue": ["3"], "삼성전자; drop": [], "alpha beta gamma delta works는?": ["6"], "삼성전자와 카카오": ["2", "4"], "00000003": ["3"], "기아": ["3"], "아기아": [], "카카오카카오의": [], "ＫＩＡ매출": ["3"], "x" * 1001: None, "": None,
    }
    frame = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {r.query: (r.status, r.corp_codes) for r in entities.resolve_companies(frame, universe).collect()}
    for query, codes in asked.items():
        status = "error" if codes is None else ("not_found", "ok", "ambiguous")[min(len(codes), 2)]
        assert got[query] == (status, [f"{int(c):08d}" for c in codes or []]), query


def test_pieces_between_boundaries(spark):
    """Against every piece of every run, by loops."""
    import itertools
    import random

    kind = lambda ch: "h" if "가" <= ch <= "힣" else "d" if ch.isdigit() else "l"
    before, after = (*entities.PARTICLES, *entities.BEFORE), (*entities.PARTICLES, *entities.AFTER)
    rnd = random.Random(2)
    runs = ["".join(rnd.choice(["a", "b", "삼", "의", "와", "12", "매출", "and", "년"]) for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    frame = spark.createDataFrame([(r,) for r in runs], "run string")
    for row in frame.select("run", entities.bounded_pieces(F.col("run"), F.lit(6)).alias("p")).collect():
        r, want = row.run, set()
        for s, e in itertools.combinations(range(len(r) + 1), 2):
            begin = s == 0 or r[:s].endswith(before) or kind(r[s - 1]) != kind(r[s])
            if 2 <= e - s <= 6 and begin and (e == len(r) or r[e:].startswith(after)):
                want.add(r[s:e])
        assert set(row.p) == want and len(row.p) == len(want)


def _citation(**kw):
    return {f: (True if f == "is_latest" else "x") for f in CITATION_FIELDS} | kw


def test_packing_limits_and_tables():
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'v' * 30} |" for i in range(60)) + "\n| bad |\n"
    items = [
        {"source_id": "s1", "text": "One. Two. " * 400, "citation": _citation(), "priority": 2, "rank": 1}, {"source_id": "s2", "text": "intro\n\n" + table + "after<br>line", "citation": _citation(), "priority": 3, "rank": 1},
        {"source_id": "s2", "text": "intro\n\n" + table + "after<br>line", "citation": _citation(), "priority": 1, "rank": 9}, {"source_id": "s3", "text": "short", "citation": _citation(), "priority": 1, "rank": 2},
    ]
    got = evidence.pack(items)
    assert len(got["context"]) <= 12_000 and len(got["passages"]) <= 8
    for name in ("s1", "s2"):
        assert 1 <= sum(p["source_id"] == name for p in got["passages"]) <= 3
    assert "duplicate_evidence_removed:s2" in got["limitations"] and "malformed_table_row_omitted:s2" in got["limitations"]
    assert got["passages"][0]["source_id"] == "s2" and any(p["source_id"] == "s3" for p in got["passages"])
    for p in got["passages"]:
        if "v" * 30 in p["text"]:
            assert p["text"].startswith("| a | b |\n|---|---|\n")
        src = next(x["text"] for x in items if x["source_id"] == p["source_id"])
        assert "\n".join(src[a:b] for a, b in p["spans"]) == p["text"]
    with pytest.raises(ValueError):
        evidence.pack([{"source_id": "x", "text": "t", "citation": {}, "priority": 1, "rank": 1}])
    mixed = evidence.pack(items, evidence.Budget(interleave=True))
    assert [p["source_id"] for p in mixed["passages"]][:3] == ["s2", "s1", "s3"]


def test_spans_are_places_of_the_source_as_it_is():
    table = "| a | b |\r\n|---|---|\r\n| 1 | 2 |\r\n| 3 |\r\n| 5 | 6 |"
    raw = "First line.\r\nSecond one.\r" + "word " * 30 + "\r\n\r\n" + table + "\r\ntail"
    parts, left = evidence.split_evidence(raw, 80, 10)
    assert left == ["malformed_table_row_omitted"]
    for body, spans in parts:
        assert "\n".join(re.sub(r"\r\n?", "\n", raw[a:b]) for a, b in spans) == body and len(body) <= 80
    assert [b for b, _ in parts if "---" in b] == ["| a | b |\n|---|---|\n| 1 | 2 |", "| a | b |\n|---|---|\n| 5 | 6 |"]
    covered = set()
    for _, spans in parts:
        for a, b in spans:
            covered.update(range(a, b))
    assert not [c for i, c in enumerate(raw) if i not in covered and c not in "\r\n| 3"]


def test_prose_parts_at_the_strongest_break():
    assert [b for b, _ in evidence.split_evidence("aaa. bbb\nccc. ddd\n\neee. fff ggg", 22, 5)[0]] == ["aaa. bbb\nccc. ddd\n\n", "eee. fff ggg"]
    assert [b for b, _ in evidence.split_evidence("x" * 25, 10, 4)[0]] == ["x" * 10, "x" * 10, "x" * 10, "x" * 7]


def test_a_request_that_nothing_fits_keeps_its_limits(spark):
    rows = [("r0", "s" * 3000, "text", _citation(), 1, 1), ("r1", "s", "text", _citation(), 1, 1)]
    schema = "request_id string, source_id string, text string, citation struct<" + ",".join(f"{f}:{'boolean' if f == 'is_latest' else 'string'}" for f in CITATION_FIELDS) + ">, priority int, rank int"
    out = {r.request_id: r for r in evidence.pack_requests(spark.createDataFrame(rows, schema)).collect()}
    assert out["r0"].label is None and out["r0"].limitations[0].startswith("passage_header_exceeds_limit") and out["r1"].label == "S1"


def test_requests(spark):
    rows = [(f"r{i % 2}", f"s{i}", f"text {i} " * 50, _citation(), 1, i) for i in range(6)]
    schema = "request_id string, source_id string, text string, citation struct<" + ",".join(f"{f}:{'boolean' if f == 'is_latest' else 'string'}" for f in CITATION_FIELDS) + ">, priority int, rank int"
    out = evidence.pack_requests(spark.createDataFrame(rows, schema)).collect()
    assert {r.request_id for r in out} == {"r0", "r1"} and len(out) == 6 and not any(r.truncated for r in out)

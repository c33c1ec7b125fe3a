"""Totals, executed investments, sums and ended contracts."""

from ledgerline.operators import extractors, investments as I

HEAD = "(단위: 억원)\n| 구분 | 투자기간 | 당기 투자액 | 향후 계획 |\n|---|---|---|---|\n"
YEAR = "2024.01.01~2024.12.31"


def _table(*rows, head=HEAD):
    return head + "\n".join("| " + " | ".join(r) + " |" for r in rows)


TABLES = {
    "ok": _table(("a", YEAR, "100", "x"), ("b", YEAR, "1,050", "x"), ("합 계", "", "1,150", "")),
    "sum_differs": _table(("a", YEAR, "100", "x"), ("합계", "", "101", "")),
    "no_single_total": _table(("a", YEAR, "100", "x"), ("계", "", "100", "")),
    "two totals": _table(("a", YEAR, "100", "x"), ("합계", "", "100", ""), ("총계", "", "100", "")),
    "no_member": _table(("합계", "", "100", "")),
    "subtotals": _table(("a", YEAR, "1", ""), ("b", YEAR, "2", ""), ("소계", "", "3", ""), ("c", YEAR, "4", ""), ("부분합", "", "4", ""), ("d", YEAR, "5", ""), ("합계", "", "12", "")),
    "subtotal_differs": _table(("a", YEAR, "1", ""), ("b", YEAR, "2", ""), ("소계", "", "4", ""), ("합계", "", "3", "")),
    "unreadable": _table(("a", YEAR, "(100)", "x"), ("합계", "", "100", "")),
    "uneven": _table(("a", YEAR, "100"), ("합계", "", "100", "")),
    "total_not_last": _table(("합계", "", "100", ""), ("a", YEAR, "100", "x")),
}


def test_totals(spark):
    chunks = spark.createDataFrame(list(TABLES.items()), "chunk_id string, text string")
    cells = extractors.table_cells(chunks)
    got = {r.chunk_id: r for r in I.reconciled_totals(cells).filter("header = '당기 투자액'").collect()}
    strict = {r.chunk_id: r.state for r in I.checked_totals(cells).filter("header = '당기 투자액'").collect()}
    for name in TABLES:
        want = {"two totals": "no_single_total", "subtotals": "ok"}.get(name, name)
        assert got[name].state == want, name
        assert strict[name] == ("subtotal" if name in ("subtotals", "subtotal_differs") else want), name
    assert got["subtotals"].subtotals == 2 and got["subtotals"].members == 12 and got["ok"].unit == "억원"


def test_executed_in_a_year(spark):
    annual = "사업보고서 (2024.12)"
    ok = TABLES["ok"]
    rows = [
        ("1", "c1", annual, True, ok), ("2", "c2", annual, True, TABLES["sum_differs"]), ("3", "c3", annual, True, ok.replace(YEAR, "2024.01~2024.11", 1)), ("4", "c4", "분기보고서 (2024.09)", True, ok),
        ("5", "c5", annual, False, ok), ("6", "c6", annual, True, ok + "\n\n" + ok), ("7", "c7", annual, True, ok), ("8", "c7", annual, True, ok.replace("100", "101").replace("1,150", "1,151")),
        ("9", "c8", annual, True, ok.replace("당기 투자액", "예상 투자실적")), ("10", "c9", annual, True, ok.replace(YEAR, "'24년 1월 ~ 12월")), ("11", "c9", annual, True, ok), ("12", "c10", annual, True, TABLES["subtotals"]), ("13", "c11", annual, True, None),
    ]
    frame = spark.createDataFrame([(a, b, c, "II. 사업의 내용 > 3", d, a, a, "original", t) for a, b, c, d, t in rows], "chunk_id string, corp_code string, report_nm string, path string, is_latest boolean, rcept_no string, latest_rcept_no string, correction_status string, text string")
    got = {r.corp_code: (r.state, None if r.won is None else int(r.won)) for r in I.executed_investments(frame, 2024).collect()}
    assert got == {"c1": ("ok", 115_000_000_000), "c7": ("conflict", None), "c9": ("ok", 115_000_000_000)}


def test_sums_and_comparison(spark):
    rows = [("A", "1", "332800", True), ("A", "2", "268,000", True), ("B", "3", "615600", True), ("C", "4", "5", True), ("C", "4", "6", True), ("D", "5", "1", False)] + [("E", f"9{k}", "1", True) for k in range(4)] + [("F", "6", "n/a", True)]
    events = spark.createDataFrame([(c, "신규 시설투자 등", a, "투자금액(원)", r, r, latest) for c, r, a, latest in rows], "corp_code string, event_type string, amount string, amount_type string, root_rcept_no string, rcept_no string, is_latest boolean")
    asked = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "C"), (3, "D"), (4, "E"), (5, "F"), (6, "nobody")], "request_id long, corp_code string")
    got = {(r.request_id, r.corp_code): (r.state, r.rank, None if r.total is None else int(r.total), None if r.difference is None else int(r.difference)) for r in I.investment_sums(events, asked).collect()}
    assert got[1, "B"] == ("ok", 1, 615600, 14800) and got[1, "A"] == ("ok", 2, 600800, None)
    assert got[2, "A"] == ("ok", None, 600800, None) and [got[k][0] for k in ((2, "C"), (3, "D"), (4, "E"), (5, "F"), (6, "nobody"))] == ["conflict", "stale", "too_many", "unreadable", "absent"]


def test_contracts_and_their_ends(spark):
    c, t = "단일판매·공급계약체결", "단일판매·공급계약해지"
    rows = [
        ("r1", "A", c, "housing", "2024-01-02", True), ("r2", "A", t, "Housing", "2024-11-15", True), ("r3", "A", c, "bridge", "2024-02-01", True), ("r4", "A", t, "tunnel", "2024-03-01", True), ("r5", "B", c, "x", "2024-01-01", True), ("r6", "B", c, "x", "2024-01-02", True),
        ("r7", "B", t, "x", "2024-05-01", True), ("r8", "C", c, "y", "2024-05-01", True), ("r9", "C", t, "y", "2024-04-01", True), ("s1", "D", c, "z", "2024-01-01", True), ("s2", "D", t, "z", "2024-01-05", False), ("s3", "E", c, "w", "2024-01-01", True),
        ("s4", "E", t, "w", "2024-01-01", True), ("s5", "E", c, "w", "2024-02-01", True), ("s6", "A", "다른", "q", "2024-01-01", True), ("s7", "F", c, None, None, True),
    ]
    frame = spark.createDataFrame([(r, k, e, title, "P", "7", d, latest) for r, k, e, title, d, latest in rows], "rcept_no string, corp_code string, event_type string, title string, counterparty string, amount string, event_date string, is_latest boolean")
    got = {r.rcept_no: (r.state, r.contract_rcept_no, r.termination_rcept_no) for r in I.contract_followups(frame).collect()}
    assert got["r1"] == ("ended", "r1", "r2") and got["r2"] == ("ended", "r1", "r2") and got["r3"] == ("open", None, None) and got["r4"] == ("no_contract", None, "r4")
    assert got["r5"] == got["r6"] == ("ambiguous", None, None) and got["r7"] == ("ambiguous", None, "r7") and got["r8"] == ("open", None, None) and got["r9"] == ("no_contract", None, "r9")
    assert got["s1"] == ("open", None, None) and "s2" not in got and got["s3"] == ("ended", "s3", "s4") and got["s5"] == ("open", None, None) and "s6" not in got and got["s7"][0] == "open"

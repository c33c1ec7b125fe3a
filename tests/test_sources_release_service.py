import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerline import service
from ledgerline.operators import evaluation, lineage, validate, workflows
from ledgerline.plans import release
from ledgerline.schemas import CITATION_FIELDS
from ledgerline.sources import files, paged
from ledgerline.streaming import incremental, windows


def test_manifest_and_universe(spark, tmp_path):
    good = {"doc_id": "d1", "rcept_no": "20240101000001", "corp_code": "00126380", "corp_name": "A", "doc_group": "periodic", "is_correction": False, "file_path": "raw/a/x.xml", "file_format": "xml", "n_files": 1}
    lines = [good, good | {"doc_id": "d2", "rcept_no": "20240101000002", "file_path": "raw/../x", "doc_group": "odd"}, good | {"doc_id": "d1", "rcept_no": "20240101000003", "n_files": 0}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    rows = files.read_manifest(spark, str(tmp_path / "m.jsonl")).cache()
    found = {r.rule: r.n for r in files.manifest_faults(rows).collect()}
    assert found == {"broken_line": 1, "missing_field": 0, "bad_group": 1, "bad_format": 0, "no_files": 1, "unsafe_path": 1, "repeated_doc_id": 1, "repeated_rcept_no": 0}
    assert rows.filter("doc_id = 'd2'").first().corp_code == "00126380"
    (tmp_path / "u.csv").write_bytes("﻿corp_code,corp_name\n00000001,A\n00000001,\n".encode())
    u = files.read_universe(spark, str(tmp_path / "u.csv"))
    assert u.columns == ["corp_code", "corp_name"] and {r.rule: r.n for r in files.universe_faults(u).collect()} == {"no_code": 0, "no_name": 1, "repeated_code": 1}


def test_raw_files_and_archives(spark, tmp_path):
    d = tmp_path / "raw" / "20240101000001"
    d.mkdir(parents=True)
    (d / "20240101000001.xml").write_bytes("<?xml encoding='euc-kr'?><P>한글</P>".encode("cp949"))
    (d / "b.xml").write_text("<P>" + "x" * 500 + "</P>")
    (d / "a.html").write_bytes(b"\xef\xbb\xbf<p>bom</p>")
    rows = files.decoded(files.ordered_sources(files.raw_files(spark, str(tmp_path / "raw")))).orderBy("document_sequence").collect()
    assert [(r.name, r.attachment) for r in rows] == [("20240101000001.xml", False), ("a.html", True), ("b.xml", True)]
    assert "한글" in rows[0].source and rows[1].source == "<p>bom</p>"
    assert files.largest_xml(files.raw_files(spark, str(tmp_path / "raw"))).first().name == "b.xml"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("b.xml", "b")
        z.writestr("r1.xml", "main")
        z.writestr("x.pdf", "no")
    a = spark.createDataFrame([("r1", bytearray(buf.getvalue())), ("r2", bytearray(b"junk"))], "receipt string, content binary")
    got = files.archive_members(a).collect()
    assert [(r.name, r.fault) for r in got] == [("r1.xml", None), ("b.xml", None), (None, "broken")]
    assert {r.fault for r in files.archive_members(a, 3).collect()} == {"too_large", "broken"}


def test_paged_source_reads_the_pages_asked_for_and_says_where_it_stopped(spark, tmp_path):
    paged.register(spark)
    for page in range(1, 9):
        (tmp_path / f"page-{page}.json").write_text(json.dumps({"status": "000", "list": [{"rcept_no": f"{page}-{i}"} for i in range(2)]}))
    options = {"path": str(tmp_path), "pagesize": "2"}
    rows, said = paged.read_bounded(spark, pages="7", **options)
    assert rows.count() == 14 and said == "listing was bounded at 7 pages of 2"
    rows, said = paged.read_bounded(spark, pages="10", **options)
    assert rows.count() == 16 and said is None
    (tmp_path / "page-8.json").write_text(json.dumps({"status": "000", "total_page": 8, "list": [{}, {}]}))
    assert paged.read_bounded(spark, pages="8", **options)[1] is None
    for pages in ("0", "11"):
        with pytest.raises(ValueError, match="1..10"):
            paged.read_bounded(spark, pages=pages, **options)
        with pytest.raises(Exception, match="1..10"):
            spark.read.format("paged_listing").options(pages=pages, **options).load().count()


def test_paged_source(spark, tmp_path):
    paged.register(spark)
    row = {"rcept_no": "1", "rcept_dt": "20240101", "corp_code": "00000001", "corp_name": "A", "stock_code": None, "report_nm": "r", "flr_nm": "f", "rm": "정"}
    for i, n in ((1, 3), (2, 2)):
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"status": "000", "list": [row | {"rcept_no": f"{i}{k}"} for k in range(n)]}))
    assert spark.read.format("paged_listing").option("path", str(tmp_path)).load().count() == 5
    for status, kind in (("011", paged.AuthError), ("020", paged.QuotaError), ("800", paged.ServiceError), ("999", paged.SourceError)):
        with pytest.raises(kind):
            paged.rows_of({"status": status})
    assert paged.rows_of({"status": "013"}) == []


def test_release(spark, tmp_path):
    frame = spark.range(100).withColumn("v", F.col("id") % 7)
    out = str(tmp_path / "rel")
    one = release.build(spark, {"t": frame}, out, publish=True)
    two = release.build(spark, {"t": frame.repartition(5).orderBy(F.rand(3))}, out)
    assert one["release"] == two["release"]
    manifest, tables = release.load(spark, out)
    assert tables["t"].count() == 100
    with pytest.raises(release.ReleaseError):
        release.build(spark, {"t": frame}, out, limit=5, publish=True)
    bad = spark.createDataFrame([("x", 1)], "check string, n int")
    with pytest.raises(release.ReleaseError):
        release.build(spark, {"t": frame.filter("id > 3")}, out, checks=bad, publish=True)
    assert release.load(spark, out)[0]["release"] == one["release"]
    frame.filter("id < 9").write.mode("overwrite").parquet(f"file://{out}/{one['release']}/t")
    with pytest.raises(release.ReleaseError):
        release.load(spark, out)
    with pytest.raises(release.ReleaseError):
        release.gate(0.89, 20)
    with pytest.raises(release.ReleaseError):
        release.same_lineage({"lineage": {"pipeline": "a"}}, "b")


def test_service():
    tools = service.Tools({"list_filings": lambda **a: service.envelope("ok", a), "get_history": lambda **a: service.envelope("ok", {"x": "y" * 70_000})})
    assert tools.call("list_filings", {"base_year": 2024})["data"] == {"base_year": 2024, "latest_only": False, "limit": 50}
    for args in ({"base_year": True}, {"base_month": 13}, {"odd": 1}, {"rcept_from": "20240231"}, {"rcept_from": "20240201", "rcept_to": "20240101"}, {"doc_group": "x"}, {"corp_code": "a\nb"}):
        assert tools.call("list_filings", args)["status"] == "error"
    assert tools.call("drop_table", {})["limitations"] == ["unknown_tool"] and tools.call("get_history", {"doc_id": "a"})["status"] == "info_limit"
    assert tools.call("get_history", {"doc_id": "a", "rcept_no": "2" * 14})["status"] == "error"
    now, mark = [0.0], ["20240102:1"]
    cache = service.AnswerCache(2, 10, lambda: now[0], lambda: mark[0])
    k = cache.key("q", " A  b", {"r": 1})
    assert k == cache.key("q", "a B", {"r": 1}) != cache.key("q", "a B", {"r": 2})
    cache.put(k, 1)
    assert cache.get(k) == 1
    for moved in ("20240103:1", "20240101:1", None):  # on, back, unknown
        cache.put(k, 1)
        mark[0] = moved
        assert cache.get(k) is None
    cache.put(k, 1)
    assert not cache.rows
    mark[0] = "20240102:1"
    for i in range(3):
        cache.put(str(i), i)
    assert [cache.get(str(i)) for i in range(3)] == [None, 1, 2]
    cache.put(k, 2)
    now[0] = 11
    assert cache.get(k) is None
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) == 1:
            raise ConnectionError
        return "ok"

    assert service.with_retry(flaky, retryable=lambda e: isinstance(e, ConnectionError), sleep=lambda s: None) == "ok"
    with pytest.raises(service.DeadlineExceeded), service.deadline(-1):
        service.check_deadline()
    text, ctx = service.follow_up("전년은?", {"company": "A사", "year": 2024, "metric": "매출액"})
    assert ctx["year"] == 2023 and text == "A사 2023년 매출액 전년은?"


def test_listed_lineage_in_batch_and_stream(spark, tmp_path):
    ddl = "rcept_no string, rcept_dt string, corp_code string, corp_name string, stock_code string, report_nm string, flr_nm string, rm string"
    rows = [("1", "20240101", "c", "C", "", "보고서 A", "f", "정"), ("2", "20240102", "c", "C", "", "[기재정정]보고서 A", "f", "정"), ("3", "20240103", "c", "C", "", "[기재정정]보고서 A", "f", ""), ("4", "20240104", "c", "C", "", "[기재정정]보고서 B", "f", ""), ("5", "20240105", "d", "D", "", "보고서 A", "f", "철")]
    frame = spark.createDataFrame(rows, ddl)
    got = {r.rcept_no: (r.root_rcept_no, r.latest_rcept_no, r.is_latest) for r in lineage.listed_lineage(frame).collect()}
    want = {"1": ("1", "3", False), "2": ("1", "3", False), "3": ("1", "3", True), "4": ("4", "4", True), "5": ("5", None, False)}
    assert got == want
    seen = {}
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).json(str(tmp_path / "in"))
        q = incremental.lineage_by_company(stream, lambda: spark.createDataFrame([r for r in rows if r[0] in seen], ddl), lambda f, e: seen.update({r.rcept_no: (r.root_rcept_no, r.latest_rcept_no, r.is_latest) for r in f.collect()}), str(tmp_path / "cp"))
        q.awaitTermination()
        assert len(seen) == (2, 5)[i]
    assert seen == want and incremental.newest_mark(frame).first().mark == "20240105:5"


def test_windows_on_a_stream_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = windows.tumbling(stream, "1 hour", "10 minutes").writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda f: sorted((r.start.replace(tzinfo=None), r.event_type, r.n, round(r.total, 6)) for r in f.collect())
    assert key(spark.table("tumbling")) == key(windows.tumbling(events, "1 hour"))
    s = windows.sessions(events, "30 minutes")
    assert s.agg(F.sum("n")).first()[0] == events.count()
    assert windows.sliding(events, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 2 * events.count()


def test_workflows(spark):
    ddl = "corp string, year int, fs_div string, sj_div string, account_nm string, currency string, thstrm_amount string"
    rows = [("a", 2024, "CFS", "BS", "부채총계", "KRW", "92,228,115"), ("a", 2024, "CFS", "BS", "자본총계", "KRW", "363,677,865"), ("a", 2024, "CFS", "CIS", "II. 당기순이익", "KRW", "34,451,351"), ("a", 2024, "OFS", "BS", "부채총계", "KRW", "1"), ("a", 2024, "CFS", "IS", "매출액", "KRW", "(5)"), ("a", 2024, "CFS", "IS", "매출액", "KRW", "6"), ("a", 2023, "CFS", "IS", "매출액", "KRW", "5")]
    values = workflows.facts(spark.createDataFrame(rows, ddl), ["corp", "year"]).cache()
    got = {(r.basis, r.ratio): (str(r.percent), r.state) for r in workflows.ratios(values.filter("year = 2024"), ["corp", "year"]).collect()}
    assert got["CFS", "debt_ratio"] == ("25.36", "ok") and got["CFS", "roe"] == ("9.47", "ok") and got["OFS", "debt_ratio"][1] == "operand_missing"
    assert not values.filter("measure = 'revenue' AND year = 2024").first().agrees
    money = spark.createDataFrame([("A", "1000", "백만원"), ("B", "12", "억원"), ("C", "900", "백만원"), ("D", "2000000", "천원"), ("E", "1500000000", "원"), ("F", "1", "?")], "c string, v string, u string").withColumn("v", F.col("v").cast("decimal(20,0)"))
    ranked = {r.c: (r["rank"], r.state) for r in workflows.compare(money, "c", "v", "u").collect()}
    assert ranked == {"D": (1, "ok"), "E": (2, "ok"), "B": (3, "ok"), "A": (4, "ok"), "C": (5, "ok"), "F": (None, "unit_unknown")}
    events = spark.createDataFrame([("c", "x", "r1", "100", True), ("c", "x", "r2", "200", True), ("c", "x", "r3", "300", True), ("c", "x", "r3", "1", False), *[("c", "y", f"s{i}", "1", True) for i in range(4)], ("c", "z", "t", "1", True), ("c", "z", "t", "2", True)], "corp_code string, event_type string, root_rcept_no string, amount string, is_latest boolean").withColumn("amount_type", F.lit("계약금액"))
    asked = spark.createDataFrame([("c", t) for t in "xyzw"], "corp_code string, event_type string")
    out = {r.event_type: (None if r.total is None else int(r.total), r.state) for r in workflows.event_totals(events, asked).collect()}
    assert out == {"x": (600, "ok"), "y": (None, "too_many"), "z": (None, "conflicting_root"), "w": (None, "absent")}
    q4 = workflows.fourth_quarter(*(spark.createDataFrame([("a", "CFS", "revenue", "KRW", v, True)], "corp string, basis string, measure string, currency string, value long, agrees boolean") for v in (300_000_000, 225_000_000)), ["corp"]).first()
    assert q4.q4 == 75_000_000


def test_validation_and_evaluation(spark):
    cite = {f: (True if f == "is_latest" else "x") for f in CITATION_FIELDS} | {"correction_status": "original"}
    late = cite | {"is_latest": False, "latest_rcept_no": "99"}
    ddl = "request_id string, label string, text string, citation struct<" + ",".join(f"{f}:{'boolean' if f == 'is_latest' else 'string'}" for f in CITATION_FIELDS) + ">"
    passages = spark.createDataFrame([("r", "S1", "sales 1,200 and 5.5", cite), ("r", "S2", "old 7", late)], ddl)
    answers = spark.createDataFrame([("r", "Sales were 1200 [S1]"), ("r", "Sales were 1300 [S1]"), ("r", "old 7 [S2]"), ("r", "old 7 [S2] superseded:99"), ("r", "x [S9]"), ("r", "none")], "request_id string, answer string")
    got = {r.answer: list(r.faults) for one in answers.collect() for r in validate.judged(spark.createDataFrame([one], answers.schema), passages).collect()}
    assert list(got.values()) == [[], ["ungrounded_number"], ["missing_disclosure"], [], ["unknown_citation"], ["no_citation"]]
    t = validate.trace(spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y")], "run_id string, seq int, step string")).first().trace
    assert t == "x ×2\ny"
    scores = spark.createDataFrame([("t", True, None), ("t", False, True)], "track string, required_fact_coverage boolean, calculation_correctness boolean")
    assert {(r.axis, r.eligible, r.passed) for r in evaluation.axis_scores(scores).collect()} == {("required_fact_coverage", 2, 1), ("calculation_correctness", 1, 1)}
    cases = spark.createDataFrame([("1", "=a b", "dev", "g"), ("2", "A  B", "holdout", "g"), ("3", "a b", "dev", "h")], "case_id string, question string, split string, source_group string")
    assert {r.rule: r.n for r in evaluation.registry_faults(cases).collect()} == {"repeated_id": 0, "repeated_question": 1, "group_crosses_splits": 1}
    sheet = evaluation.review_sheet(cases)
    assert sorted(r.question for r in sheet.collect()) == ["'=a b", "a b"]
    with pytest.raises(ValueError):
        evaluation.apply_review(cases, spark.createDataFrame([("2", "ok", "")], "case_id string, verdict string, notes string"))

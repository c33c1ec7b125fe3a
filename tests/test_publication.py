import math

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import jsons
from ledgerline.operators import retrieval
from ledgerline.plans import release


def test_frozen_values_thaw_to_what_they_were():
    value = {"b": [1, 2.5, None, {"x": True}], "a": "é", "c": []}
    frozen = jsons.frozen(value)
    assert jsons.thawed(frozen) == value and hash(frozen) == hash(jsons.frozen(dict(reversed(value.items()))))
    deep: object = 1
    for _ in range(jsons.DEPTH):
        deep = [deep]
    assert jsons.thawed(jsons.frozen(deep)) == deep
    cycle: list = []
    cycle.append(cycle)
    for bad, error in (([deep], ValueError), (cycle, ValueError), ({"x": math.nan}, TypeError), ({1: 2}, TypeError), ({"x": {1, 2}}, TypeError)):
        with pytest.raises(error):
            jsons.frozen(bad)


def test_audit_publishes_counts_and_hashes_or_refuses(spark, tmp_path):
    files = spark.createDataFrame([("1", "a.xml", b"x"), ("1", "b.XML", b"yy"), ("2", "c.pdf", b"")], "receipt string, name string, content binary")
    out = release.audit(spark, files, {"xml": 2, "pdf": 1}, str(tmp_path))
    manifest, tables = release.load(spark, str(tmp_path))
    assert manifest["release"] == out["release"] and {(r.suffix, r.n, r.bytes) for r in tables["report"].collect()} == {("xml", 2, 3), ("pdf", 1, 0)}
    assert tables["input_sha256"].count() == 3
    for wrong in ({"xml": 3, "pdf": 1}, {"xml": 2}, {"xml": 2, "pdf": 1, "zip": 1}):
        with pytest.raises(release.ReleaseError, match="files"):
            release.audit(spark, files, wrong, str(tmp_path))


def test_digests_follow_keys_and_rows_alone(spark):
    from ledgerline.operators.digests import framed, keyed_digest

    frame = spark.range(700).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("a"), "id")).alias("t"), F.array("id").alias("xs"))
    one = keyed_digest(frame, ["id"], 8)
    assert one == keyed_digest(frame.repartition(7).select("xs", "t", "v", "id"), ["id"], 8) and len(one) == 64
    others = [keyed_digest(frame, ["v", "id"], 8), keyed_digest(frame.withColumn("t", F.when(F.col("id") != 9, F.col("t"))), ["id"], 8), keyed_digest(frame.union(frame.filter("id = 4")), ["id"], 8), keyed_digest(frame.filter("false"), ["id"], 8)]
    assert len({one, *others}) == len(others) + 1
    rows = spark.createDataFrame([("x", "yz"), ("xy", "z"), (None, "x"), ("", "x"), ("string:1:x;", "x"), ("x", None)], "a string, b string")
    assert rows.select(framed(rows).alias("f")).distinct().count() == 6
    assert rows.select(framed(rows.withColumn("b", F.col("b").cast("binary"))).alias("f")).count() == 6


def test_one_of_two_publishers_fails(spark, tmp_path):
    from ledgerline.plans.store import Store

    out, frame = str(tmp_path / "rel"), spark.range(9)
    with pytest.raises(release.ReleaseError, match="nothing"):
        release.load(spark, out)
    one = release.build(spark, {"t": frame}, out, publish=True)
    store = Store(spark, out)
    seen = release.newest_pointer(store)
    release.point(store, one["release"], seen)
    with pytest.raises(release.ReleaseError, match="meanwhile"):
        release.point(store, "0" * 64, seen)
    assert release.load(spark, out)[0]["release"] == one["release"]
    assert not [n for n in store.names() if n.startswith(".staging")]
    assert release.build(spark, {"t": frame.orderBy(F.desc("id"))}, out, publish=True)["release"] == one["release"] and release.newest_pointer(store) == 3


def test_index_is_published_with_its_own_recall(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda", "theta", "zeta", "iota", "rho"]
    rows = spark.createDataFrame(
        [(f"c{i}", f"d{i}", "p", f"{w} common text", 1, f"r{i}", "k", "annual", 2024, 12, True) for i, w in enumerate(words)],
        "chunk_id string, doc_id string, path string, text string, part int, rcept_no string, corp_code string, doc_subtype string, base_year int, base_month int, is_latest boolean",
    )
    folder = f"file://{tmp_path}/index"
    retrieval.build_index(rows, folder)
    search = lambda f, q: retrieval.search(spark, f, [(q, False)], 10)
    cases = lambda shift: spark.createDataFrame([(i, w, f"c{(i + shift) % len(words)}") for i, w in enumerate(words)], "case_id int, query string, chunk_id string")
    out = release.publish_index(spark, folder, rows, cases(0), search, str(tmp_path / "rel"), "a" * 64)
    assert out["lineage"] == {"pipeline": "a" * 64, "recall": 1.0, "cases": 12}
    manifest, tables = release.load(spark, str(tmp_path / "rel"))
    release.same_lineage(manifest, "a" * 64)
    assert tables["chunks"].count() == 12
    with pytest.raises(release.ReleaseError, match="recall 0.000"):
        release.publish_index(spark, folder, rows, cases(1), search, str(tmp_path / "rel"), "a" * 64)
    with pytest.raises(release.ReleaseError, match="of 9 cases"):
        release.publish_index(spark, folder, rows, cases(0).filter("case_id < 9"), search, str(tmp_path / "rel"), "a" * 64)
    more = rows.unionByName(rows.limit(1).withColumn("chunk_id", F.lit("new")))
    with pytest.raises(release.ReleaseError, match="missing_chunk"):
        release.publish_index(spark, folder, more, cases(0), search, str(tmp_path / "rel"), "a" * 64)


def test_report_page_escapes_and_says_when_there_is_more(spark, monkeypatch):
    monkeypatch.setattr(release, "SHOWN", 2)
    page = release.report_page("<QA>", {"rows": spark.createDataFrame([(1, "<b>"), (2, None), (3, "c")], "i int, t string"), "none": spark.range(0)})
    assert "&lt;QA&gt;" in page and "&lt;b&gt;" in page and "more than 2 rows" in page and page.count("<tr>") == 4


def test_unsupported_filings_are_named(spark):
    docs = spark.createDataFrame([(r,) for r in (*release.UNSUPPORTED, "20200101000001")], "rcept_no string")
    read, listed = release.supported(docs)
    assert [r.rcept_no for r in read.collect()] == ["20200101000001"] and listed.count() == 3


def test_bad_indexes_are_refused(spark):
    faults = spark.createDataFrame([("missing_chunk", 0), ("wrong_count", 0)], "check string, n int")
    retrieval.refuse_bad_index(faults, 0.95, 12)
    for bad in ((faults, 0.85, 12), (faults, 1.0, 9), (faults.selectExpr("check", "n + 1 AS n"), 1.0, 50)):
        with pytest.raises(ValueError, match="can't be published"):
            retrieval.refuse_bad_index(*bad)

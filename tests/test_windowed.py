"""Windowed listings and batched statements against a service that counts what it is asked."""

import json
import os
import sys
import textwrap

import pytest

from ledgerline.sources import paged, windowed

SERVICE = """
import datetime as dt, json, os, uuid
HERE = os.path.dirname(__file__)
def _log(query, page):
    with open(os.path.join(HERE, "asked", uuid.uuid4().hex), "w") as f:
        json.dump([query, page], f)
def rows():
    day, out = dt.date(2024, 1, 1), []
    for k in range(60):
        for i in range({"20240110": 17, "20240111": 0}.get(day.strftime("%Y%m%d"), k % 5)):
            out.append({"rcept_no": f"{day:%Y%m%d}{i:06d}", "rcept_dt": f"{day:%Y%m%d}", "corp_code": "00000001"})
        day += dt.timedelta(days=1)
    return out
def fetch(query, page, size):
    _log(query, page)
    if query.get("status"):
        return {"status": query["status"]}
    own = [r for r in rows() if query["bgn_de"] <= r["rcept_dt"] <= query["end_de"]]
    pages = -(-len(own) // size)
    part = own[(page - 1) * size : page * size]
    return {"status": "000" if part else "013", "total_page": pages, "list": part}
def statements(query, page, size):
    _log(query, page)
    codes = query["corp_code"].split(",")
    assert len(codes) <= 100
    return {"status": "000", "list": [{"corp_code": c, "bsns_year": query["bsns_year"], "account_nm": "x", "rcept_no": c} for c in codes]}
"""


@pytest.fixture
def service(spark, tmp_path):
    name = f"service_{tmp_path.name.replace('-', '_')}"
    (tmp_path / "asked").mkdir()
    (tmp_path / f"{name}.py").write_text(textwrap.dedent(SERVICE))
    sys.path.insert(0, str(tmp_path))
    env = spark.sparkContext.environment
    before = env.get("PYTHONPATH", "")
    env["PYTHONPATH"] = os.pathsep.join([str(tmp_path), before])
    yield name, lambda: [json.loads((tmp_path / "asked" / f).read_text()) for f in os.listdir(tmp_path / "asked")], __import__(name)
    env["PYTHONPATH"] = before
    sys.path.remove(str(tmp_path))


def test_a_period_is_read_whole(spark, service):
    name, asked, module = service
    rows, said = windowed.listing(spark, f"{name}:fetch", {"bgn_de": "20240101", "end_de": "20240229"}, pages=3, size=4)
    planned = len(asked())
    got = sorted(r.rcept_no for r in rows.collect())
    want = [r["rcept_no"] for r in module.rows()]
    day = [r for r in want if r.startswith("20240110")]
    assert said == ["listing of 20240110 was bounded at 3 pages of 4"]
    assert got == sorted(set(want) - set(day[12:]))  # that day alone has more than three pages
    later = [(json.dumps(q, sort_keys=True), p) for q, p in asked()]
    reads = [x for x in set(later) if x[1] > 1]
    assert sum(p > 1 for _, p in later) == len(reads) and max(p for _, p in later) <= 3  # no later page twice, none beyond the bound
    assert planned < len(later)


def test_what_fits_is_one_window(spark, service):
    name, asked, module = service
    pages, bounded = windowed.plan(module.fetch, {"bgn_de": "20240101", "end_de": "20240229"}, 10, 100)
    assert bounded == [] and [(p.number, p.rows is not None) for p in pages] == [(1, True), (2, False)] and len(asked()) == 1
    rows, said = windowed.listing(spark, f"{name}:fetch", {"bgn_de": "20240111", "end_de": "20240111"})
    assert rows.count() == 0 and said == []


def test_faults_are_no_empty_listings(spark, service):
    name, _, module = service
    for status, error in (("011", paged.AuthError), ("020", paged.QuotaError), ("800", paged.ServiceError)):
        with pytest.raises(error):
            windowed.plan(module.fetch, {"bgn_de": "20240101", "end_de": "20240102", "status": status}, 3, 4)
    with pytest.raises(ValueError, match="ends before"):
        windowed.plan(module.fetch, {"bgn_de": "20240102", "end_de": "20240101"}, 3, 4)
    with pytest.raises(paged.SourceError, match="total_page"):
        windowed.plan(lambda q, p, s: {"status": "000", "total_page": "many", "list": [{}] * s}, {"bgn_de": "20240101", "end_de": "20240101"}, 3, 4)


def test_statements_go_by_batches_of_companies(spark, service):
    name, asked, _ = service
    windowed.register(spark)
    codes = [f"{k:08d}" for k in range(230)]
    options = {"fetch": f"{name}:statements", "companies": json.dumps(codes + codes[:5]), "year": "2023", "report": "11011"}
    rows = spark.read.format("batched_statements").options(**options).load()
    assert rows.count() == 230 and sorted(len(q["corp_code"].split(",")) for q, _ in asked()) == [30, 100, 100]
    for bad in ({"year": "2014"}, {"report": "11015"}, {"companies": "[]"}, {"companies": '["1"]'}):
        with pytest.raises(Exception, match="statements need|eight digits"):
            spark.read.format("batched_statements").options(**(options | bad)).load().count()

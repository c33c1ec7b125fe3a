"""Stateful lineage: replays in any order give the batch result."""

import random

import pytest

from ledgerline.operators.lineage import listed_lineage
from ledgerline.streaming import chains

DDL = "corp_code string, report_nm string, rcept_no string, rcept_dt string, rm string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module")
def filings():
    rnd = random.Random(4)
    out = []
    for i in range(90):
        corp, name = rnd.choice("AB"), rnd.choice(["사업보고서 (2023.12)", "분기 보고서"])
        tag = rnd.choice(["", "[기재정정]", "[첨부정정] "])
        out.append((corp, tag + name, f"2024{i:010d}", "20240101", rnd.choice(["", "유", "정", "정", "유정", "철", "정철"])))
    return out


def test_chain_by_hand():
    rows = chains.chain_lineage([("3", True, ""), ("1", False, "정"), ("2", True, "정"), ("4", True, "철"), ("5", False, "")])
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [("1", None, "1", "3", False), ("2", "1", "1", "3", False), ("3", "2", "1", "3", True), ("4", "2", "1", "3", False), ("5", None, "5", "5", True)]


def test_replays_equal_batch(spark, filings, tmp_path):
    rnd = random.Random(1)
    order = filings[:]
    rnd.shuffle(order)
    # some filings are listed first without their flags, and some come again
    early = [(*r[:4], "" if k % 3 == 0 else None) for k, r in enumerate(order) if k % 2 == 0]
    listed = early + order + order[:10]
    size = len(listed) // 4 + 1
    for k in range(0, len(listed), size):
        spark.createDataFrame(listed[k : k + size], DDL).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        told = str(tmp_path / "out")
        q = chains.lineage_changes(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda f, _: f.write.mode("append").parquet(told)).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        assert q.exception() is None
    finally:
        spark.conf.set(PROVIDER, before)
    changes = spark.read.parquet(told)
    got = {r.rcept_no: (r.predecessor_rcept_no, r.root_rcept_no, r.latest_rcept_no, r.is_latest, r.withdrawn) for r in chains.current(changes).collect()}
    batch = listed_lineage(spark.createDataFrame(filings, DDL)).collect()
    assert got == {r.rcept_no: (r.predecessor_rcept_no, r.root_rcept_no, r.latest_rcept_no, r.is_latest, r.withdrawn) for r in batch}
    assert changes.count() < 6 * len(filings)

"""Sentences, topics and their alignment."""

from pyspark.sql import functions as F

from ledgerline.operators import narratives as N

A = "당사는 DRAM과 NAND를 생산합니다. 자동차 시장의 수요가 늘었음. 상세한 내용은 표를 참고하세요. 배터리 사업을 영위하고 있습니다.\n| 게임 | 판매합니다. |\n게임을 개발하고 있습니다. 미완성 문장"
B = "2024년 배터리 사업을 영위하고 있습니다. 반도체 DRAM을 판매합니다. 수요가 많은 자동차 시장임. 게임 판매망을 두고 있습니다."


def test_sentences_are_whole(spark):
    frame = spark.createDataFrame([(A,), (None,), ("",), ("끝나지 않은",), ("아래와 같습니다. 다음의 표입니다. 좋다.” 끝",)], "t string")
    got = [r[0] for r in frame.select(N.whole_sentences(F.col("t"))).collect()]
    assert got[0] == ["당사는 DRAM과 NAND를 생산합니다.", "자동차 시장의 수요가 늘었음.", "배터리 사업을 영위하고 있습니다.", "게임을 개발하고 있습니다."]
    assert got[1:4] == [[], [], []] and got[4] == ["좋다.”"]


def test_reports_are_aligned_by_topic(spark):
    rows = [(1, 0, 0, A), (1, 1, 0, B), (2, 0, 0, A), (3, 0, 0, A), (3, 1, 0, "철강을 생산합니다."), (4, 0, 1, B), (4, 0, 0, None), (4, 1, 0, B)]
    passages = spark.createDataFrame(rows, "request_id long, doc_no int, seq int, text string").repartition(3)
    out = N.aligned_topics(passages, 9)
    got = {(r.request_id, r.rank): (r.family, r.domain, list(r.sentences)) for r in out.collect()}
    assert [got[1, k][:2] for k in (1, 2, 3)] == [("business", "메모리"), ("business", "배터리"), ("market", "자동차")] and (1, 4) not in got
    assert got[1, 2][2] == ["배터리 사업을 영위하고 있습니다.", "2024년 배터리 사업을 영위하고 있습니다."]
    assert all((r, 1) not in got for r in (2, 3)) and got[4, 1][2][0] == got[4, 1][2][1]
    assert {r.request_id: r.state for r in N.unanswered(passages, out).collect()} == {2: "one_report", 3: "no_common_topic"}
    assert N.aligned_topics(passages, 1).filter("request_id = 1").count() == 1


def test_a_sentence_is_used_once(spark):
    both = "배터리와 게임을 개발합니다. 게임을 판매합니다."
    passages = spark.createDataFrame([(1, d, 0, both) for d in (0, 1)], "request_id long, doc_no int, seq int, text string")
    assert [(r.domain, r.rank) for r in N.aligned_topics(passages, 9).collect()] == [("게임", 1)]
    named = spark.createDataFrame([(1, 2024, 12, "b"), (1, 2023, 12, "a"), (1, 2024, 12, "b")], "request_id long, year int, month int, rcept_no string")
    assert sorted(r.doc_no for r in N.numbered_reports(named).collect()) == [1, 2, 2]

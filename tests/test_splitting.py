"""Greedy packing against plain loops; the fallback of live chunks."""

import random
import re

import pytest

from ledgerline.operators import splitting as S


def plain_lines(text, most):
    """Line by line, on strings."""
    if len(text) <= most:
        return [text] if text else []
    out, now = [], None
    for line in text.splitlines():
        while line:
            part, line = line[:most], line[most:]
            if now is not None and len(now) + 1 + len(part) > most:
                out.append(now)
                now = None
            now = part if now is None else now + "\n" + part
    return out + ([now] if now is not None else [])


def plain_sentences(text, most):
    if len(text) <= most:
        return [text] if text else []
    out, now, start = [], "", 0
    for m in [*re.finditer(r"[.다음니)]\s", text), None]:
        s = text[start : m.end()] if m else text[start:]
        start = m.end() if m else start
        if now and len(now) + len(s) > most:
            out.append(now)
            now = ""
        now += s
    return out + ([now] if now else [])


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    parts = ["a", "bb ", "한다. ", "합니다\n", "음 ", ") ", "\n", "\n\n", "x" * 31, "끝.", "니 ", " "]
    return [None, "", "\n", "short"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(300)]


@pytest.mark.parametrize("most", [1, 7, 30, 200])
def test_packing_equals_loops(spark, texts, most):
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    for way, plain in (("lines", plain_lines), ("sentences", plain_sentences)):
        got = {}
        for r in S.pieces(frame, way, most).collect():
            got.setdefault(r.id, {})[r.piece] = r.text
        for i, t in enumerate(texts):
            own = got.get(i, {})
            assert [own[k] for k in range(1, len(own) + 1)] == plain(t or "", most), (way, t)
    for t in texts:
        both = S.by_lines_and_sentences(t or "", most)
        assert all(len(p) <= most for p in both)
        assert "".join(both).replace("\n", "") == (t or "").replace("\n", "")


def test_live_chunks(spark):
    long = "<p>" + "가나다라. " * 3000 + "</p>"
    rows = [
        ("a", 1, False, "<html><body><h1>I. 개요</h1>" + long + "<table><tr><td>x</td></tr></table></body></html>"), ("b", 1, False, "<script>1</script>"), ("c", 1, False, None), ("c", 2, True, "just text"),
    ]
    frame = spark.createDataFrame([(d, "1" * 14, "f.xml", n, a, s) for d, n, a, s in rows], "doc_id string, rcept_no string, src_file string, document_sequence int, attachment boolean, source string")
    got = S.live_chunks(frame).collect()
    assert {r.doc_id for r in got} == {"a", "c"} and all(r.n_chars == len(r.text) <= S.LIVE_CHARS for r in got)
    assert max(r.n_chars for r in got) > 5000 and sum(r.n_tables for r in got if r.doc_id == "a") == 1
    assert [r.path for r in got if r.doc_id == "c"] == ["[attachment] 원문 > f.xml"]


def test_titles_in_running_text(spark):
    text = "서문\nI. 회사의 개요 및 연혁\n본문 하나\n사업의 내용\n\n본문 둘\nII. 이사회\n"
    assert S.titled_sections(text, "f") == [("I. 회사의 개요 및 연혁", "본문 하나"), ("사업의 내용", "본문 둘")]
    assert S.titled_sections("nothing", "f.txt") == [("원문 > f.txt", "nothing")]
    page = spark.createDataFrame([("<?xml version='1.0'?><div>a <b>b</b></div><style>x{}</style><p>c&amp;d<br/>e</p>",)], "h string")
    assert page.select(S.visible_lines(page.h)).first()[0] == "a b\nc&d\ne"


def test_unparsed_sources_fall_back_to_titles(spark, monkeypatch):
    from ledgerline.operators import parsing

    monkeypatch.setattr(parsing, "parse_chunks", lambda s, most: spark.createDataFrame([], "doc_id string, document_sequence int, path string, part int, n_tables int, text string, section_start int"))
    monkeypatch.setattr(parsing, "number_repeated_paths", lambda rows: rows)
    source = "<p>사업의 내용</p><p>" + "a" * 9000 + "</p><p>사업의 내용</p><p>b</p><table></table>"
    frame = spark.createDataFrame([("d", "1" * 14, "f.xml", 1, False, source)], "doc_id string, rcept_no string, src_file string, document_sequence int, attachment boolean, source string")
    got = sorted((r.path, r.part, r.n_chars, r.n_tables) for r in S.live_chunks(frame).collect())
    assert got == [("사업의 내용", 1, 8000, 1), ("사업의 내용", 2, 1000, 1), ("사업의 내용 (2)", 1, 1, 0)]

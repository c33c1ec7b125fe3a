"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every stage of the pipeline."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from test_jaccard import brute as brute_join
from test_suffix import brute as brute_cut

FILTERS = dict(corpus_pipeline.STAGES[:-1])
CLASHES = ["_row", "_spans", "_hits", "_key", "_digest", "_doc", "_h", "digest", "hits", "whole", "cut", "r", "h", "id", "key", "spans", "n", "cid", "group", "_of", "_out", "_lang", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHES)


def _rows():
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    one, passage, long = words(80), words(60), words(200_000)
    texts = [None, "", " \n", "x", one, one, one, one + " end", words(40) + " " + passage, words(40) + " " + passage, "password = " + "k" * 20 + " " + words(30), long, long + " tail", words(3), None]
    ids = [*range(len(texts) - 2), None, None]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    return rows + [rows[4], rows[8], rows[11]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *["z"] * len(CLASHES)) for r in _rows()], SCHEMA).repartition(3)


@pytest.mark.parametrize("stage", FILTERS)
def test_filters_keep_columns_and_rows_whole(spark, odd, stage):
    out = FILTERS[stage](spark, odd, "")
    assert out.schema == odd.schema
    rows = out.collect()
    assert all(r["_row"] == r["cut"] == "z" and (r.n_chars is None) == (r.text is None) for r in rows)
    before = Counter((i, t) for i, t, *_ in _rows())
    if stage == "jaccard_join":
        number = range(len(_rows()))
        kinds = brute_join(number, [t for _, t, *_ in _rows()])
        assert len(rows) == len({c for _, _, c in kinds})
        assert not Counter((r.doc_id, r.text) for r in rows) - before
    elif stage == "suffix_dedup":
        gone = [n for _, n, _, _ in brute_cut([t for _, t, *_ in _rows()], 200)]
        want = sorted(len((t or "").encode()) - n for (_, t, *_), n in zip(_rows(), gone))
        assert sorted(len((r.text or "").encode()) for r in rows) == want
    elif stage == "secret_scan":
        assert len(rows) == len(_rows()) and [r.text for r in rows if r.doc_id == 10][0].startswith("[SECRET] ")
        assert not Counter((r.doc_id, r.text) for r in rows if r.doc_id != 10) - before
    else:
        assert rows and not Counter((r.doc_id, r.text) for r in rows) - before and all(len((r.text or "").split()) >= 10 for r in rows)


def test_packing_takes_odd_rows(spark, odd):
    rows = corpus_pipeline.pack(spark, odd, "").collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    ends = Counter(i for i, *_ in _rows())
    assert total[0] == 1 and total[1] == 1 and total[None] >= ends[None] and set(total) == set(ends)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_tables_give_no_rows(spark, odd, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, odd.filter("false"), "").collect() == []

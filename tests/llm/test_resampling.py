"""Importance resampling against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from ledgerline.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def _grams(text, orders):
    words = WORDS(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, buckets, orders, seed=2024, least=20, percent=10):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(place(g) for _, t in rows for g in _grams(t, orders)[1])
    t = Counter(place(g) for x in target for g in _grams(x, orders)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(big_s + buckets) / (float(s[b] + 1) * float(big_t + buckets))))
    out = []
    for i, text in rows:
        n, grams = _grams(text, orders)
        weight = sum(gain(place(g)) for g in grams)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): k for k, r in enumerate(enough[: percent * len(enough) // 100], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


def _odd(texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    long = " ".join(f"w{k % 701} X{k % 13}" for k in range(9000))
    return rows + [(None, texts[20]), (None, None), (900, long), (900, long), (901, long + " end"), (902, "ÀB c1D_e" * 9), (903, "nul\x00byte " * 30)] + rows[20:24]


@pytest.mark.parametrize(("orders", "buckets", "percent"), [(1, 10_000, 10), (2, 500, 50), (3, 97, 30)])
def test_equals_plain_loops(spark, texts, orders, buckets, percent):
    target = ["", None, "The thing and the tion", *[t for t in texts[40:60] if t]]
    rows = _odd(texts)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, weight int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(map(tuple, resampling.resample(spark, docs, aim, buckets, orders, percent=percent).collect()))
    assert got == brute(rows, target, buckets, orders, percent=percent)


def test_every_word_has_its_followers_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 4)
    texts = ["a b c d e f g h i j k l m", " x y ", "", "z"]
    frame = spark.createDataFrame(list(enumerate(texts)), "_n long, text string")
    got = Counter((r["_n"], r["gram"]) for r in resampling.gram_rows(frame, "_n", 3).collect())
    want = Counter((i, g) for i, t in enumerate(texts) for g in _grams(t, 3)[1])
    assert got[2, None] == 1  # a text without words keeps its row
    assert Counter({k: n for k, n in got.items() if k[1] is not None}) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(spark, none, some).collect() == []
    assert [tuple(r) for r in resampling.resample(spark, some, none, percent=100).collect()] == list(brute([(1, "a b " * 20)], [], 10_000, 1, percent=100))


def test_ties_and_copies_take_each_rank_once(spark):
    rows = [(7, "same words here " * 8)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.resample(spark, docs, docs, percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 21))

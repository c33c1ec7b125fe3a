import hashlib
import time

import numpy as np
import pandas as pd
import pytest

from ledgerline.llm import topk, warc

MAGIC = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
SCHEMA = "page_id long, url string, html string, file string"


def _expected(rows):
    target = {}
    for page, html in rows:
        if len((html or "").encode()) >= 1000 and page is not None:
            target[html] = max(page, target.get(html, page))
    n = pd.Series([h or "" for _, h in rows]).value_counts()
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        t = target.get(html) if html and n[html] > 1 else None
        revisit = t is not None and t != page
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", t if revisit else None))
    return sorted(out, key=str)


def test_round_trip_of_hard_pages(spark):
    big = "é" + "x" * 1200
    rows = [(1, MAGIC), (2, MAGIC * 30), (3, MAGIC * 30), (4, big), (5, big), (6, big), (7, None), (8, ""), (9, "short"), (10, "short"), (None, big), (11, "\r\n\r\n" * 300), (12, "\r\n\r\n" * 300), (13, "tail\r\n"), (6, big)]
    frame = spark.createDataFrame([(p, f"http://x/{p}\r\nWARC/1.1\r\n", h, "clash") for p, h in rows], SCHEMA).repartition(3)
    got = warc.archive_round_trip(spark, frame).drop("file", "offset").collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows)


@pytest.mark.parametrize("split", [64, 1000, 10**6])
def test_chains_cross_the_ranges_of_a_file(spark, split):
    """One file read in many ranges, with payloads full of separators, heads and record ends, and one far larger than a range."""
    rng = np.random.default_rng(split)
    bits = ["WARC/1.", "WARC/1.1\r\n", "\r\n", "\r\n\r\n", MAGIC, "Content-Length: 3", "WWARC/1.0\r\n", "é", "x" * 70]
    rows = [(i, "".join(rng.choice(bits, int(rng.integers(0, 12))))) for i in range(60)] + [(90, "y" * 20_000 + MAGIC), (91, MAGIC + "z" * 3000), (92, MAGIC + "z" * 3000)]
    frame = spark.createDataFrame([(p, "http://WARC/1.1\r\n" + str(p), h, "clash") for p, h in rows], SCHEMA).coalesce(1)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = warc.archive_round_trip(spark, frame).drop("file", "offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert sorted(map(tuple, got), key=str) == _expected(rows)


def test_a_broken_chain_fails_and_names_the_place(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: {}\r\n\r\nabc\r\n\r\n"
    (tmp_path / "part-0").write_text(head.format(3) + head.format(3), newline="")
    assert [(r.page_id, r.payload_bytes, r.offset) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()] == [(1, 3, 0), (1, 3, len(head.format(3)))]
    (tmp_path / "part-0").write_text(head.format(3) + head.format(4), newline="")
    with pytest.raises(Exception, match="no record begins at"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_false_heads_are_scanned_in_linear_time():
    raw = b"1\r\n" + b"A: b\r\n" * 200_000
    start = time.process_time()
    assert warc.fragment(raw)[1] == -1 and time.process_time() - start < 1


def test_empty_table(spark):
    assert warc.archive_round_trip(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_lookup_beyond_the_broadcast_bound(spark, monkeypatch):
    from ledgerline.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(shared, "HOT_SHARE", 0.2)
    big = [c * 1500 for c in "abcd"]
    rows = [(i, big[0]) for i in range(40)] + [(100 + i, big[i % 4]) for i in range(12)]
    frame = spark.createDataFrame([(p, "u", h, "") for p, h in rows], SCHEMA)
    got = warc.archive_round_trip(spark, frame).drop("file", "offset").collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows)


def test_pointer_jumping_keeps_the_chain_only():
    assert warc.reachable(np.array([0, 5, 7, 20, 30]), np.array([7, 20, 20, -1, 40])).tolist() == [True, False, True, True, False]
    assert warc.reachable(np.zeros(0, int), np.zeros(0, int)).tolist() == []


def _brute(ids, vectors, every, k):
    out = []
    for q in sorted({i for i in ids if i is not None and i % every == 0}):
        own = [(i, np.floor(1024.0 * np.array(v, float)).astype(int)) for i, v in zip(ids, vectors) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
        mine = [v for i, v in own if i == q]
        if not mine:
            continue
        scored = sorted((-sum(a * b for a, b in zip(mine[0].tolist(), v.tolist())), i) for i, v in own if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    vectors = [(centres[rng.integers(6)] + rng.normal(scale=0.3, size=12)).astype("float32").tolist() for _ in range(400)]
    vectors[5:25] = [vectors[4]] * 20
    vectors[30], vectors[31], vectors[32], vectors[33], vectors[34] = None, [None] * 12, [float("nan")] * 12, [], vectors[33][:5]
    ids = [i if i != 77 else None for i in range(400)]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, score string").repartition(3)
    assert sorted(map(tuple, topk.top_k(spark, frame, every=10).collect())) == _brute(ids, vectors, 10, 10)
    few = frame.filter("vec_id < 3")
    assert sorted(map(tuple, topk.top_k(spark, few, every=10).collect())) == _brute(ids[:3], vectors[:3], 10, 10)
    assert topk.top_k(spark, frame.filter("false"), every=10).collect() == []


def test_search_stops_early_on_clustered_vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 64)) * 200
    vectors = np.floor(centres[rng.integers(10, size=4000)] + rng.normal(size=(4000, 64)) * 20).astype(np.int64)
    index = topk.ImpactIndex(np.arange(4000), vectors)
    found, scores, done = index.search(0, vectors[0], 10, None)
    order = topk.best(found, scores, 10)
    exact = vectors @ vectors[0]
    exact[0] = -(10**12)
    assert found[order].tolist() == topk.best(np.arange(4000), exact, 10).tolist()
    assert done < vectors.size


def test_numbers_of_any_size_are_exact(spark):
    rng = np.random.default_rng(8)
    vectors = [(rng.normal(size=4) * 10.0 ** rng.integers(-2, 12)).tolist() for _ in range(60)]
    vectors[10], vectors[11], vectors[12], vectors[13] = [1e30, 0.0, 0.0, 1.0], [1e300, -1e300, 1.0, 2.0], [-(2.0**60), 1.0, 0.5, 0.25], [5e-324, -0.0, 2.0**-11, -(2.0**-11)]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(2)
    got = sorted(map(tuple, topk.top_k(spark, frame, every=10).collect()))
    whole = [[(1024 * int(x) if abs(x) >= 2**50 else int(np.floor(1024.0 * x))) for x in v] for v in vectors]
    want, top = [], 2**63 - 1
    for q in range(0, 60, 10):
        score = sorted((-min(max(sum(a * b for a, b in zip(whole[q], w)), -top), top), i) for i, w in enumerate(whole) if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:10])]
    assert got == want


def test_queries_that_share_an_id_are_queries_of_their_own(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [1.0, 0.0]), (1, [1024.0, 5.0]), (2, [3.0, 7.0]), (None, [9.0, 9.0]), (3, None)]
    frame = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, rank int")
    want = sorted([(100, 1, 1, 1024 * 1024 * 1024), (100, 2, 2, 3 * 1024 * 1024), (100, 1, 2, 7 * 1024 * 1024), (100, 2, 1, 5 * 1024 * 1024)])
    for parts in (1, 3, 5):
        assert sorted(map(tuple, topk.top_k(spark, frame.repartition(parts)).collect())) == want

import re

import numpy as np
import pandas as pd
import pytest

from ledgerline.llm import jaccard


def _sets(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(ids, texts):
    sets, parent = _sets(texts), list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            o = len(s & sets[j])
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = d if least.get(r) is None else (least[r] if d is None else min(d, least[r]))
    return sorted(((d, len(s), least[root(i)] if s else d) for i, (d, s) in enumerate(zip(ids, sets))), key=str)


def run(spark, ids, texts):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], "doc_id long, text string, n string").repartition(3)
    return sorted(map(tuple, jaccard.jaccard_components(spark, frame).collect()), key=str)


def _corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    words = lambda n: rng.choice(vocab, n).tolist()
    texts = []
    licence = words(60)
    for _ in range(12):
        base = words(int(rng.integers(8, 160)))
        for _ in range(int(rng.integers(1, 12))):
            own = base.copy()
            for _ in range(int(rng.integers(0, max(2, len(own) // 18)))):
                own[int(rng.integers(len(own)))] = "x" + str(rng.integers(10**6))
            texts.append(" ".join(own))
    for _ in range(25):  # a common passage with little or much around it
        texts.append(" ".join(words(int(rng.integers(0, 40))) + licence + words(int(rng.integers(0, 20)))))
    chain = words(80)
    for k in range(8):  # neighbours link, ends don't
        texts.append(" ".join(chain[3 * k : 3 * k + 40]))
    texts += [None, "", " \n", "one", "ONE", "one two three", "One Two Three", "a b c d e", "a b c d e a b c d e", texts[0], texts[0].upper()]
    order = rng.permutation(len(texts))
    return [texts[i] for i in order]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    texts = _corpus(seed)
    assert run(spark, range(len(texts)), texts) == brute(range(len(texts)), texts)


def test_later_turns_read_the_open_lists_alone(spark, monkeypatch):
    read, save = {}, jaccard.Workspace.save

    def saved(self, frame, name):
        read[name] = {f.split("/")[-2] for f in frame.inputFiles()}
        return save(self, frame, name)

    monkeypatch.setattr(jaccard.Workspace, "save", saved)
    texts = _corpus(3)
    assert run(spark, range(len(texts)), texts) == brute(range(len(texts)), texts)
    assert "postings" in read["open1"] and "open1" in read["open2"] and "postings" not in read["open2"]


def test_odd_ids_and_small_bounds(spark, monkeypatch):
    from ledgerline.llm import shared

    for module in (shared, jaccard):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 4)
    monkeypatch.setattr(shared, "HOT_SHARE", 0.05)
    monkeypatch.setattr(jaccard, "BLOCK", 400)
    texts = _corpus(3)
    ids = list(range(len(texts)))
    i = texts.index("one two three")
    texts += [texts[i], texts[i], "lonely words that nobody else has here"]
    ids += [None, ids[i], None]
    assert run(spark, ids, texts) == brute(ids, texts)


def test_documents_of_the_smallest_table(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, jaccard.jaccard_components(spark, spark.read.parquet(f"{sf}/documents.parquet")).collect()), key=str)
    assert got == brute(docs.doc_id.tolist(), docs.text.tolist())
    assert len({c for _, _, c in got}) < len(got)


def test_empty_table_and_keeping_one(spark):
    frame = spark.createDataFrame([(2, "a b c d e f", "k"), (1, "a b c d e f", "k"), (3, None, None), (4, "other words", "k")], "doc_id long, text string, cid string")
    kept = jaccard.keep_one(spark, frame)
    assert kept.schema == frame.schema and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert jaccard.jaccard_components(spark, frame.filter("false")).collect() == []


@pytest.mark.parametrize("bound", [None, 2])
def test_keeping_one_row_where_ids_repeat_or_are_null(spark, monkeypatch, bound):
    from ledgerline.llm import shared

    if bound:
        for module in (shared, jaccard):
            monkeypatch.setattr(module, "BROADCAST_ROWS", bound)
        monkeypatch.setattr(shared, "HOT_SHARE", 0.2)
    same, near, null, other = (" ".join(f"{w}{i}" for i in range(40)) for w in "snuo")
    rows = [(1, same, "k")] * 6 + [(2, near, "k"), (None, near + " end", "a"), (None, null, "b"), (None, null, "a"), (None, None, "k"), (None, None, "k"), (7, other, "k"), (7, near, "k"), (3, " ", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
    kept = jaccard.keep_one(spark, frame)
    assert kept.schema == frame.schema
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, same), (2, near), (None, null), (None, None), (None, None), (7, other), (3, " ")], key=str)


def test_keeping_one_writes_no_texts_and_names_classes_briefly(spark, monkeypatch):
    written, buckets = [], []
    save, packed = jaccard.Workspace.save, jaccard.packed

    def saved(self, frame, name):
        written.append((name, frame.columns))
        return save(self, frame, name)

    def counted(docs, n, whole):
        out = packed(docs, n, whole)
        if not whole:
            buckets.append(n)
            rows = [r for r in out.collect() if r.cids]
            assert rows and all(len(r.cids) == 2 * len(r.counts) for r in rows)  # 8 bytes a class and bucket, a count has 4
        return out

    monkeypatch.setattr(jaccard.Workspace, "save", saved)
    monkeypatch.setattr(jaccard, "packed", counted)
    frame = spark.createDataFrame([(2, "a b c d e f"), (1, "a b c d e f"), (None, "other words")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            kept = jaccard.keep_one(spark, frame)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, None]
    assert not [name for name, columns in written if {"text", "_row"} & set(columns)]
    assert len(set(buckets)) == 1


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(4)
    for _ in range(50):
        base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 1 << 62, int(rng.integers(0, 20)), dtype=np.uint64)])) for _ in range(30)]
        sizes = np.array([len(s) for s in sets])
        index = jaccard.InvertedIndex(sets, sizes)
        q = sets[int(rng.integers(30))]
        q = np.unique(np.concatenate([q[:-4], rng.integers(0, 1 << 62, 4, dtype=np.uint64)]))
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, q)) >= 75 * len(np.union1d(s, q))]
        assert index.divide_skip(q, len(q)).tolist() == want

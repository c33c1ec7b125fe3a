import hashlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import bwt, suffix_dedup


def brute(texts, depth):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + depth] for r in raws for i in range(len(r) - depth + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int8)
        for i in range(len(r) - depth + 1):
            if seen[r[i : i + depth]] > 1:
                gone[i : i + depth] = 1
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def _corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé "), 7))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), "x" * 500
    texts = [prose(int(rng.integers(1, 120))) for _ in range(20)]
    texts += [prose(20) + passage + prose(10), passage[100:] + prose(30), prose(5) + passage[:260], passage, line, "ab" * 400, prose(3) + line[:230] + prose(3)]
    base = prose(200)
    for k in range(12):
        b = list(base)
        for _ in range(3):
            b[int(rng.integers(len(b)))] = "Q"
        texts.append("".join(b))
    texts += [texts[0], texts[0], None, "", "short", "short", base[:199], base[:200], "a" * 199, texts[3] + texts[4]]
    return texts


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed, monkeypatch):
    if seed:
        from ledgerline.llm import shared

        monkeypatch.setattr(shared, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(bwt, "SHARD", 3000)
    texts = _corpus(seed)
    ids = [i if i != 5 else None for i in range(len(texts))]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], "doc_id long, text string, digest string").repartition(4)
    got = sorted(map(tuple, suffix_dedup.remove_repeats(spark, frame).collect()), key=str)
    assert got == sorted(((i, *r) for i, r in zip(ids, brute(texts, 200))), key=str)


def test_cut_text_keeps_columns(spark):
    texts = _corpus(2)
    frame = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, hits string").repartition(3)
    out = suffix_dedup.cut_repeats(spark, frame)
    assert out.schema == frame.schema
    rows = {r.doc_id: r for r in out.collect()}
    want = brute(texts, 200)
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].n_chars == len(rows[i].text or "")
        if want[i][1] == 0:
            assert rows[i].text == t
        else:
            assert len((rows[i].text or "").encode()) <= want[i][0] - want[i][1]


def test_texts_without_repeats_are_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(8)
    prose = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = prose(8000)
    texts = [*[prose(400) for _ in range(30)], passage + prose(300), prose(300) + passage, passage[:400], texts_twice := prose(300), texts_twice]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    seen, joined = [], suffix_dedup._joined

    def counted(left, side, *sizes):
        assert sizes[-1] > suffix_dedup.BROADCAST_BYTES
        seen.append((joined(left, side, *sizes), side.count()))
        return seen[-1][0]

    monkeypatch.setattr(suffix_dedup, "_joined", counted)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 24 * 6)
    cut = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(spark, frame).collect()}
    removed = brute(texts, 200)
    assert len(cut) == len(texts)
    assert all((cut[i] == t) == (not r[1]) and len(cut[i]) == len(t) - r[1] for i, (t, r) in enumerate(zip(texts, removed, strict=True)))
    assert seen and all(0 < n <= 6 and "LeftSemi" in out._jdf.queryExecution().toString() for out, n in seen)


def test_blocks_of_any_size_give_the_same_minimizers_and_hashes(monkeypatch):
    from ledgerline.llm import kernel

    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    data[rng.integers(0, 5000, 40)] = 32
    data[3000:3600] = 97
    off = np.concatenate([[0], np.cumsum(np.append(rng.integers(0, 900, 6), 0)), [5000]])
    off = np.sort(np.minimum(off, 5000))
    starts, ends, _ = kernel.spans(data, np.array([0, 5000]))
    got = []
    for size in (50, 333, 1 << 18):
        monkeypatch.setattr(suffix_dedup, "WINDOWS", size)
        monkeypatch.setattr(kernel, "HASH_BYTES", size)
        got.append([*suffix_dedup.minimizers(data, off), kernel.hash_spans(data, starts, ends), kernel.hash_grams(data, 48)])
    for other in got[1:]:
        assert all(len(a) == len(b) and (a == b).all() for a, b in zip(got[0], other))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(spark, frame).collect() == []


def _strings(rng):
    base = rng.integers(97, 100, 80, dtype=np.uint8).tobytes()
    return [base[int(rng.integers(0, 30)) :][: int(rng.integers(1, 60))] + rng.integers(97, 99, int(rng.integers(0, 9)), dtype=np.uint8).tobytes() for _ in range(12)]


@pytest.mark.parametrize("step", [1, 3, 8, 12])
@pytest.mark.parametrize("shard", [40, 200, 10**6])
def test_merged_order_is_the_order_of_all_suffixes(monkeypatch, shard, step):
    monkeypatch.setattr(bwt, "SHARD", shard)
    rng = np.random.default_rng(shard)
    for _ in range(12):
        strings = _strings(rng)
        s = bwt.Strings(strings, step)
        shards = bwt.shards_of(s, 24)
        slots, common = bwt.merge(shards, 24 // step)
        order = np.concatenate([x.places for x in shards])[slots]
        suffix = {int(a) + i: t[i:] for a, t in zip(s.at, strings) for i in range(len(t) + 1)}
        assert sorted(order.tolist()) == sorted(p for p, t in suffix.items() if len(t) >= step)
        for a, b, c in zip(order[:-1].tolist(), order[1:].tolist(), common[1:].tolist()):
            x, y = suffix[a], suffix[b]
            cut = lambda t: [t[k : k + step] for k in range(0, 24, step) if len(t) >= k + step]
            same = [p == q for p, q in zip(cut(x), cut(y))]
            assert c == (same.index(False) if False in same else len(same))
            if len(x) >= 24 and len(y) >= 24:
                assert x[:24] <= y[:24]


def test_the_transforms_carry_the_merge():
    """Places come from the shards' transforms alone: with one of them shuffled, the repeated places are others."""
    rng = np.random.default_rng(9)
    strings = [rng.integers(97, 123, 300, dtype=np.uint8).tobytes() for _ in range(6)]
    strings += [strings[0][20:240], strings[3][50:290]]
    s = bwt.Strings(strings, 8)
    half = int(s.at[4])
    right = [bwt.Transform(s, 0, half, 24), bwt.Transform(s, half, s.n, 24)]

    def places(shards):
        slots, common = bwt.merge(shards, 3)
        order, same = np.concatenate([x.places for x in shards])[slots], common == 3
        return set(order[same].tolist()) | set(order[:-1][same[1:]].tolist())

    want = {int(a) + i for a, t in zip(s.at, strings) for i in range(len(t) - 23) if sum(u.count(t[i : i + 24]) for u in strings) > 1}
    assert places(right) == want and want
    by = rng.permutation(len(right[0].places))
    right[0].places, right[0].symbols = right[0].places[by], right[0].symbols[by]
    assert places(right) != want


def test_buckets_of_real_tables_are_merged_from_several_shards():
    """Pieces of repeated minimizers of sf0.01, dealt to buckets as the operator does: most buckets hold more than one shard."""
    import pandas as pd

    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.dropna().unique().tolist()
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    text, start, count, value = suffix_dedup.minimizers(np.frombuffer(b"".join(raw), np.uint8), off)
    _, which, often = np.unique(value, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(often[which] > 1)
    pieces: dict[int, set[bytes]] = {}
    for t, s, c, v in zip(text[keep].tolist(), start[keep].tolist(), count[keep].tolist(), value[keep].tolist()):
        pieces.setdefault(v % 8, set()).add(raw[t][s : s + c + 199])
    shards = [len(bwt.shards_of(bwt.Strings(sorted(own), bwt.STEP), 200)) for own in pieces.values()]
    assert sum(n > 1 for n in shards) > len(shards) / 2 and len(shards) == 8

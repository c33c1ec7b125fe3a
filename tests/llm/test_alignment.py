"""Token alignment and token counts against the libraries and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from ledgerline.llm import alignment, token_counts

A, B, W = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = [" ", "  ", "a ", " a", "a  \n  b", "a\n b", "x ▁ y", "▁", "<s>", "<|endoftext|> <|startoftext|>", "a\x00b", "don't  stop", "ﬁn", " ́ z", "東京 " * 40, "é" * 700, "=" * 900, "İΣ ς", "'T'LL 'd", "x\x0by\x0cz\x85w"]


def plain(texts):
    """Rows by loops over token ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(A)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters, by_doc, out = alignment.byte_letters(), [], []
    for t in texts:
        a = a_model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        want = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b = [], []
        groups, i, j = [], 0, 0
        a_end = b_end = 0
        while i < len(a):
            x, y = [a[i]], [b[j]]
            a_end, b_end, i, j = a_end + len(a_bytes[i]), b_end + len(b_bytes[j]), i + 1, j + 1
            while a_end != b_end:
                if a_end < b_end:
                    x.append(a[i])
                    a_end, i = a_end + len(a_bytes[i]), i + 1
                else:
                    y.append(b[j])
                    b_end, j = b_end + len(b_bytes[j]), j + 1
            groups.append((x, y))
        by_doc.append(Counter((p, q) for x, y in groups for p in x for q in y))
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([len(a), len(b), len(groups), sum(by_doc[-1].values()), hashlib.sha256(text.encode()).hexdigest() if a else ""])
    held = Counter(p for d in by_doc for p in d)
    best = {}
    for (p, _), n in held.items():
        best[p] = max(best.get(p, 0), n)
    return [(*r[:4], sum(m for p, m in d.items() if held[p] == best[p[0]]), sum(m * held[p] for p, m in d.items()), r[4]) for r, d in zip(out, by_doc)]


@pytest.mark.parametrize("most", [1_000_000, 300, 0])
def test_alignment_equals_plain_loops(spark, texts, most):
    rows = texts + ODD + texts[30:34]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(rows)], "doc_id long, text string, pair string, n string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(spark, docs, A, B, lookup_rows=most).collect()}
    assert [got[i] for i in range(len(rows))] == plain(rows)


def test_texts_are_tokenised_once(spark, tmp_path):
    spark.createDataFrame([(1, "one two one"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/own")
    out = alignment.align(spark, spark.read.parquet(f"{tmp_path}/own"), A, B)
    assert not any("/own/" in f for f in out.inputFiles())
    assert [r[1:] for r in sorted(map(tuple, out.collect()))] == plain(["one two one", None])


def test_small_memories_change_nothing(spark, docs, texts, monkeypatch):
    want = plain(texts)
    for name, value in (("CACHE_UNITS", 50), ("CACHE_PAIRS", 300), ("JOINED_BYTES", 400), ("WIDE_GROUP", 1)):
        monkeypatch.setattr(alignment, name, value)
    al = alignment.Aligner(A, B)
    for start in range(0, len(texts), 7):
        if al.crowded():
            al.clear()
        flat, sizes = al.batch(texts[start : start + 7])
        figures = np.array([alignment.by_text(f.all[flat], sizes) for f in al.units.figures]).T.tolist()
        assert figures == [list(r[:4]) for r in want[start : start + 7]]


def test_ranks_and_cuts_of_bitsets():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000):
        ends = np.unique(np.append(rng.integers(1, size + 1, size // 2 + 1), size))
        words = alignment.bitset(ends, size)
        assert alignment.places(words).tolist() == ends.tolist()
        assert alignment.rank(words, np.arange(size + 1)).tolist() == np.searchsorted(ends, np.arange(size + 1), "right").tolist()


def test_wide_groups_count_all_links():
    a, b = np.array([5, 5, 6, 5, 9]), np.array([1, 2, 1, 3])
    group, keys, times = alignment.linked(a, b, np.array([4, 5]), np.array([3, 4]))
    want = Counter((0, x << 32 | y) for x in a[:4].tolist() for y in b[:3].tolist()) + Counter({(1, 9 << 32 | 3): 1})
    for limit in (0, 256):
        alignment.WIDE_GROUP, before = limit, alignment.WIDE_GROUP
        group, keys, times = alignment.linked(a, b, np.array([4, 5]), np.array([3, 4]))
        alignment.WIDE_GROUP = before
        got = Counter()
        for g, k, t in zip(group.tolist(), keys.tolist(), times.tolist()):
            got[g, k] += t
        assert got == want


def test_counts_equal_library(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(W)
    rows = texts + ODD + ["word " * 2048, "word " * 2049, "<|endoftext|>" * 3 + "a<|startoftext|>"] + texts[30:34]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r.doc_id: r for r in token_counts.token_counts(spark, docs, W).collect()}
    for i, t in enumerate(rows):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048), t


def test_shortcut_is_proven_and_used(texts):
    from tokenizers import Tokenizer

    model, proven = Tokenizer.from_file(W), token_counts.whole_tokens(W)
    words = [w for w in proven if w.isascii() and w.isalpha()]
    assert len(words) > 20_000 and all(len(e.ids) == 1 for e in model.encode_batch(words, add_special_tokens=False))
    counter = token_counts.Counter(W, proven)
    for t in texts:
        counter.count(t or "")
    assert counter.shortcut > 5_000 and counter.merged > 0
    bare = token_counts.Counter(W, frozenset())
    assert [bare.count(t or "") for t in texts] == [counter.count(t or "") for t in texts]


@pytest.mark.parametrize("run", [lambda s, d: alignment.align(s, d, A, B), lambda s, d: token_counts.token_counts(s, d, W)])
def test_empty_tables(spark, run):
    assert run(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = run(spark, spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r[1] == 0 and r[2] == 0 for r in got)

import math
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from ledgerline.llm import quality_rules
from test_jaccard import brute as brute_join
from test_suffix import brute as brute_cut
from test_secrets import PATTERNS


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, columns = [docs.toPandas()], docs.columns
    from ledgerline.llm.shared import Workspace

    space = Workspace(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        docs = space.save(stage(spark, docs, sf), name)
        out.append(docs.toPandas())
        if name != "packing":
            assert docs.columns == columns
    return out


def test_every_stage_does_its_work_on_its_predecessor(stages):
    docs, kept, joined, cut, clean, packed = stages
    assert 0 < len(kept) < len(docs) and set(kept.doc_id) < set(docs.doc_id)
    want = {d for d, _, c in brute_join(kept.doc_id.tolist(), kept.text.tolist()) if d == c}
    assert set(joined.doc_id) == want and len(want) < len(kept)
    removed = dict(zip(joined.doc_id, brute_cut(joined.text.tolist(), 200)))
    old, new = joined.set_index("doc_id").text, cut.set_index("doc_id").text
    assert set(old.index) == set(new.index)
    for d in old.index:
        assert (old[d] == new[d]) == (removed[d][1] == 0)
    assert any(r[1] for r in removed.values())
    assert set(clean.doc_id) == set(cut.doc_id)
    assert (clean.n_chars == clean.text.str.len()).all()
    for t in clean.text:
        assert not any(ok(m) for _, p, ok in PATTERNS for m in p.finditer(t))
    assert set(packed.doc_id) == set(clean.doc_id)
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()


def _kept_text(text, texts):
    """What is left of a text by brute force, characters that were cut in part dropped."""
    seen = Counter(r[i : i + 200] for r in (t.encode() for t in texts) for i in range(len(r) - 199))
    raw = text.encode()
    gone = [False] * len(raw)
    for i in range(len(raw) - 199):
        if seen[raw[i : i + 200]] > 1:
            gone[i : i + 200] = [True] * 200
    runs = groupby(range(len(raw)), key=gone.__getitem__)
    return "".join(bytes(raw[i] for i in own).decode("utf-8", "ignore") for g, own in runs if not g)


def test_cut_texts_equal_brute_force(stages):
    _, _, joined, cut, _, _ = stages
    new, texts = cut.set_index("doc_id").text, joined.text.tolist()
    changed = [d for d, t in zip(joined.doc_id, joined.text) if new[d] != t]
    assert changed
    old = joined.set_index("doc_id").text
    seen_once = Counter(texts)
    for d in changed[:12]:
        assert new[d] == ("" if seen_once[old[d]] > 1 else _kept_text(old[d], texts))


def _median(values):
    order = sorted(values)
    return next(v for k, v in enumerate(order, 1) if 2 * k >= len(order))


def test_kept_rows_equal_bands_by_brute_force(spark, sf, stages):
    docs, kept = stages[0], stages[1]
    import public_tokenizers

    rows = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")).toPandas()
    rows = rows.merge(docs[["doc_id", "lang"]], on="doc_id")
    key = lambda r: (r.script, min(int(math.log2(max(r.n_tokens, 1))), quality_rules.LONGEST), r.lang)
    groups = {}
    for r in rows.itertuples():
        if not r.base_failed and r.n_tokens:
            groups.setdefault(key(r), {})[r.n_tokens, r.word_chars, round(r.token_entropy * 1e6), round(r.byte_share, 6)] = r
    for r in rows.itertuples():
        lo, hi, most, least = quality_rules.BANDS[r.script]
        n, p = max(r.n_tokens, 1), r.byte_share
        sure = (p + 8 / n - 4 * math.sqrt(p * (1 - p) / n + 4 / n**2)) / (1 + 16 / n)  # the least share that four standard errors allow
        out = r.n_tokens > 0 and (not lo <= r.chars_per_token <= hi or sure > most or r.token_entropy < min(least, 0.45 * math.log2(r.n_tokens)))
        texts = groups.get(key(r), {})
        if r.n_tokens and texts:
            loose = 1 + 50 / len(texts)
            bins = {n: [min(int(v * 100 + 0.5), 3000) for v in own] for n, own in (("c", [t.chars_per_token for t in texts.values()]), ("e", [k[2] / 1e6 for k in texts]), ("b", [k[3] for k in texts]))}
            m = {n: _median(own) for n, own in bins.items()}
            d = {n: _median([abs(v - m[n]) for v in own]) * 0.014826 for n, own in bins.items()}
            wide = lambda n, share: loose * max(4 * max(d[n], 0.01), share * m[n] / 100)  # noqa: B023, E731
            out |= abs(r.chars_per_token - m["c"] / 100) > wide("c", 0.03) or r.token_entropy < m["e"] / 100 - wide("e", 0.02)
            out |= sure > m["b"] / 100 + loose * max(4 * d["b"], 0.1)
        assert r.kept == (not r.base_failed and not out), r
    assert sorted(kept.doc_id) == sorted(rows[rows.kept].doc_id)


def test_packed_pieces_are_those_of_the_cleaned_texts(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    clean, packed = stages[4], stages[5]
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in zip(clean.doc_id, clean.text)}
    for r in packed.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 4096


def test_run_is_the_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).toPandas()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert got.doc_id.nunique() == stages[-1].doc_id.nunique()
    assert got.groupby("doc_id").length.sum().equals(stages[-1].groupby("doc_id").length.sum()) and set(columns) < set(got.columns)

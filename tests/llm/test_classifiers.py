import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ledgerline.llm import language, pu_quality, queries

SF = "/root/testdata/sf0.01"


def _fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")


def test_language_on_held_out_rows(spark, documents):
    rows = queries.op4_language(spark, SF).toPandas().set_index("doc_id").join(documents[["lang"]])
    assert len(rows) == len(documents) and rows.score.between(0, 1).all()
    assert (rows.held_out == [_fold(i, 3) == 1 for i in rows.index]).all()
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    sure = held[~held.rejected]
    assert len(sure) > 0.5 * len(held) and (sure.lang_pred == sure.lang).mean() > 0.97


def test_language_of_odd_rows(spark):
    text = ["the of and in " * 20, "der die und das " * 20] * 30 + [None, "", "123 !?", "é", "東京", "a"]
    lang = ["en", "de"] * 30 + ["en", None, "de", "en", None, "en"]
    frame = spark.createDataFrame([(i, t, g, "clash") for i, (t, g) in enumerate(zip(text, lang))], "doc_id long, text string, lang string, score string")
    rows = {r.doc_id: r for r in language.identify(spark, frame).collect()}
    assert len(rows) == 66 and all(rows[i].lang_pred == lang[i] for i in range(60))
    assert [(rows[i].lang_pred, rows[i].score) for i in (60, 61, 62)] == [("und", 0.0)] * 3
    assert all(rows[i].lang_pred in ("en", "de") for i in (63, 64, 65))
    bare = language.identify(spark, frame.withColumn("lang", frame.lang.substr(9, 1)).filter("doc_id < 0")).collect()
    assert bare == []
    nothing = language.identify(spark, frame.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def _plain_prediction(model, text):
    """Probabilities by loops: every n-gram's bucket, the mean of the table's rows, softmax."""
    raw = [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    total, seen = [0.0] * len(model.languages), 0
    for order in language.ORDERS:
        for i in range(len(raw) - order + 1):
            code = raw[i]
            for j in range(1, order):
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ raw[i + j]
            code ^= code >> 15
            bucket = (code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BUCKET_BITS)
            total = [t + float(x) for t, x in zip(total, model.table[bucket])]
            seen += 1
    z = [(t / max(seen, 1) + float(b)) / model.temperature for t, b in zip(total, model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_predictions_of_rows_equal_plain_loops(spark, documents):
    own = documents.head(150)
    frame = spark.createDataFrame([(int(i), r.text, r.lang) for i, r in own.iterrows()] + [(900, None, "en"), (901, "12 !", None), (902, "É", "fr"), (903, "Abc", "en")], "doc_id long, text string, lang string")
    model = language.fit(*language.training_rows(frame))
    for r in frame.join(language.identify(spark, frame), "doc_id").collect():
        assert r.held_out == (_fold(r.doc_id, 3) == 1)
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = _plain_prediction(model, r.text)
        best = max(range(len(p)), key=p.__getitem__)
        assert r.lang_pred == model.languages[best] and math.isclose(r.score, p[best], rel_tol=1e-3, abs_tol=1e-5)


def _plain_f(net, x):
    z = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(x, net.mean, net.scale)]
    hidden = [math.tanh(sum(z[i] * net.p[0][i][k] for i in range(len(z))) + net.p[1][k]) for k in range(pu_quality.HIDDEN)]
    return sum(h * w for h, w in zip(hidden, net.p[2])) + net.p[3][0]


def test_scores_and_risk_equal_plain_loops():
    rng = np.random.default_rng(2)
    positive, unlabelled = rng.normal(1, 1, (40, 6)), np.concatenate([rng.normal(1, 1, (30, 6)), rng.normal(-1, 1, (30, 6))])
    net = pu_quality.fit(positive, unlabelled, 0.5)
    for x in unlabelled[:10]:
        assert math.isclose(net.score(x[None])[0], 1 / (1 + math.exp(-(net.slope * _plain_f(net, x) + net.shift))), rel_tol=1e-9)
    sigma = lambda v: 1 / (1 + math.exp(-v))

    def risk(prior, part):
        fp, fu = [_plain_f(net, x) for x in positive], [_plain_f(net, x) for x in unlabelled]
        bracket = sum(map(sigma, fu)) / len(fu) - prior * sum(map(sigma, fp)) / len(fp)
        return -bracket if part == "negative" else prior * sum(sigma(-v) for v in fp) / len(fp) + bracket

    for prior, part in ((0.3, "whole"), (1.6, "negative")):
        got = pu_quality.risk_gradient(net, positive, unlabelled, prior)
        for k, at in ((0, (2, 3)), (1, (4,)), (2, (5,)), (3, (0,))):
            old, ends = net.p[k][at], []
            for move in (1e-5, -1e-5):
                net.p[k][at] = old + move
                ends.append(risk(prior, part))
            net.p[k][at] = old
            assert math.isclose(got[k][at], (ends[0] - ends[1]) / 2e-5, rel_tol=1e-3, abs_tol=1e-7)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_the_class_prior_is_found_from_positives_and_unlabelled_rows(share):
    rng = np.random.default_rng(int(100 * share))
    n = int(3000 * share)
    positive, unlabelled = rng.normal(1.5, 1, (1500, 4)), np.concatenate([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (3000 - n, 4))])
    assert abs(pu_quality.class_prior(positive, rng.permutation(unlabelled)) - share) < 0.08


def test_batched_prediction_equals_single():
    model = language.fit([language.packed_counts(t) for t in (b"the of and in", b"der die und das")] * 20, ["en", "de"] * 20)
    texts = ["the cat", None, "", "und die", "x", "ab", "abc", "of " * 500]
    names, score, _ = model.predict(pa.array(texts))
    for i, t in enumerate(texts):
        one, own, _ = model.predict(pa.array([t], pa.string()))
        assert one == [names[i]] and np.isclose(own[0], score[i])


def test_quality_on_held_out_rows(spark, documents):
    rows = queries.op6_pu_quality(spark, SF).toPandas().set_index("doc_id")
    assert len(rows) == len(documents) and rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    labels = pd.read_parquet(f"{SF}/labels.parquet").drop_duplicates("doc_id").set_index("doc_id")
    held = rows.join(labels, how="inner")
    held = held[held.held_out]
    assert (held.index.map(lambda i: _fold(i, 5)) == 0).all()
    pos, neg = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    auc = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert auc > 0.9, auc
    assert (held.predicted == held.quality).mean() > 0.9


def test_quality_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (4, "word " * 5000, "x"), (4, "word " * 5000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    rows = pu_quality.quality_scores(spark, frame, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert pu_quality.quality_scores(spark, frame.filter("false"), labels).collect() == []


def test_packed_counts_are_those_of_whole_texts(monkeypatch):
    from ledgerline.llm import kernel

    rng = np.random.default_rng(5)
    texts = [b"", b"ab", b"abc", "é日本 text".encode(), bytes(rng.integers(97, 123, 60_000).astype(np.uint8)), b"a" * 200_000]
    plain = [sum((np.bincount(language.buckets(np.frombuffer(t, np.uint8), o), minlength=1 << language.BUCKET_BITS) for o in language.ORDERS if len(t) >= o), np.zeros(1 << language.BUCKET_BITS)) for t in texts]
    for piece in (1 << 21, 1000):
        monkeypatch.setattr(kernel, "BATCH_BYTES", piece)
        for t, want in zip(texts, plain):
            packed = language.packed_counts(t)
            assert len(packed) <= 2 << language.BUCKET_BITS
            assert np.allclose(language.counts(packed), want / max(1, want.sum()), rtol=2e-3, atol=1e-5)

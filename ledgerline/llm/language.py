"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams, put through one linear layer. Both are
trained together by minibatch stochastic gradient descent in numpy on a bounded sample of the training rows.
As the score is linear in the n-grams, embeddings times weights give one small table of logits by bucket,
and predicting a whole text is a sum of looked-up rows. A temperature fitted on rows kept out of training
calibrates the probabilities, and the least score at which they are right as often as asked is the threshold
under which a prediction is marked as rejected.

Only text and language of training rows are learnt from. The bound of the fit, not of the data it is used on: SAMPLE rows,
those of the smallest hash of their id. Tasks read their whole texts and send counts by bucket, at most 2 bytes a bucket and so 32 KB a row,
whatever its text; no text comes to the driver.

Defined results: null text or text without a letter is `und` with score 0; without any training row all
texts are; texts of any length are read whole; repeated rows are predicted one by one, and are one row of the sample;
of languages that are equally likely the first by name is taken; an empty table gives no rows; a null id is never held
out and takes no part in training; only doc_id, text and lang are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K

SAMPLE = 5000
BUCKET_BITS, DIM, ORDERS = 14, 16, (3, 4)
EPOCHS, BATCH, RATE = 6, 32, 0.5
#: The share of right answers that predictions must have to be accepted.
ACCEPTED = 0.99
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram at each place from which it fits."""
    n = len(data) - order + 1
    low = _LOWER[data]
    code = low[:n].copy()
    for j in range(1, order):
        code = code * np.uint32(0x01000193) ^ low[j : j + n]
    code ^= code >> np.uint32(15)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) if n > 0 else np.zeros(0, np.int32)


def packed_counts(text: bytes) -> bytes:
    """n-grams by bucket in 16 bits, scaled down if one has more: all buckets, or the others' numbers and counts where that is shorter."""
    data, size = np.frombuffer(text, np.uint8), 1 << BUCKET_BITS
    out = np.zeros(size, np.int64)
    for at in range(0, len(data), K.BATCH_BYTES):  # in pieces that overlap, so memory doesn't grow with a text
        for order in ORDERS:
            piece = data[at : at + K.BATCH_BYTES + order - 1]
            if len(piece) >= order:
                out += np.bincount(buckets(piece, order), minlength=size)
    if out.max(initial=0) > 65535:
        out = -(-out * 65535 // int(out.max()))
    some = np.flatnonzero(out)
    if 2 * len(some) < size:
        return np.concatenate([some, out[some]]).astype("<u2").tobytes()
    return out.astype("<u2").tobytes()


def counts(packed: bytes) -> np.ndarray:
    """Shares of the buckets."""
    size = 1 << BUCKET_BITS
    own = np.frombuffer(packed, "<u2").astype(np.float32)
    if len(own) < size:
        out = np.zeros(size, np.float32)
        out[own[: len(own) // 2].astype(np.int64)] = own[len(own) // 2 :]
        own = out
    return own / max(1.0, own.sum())


class Model:
    """languages, logits by bucket, bias, temperature and the least accepted score."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, least: float) -> None:
        self.languages, self.table, self.bias, self.temperature, self.least = languages, table, bias, temperature, least

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        data, off = K.buffers(text)
        n = np.diff(off)
        lettered = K.per_doc(_LETTER[data], off) > 0
        for d in np.flatnonzero(~lettered & (n > 0)):
            lettered[d] = any(map(str.isalpha, text[int(d)].as_py()))
        total, seen = np.zeros((len(n), len(self.languages))), np.zeros(len(n))
        for order in ORDERS if self.languages else ():
            own = buckets(data, order)
            fits = np.flatnonzero(n >= order)
            if not len(fits):
                continue
            # sums over each text's places, without those whose n-gram runs into the next text
            begin, end = off[fits], off[fits + 1] - order + 1
            cuts = np.stack([begin, end], 1).ravel()
            for c in range(len(self.languages)):
                column = np.append(self.table[own, c], np.float32(0))
                total[fits, c] += np.add.reduceat(column, np.minimum(cuts, len(own)), dtype=np.float64)[::2]
            seen[fits] += n[fits] - order + 1
        logits = (total / np.maximum(seen, 1)[:, None] + self.bias) / self.temperature
        names, score = ["und"] * len(n), np.zeros(len(n))
        if self.languages:
            e = np.exp(logits - logits.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            top = p.argmax(1)
            score = np.where(lettered, p[np.arange(len(n)), top], 0.0)
            names = [self.languages[t] if ok else "und" for t, ok in zip(top.tolist(), lettered.tolist(), strict=True)]
        return names, score, ~lettered | (score < self.least)


def fit(texts: list[bytes], langs: list[str], seed: int = 11) -> Model:
    """Trained on four fifths of the rows, calibrated on the rest; texts: their packed_counts."""
    languages = sorted(set(langs))
    size = 1 << BUCKET_BITS
    if not languages:
        return Model([], np.zeros((size, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(c) for c in langs])
    order = rng.permutation(len(texts))
    kept, train = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(scale=0.1, size=(size, DIM)).astype(np.float32)
    weight = np.zeros((DIM, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    # a text's mean is over thousands of n-grams, so the embeddings' gradient is scaled up by their usual number
    boost, steps, step = np.float32(size / 64), max(1, EPOCHS * math.ceil(len(train) / BATCH)), 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            own = train[at : at + BATCH]
            x = np.stack([counts(texts[i]) for i in own])
            hidden = x @ embed
            z = hidden @ weight + bias
            e = np.exp(z - z.max(1, keepdims=True))
            g = e / e.sum(1, keepdims=True)
            g[np.arange(len(own)), target[own]] -= 1
            g = (g / len(own)).astype(np.float32)
            rate = np.float32(RATE * (1 - step / steps))
            back = g @ weight.T
            weight -= rate * 8 * (hidden.T @ g)
            bias -= rate * g.sum(0)
            embed -= rate * boost * (x.T @ back)
            step += 1
    table = (embed @ weight).astype(np.float32)
    check = kept if len(kept) >= 20 else order
    z = np.stack([counts(texts[i]) @ table for i in check]) + bias
    y = target[check]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    temperature = min(np.geomspace(0.02, 5, 60), key=loss)
    s = z / temperature
    e = np.exp(s - s.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    sure, right = p.max(1), p.argmax(1) == y
    by = np.argsort(-sure)
    share = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
    good = np.flatnonzero(share >= ACCEPTED)
    return Model(languages, table, bias, float(temperature), float(sure[by[good[-1]]]) if len(good) else 1.0)


def fold(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def training_rows(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """packed_counts and languages of the sample: its keys are chosen first, and only the chosen texts are counted, where they are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    keyed = rows.withColumns({"order": F.xxhash64("doc_id"), "h": F.xxhash64("text")})
    key = ["order", "doc_id", "h", "lang"]
    # rows that repeat one another are one of the sample; SAMPLE keys are a bounded table
    chosen = keyed.select(*key).distinct().orderBy(*key).limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            packed = [packed_counts(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), pa.array(packed, pa.binary())], names=[*key, "packed"])

    found = keyed.join(F.broadcast(chosen), key, "left_semi").select(*key, "text").mapInArrow(K.tidy(run), "order long, doc_id long, h long, lang string, packed binary")
    own = found.groupBy(*key).agg(F.first("packed").alias("packed")).orderBy(*key).select("packed", "lang").toArrow()
    return own.column("packed").to_pylist(), own.column("lang").to_pylist()


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per input row; the model, of a fixed size, is sent to the tasks."""
    sent = spark.sparkContext.broadcast(fit(*training_rows(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            names, score, rejected = sent.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(K.tidy(run), SCHEMA)

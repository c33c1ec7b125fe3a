"""Quality classifier by positive-unlabelled learning.

Texts become figures of style: shares of marks and character classes, repeated words, windows and lines, word
lengths. A small network is trained by gradient descent on the non-negative unbiased risk
pi R+(f) + max(0, Ru-(f) - pi R+-(f)), with trusted positives (label 1) and unlabelled texts of the corpus;
when the bracket falls under zero its gradient is turned round.

The class prior pi is estimated from the two samples alone. A logistic model tells positives from unlabelled texts; over
the scores of rows that it wasn't fitted on, pi is at most the share of unlabelled rows above a threshold over that of
positives there, for every threshold, and the least of these bounds, with a margin for their sampling error, is taken.

Scores are calibrated on the same samples: positives have label 1, unlabelled rows the probability that the curve itself
gives them, in rounds, with the curve shifted so that their mean is pi. Rows with label 0 are never looked at.

Only rows of the training folds are learnt from; labels, lang, source and ids are no inputs. Bounds of the
fit, not of the data it is used on: SAMPLE positives and SAMPLE unlabelled, those of the smallest hash of their id.

Defined results: null text is empty text, which has a score as any other; without positives all scores are
the prior 0.5; rows with the same id share their label, the lowest of several, and one of them, of the least text hash, is
in the sample; texts are read whole; repeated rows are scored one by one; an empty table gives no rows; a null id is never
held out and takes no part in training; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .language import fold

SAMPLE = 4000
HIDDEN, STEPS, BATCH, RATE = 24, 1500, 256, 0.01
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASSES = np.zeros((256, 5), bool)
_CLASSES[65:91, 0] = True
_CLASSES[48:58, 1] = True
_CLASSES[0x80:, 2] = True
_CLASSES[[0x20, 9, 11, 12, 13], 3] = True
_CLASSES[10, 4] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def figures(text: pa.Array) -> np.ndarray:
    """One row of figures of style per text."""
    data, off = K.buffers(text)
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    bytes_of = np.bincount(doc * 256 + data, minlength=256 * len(n)).reshape(len(n), 256)
    some = np.maximum(n, 1)[:, None]
    marks = np.sqrt(bytes_of[:, _MARKS] / some)
    classes = np.sqrt(bytes_of @ _CLASSES / some)
    starts, ends, before = K.spans(data, off)
    words = np.diff(before)
    some_words = np.maximum(words, 1)
    hashes = K.hash_spans(data, starts, ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    first = before[:-1][words > 0]
    same[first] = False
    lengths = ends - starts
    per = lambda x, at=before: K.per_doc(x, at)
    mean = per(lengths) / some_words
    spread = np.sqrt(np.maximum(per(lengths * lengths) / some_words - mean * mean, 0))
    seen_before = K.repeated(hashes, before)[1]
    windows, at = K.shingles(hashes, before, 3)
    again = K.repeated(windows, at)[1]
    lo, hi, lines = K.spans(data, off, _LINE)
    repeated_lines = K.repeated(K.hash_spans(data, lo, hi), lines)[1]
    n_lines = np.maximum(np.diff(lines), 1)
    rest = [
        np.sqrt(per(same) / some_words), per(seen_before) / some_words, np.sqrt(per(again, at) / np.maximum(np.diff(at), 1)), mean / 10, spread / 10,
        np.log1p(words) / 10, np.sqrt(K.per_doc(repeated_lines, lines) / n_lines), np.log1p(n_lines) / 10, np.log1p(n / n_lines) / 10, words == 0,
    ]
    return np.column_stack([marks, classes, *rest])


class Network:
    """f(x) = tanh((x - mean) / scale . w1 + b1) . w2 + b2, and the curve that makes it a probability."""

    def __init__(self, width: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = [rng.normal(scale=1 / np.sqrt(width), size=(width, HIDDEN)), np.zeros(HIDDEN), rng.normal(scale=1 / np.sqrt(HIDDEN), size=HIDDEN), np.zeros(1)]
        self.slope, self.shift = 1.0, 0.0

    def inner(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.p[0] + self.p[1])
        return z, h, h @ self.p[2] + self.p[3][0]

    def gradient(self, x: np.ndarray, of_f: np.ndarray) -> list[np.ndarray]:
        z, h, _ = self.inner(x)
        back = (of_f[:, None] * self.p[2]) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ of_f, np.array([of_f.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.inner(x)[2] + self.shift, -40, 40)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], 1e-3)
    ridge[-1] = 1e-9
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-12)[:, None]).T @ x + np.diag(ridge), x.T @ (w * (p - y)) + ridge * beta)
        beta = beta - np.clip(step, -3, 3)
    return beta


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, margin: float = 1.0) -> float:
    """The share of positives among unlabelled rows, from out-of-fold scores of a model that tells the two samples apart."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    scores: tuple[list, list] = ([], [])
    for fold_ in (0, 1):
        x = np.concatenate([p[fold_::2], u[fold_::2]])
        y = np.concatenate([np.ones(len(p[fold_::2])), np.zeros(len(u[fold_::2]))])
        w = np.concatenate([np.full(len(p[fold_::2]), 1 / len(p[fold_::2])), np.full(len(u[fold_::2]), 1 / len(u[fold_::2]))])
        beta = _logistic(x, y, w)
        for out, own in zip(scores, (p, u), strict=True):
            out.append(np.column_stack([own[1 - fold_ :: 2], np.ones(len(own[1 - fold_ :: 2]))]) @ beta)
    sp, su = np.sort(np.concatenate(scores[0])), np.sort(np.concatenate(scores[1]))
    at = np.quantile(sp, np.linspace(0.0, 0.9, 91))
    above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    error = np.sqrt(above_u * (1 - above_u) / len(su)) + above_u / above_p * np.sqrt(above_p * (1 - above_p) / len(sp))
    return float(np.clip(((above_u + margin * error) / above_p).min(), 0.05, 0.95))


def _calibrated(f: np.ndarray, labelled: int, prior: float) -> tuple[float, float]:
    """(slope, shift) of the curve over f, whose first `labelled` rows are positives and the others unlabelled."""
    centre, scale = f.mean(), f.std() + 1e-9
    z, n = (f - centre) / scale, len(f) - labelled
    a, b = 2.0, 0.0
    for _ in range(40):
        lo, hi = -60.0, 60.0
        for _ in range(50):  # the shift at which unlabelled rows have the prior as their mean
            b = (lo + hi) / 2
            lo, hi = (b, hi) if _sigmoid(a * z[labelled:] + b).mean() < prior else (lo, b)
        y = np.concatenate([np.ones(labelled), _sigmoid(a * z[labelled:] + b)])
        w = np.concatenate([np.full(labelled, prior / labelled), np.full(n, 1 / n)])
        beta = _logistic(z[:, None], y, w, 8)
        a = float(np.clip(beta[0], 0.5, 8.0))
    return a / scale, b - a * centre / scale


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 3) -> Network:
    width = max(x.shape[1] for x in (positive, unlabelled))
    net = Network(width, seed)
    if not len(positive) or not len(unlabelled):
        net.slope = 0.0
        return net
    prior = class_prior(positive, unlabelled) if prior is None else prior
    rng = np.random.default_rng(seed)
    net.mean, net.scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    first, second = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for step in range(1, STEPS + 1):
        x, u = positive[rng.integers(len(positive), size=BATCH)], unlabelled[rng.integers(len(unlabelled), size=2 * BATCH)]
        for i, g in enumerate(risk_gradient(net, x, u, prior)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            net.p[i] = net.p[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.slope, net.shift = _calibrated(np.concatenate([net.inner(positive)[2], net.inner(unlabelled)[2]]), len(positive), prior)
    return net


def risk_gradient(net: Network, x: np.ndarray, u: np.ndarray, prior: float) -> list[np.ndarray]:
    """Of the non-negative risk with the sigmoid loss l(f, y) = sigmoid(-y f); where the bracket is negative, the way that raises it."""
    lp, lu = _sigmoid(net.inner(x)[2]), _sigmoid(net.inner(u)[2])
    dp, du = lp * (1 - lp), lu * (1 - lu)
    if lu.mean() - prior * lp.mean() >= 0:
        of_p, of_u = -2 * prior * dp, du
    else:
        of_p, of_u = prior * dp, -du
    return [a + b for a, b in zip(net.gradient(x, of_p / len(x)), net.gradient(u, of_u / len(u)), strict=True)]


def _figures(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(figures, part) of a bounded set of rows: part, h, text; of rows with the same id the one of the least text hash."""
    width = len(_MARKS) + 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            x = figures(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))], names=["part", "x"])

    own = docs.mapInArrow(K.tidy(run), "part int, x array<double>").toArrow()
    x = own.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width) if own.num_rows else np.zeros((0, width))
    return x, np.asarray(own.column("part"), int) if own.num_rows else np.zeros(0, int)


def train(docs: DataFrame, labels: DataFrame) -> Network:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(fold("doc_id", 5) != 0)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter((fold("doc_id", 5) != 0) & F.col("quality").isin(0, 1))
    positive = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    by = [F.xxhash64("doc_id"), "doc_id"]
    # at most 2 * SAMPLE ids
    chosen = [own.select("doc_id").orderBy(*by).limit(SAMPLE).withColumn("part", F.lit(part)) for part, own in enumerate((positive, rows.select("doc_id").distinct()))]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    # one row of each id, told by its hash, before any text moves
    hashed = rows.withColumn("h", F.xxhash64("text"))
    one = hashed.join(chosen, "doc_id").groupBy("part", "doc_id").agg(F.min("h").alias("h"))
    texts = hashed.join(F.broadcast(one), ["doc_id", "h"]).groupBy("part", "doc_id").agg(F.first("text").alias("text"))
    x, part = _figures(texts.select("part", "text"))
    order = np.lexsort((*x.T[::-1], part))
    x, part = x[order], part[order]
    mixed = np.random.default_rng(5).permutation(len(x))  # rows by figures would make the folds of the prior alike
    x, part = x[mixed], part[mixed]
    return fit(x[part == 0], x[part == 1])


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per input row; the network, of a fixed size, is sent to the tasks."""
    sent = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            score = sent.value.score(figures(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(K.tidy(run), SCHEMA)

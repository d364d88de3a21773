"""Bradley-Terry quality scores from preference pairs.

Every pair of a good and a bad labelled document is a preference: the good one should win. The strength of a
document is linear in its features, so the chance that a beats b is the logistic function of w.(x_a - x_b), and
w minimises the logistic loss over pairs plus a small ridge, by Newton's method. Labels say nothing about
a zero of the scale, so it is set by quantile: the cut is the strength below which as large a share of
the training documents lies as is labelled bad. A score maps strength to 0..1 with the cut at ``at``.

Features are measured on the whole text: sizes, shares of character classes and of some marks, word, pair and line repetition,
word and line lengths, capital and long words, each also as hinges above its training quantiles, so that the linear model
can bend. Neither ids, labels, language nor source enter them.

Training is bounded: at most ``max_train`` labelled documents (those with the smallest hash of their id) and
``pairs`` preference pairs, both documented parameters; scoring covers every document.

Null and empty texts score as texts with no characters. Repeated label rows of a document vote by mean (a tie
is good); of labelled documents that share an id, the one with the smallest features trains, so no row order matters.
Without both labels in training every score is ``at``. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumafold.llm.common import crc_mod5

_LETTERS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8))
#: Byte classes: lower case, upper case, digits, bytes of other scripts, white space, sentence marks, symbols, other marks.
_CLASS = np.full(256, 7)
_CLASS[_LETTERS] = 0
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 2
_CLASS[128:] = 3
_CLASS[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = 4
_CLASS[np.frombuffer(b".,;:'\"()-", np.uint8)] = 5
_CLASS[np.frombuffer(b"#*$%&|<>@{}[]=/\\~^_+", np.uint8)] = 6
_ONE_HOT = np.eye(8)[_CLASS]
KNOTS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def measures(text: bytes | None) -> list[float]:
    """The raw features of one text."""
    text = text or b""
    n = max(len(text), 1)
    classes = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _ONE_HOT
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = max(classes[0] + classes[1] + classes[3], 1)
    return [
        np.log1p(len(words)), np.log1p(len(text)), *(classes / n), classes[1] / letters, text.count(b"!") / m, text.count(b"?") / m,
        text.count(b"|") / m, len(counts) / m, (len(counts) / m) * np.log1p(m), top / m, 1 - pairs / max(m - 1, 1) if m > 1 else 0.0, 1 - len(set(lines)) / k,
        (n - classes[4]) / m, len(lines) / m, sum(map(bytes.isupper, words)) / m, sum(len(w) > 20 for w in counts) / m, max(map(len, lines), default=0) / n,
    ]


@dataclass(frozen=True)
class Model:
    """Weights over standardised features and hinges, and the cut of the strength scale."""

    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cut: float
    at: float

    def expand(self, raw: np.ndarray) -> np.ndarray:
        z = (raw - self.mean) / self.scale
        return np.hstack([z, *(np.maximum(z - k, 0) for k in self.knots)])

    def score(self, raw: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(raw), self.at)
        strength = np.clip(self.expand(raw) @ self.weights - self.cut, -30, 30)
        return 1 / (1 + np.exp(-(strength + np.log(self.at / (1 - self.at)))))


def fit(raw: np.ndarray, good: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, at: float = 0.3, seed: int = 5) -> Model:
    """Bradley-Terry weights from labelled documents."""
    mean = raw.mean(axis=0) if len(raw) else np.zeros(raw.shape[1])
    scale = raw.std(axis=0) + 1e-6 if len(raw) else np.ones(raw.shape[1])
    z = (raw - mean) / scale
    knots = np.unique(np.quantile(z, KNOTS, axis=0), axis=0) if len(raw) else np.zeros((1, raw.shape[1]))
    model = Model(mean, scale, knots, np.zeros(raw.shape[1] * (1 + len(knots))), 0.0, at)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(winners) or not len(losers):
        return model
    rng = np.random.default_rng(seed)
    x = model.expand(raw)
    a = rng.choice(winners, pairs)
    b = losers[np.arange(pairs) % len(losers)]
    weights = np.zeros(x.shape[1])
    for _ in range(25):
        gradient, hessian = ridge * weights, np.eye(x.shape[1]) * ridge
        for at_row in range(0, pairs, 8192):
            d = x[a[at_row : at_row + 8192]] - x[b[at_row : at_row + 8192]]
            p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
            gradient = gradient - d.T @ p / pairs
            hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hessian, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    strength = x @ weights
    # The cut: midway between the two training strengths around the quantile of the bad share.
    ranked = np.sort(strength)
    k = len(losers)
    cut = float((ranked[k - 1] + ranked[min(k, len(ranked) - 1)]) / 2)
    return Model(mean, scale, knots, weights, cut, at)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_train`` labelled documents outside the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").where(crc_mod5() != 0).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [measures(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.list_(pa.float64()))], ["doc_id", "good", "x"])

    # At most max_train ids of 8 bytes, so the broadcast has a fixed bound.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "good", "text")
    # Of rows that share an id, the one with the smallest features: a row for each id, so at most max_train.
    rows = chosen.mapInArrow(measure, "doc_id long, good boolean, x array<double>").groupBy("doc_id").agg(F.first("good").alias("good"), F.min("x").alias("x")).toArrow()
    width = len(measures(b""))
    raw = rows["x"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, width) if rows.num_rows else np.zeros((0, width))
    good = rows["good"].to_numpy(zero_copy_only=False).astype(bool) if rows.num_rows else np.zeros(0, bool)
    order = np.lexsort((*raw.T, good)) if len(raw) else np.zeros(0, int)  # whatever order the rows came in
    return raw[order], good[order]


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array([measures(t) for t in batch.column(2).cast(pa.binary()).to_pylist()])
            s = model.score(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod5() == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, threshold: float = 0.3, **how) -> DataFrame:
    """Learn from ``labels`` and score all of ``docs``."""
    return score_documents(docs, fit(*training_rows(docs, labels, max_train), at=threshold, **how), threshold)

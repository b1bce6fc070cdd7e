"""Quality scores from preference pairs (Bradley-Terry), thresholded by a score quantile.

A text is described by shares: capitals, digits, symbols, repeated lines and words, word lengths and so on,
and by the shares of its words in 256 hashed buckets. Every pair of a preferred (label 1) and a rejected (label 0) document counts; the
probability that the first is preferred is the sigmoid of the difference of the two scores, and a score is
linear in the features, so logistic loss on feature differences fits it. The decision threshold is the
quantile of the training scores that leaves the share of label 0 below it; ``score`` is the sigmoid of the
distance from that threshold.

Labels come from a sample of at most about ``sample_rows`` labelled documents. Empty and null texts are
described by zeros. Without documents of both labels every score is the share of label 1. Repeated rows
each get a row; null labels are not learned from, copies of a text count once. The sample is sorted by a hash of
its ids, so two trainings on equal tables give equal models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .common import texts
from .toxicity import labelled_sample

KINDS = 10
KIND = np.full(256, 9, np.int64)  # other control characters
for _b in range(256):
    _c = chr(_b)
    KIND[_b] = 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c == " " else 4 if _c == "\n" else 5 if _c in ".,;:'\"-()?" else 6 if _c in "!" else 7 if 0x21 <= _b < 0x7F else 8 if _b >= 0x80 else 9
SURFACE, TERM_BITS = KINDS + 8, 8
FEATURES = SURFACE + (1 << TERM_BITS)


def _distinct(own: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each document."""
    order = np.lexsort((hashes, own))
    o, h = own[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[new], minlength=n)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    n, sizes = len(at) - 1, np.diff(at)
    own = np.repeat(np.arange(n), sizes)
    shares = np.bincount(own * KINDS + KIND[data], minlength=n * KINDS).reshape(n, KINDS) / np.maximum(sizes, 1)[:, None]
    start, end, hashes, counts = W.words(data, at)
    word_own, lengths = np.repeat(np.arange(n), counts), end - start
    many = np.maximum(counts, 1)
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begins = np.flatnonzero(first[:-1] | np.concatenate([[False], data[:-1] == 10])[: len(data)])
    stops = np.append(begins[1:], len(data))
    line_own = np.searchsorted(at, begins, "right") - 1
    lines = np.bincount(line_own, minlength=n)
    distinct_lines = _distinct(line_own, W.stretch_hash(W.prefix_hash(W.BYTE[data]), begins, stops), n) if len(begins) else np.zeros(n)
    mean = np.bincount(word_own, lengths, n) / many
    extra = [
        mean / 10,
        np.sqrt(np.maximum(np.bincount(word_own, lengths**2.0, n) / many - mean**2, 0)) / 10,
        _distinct(word_own, hashes, n) / many if len(hashes) else np.zeros(n),
        distinct_lines / np.maximum(lines, 1),
        np.log1p(lines) / 10,
        np.log1p(counts) / 10,
        counts / np.maximum(sizes, 1),
        np.bincount(word_own, lengths > 20, n) / many,
    ]
    bucket = (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    terms = np.bincount(word_own << TERM_BITS | bucket, minlength=n << TERM_BITS).reshape(n, -1) / many[:, None]
    return np.concatenate([np.log1p(100 * shares), np.stack(extra, 1), np.sqrt(terms)], 1)


def expand(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features, and the squares of those of the surface."""
    z = np.clip((x - mean) / spread, -8, 8)
    return np.concatenate([z, z[:, :SURFACE] ** 2], 1)


@dataclass
class QualityModel:
    """Linear score of standardised features, its threshold and scale."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.mean, self.spread) @ self.weights


def pair_sums(good: np.ndarray, bad: np.ndarray, weights: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the mean logistic loss of every pair of a row of ``good`` and one of ``bad``.

    A pair's probability is a / (a + b) of the two rows' strengths exp(score), so a block of ``good`` meets all of ``bad`` without
    their differences being made, and memory is ``block`` times the rows of ``bad``. The Hessian's product of both sides, which only
    directs a step, is made in single precision.
    """
    a, b = good @ weights, bad @ weights
    middle = (a.mean() + b.mean()) / 2
    a, b = np.exp(np.clip(a - middle, -300, 300)), np.exp(np.clip(b - middle, -300, 300))
    missed, curve = np.zeros(len(b)), np.zeros(len(b))
    grad, hessian = np.zeros(good.shape[1]), np.zeros((good.shape[1],) * 2)
    single = bad.astype(np.float32)
    for lo in range(0, len(a), block):
        z, own = good[lo : lo + block], a[lo : lo + block, None]
        p = own / (own + b)
        q = 1 - p
        missed += q.sum(0)
        grad -= z.T @ q.sum(1)
        p *= q
        curve += p.sum(0)
        cross = z.T @ (p.astype(np.float32) @ single)
        hessian += (z * p.sum(1)[:, None]).T @ z - cross - cross.T
    n = len(a) * len(b)
    return (grad + bad.T @ missed) / n, (hessian + (bad * curve[:, None]).T @ bad) / n


def fit_pairs(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> QualityModel:
    """Newton steps on the logistic loss of all pairs of a preferred and a rejected row, until they stand still."""
    model = QualityModel(x.mean(0) if len(x) else np.zeros(FEATURES), x.std(0) + 1e-6 if len(x) else np.ones(FEATURES), np.zeros(FEATURES + SURFACE))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        share = float((y == 1).mean()) if len(y) else 0.5
        model.threshold = -float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return model
    z = expand(x, model.mean, model.spread)
    pairs = z[good], z[bad]
    grad, hessian = pair_sums(*pairs, model.weights)
    step = np.linalg.solve(hessian + l2 * np.eye(z.shape[1]), grad)
    while np.abs(step).max() >= 1e-6:
        weights = model.weights - step
        new, hessian = pair_sums(*pairs, weights)
        new += l2 * weights
        if np.linalg.norm(new) > np.linalg.norm(grad):  # too far
            step = step / 2
            continue
        model.weights, grad = weights, new
        step = np.linalg.solve(hessian + l2 * np.eye(z.shape[1]), grad)
    scores = np.sort(z @ model.weights)
    k = len(bad)  # this many of the lowest scores lie below the threshold
    model.threshold = float((scores[k - 1] + scores[min(k, len(scores) - 1)]) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 16_000) -> QualityModel:
    """Fit on a bounded sample of ``labels`` (doc_id, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in texts(batch, "text"):
                x = features(data, at)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32())), *(batch.column(k).slice(lo, hi - lo) for k in (1, 2))], names=["x", "y", "key"])

    rows = labelled_sample(docs, labels, label, sample_rows).mapInArrow(run, "x array<float>, y int, key long").toArrow().sort_by("key")
    x = rows.column("x").combine_chunks()
    return fit_pairs(np.asarray(x.flatten()).astype(np.float64).reshape(-1, FEATURES), rows.column("y").to_numpy())


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; 0.5 is the quantile threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in texts(batch, text_col):
                raw = model.raw(features(data, at)) - model.threshold
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], names=[id_col, "score"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")

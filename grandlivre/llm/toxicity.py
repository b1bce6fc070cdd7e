"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w_t + sum over pairs of <v_t, v_u>) over the distinct terms t of a text. The
pair terms learn what a sum of weights cannot: a harmless word that is an insult next to another.

Terms are words (see ``words.py``) hashed to 2**18 buckets. Labels come from a sample of at most about
``sample_rows`` labelled documents, a documented bound; the sample's ids are thereby small enough to
broadcast. Buckets are counted over the whole sample by an aggregation, and those in at least ``LEAST_DOCS``
texts are all learned from, weights and pair vectors together, under a penalty that makes noise exactly zero
(``sparse_fit``). Terms tell alone or only beside others; those that keep a weight or a pair vector are fitted
again without the penalty, which would hold their weights small. Every whole text is scored.

Null, empty and wordless texts get the score of no terms. Without any labelled document of both kinds all
scores are the share of label 1 (0 if there is none). Repeated rows each get a row. Null labels and null ids are
not learned from; copies of a text count once, with the greatest of their labels. The sample is sorted by a hash
of its ids before it is learned from, so two trainings on equal tables give equal models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import hash_sample, int_lists, materialize, small_batches, texts

BITS = 18
#: Buckets in fewer texts of the sample cannot be learned from.
LEAST_DOCS = 3
#: Penalties of ``sparse_fit`` on weights and pair vectors, times the root of the number of texts.
L1, L1_PAIRS = 0.4, 0.1
#: A pair vector this long differs from what noise leaves of its random start.
LEAST_NORM = 0.17


def buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word."""
    _, _, hashes, counts = W.words(data, at)
    return np.repeat(np.arange(len(counts)), counts), (hashes >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class FactorizationMachine:
    """Weights of the chosen buckets: ``slot`` maps a bucket to its row of ``w`` and ``v``, or -1."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def terms(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, slot) of the texts."""
        own, bucket = buckets(data, at)
        slot = self.slot[bucket]
        keep = slot >= 0
        pairs = np.unique(own[keep] * len(self.w) + slot[keep]) if len(self.w) else np.zeros(0, np.int64)
        return pairs // max(len(self.w), 1), pairs % max(len(self.w), 1)

    def raw(self, own: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """Scores before the sigmoid of ``n`` documents."""
        out = self.w0 + np.bincount(own, self.w[slot], n)
        for f in range(self.v.shape[1]):
            x = self.v[slot, f]
            out += (np.bincount(own, x, n) ** 2 - np.bincount(own, x * x, n)) / 2
        return out

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, l2: float, positive: float = 1.0, seed: int = 7) -> None:
        """AdaGrad on logistic loss over batches of documents; ``positive`` weighs those with label 1."""
        rng = np.random.RandomState(seed)
        k, factors = self.v.shape
        seen = [np.full(1, 1e-3), np.full(k, 1e-3), np.full((k, factors), 1e-3)]
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), 256):
                pick = order[lo : lo + 256]
                own = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
                slot = np.concatenate([rows[i] for i in pick]).astype(np.int64)
                n = len(pick)
                sums = np.stack([np.bincount(own, self.v[slot, f], n) for f in range(factors)], 1)
                miss = (1 / (1 + np.exp(-np.clip(self.raw(own, slot, n), -30, 30))) - y[pick]) * np.where(y[pick] == 1, positive, 1.0)
                g = miss[own]
                grad_w = np.bincount(slot, g, k) / n + l2 * self.w
                spread = g[:, None] * (sums[own] - self.v[slot])
                grad_v = np.stack([np.bincount(slot, spread[:, f], k) for f in range(factors)], 1) / n + l2 * self.v
                for value, grad, s in ((self.w, grad_w, seen[1]), (self.v, grad_v, seen[2])):
                    s += grad**2
                    value -= rate * grad / np.sqrt(s)
                seen[0] += miss.mean() ** 2
                self.w0 -= rate * miss.mean() / float(np.sqrt(seen[0][0]))


def sparse_fit(rows: list[np.ndarray], y: np.ndarray, k: int, factors: int, epochs: int, rate: float, positive: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair vectors of all ``k`` terms by FTRL-proximal under L1 penalties that add up over the visits."""
    rng, total, beta = np.random.RandomState(seed), len(rows), 8.0
    share, size = y.mean(), max(16, min(256, len(rows) // 32))
    w0, seen0 = float(np.log(share / (1 - share))), 65.0
    w, v = np.zeros(k, np.float32), rng.normal(0, 0.02, (k, factors)).astype(np.float32)
    state = [(np.zeros_like(w), np.zeros_like(w), w, L1 * total**0.5), (-v * np.float32(beta / rate), np.zeros_like(v), v, L1_PAIRS * total**0.5)]
    every, visits = np.bincount(np.concatenate(rows), minlength=k), np.zeros(k, np.float32)
    order, parts = rng.permutation(total), []
    for lo in range(0, total, size):
        pick = order[lo : lo + size]
        slot = np.concatenate([rows[i] for i in pick])
        parts.append((pick, np.array([len(rows[i]) for i in pick]), slot, np.argsort(slot, kind="stable").astype(np.int32)))
    for _ in range(epochs):
        for part in rng.permutation(len(parts)):
            pick, counts, slot, by_slot = parts[part]
            n, some, at = len(pick), counts > 0, (np.cumsum(counts) - counts)[counts > 0]
            if not len(at):
                continue
            x, sums, raw = v[slot], np.zeros((n, factors), np.float32), np.full(n, w0)
            sums[some] = np.add.reduceat(x, at)
            raw[some] += np.add.reduceat(w[slot], at) + ((sums[some] ** 2).sum(1) - np.add.reduceat((x * x).sum(1), at)) / 2
            miss = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) * np.where(y[pick] == 1, positive, 1.0)).astype(np.float32)
            own, ordered = np.repeat(np.arange(n), counts)[by_slot], slot[by_slot]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            u, g = ordered[first], miss[own]
            visits[u] += np.diff(np.append(first, len(ordered))) / every[u]
            for (z, squares, value, penalty), grad in zip(state, (np.add.reduceat(g, first), np.add.reduceat(g[:, None] * (sums[own] - x[by_slot]), first)), strict=True):
                limit = penalty * visits[u].reshape(-1, *[1] * (value.ndim - 1))
                more = squares[u] + grad**2
                moved = z[u] + grad - (np.sqrt(more) - np.sqrt(squares[u])) / rate * value[u]
                z[u], squares[u] = moved, more
                value[u] = -np.sign(moved) * np.maximum(np.abs(moved) - limit, 0) * rate / (beta + np.sqrt(more))
            seen0 += float(miss.sum()) ** 2
            w0 -= rate * float(miss.sum()) / seen0**0.5
    return w, v


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(text, y, key) of at most about ``sample_rows`` labelled documents, copies of a text only once, under their greatest label.

    ``key`` is a hash of the ids to sort by. The sample of ids has that bound, so it is broadcast and the documents are filtered where they are read.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = hash_sample(known, "doc_id", sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("text").agg(F.max("y").cast("int").alias("y"), F.min(F.xxhash64(F.col("doc_id").cast("string"))).alias("key"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 16_000, factors: int = 8, epochs: int = 30, rate: float = 0.1, l2: float = 1e-5, positive: float = 2.0) -> FactorizationMachine:
    """Fit on a bounded sample of ``labels`` (doc_id, label)."""
    small_batches(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, label, sample_rows), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in texts(batch, "text"):
                own, bucket = buckets(data, at)
                pairs = np.unique(own << BITS | bucket)
                bucket = pairs & ((1 << BITS) - 1)
                n = np.bincount(bucket, minlength=1 << BITS)
                some = np.flatnonzero(n)
                head = [[-1], [hi - lo], [int(y[lo:hi].sum())]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h, x[some] if k else some]).astype(np.int64)) for k, (h, x) in enumerate(zip(head, (some, n, np.zeros_like(n)), strict=True))], names=["bucket", "n", "p"])

    counts = sample.mapInArrow(count, "bucket long, n long, p long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    table = np.array([tuple(r) for r in counts.collect()], np.int64).reshape(-1, 3)  # one row for each bucket at most
    head = table[table[:, 0] < 0]
    total, n_positive = (int(head[0, 1]), int(head[0, 2])) if len(head) else (0, 0)
    table = table[(table[:, 0] >= 0) & (table[:, 1] >= LEAST_DOCS)]
    slot = np.full(1 << BITS, -1, np.int32)
    if not 0 < n_positive < total:
        share = n_positive / total if total else 0.0
        return FactorizationMachine(slot, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0), np.zeros((0, factors)))
    best = np.sort(table[:, 0])
    slot[best] = np.arange(len(best))
    rng = np.random.RandomState(11)
    model = FactorizationMachine(slot, float(np.log(n_positive / (total - n_positive))), np.zeros(len(best)), np.zeros((0, factors)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in texts(batch, "text"):
                own, found = model.terms(data, at)
                yield pa.RecordBatch.from_arrays([int_lists(found, np.bincount(own, minlength=hi - lo), pa.int32()), *(batch.column(k).slice(lo, hi - lo) for k in (1, 2))], names=["slots", "y", "key"])

    rows = sample.mapInArrow(encode, "slots array<int>, y int, key long").toArrow().sort_by("key")
    lists, y = rows.column("slots").combine_chunks(), rows.column("y").to_numpy().astype(float)
    slots = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets.to_numpy()[0])
    w, v = sparse_fit(slots, y, len(best), factors, max(1, epochs // 3), rate, positive)
    kept = np.flatnonzero((w != 0) | (np.sqrt((v**2).sum(1)) > LEAST_NORM))
    again = np.full(len(best), -1, np.int32)
    again[kept] = np.arange(len(kept))
    slot[best] = again
    model.w, model.v = np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), factors))
    model.fit([x[x >= 0] for x in (again[i] for i in slots)], y, epochs, rate, l2, positive)
    return model


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in texts(batch, text_col):
                raw = model.raw(*model.terms(data, at), hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], names=[id_col, "score"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")

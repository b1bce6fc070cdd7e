"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed to 2**15 buckets. A feature is the bucket's share
of the text's n-grams times its inverse document frequency, which is counted by an aggregation over all
documents that may be learned from, and over no others. Weights are trained by follow-the-regularised-leader with elastic-net penalties (per
coordinate rates, L1 giving exact zeros) on at most about ``sample_rows`` documents with a known language; a quarter
of the sample is kept back to choose the temperature that calibrates the probabilities. The sample is sorted by a hash
of its rows before it is learned from, so two trainings on equal tables give equal models.

Null texts and texts without a letter are ``und`` with score 0. If no document has a language, so are all.
Empty texts have no letter. Repeated rows each get a row. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hash_sample, utf8

BITS, ORDERS = 15, (1, 2, 3)
SCALE = 10.0
_LOWER = np.array([ord(low) if len(low := chr(c).lower()) == 1 and not 0xD800 <= c < 0xE000 else c for c in range(1 << 16)], np.uint32)


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: buckets of all n-grams, and the first and end n-gram of each text."""
    raw = data.tobytes()
    parts = [raw[lo:hi].decode("utf-8", "replace") for lo, hi in zip(at[:-1], at[1:], strict=True)]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < (1 << 16), _LOWER[np.minimum(code, (1 << 16) - 1)], code).astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            h = np.full(max(len(code) - n + 1, 0), np.uint64(n))
            for k in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ code[k : k + len(h)]
            bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
            yield bucket, edges[:-1].clip(max=len(h)), np.maximum(edges[:-1], edges[1:] - n + 1).clip(max=len(h))


def sparse(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, share) of the distinct buckets of each text."""
    keys = []
    for bucket, lo, hi in grams(data, at):
        own = np.repeat(np.arange(len(lo)), hi - lo)
        place = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(own))
        keys.append(own << BITS | bucket[place])
    pairs, n = np.unique(np.concatenate(keys), return_counts=True)
    own = pairs >> BITS
    return own, pairs & ((1 << BITS) - 1), n / np.bincount(own, n, len(at) - 1)[own]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each bucket occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            data, at = utf8(batch.column(0))
            for lo, hi in chunks(at):
                found = list(grams(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
                for d in range(hi - lo):
                    seen = np.zeros(1 << BITS, bool)
                    for bucket, first, end in found:
                        seen[bucket[first[d] : end[d]]] = True
                    total += seen
                n += hi - lo
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["bucket", "n"])

    rows = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << BITS)
    for bucket, n in rows:
        if bucket >= 0:
            counts[bucket] = n
    return counts, next((n for bucket, n in rows if bucket < 0), 0)


@dataclass
class LanguageModel:
    """Weights by bucket and class (inverse document frequencies included), biases and temperature."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, count = np.zeros((len(at) - 1, len(self.classes))), np.zeros(len(at) - 1)
        for bucket, lo, hi in grams(data, at):
            count += hi - lo
            for c in range(len(self.classes)):
                total = np.concatenate([[0.0], np.cumsum(self.weights[c][bucket], dtype=np.float64)])
                out[:, c] += total[hi] - total[lo]
        return out / np.maximum(count, 1)[:, None] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x buckets) and biases by FTRL-proximal, one document at a time."""
    size = (1 << BITS) + 1  # the last feature is the bias
    z, n = np.zeros((classes, size)), np.zeros((classes, size))
    weigh = lambda z, n: -(z - np.sign(z) * np.minimum(np.abs(z), l1)) / ((beta + np.sqrt(n)) / alpha + l2)
    rng = np.random.RandomState(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], size - 1), np.append(rows[i][1], 1.0)
            zi, ni = z[:, at], n[:, at]
            w = weigh(zi, ni)
            g = (softmax(w @ x) - (np.arange(classes) == y[i]))[:, None] * x
            more = ni + g * g
            z[:, at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[:, at] = more
    w = weigh(z, n)
    return w[:, :-1], w[:, -1]


def train(docs: DataFrame, sample_rows: int = 4000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1) -> LanguageModel | None:
    """Fit on ``docs`` (doc_id, text, lang) with idf over all of them; None if no document has a language and a text."""
    sample = hash_sample(docs.where("lang is not null and text is not null"), "doc_id", sample_rows).select("text", "lang", F.xxhash64(F.col("doc_id").cast("string"), "text", "lang").alias("key"))
    counts, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + counts)) + 0.1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(0))
            for lo, hi in chunks(at):
                own, bucket, share = sparse(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                edges = pa.array(np.searchsorted(own, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(v)) for v in (bucket.astype(np.int32), share.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*lists, *(batch.column(k).slice(lo, hi - lo) for k in (1, 2))], names=["at", "x", "lang", "key"])

    rows = sample.mapInArrow(run, "at array<int>, x array<float>, lang string, key long").toArrow().sort_by("key")  # bounded by sample_rows
    langs = rows.column("lang").to_pylist()
    classes = sorted(set(langs))
    if not classes:
        return None
    y = np.array([classes.index(x) for x in langs])
    x = [(a.values.to_numpy(), SCALE * b.values.to_numpy() * idf[a.values.to_numpy()]) for a, b in zip(rows.column("at"), rows.column("x"), strict=True)]
    fit = [i for i in range(len(x)) if i % 4] or list(range(len(x)))
    weights, bias = ftrl([x[i] for i in fit], y[fit], len(classes), epochs, alpha, beta, l1, l2)
    rest = [i for i in range(len(x)) if i % 4 == 0]
    logits = np.array([weights[:, x[i][0]] @ x[i][1] + bias for i in rest])
    grid = np.exp(np.linspace(np.log(0.002), np.log(50), 121))
    # labels are taken to be wrong once in the sample, or texts that separate wholly would drive the temperature to 0
    wrong = 1 / (len(rest) + len(classes))
    aim = np.where(np.arange(len(classes)) == y[rest][:, None], 1 - wrong, wrong / max(len(classes) - 1, 1))
    loss = [-(aim * np.log(softmax(logits / t) + 1e-300)).sum(1).mean() for t in grid]
    return LanguageModel(classes, (SCALE * weights * idf).astype(np.float32), bias, float(grid[int(np.argmin(loss))]))


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language of every whole text and its calibrated probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in chunks(at):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                known = np.array([bool(model) and t is not None and any(map(str.isalpha, t)) for t in texts], bool)
                pred, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                if known.any():
                    p = softmax(model.logits(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) / model.temperature)
                    best = p.argmax(1)
                    pred = [model.classes[b] if k else "und" for b, k in zip(best, known, strict=True)]
                    score = np.where(known, p[np.arange(hi - lo), best], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")

"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of word 5-grams (``words.py``; a shorter text with words is one gram). Two texts are linked if
the Jaccard similarity of their sets is at least ``threshold``.

1. Documents with the same set form a class, found by a 128-bit sum over the set in an aggregation that
   combines before the shuffle; its smallest id represents it from here on. Copies thus never meet.
2. Representatives that share a MinHash band (``BANDS`` bands of ``ROWS`` values; a pair at similarity 0.8 misses
   all with probability 6e-6) meet under the band's smallest one, its hub; bands of the same hub are one group. So
   a group holds only what shares a band with its hub, and chains of vague likeness do not grow together. Its
   members are dealt into blocks of bounded size, and each pair of blocks is one group of rows, so that no band,
   however large, lies in one task. A pair that has several hubs in common counts under the smallest one.
3. In a group MinHash values are compared a few at a time. With a uniform prior, m matches of n give the
   similarity a beta posterior; pairs whose probability to reach the threshold is below ``TOLERANCE`` are
   dropped at once. The pairs left are verified exactly on their gram sets. A group returns, for each
   document, its number of links and one edge towards the root of its linked neighbourhood: never pairs.
4. Components of those edges give each document the smallest id it is linked to, directly or not.

Texts without words (null, empty) have no set and are linked to nothing. Ids are integers. Repeated rows of one id
and text are one document and each get its row. Texts that share an id each get a row with their own set's
class; where such an id is the smallest one of several sets, these count as one in links. Grams are
compared by 64-bit hashes. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import int_lists, materialize, small_batches, texts, thin
from .components import connected_components

N, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP = 40, 6, 24
TOLERANCE = 1e-5
BLOCK = 2000
_random = np.random.RandomState(99)
_A = _random.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32)


def gram_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of each document, end to end, and their numbers."""
    _, _, hashes, counts = W.words(data, at)
    grams, many = W.shingles(hashes, counts, n)
    own = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((grams, own))
    own, grams = own[order], grams[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.bincount(own[new], minlength=len(many))


def signatures(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values of each set; all ones for an empty set."""
    out = np.full((len(counts), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        x = (grams >> np.uint64(32)).astype(np.uint32) ^ (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                h = x * _A[k]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                h += _B[k]
                out[some, k] = np.minimum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row; the band's number is part of it."""
    values = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), values.shape[:2]).copy()
    for r in range(ROWS):
        key = W.mix(key + values[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
    return key


@functools.lru_cache(64)
def least_matches(n: int, threshold: float) -> int:
    """The least number of matches of ``n`` for which the posterior keeps a pair.

    With a uniform prior P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= TOLERANCE:
            return m
    return n


def surviving_pairs(left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` and ``right`` that the incremental comparison keeps; of one block only i < j."""
    out_i, out_j = [], []
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        matches = np.zeros((len(rows), len(right)), np.uint8)
        for k in range(STEP):
            matches += rows[:, k, None] == right[None, :, k]
        i, j = np.nonzero(matches >= least_matches(STEP, threshold))
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 18):
            a, b = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
            m = matches[a - lo, b].astype(np.int16)
            for k in range(STEP, BANDS * ROWS, STEP):
                m = m + (left[a, k : k + STEP] == right[b, k : k + STEP]).sum(1, dtype=np.int16)
                keep = m >= least_matches(k + STEP, threshold)
                a, b, m = a[keep], b[keep], m[keep]
            out_i.append(a)
            out_j.append(b)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def verify(i: np.ndarray, j: np.ndarray, grams_i: np.ndarray, counts_i: np.ndarray, grams_j: np.ndarray, counts_j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold exactly: the sets' overlap is counted gram by gram."""
    if not len(i):
        return np.zeros(0, bool)
    vocabulary, ids = np.unique(np.concatenate([grams_i, grams_j]), return_inverse=True)
    ids_i, ids_j = ids[: len(grams_i)], ids[len(grams_i) :]
    at_i, at_j = np.concatenate([[0], np.cumsum(counts_i)]), np.concatenate([[0], np.cumsum(counts_j)])
    flag = np.zeros(len(vocabulary), np.int32)
    both = np.zeros(len(i), np.int64)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1], [True]]))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        pairs = order[lo:hi]
        own = ids_i[at_i[i[pairs[0]]] : at_i[i[pairs[0]] + 1]]
        flag[own] = 1
        others = j[pairs]
        sizes = counts_j[others]
        starts = np.cumsum(sizes) - sizes
        take = np.repeat(at_j[others] - starts, sizes) + np.arange(int(sizes.sum()))
        both[pairs] = np.add.reduceat(flag[ids_j[take]], starts)
        flag[own] = 0
    union = counts_i[i] + counts_j[j] - both
    return both >= threshold * union - 1e-9


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is linked to, directly or not."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc, grams, sum_a, sum_b, keys): the size of each document's set, its 128-bit sum and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in texts(batch, "text"):
                grams, counts = gram_sets(data, at, n)
                keys = band_keys(signatures(grams, counts)).view(np.int64)
                a, b = set_sums(grams, counts)
                lists = int_lists(keys.ravel(), np.full(hi - lo, BANDS), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array(a), pa.array(b), lists], names=["doc", "grams", "sum_a", "sum_b", "keys"])

    return docs.mapInArrow(run, "doc long, grams long, sum_a long, sum_b long, keys array<long>")


def set_sums(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, which tell sets apart."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (grams, W.mix(grams ^ np.uint64(0x5851F42D4C957F2D)))]
        a, b = ((s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums)
    return a, b


def earlier_hub(i: np.ndarray, j: np.ndarray, hubs: list[np.ndarray], hub: int) -> np.ndarray:
    """Whether a pair has a hub in common that is smaller than ``hub``."""
    many = np.array([len(h) for h in hubs])
    wide = np.full((len(hubs), max(1, int(many.max(initial=0)))), np.iinfo(np.int64).max)
    for row, h in enumerate(hubs):
        wide[row, : len(h)] = h
    out = np.zeros(len(i), bool)
    for k in range(wide.shape[1]):
        some = np.flatnonzero((wide[i, k] < hub) & ~out)
        for part in range(0, len(some), 1 << 16):
            at = some[part : part + (1 << 16)]
            out[at] = (wide[j[at]] == wide[i[at], k][:, None]).any(1)
    return out


def _links(members: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc, links, root) from each pair of blocks: ``members`` (doc, sum_a, sum_b, groups array<struct<component, block, blocks>>)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in texts(batch, "text"):
                grams, counts = gram_sets(data, at, n)
                # of the texts under an id only the one whose set it represents
                own = np.all([x == batch.column(k).slice(lo, hi - lo).to_numpy() for x, k in zip(set_sums(grams, counts), ("sum_a", "sum_b"), strict=True)], axis=0)
                flat = pa.array([row.tobytes() for row in signatures(grams, counts)], pa.binary())
                columns = [batch.column("doc"), batch.column("groups"), batch.column("sum_a"), batch.column("sum_b")]
                out = [*(c.slice(lo, hi - lo) for c in columns), int_lists(grams.view(np.int64), counts, pa.int64()), flat]
                yield pa.RecordBatch.from_arrays(out, names=["doc", "groups", "sum_a", "sum_b", "grams", "signature"]).filter(pa.array(own))

    some = thin(docs, "doc", members).join(members, "doc")
    loaded = some.mapInArrow(load, "doc long, groups array<struct<component:long,block:int,blocks:int>>, sum_a long, sum_b long, grams array<long>, signature binary")
    # a block meets every block of its group, itself included; pairs are named smaller block first
    meets = loaded.select("*", F.expr("transform(groups, x -> x.component)").alias("hubs"), F.inline("groups")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("doc", "sum_a", "sum_b", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "hubs", "grams", "signature")

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([table.column(k).to_numpy() for k in ("doc", "sum_a", "sum_b")])
        table = table.take(pa.array(np.sort(np.unique(key, axis=1, return_index=True)[1])))  # a repeated row is one document
        doc, i, j, block = (table.column(k).to_numpy() for k in ("doc", "i", "j", "block"))
        lists = table.column("grams").combine_chunks()
        at = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        grams, counts = lists.flatten().to_numpy().view(np.uint64), np.diff(at)
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(doc), BANDS * ROWS)
        same = i[0] == j[0]
        a, b = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        x, y = surviving_pairs(sig[a], sig[b], same, threshold)
        part = lambda rows: np.concatenate([np.zeros(0, np.uint64), *(grams[at[r] : at[r + 1]] for r in rows)])
        ok = verify(x, y, part(a), counts[a], part(b), counts[b], threshold)
        x, y = a[x[ok]], b[y[ok]]
        x, y = x[doc[x] != doc[y]], y[doc[x] != doc[y]]
        counted = ~earlier_hub(x, y, [np.asarray(h) for h in table.column("hubs").combine_chunks().to_numpy(zero_copy_only=False)], table.column("component")[0].as_py())
        degree = np.bincount(x[counted], minlength=len(doc)) + np.bincount(y[counted], minlength=len(doc))
        order = np.argsort(doc, kind="stable")
        back = np.empty(len(doc), np.int64)
        back[order] = np.arange(len(doc))
        root = doc[order][roots(len(doc), back[x], back[y])][back]
        some = np.flatnonzero((degree > 0) | (root != doc))
        yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(degree[some].astype(np.int64)), pa.array(root[some])], names=["doc", "links", "root"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def take(table: pa.Table, last: bool):
            keys = np.stack([table.column(k).to_numpy() for k in ("component", "i", "j")], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == len(keys) and not last:
                    return table.slice(lo).to_batches()
                if hi - lo > 1:
                    out.extend(compare(table.slice(lo, hi - lo)))
            return []

        for batch in batches:
            out: list[pa.RecordBatch] = []
            held.append(batch)
            first, end = (tuple(b.column(k)[r].as_py() for k in ("component", "i", "j")) for b, r in ((held[0], 0), (batch, batch.num_rows - 1)))
            if first != end:
                held = take(pa.Table.from_batches(held), False)
            yield from out
        if held:
            out = []
            take(pa.Table.from_batches(held), True)
            yield from out

    dealt = meets.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(groups, "doc long, links long, root long")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(id, rep_id, n_links, class_id) of every document; one without an id has no links and no class.

    ``rep_id`` is the smallest id with the same set of grams, ``n_links`` the number of other sets that are
    similar enough, ``class_id`` the smallest id that the document is linked to, directly or through others.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    signed = materialize(_classes(base, n), "signed")
    reps = materialize(
        signed.where("grams > 0").groupBy("sum_a", "sum_b", "grams").agg(F.min("doc").alias("rep"), F.min_by("keys", "doc").alias("keys")), "reps"
    )
    bands = reps.select("rep", F.explode("keys").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    near = materialize(bands.join(hubs, "key").select(F.col("rep").alias("doc"), F.col("hub").alias("component")).distinct(), "near")
    # written, so that the join has plain shuffles on both sides and Spark splits the tasks of a large group
    sizes = materialize(near.groupBy("component").agg(F.count("*").alias("n")).select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "sizes")
    placed = near.join(sizes, "component").select("doc", F.struct("component", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), "blocks").alias("group"))
    members = placed.groupBy("doc").agg(F.array_sort(F.collect_list("group")).alias("groups")).join(reps.select(F.col("rep").alias("doc"), "sum_a", "sum_b"), "doc").select("doc", "sum_a", "sum_b", "groups")
    members = materialize(members, "members")
    links = materialize(_links(members, base, n, threshold), "links")
    classes = connected_components(links.select(F.col("doc").alias("u"), F.col("root").alias("v")))
    degrees = links.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("n_links"))
    about = reps.select("sum_a", "sum_b", "grams", "rep").join(degrees, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    out = signed.select("doc", "sum_a", "sum_b", "grams").join(about, ["sum_a", "sum_b", "grams"], "left")
    named = out.select(F.col("doc").alias(id_col), F.coalesce("rep", "doc").alias("rep_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "rep", "doc").alias("class_id"))
    none = F.lit(None).cast("long")
    return named.union(docs.where(F.col(id_col).isNull()).select(none, none, F.lit(0).cast("long"), none))

"""Exact top-k inner products by pivot-table elimination.

Vectors x get one more coordinate sqrt(M*M - |x|^2), where M is the greatest length, and queries a 0; then the
largest inner product is the smallest distance: q.x = (|q|^2 + M^2 - d^2) / 2. A pivot table holds every
vector's distance to many pivots. By the triangle inequality the greatest difference between the query's and a
candidate's distances to a pivot bounds their distance from below, and so their inner product from above.
Candidates are evaluated in the order of that bound, and evaluation stops when the next bound is below the
k-th best product: no other candidate can enter, ties included.

Vectors are dealt by their nearest pivot (a cell), and a cell into blocks of bounded size; queries by groups of
neighbouring cells, no more groups than they fill, since every vector goes to each group that may want it. A cell's least
and greatest distance to each pivot bound the products of all its vectors. A query's k-th best product within the
sample, which is a part of the vectors, is a floor for its k-th best of all; pairs of a query cell and a vector cell
of which no query can reach its floor never meet. Each other pair of a query block and a vector block is
a task's group that returns k rows for a query at most, and a window takes the best of all blocks. The pivots
are chosen farthest-first from at most ``sample_rows`` vectors; every vector is in the table.

Vectors that are null or hold a null or non-finite component take no part; a shorter vector counts as ended
with zeros. Repeated rows are candidates of their own, but one query; query rows of one id with different
vectors are ranked together, under that id; a query's own id is none of its candidates. Fewer
candidates than k give fewer rows; an empty table gives none. Products are exact while they are below 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, materialize

PIVOTS, BLOCK, QUERIES = 48, 8192, 2048
#: Relative error that distances in float32 may have; bounds are widened by it.
SLACK = 1e-5


def quantize(embedding: Column) -> Column:
    """floor(64 * component) of every component, as doubles."""
    return F.transform(embedding, lambda x: F.floor(64 * x.cast("double")).cast("double"))


def usable(embedding: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(odd, F.lit(True))


def matrix(column: pa.ChunkedArray | pa.Array, wide: int) -> np.ndarray:
    """Lists as rows of ``wide`` numbers, ended with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(-1, wide)
    out = np.zeros((len(sizes), wide))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def choose_pivots(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first from the longest vector."""
    if not len(vectors):
        return vectors
    picked = [int((vectors**2).sum(1).argmax())]
    away = ((vectors - vectors[picked[0]]) ** 2).sum(1)
    while len(picked) < min(pivots, len(vectors)) and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, ((vectors - vectors[picked[-1]]) ** 2).sum(1))
    return vectors[picked]


def cell_ranges(table: DataFrame, pivots: int) -> np.ndarray:
    """Least and greatest distance (2 x cells x pivots) of the vectors of each cell to each pivot; empty cells are out of reach."""

    def run(batches):
        low, high = np.full((pivots, pivots), np.inf), np.full((pivots, pivots), -np.inf)
        for batch in batches:
            d, cell = matrix(batch.column(0), pivots), batch.column(1).to_numpy()
            np.minimum.at(low, cell, d)
            np.maximum.at(high, cell, d)
        at, p = np.nonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(p), pa.array(low[at, p]), pa.array(high[at, p])], names=["cell", "pivot", "low", "high"])

    found = table.select("d", "cell").mapInArrow(run, "cell long, pivot long, low double, high double").groupBy("cell", "pivot").agg(F.min("low"), F.max("high"))
    out = np.stack([np.full((pivots, pivots), np.inf), np.full((pivots, pivots), -np.inf)])
    for cell, pivot, low, high in found.collect():  # at most a row for each pair of pivots
        out[:, cell, pivot] = low, high
    return out


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, longest: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, product) of each query's best k among the vectors, evaluated in bound order."""
    lengths = (queries**2).sum(1)
    query_pivots = np.sqrt(np.maximum(lengths[:, None] + longest**2 - 2 * queries @ pivots[:, :-1].T, 0)).astype(np.float32)
    table = np.ascontiguousarray(to_pivots.T.astype(np.float32))
    out_q, out_i, out_s = [], [], []
    widest = SLACK * (longest + np.sqrt(lengths.max(initial=0)) + 1)
    for q in range(len(queries)):
        bound = np.zeros(len(ids), np.float32)
        for p in range(len(table)):
            np.maximum(bound, np.abs(table[p] - query_pivots[q, p]), out=bound)
        best_s, best_i, at, step = np.zeros(0), np.zeros(0, np.int64), 0, max(256, 4 * k)  # steps double as the bound decides less
        order = np.argpartition(bound, min(step, len(bound) - 1))[:step] if len(bound) > step else np.arange(len(bound))
        order = order[np.argsort(bound[order], kind="stable")]
        whole = len(order) == len(bound)
        while at < len(order):
            if len(best_s) == k:
                reach = max(float(bound[order[at]]) - widest, 0.0)
                if (lengths[q] + longest**2 - reach**2) / 2 < best_s[-1] - 0.5:
                    break
            part = order[at : at + step]
            part = part[ids[part] != query_ids[q]]
            s = vectors[part] @ queries[q]
            if len(best_s) == k:  # only those that can enter are merged
                enter = s >= best_s[-1]
                s, part = s[enter], part[enter]
            s, i = np.concatenate([best_s, s]), np.concatenate([best_i, ids[part]])
            keep = np.lexsort((i, -s))[:k]
            best_s, best_i = s[keep], i[keep]
            at += step
            step *= 2
            if at >= len(order) and not whole:
                # those beyond the first step, if their bounds can still matter
                reach = np.sqrt(max(lengths[q] + longest**2 - 2 * (best_s[-1] - 0.5), 0)) + widest if len(best_s) == k else np.inf
                seen = np.zeros(len(bound), bool)
                seen[order] = True
                more = np.flatnonzero(~seen & (bound <= reach))
                order, at, whole = more[np.argsort(bound[more], kind="stable")], 0, True
        out_q.append(np.full(len(best_i), query_ids[q]))
        out_i.append(best_i)
        out_s.append(best_s)
    return np.concatenate([np.zeros(0, np.int64), *out_q]), np.concatenate([np.zeros(0, np.int64), *out_i]), np.concatenate([np.zeros(0), *out_s])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 2000) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest inner products of each query over all vectors.

    Both tables have the id and an array of doubles; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).distinct()
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, longest, wide = rows.agg(F.count("*"), F.coalesce(F.sqrt(F.max(square)), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_asked, wide_asked = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    wide = max(wide, wide_asked, 1)
    drawn = hash_sample(rows, "id", sample_rows).select("id", "v").toArrow()  # bounded by sample_rows
    sample, sample_ids = matrix(drawn.column("v"), wide), drawn.column("id").to_numpy()
    extended = lambda x: np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))[:, None]], 1)
    pivots = choose_pivots(extended(sample), PIVOTS)

    def distances(x: np.ndarray) -> np.ndarray:
        x = extended(x)
        return np.sqrt(np.maximum(((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T), 0)).astype(np.float32)

    # groups of cells that lie beside each other along the pivots' main direction
    groups = max(1, min(len(pivots), -(-n_asked // QUERIES)))
    spread = pivots - pivots.mean(0) if len(pivots) else pivots
    line = spread @ np.linalg.svd(spread, full_matrices=False)[2][0] if len(pivots) else np.zeros(0)
    group = (np.argsort(np.argsort(line, kind="stable"), kind="stable") * groups // max(len(pivots), 1)).astype(np.int32)

    def measure(batches):
        for batch in batches:
            d = distances(matrix(batch.column(1), wide))
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(d) + 1) * d.shape[1]).astype(np.int32)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(d.argmin(1).astype(np.int32))], names=["id", "v", "d", "cell"])

    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    table = materialize(rows.mapInArrow(measure, "id long, v array<double>, d array<float>, cell int"), "pivots")
    ranges = cell_ranges(table, len(pivots))
    sizes = [0] * len(pivots)
    for cell, count in table.groupBy("cell").count().collect():  # a row for each pivot at most
        sizes[cell] = count

    def place(batches):
        """Each query's cell, and the cells it can still gain from."""
        for batch in batches:
            v, own = matrix(batch.column(1), wide), batch.column(0).to_numpy()
            d, lengths = np.sqrt(np.maximum((v**2).sum(1)[:, None] + longest**2 - 2 * v @ pivots[:, :-1].T, 0)), (v**2).sum(1)
            known = np.where(own[:, None] == sample_ids, -np.inf, v @ sample.T)
            floor = np.sort(known, 1)[:, -k] if known.shape[1] >= k else np.full(len(v), -np.inf)
            near = np.maximum(np.maximum(d[:, None] - ranges[1], ranges[0] - d[:, None]).max(2, initial=0), 0)  # to the nearest place of a cell
            near = np.maximum(near - SLACK * (longest + np.sqrt(lengths)[:, None] + 1), 0)
            open_ = (lengths[:, None] + longest**2 - near**2) / 2 >= floor[:, None] - 0.5
            rows_, cells = np.nonzero(open_)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(open_.sum(1))]).astype(np.int32)), pa.array(cells.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group[d.argmin(1)]), lists], names=["id", "v", "qc", "cells"])

    placed = materialize(asked.mapInArrow(place, "id long, v array<double>, qc int, cells array<int>"), "queries")
    many = {c: max(1, -(-q // QUERIES)) for c, q in placed.groupBy("qc").count().collect()}  # a row for each group
    blocks = [max(1, -(-s // BLOCK)) for s in sizes]
    # pairs of a query group and a cell in which some query can still gain; both sides go only there
    pairs = [(q, c) for q, c in placed.select("qc", F.explode("cells").alias("cell")).distinct().collect() if sizes[c]]
    with_queries = [sorted(q for q, other in pairs if other == c) for c in range(len(pivots))]
    lookup = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    number = lambda count: F.pmod(F.xxhash64("id"), count).cast("int")
    to = F.element_at(F.array(*(F.array(*map(F.lit, w)).cast("array<int>") for w in with_queries)), F.col("cell") + 1)
    query_blocks = F.coalesce(lookup([many.get(g, 1) for g in range(groups)], F.col("qc")), F.lit(1))
    held = table.select("id", "v", "d", "cell", number(lookup(blocks, F.col("cell"))).alias("vb"), F.explode(to).alias("qc")).withColumn("qb", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    put = placed.select("id", "v", "qc", number(query_blocks).alias("qb"), F.explode("cells").alias("cell")).withColumn("vb", F.explode(F.sequence(F.lit(0), lookup(blocks, F.col("cell")) - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        d = matrix(left.column("d"), len(pivots))
        q, i, s = search_block(matrix(right.column("v"), wide), right.column("id").to_numpy(), matrix(left.column("v"), wide), left.column("id").to_numpy(), d, pivots, longest, k)
        return pa.table([q, i, s.astype(np.int64)], schema=schema)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    part = held.groupBy("qc", "qb", "cell", "vb").cogroup(put.groupBy("qc", "qb", "cell", "vb")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

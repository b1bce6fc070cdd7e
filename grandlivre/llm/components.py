"""Connected components of an edge table, with DataFrame operations only.

Rounds of two steps: every node links its larger neighbours to its smallest one (large star), then its
smaller neighbours and itself to the smallest one (small star). Both keep the components; the number of
rounds grows with the logarithm of the longest path. Each round is written to the shared folder, so the
plan stays short and a lost executor costs one round. A node's neighbours are only ever reduced to a
minimum, by an aggregation that combines before the shuffle and a join that Spark may split where a hub
makes it skewed; they are never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written, so that the join has plain shuffles on both sides and Spark splits the tasks of a hub
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    moved = pairs.join(least, "u")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component is named by its smallest node.

    Edges with a null end and loops say nothing and are left out, and a node that only they name has no row;
    an empty edge table gives no rows. Nodes are of any type that can be ordered.
    """
    now = materialize(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    # an order-free fingerprint and the number of rows tell when a round changes nothing
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(now)
    for _ in range(most_rounds if before[0] else 0):
        now = materialize(_star(_star(now, True), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()

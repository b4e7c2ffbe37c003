"""Connected components of an edge table: the union-find of a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

MAX_ROUNDS = 50


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): root is the least node that edges lead to.

    Large and small stars in turn: each node hooks its greater, then its smaller neighbours to the least one
    that it sees, so trees flatten in a logarithmic number of rounds.  Every round is a written table.  Loops
    and repeated edges change nothing; no edge gives no row.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    # A node beside its least neighbour; the sum of hashes tells when nothing moves any more.
    mark = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: greater neighbours go to the least
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        before, edges = edges, written(small, "edges")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError(f"components not closed after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of an edge table, by alternating stars; no group or component is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, rows, stored


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each task keeps a spanning forest of its own edges."""
    def task(batches):
        up: dict[int, int] = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x
        for a, b in rows(batches):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
        for x in list(up):
            if root(x) != x:
                yield x, root(x)
    return arrow_map(edges.select("a", "b"), task, "a bigint, b bigint", batch_rows=16384)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node it is connected with.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour. Rounds are
    few (the logarithm of the longest path); every round is written, which ends its lineage.
    """
    now = stored(forest(edges).distinct())
    state = None
    while True:
        # after both steps every edge points from a node to a smaller one
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                               F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        now = stored(small)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)

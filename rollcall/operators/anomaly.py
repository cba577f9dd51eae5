"""Isolation forest over record features.

Trees are grown from small hash samples, one task group per tree; the forest's size depends only on its
parameters, so it is sent to the executors, and every record is scored where it lies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ensure_checkpoint_dir
from ..functions.ordered import narrow_quantile

EULER = 0.5772156649
NODES = "tree int, node int, feature int, threshold double, child int, length double"


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def tree_samples(df: DataFrame, key: str, rows: int, trees: int, sample: int) -> DataFrame:
    """Up to ``sample`` rows per tree, drawn by hash: the same rows in every run and partitioning.

    Each row gets as many hashed draws as the table's size calls for (one for large tables, of which only
    the needed share survives), so the volume shuffled is that of the samples, not of the table.
    """
    want = 1.5 * trees * sample
    draws = max(1, math.ceil(want / rows))
    share = min(1.0, want / (rows * draws))
    slots = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(draws)))) if draws > 1 else df.withColumn("_i", F.lit(1))
    h = F.xxhash64(F.col(key), F.col("_i"))
    slots = slots.withColumns({"_u": F.pmod(h, F.lit(1 << 40)) / float(1 << 40), "tree": F.pmod(F.xxhash64(h), F.lit(trees)).cast("int")})
    slots = slots.where(F.col("_u") < share).dropDuplicates(["tree", key])
    first = Window.partitionBy("tree").orderBy("_u", key)  # about 1.5 samples per tree
    return slots.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= sample).drop("_i", "_u")


def _grower(features: list[str], sample: int):
    limit = max(1, math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_rn")[features].to_numpy(dtype=float)
        rng = np.random.default_rng(tree)
        out, todo, made = [], [(0, np.arange(len(x)), 0)], 1
        while todo:
            node, rows, depth = todo.pop()
            useful = np.array([], dtype=int)
            if depth < limit and len(rows) > 1:
                lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
                useful = np.flatnonzero(hi > lo)
            if len(useful) == 0:
                out.append((tree, node, -1, 0.0, node, depth + mean_path(len(rows))))
                continue
            f = int(rng.choice(useful))
            cut = float(rng.uniform(lo[f], hi[f]))
            left = x[rows, f] <= cut
            out.append((tree, node, f, cut, made, 0.0))
            todo += [(made, rows[left], depth + 1), (made + 1, rows[~left], depth + 1)]
            made += 2
        return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "child", "length"])
    return grow, limit


def isolation_forest(df: DataFrame, key: str, features: list[str], trees: int = 300, sample: int = 256,
                     contamination: float = 0.02) -> DataFrame:
    """Anomaly score and flag per record key: the top ``contamination`` share of scores is flagged."""
    ensure_checkpoint_dir(df.sparkSession)
    x = df.select(key, *_numbers(features)).checkpoint()  # read for the count, the samples and the scores
    return flag_highest(forest_scores(x, key, features, trees, sample).select(key, "anomaly_score").checkpoint(), contamination)


def _numbers(features: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]


def flag_highest(scored: DataFrame, contamination: float = 0.02) -> DataFrame:
    """``iforest_flag`` for the top share of ``anomaly_score``. ``scored`` should be stored."""
    top = narrow_quantile(scored, "anomaly_score", 1 - contamination)
    return scored.withColumn("iforest_flag", F.col("anomaly_score") > top)


def forest_scores(df: DataFrame, key: str, features: list[str], trees: int = 300, sample: int = 256, rows: int | None = None) -> DataFrame:
    """``df``, which should be stored, with ``anomaly_score``: read once for the samples and once for the scores. ``rows`` is its count, if known."""
    spark = df.sparkSession
    x = df.select(key, *_numbers(features))
    n = x.count() if rows is None else rows
    grow, depth = _grower(features, sample)
    picked = tree_samples(x, key, n, trees, sample)
    # at most 2 x sample nodes per tree, whatever the size of the table
    nodes = picked.groupBy("tree").applyInPandas(grow, NODES).toPandas()
    ids = {t: i for i, t in enumerate(sorted(nodes["tree"].unique()))}
    t, k = nodes["tree"].map(ids).to_numpy(), nodes["node"].to_numpy()
    shape = (len(ids), int(k.max()) + 1)
    # index arrays of numpy's own index type, or each look-up converts them first
    feat, cut, child, length = (np.zeros(shape, dtype=d) for d in (np.intp, np.float64, np.intp, np.float64))
    feat[t, k], cut[t, k], child[t, k], length[t, k] = (nodes[c].to_numpy() for c in ("feature", "threshold", "child", "length"))
    # a leaf sends every value to itself, so scoring needs no test for it
    leaf = feat < 0
    cut[leaf], feat[leaf] = np.inf, 0
    forest = spark.sparkContext.broadcast((feat, cut, child, length))
    scale = mean_path(min(sample, n)) or 1.0

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        feat, cut, child, length = forest.value
        values = np.ascontiguousarray(rows.to_numpy(dtype=float))
        flat, start = values.ravel(), np.arange(len(values)) * values.shape[1]
        total = np.zeros(len(values))
        for f, c, nxt, size in zip(feat, cut, child, length):
            at = nxt[0] + (values[:, f[0]] > c[0])      # all rows are at the root
            for _ in range(depth - 1):
                # every index lies in its array; clipping spares the look-ups a test and a copy
                at = nxt.take(at, mode="clip") + (flat.take(start + f.take(at, mode="clip"), mode="clip") > c.take(at, mode="clip"))
            total += size.take(at, mode="clip")
        return pd.Series(2.0 ** (-total / len(feat) / scale))

    return df.withColumn("anomaly_score", F.round(score(F.struct(*_numbers(features))), 9))

"""Ordered scans and exact quantiles by one range partitioning on (group, value).

A plain window (or ``percentile``) over a group sends the group to one task. Here the rows are range-partitioned by
group and value, sorted inside the partitions, numbered and written once: a number holds the partition and the place
in it, so the numbers are the order. Counts of (group, partition) and their running totals turn a number into a rank.
A quantile is then a lookup of a few numbers, and no row is moved a second time. Equal values may be dealt to several
partitions, so a very common value does not meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import written

PLACE_BITS = 33                   # the number of a row: its partition above, its place in it below


def placed(df: DataFrame, by: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """The rows with ``_id``, their number in the order of (by, order), and ``_p``, their range partition."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_deal", F.rand(7)).repartitionByRange(n, *by, *order, "_deal").sortWithinPartitions(*by, *order)
    rows = written(rows.drop("_deal").withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumn("_p", F.shiftright("_id", PLACE_BITS))


def part_heads(rows: DataFrame, by: list[str], sums: dict[str, Column], maxes: dict[str, Column] | None = None) -> DataFrame:
    """One row for each group and partition that has it: the first number, and totals before this partition.

    ``_n`` is the number of rows of the group. Its size is the number of groups and partitions together.
    """
    maxes = maxes or {}
    own = rows.groupBy(*by, "_p").agg(F.min("_id").alias("_first"), F.count("*").alias("_c"), *[e.alias(f"_own_{k}") for k, e in sums.items()],
                                      *[e.alias(f"_own_{k}") for k, e in maxes.items()])
    all_ = Window.partitionBy(*by)
    over = all_.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return own.select(*by, "_p", "_first", "_c", F.sum("_c").over(all_).alias("_n"), F.coalesce(F.sum("_c").over(over), F.lit(0)).alias("_pre"),
                      *[F.coalesce(F.sum(f"_own_{k}").over(over), F.lit(0)).alias(f"_h_{k}") for k in sums],
                      *[F.max(f"_own_{k}").over(over).alias(f"_h_{k}") for k in maxes])


def carried_over(heads: DataFrame) -> DataFrame:
    """Heads of groups that began in an earlier partition: the first group of a partition only, so at most one row for
    each partition, a proven bound for a broadcast."""
    return F.broadcast(heads.where(F.col("_pre") > 0))


def ordered_scan(df: DataFrame, by: list[str], order: str, sums: dict[str, str] | None = None,
                 maxes: dict[str, str] | None = None, buckets: int | None = None) -> DataFrame:
    """Running totals and maxima over all rows with a smaller ``order`` in the same group.

    ``df`` must hold one row per (``by``, ``order``). ``sums`` and ``maxes`` map the new column to its
    source column. A sum before the first row is 0, a maximum is null.
    """
    sums, maxes = sums or {}, maxes or {}
    rows = placed(df, by, [order], buckets)
    heads = part_heads(rows, by, {k: F.sum(src) for k, src in sums.items()}, {k: F.max(src) for k, src in maxes.items()})
    inside = Window.partitionBy(*by, "_p").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = carried_over(heads.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_p").alias("_hp"), "_pre",
                                        *[f"_h_{k}" for k in [*sums, *maxes]]))
    same = F.col("_p") == F.col("_hp")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = rows.join(earlier, same, "left").drop("_hp", *[f"_k_{c}" for c in by])
    out = out.withColumns({
        **{new: F.coalesce(F.col(f"_h_{new}"), F.lit(0)) + F.coalesce(F.sum(src).over(inside), F.lit(0)) for new, src in sums.items()},
        **{new: F.greatest(F.col(f"_h_{new}"), F.max(src).over(inside)) for new, src in maxes.items()}})
    return out.drop("_p", "_id", "_pre", *[f"_h_{new}" for new in [*sums, *maxes]])


def first_rows(df: DataFrame, order: list[str], n: Column) -> DataFrame:
    """The first ``n`` rows of the whole table in this order, without a window over it."""
    rows = placed(df, [], order)
    heads = F.broadcast(part_heads(rows, [], {}).select("_p", "_first", "_pre"))     # one row for each partition
    return rows.join(heads, "_p").where(F.col("_pre") + F.col("_id") - F.col("_first") < n).select(*df.columns)


def numbered(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """The rows with their number (from 0) in the order of their group, from the written order; no window over rows."""
    rows = placed(df, by, order)
    heads = part_heads(rows, by, {}).select(*by, "_p", "_first", "_pre")
    return rows.join(heads, [*by, "_p"]).withColumn(out, F.col("_pre") + F.col("_id") - F.col("_first")).select(*df.columns, out)


def average_ranks(df: DataFrame, by: list[str], value: str, out: str = "rank", descending: bool = False,
                  buckets: int | None = None) -> DataFrame:
    """Rank of each row's value in its group, ties sharing the average rank."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    key = value
    if descending:
        counts, key = counts.withColumn("_neg", -F.col(value)), "_neg"
    ranks = (ordered_scan(counts, by, key, {"_before_all": "_n"}, buckets=buckets)
             .select(*by, value, (F.col("_before_all") + (F.col("_n") + 1) / 2).alias(out)))
    return df.join(ranks, [*by, value])


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float | Column],
                    buckets: int | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) per group, one output column per entry of ``probs``.

    Nulls are ignored. A probability may be a number or a Column of the group's row count ``_n``.
    """
    rows = placed(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), by, ["_v"], buckets)
    heads = part_heads(rows, by, {})
    wanted = []
    for name, p in probs.items():
        p = F.lit(float(p)) if isinstance(p, (int, float)) else p
        # rounding keeps exact positions such as 0.95 * 20 from landing a hair off the row
        pos = F.round(p * (F.col("_n") - 1), 9)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            wanted.append(F.struct(F.lit(f"{side}_{name}").alias("what"), rank.alias("rank"), (pos - F.floor(pos)).alias("share")))
    # a few numbers for each group; the rows themselves stay where they are
    picks = (heads.select(*by, "_first", "_c", "_pre", F.explode(F.array(*wanted)).alias("_w"))
             .where((F.col("_w.rank") >= F.col("_pre")) & (F.col("_w.rank") < F.col("_pre") + F.col("_c")))
             .select(*by, (F.col("_first") + F.col("_w.rank") - F.col("_pre")).alias("_id"), F.col("_w.what").alias("_what"), F.col("_w.share").alias("_share")))
    found = picks.join(rows.select("_id", "_v"), "_id")
    got = {f"{side}_{name}": F.max(F.when(F.col("_what") == f"{side}_{name}", F.col("_v"))) for name in probs for side in ("lo", "hi")}
    share = {name: F.max(F.when(F.col("_what") == f"lo_{name}", F.col("_share"))) for name in probs}
    return found.groupBy(*by).agg(*[(got[f"lo_{name}"] + (got[f"hi_{name}"] - got[f"lo_{name}"]) * share[name]).alias(name) for name in probs])


NARROW = 10_000


def narrow_quantile(df: DataFrame, value: str, p: float) -> float | None:
    """The exact quantile (linear interpolation) of one column of numbers from 0 to 1; nulls are ignored.

    Rows are counted in ``NARROW`` equal steps of the value first, so only those in the steps around the quantile are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.floor(F.col(value) * NARROW).alias("_s"))
    counts = sorted(map(tuple, rows.groupBy("_s").agg(F.count("*")).collect()))      # at most NARROW + 1 rows
    pos = round(p * (sum(n for _, n in counts) - 1), 9)
    before, first, last, upto = 0, None, None, 0
    for step, n in counts:
        if first is None and upto + n > math.floor(pos):
            first, before = step, upto
        upto += n
        if upto > math.ceil(pos):
            last = step
            break
    if last is None:
        return None
    inside = pos - before
    share = F.lit(inside) / F.greatest(F.col("_n") - 1, F.lit(1))
    return exact_quantiles(rows.where(F.col("_s").between(first, last)).select("_v"), [], "_v", {"q": share}).first()[0]

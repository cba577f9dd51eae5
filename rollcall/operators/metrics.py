"""Scoring metrics. The Column functions go into any ``agg``; the rest take grouped rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import average_ranks, first_rows, ordered_scan


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mape(actual, pred) -> Column:
    return F.avg(F.abs(F.try_divide(_c(pred) - _c(actual), _c(actual)))) * 100


def mae(actual, pred) -> Column:
    return F.avg(F.abs(_c(pred) - _c(actual)))


def rmse(actual, pred) -> Column:
    e = _c(pred) - _c(actual)
    return F.sqrt(F.avg(e * e))


def wape(actual, pred) -> Column:
    return F.try_divide(F.sum(F.abs(_c(pred) - _c(actual))), F.sum(_c(actual))) * 100


def pinball(actual, quantile, tau: float) -> Column:
    e = _c(actual) - _c(quantile)
    return F.greatest(tau * e, (tau - 1) * e)


def covered(actual, lo, hi) -> Column:
    return ((_c(actual) >= _c(lo)) & (_c(actual) <= _c(hi))).cast("double")


def brier(label, prob) -> Column:
    e = _c(prob) - _c(label)
    return F.avg(e * e)


def log_loss(label, prob, eps: float = 1e-6) -> Column:
    p = F.greatest(F.least(_c(prob), F.lit(1 - eps)), F.lit(eps))
    return F.avg(-(_c(label) * F.log(p) + (1 - _c(label)) * F.log(1 - p)))


def r2(actual, pred, weight=None) -> Column:
    """1 - residual / total sum of squares (weighted when a weight is given), from sums only."""
    a, p = _c(actual), _c(pred)
    w = F.lit(1.0) if weight is None else _c(weight)
    total = F.sum(w * a * a) - F.sum(w * a) * F.sum(w * a) / F.sum(w)
    return 1 - F.try_divide(F.sum(w * (a - p) * (a - p)), total)


def diebold_mariano(loss1, loss2) -> Column:
    """Mean difference of squared errors over its standard error; null below 3 rows or without variance."""
    d = _c(loss1) * _c(loss1) - _c(loss2) * _c(loss2)
    stat = F.try_divide(F.avg(d), F.sqrt(F.var_samp(d) / F.count(d)))
    return F.when((F.count(d) >= 3) & (F.var_pop(d) > 0), stat)


def dm_hln(df: DataFrame, by: list[str], order: str, loss_a: str, loss_b: str, h: int) -> DataFrame:
    """Diebold-Mariano with h-1 autocovariance lags and the small-sample correction.

    One row per forecast origin in each group, so a group is bounded by the number of periods.
    """
    w = Window.partitionBy(*by)
    seq = w.orderBy(order)
    d = df.select(*by, order, (F.col(loss_a) - F.col(loss_b)).alias("_d"))
    d = d.withColumns({"_n": F.count("_d").over(w), "_m": F.avg("_d").over(w)}).withColumn("_x", F.col("_d") - F.col("_m"))
    d = d.withColumns({f"_g{k}": F.col("_x") * F.lag("_x", k).over(seq) if k else F.col("_x") * F.col("_x")
                       for k in range(h)})
    n = F.col("n")
    out = d.groupBy(*by).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.max(F.abs("_d")).alias("_big"),
                             *[F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(h)])
    extra = F.lit(0.0)
    for k in range(1, h):
        extra = extra + F.col(f"g{k}")
    var = (F.col("g0") + 2 * extra) / n / n
    var = F.when(var <= 0, F.col("g0") / n / n).otherwise(var)
    stat = F.col("mean_diff") / F.sqrt(var) * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return out.select(*by, "n", F.when((n >= 4) & (F.col("_big") > 1e-8), stat).alias("stat"))


# ---- fixed values: coefficients of the Lanczos approximation of the gamma function (g = 7) ----
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# ---- end of fixed values ----
FRACTION_STEPS = 200


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x of at least 0.5, in the JVM."""
    z, series = x - 1, F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    tiny = F.lit(1e-300)

    def fraction(p: Column, q: Column, u: Column) -> Column:
        def held(v: Column) -> Column:
            return F.when(F.abs(v) < tiny, tiny).otherwise(v)

        def term(s: Column, k: Column) -> Column:
            # even and odd terms of the fraction in turn; c and d are the two running ratios, h the value so far
            m = F.floor(k / 2)
            even = m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))
            n = F.when(k % 2 == 0, even).otherwise(odd)
            d, c = 1 / held(1 + n * s["d"]), held(1 + n / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))
        start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(2 * FRACTION_STEPS)), start, term, lambda s: 1 / s["h"])
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    direct = front * fraction(a, b, x) / a
    mirrored = 1 - front * fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)


def t_p_value(stat, df) -> Column:
    """Two-sided Student-t p-value of a statistic as a Column; null without a statistic or a degree of freedom."""
    t, v = _c(stat).cast("double"), _c(df).cast("double")
    p = beta_share(v / 2, F.lit(0.5), v / (v + t * t))
    return F.when(t.isNotNull() & ~F.isnan(t) & (v >= 1), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def ece_bins(df: DataFrame, by: list[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    cells = df.groupBy(*by, b.alias("_bin")).agg(F.avg(label).alias("_y"), F.avg(prob).alias("_p"), F.count("*").alias("_n"))
    return cells.groupBy(*by).agg((F.sum(F.abs(F.col("_y") - F.col("_p")) * F.col("_n")) / F.sum("_n")).alias("ece"))


def auc(df: DataFrame, by: list[str], label: str, score: str, buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null when a class is missing."""
    s = (df.groupBy(*by, F.col(score).alias("_s"))
         .agg(F.sum(F.col(label).cast("double")).alias("_pos"), F.sum(1.0 - F.col(label).cast("double")).alias("_neg")))
    scan = ordered_scan(s, by, "_s", {"_below": "_neg"}, buckets=buckets)
    return scan.groupBy(*by).agg(F.try_divide(
        F.sum(F.col("_pos") * (F.col("_below") + 0.5 * F.col("_neg"))), F.sum("_pos") * F.sum("_neg")).alias("auc"))


def spearman(df: DataFrame, by: list[str], a: str, b: str, buckets: int | None = None) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    r = average_ranks(df, by, a, "_ra", buckets=buckets)
    r = average_ranks(r, by, b, "_rb", buckets=buckets)
    return r.groupBy(*by).agg(F.corr("_ra", "_rb").alias("rank_corr"))


def top_share_hit_rate(df: DataFrame, unit: str, predicted: str, actual: str, top: float = 0.2) -> DataFrame:
    """Share of the units in the actual top that the prediction also puts in its top.

    One row per unit. Ties at the edge go by unit number, or by the hash of a unit name.
    """
    n = df.agg(F.greatest(F.lit(1), F.bround(F.count("*") * top, 0)).cast("bigint")).scalar()
    key = F.col(unit) if dict(df.dtypes)[unit] in ("int", "bigint", "double") else F.xxhash64(unit)

    def first_k(col: str, mark: str) -> DataFrame:
        ranked = df.where(F.col(col).isNotNull()).select(unit, (-F.col(col)).alias("_neg"), key.alias("_key"))
        return first_rows(ranked, ["_neg", "_key"], n).select(unit).withColumn(mark, F.lit(True))

    hits = first_k(actual, "_a").join(first_k(predicted, "_p"), unit, "left")
    return hits.agg(F.count("*").alias("k"), F.count_if(F.col("_p")).alias("hits"),
                    (F.count_if(F.col("_p")) / F.count("*")).alias("hit_rate"))

"""Queries: scoring metrics over predictions derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import table
from .registry import query
from .sqlviews import sql, t_p_sql

PRED = """WITH p AS (
  SELECT l_returnflag AS model, l_extendedprice / 1000 AS actual, l_quantity * 1.5 AS pred,
    l_quantity * 1.4 + l_tax * 10 AS pred2, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label,
    LEAST(GREATEST(l_discount * 8 + l_tax * 2, 0), 1) AS prob,
    CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS month FROM lineitem)
"""


def predictions(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("model"), (F.col("l_extendedprice") / 1000).alias("actual"),
        (F.col("l_quantity") * 1.5).alias("pred"), (F.col("l_quantity") * 1.4 + F.col("l_tax") * 10).alias("pred2"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"),
        F.least(F.greatest(F.col("l_discount") * 8 + F.col("l_tax") * 2, F.lit(0.0)), F.lit(1.0)).alias("prob"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month"))


@query("k01_point_errors", sql("", PRED + """
SELECT model, ROUND(AVG(abs((pred - actual) / actual)) * 100, 6) AS mape, ROUND(AVG(abs(pred - actual)), 6) AS mae,
  ROUND(sqrt(AVG((pred - actual) * (pred - actual))), 6) AS rmse FROM p GROUP BY 1"""))
def point(spark, d):
    return predictions(spark, d).groupBy("model").agg(
        F.round(M.mape("actual", "pred"), 6).alias("mape"), F.round(M.mae("actual", "pred"), 6).alias("mae"),
        F.round(M.rmse("actual", "pred"), 6).alias("rmse"))


@query("k02_wape", sql("", PRED + """
SELECT model, ROUND(SUM(abs(pred - actual)) / SUM(actual) * 100, 6) AS wape FROM p GROUP BY 1"""))
def wape(spark, d):
    return predictions(spark, d).groupBy("model").agg(F.round(M.wape("actual", "pred"), 6).alias("wape"))


@query("k03_diebold_mariano", sql("", PRED + """,
e AS (SELECT model, (pred - actual) * (pred - actual) - (pred2 - actual) * (pred2 - actual) AS d FROM p)
SELECT model, COUNT(*) AS n, ROUND(AVG(d) / sqrt(var_samp(d) / COUNT(*)), 6) AS dm FROM e GROUP BY 1"""))
def dm(spark, d):
    p = predictions(spark, d)
    return p.groupBy("model").agg(F.count("*").alias("n"), F.round(
        M.diebold_mariano(F.col("pred") - F.col("actual"), F.col("pred2") - F.col("actual")), 6).alias("dm"))


@query("k04_dm_hln", sql("", PRED + """,
m AS (SELECT model, month, AVG(abs(pred - actual)) AS a, AVG(abs(pred2 - actual)) AS b FROM p GROUP BY 1, 2),
x AS (SELECT model, month, a - b AS d, a - b - AVG(a - b) OVER (PARTITION BY model) AS x FROM m),
g AS (SELECT *, x * x AS g0, x * LAG(x, 1) OVER w AS g1, x * LAG(x, 2) OVER w AS g2 FROM x
  WINDOW w AS (PARTITION BY model ORDER BY month)),
s AS (SELECT model, COUNT(*) AS n, AVG(d) AS m, MAX(abs(d)) AS big, SUM(g0) AS g0, SUM(g0) + 2 * (SUM(g1) + SUM(g2)) AS gs FROM g GROUP BY 1),
v AS (SELECT *, CASE WHEN gs / n / n <= 0 THEN g0 / n / n ELSE gs / n / n END AS var FROM s)
SELECT model, n, ROUND(CASE WHEN n >= 4 AND big > 1e-8 THEN m / sqrt(var) * sqrt((n + 1 - 6 + 3 * 2 / n) / n) END, 6) AS stat FROM v"""))
def hln(spark, d):
    m = predictions(spark, d).groupBy("model", "month").agg(M.mae("actual", "pred").alias("a"), M.mae("actual", "pred2").alias("b"))
    return M.dm_hln(m, ["model"], "month", "a", "b", 3).withColumn("stat", F.round("stat", 6))


@query("k03_dm_p_values", sql("", PRED + f""",
e AS (SELECT model, month, (pred - actual) * (pred - actual) - (pred2 - actual) * (pred2 - actual) AS d FROM p),
s AS (SELECT model, month, COUNT(*) AS n, AVG(d) / sqrt(var_samp(d) / COUNT(*)) AS stat FROM e GROUP BY 1, 2 HAVING COUNT(*) >= 3 AND var_pop(d) > 0)
SELECT model, month, n, ROUND(stat, 6) AS dm, ROUND({t_p_sql('stat', '(n - 1)')}, 6) AS p_value FROM s"""))
def dm_p(spark, d):
    e = M.diebold_mariano(F.col("pred") - F.col("actual"), F.col("pred2") - F.col("actual"))
    s = predictions(spark, d).groupBy("model", "month").agg(F.count("*").alias("n"), e.alias("stat")).where("stat IS NOT NULL")
    s = s.withColumn("p_value", M.t_p_value("stat", F.col("n") - 1))
    return s.select("model", "month", "n", F.round("stat", 6).alias("dm"), F.round("p_value", 6).alias("p_value"))


@query("k04_hln_p_values", sql("", PRED + f""",
m AS (SELECT model, month, AVG(abs(pred - actual)) AS a, AVG(abs(pred2 - actual)) AS b FROM p GROUP BY 1, 2),
x AS (SELECT model, month, a - b AS d, a - b - AVG(a - b) OVER (PARTITION BY model) AS x FROM m),
g AS (SELECT *, x * x AS g0, x * LAG(x, 1) OVER w AS g1, x * LAG(x, 2) OVER w AS g2 FROM x WINDOW w AS (PARTITION BY model ORDER BY month)),
s AS (SELECT model, COUNT(*) AS n, AVG(d) AS m, SUM(g0) AS g0, SUM(g0) + 2 * (SUM(g1) + SUM(g2)) AS gs FROM g GROUP BY 1),
t AS (SELECT model, n, m / sqrt(CASE WHEN gs <= 0 THEN g0 ELSE gs END / n / n) * sqrt((n + 1 - 6 + 3 * 2 / n) / n) AS stat FROM s)
SELECT model, n, ROUND({t_p_sql('stat', '(n - 1)')}, 6) AS p_value FROM t"""))
def hln_p(spark, d):
    m = predictions(spark, d).groupBy("model", "month").agg(M.mae("actual", "pred").alias("a"), M.mae("actual", "pred2").alias("b"))
    s = M.dm_hln(m, ["model"], "month", "a", "b", 3)
    return s.select("model", "n", F.round(M.t_p_value("stat", F.col("n") - 1), 6).alias("p_value"))


@query("k05_pinball_coverage", sql("", PRED + """
SELECT model, ROUND(AVG(GREATEST(0.1 * (actual - pred * 0.6), -0.9 * (actual - pred * 0.6))), 6) AS loss10,
  ROUND(AVG(GREATEST(0.9 * (actual - pred * 1.4), -0.1 * (actual - pred * 1.4))), 6) AS loss90,
  ROUND(AVG(CASE WHEN actual >= pred * 0.6 AND actual <= pred * 1.4 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM p GROUP BY 1"""))
def loss(spark, d):
    lo, hi = F.col("pred") * 0.6, F.col("pred") * 1.4
    return predictions(spark, d).groupBy("model").agg(
        F.round(F.avg(M.pinball("actual", lo, 0.1)), 6).alias("loss10"),
        F.round(F.avg(M.pinball("actual", hi, 0.9)), 6).alias("loss90"),
        F.round(F.avg(M.covered("actual", lo, hi)), 6).alias("coverage"))


@query("k06_auc", sql("", PRED + """,
s AS (SELECT model, ROUND(prob, 6) AS prob, SUM(label) AS pos, SUM(1 - label) AS neg FROM p GROUP BY 1, 2),
c AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT model, ROUND(SUM(pos * (below + 0.5 * neg)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)), 6) AS auc FROM c GROUP BY 1"""))
def auc(spark, d):
    p = predictions(spark, d).withColumn("prob", F.round("prob", 6))
    return M.auc(p, ["model"], "label", "prob").withColumn("auc", F.round("auc", 6))


@query("k07_calibration", sql("", PRED + """,
b AS (SELECT model, LEAST(CAST(floor(ROUND(prob, 6) * 10) AS INT), 9) AS bin, AVG(label) AS y, AVG(ROUND(prob, 6)) AS pr, COUNT(*) AS n FROM p GROUP BY 1, 2),
e AS (SELECT model, SUM(abs(y - pr) * n) / SUM(n) AS ece FROM b GROUP BY 1),
l AS (SELECT model, AVG((prob - label) * (prob - label)) AS brier,
  AVG(-(label * ln(LEAST(GREATEST(prob, 1e-6), 1 - 1e-6)) + (1 - label) * ln(1 - LEAST(GREATEST(prob, 1e-6), 1 - 1e-6)))) AS ll FROM p GROUP BY 1)
SELECT model, ROUND(brier, 6) AS brier, ROUND(ll, 6) AS log_loss, ROUND(ece, 6) AS ece FROM l JOIN e USING (model)"""))
def calibration(spark, d):
    p = predictions(spark, d)
    a = p.groupBy("model").agg(F.round(M.brier("label", "prob"), 6).alias("brier"), F.round(M.log_loss("label", "prob"), 6).alias("log_loss"))
    e = M.ece_bins(p.withColumn("prob", F.round("prob", 6)), ["model"], "label", "prob").withColumn("ece", F.round("ece", 6))
    return a.join(e, "model")


CUST = """WITH u AS (
  SELECT o_custkey AS unit, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS spend FROM orders GROUP BY 1)
"""


def customers(spark, d):
    return (table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit"))
            .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spend")))


@query("k08_spearman", sql("", CUST + """,
r AS (SELECT RANK() OVER (ORDER BY n) + (COUNT(*) OVER (PARTITION BY n) - 1) / 2 AS a,
  RANK() OVER (ORDER BY spend) + (COUNT(*) OVER (PARTITION BY spend) - 1) / 2 AS b FROM u)
SELECT ROUND(corr(a, b), 6) AS rank_corr FROM r"""))
def spearman(spark, d):
    return M.spearman(customers(spark, d), [], "n", "spend").withColumn("rank_corr", F.round("rank_corr", 6))


@query("k08_top_share_hit_rate", sql("", CUST + """,
k AS (SELECT GREATEST(1, CAST(round_even(COUNT(*) * 0.2, 0) AS BIGINT)) AS k FROM u),
a AS (SELECT unit FROM u ORDER BY spend DESC, unit LIMIT (SELECT k FROM k)),
p AS (SELECT unit FROM u ORDER BY n DESC, unit LIMIT (SELECT k FROM k))
SELECT COUNT(*) AS k, COUNT(p.unit) AS hits, COUNT(p.unit) / COUNT(*) AS hit_rate FROM a LEFT JOIN p USING (unit)"""))
def hits(spark, d):
    return M.top_share_hit_rate(customers(spark, d), "unit", "n", "spend")


@query("k09_r2", sql("", PRED + """,
m AS (SELECT model, AVG(actual) AS ma, SUM(actual * prob) / SUM(prob) AS mw FROM p GROUP BY 1)
SELECT model, ROUND(1 - SUM((actual - pred) * (actual - pred)) / SUM((actual - ma) * (actual - ma)), 6) AS r2,
  ROUND(1 - SUM(prob * (actual - pred) * (actual - pred)) / SUM(prob * (actual - mw) * (actual - mw)), 6) AS r2_weighted
FROM p JOIN m USING (model) GROUP BY 1"""))
def r2(spark, d):
    return predictions(spark, d).groupBy("model").agg(
        F.round(M.r2("actual", "pred"), 6).alias("r2"), F.round(M.r2("actual", "pred", "prob"), 6).alias("r2_weighted"))

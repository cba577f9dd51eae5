"""Queries: forecasting and forecast scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import ensure_checkpoint_dir
from ..operators import forecast as FC
from ..operators import hierarchy as H
from ..operators import metrics as M_
from . import views as V
from .registry import query
from .sqlviews import sql, t_p_sql

RATES = ["real_growth", "inflation"]

TASKS = """ends AS (SELECT series, MIN(t) AS a, MAX(t) AS b FROM macro GROUP BY 1),
roll AS (SELECT series, CAST(unnest(range(GREATEST(a + 7, b - 17), b - 5 + 1)) AS INT) AS origin, 5 AS h FROM ends),
tasks AS (SELECT series, origin, MAX(h) AS h FROM (SELECT * FROM roll UNION ALL SELECT series, b - 8, 8 FROM ends UNION ALL SELECT series, b, 10 FROM ends) GROUP BY 1, 2),
ctx AS (SELECT k.series, k.origin, k.h, m.t, m.value, ROW_NUMBER() OVER (PARTITION BY k.series, k.origin ORDER BY m.t DESC) AS back,
    ROW_NUMBER() OVER (PARTITION BY k.series, k.origin ORDER BY m.t) - 1 AS x FROM tasks k JOIN macro m ON m.series = k.series AND m.t <= k.origin),
fit AS (SELECT series, origin, MAX(h) AS h, COUNT(*) AS n, arg_max(value, t) AS last, AVG(value) FILTER (WHERE back <= 8) AS m8,
    regr_slope(value, x) AS slope, regr_intercept(value, x) AS icpt FROM ctx GROUP BY 1, 2),
fc AS (SELECT series, origin, CAST(k AS INT) AS h, CAST(origin + k AS INT) AS t, model, CASE model WHEN 'naive' THEN last WHEN 'mean_8' THEN m8 ELSE icpt + slope * (n + k - 1) END AS q50
  FROM fit JOIN range(1, 11) AS r(k) ON k <= h CROSS JOIN (VALUES ('naive'), ('mean_8'), ('linear_trend')) AS v(model))"""
M = "WITH " + TASKS


def actuals(spark, d):
    """The monthly series (one row per series and month), written out: every scoring step reads them."""
    ensure_checkpoint_dir(spark)
    return V.macro(spark, d).checkpoint()


def forecasts(spark, d, with_ar=False):
    a = actuals(spark, d)
    tasks = FC.rolling_tasks(a, ["series"])
    return a, tasks, FC.run_forecasters(tasks, ["series"], with_ar=with_ar)


def yearly(spark, d):
    """All totals of the unit hierarchy as series by year."""
    s = H.all_series(H.cell_series(V.cells(spark, d)))
    return s.select("series", F.col("year").alias("t"), "value")


YEARLY = """cell_grid AS (SELECT c.sector, c.ministry, c.province, y.year, COALESCE(v.value, 0) AS value
  FROM (SELECT DISTINCT sector, ministry, province FROM cells) c CROSS JOIN (SELECT DISTINCT year FROM cells) y
  LEFT JOIN cells v ON v.sector = c.sector AND v.ministry = c.ministry AND v.province = c.province AND v.year = y.year),
alls AS (SELECT CASE GROUPING(sector, ministry, province) WHEN 7 THEN 'national' WHEN 3 THEN 'sector:' || sector WHEN 5 THEN 'ministry:' || ministry
    WHEN 6 THEN 'province:' || province ELSE 'cell:' || sector || '|' || ministry || '|' || province END AS series,
  CASE GROUPING(sector, ministry, province) WHEN 7 THEN 'national' WHEN 3 THEN 'sector' WHEN 5 THEN 'ministry' WHEN 6 THEN 'province' ELSE 'cell' END AS level,
  year, SUM(value) AS value FROM cell_grid
  GROUP BY GROUPING SETS ((year), (sector, year), (ministry, year), (province, year), (sector, ministry, province, year)))"""


@query("h01_naive", sql("cells", f"""
WITH {YEARLY}, n AS (SELECT series, arg_max(value, year) AS v FROM alls GROUP BY 1)
SELECT series, CAST(k AS INT) AS h, ROUND(v, 9) AS q50 FROM n CROSS JOIN range(1, 4) AS r(k)"""))
def naive(spark, d):
    return one_model(yearly(spark, d), FC.naive, 3)


def one_model(s, fn, h):
    p = FC.pack_series(s, ["series"]).withColumn("h", F.lit(h))
    return (p.select("series", F.posexplode(fn(F.col("y"), F.col("h"))).alias("_i", "q50"))
            .select("series", (F.col("_i") + 1).alias("h"), F.round("q50", 9).alias("q50")))


@query("h02_recent_mean", sql("macro", """
WITH b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY t DESC) AS back FROM macro),
n AS (SELECT series, AVG(value) AS v FROM b WHERE back <= 8 GROUP BY 1)
SELECT series, CAST(k AS INT) AS h, ROUND(v, 8) AS q50 FROM n CROSS JOIN range(1, 4) AS r(k)"""))
def recent_mean(spark, d):
    p = FC.pack_series(V.macro(spark, d), ["series"]).withColumn("h", F.lit(3))
    return (p.select("series", F.posexplode(FC.recent_mean(F.col("y"), F.col("h"))).alias("_i", "q50"))
            .select("series", (F.col("_i") + 1).alias("h"), F.round("q50", 8).alias("q50")))


@query("h03_linear_trend", sql("cells", f"""
WITH {YEARLY}, f AS (SELECT series, regr_slope(value, year) AS s, regr_intercept(value, year) AS i, MAX(year) AS y FROM alls GROUP BY 1)
SELECT series, CAST(k AS INT) AS h, ROUND(i + s * (y + k), 6) AS q50 FROM f CROSS JOIN range(1, 4) AS r(k)"""))
def trend(spark, d):
    return one_model(yearly(spark, d), FC.linear_trend, 3).withColumn("q50", F.round("q50", 6))


@query("h04_ar_select")
def ar(spark, d):
    tasks = FC.rolling_tasks(actuals(spark, d), ["series"])
    return FC.ar_select(tasks).select("series", "origin", "h", "q10", "q50", "q90")


@query("h04_ma_grid")
def ma(spark, d):
    tasks = FC.rolling_tasks(actuals(spark, d), ["series"])
    return FC.ma_grid(tasks).select("series", "origin", "model", "phi", "theta", "aic", "q50")


LAGS = """
lg AS (SELECT series, origin, t, value AS y0, LAG(value, 1) OVER w AS y1, LAG(value, 2) OVER w AS y2, ROW_NUMBER() OVER w AS i,
    value - AVG(value) OVER (PARTITION BY series, origin) AS x, COUNT(*) OVER (PARTITION BY series, origin) AS n FROM ctx WINDOW w AS (PARTITION BY series, origin ORDER BY t)),
mo AS (SELECT series, origin, COUNT(*) AS m, AVG(y0) AS m0, AVG(y1) AS m1, AVG(y2) AS m2, covar_pop(y0, y0) * COUNT(*) AS s00, covar_pop(y0, y1) * COUNT(*) AS s01, covar_pop(y0, y2) * COUNT(*) AS s02,
    covar_pop(y1, y1) * COUNT(*) AS s11, covar_pop(y1, y2) * COUNT(*) AS s12, covar_pop(y2, y2) * COUNT(*) AS s22, SUM((y0 - y1) * (y0 - y1)) AS d00, SUM((y0 - y1) * (y1 - y2)) AS dd,
    SUM((y1 - y2) * (y1 - y2)) AS d11 FROM lg WHERE i >= 3 AND n >= 6 GROUP BY 1, 2),
b AS (SELECT *, s01 / s11 AS a1, (s01 * s22 - s02 * s12) / (s11 * s22 - s12 * s12) AS b1, (s02 * s11 - s01 * s12) / (s11 * s22 - s12 * s12) AS b2, dd / d11 AS g FROM mo),
gr AS (SELECT ROUND(-0.9 + 0.1 * i, 1) AS v FROM range(0, 19) AS r(i)),
"""
CHOICE = f"""WITH RECURSIVE {TASKS}, {LAGS}
sh AS (SELECT series, origin, p.v AS phi, q.v AS theta, i, n, x AS prev, x - p.v * (y1 - (y0 - x)) AS e, CAST(0 AS DOUBLE) AS sse, y0 - y1 - q.v * 0 AS de, CAST(0 AS DOUBLE) AS dsse
    FROM lg CROSS JOIN gr p CROSS JOIN gr q WHERE i = 2 AND n >= 6
  UNION ALL SELECT s.series, s.origin, phi, theta, l.i, s.n, l.x, l.x - phi * prev - theta * e, sse + (l.x - phi * prev - theta * e) * (l.x - phi * prev - theta * e),
    l.y0 - l.y1 - theta * de, dsse + (l.y0 - l.y1 - theta * de) * (l.y0 - l.y1 - theta * de)
    FROM sh s JOIN lg l ON l.series = s.series AND l.origin = s.origin AND l.i = s.i + 1),
cand AS (SELECT series, origin, 1 AS o, 'ar1' AS model, m * ln(GREATEST((s00 - a1 * s01) / m, 1e-12)) + 6 AS aic FROM b
  UNION ALL SELECT series, origin, 2, 'ar2', m * ln(GREATEST((s00 - b1 * s01 - b2 * s02) / m, 1e-12)) + 8 FROM b
  UNION ALL SELECT series, origin, 3, 'ari11', m * ln(GREATEST((d00 - g * dd) / m, 1e-12)) + 4 FROM b
  UNION ALL SELECT series, origin, 4, 'arma11', MIN((n - 2) * ln(GREATEST(sse / (n - 2), 1e-12)) + 8) FROM sh WHERE i = n GROUP BY 1, 2
  UNION ALL SELECT series, origin, 5, 'ima011', MIN((n - 2) * ln(GREATEST(dsse / (n - 2), 1e-12)) + 4) FROM sh WHERE i = n GROUP BY 1, 2)
SELECT series, origin, model, ROUND(aic, 5) AS aic, ROW_NUMBER() OVER (PARTITION BY series, origin ORDER BY ROUND(aic, 8), o) = 1 AS chosen FROM cand"""


@query("h04_model_table", sql("macro", CHOICE))
def model_table(spark, d):
    t = FC.model_table(FC.rolling_tasks(actuals(spark, d), ["series"]), ["series"])
    return t.select("series", "origin", "model", F.round("aic", 5).alias("aic"), "chosen")


SAME = M + """,
tr AS (SELECT f.series, f.h, f.model, f.q50, m.value AS actual FROM fc f JOIN ends e ON e.series = f.series AND f.origin = e.b - 8
  JOIN macro m ON m.series = f.series AND m.t = f.t WHERE f.h <= 8),
lv AS (SELECT series, h, model, CASE WHEN series = 'revenue_share' THEN q50 ELSE product(1 + q50) OVER w END AS p,
  CASE WHEN series = 'revenue_share' THEN actual ELSE product(1 + actual) OVER w END AS a FROM tr WINDOW w AS (PARTITION BY series, model ORDER BY h)),
sc AS (SELECT l.series, l.model, AVG(abs((l.p - l.a) / l.a)) * 100 AS mape, sqrt(AVG((l.p - l.a) * (l.p - l.a))) AS rmse,
  CASE WHEN l.model <> 'naive' THEN AVG((n.p - n.a) * (n.p - n.a) - (l.p - l.a) * (l.p - l.a)) /
    sqrt(var_samp((n.p - n.a) * (n.p - n.a) - (l.p - l.a) * (l.p - l.a)) / COUNT(*)) END AS dm
  FROM lv l JOIN lv n ON n.series = l.series AND n.h = l.h AND n.model = 'naive' GROUP BY 1, 2)
"""


@query("h05_single_origin_backtest", sql("macro", SAME + """
SELECT series, model, ROUND(mape, 6) AS mape, ROUND(rmse, 8) AS rmse, ROUND(dm, 5) AS dm_vs_naive FROM sc"""))
def single(spark, d):
    a, _, f = forecasts(spark, d)
    s = FC.score_same_origin(f, a, RATES)
    return s.select("series", "model", F.round("mape", 6).alias("mape"), F.round("rmse", 8).alias("rmse"), F.round("dm_vs_naive", 5).alias("dm_vs_naive"))


@query("h06_best_model", sql("macro", SAME + "SELECT series, arg_min(model, mape) AS model FROM sc GROUP BY 1"))
def best(spark, d):
    a, _, f = forecasts(spark, d)
    return FC.best_model(FC.score_same_origin(f, a, RATES))


@query("h07_rolling_tasks", sql("macro", M + """
SELECT series, origin, h, COUNT(*) AS n, ROUND(arg_max(value, t), 8) AS last FROM ctx GROUP BY 1, 2, 3"""))
def tasks(spark, d):
    t = FC.rolling_tasks(V.macro(spark, d), ["series"])
    return t.select("series", "origin", "h", F.size("y").alias("n"), F.round(F.element_at("y", -1), 8).alias("last"))


@query("h08_run_forecasters", sql("macro", M + "SELECT series, origin, h, t, model, ROUND(q50, 8) AS q50 FROM fc"))
def run(spark, d):
    return forecasts(spark, d)[2].select("series", "origin", "h", "t", "model", F.round("q50", 8).alias("q50"))


@query("h09_score_same_origin")
def same(spark, d):
    a, _, f = forecasts(spark, d, with_ar=True)
    return FC.score_same_origin(f, a, RATES)


# saved forecasts of an outside model: last value with a fixed range, scored next to the baselines
ROLL = M + """,
ff AS (SELECT series, origin, h, t, model, CAST(NULL AS DOUBLE) AS q10, q50, CAST(NULL AS DOUBLE) AS q90 FROM fc
  UNION ALL SELECT series, origin, h, t, 'saved', q50 - 0.05, q50, q50 + 0.04 FROM fc WHERE model = 'mean_8'),
rr AS (SELECT f.*, m.value AS actual, abs(q50 - m.value) * 100 AS abs_err, CASE WHEN q10 IS NOT NULL THEN CASE WHEN m.value >= q10 AND m.value <= q90 THEN 1.0 ELSE 0.0 END END AS covered,
    CASE WHEN q10 IS NOT NULL THEN (GREATEST(0.1 * (m.value - q10), -0.9 * (m.value - q10)) + GREATEST(0.5 * (m.value - q50), -0.5 * (m.value - q50))
      + GREATEST(0.9 * (m.value - q90), -0.1 * (m.value - q90))) * 2 / 3 * 100 END AS qloss
  FROM ff f JOIN ends e ON e.series = f.series AND f.origin BETWEEN GREATEST(a + 7, b - 17) AND b - 5 JOIN macro m ON m.series = f.series AND m.t = f.t WHERE f.h <= 5),
ro AS (SELECT series, model, AVG(abs_err) AS mae, """ + ", ".join(f"AVG(abs_err) FILTER (WHERE h = {k}) AS mae_h{k}" for k in range(1, 6)) + """,
  AVG(covered) * 100 AS coverage_80, AVG(qloss) AS quantile_loss FROM rr GROUP BY 1, 2),
rs AS (SELECT r.*, r.mae / n.mae AS rel_mae FROM ro r JOIN ro n ON n.series = r.series AND n.model = 'naive')
"""
ROLL_COLS = ["mae", *[f"mae_h{k}" for k in range(1, 6)], "coverage_80", "quantile_loss", "rel_mae"]


def rolling(spark, d):
    a, t, f = forecasts(spark, d)
    saved = f.where("model = 'mean_8'").withColumns({"model": F.lit("saved"), "q10": F.col("q50") - 0.05, "q90": F.col("q50") + 0.04})
    return a, t, f.unionByName(saved)


@query("h10_score_rolling", sql("macro", ROLL + "SELECT series, model, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in ROLL_COLS) + " FROM rs"))
def score_rolling(spark, d):
    a, _, f = rolling(spark, d)
    s = FC.score_rolling(FC.rolling_rows(f, a))
    return s.select("series", "model", *[F.round(c, 6).alias(c) for c in ROLL_COLS])


@query("h10_rolling_dm", sql("macro", ROLL + """,
po AS (SELECT series, origin, AVG(abs_err) FILTER (WHERE model = 'linear_trend') AS a, AVG(abs_err) FILTER (WHERE model = 'naive') AS b FROM rr GROUP BY 1, 2),
x AS (SELECT series, origin, a - b AS d, a - b - AVG(a - b) OVER (PARTITION BY series) AS x FROM po),
g AS (SELECT *, x * LAG(x, 1) OVER w AS g1, x * LAG(x, 2) OVER w AS g2, x * LAG(x, 3) OVER w AS g3, x * LAG(x, 4) OVER w AS g4 FROM x WINDOW w AS (PARTITION BY series ORDER BY origin)),
s AS (SELECT series, COUNT(*) AS n, AVG(d) AS m, SUM(x * x) AS g0, SUM(x * x) + 2 * (SUM(g1) + SUM(g2) + SUM(g3) + SUM(g4)) AS gs FROM g GROUP BY 1)
SELECT series, n, ROUND(m / sqrt(CASE WHEN gs <= 0 THEN g0 ELSE gs END / n / n) * sqrt((n + 1 - 10 + 5 * 4 / n) / n), 5) AS stat FROM s"""))
def rolling_dm(spark, d):
    a, _, f = rolling(spark, d)
    return FC.rolling_dm(FC.rolling_rows(f, a), "linear_trend", "naive").withColumn("stat", F.round("stat", 5))


@query("h10_dm_p_values", sql("macro", ROLL + f""",
po AS (SELECT series, origin, AVG(abs_err) FILTER (WHERE model = 'linear_trend') AS a, AVG(abs_err) FILTER (WHERE model = 'naive') AS b FROM rr GROUP BY 1, 2),
x AS (SELECT series, origin, a - b AS d, a - b - AVG(a - b) OVER (PARTITION BY series) AS x FROM po),
g AS (SELECT *, x * LAG(x, 1) OVER w AS g1, x * LAG(x, 2) OVER w AS g2, x * LAG(x, 3) OVER w AS g3, x * LAG(x, 4) OVER w AS g4 FROM x WINDOW w AS (PARTITION BY series ORDER BY origin)),
s AS (SELECT series, COUNT(*) AS n, AVG(d) AS m, SUM(x * x) AS g0, SUM(x * x) + 2 * (SUM(g1) + SUM(g2) + SUM(g3) + SUM(g4)) AS gs FROM g GROUP BY 1),
t AS (SELECT series, n, m / sqrt(CASE WHEN gs <= 0 THEN g0 ELSE gs END / n / n) * sqrt((n + 1 - 10 + 5 * 4 / n) / n) AS stat FROM s)
SELECT series, n, ROUND({t_p_sql('stat', '(n - 1)')}, 6) AS p_value FROM t"""))
def rolling_p(spark, d):
    a, _, f = rolling(spark, d)
    s = FC.rolling_dm(FC.rolling_rows(f, a), "linear_trend", "naive")
    return s.select("series", "n", F.round(M_.t_p_value("stat", F.col("n") - 1), 6).alias("p_value"))


@query("h11_overall_scores", sql("macro", ROLL + """,
rk AS (SELECT *, RANK() OVER (PARTITION BY series ORDER BY ROUND(mae, 9)) + (COUNT(*) OVER (PARTITION BY series, ROUND(mae, 9)) - 1) / 2 AS rk FROM rs)
SELECT model, ROUND(exp(AVG(ln(rel_mae))), 6) AS rel_mae, ROUND(AVG(coverage_80), 6) AS coverage_80, ROUND(AVG(quantile_loss), 6) AS quantile_loss,
  ROUND(AVG(rk), 6) AS mean_rank FROM rk GROUP BY 1"""))
def overall(spark, d):
    a, _, f = rolling(spark, d)
    r = FC.score_rolling(FC.rolling_rows(f, a)).withColumn("mae", F.round("mae", 9))
    return FC.overall_scores(r).select("model", *[F.round(c, 6).alias(c) for c in ("rel_mae", "coverage_80", "quantile_loss", "mean_rank")])


@query("h12_future_forecasts", sql("macro", M + "SELECT f.series, h, t, model, ROUND(q50, 8) AS q50 FROM fc f JOIN ends e ON e.series = f.series AND origin = b"))
def future(spark, d):
    a, _, f = forecasts(spark, d)
    return FC.future_forecasts(f, a).select("series", "h", "t", "model", F.round("q50", 8).alias("q50"))


@query("h13_forecast_coverage", sql("macro", ROLL + """
SELECT model, COUNT(*) FILTER (WHERE h = 1) AS tasks_covered, COUNT(*) AS "rows", COUNT(*) FILTER (WHERE q10 > q50 OR q50 > q90) AS disordered,
  (SELECT COUNT(*) FROM tasks) AS tasks, (SELECT CAST(SUM(h) AS BIGINT) FROM tasks) AS rows_expected FROM ff GROUP BY 1"""))
def coverage(spark, d):
    _, t, f = rolling(spark, d)
    return FC.forecast_coverage(f, t, ["series"])

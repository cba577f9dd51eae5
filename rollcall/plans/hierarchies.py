"""Queries: hierarchical series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import ensure_checkpoint_dir, written
from ..operators import hierarchy as H
from . import settings as S
from . import views as V
from .registry import query
from .series import YEARLY
from .sqlviews import sql

MAX_H, FUTURE = 3, 5
GRID = (S.SMOOTHING_ALPHA, S.SMOOTHING_BETA, S.SMOOTHING_PHI)


def cells(spark, d):
    """Cell values by year (one row per unit and year), written out for everything built on them."""
    ensure_checkpoint_dir(spark)
    return H.cell_series(V.cells(spark, d)).checkpoint()


def damped(series, by, h):
    # one row per series after packing: spread the grid work over the cluster's cores
    n = series.sparkSession.sparkContext.defaultParallelism
    return H.damped_trend(series.repartition(n, *by), by, h, *GRID)


def base_at_origins(spark, d):
    """Cells, all series and their base forecasts at every rolling origin."""
    c = cells(spark, d)
    s = H.all_series(c)
    base = damped(H.rolling_origins(s, MAX_H), ["origin", "series", "level", "label"], MAX_H).checkpoint()
    return c, s, base


def errors(spark, d, least_squares=False):
    """Every method on every origin, horizon and series, next to the actual value."""
    c, s, base = base_at_origins(spark, d)
    b = H.long_forecast(base, ["origin", "series", "level", "label"])
    keys = ("origin", "h", "year")
    hist = H.rolling_origins(c, MAX_H)
    parts = {"base": b, "bottom_up": H.bottom_up(b, keys), "top_down": H.top_down(b, hist, keys, ["origin"])}
    cols = ["origin", "h", "year", "series", "level", "value"]
    out = None
    for name, f in parts.items():
        f = f.select(F.lit(name).alias("method"), *cols)
        out = f if out is None else out.unionByName(f)
    if least_squares:
        out = out.unionByName(H.reconcile(base).select("method", *cols))
    actual = s.select("series", "year", F.col("value").alias("actual"))
    return out.withColumnRenamed("value", "forecast").join(actual, ["series", "year"])


def smooth_sql(src: str, out: str, horizon: int) -> str:
    """Damped trend over the grid by recursion on the year; ``src`` has origin, series, year, value."""
    arr = lambda xs: "(" + ", ".join(f"({float(x)!r}, {i})" for i, x in enumerate(xs)) + ")"
    vals = lambda xs: "(VALUES " + arr(xs)[1:-1] + ")"
    nb, nf = len(GRID[1]), len(GRID[2])
    return f"""{out}_n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY origin, series ORDER BY year) AS i, LEAD(value) OVER (PARTITION BY origin, series ORDER BY year) AS nx FROM {src}),
{out}_g AS (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(f AS DOUBLE) AS f, ai * {nb * nf} + bi * {nf} + fi AS pos
  FROM {vals(GRID[0])} AS x(a, ai) CROSS JOIN {vals(GRID[1])} AS y(b, bi) CROSS JOIN {vals(GRID[2])} AS z(f, fi)),
{out}_r AS (
  SELECT origin, series, pos, a, b, f, i, value AS level, COALESCE(nx - value, 0) AS trend, CAST(0 AS DOUBLE) AS sse FROM {out}_n CROSS JOIN {out}_g WHERE i = 1
  UNION ALL
  SELECT r.origin, r.series, pos, a, b, f, n.i, a * n.value + (1 - a) * (r.level + f * trend),
    b * (a * n.value + (1 - a) * (r.level + f * trend) - r.level) + (1 - b) * f * trend, sse + (n.value - r.level - f * trend) * (n.value - r.level - f * trend)
  FROM {out}_r r JOIN {out}_n n ON n.origin = r.origin AND n.series = r.series AND n.i = r.i + 1),
{out}_l AS (SELECT origin, series, MAX(i) AS i, MAX(year) AS last_year FROM {out}_n GROUP BY 1, 2),
{out}_p AS (SELECT r.*, last_year, ROW_NUMBER() OVER (PARTITION BY r.origin, r.series ORDER BY ROUND(sse, 8), pos) AS rn FROM {out}_r r JOIN {out}_l l ON l.origin = r.origin AND l.series = r.series AND l.i = r.i),
{out} AS (SELECT origin, series, a, b, f AS phi, CAST(h AS INT) AS h, CAST(last_year + h AS INT) AS year,
    GREATEST(level + trend * (SELECT SUM(pow(f, j)) FROM range(1, 11) AS q(j) WHERE j <= h), 0) AS value
  FROM {out}_p CROSS JOIN range(1, {horizon + 1}) AS k(h) WHERE rn = 1)"""


CUT = """span AS (SELECT GREATEST(MIN(year) + 4, MAX(year) - 7) AS lo, MAX(year) - 1 AS hi FROM alls),
orig AS (SELECT CAST(unnest(range(lo, hi + 1)) AS INT) AS origin FROM span),
cut AS (SELECT origin, series, level, year, value FROM alls JOIN orig ON year <= origin)"""
WHOLE = "cut AS (SELECT 0 AS origin, series, level, year, value FROM alls)"
LEVEL = "CASE WHEN series LIKE 'cell:%' THEN 'cell' WHEN series LIKE '%:%' THEN split_part(series, ':', 1) ELSE 'national' END"


def totals_sql(src: str, keys: str) -> str:
    """Sum cell rows (sector, ministry, province, value) to every series."""
    return f"""SELECT CASE GROUPING(sector, ministry, province) WHEN 7 THEN 'national' WHEN 3 THEN 'sector:' || sector WHEN 5 THEN 'ministry:' || ministry
    WHEN 6 THEN 'province:' || province ELSE 'cell:' || sector || '|' || ministry || '|' || province END AS series, {keys}, SUM(value) AS value
  FROM {src} GROUP BY GROUPING SETS (({keys}), (sector, {keys}), (ministry, {keys}), (province, {keys}), (sector, ministry, province, {keys}))"""


PARTS = "split_part(substr(series, 6), '|', 1) AS sector, split_part(substr(series, 6), '|', 2) AS ministry, split_part(substr(series, 6), '|', 3) AS province"
METHODS = f"""bcells AS (SELECT origin, h, year, {PARTS}, value FROM sm WHERE series LIKE 'cell:%'),
bu AS ({totals_sql('bcells', 'origin, h, year')}),
share AS (SELECT g.origin, sector, ministry, province, AVG(value / tot) AS s FROM (SELECT o.origin, c.*, SUM(c.value) OVER (PARTITION BY o.origin, c.year) AS tot
    FROM cell_grid c JOIN orig o ON c.year <= o.origin) g GROUP BY 1, 2, 3, 4),
tcells AS (SELECT s.origin, h, year, sector, ministry, province, s.s * value AS value FROM share s JOIN sm ON sm.origin = s.origin AND sm.series = 'national'),
td AS ({totals_sql('tcells', 'origin, h, year')}),
err AS (SELECT m.method, m.origin, m.h, m.year, m.series, {LEVEL.replace('series', 'm.series')} AS level, m.value AS forecast, a.value AS actual FROM (
    SELECT 'base' AS method, origin, h, year, series, value FROM sm UNION ALL SELECT 'bottom_up', origin, h, year, series, value FROM bu
    UNION ALL SELECT 'top_down', origin, h, year, series, value FROM td) m JOIN alls a ON a.series = m.series AND a.year = m.year)
"""
BACK = f"WITH {YEARLY}, {CUT}, {smooth_sql('cut', 'sm', MAX_H)}, {METHODS}"
AHEAD = f"WITH {YEARLY}, {WHOLE}, {smooth_sql('cut', 'sm', FUTURE)}"


@query("i01_cell_series", sql("cells", f"WITH {YEARLY} SELECT sector, ministry, province, year, ROUND(value, 9) AS value FROM cell_grid"))
def cell_series(spark, d):
    return H.cell_series(V.cells(spark, d)).withColumn("value", F.round("value", 9))


@query("i02_all_series", sql("cells", f"WITH {YEARLY} SELECT series, level, year, ROUND(value, 9) AS value FROM alls"))
def all_series(spark, d):
    return H.all_series(H.cell_series(V.cells(spark, d))).select("series", "level", "year", F.round("value", 9).alias("value"))


@query("i03_damped_trend", sql("cells", AHEAD + "SELECT series, h, year, ROUND(value, 6) AS value FROM sm"))
def damped_trend(spark, d):
    base = damped(H.all_series(cells(spark, d)), ["series"], FUTURE)
    return H.long_forecast(base, ["series"]).withColumn("value", F.round("value", 6))


def chosen(method):
    return BACK + f"SELECT origin, h, series, ROUND(forecast, 7) AS forecast, ROUND(actual, 9) AS actual FROM err WHERE method = '{method}'"


def one_method(spark, d, method):
    e = errors(spark, d).where(F.col("method") == method)
    return e.select("origin", "h", "series", F.round("forecast", 7).alias("forecast"), F.round("actual", 9).alias("actual"))


@query("i04_bottom_up", sql("cells", chosen("bottom_up")))
def bottom_up(spark, d):
    return one_method(spark, d, "bottom_up")


@query("i05_top_down", sql("cells", chosen("top_down")))
def top_down(spark, d):
    return one_method(spark, d, "top_down")


@query("i06_reconcile")
def reconcile(spark, d):
    _, _, base = base_at_origins(spark, d)
    return H.reconcile(base, ("ols", "wls_struct", "wls_var"))


SHAPE = f"""WITH {YEARLY}, {CUT},
nn AS (SELECT origin, COUNT(DISTINCT series) FILTER (WHERE level <> 'cell') AS totals, COUNT(DISTINCT series) FILTER (WHERE level = 'cell') AS cells FROM cut GROUP BY 1)
SELECT method, origin, CAST(h AS INT) AS h, totals, cells, CAST(0 AS DOUBLE) AS gap"""


@query("i06_normal_equations", sql("cells", SHAPE + """, CAST(0 AS DOUBLE) AS residual
FROM nn CROSS JOIN range(1, 4) AS r(h) CROSS JOIN (VALUES ('ols'), ('wls_struct'), ('wls_var')) AS v(method)"""))
def normal_equations(spark, d):
    """Totals add up and S' W^-1 (base - coherent) vanishes: only the least-squares answer does both."""
    _, _, base = base_at_origins(spark, d)
    methods = ("ols", "wls_struct", "wls_var")
    coherent = written(H.reconcile(base, methods))
    out = None
    for m in methods:
        c = H.reconciliation_check(base, coherent.where(F.col("method") == m), m).withColumn("method", F.lit(m))
        out = c if out is None else out.unionByName(c)
    return out.select("method", "origin", "h", "totals", "cells", F.round("gap", 6).alias("gap"), F.round("residual", 6).alias("residual"))


@query("i07_mint_coherence", sql("cells", SHAPE + " FROM nn CROSS JOIN range(1, 4) AS r(h) CROSS JOIN (VALUES ('mint_shrink')) AS v(method)"))
def mint_coherence(spark, d):
    _, _, base = base_at_origins(spark, d)
    c = H.reconciliation_check(base, H.reconcile(base, ("mint_shrink",)), "ols")
    return c.select(F.lit("mint_shrink").alias("method"), "origin", "h", "totals", "cells", F.round("gap", 6).alias("gap"))


@query("i07_mint_shrink")
def mint(spark, d):
    _, _, base = base_at_origins(spark, d)
    return H.reconcile(base, ("mint_shrink",))


@query("i08_hierarchy_backtest", sql("cells", BACK + "SELECT method, origin, h, series, level, ROUND(forecast, 7) AS forecast, ROUND(actual, 9) AS actual FROM err"))
def backtest(spark, d):
    return errors(spark, d).select("method", "origin", "h", "series", "level", F.round("forecast", 7).alias("forecast"), F.round("actual", 9).alias("actual"))


@query("i08_backtest_all_methods")
def backtest_all(spark, d):
    return H.wape_summary(errors(spark, d, least_squares=True))


@query("i09_wape", sql("cells", BACK + "SELECT method, level, h, ROUND(SUM(abs(forecast - actual)) / SUM(actual) * 100, 6) AS wape FROM err GROUP BY 1, 2, 3"))
def wape(spark, d):
    return H.wape_by(errors(spark, d), ["method", "level", "h"]).withColumn("wape", F.round("wape", 6))


WIDE = """,
wl AS (SELECT method, level, SUM(abs(forecast - actual)) / SUM(actual) * 100 AS w FROM err GROUP BY 1, 2),
ws AS (SELECT method, """ + ", ".join(f"MAX(w) FILTER (WHERE level = '{lv}') AS {lv}" for lv in H.LEVELS) + ", SUM(w) / 5 AS average FROM wl GROUP BY 1)\n"


@query("i09_wape_summary", sql("cells", BACK + WIDE + "SELECT method, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in (*H.LEVELS, "average")) + " FROM ws"))
def summary(spark, d):
    return H.wape_summary(errors(spark, d)).withColumns({c: F.round(c, 6) for c in (*H.LEVELS, "average")})


@query("i10_coherence_gap", sql("cells", BACK + """,
pt AS (SELECT level, origin, h, SUM(forecast) AS p FROM err WHERE method = 'base' AND level <> 'national' GROUP BY 1, 2, 3)
SELECT pt.level, ROUND(AVG(abs(p - n.forecast) / n.forecast) * 100, 6) AS gap FROM pt JOIN err n ON n.method = 'base' AND n.level = 'national' AND n.origin = pt.origin AND n.h = pt.h GROUP BY 1"""))
def gap(spark, d):
    return H.coherence_gap(errors(spark, d)).withColumn("gap", F.round("gap", 6))


@query("i11_pick_method", sql("cells", BACK + WIDE + "SELECT 'smoothing' AS base_model, arg_min(method, average) AS method FROM ws WHERE method <> 'base'"))
def pick(spark, d):
    return H.pick_method(H.wape_summary(errors(spark, d)).withColumn("base_model", F.lit("smoothing")))


FUT = f"""{AHEAD},
bcells AS (SELECT h, year, {PARTS}, value FROM sm WHERE series LIKE 'cell:%'),
bu AS ({totals_sql('bcells', 'h, year')}),
fut AS (SELECT 'history' AS kind, series, year, value FROM alls UNION ALL SELECT 'base', series, year, value FROM sm UNION ALL SELECT 'forecast', series, year, value FROM bu)
"""


def future(spark, d):
    """History, base and bottom-up forecasts in one long table."""
    s = H.all_series(cells(spark, d))
    b = H.long_forecast(damped(s, ["series", "level", "label"], FUTURE), ["series", "level", "label"])
    f = H.bottom_up(b, ("h", "year"))
    cols = ["series", "level", "label", "year", "value"]
    return (s.select(F.lit("history").alias("kind"), *cols).unionByName(b.select(F.lit("base").alias("kind"), *cols))
            .unionByName(f.select(F.lit("forecast").alias("kind"), *cols)))


@query("i12_hierarchy_forecast", sql("cells", FUT + f"SELECT kind, series, {LEVEL} AS level, year, ROUND(value, 9) AS value FROM fut"))
def forecast(spark, d):
    return future(spark, d).select("kind", "series", "level", "year", F.round("value", 9).alias("value"))


@query("i13_win_rates", sql("cells", BACK + """,
w AS (SELECT origin, h, series, MAX(abs(forecast - actual)) FILTER (WHERE method = 'bottom_up') AS m, MAX(abs(forecast - actual)) FILTER (WHERE method = 'base') AS b,
  MAX(abs(forecast - actual)) FILTER (WHERE method = 'top_down') AS t FROM err GROUP BY 1, 2, 3)
SELECT 'base' AS against, ROUND(AVG(CASE WHEN m < b THEN 1.0 ELSE 0.0 END), 8) AS win_rate FROM w
UNION ALL SELECT 'top_down', ROUND(AVG(CASE WHEN m < t THEN 1.0 ELSE 0.0 END), 8) FROM w"""))
def wins(spark, d):
    return H.win_rates(errors(spark, d), "bottom_up", ("base", "top_down")).withColumn("win_rate", F.round("win_rate", 8))


@query("i14_saved_base", sql("cells", f"""
WITH {YEARLY}, sv AS (SELECT 'last' AS model, series, year AS origin, CAST(k AS INT) AS h, value * (1 + 0.01 * k) AS value FROM alls CROSS JOIN range(1, 4) AS r(k)),
re AS (SELECT o.series, s.origin + 1 AS year, o.value - s.value AS r FROM sv s JOIN alls o ON o.series = s.series AND o.year = s.origin + 1 WHERE s.h = 1),
og AS (SELECT DISTINCT series, origin FROM sv)
SELECT g.series, g.origin, COUNT(r.r) AS residuals, ROUND(SUM(r.r * r.r), 6) AS ss, ROUND((SELECT value FROM sv WHERE sv.series = g.series AND sv.origin = g.origin AND h = 3), 6) AS f3
FROM og g LEFT JOIN re r ON r.series = g.series AND r.year <= g.origin GROUP BY 1, 2"""))
def saved(spark, d):
    s = H.all_series(cells(spark, d))
    sv = s.select(F.lit("last").alias("model"), "series", F.col("year").alias("origin"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("h"),
                  "value").withColumn("value", F.col("value") * (1 + 0.01 * F.col("h")))
    b = H.saved_base(sv, s)
    n = F.size("residual").cast("bigint")
    ss = F.when(n > 0, F.aggregate("residual", F.lit(0.0), lambda a, x: a + x * x))
    return b.select("series", "origin", n.alias("residuals"), F.round(ss, 6).alias("ss"), F.round(F.element_at("forecast", 3), 6).alias("f3"))


YEARS = list(range(2000, 2006))


@query("i15_unit_forecast_table", sql("cells", FUT + """,
rows AS (SELECT split_part(series, ':', 2) AS label, year, value FROM fut WHERE kind IN ('history', 'forecast') AND series LIKE 'ministry:%' AND year >= 2000),
tot AS (SELECT * FROM rows UNION ALL SELECT 'all units', year, SUM(value) FROM rows GROUP BY year
  UNION ALL SELECT 'national', year, value FROM fut WHERE kind IN ('history', 'forecast') AND series = 'national' AND year >= 2000),
w AS (SELECT label, """ + ", ".join(f"MAX(value) FILTER (WHERE year = {y}) AS y{y}" for y in YEARS) + """ FROM tot GROUP BY 1)
SELECT label, """ + ", ".join(f"ROUND(y{y}, 9) AS y{y}" for y in YEARS) + """, ROUND(y2005 / NULLIF(y2000, 0) - 1, 9) AS growth,
  ROUND(pow(y2005 / NULLIF(y2000, 0), 1 / 5) - 1, 9) AS yearly_growth FROM w"""))
def unit_table(spark, d):
    f = future(spark, d).where("kind <> 'base' and year >= 2000")
    t = H.unit_forecast_table(f, "ministry", YEARS)
    return t.select("label", *[F.round(c, 9).alias(c) for c in t.columns if c != "label"])

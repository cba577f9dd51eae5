"""Queries: exit waves by unit."""

from __future__ import annotations

from math import factorial

from pyspark.sql import functions as F

from ..functions.keys import ensure_checkpoint_dir
from ..operators import panel as P
from ..operators import waves as W
from ..operators.metrics import wape
from ..sources.tables import table
from . import settings as S
from . import views as V
from .panels import RISK, life
from .registry import query
from .sqlviews import sql

YEARS, HORIZON = 20, 10

CELLS = """cells_now AS (SELECT province, ministry, sector, framework, eligible60, age, service, COUNT(*) AS n FROM panel
  WHERE year = (SELECT MAX(year) FROM panel) AND age BETWEEN 18 AND 65 AND service BETWEEN 0 AND 47 GROUP BY ALL)"""


def paths_sql(cells: str, hz: str, join: str, years: int, out: str) -> str:
    cols = "province, ministry, sector, framework, eligible60, age, service"
    return f"""{out}_r AS (SELECT c.*, CAST(k AS INT) AS t, CASE WHEN c.age + k >= CASE WHEN c.eligible60 THEN 60 ELSE 55 END THEN 1.0
    ELSE qx + (1 - qx) * {hz} END AS p
  FROM {cells} c CROSS JOIN range({years}) AS r(k) JOIN life ON life.age = LEAST(GREATEST(c.age + k, 18), 65) {join}),
{out} AS (SELECT {cols}, n, t, n * p * COALESCE(product(1 - p) OVER (PARTITION BY {cols} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS exits
  FROM {out}_r)"""


HZ = "CASE WHEN LEAST(GREATEST(c.age + k, 18), 65) - LEAST(c.service + k, 47) < 18 THEN 0 ELSE COALESCE(rate, o) END"
HZ_JOIN = "CROSS JOIN overall LEFT JOIN rates ON rates.sector = c.sector AND band = LEAST(GREATEST(c.age + k, 18), 65) // 5 * 5"
EXITS = RISK + "," + CELLS + "," + paths_sql("cells_now", HZ, HZ_JOIN, YEARS, "ex")


def hazard_from(train):
    """Separation hazard by sector and age band, zero for impossible careers."""
    def add(df):
        rates = P.cohort_rates(train).withColumnRenamed("band", "_band")
        overall = train.agg(F.avg("y")).scalar()
        h = F.when(F.col("age_t") - F.col("service_t") < 18, 0.0).otherwise(F.coalesce("rate", overall))
        return (df.withColumn("_band", (F.floor(F.col("age_t") / 5) * 5).cast("int")).join(rates, ["sector", "_band"], "left")
                .withColumn("h", h).drop("_band", "rate"))
    return add


def setup(spark, d):
    ensure_checkpoint_dir(spark)
    p = V.panel(spark, d).checkpoint()
    train = P.temporal_split(P.at_risk(p), 4).where("part = 'train'")
    return p, train


def wave_exits(spark, d):
    """Cells of the last panel year and their exits over twenty years, written out for the tables built on them."""
    p, train = setup(spark, d)
    last = p.agg(F.max("year")).scalar()
    cells = W.unit_cells(p.where(F.col("year") == last))
    ex = W.exit_paths(cells, YEARS, lambda t: F.lit(55), hazard_from(train), life(spark)).checkpoint()
    return cells, ex


@query("g01_unit_cells", sql("panel", f"WITH {CELLS} SELECT * FROM cells_now"))
def cells(spark, d):
    p = V.panel(spark, d)
    return W.unit_cells(p.where(F.col("year") == p.agg(F.max("year")).scalar()))


@query("g02_exit_paths", sql("panel life", EXITS + """
SELECT province, ministry, sector, framework, eligible60, age, service, t, ROUND(exits, 8) AS exits FROM ex"""))
def exit_paths(spark, d):
    return wave_exits(spark, d)[1].drop("n").withColumn("exits", F.round("exits", 8))


WAVE = EXITS + f""",
nat AS (SELECT SUM(exits) FILTER (WHERE t < {HORIZON}) AS x, (SELECT SUM(n) FROM cells_now) AS staff FROM ex),
base AS (SELECT ministry, CAST(SUM(n) AS BIGINT) AS staff, SUM(n * age) / SUM(n) AS mean_age, SUM(CASE WHEN age >= 50 THEN n ELSE 0 END) / SUM(n) AS old FROM cells_now GROUP BY 1),
uy AS (SELECT ministry, t, SUM(exits) / MAX(staff) AS rate FROM ex JOIN base USING (ministry) GROUP BY 1, 2),
u AS (SELECT ministry, SUM(rate) FILTER (WHERE t < 5) AS leave_5y, SUM(rate) FILTER (WHERE t < {HORIZON}) AS leave_h,
    arg_max({S.BASE_YEAR} + t, rate) FILTER (WHERE t < {HORIZON}) AS peak_year, MAX(rate) FILTER (WHERE t < {HORIZON}) AS peak_rate,
    MIN(CASE WHEN t < {HORIZON} AND rate >= 1.5 * x / nat.staff / {HORIZON} THEN {S.BASE_YEAR} + t END) AS wave_start,
    COUNT(CASE WHEN t < {HORIZON} AND rate >= 1.5 * x / nat.staff / {HORIZON} THEN 1 END) AS wave_years,
    SUM(rate) FILTER (WHERE t < {HORIZON}) / MAX(x / nat.staff) AS vs_national FROM uy, nat GROUP BY 1)
"""


@query("g03_unit_wave_table", sql("panel life", WAVE + """
SELECT ministry, staff, ROUND(mean_age, 6) AS mean_age, ROUND(old, 6) AS aged_50_plus, ROUND(leave_5y, 6) AS leave_5y, ROUND(leave_h, 6) AS leave_h,
  peak_year, ROUND(peak_rate, 6) AS peak_rate, wave_start, wave_years, ROUND(vs_national, 6) AS vs_national,
  CASE WHEN staff < 30 THEN 'few_staff' WHEN vs_national >= 1.25 THEN 'high' WHEN vs_national >= 1.1 THEN 'watch' ELSE 'normal' END AS tier
FROM u JOIN base USING (ministry)"""))
def wave_table(spark, d):
    t = W.unit_wave_table(wave_exits(spark, d)[1], ["ministry"], HORIZON, S.BASE_YEAR)
    return t.withColumns({c: F.round(c, 6) for c in ("mean_age", "aged_50_plus", "leave_5y", "leave_h", "peak_rate", "vs_national")})


@query("g04_wave_heat", sql("panel life", WAVE + """,
top AS (SELECT ministry FROM u ORDER BY vs_national DESC, ministry LIMIT 15)
SELECT ministry, """ + ", ".join(f"ROUND(MAX(rate) FILTER (WHERE t = {i}), 6) AS y{i}" for i in range(HORIZON)) + """
FROM uy JOIN top USING (ministry) GROUP BY 1"""))
def heat(spark, d):
    _, ex = wave_exits(spark, d)
    h = W.wave_heat(ex, W.unit_wave_table(ex, ["ministry"], HORIZON, S.BASE_YEAR), "ministry", HORIZON, 15)
    return h.withColumns({f"y{i}": F.round(f"y{i}", 6) for i in range(HORIZON)})


def shapley_sql(src: str, feats: list[str], out: str) -> str:
    """CUBE over the features, then the weighted sum of set worths per combination."""
    k = len(feats)
    plus = "CASE k - bit_count(g) " + " ".join(
        f"WHEN {s} THEN {factorial(s - 1) * factorial(k - s) / factorial(k)!r}" for s in range(1, k + 1)) + " END"
    minus = "CASE k - bit_count(g) " + " ".join(
        f"WHEN {s} THEN {-factorial(s) * factorial(k - s - 1) / factorial(k)!r}" for s in range(k)) + " END"
    plus, minus = plus.replace("k -", f"{k} -"), minus.replace("k -", f"{k} -")
    bit = {f: 1 << (k - 1 - i) for i, f in enumerate(feats)}
    on = " AND ".join(f"(g & {bit[f]} <> 0 OR w.{f} = c.{f})" for f in feats)
    cols = ", ".join(feats)
    phi = ", ".join(f"SUM(CASE WHEN g & {bit[f]} = 0 THEN {plus} ELSE {minus} END * v) AS phi_{f}" for f in feats)
    return f"""{out}_c AS (SELECT {cols}, SUM(y * n) / SUM(n) AS y, SUM(n) AS n FROM {src} GROUP BY {cols}),
{out}_w AS (SELECT GROUPING({cols}) AS g, {cols}, SUM(y * n) / SUM(n) AS v FROM {out}_c GROUP BY CUBE ({cols})),
{out} AS (SELECT {', '.join('c.' + f for f in feats)}, MAX(c.y) AS y, MAX(c.n) AS n, {phi} FROM {out}_c c JOIN {out}_w w ON {on} GROUP BY {', '.join('c.' + f for f in feats)})"""


FEATS = ["sector", "framework", "eligible60", "age", "service"]


@query("g05_explain_gap", sql("panel life", EXITS + f""",
gone AS (SELECT province, ministry, sector, framework, eligible60, age, service, MAX(n) AS n, SUM(exits) / MAX(n) AS y FROM ex WHERE t < {HORIZON} GROUP BY 1, 2, 3, 4, 5, 6, 7),
{shapley_sql('gone', FEATS, 'phi')}
SELECT province, """ + ", ".join(f"ROUND(SUM(phi_{f} * c.n) / SUM(c.n) * 100, 6) AS {f}" for f in FEATS) + """
FROM cells_now c JOIN phi USING (sector, framework, eligible60, age, service) GROUP BY 1"""))
def explain(spark, d):
    c, ex = wave_exits(spark, d)
    return W.explain_gap(c, ex, ["province"], HORIZON).select("province", *[F.round(f, 6).alias(f) for f in FEATS])


LEVEL = ["province", "sector"]
TEST = RISK + """,
org AS (SELECT MAX(year) - 4 AS o4 FROM panel),
stay AS (SELECT person_id, province, ministry, sector, framework, eligible60, age + 1 AS age, service + 1 AS service FROM panel, org WHERE year = o4 AND NOT "exit"),
cells_then AS (SELECT province, ministry, sector, framework, eligible60, age, service, COUNT(*) AS n FROM stay
  WHERE age BETWEEN 18 AND 65 AND service BETWEEN 0 AND 47 GROUP BY ALL),
past AS (SELECT province, sector, AVG(CASE WHEN "exit" THEN 1.0 ELSE 0.0 END) AS er,
  AVG(CASE WHEN exit_type NOT IN ('retirement', 'death') THEN CASE WHEN exit_type = 'separation' THEN 1.0 ELSE 0.0 END END) AS sr
  FROM panel, org WHERE year <= o4 AND year > o4 - 5 GROUP BY 1, 2),
act AS (SELECT province, sector, year - o4 - 1 AS t, COUNT(*) AS actual FROM panel, org WHERE year > o4 AND "exit" AND person_id IN (SELECT person_id FROM stay) GROUP BY 1, 2, 3),
""" + paths_sql("cells_then", HZ, HZ_JOIN, 4, "m") + "," + paths_sql(
    "cells_then", "sr", "JOIN past ON past.province = c.province AND past.sector = c.sector", 4, "a") + """,
un AS (SELECT province, sector, SUM(n) AS n FROM cells_then GROUP BY 1, 2),
cf AS (SELECT province, sector, CAST(k AS INT) AS t, n * er * pow(1 - er, k) AS past_rate FROM un JOIN past USING (province, sector) CROSS JOIN range(4) AS r(k)),
mm AS (SELECT province, sector, t, SUM(exits) AS model FROM m GROUP BY 1, 2, 3), aa AS (SELECT province, sector, t, SUM(exits) AS rule_plus_avg FROM a GROUP BY 1, 2, 3),
bt AS (SELECT province, sector, t, COALESCE(actual, 0) AS actual, model, past_rate, rule_plus_avg
  FROM mm JOIN aa USING (province, sector, t) JOIN cf USING (province, sector, t) LEFT JOIN act USING (province, sector, t))
"""


def backtest_cells(spark, d):
    p, train = setup(spark, d)
    origin = p.agg(F.max("year") - 4).scalar()
    staff = p.where((F.col("year") == origin) & ~F.col("exit")).withColumns({"age": F.col("age") + 1, "service": F.col("service") + 1})
    then = W.unit_cells(staff).checkpoint()
    rates = W.rate_backtest(p, origin, LEVEL).checkpoint()
    def unit_hazard(df):
        return df.join(rates.select(*LEVEL, F.col("separation_rate").alias("h")), LEVEL)
    def expected(hazard, out):
        ex = W.exit_paths(then, 4, lambda t: F.lit(55), hazard, life(spark))
        return ex.groupBy(*LEVEL, "t").agg(F.sum("exits").alias(out))
    on = [*LEVEL, "t"]
    return (expected(hazard_from(train), "model").join(expected(unit_hazard, "rule_plus_avg"), on)
            .join(W.carried_forward(then, rates, LEVEL, 4), on)
            .join(W.actual_exits(p, staff, origin, LEVEL), on, "left").withColumn("actual", F.coalesce("actual", F.lit(0))))


MODELS = ("model", "past_rate", "rule_plus_avg")


@query("g06_wave_backtest", sql("panel life", TEST + "SELECT province, sector, t, actual, " + ", ".join(f"ROUND({m}, 6) AS {m}" for m in MODELS) + " FROM bt"))
def backtest(spark, d):
    return backtest_cells(spark, d).select(*LEVEL, "t", "actual", *[F.round(m, 6).alias(m) for m in MODELS])


@query("g06_backtest_scores", sql("panel life", TEST + "SELECT " + ", ".join(
    f"ROUND(SUM(abs({m} - actual)) / SUM(actual) * 100, 6) AS wape_{m}" for m in MODELS) + " FROM bt"))
def backtest_scores(spark, d):
    return backtest_cells(spark, d).agg(*[F.round(wape("actual", m), 6).alias(f"wape_{m}") for m in MODELS])


@query("g07_match_unit", sql("", """
WITH nm AS (SELECT CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN 'Province ' || lower(n_name) WHEN 2 THEN replace(n_name, '_', '-')
    WHEN 3 THEN 'the ' || n_name || ' office' ELSE 'zone ' || c_mktsegment END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
ds AS (SELECT DISTINCT name, trim(regexp_replace(lower(name), 'province|ministry of', '', 'g')) AS n FROM nm),
pr AS (SELECT name, n_name, CASE WHEN n = lower(n_name) THEN 3.0 WHEN n <> '' AND (contains(lower(n_name), n) OR contains(n, lower(n_name))) THEN 2.0
    WHEN 1 - levenshtein(n, lower(n_name)) / GREATEST(length(n), length(n_name), 1) >= 0.7 THEN 1 - levenshtein(n, lower(n_name)) / GREATEST(length(n), length(n_name), 1) END AS rank
  FROM ds CROSS JOIN nation),
bs AS (SELECT name, n_name, ROW_NUMBER() OVER (PARTITION BY name ORDER BY rank DESC NULLS LAST, n_name) AS rn, rank FROM pr)
SELECT name, CASE WHEN rank IS NOT NULL THEN n_name END AS unit FROM bs WHERE rn = 1"""))
def match(spark, d):
    k = F.col("c_custkey") % 5
    n = F.col("n_name")
    names = (table(spark, d, "customer").join(V._units(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.when(k == 0, n).when(k == 1, F.concat(F.lit("Province "), F.lower(n))).when(k == 2, F.replace(n, F.lit("_"), F.lit("-")))
        .when(k == 3, F.concat(F.lit("the "), n, F.lit(" office"))).otherwise(F.concat(F.lit("zone "), "c_mktsegment")).alias("name")))
    return W.match_unit(names, table(spark, d, "nation"), "name", "n_name")

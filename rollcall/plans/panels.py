"""Queries: staff panel, exit models and cohort roll-forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import bounded, ensure_checkpoint_dir, with_parameters
from ..operators import panel as P
from . import settings as S
from . import views as V
from .registry import query
from .sqlviews import Q_AGE, sql, t_p_sql

SECTORS = tuple(S.ALLOWANCE)
ELIGIBLE_SHARE = 0.12


def hash_sql(expr: str, salt: str = "") -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {expr}, '{salt}')), 1, 8) AS BIGINT) / 4294967296.0)"


RISK = """WITH risk AS (SELECT *, CASE WHEN exit_type = 'separation' THEN 1 ELSE 0 END AS y, age // 5 * 5 AS band,
    (SELECT MAX(year) - 4 FROM panel) AS origin FROM panel WHERE exit_type NOT IN ('retirement', 'death')),
rates AS (SELECT sector, band, AVG(y) AS rate FROM risk WHERE year <= origin GROUP BY 1, 2),
overall AS (SELECT AVG(y) AS o FROM risk WHERE year <= origin),
scored AS (SELECT r.*, COALESCE(rate, o) AS cohort_ratio FROM risk r LEFT JOIN rates USING (sector, band), overall WHERE year > origin)
"""


def split(spark, d):
    """The panel, written once because training and scoring read it several times, and its two parts: no year at risk is left out."""
    ensure_checkpoint_dir(spark)
    p = V.panel(spark, d).checkpoint()
    s = P.temporal_split(P.at_risk(p), 4)
    return p, s.where("part = 'train'"), s.where("part = 'test'")


@query("d01_hazard_features", sql("panel", """
SELECT year, CAST(SUM(age) AS DOUBLE) AS age, CAST(SUM(CASE WHEN eligible60 THEN 1 ELSE 0 END) AS DOUBLE) AS eligible60,
  CAST(COUNT(*) FILTER (WHERE sector = 'AFRICA') AS DOUBLE) AS sector_0, CAST(COUNT(*) FILTER (WHERE sector = 'ASIA') AS DOUBLE) AS sector_2,
  CAST(COUNT(*) FILTER (WHERE framework = 'A') AS DOUBLE) AS fw_a, CAST(COUNT(*) FILTER (WHERE framework = 'D') AS DOUBLE) AS fw_d
FROM panel GROUP BY 1"""))
def features(spark, d):
    f = P.hazard_features(V.panel(spark, d), SECTORS, S.FRAMEWORKS)
    return f.groupBy("year").agg(F.sum("x_age").alias("age"), F.sum("x_eligible60").alias("eligible60"),
                                 F.sum("x_sector_0").alias("sector_0"), F.sum("x_sector_2").alias("sector_2"),
                                 F.sum("x_fw_A").alias("fw_a"), F.sum("x_fw_D").alias("fw_d"))


@query("d02_at_risk", sql("panel", """
SELECT sector, year, COUNT(*) AS n, COUNT(*) FILTER (WHERE exit_type = 'separation') AS separations
FROM panel WHERE exit_type NOT IN ('retirement', 'death') GROUP BY 1, 2"""))
def at_risk(spark, d):
    return P.at_risk(V.panel(spark, d)).groupBy("sector", "year").agg(F.count("*").alias("n"), F.sum("y").alias("separations"))


@query("d03_kaplan_meier", sql("panel", """
WITH f AS (SELECT person_id, arg_min(sector, year) AS sector, arg_min(service, year) AS s0, arg_max(service, year) + 1 AS dur,
    arg_max(exit_type, year) = 'separation' AS ev FROM panel GROUP BY 1),
p AS (SELECT * FROM f WHERE s0 = 0),
spine AS (SELECT sector, CAST(unnest(range(1, MAX(dur) + 1)) AS INT) AS t FROM p GROUP BY sector),
c AS (SELECT s.sector, s.t, (SELECT COUNT(*) FROM p WHERE p.sector = s.sector AND dur >= s.t) AS at_risk,
    (SELECT COUNT(*) FROM p WHERE p.sector = s.sector AND dur = s.t AND ev) AS events FROM spine s)
SELECT sector, t AS service_years, at_risk,
  ROUND(product(1 - events / at_risk) OVER (PARTITION BY sector ORDER BY t), 8) AS survival FROM c"""))
def km(spark, d):
    return P.kaplan_meier(V.panel(spark, d)).withColumn("survival", F.round("survival", 8))


@query("d04_cohort_ratio", sql("panel", RISK + """
SELECT person_id, year, y, ROUND(cohort_ratio, 8) AS cohort_ratio FROM scored"""))
def cohort(spark, d):
    _, train, test = split(spark, d)
    return P.cohort_ratio(train, test).select("person_id", "year", "y", F.round("cohort_ratio", 8).alias("cohort_ratio"))


@query("d05_logit_hazard")
def logit(spark, d):
    _, train, test = split(spark, d)
    return (P.logit_hazard(train, SECTORS, S.FRAMEWORKS)(test).groupBy("year", "sector")
            .agg(F.sum("y").alias("actual"), F.sum("logit_hazard").alias("expected")))


@query("d06_gbt_hazard")
def gbt(spark, d):
    _, train, test = split(spark, d)
    return (P.gbt_hazard(train, SECTORS, S.FRAMEWORKS)(test).groupBy("year", "sector")
            .agg(F.sum("y").alias("actual"), F.sum("gbt_hazard").alias("expected")))


MATRIX = """stay AS (SELECT framework, AVG(CASE WHEN promoted THEN 1.0 ELSE 0.0 END) AS p FROM panel WHERE NOT "exit" GROUP BY 1),
ups AS (SELECT f, up, CASE WHEN up IS NULL THEN 0.0 ELSE COALESCE(p, 0) END AS p
  FROM (VALUES ('A', NULL), ('B', 'A'), ('C', 'B'), ('D', 'C')) AS o(f, up) LEFT JOIN stay ON f = framework)"""


@query("d07_transition_matrix", sql("panel", "WITH " + MATRIX + """
SELECT f AS from_fw, f AS to_fw, ROUND(1 - p, 8) AS p FROM ups UNION ALL SELECT f, up, ROUND(p, 8) FROM ups WHERE up IS NOT NULL"""))
def matrix(spark, d):
    return P.transition_matrix(V.panel(spark, d), S.FRAMEWORKS).withColumn("p", F.round("p", 8))


@query("d08_temporal_split", sql("panel", f"""
SELECT year, CASE WHEN year > (SELECT MAX(year) - 4 FROM panel) THEN 'test'
  WHEN {hash_sql('person_id, year')} < 0.5 THEN 'train' END AS part, COUNT(*) AS n FROM panel GROUP BY 1, 2"""))
def temporal(spark, d):
    return P.temporal_split(V.panel(spark, d), 4, 0.5).groupBy("year", "part").agg(F.count("*").alias("n"))


CELLS = RISK + """,
cells AS (SELECT year, sector, SUM(y) AS actual, SUM(cohort_ratio) AS cohort_ratio FROM scored GROUP BY 1, 2),
other AS (SELECT year, sector, COUNT(*) AS other FROM panel WHERE exit_type IN ('retirement', 'death') GROUP BY 1, 2),
b AS (SELECT c.*, COALESCE(other, 0) AS other FROM cells c LEFT JOIN other USING (year, sector))
"""


@query("d09_hazard_backtest", sql("panel", CELLS + """
SELECT year, sector, CAST(actual AS BIGINT) AS actual, ROUND(cohort_ratio, 6) AS cohort_ratio, other FROM b"""))
def backtest(spark, d):
    p, train, test = split(spark, d)
    return P.hazard_backtest(p, P.cohort_ratio(train, test), ["cohort_ratio"]).withColumn("cohort_ratio", F.round("cohort_ratio", 6))


@query("d09_backtest_scores", sql("panel", CELLS + """
SELECT 'cohort_ratio' AS model, ROUND(AVG(abs((cohort_ratio - actual) / NULLIF(actual, 0))) * 100, 6) AS separations_mape,
  ROUND(sqrt(AVG((cohort_ratio - actual) * (cohort_ratio - actual))), 6) AS separations_rmse,
  ROUND(AVG(abs((cohort_ratio - actual) / NULLIF(actual + other, 0))) * 100, 6) AS all_exits_mape FROM b"""))
def scores(spark, d):
    p, train, test = split(spark, d)
    cells = P.hazard_backtest(p, P.cohort_ratio(train, test), ["cohort_ratio"])
    s = P.backtest_scores(cells, ["cohort_ratio"], "cohort_ratio")
    return s.select("model", *[F.round(c, 6).alias(c) for c in ("separations_mape", "separations_rmse", "all_exits_mape")])


@query("d09_backtest_p_values", sql("panel", RISK + f""",
cells AS (SELECT year, sector, SUM(y) AS actual, SUM(cohort_ratio) AS cohort_ratio, SUM((SELECT o FROM overall)) AS overall_mean FROM scored GROUP BY 1, 2),
e AS (SELECT (cohort_ratio - actual) * (cohort_ratio - actual) - (overall_mean - actual) * (overall_mean - actual) AS d FROM cells),
s AS (SELECT COUNT(*) AS n, AVG(d) / sqrt(var_samp(d) / COUNT(*)) AS dm FROM e)
SELECT 'overall_mean' AS model, ROUND(dm, 6) AS dm_vs_baseline, ROUND({t_p_sql('dm', '(n - 1)')}, 6) AS p_value FROM s"""))
def backtest_p(spark, d):
    """The mean rate of all against the cohort rates, with the p-value of the difference."""
    p, train, test = split(spark, d)
    scored = P.cohort_ratio(train, test).withColumn("overall_mean", train.agg(F.avg("y")).scalar())
    s = P.backtest_scores(P.hazard_backtest(p, scored, ["cohort_ratio", "overall_mean"]), ["overall_mean"], "cohort_ratio")
    return s.select("model", F.round("dm_vs_baseline", 6).alias("dm_vs_baseline"), F.round("p_value", 6).alias("p_value"))


@query("d09_model_backtest")
def model_backtest(spark, d):
    p, train, test = split(spark, d)
    ensure_checkpoint_dir(spark)
    scored = P.cohort_ratio(train, test)
    scored = P.logit_hazard(train, SECTORS, S.FRAMEWORKS)(scored)
    scored = P.gbt_hazard(train, SECTORS, S.FRAMEWORKS)(scored).checkpoint()
    models = ["cohort_ratio", "logit_hazard", "gbt_hazard"]
    table = P.backtest_scores(P.hazard_backtest(p, scored, models), models, "cohort_ratio")
    return table.join(P.model_auc(scored, models), "model")


@query("d10_hazard_lookup", sql("panel", RISK + """
SELECT s.sector, framework, eligible60, CAST(a AS INT) AS age, CAST(v AS INT) AS service,
  ROUND(CASE WHEN a - v < 18 THEN 0 ELSE COALESCE(rate, o) END, 8) AS hazard
FROM (SELECT DISTINCT sector FROM panel) s CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D')) AS f(framework)
CROSS JOIN (VALUES (FALSE), (TRUE)) AS e(eligible60) CROSS JOIN range(18, 66) AS r(a) CROSS JOIN range(0, 48) AS q(v)
CROSS JOIN overall LEFT JOIN rates ON rates.sector = s.sector AND band = a // 5 * 5"""))
def lookup(spark, d):
    _, train, _ = split(spark, d)
    grid = P.hazard_grid(spark, SECTORS, S.FRAMEWORKS, (S.AGE_MIN, S.AGE_MAX), S.SERVICE_MAX)
    return P.hazard_lookup(P.cohort_ratio(train, grid), "cohort_ratio").withColumn("hazard", F.round("hazard", 8))


HIRES = """hires_n AS (SELECT framework, age, COUNT(*) AS n FROM panel
  WHERE service = 0 AND year >= (SELECT MAX(year) - 4 FROM panel) GROUP BY 1, 2),
hires AS (SELECT framework, age, SUM(n) OVER (PARTITION BY framework) / SUM(n) OVER () AS framework_share,
  n / SUM(n) OVER (PARTITION BY framework) AS age_share FROM hires_n)"""


@query("d11_hire_profile", sql("panel", "WITH " + HIRES + """
SELECT framework, age, ROUND(framework_share, 8) AS framework_share, ROUND(age_share, 8) AS age_share FROM hires"""))
def hires(spark, d):
    return P.hire_profile(V.panel(spark, d)).withColumns({c: F.round(c, 8) for c in ("framework_share", "age_share")})


@query("d12_cohort_stock", sql("stocks", "SELECT * FROM stocks"))
def stock(spark, d):
    return V.stocks(spark, d)


@query("d13_retirement_age_schedule", sql("stocks scenarios", f"""
WITH lim AS (SELECT scenario, CAST(t AS INT) AS t, CAST(floor(CASE WHEN phase_years > 0 AND retirement_age_target > retirement_age
    THEN retirement_age + LEAST(t / phase_years, 1) * (retirement_age_target - retirement_age) ELSE retirement_age END) AS INT) AS "limit"
  FROM scenarios CROSS JOIN range(51) AS r(t))
SELECT scenario, CAST({S.BASE_YEAR} + t AS INT) AS year, "limit", CAST(SUM(n) AS BIGINT) AS staff,
  CAST(SUM(CASE WHEN age >= "limit" THEN n ELSE 0 END) AS BIGINT) AS due FROM stocks JOIN lim USING (t) GROUP BY 1, 2, 3"""))
def schedule(spark, d):
    s = P.retirement_age_schedule(V.scenarios(spark), S.BASE_YEAR, S.BASE_YEAR + 50)
    staff = V.stocks(spark, d).groupBy((F.col("t") + S.BASE_YEAR).alias("year"), "age").agg(F.sum("n").alias("n"))
    return (s.join(staff, "year").groupBy("scenario", "year", "limit")
            .agg(F.sum("n").alias("staff"), F.sum(F.when(F.col("age") >= F.col("limit"), F.col("n")).otherwise(0)).alias("due")))


def start_stock(spark, d):
    """The last panel year's cohorts, once per scenario."""
    s = V.stocks(spark, d)
    last = s.agg(F.max("t")).scalar()
    s = s.where(F.col("t") == last).drop("t").withColumn("n", F.col("n").cast("double"))
    return with_parameters(s, [(r[0],) for r in S.SCENARIOS], "scenario string")


def life(spark):
    return P.life_table(spark, S.LIFE["makeham"], S.LIFE["gompertz"], S.LIFE["slope"], S.LIFE["last_age"])


def roll(spark, d, years):
    """Flows of each year, the stocks between them written out so that the plan stays one step long."""
    p, train, _ = split(spark, d)
    grid = P.hazard_grid(spark, SECTORS, S.FRAMEWORKS, (S.AGE_MIN, S.AGE_MAX), S.SERVICE_MAX)
    hz = P.hazard_lookup(P.cohort_ratio(train, grid), "cohort_ratio")
    promo, hires_, sc = P.transition_matrix(p, S.FRAMEWORKS), P.hire_profile(p), V.scenarios(spark)
    ensure_checkpoint_dir(spark)
    hz, promo, hires_ = bounded(hz), bounded(promo), bounded(hires_)
    stock_, out = start_stock(spark, d), None
    for k in range(years):
        fl = P.step_flows(stock_, sc, hz, list(P.COHORT), life(spark), promo, S.BASE_YEAR + k, S.BASE_YEAR)
        if k + 1 < years:
            fl = fl.checkpoint()
        out = fl.withColumn("k", F.lit(k)) if out is None else out.unionByName(fl.withColumn("k", F.lit(k)))
        stock_ = P.stock_flow_step(fl, sc, hires_, S.PRIORITY, ELIGIBLE_SHARE)
    return out, stock_


def step_sql(src: str, k: int) -> str:
    limit = f"""CAST(floor(CASE WHEN phase_years > 0 AND retirement_age_target > retirement_age
      THEN retirement_age + LEAST({k} / phase_years, 1) * (retirement_age_target - retirement_age) ELSE retirement_age END) AS INT)"""
    return f""",
fa{k} AS (SELECT s.*, {limit} AS lim, hiring_growth, restrain,
    CASE WHEN s.age >= CASE WHEN s.eligible60 THEN GREATEST(60, {limit}) ELSE {limit} END THEN n ELSE 0 END AS retired,
    CASE WHEN s.age - s.service < 18 THEN 0 ELSE COALESCE(rate, o) END AS h, u.up, u.p
  FROM {src} s JOIN scenarios USING (scenario) CROSS JOIN overall LEFT JOIN rates ON rates.sector = s.sector AND band = s.age // 5 * 5
  JOIN ups u ON u.f = s.framework),
fb{k} AS (SELECT f.*, (n - retired) * qx AS died FROM fa{k} f JOIN life ON life.age = f.age),
fc{k} AS (SELECT *, (n - retired - died) * h AS separated FROM fb{k}),
fl{k} AS (SELECT *, (n - retired - died - separated) * p AS promoted, (n - retired - died - separated) * (1 - p) AS stayed FROM fc{k}),
mv{k} AS (SELECT scenario, sector, framework, eligible60, age + 1 AS age, service + 1 AS service, stayed AS n FROM fl{k}
  UNION ALL SELECT scenario, sector, up, eligible60, age + 1, service + 1, promoted FROM fl{k} WHERE up IS NOT NULL),
mk{k} AS (SELECT * FROM mv{k} WHERE age <= 65 AND service <= 47),
gap{k} AS (SELECT scenario, sector, GREATEST(before * (1 + g) - COALESCE(after, 0), 0) AS gap FROM (
    SELECT scenario, sector, SUM(n) AS before, MAX(CASE WHEN restrain AND sector NOT IN {S.PRIORITY} THEN 0 ELSE hiring_growth END) AS g
    FROM fl{k} GROUP BY 1, 2) LEFT JOIN (SELECT scenario, sector, SUM(n) AS after FROM mk{k} GROUP BY 1, 2) USING (scenario, sector)),
st{k + 1} AS (SELECT scenario, sector, framework, eligible60, age, service, SUM(n) AS n FROM (
    SELECT * FROM mk{k} UNION ALL SELECT scenario, sector, framework, e, age, 0, gap * framework_share * age_share * w
    FROM gap{k} CROSS JOIN hires CROSS JOIN (VALUES (FALSE, {1 - ELIGIBLE_SHARE}), (TRUE, {ELIGIBLE_SHARE})) AS v(e, w))
  GROUP BY 1, 2, 3, 4, 5, 6)
"""


ROLL = RISK + "," + MATRIX + "," + HIRES + """,
st0 AS (SELECT scenario, sector, framework, eligible60, age, service, CAST(n AS DOUBLE) AS n FROM stocks, scenarios
  WHERE t = (SELECT MAX(t) FROM stocks))
""" + step_sql("st0", 0) + step_sql("st1", 1) + step_sql("st2", 2)


@query("d14_stock_flow_step", sql("panel stocks scenarios life", ROLL + """
SELECT scenario, sector, framework, eligible60, age, service, ROUND(n, 6) AS n FROM st2 WHERE n > 1e-4"""))
def step(spark, d):
    _, s = roll(spark, d, 2)
    return s.where("n > 1e-4").withColumn("n", F.round("n", 6))


@query("d15_headcount_summary", sql("panel stocks scenarios life", ROLL + ",\nfl AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, scenario, sector, age, n, retired, separated, lim FROM fl{k}" for k in range(3)) + """)
SELECT scenario, k, """ + ", ".join(
    f"ROUND(SUM(CASE WHEN sector = '{s}' THEN n ELSE 0 END), 6) AS staff_{i}" for i, s in enumerate(SECTORS)) + """,
  ROUND(SUM(n), 6) AS total, ROUND(SUM(retired), 6) AS retirements, ROUND(SUM(separated), 6) AS separations,
  ROUND(SUM(n * age) / SUM(n), 6) AS mean_age, MAX(lim) AS retirement_age FROM fl GROUP BY 1, 2"""))
def headcount(spark, d):
    fl, _ = roll(spark, d, 3)
    out = P.headcount_summary(fl, ["scenario", "k"], SECTORS)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("scenario", "k", "retirement_age")})


@query("d16_life_table", sql("register life", """
SELECT r.age, ROUND(qx, 10) AS qx, COUNT(*) AS pensioners, ROUND(COUNT(*) * qx, 6) AS expected_deaths
FROM register r JOIN life ON life.age = r.age GROUP BY r.age, qx"""))
def life_query(spark, d):
    n = V.register(spark, d).groupBy("age").agg(F.count("*").alias("pensioners"))
    return (n.join(life(spark), "age").select("age", F.round("qx", 10).alias("qx"), "pensioners",
                                               F.round(F.col("pensioners") * F.col("qx"), 6).alias("expected_deaths")))

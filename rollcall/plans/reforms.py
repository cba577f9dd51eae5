"""Queries: path levels, scenario summaries and reform packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import ensure_checkpoint_dir, with_parameters, written
from ..operators import pay as E
from ..operators import scenarios as R
from ..sources.tables import table
from . import funds
from . import settings as S
from . import views as V
from .registry import query
from .sqlviews import sql

HORIZONS = [9, 19, 29]
LONG = "long AS (" + " UNION ALL ".join(f"SELECT scenario, run, t, '{m}' AS metric, {m} AS value FROM outcomes" for m in E.METRICS) + ")"


@query("f01_blend_to_anchor", sql("macro", f"""
WITH n AS (SELECT series, arg_max(value, t) AS v FROM macro GROUP BY 1)
SELECT series, CAST(h AS INT) AS h, ROUND((1 - LEAST(h / {S.CONVERGENCE}, 1)) * v + LEAST(h / {S.CONVERGENCE}, 1) *
  CASE series WHEN 'real_growth' THEN 0.045 WHEN 'inflation' THEN 0.03 ELSE 0.24 END, 8) AS value FROM n CROSS JOIN range(1, 31) AS r(h)"""))
def blend(spark, d):
    n = V.macro(spark, d).groupBy("series").agg(F.max_by("value", "t").alias("value"))
    f = n.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(30))))
    return R.blend_to_anchor(f, S.ANCHORS, S.CONVERGENCE).select("series", "h", F.round("value", 8).alias("value"))


@query("f02_level_index", sql("level_paths", "SELECT run, t, ROUND(cpi, 10) AS cpi, ROUND(gdp, 10) AS gdp FROM level_paths"))
def levels(spark, d):
    return V.level_paths(spark, d).select("run", "t", F.round("cpi", 10).alias("cpi"), F.round("gdp", 10).alias("gdp"))


@query("f03_fan", sql("level_paths", """
SELECT t, 'gdp' AS metric, ROUND(quantile_cont(gdp, 0.05), 8) AS p5, ROUND(quantile_cont(gdp, 0.5), 8) AS p50,
  ROUND(quantile_cont(gdp, 0.95), 8) AS p95, ROUND(MAX(CASE WHEN run = 0 THEN gdp END), 8) AS central FROM level_paths GROUP BY 1"""))
def fan(spark, d):
    f = R.fan_long(V.level_paths(spark, d), ("gdp",), ["t"])
    return f.withColumns({c: F.round(c, 8) for c in ("p5", "p50", "p95", "central")})


@query("f04_fan_long", sql("outcomes", f"""
WITH {LONG} SELECT scenario, t, metric, ROUND(quantile_cont(value, 0.05), 6) AS p5, ROUND(quantile_cont(value, 0.5), 6) AS p50,
  ROUND(quantile_cont(value, 0.95), 6) AS p95, ROUND(MAX(CASE WHEN run = 0 THEN value END), 6) AS central FROM long GROUP BY 1, 2, 3"""))
def fan_long(spark, d):
    f = R.fan_long(funds.outcomes(spark, d)[0], E.METRICS, ["scenario", "t"])
    return f.withColumns({c: F.round(c, 6) for c in ("p5", "p50", "p95", "central")})


SUMMARY_METRICS = ("wage_bill_gdp", "total_cost_gdp")


def _stat(m, h, c):
    inner = {"p5": "quantile_cont({v}, 0.05)", "p50": "quantile_cont({v}, 0.5)", "p95": "quantile_cont({v}, 0.95)", "central": "MAX({v})"}[c]
    cond = f"t = {h}" + (" AND run = 0" if c == "central" else "")
    return f"ROUND({inner.format(v=f'CASE WHEN {cond} THEN {m} END')}, 6) AS {m}_{h}_{c}"


SUMMARY = "SELECT scenario, " + ", ".join(_stat(m, h, c) for m in SUMMARY_METRICS for h in HORIZONS for c in ("p5", "p50", "p95", "central")) + " FROM outcomes GROUP BY 1"


@query("f05_scenario_summary", sql("outcomes", f"""
WITH s AS ({SUMMARY}),
dp AS (SELECT scenario, ROUND(AVG(CASE WHEN depletion_year > 0 THEN 1.0 ELSE 0.0 END), 8) AS prob_depleted,
  CAST(MAX(CASE WHEN run = 0 AND depletion_year > 0 THEN depletion_year END) AS INT) AS central_depletion_year,
  median(CASE WHEN depletion_year > 0 THEN depletion_year END) AS median_depletion_year FROM depletion GROUP BY 1)
SELECT * FROM s JOIN dp USING (scenario)"""))
def summary(spark, d):
    o, dep = funds.outcomes(spark, d)
    s = R.scenario_summary(o, dep, SUMMARY_METRICS, HORIZONS)
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c.startswith(SUMMARY_METRICS)} | {"prob_depleted": F.round("prob_depleted", 8)})


@query("f05_windowed_adequacy", sql("index retirees", f"""
WITH {funds.BENEFIT}, {funds.ADEQUACY}
SELECT scenario, """ + ", ".join(f"""
  ROUND(SUM(avg_replacement * retirees) FILTER (WHERE t BETWEEN {a} AND {b}) / SUM(retirees) FILTER (WHERE t BETWEEN {a} AND {b}), 8) AS avg_replacement_{n},
  ROUND(MIN(min_replacement) FILTER (WHERE t BETWEEN {a} AND {b}), 8) AS min_replacement_{n},
  ROUND(SUM(share_on_minimum * retirees) FILTER (WHERE t BETWEEN {a} AND {b}) / SUM(retirees) FILTER (WHERE t BETWEEN {a} AND {b}), 8) AS share_on_minimum_{n}"""
    for n, a, b in (("early", 0, 2), ("late", 3, 6))) + " FROM adeq GROUP BY 1"))
def windowed(spark, d):
    w = R.windowed_adequacy(E.adequacy(funds.benefits(spark, d), S.ALLOWANCE), {"early": (0, 2), "late": (3, 6)})
    return w.withColumns({c: F.round(c, 8) for c in w.columns if c != "scenario"})


@query("f06_combine_scenarios", sql("ledger", """
WITH c AS (SELECT 'preset' AS scenario_set, scenario, depletion_year FROM depletion
  UNION ALL SELECT 'saved', 'my ' || scenario, GREATEST(depletion_year - 1, 0) FROM depletion WHERE scenario = 'S1')
SELECT scenario_set, scenario, COUNT(*) AS runs, COUNT(*) FILTER (WHERE depletion_year > 0) AS depleted FROM c GROUP BY 1, 2"""))
def combine(spark, d):
    dep = E.depletion_year(funds.ledger(spark, d)[1], S.BASE_YEAR)
    saved = dep.where("scenario = 'S1'").withColumns({
        "scenario": F.concat(F.lit("my "), "scenario"), "depletion_year": F.greatest(F.col("depletion_year") - 1, F.lit(0))})
    return (R.combine_scenarios([("preset", dep), ("saved", saved)]).groupBy("scenario_set", "scenario")
            .agg(F.count("*").alias("runs"), F.count_if(F.col("depletion_year") > 0).alias("depleted")))


DRIVERS = ("avg_inflation", "avg_return", "avg_growth", "mortality_level")


@query("f07_run_drivers", sql("paths", """
SELECT run, ROUND(AVG(inflation) * 100, 10) AS avg_inflation, ROUND(AVG(real_return) * 100, 10) AS avg_return,
  ROUND(AVG(real_growth) * 100, 10) AS avg_growth, ROUND(MAX(mortality_mult), 10) AS mortality_level FROM paths WHERE t <= 19 GROUP BY 1"""))
def drivers(spark, d):
    return R.run_drivers(V.paths(spark, d), 19).withColumns({c: F.round(c, 10) for c in DRIVERS})


@query("f08_lever_features", sql("ledger", """
SELECT scenario, retirement_age_target AS lever_age, CASE WHEN pension_formula = 'accrual' THEN 1.0 ELSE 0.0 END AS lever_accrual,
  CASE WHEN pension_formula = 'accrual' THEN accrual_rate ELSE 0 END AS lever_rate,
  CASE WHEN contribution_step > 0 THEN contribution_cap ELSE 0 END AS lever_rise, employee_rate AS lever_employee, employer_rate AS lever_employer,
  CASE WHEN salary_rule = 'inflation' THEN 1.0 ELSE 0.0 END AS lever_inflation, CASE WHEN salary_rule = 'targeted' THEN 1.0 ELSE 0.0 END AS lever_targeted,
  recent_raise AS lever_raise, hiring_growth AS lever_hiring, CASE WHEN restrain THEN 1.0 ELSE 0.0 END AS lever_restraint, runs, depleted
FROM scenarios JOIN (SELECT scenario, COUNT(*) AS runs, COUNT(*) FILTER (WHERE depletion_year > 0) AS depleted FROM depletion GROUP BY 1) USING (scenario)"""))
def levers(spark, d):
    dep = E.depletion_year(funds.ledger(spark, d)[1], S.BASE_YEAR)
    n = dep.groupBy("scenario").agg(F.count("*").alias("runs"), F.count_if(F.col("depletion_year") > 0).alias("depleted"))
    return R.lever_features(V.scenarios(spark)).join(n, "scenario").select("scenario", *R.LEVERS, "runs", "depleted")


CHECK = [2030, 2035, 2040, 2045, 2050, 2055]


@query("f09_depletion_curve", sql("ledger", f"""
WITH c AS (SELECT scenario, y AS year, AVG(CASE WHEN depletion_year > 0 AND depletion_year <= y THEN 1.0 ELSE 0.0 END) AS p
  FROM depletion CROSS JOIN (VALUES {', '.join(f'({y})' for y in CHECK)}) AS v(y) GROUP BY 1, 2)
SELECT scenario, year, ROUND(p, 8) AS chance, CASE WHEN p >= 0.5 THEN 'red' WHEN p >= 0.1 THEN 'amber' ELSE 'green' END AS light FROM c"""))
def curve(spark, d):
    return R.depletion_curve(E.depletion_year(funds.ledger(spark, d)[1], S.BASE_YEAR), CHECK).withColumn("chance", F.round("chance", 8))


@query("f09_depletion_range", sql("ledger", f"""
WITH n AS (SELECT scenario, CASE WHEN depletion_year > 0 THEN depletion_year ELSE {S.BASE_YEAR + S.PATH_YEARS} END AS y FROM depletion),
q AS (SELECT scenario, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.95) AS hi FROM n GROUP BY 1)
SELECT scenario, ROUND(lo, 6) AS low, ROUND(CASE WHEN med < {S.BASE_YEAR + S.PATH_YEARS} THEN med END, 6) AS median, ROUND(hi, 6) AS high FROM q"""))
def depletion_range(spark, d):
    r = R.depletion_range(E.depletion_year(funds.ledger(spark, d)[1], S.BASE_YEAR), S.BASE_YEAR + S.PATH_YEARS)
    return r.withColumns({c: F.round(c, 6) for c in ("low", "median", "high")})


@query("f10_delta_vs_baseline", sql("outcomes", """
WITH a AS (SELECT scenario, AVG(total_cost_gdp) AS total_cost, AVG(wage_bill_gdp) AS wage_cost FROM outcomes GROUP BY 1)
SELECT scenario, ROUND(total_cost, 6) AS total_cost, ROUND(wage_cost, 6) AS wage_cost,
  ROUND(total_cost - (SELECT total_cost FROM a WHERE scenario = 'S0'), 6) AS total_cost_change,
  ROUND(wage_cost - (SELECT wage_cost FROM a WHERE scenario = 'S0'), 6) AS wage_cost_change FROM a"""))
def delta(spark, d):
    o = funds.outcomes(spark, d)[0]
    ensure_checkpoint_dir(spark)
    a = o.groupBy("scenario").agg(F.avg("total_cost_gdp").alias("total_cost"), F.avg("wage_bill_gdp").alias("wage_cost")).checkpoint()
    out = R.delta_vs_baseline(a, ["total_cost", "wage_cost"], "S0")
    return out.select("scenario", *[F.round(c, 6).alias(c) for c in out.columns if c != "scenario"])


PACKAGE_SQL = """pk AS (
  SELECT age AS package_age, acc AS package_accrual, rise AS package_rise, 'recent_average' AS package_pay, FALSE AS package_restrain
  FROM range(55, 63) AS a(age) CROSS JOIN (VALUES (NULL), (0.015), (0.0175), (0.02), (0.0225), (0.025), (0.0275), (0.03)) AS b(acc)
  CROSS JOIN (VALUES (0.0), (0.01), (0.02), (0.03), (0.04)) AS c(rise)),
po AS (
  SELECT pk.*, run, t,
    CASE WHEN acc_rate IS NULL THEN 0.8 ELSE LEAST(acc_rate * 30, 0.8) END * (1 - 0.004 * (60 - package_age)) AS adequacy,
    (0.9 + 0.1 * cpi) * mortality_mult * (1.2 - 0.02 * (package_age - 55)) * CASE WHEN acc_rate IS NULL THEN 0.8 ELSE LEAST(acc_rate * 30, 0.8) END
      - 5 * LEAST(floor(t / 5) * 0.01, package_rise) AS spend
  FROM (SELECT *, CAST(package_accrual AS DOUBLE) AS acc_rate FROM pk) pk CROSS JOIN level_paths),
obj AS (
  SELECT package_age, package_accrual, package_rise, median(c) AS cost, AVG(a) AS adequacy, AVG(m) AS share_on_minimum, AVG(o) AS prob_depleted
  FROM (SELECT package_age, package_accrual, package_rise, run, AVG(3 + spend) AS c, AVG(adequacy) AS a,
      AVG(CASE WHEN adequacy < 0.5 THEN 1.0 ELSE 0.0 END) AS m, MAX(CASE WHEN spend > 0.8 THEN 1.0 ELSE 0.0 END) AS o FROM po GROUP BY 1, 2, 3, 4)
  GROUP BY 1, 2, 3),
objr AS (SELECT package_age, package_accrual, package_rise, ROUND(cost, 8) AS cost, ROUND(adequacy, 8) AS adequacy, ROUND(share_on_minimum, 8) AS share_on_minimum,
  ROUND(prob_depleted, 8) AS prob_depleted FROM obj)"""
KEYS = ["package_age", "package_accrual", "package_rise"]


def package_outcomes(spark, d):
    """A cost and adequacy figure for every package, run and year."""
    p = R.package_scenario(R.package_grid(V.level_paths(spark, d).select("run", "t", "cpi", "mortality_mult")))
    rate = F.when(F.col("pension_formula") == "current", 0.8).otherwise(F.least(F.col("accrual_rate") * 30, F.lit(0.8)))
    spend = ((0.9 + 0.1 * F.col("cpi")) * F.col("mortality_mult") * (1.2 - 0.02 * (F.col("package_age") - 55)) * rate
             - 5 * F.least(F.floor(F.col("t") / 5) * 0.01, F.col("package_rise")))
    return (p.withColumn("adequacy", rate * (1 - 0.004 * (60 - F.col("package_age")))).withColumn("spend", spend)
            .withColumns({"cost": 3 + F.col("spend"), "on_minimum": (F.col("adequacy") < 0.5).cast("double"),
                          "topup": F.greatest(F.col("spend") - 0.8, F.lit(0.0))}))


def objectives(spark, d):
    """The 320 scored packages, written out: front, hypervolume and targets all read them."""
    ensure_checkpoint_dir(spark)
    o = R.package_objectives(package_outcomes(spark, d), KEYS)
    return o.select(*KEYS, *[F.round(c, 8).alias(c) for c in ("cost", "adequacy", "share_on_minimum", "prob_depleted")]).checkpoint()


@query("f11_package_grid", sql("level_paths", f"""
WITH {PACKAGE_SQL} SELECT package_age, package_accrual, COUNT(*) AS n, ROUND(AVG(spend), 8) AS spend FROM po GROUP BY 1, 2"""))
def grid(spark, d):
    return (package_outcomes(spark, d).groupBy("package_age", "package_accrual")
            .agg(F.count("*").alias("n"), F.round(F.avg("spend"), 8).alias("spend")).withColumn("package_age", F.col("package_age").cast("bigint")))


@query("f12_package_objectives", sql("level_paths", f"WITH {PACKAGE_SQL} SELECT * FROM objr"))
def package_objectives(spark, d):
    return objectives(spark, d)


POINTS = "pt AS (SELECT o_custkey AS id, ROUND(SUM(o_totalprice), 2) AS cost, COUNT(*) AS adequacy FROM orders GROUP BY 1)"


def points(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("cost"), F.count("*").alias("adequacy"))


@query("f13_pareto_front", sql("", f"""
WITH {POINTS}, s AS (SELECT *, MAX(adequacy) OVER (ORDER BY cost RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS same,
  MAX(adequacy) OVER (ORDER BY cost RANGE BETWEEN UNBOUNDED PRECEDING AND 0.0001 PRECEDING) AS cheaper FROM pt)
SELECT id, cost, adequacy FROM s WHERE adequacy = same AND (cheaper IS NULL OR cheaper < adequacy)"""))
def pareto(spark, d):
    return R.pareto_front(points(spark, d), "cost", "adequacy").where("on_front").select("id", "cost", "adequacy")


@query("f13_package_front", sql("level_paths", f"""
WITH {PACKAGE_SQL} SELECT package_age, package_accrual, package_rise, cost, adequacy FROM objr a WHERE NOT EXISTS (
  SELECT 1 FROM objr b WHERE b.cost <= a.cost AND b.adequacy >= a.adequacy AND (b.cost < a.cost OR b.adequacy > a.adequacy))"""))
def package_front(spark, d):
    return R.pareto_front(objectives(spark, d), "cost", "adequacy").where("on_front").select(*KEYS, "cost", "adequacy")


HV = """FROM (SELECT cost, adequacy, LEAD(cost, 1, {ref_c}) OVER (ORDER BY cost) - cost AS width FROM (
  SELECT DISTINCT cost, adequacy FROM {src} a WHERE NOT EXISTS (
  SELECT 1 FROM {src} b WHERE b.cost <= a.cost AND b.adequacy >= a.adequacy AND (b.cost < a.cost OR b.adequacy > a.adequacy))))"""


@query("f14_hypervolume", sql("", f"""
WITH {POINTS}, fr AS (SELECT DISTINCT cost, adequacy FROM (SELECT *, MAX(adequacy) OVER (ORDER BY cost, adequacy DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM pt)
  WHERE prev IS NULL OR adequacy > prev),
w AS (SELECT adequacy, LEAD(cost, 1, 1e8) OVER (ORDER BY cost) - cost AS width FROM fr)
SELECT ROUND(SUM(width * (GREATEST(adequacy, 0))) / 1e6, 4) AS hypervolume FROM w"""))
def hypervolume(spark, d):
    return R.hypervolume(points(spark, d), "cost", "adequacy", F.lit(1e8), F.lit(0)).select(F.round(F.col("hypervolume") / 1e6, 4).alias("hypervolume"))


# a search asks for the best package of each stated target
WANTED_ADEQUACY, WANTED_COST = (0.6, 0.65, 0.7, 0.75), (3.2, 3.4, 3.6, 3.8)
TARGETS_SQL = ", ".join([f"('adequacy', {t})" for t in WANTED_ADEQUACY] + [f"('cost', {t})" for t in WANTED_COST])


@query("f15_compare_fronts", sql("level_paths", f"""
WITH {PACKAGE_SQL},
front AS (SELECT * FROM objr a WHERE NOT EXISTS (
  SELECT 1 FROM objr b WHERE b.cost <= a.cost AND b.adequacy >= a.adequacy AND (b.cost < a.cost OR b.adequacy > a.adequacy))),
asked AS (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY kind, target ORDER BY CASE WHEN kind = 'adequacy' THEN adequacy >= target ELSE cost <= target END DESC,
    CASE WHEN kind = 'adequacy' THEN CASE WHEN adequacy >= target THEN cost ELSE -adequacy END ELSE CASE WHEN cost <= target THEN -adequacy ELSE cost END END,
    package_age, package_accrual NULLS FIRST, package_rise) AS rn FROM front f CROSS JOIN (VALUES {TARGETS_SQL}) AS v(kind, target)),
found AS (SELECT DISTINCT package_age, package_accrual, package_rise, cost, adequacy FROM asked WHERE rn = 1),
ref AS (SELECT MAX(cost) * 1.01 AS rc, MIN(adequacy) - 0.01 AS ra FROM objr),
hv AS (SELECT SUM(width * (adequacy - (SELECT ra FROM ref))) AS v {HV.format(src='objr', ref_c='(SELECT rc FROM ref)')}),
hf AS (SELECT SUM(width * (adequacy - (SELECT ra FROM ref))) AS v {HV.format(src='found', ref_c='(SELECT rc FROM ref)')})
SELECT ROUND(hf.v / hv.v, 8) AS hypervolume_ratio, (SELECT COUNT(*) FROM front) AS true_front_size, (SELECT COUNT(*) FROM found) AS true_front_found FROM hv, hf"""))
def compare(spark, d):
    """The best packages for stated targets against the front of all packages."""
    o = objectives(spark, d)
    front = written(R.pareto_front(o, "cost", "adequacy").where("on_front").select(*KEYS, "cost", "adequacy"))
    keep, found = [*KEYS, "cost", "adequacy"], None
    for target in [{"min_adequacy": t} for t in WANTED_ADEQUACY] + [{"max_cost": t} for t in WANTED_COST]:
        best = R.best_for_target(front, keep, **target).select(*keep)
        found = best if found is None else found.unionByName(best)
    return R.compare_fronts(written(found.distinct()), o, KEYS).withColumn("hypervolume_ratio", F.round("hypervolume_ratio", 8))


@query("f16_best_for_target", sql("level_paths", f"""
WITH {PACKAGE_SQL} SELECT * FROM (SELECT 'found' AS status, cost, adequacy FROM objr WHERE adequacy >= 0.7 ORDER BY cost, adequacy DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'closest', cost, adequacy FROM objr ORDER BY adequacy DESC, cost LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'found', cost, adequacy FROM objr WHERE cost <= 3.6 ORDER BY adequacy DESC, cost LIMIT 1)"""))
def target(spark, d):
    front = R.pareto_front(objectives(spark, d), "cost", "adequacy").where("on_front")
    keep = ["cost", "adequacy"]
    return (R.best_for_target(front, keep, min_adequacy=0.7).unionByName(R.best_for_target(front, keep, min_adequacy=0.99))
            .unionByName(R.best_for_target(front, keep, max_cost=3.6)))


@query("f17_breakeven_level", sql("level_paths", f"""
WITH {PACKAGE_SQL}, s AS (SELECT package_age, CAST(package_accrual AS DOUBLE) AS a, AVG(adequacy) AS v FROM objr WHERE package_accrual IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, LAG(a) OVER w AS pa, LAG(v) OVER w AS pv FROM s WINDOW w AS (PARTITION BY package_age ORDER BY a)),
c AS (SELECT package_age, MIN(a) FILTER (WHERE v >= 0.785) AS first FROM l GROUP BY 1)
SELECT c.package_age, ROUND(CASE WHEN pv IS NULL THEN a ELSE pa + (0.785 - pv) / (v - pv) * (a - pa) END, 8) AS breakeven
FROM c LEFT JOIN l ON l.package_age = c.package_age AND l.a = c.first"""))
def breakeven(spark, d):
    sweep = objectives(spark, d).where("package_accrual is not null").groupBy("package_age", "package_accrual").agg(F.avg("adequacy").alias("v"))
    out = R.breakeven_level(sweep, ["package_age"], "package_accrual", "v", F.lit(0.785))
    return out.select(F.col("package_age").cast("bigint").alias("package_age"), F.round("breakeven", 8).alias("breakeven"))


@query("f18_lever_table", sql("scenarios flows", """
SELECT s.scenario, salary_rule, pension_formula, retirement_age_target, accrual_rate, contribution_cap, restrain, ROUND(c, 8) AS mean_contribution
FROM scenarios s JOIN (SELECT scenario, AVG(contrib_employee + contrib_employer) AS c FROM flows GROUP BY 1) USING (scenario)"""))
def lever_table(spark, d):
    c = funds.flows(spark, d).groupBy("scenario").agg(F.round(F.avg(F.col("contrib_employee") + F.col("contrib_employer")), 8).alias("mean_contribution"))
    return V.scenarios(spark).join(c, "scenario").select("scenario", "salary_rule", "pension_formula", "retirement_age_target",
                                                        "accrual_rate", "contribution_cap", "restrain", "mean_contribution")


@query("f19_first_paths", sql("level_paths", """
SELECT t, COUNT(*) AS runs, ROUND(AVG(gdp), 8) AS gdp FROM level_paths WHERE run < 40 GROUP BY 1"""))
def first(spark, d):
    return R.first_paths(V.level_paths(spark, d), 40).groupBy("t").agg(F.count("*").alias("runs"), F.round(F.avg("gdp"), 8).alias("gdp"))

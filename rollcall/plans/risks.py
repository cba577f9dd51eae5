"""Queries: run-out risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import ensure_checkpoint_dir, side_by_side
from ..operators import risk as K
from ..operators import scenarios as R
from ..operators.waves import importance
from ..sources.tables import table
from . import funds
from . import settings as S
from . import views as V
from .exits import shapley_sql
from .panels import hash_sql
from .registry import query
from .sqlviews import sql

NEVER = S.BASE_YEAR + S.PATH_YEARS
PER_RUN = 12            # random years a run in fitting
CHECK = [2030, 2035, 2040, 2045, 2050, 2055]
# every preset at seven employer rates: the packages a model learns from
SETTINGS = [(f"{r[0]}-{i}", *r[1:12], round(0.06 + 0.02 * i, 2), *r[13:]) for r in S.SCENARIOS for i in range(7)]

RISK = f"""rt AS (SELECT d.scenario, d.run, CASE WHEN depletion_year > 0 THEN depletion_year ELSE {NEVER} END AS run_out,
    CASE WHEN contribution_step > 0 THEN contribution_cap ELSE 0 END AS lever_rise, CASE WHEN salary_rule = 'inflation' THEN 1.0 ELSE 0.0 END AS lever_inflation,
    avg_inflation, avg_return, avg_growth, mortality_level
  FROM depletion d JOIN (SELECT run, AVG(inflation) * 100 AS avg_inflation, AVG(real_return) * 100 AS avg_return, AVG(real_growth) * 100 AS avg_growth,
    MAX(mortality_mult) AS mortality_level FROM paths WHERE t <= 19 GROUP BY 1) v ON v.run = d.run JOIN scenarios s ON s.scenario = d.scenario),
st AS (SELECT rt.*, y AS year, CASE WHEN run_out <= y THEN 1 ELSE 0 END AS label FROM rt CROSS JOIN (VALUES {', '.join(f'({y})' for y in CHECK)}) AS v(y))"""


def training(spark, d, rows=None):
    """Settings x runs with levers, drivers and run-out year, written out for the models that read it."""
    ensure_checkpoint_dir(spark)
    rows = rows or S.SCENARIOS
    dep = funds.run_out_years(spark, d, rows)
    settings = F.broadcast(spark.createDataFrame(rows, S.SCENARIO_SCHEMA))
    return K.risk_training_table(settings, R.run_drivers(V.paths(spark, d), 19), dep, NEVER).checkpoint()


def parts(spark, d):
    t = K.group_split(training(spark, d, SETTINGS), "scenario", {"train": 0.7, "cal": 0.85, "test": 1.01})
    return [t.where(F.col("part") == p).drop("part") for p in ("train", "cal", "test")]


@query("j01_risk_training_table", sql("ledger", f"""WITH {RISK}
SELECT scenario, run, run_out, lever_rise, lever_inflation, ROUND(avg_inflation, 10) AS avg_inflation, ROUND(mortality_level, 10) AS mortality_level FROM rt"""))
def table_query(spark, d):
    return training(spark, d).select("scenario", "run", "run_out", "lever_rise", "lever_inflation",
                                     F.round("avg_inflation", 10).alias("avg_inflation"), F.round("mortality_level", 10).alias("mortality_level"))


@query("j02_stack_by_year", sql("ledger", f"WITH {RISK} SELECT scenario, year, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS ran_out FROM st GROUP BY 1, 2"))
def stack(spark, d):
    return K.stack_years(training(spark, d), CHECK).groupBy("scenario", "year").agg(F.count("*").alias("n"), F.sum("label").alias("ran_out"))


@query("j02_stack_random_years", sql("ledger", f"""WITH {RISK},
ry AS (SELECT scenario, CAST({S.BASE_YEAR} + floor({hash_sql('scenario, run, i')} * {S.PATH_YEARS}) AS INT) AS year, run_out FROM rt CROSS JOIN range(1, 5) AS r(i))
SELECT scenario, year, COUNT(*) AS n, CAST(SUM(CASE WHEN run_out <= year THEN 1 ELSE 0 END) AS BIGINT) AS ran_out FROM ry GROUP BY 1, 2"""))
def random_years(spark, d):
    t = K.stack_random_years(training(spark, d), 4, S.BASE_YEAR, NEVER - 1)
    return t.groupBy("scenario", "year").agg(F.count("*").alias("n"), F.sum("label").alias("ran_out"))


@query("j03_risk_classifier")
def classifier(spark, d):
    train, _, test = parts(spark, d)
    score = K.risk_classifier(K.stack_random_years(train, PER_RUN, S.BASE_YEAR, NEVER - 1))
    cdf = K.risk_cdf(test, score, S.BASE_YEAR, NEVER - 1)
    return cdf.groupBy("scenario", "grid_year").agg(F.avg("prob").alias("prob"), F.avg((F.col("run_out") <= F.col("grid_year")).cast("double")).alias("actual"))


@query("j04_isotonic_calibration")
def isotonic(spark, d):
    train, cal, test = parts(spark, d)
    score = K.risk_classifier(K.stack_random_years(train, PER_RUN, S.BASE_YEAR, NEVER - 1))
    fix = K.isotonic_calibration(score(K.stack_random_years(cal, PER_RUN, S.BASE_YEAR, NEVER - 1, "cal")))
    out = fix(score(K.stack_years(test, CHECK)))
    return out.groupBy("scenario", "year").agg(F.avg("prob").alias("prob"), F.avg("calibrated").alias("calibrated"), F.avg("label").alias("actual"))


@query("j05_base_rate", sql("ledger", f"WITH {RISK} SELECT year, ROUND(AVG(label), 8) AS prob FROM st GROUP BY 1"))
def base_rate(spark, d):
    return K.base_rate(K.stack_years(training(spark, d), CHECK)).withColumn("prob", F.round("prob", 8))


@query("j05_logistic_risk")
def logistic(spark, d):
    train, _, test = parts(spark, d)
    score = K.logistic_risk(K.stack_random_years(train, PER_RUN, S.BASE_YEAR, NEVER - 1))
    return score(K.stack_years(test, CHECK)).groupBy("scenario", "year").agg(F.avg("prob").alias("prob"), F.avg("label").alias("actual"))


CDF = f"""cdf AS (SELECT scenario, CAST(y AS INT) AS grid_year, AVG(CASE WHEN run_out <= y THEN 1.0 ELSE 0.0 END) AS prob
  FROM rt CROSS JOIN range({S.BASE_YEAR}, {NEVER + 1}) AS r(y) GROUP BY 1, 2),
qy AS (SELECT scenario, MIN(grid_year) FILTER (WHERE prob >= 0.05) AS low, MIN(grid_year) FILTER (WHERE prob >= 0.5) AS median,
  MIN(grid_year) FILTER (WHERE prob >= 0.95) AS high FROM cdf GROUP BY 1)"""


def empirical_cdf(t):
    """Share of runs that have run out by each year, per setting."""
    rows = t.groupBy("scenario", "run_out").agg(F.count("*").alias("n")).withColumn(
        "grid_year", F.explode(F.sequence(F.lit(S.BASE_YEAR), F.lit(NEVER))))
    hit = F.when(F.col("run_out") <= F.col("grid_year"), F.col("n")).otherwise(0)
    return rows.groupBy("scenario", "grid_year").agg((F.sum(hit) / F.sum("n")).alias("prob"))


@query("j06_quantile_years", sql("ledger", f"WITH {RISK}, {CDF} SELECT scenario, low, median, high FROM qy"))
def quantile_years(spark, d):
    return K.quantile_years(empirical_cdf(training(spark, d)), ["scenario"], 0.10)


@query("j07_conformal_width", sql("ledger", f"""WITH {RISK}, {CDF},
sc AS (SELECT CAST(GREATEST(median - run_out, run_out - median) AS DOUBLE) AS s FROM rt JOIN qy USING (scenario)),
nn AS (SELECT LEAST(1, ceil((COUNT(*) + 1) * 0.9) / COUNT(*)) AS p FROM sc), k AS (SELECT list(s ORDER BY s) AS l, COUNT(*) AS n FROM sc)
SELECT ROUND(l[CAST(floor(ROUND(p * (n - 1), 9)) AS BIGINT) + 1] + (l[CAST(ceil(ROUND(p * (n - 1), 9)) AS BIGINT) + 1] - l[CAST(floor(ROUND(p * (n - 1), 9)) AS BIGINT) + 1])
  * (ROUND(p * (n - 1), 9) - floor(ROUND(p * (n - 1), 9))), 6) AS width FROM k, nn"""))
def width(spark, d):
    t = training(spark, d)
    cal = t.join(K.quantile_years(empirical_cdf(t), ["scenario"], 0.10), "scenario")
    return K.conformal_width(cal, "median", "median", "run_out", 0.10).withColumn("width", F.round("width", 6))


@query("j07_linear_conformal")
def linear(spark, d):
    train, cal, test = parts(spark, d)
    score, w = K.linear_conformal(train, cal, 0.10)
    half = w.scalar()
    pred = score(test).select("run_out", F.col("linear").alias("median"), (F.col("linear") - half).alias("low"), (F.col("linear") + half).alias("high"))
    return K.range_scores(pred)


@query("j08_group_split", sql("", f"""
WITH k AS (SELECT DISTINCT o_custkey AS key, {hash_sql('o_custkey')} AS h FROM orders), p AS (SELECT key, (RANK() OVER (ORDER BY h) - 1) / COUNT(*) OVER () AS pos FROM k),
q AS (SELECT key, CASE WHEN pos < 0.7 THEN 'train' WHEN pos < 0.85 THEN 'cal' ELSE 'test' END AS part FROM p)
SELECT key, part, COUNT(*) AS n FROM q JOIN orders ON key = o_custkey GROUP BY 1, 2"""))
def split(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return K.group_split(o, "key", {"train": 0.7, "cal": 0.85, "test": 1.01}).groupBy("key", "part").agg(F.count("*").alias("n"))


PRED = """pr AS (SELECT 'year_rate' AS model, scenario, year, label, ROUND(AVG(label) OVER (PARTITION BY year), 6) AS prob FROM st
  UNION ALL SELECT 'setting_rate', scenario, year, label, ROUND(AVG(label) OVER (PARTITION BY scenario), 6) FROM st),
cl AS (SELECT model, scenario, year, label, LEAST(GREATEST(prob, 1e-6), 1 - 1e-6) AS prob FROM pr)"""


@query("j09_risk_scores", sql("ledger", f"""WITH {RISK}, {PRED},
a AS (SELECT model, AVG((prob - label) * (prob - label)) AS brier, AVG(-(label * ln(prob) + (1 - label) * ln(1 - prob))) AS ll FROM cl GROUP BY 1),
b AS (SELECT model, LEAST(CAST(floor(prob * 10) AS INT), 9) AS k, AVG(label) AS y, AVG(prob) AS p, COUNT(*) AS n FROM cl GROUP BY 1, 2),
e AS (SELECT model, SUM(abs(y - p) * n) / SUM(n) AS ece FROM b GROUP BY 1),
s AS (SELECT model, prob, SUM(label) AS pos, SUM(1 - label) AS neg FROM cl GROUP BY 1, 2),
r AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
u AS (SELECT model, SUM(pos * (below + 0.5 * neg)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) AS auc FROM r GROUP BY 1),
g AS (SELECT model, scenario, year, AVG(prob) - AVG(label) AS x FROM cl GROUP BY 1, 2, 3), h AS (SELECT model, AVG(abs(x)) * 100 AS pe FROM g GROUP BY 1)
SELECT model, ROUND(brier, 6) AS brier, ROUND(ll, 6) AS log_loss, ROUND(ece, 6) AS ece, ROUND(auc, 6) AS auc, ROUND(pe, 6) AS package_error
FROM a JOIN e USING (model) JOIN u USING (model) JOIN h USING (model)"""))
def scores(spark, d):
    st = K.stack_years(training(spark, d), CHECK)
    def rate(by, name):
        r = st.groupBy(by).agg(F.round(F.avg("label"), 6).alias("prob"))
        return st.join(r, by).select(F.lit(name).alias("model"), "scenario", "year", "label", "prob")
    s = K.risk_scores(rate("year", "year_rate").unionByName(rate("scenario", "setting_rate")))
    return s.withColumns({c: F.round(c, 6) for c in ("brier", "log_loss", "ece", "auc", "package_error")})


@query("j09_range_scores", sql("ledger", f"""WITH {RISK}, {CDF}
SELECT ROUND(AVG(CASE WHEN run_out BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 8) AS coverage, ROUND(AVG(high - low), 8) AS avg_width,
  ROUND(AVG(abs(median - run_out)), 8) AS median_error FROM rt JOIN qy USING (scenario)"""))
def range_scores(spark, d):
    t = training(spark, d)
    r = K.range_scores(t.join(K.quantile_years(empirical_cdf(t), ["scenario"], 0.10), "scenario"))
    return r.select(*[F.round(c, 8).alias(c) for c in r.columns])


def fitted(spark, d):
    """Four models of the chance, the linear one of the year with its width, and the three parts.

    Trees take most of the time, in many short jobs that leave executors idle, so the other models are fitted meanwhile.
    """
    train, cal, test = parts(spark, d)
    stacked = K.stack_random_years(train, PER_RUN, S.BASE_YEAR, NEVER - 1)

    def trees():
        score = K.risk_classifier(stacked)
        return score, K.isotonic_calibration(score(K.stack_random_years(cal, PER_RUN, S.BASE_YEAR, NEVER - 1, "cal")))

    (score, fix), logit, line = side_by_side(spark, trees, lambda: K.logistic_risk(stacked), lambda: K.linear_conformal(train, cal, 0.10))
    return score, fix, logit, K.base_rate(stacked), line, (train, cal, test)


@query("j09_model_scores")
def model_scores(spark, d):
    """Scores of four models on packages none of them saw, and of the ranges of two; long: (model, score, value)."""
    score, fix, logit, rates, (line, w), (_, cal, test) = fitted(spark, d)
    pred, (curve, _) = side_by_side(
        spark, lambda: K.model_predictions(K.stack_years(test, CHECK), score, fix, logit, rates).checkpoint(),
        lambda: K.conformal_years(cal, test, score, 0.10, S.BASE_YEAR, NEVER - 1))
    half = w.scalar()
    flat = line(test).select("run_out", F.col("linear").alias("median"), (F.col("linear") - half).alias("low"), (F.col("linear") + half).alias("high"))
    ranges_ = [K.range_scores(r).withColumn("model", F.lit(m)) for m, r in (("boosted_conformal", curve), ("linear_conformal", flat))]

    def long(t):
        return t.unpivot("model", [c for c in t.columns if c != "model"], "score", "value")
    return long(K.risk_scores(pred)).unionByName(long(ranges_[0])).unionByName(long(ranges_[1]))


@query("j10_driver_ranges", sql("paths", """
WITH v AS (SELECT run, AVG(inflation) * 100 AS avg_inflation, AVG(real_return) * 100 AS avg_return, AVG(real_growth) * 100 AS avg_growth, MAX(mortality_mult) AS mortality_level
  FROM paths WHERE t <= 19 GROUP BY 1), l AS (UNPIVOT v ON avg_inflation, avg_return, avg_growth, mortality_level INTO NAME driver VALUE value)
SELECT driver, ROUND(quantile_cont(value, 0.01), 8) AS p1, ROUND(quantile_cont(value, 0.99), 8) AS p99, ROUND(MAX(CASE WHEN run = 0 THEN value END), 8) AS central FROM l GROUP BY 1"""))
def ranges(spark, d):
    r = K.driver_ranges(R.run_drivers(V.paths(spark, d), 19))
    return r.withColumns({c: F.round(c, 8) for c in ("p1", "p99", "central")})


FEATS = ["lever_rise", "lever_inflation", "bin_inflation", "bin_return", "bin_mortality"]


@query("j11_driver_importance", sql("ledger", f"""WITH {RISK},
bn AS (SELECT lever_rise, lever_inflation, CAST(floor(ROUND(avg_inflation, 9) * 20) AS BIGINT) AS bin_inflation, CAST(floor(ROUND(avg_return, 9) * 40) AS BIGINT) AS bin_return,
  CAST(floor(ROUND(mortality_level, 9) * 20) AS BIGINT) AS bin_mortality, run_out AS y, 1 AS n FROM rt),
{shapley_sql('bn', FEATS, 'phi')}
""" + " UNION ALL ".join(f"SELECT '{f}' AS driver, ROUND(SUM(abs(phi_{f}) * n) / SUM(n), 6) AS importance FROM phi" for f in FEATS)))
def driver_importance(spark, d):
    t = training(spark, d)
    b = t.select("lever_rise", "lever_inflation", F.floor(F.round("avg_inflation", 9) * 20).alias("bin_inflation"),
                 F.floor(F.round("avg_return", 9) * 40).alias("bin_return"), F.floor(F.round("mortality_level", 9) * 20).alias("bin_mortality"),
                 F.col("run_out").alias("y"), F.lit(1).alias("n"))
    return importance(b, FEATS, "y", "n").withColumn("importance", F.round("importance", 6))

"""Queries: what moves the predictions of fitted models (exits, cost, policies, run-out year)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import ensure_checkpoint_dir
from ..operators import explain as X
from ..operators import panel as P
from ..operators import scenarios as R
from . import funds
from . import risks
from . import settings as S
from . import views as V
from .panels import SECTORS, split
from .registry import query
from .sqlviews import sql

LAST = 19               # the result year, and the last one whose drivers count
DRIVERS = {"growth": ["avg_growth"], "inflation": ["avg_inflation"], "revenue": ["avg_revenue"], "return": ["avg_return"],
           "mortality": ["mortality_level"]}
POLICY = {"pay": ["lever_inflation", "lever_targeted", "lever_raise"], "retirement": ["lever_age"],
          "formula": ["lever_accrual", "lever_rate"], "contribution": ["lever_rise", "lever_employee", "lever_employer"],
          "hiring": ["lever_hiring", "lever_restraint"],
          "economy": ["avg_growth", "avg_inflation", "avg_return", "mortality_level"]}
EXITS = {"age": ["x_age"], "service": ["x_service"], "year": ["x_year"], "eligible60": ["x_eligible60"],
         "sector": [f"x_sector_{i}" for i in range(len(SECTORS))], "framework": [f"x_fw_{f}" for f in S.FRAMEWORKS]}


def names(groups):
    return [f for fs in groups.values() for f in fs]


def drivers(spark, d):
    paths = V.paths(spark, d)
    revenue = paths.where(F.col("t") <= LAST).groupBy("run").agg((F.avg("revenue_share") * 100).alias("avg_revenue"))
    return R.run_drivers(paths, LAST).join(revenue, "run")


def cost(spark, d):
    """Scenario x run: total cost in the result year beside drivers and levers, written for the trees that read it often."""
    ensure_checkpoint_dir(spark)
    series, _ = funds.outcomes(spark, d)
    levers = F.broadcast(R.lever_features(spark.createDataFrame(S.SCENARIOS, S.SCENARIO_SCHEMA)).select("scenario", *R.LEVERS))
    return (series.where(F.col("t") == LAST).select("scenario", "run", F.col("total_cost_gdp").alias("cost"))
            .join(drivers(spark, d), "run").join(levers, "scenario").checkpoint())


def explained(rows, groups, value, keys=(), **how):
    return X.contributions(rows, groups, X.boosted(rows, names(groups), value, **how), keys)


@query("j11_exit_contributions")
def exit_model(spark, d):
    """Which features drive the fitted separation hazard, over person-years at risk."""
    _, train, _ = split(spark, d)
    rows = P.hazard_features(train, SECTORS, S.FRAMEWORKS)
    return X.mean_contributions(explained(rows, EXITS, "y", chance=True, depth=5), EXITS)


@query("j11_cost_contributions")
def cost_drivers(spark, d):
    """Which random drivers move the base scenario's cost."""
    rows = cost(spark, d).where(F.col("scenario") == S.SCENARIOS[0][0])
    return X.mean_contributions(explained(rows, DRIVERS, "cost"), DRIVERS)


@query("j11_policy_contributions")
def policy(spark, d):
    """Levers against the economy over all scenarios, and per scenario."""
    part = explained(cost(spark, d), POLICY, "cost", ("scenario",)).checkpoint()
    every = X.mean_contributions(part, POLICY).withColumn("scenario", F.lit("all"))
    return every.unionByName(X.mean_contributions(part, POLICY, ("scenario",)))


@query("j11_run_out_contributions")
def run_out(spark, d):
    """Years that each group moves the predicted run-out year of a package from the average package."""
    rows = risks.training(spark, d, risks.SETTINGS)
    return X.mean_contributions(explained(rows, POLICY, "run_out", ("scenario",)), POLICY, ("scenario",))


@query("j11_contributions_add_up", sql("outcomes", f"""
SELECT scenario, COUNT(*) AS n, ROUND(AVG(total_cost_gdp), 6) AS cost, CAST(0 AS DOUBLE) AS gap FROM outcomes WHERE t = {LAST} GROUP BY 1"""))
def add_up(spark, d):
    """Rows explained per scenario, their mean cost, and the largest gap between contributions and the prediction."""
    rows = cost(spark, d)
    part = explained(rows, POLICY, "cost", ("scenario",))
    gap = F.abs(F.col("predicted") - F.col("base") - sum((F.col(f"phi_{g}") for g in POLICY), F.lit(0.0)))
    split_ = part.groupBy("scenario").agg(F.sum("weight").alias("n"), F.round(F.max(gap), 6).alias("gap"))
    return rows.groupBy("scenario").agg(F.round(F.avg("cost"), 6).alias("cost")).join(split_, "scenario").select("scenario", "n", "cost", "gap")

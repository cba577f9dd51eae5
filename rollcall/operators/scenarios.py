"""Paths, scenario summaries and reform packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import exact_quantiles, ordered_scan


def blend_to_anchor(forecast: DataFrame, anchors: dict[str, float], years: int) -> DataFrame:
    """Blend a forecast (series, h, value) linearly into long-run values over ``years`` steps."""
    anchor = None
    for s, v in anchors.items():
        anchor = F.when(F.col("series") == s, v) if anchor is None else anchor.when(F.col("series") == s, v)
    w = F.least(F.col("h") / years, F.lit(1.0))
    return forecast.withColumn("value", (1 - w) * F.col("value") + w * anchor)


def level_index(paths: DataFrame) -> DataFrame:
    """CPI and GDP levels per run, 1 in the base year. A run has one row per year of the horizon."""
    w = Window.partitionBy("run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    up = {"cpi": 1 + F.col("inflation"), "gdp": (1 + F.col("real_growth")) * (1 + F.col("inflation"))}
    return paths.withColumns({c: F.product(e).over(w) for c, e in up.items()}).withColumns(
        {c: F.col(c) / F.first(c).over(w) for c in up})


FAN = {"p5": 0.05, "p50": 0.5, "p95": 0.95}


def fan_long(series: DataFrame, metrics: tuple[str, ...], keys: list[str], central_run: int = 0) -> DataFrame:
    """5th, 50th and 95th percentile over runs and the central run, per key and metric."""
    long = unpivot_metrics(series, metrics, [*keys, "run"])
    bands = exact_quantiles(long, [*keys, "metric"], "value", FAN)
    central = long.where(F.col("run") == central_run).select(*keys, "metric", F.col("value").alias("central"))
    return bands.join(central, [*keys, "metric"], "left")


def unpivot_metrics(df: DataFrame, metrics: tuple[str, ...], keys: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    return df.select(*keys, F.explode(F.array(*rows)).alias("_m")).select(*keys, "_m.metric", "_m.value")


def scenario_summary(series: DataFrame, depletion: DataFrame, metrics: tuple[str, ...], horizons: list[int],
                     central_run: int = 0) -> DataFrame:
    """One row per scenario: bands and central value of each metric at each horizon, and run-out figures."""
    at = series.where(F.col("t").isin(*horizons))
    fans = fan_long(at, metrics, ["scenario", "t"], central_run)
    wide = fans.groupBy("scenario").agg(*[
        F.max(F.when((F.col("metric") == m) & (F.col("t") == h), F.col(c))).alias(f"{m}_{h}_{c}")
        for m in metrics for h in horizons for c in (*FAN, "central")])
    ran_out = depletion.where(F.col("depletion_year") > 0)
    medians = exact_quantiles(ran_out, ["scenario"], "depletion_year", {"median_depletion_year": 0.5})
    share = depletion.groupBy("scenario").agg(
        F.avg((F.col("depletion_year") > 0).cast("double")).alias("prob_depleted"),
        F.max(F.when((F.col("run") == central_run) & (F.col("depletion_year") > 0), F.col("depletion_year"))).alias("central_depletion_year"))
    return wide.join(share, "scenario").join(medians, "scenario", "left")


def windowed_adequacy(adequacy: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Average and lowest replacement and floor share per scenario over spans of years, weighted by retirees."""
    cols = []
    for name, (a, b) in windows.items():
        on = F.col("t").between(a, b)
        w = F.sum(F.when(on, F.col("retirees")))
        cols += [F.try_divide(F.sum(F.when(on, F.col("avg_replacement") * F.col("retirees"))), w).alias(f"avg_replacement_{name}"),
                 F.min(F.when(on, F.col("min_replacement"))).alias(f"min_replacement_{name}"),
                 F.try_divide(F.sum(F.when(on, F.col("share_on_minimum") * F.col("retirees"))), w).alias(f"share_on_minimum_{name}")]
    return adequacy.groupBy("scenario").agg(*cols)


def combine_scenarios(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Stack scenario tables (presets, saved, uploaded) with the name of their set."""
    out = None
    for name, df in tables:
        df = df.withColumn("scenario_set", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def run_drivers(paths: DataFrame, last_t: int) -> DataFrame:
    """Per run: average inflation, return and growth up to a year in percent, and the mortality level."""
    return paths.where(F.col("t") <= last_t).groupBy("run").agg(
        (F.avg("inflation") * 100).alias("avg_inflation"), (F.avg("real_return") * 100).alias("avg_return"),
        (F.avg("real_growth") * 100).alias("avg_growth"), F.max("mortality_mult").alias("mortality_level"))


LEVERS = ("lever_age", "lever_accrual", "lever_rate", "lever_rise", "lever_employee", "lever_employer", "lever_inflation",
          "lever_targeted", "lever_raise", "lever_hiring", "lever_restraint")


def lever_features(df: DataFrame) -> DataFrame:
    """Numeric form of the scenario columns of ``df``."""
    accrual = F.col("pension_formula") == "accrual"
    exprs = [F.col("retirement_age_target"), accrual.cast("double"), F.when(accrual, F.col("accrual_rate")).otherwise(0.0),
             F.when(F.col("contribution_step") > 0, F.col("contribution_cap")).otherwise(0.0), F.col("employee_rate"),
             F.col("employer_rate"), (F.col("salary_rule") == "inflation").cast("double"),
             (F.col("salary_rule") == "targeted").cast("double"), F.col("recent_raise"), F.col("hiring_growth"),
             F.col("restrain").cast("double")]
    return df.withColumns(dict(zip(LEVERS, exprs)))


def light(p: Column, green: float = 0.10, red: float = 0.50) -> Column:
    return F.when(p >= red, "red").when(p >= green, "amber").otherwise("green")


def depletion_curve(depletion: DataFrame, years: list[int]) -> DataFrame:
    """Share of runs that have run out by each check year, with its traffic light."""
    ran_out = F.col("depletion_year") > 0
    wide = depletion.groupBy("scenario").agg(*[
        F.avg((ran_out & (F.col("depletion_year") <= y)).cast("double")).alias(f"y{y}") for y in years])
    rows = [F.struct(F.lit(y).alias("year"), F.col(f"y{y}").alias("chance")) for y in years]
    long = wide.select("scenario", F.explode(F.array(*rows)).alias("_r")).select("scenario", "_r.year", "_r.chance")
    return long.withColumn("light", light(F.col("chance")))


def depletion_range(depletion: DataFrame, never: int) -> DataFrame:
    """5th, 50th and 95th percentile of the run-out year with "never" after the horizon; no median when never."""
    d = depletion.withColumn("_y", F.when(F.col("depletion_year") > 0, F.col("depletion_year")).otherwise(never))
    q = exact_quantiles(d, ["scenario"], "_y", {"low": 0.05, "median": 0.5, "high": 0.95})
    return q.withColumn("median", F.when(F.col("median") < never, F.col("median")))


def delta_vs_baseline(summary: DataFrame, metrics: list[str], base: str) -> DataFrame:
    """Change of every metric against the base scenario (one row, read as scalars)."""
    ref = summary.where(F.col("scenario") == base)
    return summary.select("scenario", *metrics, *[
        (F.col(m) - ref.select(m).scalar()).alias(f"{m}_change") for m in metrics])


# ---- package grid: fixed values ----
GRID_AGES = tuple(range(55, 63))
GRID_ACCRUAL = (None, 0.015, 0.0175, 0.02, 0.0225, 0.025, 0.0275, 0.03)
GRID_RISE = (0.0, 0.01, 0.02, 0.03, 0.04)
GRID_PAY = ("recent_average", "inflation", "targeted")
# ---- end of fixed values ----


def package_grid(df: DataFrame, pay_levers: bool = False) -> DataFrame:
    """Repeat every row for each lever combination (320, or 1,920 with pay levers), inside the task."""
    def each(values, kind):
        return F.explode(F.array(*[F.lit(v).cast(kind) for v in values]))
    df = (df.withColumn("package_age", each(GRID_AGES, "int")).withColumn("package_accrual", each(GRID_ACCRUAL, "double"))
          .withColumn("package_rise", each(GRID_RISE, "double")))
    if pay_levers:
        return df.withColumn("package_pay", each(GRID_PAY, "string")).withColumn("package_restrain", each((False, True), "boolean"))
    return df.withColumns({"package_pay": F.lit(GRID_PAY[0]), "package_restrain": F.lit(False)})


PACKAGE = ("package_age", "package_accrual", "package_rise", "package_pay", "package_restrain")


def package_scenario(df: DataFrame) -> DataFrame:
    """Scenario columns of each package, on top of the status quo."""
    accrual = F.col("package_accrual").isNotNull()
    return df.withColumns({
        "retirement_age_target": F.col("package_age").cast("double"),
        "phase_years": F.when(F.col("package_age") > 55, 10).otherwise(0),
        "pension_formula": F.when(accrual, "accrual").otherwise("current"),
        "accrual_rate": F.coalesce("package_accrual", F.lit(0.02)),
        "contribution_step": F.when(F.col("package_rise") > 0, 0.01).otherwise(0.0),
        "contribution_cap": F.col("package_rise"), "salary_rule": F.col("package_pay"), "restrain": F.col("package_restrain")})


def package_objectives(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Per package: median over runs of the run's mean cost; mean adequacy, floor share, share of runs depleted.

    ``outcomes`` has one row per (package, run, year).
    """
    runs = outcomes.groupBy(*keys, "run").agg(
        F.avg("cost").alias("_cost"), F.avg("adequacy").alias("_adequacy"), F.avg("on_minimum").alias("_min"),
        F.max((F.col("topup") > 0).cast("double")).alias("_out"))
    # packages can have null levers, so the join key is one string
    runs = runs.withColumn("_key", F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys]))
    medians = exact_quantiles(runs, ["_key"], "_cost", {"cost": 0.5})
    means = runs.groupBy("_key", *keys).agg(F.avg("_adequacy").alias("adequacy"), F.avg("_min").alias("share_on_minimum"),
                                            F.avg("_out").alias("prob_depleted"))
    return means.join(medians, "_key").drop("_key")


def local_fronts(df: DataFrame, by: list[str], cost: str, adequacy: str) -> DataFrame:
    """The rows (by, cost, adequacy) that no row of their own partition beats: all that a front can be made of.

    A task holds its front so far and one batch. Rows with a missing value are left out.
    """
    def task(parts):
        import pandas as pd
        held = None
        for part in parts:
            rows = part if held is None else pd.concat([held, part])
            rows = rows.sort_values([*by, cost, adequacy], ascending=[True] * (len(by) + 1) + [False])
            own = rows.groupby(by, dropna=False, sort=False)[adequacy] if by else rows[adequacy]
            best = own.cummax()
            before = best.groupby([rows[c] for c in by], dropna=False, sort=False).shift() if by else best.shift()
            held = rows[before.isna() | (rows[adequacy] > before)]
        if held is not None:
            yield held
    there = df.where(F.col(cost).isNotNull() & F.col(adequacy).isNotNull()).select(*by, cost, adequacy)
    return there.mapInPandas(task, there.schema)


def pareto_front(df: DataFrame, cost: str, adequacy: str, by: list[str] = ()) -> DataFrame:
    """Mark rows no other row beats: at least as cheap and as adequate, and better in one.

    Every partition keeps its own front, and only the union of these is scanned in order of cost for the best adequacy
    at any lower cost. Rows with a missing value are never beaten.
    """
    by = list(by)
    best = local_fronts(df, by, cost, adequacy).groupBy(*by, F.col(cost).alias("_c")).agg(F.max(adequacy).alias("_best"))
    scan = ordered_scan(best, by, "_c", maxes={"_cheaper": "_best"}).where(F.col("_cheaper").isNull() | (F.col("_cheaper") < F.col("_best")))
    points = scan.select(*by, F.col("_c").alias(cost), F.col("_best").alias(adequacy), F.lit(True).alias("_on"))
    missing = F.col(cost).isNull() | F.col(adequacy).isNull()
    for c in by:
        missing = missing | F.col(c).isNull()
    return df.join(points, [*by, cost, adequacy], "left").withColumn("on_front", F.coalesce("_on", missing)).select(*df.columns, "on_front")


def hypervolume(df: DataFrame, cost: str, adequacy: str, ref_cost: Column, ref_adequacy: Column) -> DataFrame:
    """Area the points dominate relative to a reference point.

    Each distinct cost adds its gain in adequacy over all cheaper points, times the distance to the
    reference cost, so no neighbour lookup is needed and dominated points add nothing.
    """
    best = local_fronts(df, [], cost, adequacy).groupBy(F.col(cost).alias("_c")).agg(F.max(adequacy).alias("_best"))
    scan = ordered_scan(best, [], "_c", maxes={"_cheaper": "_best"})
    gain = F.greatest("_best", ref_adequacy) - F.greatest(F.coalesce("_cheaper", ref_adequacy), ref_adequacy)
    return scan.agg(F.coalesce(F.sum((ref_cost - F.col("_c")) * F.greatest(gain, F.lit(0.0))), F.lit(0.0)).alias("hypervolume"))


def compare_fronts(found: DataFrame, everything: DataFrame, keys: list[str]) -> DataFrame:
    """Hypervolume ratio of the found packages to all, size of the true front, how much of it was found."""
    ref_c = everything.agg(F.max("cost") * 1.01).scalar()
    ref_a = everything.agg(F.min("adequacy") - 0.01).scalar()
    true_hv = hypervolume(everything, "cost", "adequacy", ref_c, ref_a).scalar()
    front = pareto_front(everything, "cost", "adequacy").where("on_front")
    on = None
    for k in keys:
        e = front[k].eqNullSafe(found[k])
        on = e if on is None else on & e
    hits = front.join(found, on, "left_semi").agg(F.count("*")).scalar()
    size = front.agg(F.count("*").alias("true_front_size"))
    return size.select((hypervolume(found, "cost", "adequacy", ref_c, ref_a).scalar() / true_hv).alias("hypervolume_ratio"),
                       "true_front_size", hits.alias("true_front_found"))


def best_for_target(front: DataFrame, keep: list[str], min_adequacy: float | None = None,
                    max_cost: float | None = None) -> DataFrame:
    """Cheapest package with enough adequacy, or most adequate one within a cost; the closest when none fits."""
    if min_adequacy is not None:
        fits, pick, near = F.col("adequacy") >= min_adequacy, F.struct("cost", *keep), F.struct(-F.col("adequacy"), *keep)
    else:
        fits, pick, near = F.col("cost") <= max_cost, F.struct(-F.col("adequacy"), *keep), F.struct("cost", *keep)
    row = F.struct(*keep)
    best = front.agg(F.min_by(F.when(fits, row), F.when(fits, pick)).alias("_hit"), F.min_by(row, near).alias("_near"))
    return best.select(F.when(F.col("_hit").isNotNull(), "found").otherwise("closest").alias("status"),
                       *[F.coalesce(F.col("_hit"), F.col("_near"))[k].alias(k) for k in keep])


def breakeven_level(sweep: DataFrame, by: list[str], level: str, value: str, target: Column) -> DataFrame:
    """Smallest lever level whose value meets the target, interpolated from the level before; null when none does.

    A sweep has one row per lever level.
    """
    w = Window.partitionBy(*by).orderBy(level)
    s = sweep.withColumns({"_pl": F.lag(level).over(w), "_pv": F.lag(value).over(w)})
    cross = F.when(F.col("_pv").isNull(), F.col(level)).otherwise(
        F.col("_pl") + (target - F.col("_pv")) / F.nullif(F.col(value) - F.col("_pv"), F.lit(0.0)) * (F.col(level) - F.col("_pl")))
    return s.groupBy(*by).agg(F.min_by(F.when(F.col(value) >= target, cross), F.when(F.col(value) >= target, F.col(level))).alias("breakeven"))


def first_paths(paths: DataFrame, n: int) -> DataFrame:
    """The common subset of runs used to compare packages: run numbers below n."""
    return paths.where(F.col("run") < n)

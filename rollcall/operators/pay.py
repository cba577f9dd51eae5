"""Wage bill, benefits and the fund, as tables keyed by scenario, run and year index t.

Scenario parameters are columns, so all scenarios go through one plan. Cohort tables (units, retirees)
are aggregated before they meet the run axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import keyed_lookup, parameter_structs, with_small_table
from ..functions.ordered import exact_quantiles
from .quality import expected_pay


def wage_units(stocks: DataFrame, scale: dict[str, float], step: float, allowance: dict[str, float]) -> DataFrame:
    """Annual basic and total pay at base-year pay levels, by year index and sector."""
    yearly = F.col("n") * expected_pay("framework", "service", scale, step) * 12
    out = stocks.groupBy("t", "sector").agg(F.sum(yearly).alias("basic_units"))
    return out.withColumn("total_units", F.col("basic_units") * (1 + keyed_lookup(allowance, "sector")))


def salary_index(paths: DataFrame, sectors: tuple[str, ...], priority: tuple[str, ...]) -> DataFrame:
    """Pay level index per scenario, run, year and sector; 1 in the base year.

    ``paths`` carries the scenario columns (see ``with_parameters``), so this is a projection.
    """
    sector = F.explode(F.array(*[F.lit(s) for s in sectors])).alias("sector")
    t = F.col("t")
    raise_ = F.when(F.col("sector").isin(*priority), F.col("raise_priority")).otherwise(F.col("raise_other"))
    idx = (F.when(F.col("salary_rule") == "inflation", F.col("cpi"))
           .when(F.col("salary_rule") == "targeted", F.pow(1 + raise_, t))
           .otherwise(F.pow(1 + F.col("recent_raise"), t)))
    return paths.select("*", sector).withColumn("idx", idx)


def wage_bill(units: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """Nominal wage bill and basic payroll per scenario, run and year. ``units`` has one row per ``on`` key."""
    return (index.join(units, on).groupBy("scenario", "run", "t")
            .agg(F.sum(F.col("total_units") * F.col("idx")).alias("wage_bill"),
                 F.sum(F.col("basic_units") * F.col("idx")).alias("basic_payroll")))


def survival(df: DataFrame, life: DataFrame, age: str, years: str, level: Column, out: str = "alive") -> DataFrame:
    """P(alive ``years`` after ``age``) with the mortality level scaling the cumulative hazard.

    The life table has 112 rows, so its two lookups are broadcast.
    """
    top = 111
    start = F.broadcast(life.select(F.col("age").alias("_a0"), F.col("cumhaz").alias("_h0")))
    end = F.broadcast(life.select(F.col("age").alias("_a1"), F.col("cumhaz").alias("_h1")))
    return (df.withColumn("_s", F.least(F.col(age), F.lit(top))).withColumn("_e", F.least(F.col(age) + F.col(years), F.lit(top)))
            .join(start, F.col("_s") == F.col("_a0")).join(end, F.col("_e") == F.col("_a1"))
            .withColumn(out, F.exp(-level * (F.col("_h1") - F.col("_h0"))))
            .drop("_s", "_e", "_a0", "_h0", "_a1", "_h1"))


def rate_rise(t: Column) -> Column:
    """A stepwise rise up to a cap, the same for employees and employers."""
    return F.when(F.col("contribution_step") > 0, F.least(
        F.floor(t / F.col("contribution_every")) * F.col("contribution_step"), F.col("contribution_cap"))).otherwise(0.0)


def contribution_rates(df: DataFrame) -> DataFrame:
    """Add employee and employer rates: a stepwise rise up to a cap, the same on both sides."""
    extra = rate_rise(F.col("t"))
    return df.withColumns({"employee": F.col("employee_rate") + extra, "employer": F.col("employer_rate") + extra})


def contributions(df: DataFrame, payroll: str = "basic_payroll") -> DataFrame:
    """Employee and employer contributions on basic payroll; needs the rates of ``contribution_rates``."""
    return df.withColumns({"contrib_employee": F.col(payroll) * F.col("employee"),
                           "contrib_employer": F.col(payroll) * F.col("employer")})


def average_salary_factor(index: DataFrame, step: float, revalue: bool) -> DataFrame:
    """Average basic pay of the last N years over final basic pay, per scenario, run, year and sector.

    Revalued: only the step increments count. Otherwise pay levels of the years before count too, back-cast
    at the recent raise before the base year. The array holds one number per year of the horizon.
    """
    n = F.col("accrual_years")
    if revalue:
        if step == 0:
            return index.withColumn("factor", F.lit(1.0))
        r = 1 / (1 + step)  # the steps form a geometric series
        return index.withColumn("factor", (1 - F.pow(F.lit(r), n)) / (1 - r) / n)
    keys = ["scenario", "run", "sector"]
    packed = index.groupBy(*keys, "accrual_years", "recent_raise").agg(
        F.map_from_entries(F.collect_list(F.struct("t", "idx"))).alias("_idx"))

    def one(t: Column, idx: Column) -> Column:
        def ratio(j: Column) -> Column:
            earlier = F.element_at("_idx", t - j) / idx
            before = F.element_at("_idx", F.lit(0)) / idx / F.pow(1 + F.col("recent_raise"), j - t)
            return F.when(t - j >= 0, earlier).otherwise(before) / F.pow(F.lit(1 + step), j)
        terms = F.transform(F.sequence(F.lit(0), n - 1), ratio)
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / n

    rows = packed.select(*keys, "_idx", "accrual_years", "recent_raise", F.explode("_idx").alias("t", "idx"))
    return rows.select(*keys, "t", "idx", one(F.col("t"), F.col("idx")).alias("factor"))


def counted_index(index: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of the index that agree in ``fields`` as one row, with their number as ``runs``.

    Pay that follows no run's own path is the same in all runs; equal rows meet in the task that holds them, before the shuffle.
    """
    return index.groupBy(*fields).agg(F.count("*").alias("runs"))


def initial_benefit(retirees: DataFrame, index: DataFrame, scale: dict[str, float], step: float, min_service: int,
                    replacement: float, min_pension: float, cap: float) -> DataFrame:
    """First-year benefit of each retiring cohort per scenario and run.

    ``index`` has idx, pension index pidx, factor and the scenario's formula per (scenario, run, t, sector);
    ``retirees`` has n per (t, sector, framework, age, service).
    """
    final = expected_pay("framework", "service", scale, step) * 12 * F.col("idx")
    rate = F.least(F.col("accrual_rate") * F.col("service"), F.lit(cap))
    formula = F.when(F.col("pension_formula") == "accrual", rate * F.col("final") * F.col("factor")).otherwise(replacement * F.col("final"))
    df = index.join(retirees, ["t", "sector"]).withColumn("final", final)
    df = df.withColumns({"formula": formula, "floor": min_pension * 12 * F.col("pidx"),
                         "eligible": F.col("service") >= min_service})
    return df.withColumn("benefit", F.when(F.col("eligible"), F.greatest("formula", "floor")).otherwise(0.0))


def lump_sums(benefits: DataFrame, months_per_year: float) -> DataFrame:
    """Paid to those below the minimum service, and the number of new pensioners, per scenario, run and year."""
    paid = F.when(F.col("eligible"), 0.0).otherwise(F.col("n") * F.col("final") / 12 * months_per_year * F.col("service"))
    return benefits.groupBy("scenario", "run", "t").agg(
        F.sum(paid).alias("lump_sum"), F.sum(F.when(F.col("eligible"), F.col("n")).otherwise(0)).alias("new_pensioners"))


def adequacy(benefits: DataFrame, allowance: dict[str, float], central_run: int = 0) -> DataFrame:
    """Replacement rates, floor share and service of new pensioners on the central run, weighted by people."""
    b = benefits.where((F.col("run") == central_run) & F.col("eligible"))
    basic = F.col("benefit") / F.col("final")
    total = basic / (1 + keyed_lookup(allowance, "sector"))
    w = F.sum("n")
    return b.groupBy("scenario", "t").agg(
        w.alias("retirees"), (F.sum(total * F.col("n")) / w).alias("avg_replacement"),
        (F.sum(basic * F.col("n")) / w).alias("avg_replacement_basic"), F.min(total).alias("min_replacement"),
        (F.sum(F.when(F.col("formula") <= F.col("floor"), F.col("n")).otherwise(0)) / w).alias("share_on_minimum"),
        (F.sum(F.col("service") * F.col("n")) / w).alias("avg_service"))


def benefit_run_off(benefits: DataFrame, pension_index: DataFrame, life: DataFrame, last_t: int) -> DataFrame:
    """Payments in every later year to the cohorts that retire: indexed, and paid while they live.

    Cohorts collapse to (retirement year, age, sector) before the payment years are unfolded; catalyst
    does not push an aggregation below an explode.
    """
    start = (benefits.groupBy("scenario", "run", "sector", "age", F.col("t").alias("t0"), "mortality_mult")
             .agg((F.sum(F.col("benefit") * F.col("n")) / F.max("pidx")).alias("amount"))
             .where(F.col("amount") > 0))
    years = (start.where(F.col("t0") < last_t)
             .withColumn("t", F.explode(F.sequence(F.col("t0") + 1, F.lit(last_t))))
             .withColumns({"_from": F.col("age") + 1, "_n": F.col("t") - F.col("t0") - 1}))
    paid = survival(years, life, "_from", "_n", F.col("mortality_mult"))
    by_sector = paid.groupBy("scenario", "run", "t", "sector").agg(F.sum(F.col("amount") * F.col("alive")).alias("_due"))
    # both sides grow with runs, but sizes estimated below an explode are far too small: never broadcast the index
    pidx = pension_index.select("scenario", "run", "t", "sector", "pidx").hint("merge")
    return (by_sector.join(pidx, ["scenario", "run", "t", "sector"])
            .groupBy("scenario", "run", "t").agg(F.sum(F.col("_due") * F.col("pidx")).alias("payments")))


def register_payments(by_age: DataFrame, runs: DataFrame, life: DataFrame) -> DataFrame:
    """Payments to pensioners already in the register. ``by_age`` is (age, amount), at most one row per age;
    ``runs`` has mortality_mult and the economy-wide pension index per (scenario, run, t).

    Each mortality level is worked out once per (age, t) and shared by the runs that have it.
    """
    levels = runs.groupBy("mortality_mult", "t").agg(F.count("*").alias("_n"))
    due = survival(with_small_table(levels, by_age), life, "age", "t", F.col("mortality_mult"))
    due = due.groupBy("mortality_mult", "t").agg(F.sum(F.col("amount") * F.col("alive")).alias("_due"))
    return (runs.join(due, ["mortality_mult", "t"])
            .select("scenario", "run", "t", (F.col("_due") * F.col("pidx_all")).alias("payments")))


def nominal_return() -> Column:
    return (1 + F.col("real_return")) * (1 + F.col("inflation")) - 1


def fund_ledger(flows: DataFrame, reserve: float) -> DataFrame:
    """Fund balance with nominal return, never below zero; a shortfall is a top-up.

    One array per (scenario, run) with one entry per year of the horizon, folded in year order.
    """
    r = nominal_return()
    net = F.col("contrib_employee") + F.col("contrib_employer") - F.col("pension_spending")
    packed = flows.groupBy("scenario", "run").agg(
        F.array_sort(F.collect_list(F.struct("t", r.alias("r"), net.alias("net")))).alias("_y"))

    def fold(acc: Column, y: Column) -> Column:
        raw = acc["f"] * (1 + y["r"]) + y["net"]
        f, top = F.when(raw < 0, 0.0).otherwise(raw), F.when(raw < 0, -raw).otherwise(0.0)
        row = F.struct(y["t"].alias("t"), f.alias("fund_balance"), top.alias("gov_topup"))
        return F.struct(f.alias("f"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    empty = F.expr("cast(array() as array<struct<t:int,fund_balance:double,gov_topup:double>>)")
    rows = F.aggregate("_y", F.struct(F.lit(float(reserve)).alias("f"), empty.alias("rows")), fold, lambda a: a["rows"])
    return packed.select("scenario", "run", F.inline(rows))


def depletion_year(ledger: DataFrame, base_year: int) -> DataFrame:
    """First year with a top-up per scenario and run; 0 when there is none."""
    first = F.min(F.when(F.col("gov_topup") > 0, base_year + F.col("t")))
    return ledger.groupBy("scenario", "run").agg(F.coalesce(first, F.lit(0)).alias("depletion_year"))


def run_out_years(payroll: DataFrame, by: str, rates: dict, schema: str, reserve: float, base_year: int) -> DataFrame:
    """``depletion_year`` of the fund per (setting, run), without a row for each year of its balance. The reserve is not negative.

    ``payroll`` has a row per (``by``, run, t) with basic_payroll, pension_spending and the returns. ``rates`` maps a value of
    ``by`` to its parameter rows (``schema``: the setting's name, then its contribution rates). A run's years are packed once for
    each value of ``by``; its settings are unfolded from there, inside the task.
    """
    packed = payroll.groupBy(by, "run").agg(F.array_sort(F.collect_list(F.struct(
        "t", nominal_return().alias("r"), F.col("basic_payroll").alias("pay"), F.col("pension_spending").alias("out")))).alias("_y"))
    rows = F.create_map(*[c for value, some in rates.items() for c in (F.lit(value), F.array(*parameter_structs(some, schema)))])
    unfolded = packed.select("run", "_y", F.explode(rows[F.col(by)]).alias("_p")).select("run", "_y", "_p.*")

    def fold(acc: Column, y: Column) -> Column:
        rise = rate_rise(y["t"])
        net = y["pay"] * (F.col("employee_rate") + rise) + y["pay"] * (F.col("employer_rate") + rise) - y["out"]
        year = F.struct((acc["raw"] * (1 + y["r"]) + net).alias("raw"), y["t"].alias("t"))
        return F.when(acc["raw"] < 0, acc).otherwise(year)          # stops at the first shortfall

    start = F.struct(F.lit(float(reserve)).alias("raw"), F.lit(None).cast("int").alias("t"))
    last = F.aggregate("_y", start, fold, lambda a: F.when(a["raw"] < 0, base_year + a["t"]).otherwise(0))
    return unfolded.select(schema.split(" ")[0], "run", last.alias("depletion_year"))


def outcome_series(flows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Wage bill, pensions, government cost and balance as shares of GDP or revenue."""
    gdp = F.col("gdp")
    gov = F.col("contrib_employer") + F.col("gov_topup")
    return flows.join(ledger, ["scenario", "run", "t"]).select(
        "scenario", "run", "t", (F.col("wage_bill") / gdp * 100).alias("wage_bill_gdp"),
        (F.col("wage_bill") / (gdp * F.col("revenue_share")) * 100).alias("wage_bill_revenue"),
        (F.col("pension_spending") / gdp * 100).alias("pension_spending_gdp"), (gov / gdp * 100).alias("gov_pension_cost_gdp"),
        ((F.col("wage_bill") + gov) / gdp * 100).alias("total_cost_gdp"), (F.col("fund_balance") / gdp * 100).alias("fund_balance_gdp"))


METRICS = ("wage_bill_gdp", "wage_bill_revenue", "pension_spending_gdp", "gov_pension_cost_gdp", "total_cost_gdp",
           "fund_balance_gdp")


def median_by_group(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return exact_quantiles(df, by, value, {"median": 0.5})

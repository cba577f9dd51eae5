"""Queries: pay, benefits and the fund, over staff cohorts and all runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.keys import bounded, ensure_checkpoint_dir, exact_sum, with_parameters
from ..operators import pay as E
from ..operators.panel import life_table
from . import settings as S
from . import views as V
from .registry import query
from .sqlviews import ALLOW, SALARY, sql

SECTORS = tuple(S.ALLOWANCE)
MIN_SERVICE = 3   # the panel spans seven years, so few staff reach the default of twenty
CUM = "(SELECT h.age, SUM(-ln(1 - LEAST(l.qx, 0.999999))) AS cumhaz FROM range(112) AS h(age) LEFT JOIN life l ON l.age < h.age GROUP BY 1)"
CUMHAZ = f"cum AS (SELECT age, COALESCE(cumhaz, 0) AS cumhaz FROM {CUM})"


def index(spark, d, rows=None, years=None):
    """The pay index; ``years`` is a table of the year indexes ``t`` to keep, which are picked before runs are unfolded."""
    paths = V.level_paths(spark, d)
    if years is not None:
        paths = paths.join(years, "t", "left_semi")
    return E.salary_index(with_parameters(paths, rows or S.SCENARIOS, S.SCENARIO_SCHEMA), SECTORS, S.PRIORITY)


def units(spark, d):
    return E.wage_units(V.stocks(spark, d), S.BASE_SALARY, S.STEP, S.ALLOWANCE)


def start_units(spark, d):
    """Base-year units, one row per sector, as shares of total basic pay."""
    w = Window.partitionBy()  # one row per sector
    u = units(spark, d).where("t = 0").withColumn("_all", F.sum("basic_units").over(w))
    return bounded(u.select("sector", (F.col("basic_units") / F.col("_all")).alias("basic_units"),
                            (F.col("total_units") / F.col("_all")).alias("total_units")))


def pension_spending():
    return 0.16 * F.pow(F.lit(1.05), F.col("t")) * (2 - F.col("mortality_mult"))


def flows(spark, d, rows=None):
    """Pay, contributions and pension spending per scenario, run and year, relative to base-year basic pay."""
    idx = index(spark, d, rows)
    # run-level columns ride through the aggregation instead of being joined back
    keep = ["inflation", "real_return", "revenue_share", "gdp", "mortality_mult", "employee_rate", "employer_rate",
            "contribution_step", "contribution_every", "contribution_cap"]
    bill = (idx.join(start_units(spark, d), "sector").groupBy("scenario", "run", "t").agg(
        F.sum(F.col("total_units") * F.col("idx")).alias("wage_bill"), F.sum(F.col("basic_units") * F.col("idx")).alias("basic_payroll"),
        *[F.first(c).alias(c) for c in keep]))
    return E.contributions(E.contribution_rates(bill)).withColumns({
        "pension_spending": pension_spending(), "gdp": 20 * F.col("gdp")})


def flow_table(spark, d, rows=None):
    """The flows, written out because ledger and outcome tables both read them."""
    ensure_checkpoint_dir(spark)
    return flows(spark, d, rows).checkpoint()


def ledger(spark, d, rows=None):
    f = flow_table(spark, d, rows)
    return f, E.fund_ledger(f, 1.0)


PAY_FIELDS = ("salary_rule", "recent_raise", "raise_priority", "raise_other")        # what pay depends on in a setting
RATE_FIELDS = ("employee_rate", "employer_rate", "contribution_step", "contribution_every", "contribution_cap")


def run_out_years(spark, d, rows):
    """First year with a top-up per setting and run, the same as from the ledger.

    Pay is worked out once for settings that agree in its rule, and a fund once for those that agree in pay and rates. Each part
    gets only the parameters it is keyed by, so that no other can enter it.
    """
    names, kinds = S.column_names(S.SCENARIO_SCHEMA), S.SCENARIO_SCHEMA.split(", ")
    kind = dict(zip(names, kinds))
    pays, funds = {}, {}
    for row in rows:
        at = dict(zip(names, row))
        pay = pays.setdefault(tuple(at[c] for c in PAY_FIELDS), len(pays))
        funds.setdefault((pay, *[at[c] for c in RATE_FIELDS]), []).append(at["scenario"])
    idx = E.salary_index(with_parameters(V.level_paths(spark, d), [(i, *p) for p, i in pays.items()],
                                         ", ".join(["pay int", *[kind[c] for c in PAY_FIELDS]])), SECTORS, S.PRIORITY)
    payroll = (idx.join(start_units(spark, d), "sector").groupBy("pay", "run", "t").agg(
        F.sum(F.col("basic_units") * F.col("idx")).alias("basic_payroll"),
        *[F.first(c).alias(c) for c in ("inflation", "real_return", "mortality_mult")])
        .withColumn("pension_spending", pension_spending()))
    rates = {i: [] for i in pays.values()}
    for number, key in enumerate(funds):
        rates[key[0]].append((number, *key[1:]))
    out = E.run_out_years(payroll, "pay", rates, ", ".join(["fund int", *[kind[c] for c in RATE_FIELDS]]), 1.0, S.BASE_YEAR)
    shared = F.array(*[F.array(*[F.lit(s) for s in some]) for some in funds.values()])
    return out.select(F.explode(shared[F.col("fund")]).alias("scenario"), "run", "depletion_year")


def outcomes(spark, d):
    f, led = ledger(spark, d)
    return E.outcome_series(f, led), E.depletion_year(led, S.BASE_YEAR)


@query("e01_wage_units", sql("units", """
SELECT t, sector, ROUND(basic_units / 1e9, 6) AS basic_units, ROUND(total_units / 1e9, 6) AS total_units FROM units"""))
def wage_units(spark, d):
    return units(spark, d).select("t", "sector", *[F.round(F.col(c) / 1e9, 6).alias(c) for c in ("basic_units", "total_units")])


@query("e02_salary_index", sql("index", """
SELECT scenario, t, sector, ROUND(AVG(idx), 8) AS idx, COUNT(*) AS runs FROM index GROUP BY 1, 2, 3"""))
def salary_index(spark, d):
    return index(spark, d).groupBy("scenario", "t", "sector").agg(F.round(F.avg("idx"), 8).alias("idx"), F.count("*").alias("runs"))


@query("e03_wage_bill", sql("index units", """
SELECT scenario, run, t, ROUND(SUM(total_units * idx) / 1e9, 6) AS wage_bill, ROUND(SUM(basic_units * idx) / 1e9, 6) AS basic_payroll
FROM index JOIN units USING (t, sector) GROUP BY 1, 2, 3"""))
def wage_bill(spark, d):
    b = E.wage_bill(bounded(units(spark, d)), index(spark, d), ["t", "sector"])
    return b.select("scenario", "run", "t", *[F.round(F.col(c) / 1e9, 6).alias(c) for c in ("wage_bill", "basic_payroll")])


@query("e04_survival", sql("register life", f"""
WITH {CUMHAZ},
g AS (SELECT age, 0.9 + 0.02 * (pensioner_id % 11) AS level, COUNT(*) AS n FROM register GROUP BY 1, 2)
SELECT CAST(k AS INT) AS years, ROUND(SUM(n * exp(-level * (b.cumhaz - a.cumhaz))), 6) AS alive
FROM g CROSS JOIN range(0, 41) AS r(k) JOIN cum a ON a.age = LEAST(g.age, 111) JOIN cum b ON b.age = LEAST(g.age + k, 111) GROUP BY 1"""))
def survival(spark, d):
    g = (V.register(spark, d).groupBy("age", (0.9 + 0.02 * (F.col("pensioner_id") % 11)).alias("level")).agg(F.count("*").alias("n"))
         .withColumn("years", F.explode(F.sequence(F.lit(0), F.lit(40)))))
    return (E.survival(g, life(spark), "age", "years", F.col("level")).groupBy("years")
            .agg(F.round(F.sum(F.col("n") * F.col("alive")), 6).alias("alive")))


def life(spark):
    return life_table(spark, S.LIFE["makeham"], S.LIFE["gompertz"], S.LIFE["slope"], S.LIFE["last_age"])


@query("e05_contribution_schedule", sql("flows", """
SELECT scenario, t, ROUND(MAX(employee), 8) AS employee, ROUND(MAX(employer), 8) AS employer, COUNT(*) AS runs FROM flows GROUP BY 1, 2"""))
def schedule(spark, d):
    rates = E.contribution_rates(with_parameters(V.paths(spark, d), S.SCENARIOS, S.SCENARIO_SCHEMA))
    return rates.groupBy("scenario", "t").agg(F.round(F.max("employee"), 8).alias("employee"),
                                              F.round(F.max("employer"), 8).alias("employer"), F.count("*").alias("runs"))


FACTOR = f"""fac AS (
  SELECT i.scenario, i.run, i.t, i.sector, AVG(CASE WHEN i.t - j >= 0 THEN b.idx / i.idx
      ELSE z.idx / i.idx / pow(1 + i.recent_raise, j - i.t) END / pow({1 + S.STEP}, j)) AS factor
  FROM index i CROSS JOIN range(10) AS r(j)
  LEFT JOIN index b ON b.scenario = i.scenario AND b.run = i.run AND b.sector = i.sector AND b.t = i.t - j
  JOIN index z ON z.scenario = i.scenario AND z.run = i.run AND z.sector = i.sector AND z.t = 0
  GROUP BY 1, 2, 3, 4)"""


@query("e06_average_salary_factor", sql("index", f"""
WITH {FACTOR} SELECT scenario, t, sector, ROUND(AVG(factor), 8) AS factor FROM fac GROUP BY 1, 2, 3"""))
def factor(spark, d):
    return (E.average_salary_factor(index(spark, d), S.STEP, revalue=False).groupBy("scenario", "t", "sector")
            .agg(F.round(F.avg("factor"), 8).alias("factor")))


@query("e06_revalued_factor", sql("index", f"""
SELECT scenario, ROUND(AVG(f), 8) AS factor FROM (SELECT scenario, (SELECT SUM(pow({1 + S.STEP}, -j)) FROM range(10) AS r(j)) / accrual_years AS f FROM index)
GROUP BY 1"""))
def revalued(spark, d):
    return (E.average_salary_factor(index(spark, d), S.STEP, revalue=True).groupBy("scenario")
            .agg(F.round(F.avg("factor"), 8).alias("factor")))


BENEFIT = f"""ben AS (
  SELECT i.scenario, i.run, i.t, i.sector, i.mortality_mult, i.idx AS pidx, r.age, r.service, r.framework, r.n,
    {SALARY.replace('framework', 'r.framework')} * pow({1 + S.STEP}, r.service) * 12 * i.idx AS final,
    CASE WHEN pension_formula = 'accrual' THEN LEAST(accrual_rate * r.service, {S.RULES['cap']}) * final *
      {sum((1 + S.STEP) ** -j for j in range(10)) / 10!r} ELSE {S.RULES['replacement']} * final END AS formula,
    {S.RULES['min_pension']} * 12 * i.idx AS floor, r.service >= {MIN_SERVICE} AS eligible,
    CASE WHEN eligible THEN GREATEST(formula, floor) ELSE 0 END AS benefit
  FROM index i JOIN retirees r ON r.t = i.t AND r.sector = i.sector)"""


def benefits(spark, d):
    return first_benefit(bounded(V.retirees(spark, d)), pension_index(spark, d))


def pension_index(spark, d, years=None):
    return E.average_salary_factor(index(spark, d, years=years), S.STEP, revalue=True).withColumn("pidx", F.col("idx"))


def first_benefit(retirees, idx):
    return E.initial_benefit(retirees, idx, S.BASE_SALARY, S.STEP, MIN_SERVICE, S.RULES["replacement"], S.RULES["min_pension"], S.RULES["cap"])


def counted_benefits(spark, d):
    """The benefits of all runs and retirees, worked out once for those that agree in all that a benefit depends on.

    Ages are added up first; a row stands for ``n`` retirees in each of ``runs`` runs.
    """
    people = bounded(V.retirees(spark, d).groupBy("t", "sector", "framework", "service").agg(F.sum("n").alias("n")))
    years = F.broadcast(people.select("t").distinct())      # at most one row per calendar year
    idx = pension_index(spark, d, years)
    return first_benefit(people, E.counted_index(idx, ["scenario", "t", "sector", "pension_formula", "accrual_rate", "idx", "pidx", "factor"]))


@query("e07_initial_benefit", sql("index retirees", f"""
WITH {BENEFIT} SELECT scenario, t, sector, ROUND(SUM(n * benefit) / 1e9, 6) AS benefit, ROUND(SUM(n * final) / 1e9, 6) AS final,
  CAST(SUM(CASE WHEN formula <= floor THEN n ELSE 0 END) AS BIGINT) AS on_floor FROM ben GROUP BY 1, 2, 3"""))
def initial(spark, d):
    n, runs = F.col("n"), F.col("runs")
    return counted_benefits(spark, d).groupBy("scenario", "t", "sector").agg(
        F.round(exact_sum(n * F.col("benefit"), runs) / 1e9, 6).alias("benefit"), F.round(exact_sum(n * F.col("final"), runs) / 1e9, 6).alias("final"),
        F.sum(F.when(F.col("formula") <= F.col("floor"), n * runs).otherwise(0)).alias("on_floor"))


@query("e08_lump_sums", sql("index retirees", f"""
WITH {BENEFIT} SELECT scenario, run, t, ROUND(SUM(CASE WHEN eligible THEN 0 ELSE n * final / 12 * service END) / 1e9, 8) AS lump_sum,
  CAST(SUM(CASE WHEN eligible THEN n ELSE 0 END) AS BIGINT) AS new_pensioners FROM ben GROUP BY 1, 2, 3"""))
def lumps(spark, d):
    return E.lump_sums(benefits(spark, d), S.RULES["lump_months"]).withColumn("lump_sum", F.round(F.col("lump_sum") / 1e9, 8))


ADEQUACY = f"""ad AS (SELECT *, benefit / final / (1 + {ALLOW}) AS rr FROM ben WHERE run = 0 AND eligible),
adeq AS (SELECT scenario, t, CAST(SUM(n) AS BIGINT) AS retirees, SUM(rr * n) / SUM(n) AS avg_replacement,
  SUM(benefit / final * n) / SUM(n) AS avg_replacement_basic, MIN(rr) AS min_replacement,
  SUM(CASE WHEN formula <= floor THEN n ELSE 0 END) / SUM(n) AS share_on_minimum, SUM(service * n) / SUM(n) AS avg_service
  FROM ad GROUP BY 1, 2)"""
RATES = ("avg_replacement", "avg_replacement_basic", "min_replacement", "share_on_minimum", "avg_service")


@query("e09_adequacy", sql("index retirees", f"""
WITH {BENEFIT}, {ADEQUACY} SELECT scenario, t, retirees, """ + ", ".join(f"ROUND({c}, 8) AS {c}" for c in RATES) + " FROM adeq"))
def adequacy(spark, d):
    return E.adequacy(benefits(spark, d), S.ALLOWANCE).withColumns({c: F.round(c, 8) for c in RATES})


@query("e10_benefit_run_off", sql("index retirees life", f"""
WITH {CUMHAZ}, {BENEFIT},
st AS (SELECT scenario, run, sector, age, t AS t0, mortality_mult, SUM(benefit * n) / MAX(pidx) AS amount FROM ben GROUP BY 1, 2, 3, 4, 5, 6 HAVING SUM(benefit * n) > 0),
ys AS (SELECT st.*, CAST(t AS INT) AS t FROM st CROSS JOIN range({S.PATH_YEARS}) AS r(t) WHERE t > t0),
due AS (SELECT scenario, run, t, sector, SUM(amount * exp(-mortality_mult * (b.cumhaz - a.cumhaz))) AS due
  FROM ys JOIN cum a ON a.age = LEAST(ys.age + 1, 111) JOIN cum b ON b.age = LEAST(ys.age + 1 + t - t0 - 1, 111) GROUP BY 1, 2, 3, 4)
SELECT scenario, run, t, ROUND(SUM(due * idx) / 1e9, 6) AS payments FROM due JOIN index USING (scenario, run, t, sector) GROUP BY 1, 2, 3"""))
def run_off(spark, d):
    pidx = index(spark, d).withColumn("pidx", F.col("idx"))
    out = E.benefit_run_off(benefits(spark, d), pidx, life(spark), S.PATH_YEARS - 1)
    return out.withColumn("payments", F.round(F.col("payments") / 1e9, 6))


@query("e10_register_payments", sql("index register stocks life", f"""
WITH {CUMHAZ},
heads AS (SELECT sector, SUM(n) AS n FROM stocks WHERE t = 0 GROUP BY 1),
pa AS (SELECT scenario, run, index.t, mortality_mult, SUM(idx * n) / SUM(n) AS pidx_all FROM index JOIN heads USING (sector) GROUP BY 1, 2, 3, 4),
am AS (SELECT age, SUM(monthly_pension) * 12 AS amount FROM register GROUP BY 1),
du AS (SELECT mortality_mult, t, SUM(amount * exp(-mortality_mult * (b.cumhaz - a.cumhaz))) AS due
  FROM (SELECT DISTINCT mortality_mult, t FROM pa) CROSS JOIN am JOIN cum a ON a.age = am.age JOIN cum b ON b.age = LEAST(am.age + t, 111) GROUP BY 1, 2)
SELECT scenario, run, t, ROUND(due * pidx_all / 1e6, 6) AS payments FROM pa JOIN du USING (mortality_mult, t)"""))
def register(spark, d):
    heads = bounded(V.stocks(spark, d).where("t = 0").groupBy("sector").agg(F.sum("n").alias("n")))      # one row per sector
    runs = (index(spark, d).join(heads, "sector").groupBy("scenario", "run", "t", "mortality_mult")
            .agg((F.sum(F.col("idx") * F.col("n")) / F.sum("n")).alias("pidx_all")))
    by_age = V.register(spark, d).groupBy("age").agg((F.sum("monthly_pension") * 12).alias("amount"))
    return E.register_payments(by_age, runs, life(spark)).withColumn("payments", F.round(F.col("payments") / 1e6, 6))


@query("e11_contributions", sql("flows", """
SELECT scenario, run, t, ROUND(contrib_employee, 10) AS contrib_employee, ROUND(contrib_employer, 10) AS contrib_employer FROM flows"""))
def contributions(spark, d):
    return flows(spark, d).select("scenario", "run", "t", *[F.round(c, 10).alias(c) for c in ("contrib_employee", "contrib_employer")])


@query("e12_fund_ledger", sql("ledger", """
SELECT scenario, run, t, ROUND(fund_balance, 8) AS fund_balance, ROUND(gov_topup, 8) AS gov_topup FROM ledger"""))
def fund(spark, d):
    return ledger(spark, d)[1].withColumns({c: F.round(c, 8) for c in ("fund_balance", "gov_topup")})


@query("e13_depletion_year", sql("ledger", "SELECT * FROM depletion"))
def depletion(spark, d):
    return E.depletion_year(ledger(spark, d)[1], S.BASE_YEAR)


@query("e14_outcome_series", sql("outcomes", "SELECT scenario, run, t, " + ", ".join(
    f"ROUND({m}, 6) AS {m}" for m in E.METRICS) + " FROM outcomes"))
def outcome(spark, d):
    return outcomes(spark, d)[0].withColumns({m: F.round(m, 6) for m in E.METRICS})


@query("e15_median_by_group", sql("index units", """
SELECT scenario, t, sector, ROUND(median(total_units * idx) / 1e9, 6) AS median FROM index JOIN units USING (t, sector) GROUP BY 1, 2, 3"""))
def medians(spark, d):
    bill = index(spark, d).join(bounded(units(spark, d)), ["t", "sector"]).withColumn("bill", F.col("total_units") * F.col("idx"))
    return E.median_by_group(bill, ["scenario", "t", "sector"], "bill").withColumn("median", F.round(F.col("median") / 1e9, 6))

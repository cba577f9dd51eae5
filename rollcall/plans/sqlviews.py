"""The same logical tables as DuckDB common table expressions, for the SQL counterparts."""

from __future__ import annotations

from . import settings as S


def _case(mapping: dict, col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"(CASE {col} {whens} END)"


SALARY = f"CAST({_case(S.BASE_SALARY, 'framework')} AS DOUBLE)"
ALLOW = f"CAST({_case(S.ALLOWANCE, 'sector')} AS DOUBLE)"
RANK = "(CASE framework WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END)"
Q_AGE = (f"(CASE WHEN a >= {S.LIFE['last_age']} THEN 1.0 ELSE 1 - exp(-({S.LIFE['makeham']} + "
         f"{S.LIFE['gompertz']} * exp({S.LIFE['slope']} * a))) END)")

# name -> (names it needs, list of "cte AS (...)")
VIEWS: dict[str, tuple[list[str], str]] = {
    "panel_base": ([], f"""
panel_years AS (
  SELECT o_custkey AS person_id, CAST(year(o_orderdate) AS INT) AS year, SUM(o_totalprice) AS spend
  FROM orders GROUP BY 1, 2),
panel_seq AS (SELECT *, MIN(year) OVER (PARTITION BY person_id) AS first_year FROM panel_years),
panel_base AS (
  SELECT person_id, year, CAST(20 + person_id % 40 + year - {S.PANEL_START} AS INT) AS age,
    CAST(year - first_year + CASE WHEN person_id % 4 = 0 THEN 3 ELSE 0 END AS INT) AS service,
    r_name AS sector, CASE WHEN spend >= 900000 THEN 'A' WHEN spend >= 500000 THEN 'B'
      WHEN spend >= 200000 THEN 'C' ELSE 'D' END AS framework,
    person_id % 8 = 0 AS eligible60, n_name AS ministry, c_mktsegment AS province
  FROM panel_seq JOIN customer ON person_id = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""),
    "panel": (["panel_base"], f"""
panel_next AS (
  SELECT *, LEAD(year) OVER w AS next_year, {RANK} AS fw_rank, LEAD({RANK}) OVER w AS next_rank,
    MAX(year) OVER () AS last_year
  FROM panel_base WINDOW w AS (PARTITION BY person_id ORDER BY year)),
panel_typed AS (
  SELECT *, CASE WHEN next_year IS NULL AND year < last_year THEN
      CASE WHEN person_id % 29 = 0 THEN 'death'
           WHEN age >= CASE WHEN eligible60 THEN 60 ELSE 55 END THEN 'retirement' ELSE 'separation' END
    ELSE '' END AS exit_type,
    COALESCE(next_year = year + 1 AND next_rank < fw_rank, FALSE) AS promoted
  FROM panel_next),
panel AS (
  SELECT person_id, year, age, service, sector, framework, eligible60, ministry, province, exit_type,
    exit_type <> '' AS "exit", promoted FROM panel_typed)"""),
    "records": ([], """
records AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(l_shipdate AS DATE)) AS record_id,
    l_orderkey * 10000 + l_partkey % 50 AS national_id, l_suppkey * 100000 + l_orderkey AS bank_account,
    concat_ws('/', p_name, l_suppkey) AS full_name, CAST(l_shipdate AS DATE) AS birth_date,
    l_linestatus AS sex, l_linestatus AS sector, l_returnflag AS framework, n_name AS ministry, r_name AS province,
    l_linenumber AS service, 20 + p_size AS age, l_suppkey % 8 = 0 AS eligible60,
    l_extendedprice AS basic_salary, l_extendedprice * l_tax AS allowance,
    CAST(l_quantity AS INT) % 10 AS attendance_days_q, p_retailprice * l_quantity AS expected
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""),
    "paths": ([], f"""
path_days AS (
  SELECT user_id AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS t, AVG(value) AS x
  FROM events GROUP BY 1, 2),
path_x AS (
  SELECT r.run, CAST(s.t AS INT) AS t, COALESCE(d.x, 0) AS x
  FROM (SELECT DISTINCT run FROM path_days) r CROSS JOIN range({S.PATH_YEARS}) AS s(t)
  LEFT JOIN path_days d ON d.run = r.run AND d.t = s.t),
paths AS (
  SELECT run, t, CAST({S.BASE_YEAR} + t AS INT) AS year, x * 0.0001 AS real_growth, x * 0.00005 AS inflation,
    x * 0.00002 AS real_return, 0.2 + x * 0.00001 AS revenue_share, 0.9 + 0.02 * (run % 11) AS mortality_mult
  FROM path_x)"""),
    "level_paths": (["paths"], """
level_raw AS (
  SELECT *, product(1 + inflation) OVER w AS c, product((1 + real_growth) * (1 + inflation)) OVER w AS g
  FROM paths WINDOW w AS (PARTITION BY run ORDER BY t)),
level_paths AS (
  SELECT run, t, year, real_growth, inflation, real_return, revenue_share, mortality_mult,
    c / FIRST_VALUE(c) OVER w AS cpi, g / FIRST_VALUE(g) OVER w AS gdp
  FROM level_raw WINDOW w AS (PARTITION BY run ORDER BY t))"""),
    "scenarios": ([], f"""
scenarios AS (SELECT * FROM {S.values_sql(S.SCENARIOS, ', '.join(S.column_names(S.SCENARIO_SCHEMA)))})"""),
    "cells": ([], """
cells AS (
  SELECT r_name AS sector, n_name AS ministry, c_mktsegment AS province, CAST(year(o_orderdate) AS INT) AS year,
    SUM(o_totalprice) / 1e6 AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4)"""),
    "macro": ([], f"""
macro_months AS (
  SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - {S.PANEL_START * 12 + 1} AS INT) AS t,
    SUM(l_quantity) AS q, SUM(l_extendedprice) AS v,
    COUNT(*) FILTER (WHERE l_returnflag = 'R') / COUNT(*) AS share
  FROM lineitem GROUP BY 1),
macro_wide AS (
  SELECT t, q / LAG(q) OVER w - 1 AS real_growth, (v / q) / LAG(v / q) OVER w - 1 AS inflation, share
  FROM macro_months WINDOW w AS (ORDER BY t)),
macro AS (
  SELECT 'real_growth' AS series, t, real_growth AS value FROM macro_wide WHERE real_growth IS NOT NULL
  UNION ALL SELECT 'inflation', t, inflation FROM macro_wide WHERE real_growth IS NOT NULL
  UNION ALL SELECT 'revenue_share', t, share FROM macro_wide WHERE real_growth IS NOT NULL)"""),
    "retirees": (["panel"], f"""
retirees AS (
  SELECT CAST(year - {S.PANEL_START} AS INT) AS t, sector, framework, age, service, COUNT(*) AS n
  FROM panel WHERE exit_type = 'retirement' GROUP BY 1, 2, 3, 4, 5)"""),
    "stocks": (["panel_base"], f"""
stocks AS (
  SELECT CAST(year - {S.PANEL_START} AS INT) AS t, sector, framework, eligible60, age, service, COUNT(*) AS n
  FROM panel_base WHERE age BETWEEN {S.AGE_MIN} AND {S.AGE_MAX} AND service BETWEEN 0 AND {S.SERVICE_MAX}
  GROUP BY 1, 2, 3, 4, 5, 6)"""),
    "flagged_docs": ([], """
docs_flagged AS (
  SELECT doc_id AS record_id, lang, source, CAST(n_chars AS DOUBLE) AS pay,
    length(text) < 60 OR length(text) > 20000 AS length_rule, regexp_matches(text, '[0-9]') AS digit_rule,
    ROW_NUMBER() OVER (PARTITION BY text, lang ORDER BY doc_id) > 1 AS copy_flag
  FROM documents),
flagged_docs AS (
  SELECT f.*, CASE WHEN labels.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' ELSE 'none' END AS anomaly,
    length_rule OR digit_rule AS rule_flag, length_rule OR digit_rule OR copy_flag AS flag
  FROM docs_flagged f LEFT JOIN labels ON record_id = labels.doc_id)"""),
    "register": ([], """
register AS (
  SELECT c_custkey AS pensioner_id, CAST(40 + c_custkey % 60 AS INT) AS age, c_acctbal AS monthly_pension
  FROM customer)"""),
    "index": (["level_paths", "scenarios"], f"""
sectors AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in S.ALLOWANCE)}) AS v(sector)),
index AS (
  SELECT s.*, run, t, year, inflation, real_return, revenue_share, mortality_mult, cpi, gdp, sector,
    CASE salary_rule WHEN 'inflation' THEN cpi
      WHEN 'targeted' THEN pow(1 + CASE WHEN sector IN {S.PRIORITY} THEN raise_priority ELSE raise_other END, t)
      ELSE pow(1 + recent_raise, t) END AS idx
  FROM level_paths CROSS JOIN scenarios s CROSS JOIN sectors)"""),
    "units": (["stocks"], f"""
units AS (
  SELECT t, sector, SUM(n * {SALARY} * pow({1 + S.STEP}, service) * 12) AS basic_units,
    SUM(n * {SALARY} * pow({1 + S.STEP}, service) * 12) * (1 + {ALLOW}) AS total_units FROM stocks GROUP BY t, sector),
units0 AS (SELECT * FROM units WHERE t = 0),
unit_scale AS (SELECT SUM(basic_units) AS u FROM units0)"""),
    "flows": (["index", "units"], """
bill AS (
  SELECT scenario, run, index.t, SUM(total_units * idx) / MAX(u) AS wage_bill, SUM(basic_units * idx) / MAX(u) AS basic_payroll
  FROM index JOIN units0 USING (sector) CROSS JOIN unit_scale GROUP BY 1, 2, 3),
rate_table AS (
  SELECT scenario, CAST(t AS INT) AS t, CASE WHEN contribution_step > 0 THEN
    LEAST(floor(t / contribution_every) * contribution_step, contribution_cap) ELSE 0 END AS extra,
    employee_rate + extra AS employee, employer_rate + extra AS employer
  FROM scenarios CROSS JOIN range(30) AS r(t)),
flows AS (
  SELECT b.*, employee, employer, basic_payroll * employee AS contrib_employee, basic_payroll * employer AS contrib_employer,
    0.16 * pow(1.05, b.t) * (2 - mortality_mult) AS pension_spending, inflation, real_return, revenue_share,
    20 * gdp AS gdp, mortality_mult
  FROM bill b JOIN level_paths p ON b.run = p.run AND b.t = p.t JOIN rate_table r ON r.scenario = b.scenario AND r.t = b.t)"""),
    "ledger": (["flows"], """
ledger AS (
  SELECT scenario, run, t, GREATEST(1.0 * ((1 + real_return) * (1 + inflation)) + contrib_employee + contrib_employer - pension_spending, 0) AS fund_balance,
    GREATEST(-(1.0 * ((1 + real_return) * (1 + inflation)) + contrib_employee + contrib_employer - pension_spending), 0) AS gov_topup
  FROM flows WHERE t = 0
  UNION ALL
  SELECT f.scenario, f.run, f.t, GREATEST(l.fund_balance * ((1 + real_return) * (1 + inflation)) + contrib_employee + contrib_employer - pension_spending, 0),
    GREATEST(-(l.fund_balance * ((1 + real_return) * (1 + inflation)) + contrib_employee + contrib_employer - pension_spending), 0)
  FROM ledger l JOIN flows f ON f.scenario = l.scenario AND f.run = l.run AND f.t = l.t + 1),
depletion AS (
  SELECT scenario, run, COALESCE(MIN(CASE WHEN gov_topup > 0 THEN 2026 + t END), 0) AS depletion_year FROM ledger GROUP BY 1, 2)"""),
    "outcomes": (["ledger"], """
outcomes AS (
  SELECT scenario, run, t, wage_bill / gdp * 100 AS wage_bill_gdp, wage_bill / (gdp * revenue_share) * 100 AS wage_bill_revenue,
    pension_spending / gdp * 100 AS pension_spending_gdp, (contrib_employer + gov_topup) / gdp * 100 AS gov_pension_cost_gdp,
    (wage_bill + contrib_employer + gov_topup) / gdp * 100 AS total_cost_gdp, fund_balance / gdp * 100 AS fund_balance_gdp
  FROM flows JOIN ledger USING (scenario, run, t))"""),
    "life": ([], f"""
life AS (SELECT CAST(a AS INT) AS age, {Q_AGE} AS qx FROM range({S.LIFE['last_age'] + 1}) AS s(a))"""),
}


def t_p_sql(stat: str, df: str) -> str:
    """Two-sided Student-t p-value in DuckDB, by Simpson's rule over the angle of the statistic."""
    angle = f"atan(abs({stat}) / sqrt({df}))"
    weights = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, 2001), lambda i: {weights} * pow(cos({angle} * i / 2000), {df} - 1)))"
    return f"GREATEST(0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {angle} / 6000 * {area})"


def sql(views: str | list[str], body: str) -> str:
    """A full statement: the named views, then ``body`` (a SELECT, or WITH ctes SELECT)."""
    names = views.split() if isinstance(views, str) else views
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for need in VIEWS[name][0]:
            add(need)
        done.append(name)

    for n in names:
        add(n)
    parts = [VIEWS[n][1].strip() for n in done]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:].lstrip()
        if rest[:10].upper() == "RECURSIVE ":
            rest = rest[10:]
        head = ",\n".join([*parts, rest])
        return f"WITH RECURSIVE {head}"
    if not parts:
        return body
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body

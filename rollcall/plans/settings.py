"""Parameters used by the registered queries. Operators take them as arguments."""

# ---- fixed values: policy presets, pay scale, benefit rules, thresholds ----
BASE_YEAR = 2026
FRAMEWORKS = ("A", "B", "C", "D")
BASE_SALARY = {"A": 2300000.0, "B": 1750000.0, "C": 1500000.0, "D": 1430000.0}
STEP = 0.012
AGE_MIN, AGE_MAX, SERVICE_MAX = 18, 65, 47
TRUTHY = ("true", "1", "yes", "y")
SCENARIO_SCHEMA = (
    "scenario string, salary_rule string, recent_raise double, raise_priority double, raise_other double, "
    "retirement_age double, retirement_age_target double, phase_years int, pension_formula string, "
    "accrual_rate double, accrual_years int, employee_rate double, employer_rate double, "
    "contribution_step double, contribution_every int, contribution_cap double, hiring_growth double, "
    "restrain boolean")
SCENARIOS = [
    ("S0", "recent_average", 0.06, 0.08, 0.03, 55.0, 55.0, 0, "current", 0.02, 10, 0.06, 0.12, 0.0, 5, 0.0, 0.01, False),
    ("S1", "inflation", 0.06, 0.08, 0.03, 55.0, 55.0, 0, "current", 0.02, 10, 0.06, 0.12, 0.0, 5, 0.0, 0.01, False),
    ("S2", "targeted", 0.06, 0.08, 0.03, 55.0, 55.0, 0, "current", 0.02, 10, 0.06, 0.12, 0.0, 5, 0.0, 0.01, False),
    ("S3", "recent_average", 0.06, 0.08, 0.03, 55.0, 60.0, 10, "current", 0.02, 10, 0.06, 0.12, 0.0, 5, 0.0, 0.01, False),
    ("S4", "recent_average", 0.06, 0.08, 0.03, 55.0, 55.0, 0, "accrual", 0.02, 10, 0.06, 0.12, 0.0, 5, 0.0, 0.01, False),
    ("S5", "inflation", 0.06, 0.08, 0.03, 55.0, 60.0, 10, "accrual", 0.02, 10, 0.06, 0.12, 0.01, 5, 0.03, 0.01, False),
    ("S6", "recent_average", 0.06, 0.08, 0.03, 55.0, 55.0, 0, "current", 0.02, 10, 0.06, 0.12, 0.0, 5, 0.0, 0.01, True),
]
RULES = {"min_service": 20, "replacement": 0.80, "min_pension": 1400000.0, "lump_months": 1.0, "cap": 0.80}
LIFE = {"makeham": 0.0006, "gompertz": 0.00004, "slope": 0.092, "last_age": 110}
HIGH, WATCH, WAVE_FACTOR, MIN_STAFF = 1.25, 1.1, 1.5, 30
GREEN, RED = 0.10, 0.50
ANCHORS = {"real_growth": 0.045, "inflation": 0.03, "revenue_share": 0.24}
CONVERGENCE = 15
SMOOTHING_ALPHA = [round(0.05 * i, 2) for i in range(1, 21)]
SMOOTHING_BETA = [round(0.1 * i, 1) for i in range(11)]
SMOOTHING_PHI = [0.8, 0.85, 0.9, 0.95, 0.98]
# ---- end of fixed values ----

# Choices for the driver tables.
PRIORITY = ("ASIA", "EUROPE")
ALLOWANCE = {"AFRICA": 0.35, "AMERICA": 0.40, "ASIA": 0.30, "EUROPE": 0.25, "MIDDLE EAST": 0.20}
PANEL_START = 1995
PATH_YEARS = 30


def values_sql(rows: list[tuple], names: str) -> str:
    """A parameter list as a SQL VALUES relation."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


def column_names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]

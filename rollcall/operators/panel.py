"""Exits, promotions and cohorts from a person-year panel (one row per person and year)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import ensure_checkpoint_dir, hash_unit, inline_table, with_small_table
from .boosting import boost
from .metrics import auc, diebold_mariano, mape, rmse, t_p_value

RULE_EXITS = ("retirement", "death")


def hazard_features(df: DataFrame, sectors: tuple[str, ...], frameworks: tuple[str, ...]) -> DataFrame:
    """Numeric columns and 0/1 indicators; the other columns stay."""
    return df.withColumns({
        "x_age": F.col("age").cast("double"), "x_service": F.col("service").cast("double"),
        "x_year": F.col("year").cast("double"), "x_eligible60": F.col("eligible60").cast("double"),
        **{f"x_sector_{i}": (F.col("sector") == s).cast("double") for i, s in enumerate(sectors)},
        **{f"x_fw_{f}": (F.col("framework") == f).cast("double") for f in frameworks}})


def feature_names(sectors: tuple[str, ...], frameworks: tuple[str, ...]) -> list[str]:
    return ["x_age", "x_service", "x_year", "x_eligible60", *[f"x_sector_{i}" for i in range(len(sectors))],
            *[f"x_fw_{f}" for f in frameworks]]


def at_risk(panel: DataFrame) -> DataFrame:
    """Person-years at risk of separation, with label y."""
    return (panel.where(~F.col("exit_type").isin(*RULE_EXITS))
            .withColumn("y", (F.col("exit_type") == "separation").cast("int")))


def kaplan_meier(panel: DataFrame, by: str = "sector") -> DataFrame:
    """Survival of service until separation, for people seen from service 0.

    People are counted per (group, duration) before any ordered step, so the windows hold one row per
    year of service.
    """
    people = (panel.groupBy("person_id").agg(
        F.min_by(by, "year").alias(by), F.min_by("service", "year").alias("_start"),
        F.max_by("service", "year").alias("_end"), F.max_by("exit_type", "year").alias("_why"))
        .where(F.col("_start") == 0))
    counts = (people.groupBy(by, (F.col("_end") + 1).alias("service_years"))
              .agg(F.count("*").alias("_n"), F.count_if(F.col("_why") == "separation").alias("_d")))
    spine = (people.groupBy(by).agg(F.max(F.col("_end") + 1).alias("_last"))
             .select(by, F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("service_years")))
    seq = Window.partitionBy(by).orderBy("service_years")
    rest = seq.rowsBetween(0, Window.unboundedFollowing)
    full = (spine.join(counts, [by, "service_years"], "left")
            .withColumn("at_risk", F.sum(F.coalesce("_n", F.lit(0))).over(rest)))
    keep = 1 - F.coalesce("_d", F.lit(0)) / F.col("at_risk")
    return full.select(by, "service_years", "at_risk",
                       F.product(keep).over(seq.rowsBetween(Window.unboundedPreceding, 0)).alias("survival"))


def age_band() -> Column:
    return F.floor(F.col("age") / 5).cast("int") * 5


def cohort_rates(train: DataFrame, label: str = "y") -> DataFrame:
    return train.groupBy("sector", age_band().alias("band")).agg(F.avg(label).alias("rate"))


def cohort_ratio(train: DataFrame, test: DataFrame, label: str = "y", out: str = "cohort_ratio") -> DataFrame:
    """Mean rate of the row's sector and 5-year age band; the overall mean where the band is unseen."""
    overall = train.agg(F.avg(label)).scalar()
    return (test.withColumn("band", age_band()).join(cohort_rates(train, label), ["sector", "band"], "left")
            .withColumn(out, F.coalesce("rate", overall)).drop("band", "rate"))


def spline_columns(col: str, lo: float, hi: float, knots: int = 6, degree: int = 3) -> dict[str, Column]:
    """Cubic B-spline basis over uniform knots (values held at the ends), by the Cox-de Boor recursion."""
    step = (hi - lo) / (knots - 1) or 1.0
    grid = [lo + step * i for i in range(-degree, knots + degree)]
    x = F.greatest(F.least(F.col(col).cast("double"), F.lit(float(hi))), F.lit(float(lo)))
    last = knots + degree - 2  # the interval that ends at `hi` also owns it
    basis = []
    for i in range(len(grid) - 1):
        inside = F.lit(False) if i > last else x >= grid[i] if i == last else (x >= grid[i]) & (x < grid[i + 1])
        basis.append(F.when(inside, 1.0).otherwise(0.0))
    for p in range(1, degree + 1):
        basis = [(x - grid[i]) / (p * step) * basis[i] + (grid[i + p + 1] - x) / (p * step) * basis[i + 1]
                 for i in range(len(basis) - 1)]
    return {f"b_{col}_{i}": b for i, b in enumerate(basis)}


def _range(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value per column: one row, read on the driver."""
    row = df.agg(*[e for c in cols for e in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))]).first()
    return {c: (float(row[f"a_{c}"]), float(row[f"b_{c}"])) for c in cols}


def logit_hazard(train: DataFrame, sectors: tuple[str, ...], frameworks: tuple[str, ...], c: float = 10.0):
    """Discrete-time logit: splines on age and service, linear year, indicators. Returns df -> df with ``logit_hazard``."""
    bounds = _range(train, ["age", "service", "year"])
    n = train.count()

    def prepare(df: DataFrame) -> DataFrame:
        cols = {}
        for v in ("age", "service"):
            cols.update(spline_columns(v, *bounds[v]))
        cols["l_year"] = F.col("year") - bounds["year"][0]
        cols["l_eligible60"] = F.col("eligible60").cast("double")
        cols.update({f"l_sector_{i}": (F.col("sector") == s).cast("double") for i, s in enumerate(sectors[1:])})
        cols.update({f"l_fw_{f}": (F.col("framework") == f).cast("double") for f in frameworks[1:]})
        names = list(cols)
        return VectorAssembler(inputCols=names, outputCol="_features").transform(df.withColumns(cols)).drop(*names)

    model = LogisticRegression(featuresCol="_features", labelCol="y", regParam=1.0 / (c * max(n, 1)), maxIter=2000,
                               standardization=False).fit(prepare(train))
    return lambda df: _probability(model.transform(prepare(df)), "logit_hazard")


def gbt_hazard(train: DataFrame, sectors: tuple[str, ...], frameworks: tuple[str, ...], rounds: int = 300, seed: int = 7):
    """Boosted trees of depth 5, rate 0.05, subsample 0.8. Returns df -> df with ``gbt_hazard``."""
    ensure_checkpoint_dir(train.sparkSession)       # boosting cuts its lineage there every ten rounds
    names = feature_names(sectors, frameworks)
    trees = GBTClassifier(featuresCol="_features", labelCol="y", maxDepth=5, stepSize=0.05, subsamplingRate=0.8, maxIter=rounds, seed=seed)
    model = boost(trees, hazard_features(train, sectors, frameworks), names, "y")
    return lambda df: _probability(model(hazard_features(df, sectors, frameworks)).drop(*names), "gbt_hazard")


def _probability(df: DataFrame, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def transition_matrix(panel: DataFrame, frameworks: tuple[str, ...]) -> DataFrame:
    """Yearly probability of staying in or moving one framework up, for staff who stay; long form."""
    p = panel.where(~F.col("exit")).groupBy("framework").agg(F.avg(F.col("promoted").cast("double")).alias("_p"))
    order = inline_table(panel.sparkSession, [(f, frameworks[i - 1] if i else None) for i, f in enumerate(frameworks)],
                         "from_fw string, above string")
    up = F.when(F.col("above").isNull(), 0.0).otherwise(F.coalesce("_p", F.lit(0.0)))
    full = order.join(p, order.from_fw == p.framework, "left").withColumn("up", up)
    moves = F.explode(F.array(F.struct(F.col("from_fw").alias("to_fw"), (1 - F.col("up")).alias("p")),
                              F.struct(F.col("above").alias("to_fw"), F.col("up").alias("p"))))
    return full.select("from_fw", moves.alias("m")).select("from_fw", "m.to_fw", "m.p").where("to_fw is not null")


def temporal_split(panel: DataFrame, test_years: int = 4, frac: float = 1.0) -> DataFrame:
    """Add ``part``: train up to the last year minus ``test_years`` (a repeatable sample), test after it."""
    origin = panel.agg(F.max("year") - test_years).scalar()
    part = F.when(F.col("year") > origin, "test").when(hash_unit("person_id", "year") < frac, "train")
    return panel.withColumn("part", part)


def hazard_backtest(panel: DataFrame, scored: DataFrame, models: list[str]) -> DataFrame:
    """Expected and actual separations, and the rule exits shared by all models, per test year and sector.

    ``scored`` holds the at-risk test rows with one probability column per model.
    """
    cells = scored.groupBy("year", "sector").agg(F.sum("y").alias("actual"), *[F.sum(m).alias(m) for m in models])
    other = (panel.where(F.col("exit_type").isin(*RULE_EXITS)).groupBy("year", "sector").agg(F.count("*").alias("other")))
    return cells.join(other, ["year", "sector"], "left").withColumn("other", F.coalesce("other", F.lit(0)))


def backtest_scores(cells: DataFrame, models: list[str], baseline: str) -> DataFrame:
    """MAPE, RMSE and the Diebold-Mariano statistic against the baseline with its p-value, one row per model."""
    rows = [F.struct(F.lit(m).alias("model"), F.col(m).alias("pred"), F.col(baseline).alias("base")) for m in models]
    long = cells.select("actual", "other", F.explode(F.array(*rows)).alias("r")).select("actual", "other", "r.*")
    total = F.col("actual") + F.col("other")
    scores = long.groupBy("model").agg(
        mape("actual", "pred").alias("separations_mape"), rmse("actual", "pred").alias("separations_rmse"),
        mape(total, F.col("pred") + F.col("other")).alias("all_exits_mape"),
        diebold_mariano(F.col("base") - F.col("actual"), F.col("pred") - F.col("actual")).alias("dm_vs_baseline"), F.count("*").alias("_n"))
    return scores.withColumn("p_value", t_p_value("dm_vs_baseline", F.col("_n") - 1)).drop("_n")


def model_auc(scored: DataFrame, models: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("model"), F.col(m).alias("prob")) for m in models]
    long = scored.select("y", F.explode(F.array(*rows)).alias("r")).select("y", "r.*")
    return auc(long, ["model"], "y", "prob")


def hazard_grid(spark: SparkSession, sectors: tuple[str, ...], frameworks: tuple[str, ...], ages: tuple[int, int],
                service_max: int) -> DataFrame:
    """Every combination of the declared codes, ages and years of service: a table of known size."""
    return (inline_table(spark, [(s,) for s in sectors], "sector string")
            .withColumn("framework", F.explode(F.array(*[F.lit(f) for f in frameworks])))
            .withColumn("eligible60", F.explode(F.array(F.lit(False), F.lit(True))))
            .withColumn("age", F.explode(F.sequence(F.lit(ages[0]), F.lit(ages[1]))))
            .withColumn("service", F.explode(F.sequence(F.lit(0), F.lit(service_max)))))


def hazard_lookup(scored_grid: DataFrame, prob: str, min_entry_age: int = 18) -> DataFrame:
    """Scored grid as a lookup; zero where the person would have entered below the minimum age."""
    return scored_grid.select("sector", "framework", "eligible60", "age", "service",
                              F.when(F.col("age") - F.col("service") < min_entry_age, 0.0)
                              .otherwise(F.col(prob)).alias("hazard"))


def hire_profile(panel: DataFrame, years: int = 5) -> DataFrame:
    """Recent hires: each framework's share, and the age distribution within it."""
    first = panel.agg(F.max("year") - (years - 1)).scalar()
    n = (panel.where((F.col("service") == 0) & (F.col("year") >= first)).groupBy("framework", "age")
         .agg(F.count("*").alias("_n")))
    fw = Window.partitionBy("framework")  # at most one row per age
    everything = Window.partitionBy()     # at most one row per framework and age
    return n.select("framework", "age", (F.sum("_n").over(fw) / F.sum("_n").over(everything)).alias("framework_share"),
                    (F.col("_n") / F.sum("_n").over(fw)).alias("age_share"))


COHORT = ("sector", "framework", "eligible60", "age", "service")


def cohort_stock(records: DataFrame, ages: tuple[int, int] = (18, 65), service_max: int = 47,
                 extra: list[str] = ()) -> DataFrame:
    """Headcount per cohort within the model's bounds (only cohorts that exist)."""
    inside = F.col("age").between(*ages) & F.col("service").between(0, service_max)
    return records.where(inside).groupBy(*extra, *COHORT).agg(F.count("*").alias("n"))


def retirement_age(year: Column, base_year: int) -> Column:
    """Retirement age in a year under the scenario columns: floor of a linear phase-in."""
    phased = (F.col("phase_years") > 0) & (F.col("retirement_age_target") > F.col("retirement_age"))
    done = F.least(F.greatest((year - base_year) / F.greatest(F.col("phase_years"), F.lit(1)), F.lit(0.0)), F.lit(1.0))
    target = F.col("retirement_age") + done * (F.col("retirement_age_target") - F.col("retirement_age"))
    return F.when(phased, F.floor(target)).otherwise(F.floor("retirement_age")).cast("int")


def retirement_age_schedule(scenarios: DataFrame, first: int, last: int) -> DataFrame:
    years = scenarios.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return years.select("scenario", "year", retirement_age(F.col("year"), first).alias("limit"))


def life_table(spark: SparkSession, makeham: float, gompertz: float, slope: float, last_age: int = 110,
               level: float = 1.0) -> DataFrame:
    """Yearly death probability by age, with the cumulative hazard up to the start of each age."""
    q = F.least(1 - F.exp(-(makeham + gompertz * F.exp(slope * F.col("age"))) * level), F.lit(1.0))
    base = spark.range(last_age + 2).select(F.col("id").cast("int").alias("age"))
    base = base.withColumn("qx", F.when(F.col("age") >= last_age, 1.0).otherwise(q))
    before = Window.orderBy("age").rowsBetween(Window.unboundedPreceding, -1)  # 112 rows
    return base.withColumn("cumhaz", F.coalesce(F.sum(-F.log(1 - F.least("qx", F.lit(0.999999)))).over(before), F.lit(0.0)))


def step_flows(stock: DataFrame, scenarios: DataFrame, hazard: DataFrame, hazard_keys: list[str], life: DataFrame,
               promotion: DataFrame, year: int, base_year: int) -> DataFrame:
    """Each cohort's retirements, deaths, separations, promotions and stayers in one year.

    ``stock`` has a scenario column, so all scenarios move in one job. The rate tables have one row per
    cohort key at most; adaptive execution decides how to join them.
    """
    limits = scenarios.select("scenario", retirement_age(F.lit(year), base_year).alias("_limit"))
    s = (stock.join(limits, "scenario").join(hazard, hazard_keys, "left")
         .join(life.select("age", "qx"), "age", "left")
         .join(promotion.where("from_fw <> to_fw").select(F.col("from_fw").alias("framework"), F.col("to_fw").alias("_above"),
                                                         F.col("p").alias("_up")), "framework", "left"))
    limit = F.when(F.col("eligible60"), F.greatest(F.lit(60), F.col("_limit"))).otherwise(F.col("_limit"))
    s = s.withColumn("retired", F.when(F.col("age") >= limit, F.col("n")).otherwise(F.lit(0.0)))
    s = s.withColumn("died", (F.col("n") - F.col("retired")) * F.col("qx"))
    s = s.withColumn("separated", (F.col("n") - F.col("retired") - F.col("died")) * F.coalesce("hazard", F.lit(0.0)))
    s = s.withColumn("_left", F.col("n") - F.col("retired") - F.col("died") - F.col("separated"))
    return (s.withColumn("promoted", F.col("_left") * F.coalesce("_up", F.lit(0.0)))
            .withColumn("stayed", F.col("_left") - F.col("promoted"))
            .withColumn("retirement_age", F.col("_limit")).drop("_limit", "_left", "_up", "qx"))


def stock_flow_step(flows: DataFrame, scenarios: DataFrame, hires: DataFrame, priority: tuple[str, ...],
                    eligible_share: float, age_max: int = 65, service_max: int = 47) -> DataFrame:
    """Next year's stock: stayers and promoted staff one year older, plus hires up to the target headcount.

    Hires of sector s in scenario c: the target minus the staff left, spread over the hire profile at
    service 0. Staff beyond the model's last age or year of service drop out.
    """
    kept = F.explode(F.array(F.struct(F.col("framework").alias("fw"), F.col("stayed").alias("m")),
                             F.struct(F.col("_above").alias("fw"), F.col("promoted").alias("m")))).alias("_k")
    moved = (flows.select("scenario", "sector", "eligible60", (F.col("age") + 1).alias("age"),
                          (F.col("service") + 1).alias("service"), "n", kept)
             .select("scenario", "sector", F.col("_k.fw").alias("framework"), "eligible60", "age", "service",
                     F.col("_k.m").alias("n")).where("framework is not null")
             .where((F.col("age") <= age_max) & (F.col("service") <= service_max)))
    growth = F.when(F.col("restrain") & ~F.col("sector").isin(*priority), 0.0).otherwise(F.col("hiring_growth"))
    inside = (F.col("age") < age_max) & (F.col("service") < service_max)
    gaps = (flows.groupBy("scenario", "sector").agg(
        F.sum("n").alias("_before"),
        F.sum(F.when(inside, F.col("stayed") + F.when(F.col("_above").isNotNull(), F.col("promoted")).otherwise(0.0))
              .otherwise(0.0)).alias("_after"))
        .join(scenarios.select("scenario", "hiring_growth", "restrain"), "scenario")
        .select("scenario", "sector", F.greatest(F.col("_before") * (1 + growth) - F.col("_after"), F.lit(0.0)).alias("_gap")))
    # the profile has at most one row per framework and age
    profile = hires.select("framework", "age", (F.col("framework_share") * F.col("age_share")).alias("_w"))
    new = (with_small_table(gaps, profile)
           .select("scenario", "sector", "framework", "age", F.explode(F.array(
               F.struct(F.lit(False).alias("e"), F.lit(1 - eligible_share).alias("w")),
               F.struct(F.lit(True).alias("e"), F.lit(eligible_share).alias("w")))).alias("_e"),
               (F.col("_gap") * F.col("_w")).alias("_h"))
           .select("scenario", "sector", "framework", F.col("_e.e").alias("eligible60"), "age",
                   F.lit(0).alias("service"), (F.col("_h") * F.col("_e.w")).alias("n")))
    return moved.unionByName(new).groupBy("scenario", *COHORT).agg(F.sum("n").alias("n"))


def headcount_summary(flows: DataFrame, by: list[str], sectors: tuple[str, ...]) -> DataFrame:
    """Headcount by sector and in total, exits, mean age and the retirement age in force."""
    return flows.groupBy(*by).agg(
        *[F.sum(F.when(F.col("sector") == s, F.col("n")).otherwise(0.0)).alias(f"staff_{i}") for i, s in enumerate(sectors)],
        F.sum("n").alias("total"), F.sum("retired").alias("retirements"), F.sum("separated").alias("separations"),
        (F.sum(F.col("n") * F.col("age")) / F.sum("n")).alias("mean_age"), F.max("retirement_age").alias("retirement_age"))

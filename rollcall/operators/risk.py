"""When does the fund run out: training table, classifier, calibration, ranges and scores."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import bounded, ensure_checkpoint_dir, hash_unit
from ..functions.ordered import exact_quantiles, ordered_scan
from .boosting import boost
from .metrics import auc, brier, ece_bins, log_loss
from .scenarios import LEVERS, lever_features

DRIVERS = ("avg_inflation", "avg_return", "avg_growth", "mortality_level")
FEATURES = (*LEVERS, *DRIVERS)


def risk_training_table(settings: DataFrame, drivers: DataFrame, depletion: DataFrame, never: int) -> DataFrame:
    """One row per (setting, run): levers, drivers and the run-out year, ``never`` when it does not run out.

    Settings are a short parameter table; drivers are joined on the run.
    """
    year = F.when(F.col("depletion_year") > 0, F.col("depletion_year")).otherwise(never)
    levers = lever_features(settings).select("scenario", *LEVERS)
    return (depletion.select("scenario", "run", year.alias("run_out")).join(drivers, "run").join(levers, "scenario"))


def stack_years(table: DataFrame, years: list[int]) -> DataFrame:
    """One row per check year with the label "ran out by then"."""
    rows = table.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    return rows.withColumn("label", (F.col("run_out") <= F.col("year")).cast("int"))


def stack_random_years(table: DataFrame, per_run: int, first: int, last: int, salt: str = "") -> DataFrame:
    """The same with ``per_run`` years per row drawn from the key, so that every year is seen in training."""
    rows = table.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(per_run))))
    u = hash_unit("scenario", "run", "_i", salt=salt)
    rows = rows.withColumn("year", (first + F.floor(u * (last - first + 1))).cast("int")).drop("_i")
    return rows.withColumn("label", (F.col("run_out") <= F.col("year")).cast("int"))


def risk_classifier(train: DataFrame, rounds: int = 300, seed: int = 7):
    """Boosted trees of depth 5, rate 0.05, subsample 0.8 on levers, drivers and year. Returns df -> df with ``prob``."""
    ensure_checkpoint_dir(train.sparkSession)       # boosting cuts its lineage there every ten rounds
    trees = GBTClassifier(featuresCol="_x", labelCol="label", maxDepth=5, stepSize=0.05, subsamplingRate=0.8, maxIter=rounds, seed=seed)
    model = boost(trees, train, [*FEATURES, "year"], "label")
    return lambda df: (model(df).withColumn("prob", vector_to_array("probability")[1])
                       .drop("_x", "rawPrediction", "probability", "prediction"))


def logistic_risk(train: DataFrame):
    """Scaled logistic regression, the simple alternative. The regression scales by itself, from its own pass over the rows."""
    names = [*FEATURES, "year"]
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"),
                             LogisticRegression(featuresCol="_x", labelCol="label", maxIter=2000, regParam=1e-4)]).fit(train)
    return lambda df: (model.transform(df).withColumn("prob", vector_to_array("probability")[1])
                       .drop("_x", "rawPrediction", "probability", "prediction"))


def base_rate(train: DataFrame) -> DataFrame:
    """Chance of having run out by each year, whatever the package."""
    return train.groupBy("year").agg(F.avg("label").alias("prob"))


def isotonic_calibration(cal: DataFrame):
    """Non-decreasing map from predicted to observed chance. Returns df -> df with ``calibrated``.

    Rows of one chance act as their mean, so the fit, which ends in one task, sees each distinct chance once.
    """
    label = F.when(F.count("label") == F.count("*"), F.avg(F.col("label").cast("double"))).alias("label")      # a null label stays one
    cells = cal.groupBy("prob").agg(label, F.count("*").cast("double").alias("_weight"))
    model = IsotonicRegression(featuresCol="prob", labelCol="label", predictionCol="calibrated", weightCol="_weight").fit(cells)
    return lambda df: model.transform(df)


def risk_cdf(table: DataFrame, score, first: int, last: int) -> DataFrame:
    """P(ran out by each year) per (setting, run), non-decreasing, 1 in the year after the horizon.

    A row has one entry per year of the horizon, so the running maximum is a short window.
    """
    grid = table.withColumn("grid_year", F.explode(F.sequence(F.lit(first), F.lit(last + 1)))).withColumn(
        "year", F.least("grid_year", F.lit(last)))
    p = F.when(F.col("grid_year") > last, 1.0).otherwise(F.col("prob"))
    w = Window.partitionBy("scenario", "run").orderBy("grid_year").rowsBetween(Window.unboundedPreceding, 0)
    return score(grid).select("scenario", "run", "run_out", "grid_year", p.alias("prob")).withColumn("prob", F.max("prob").over(w))


def quantile_years(cdf: DataFrame, by: list[str], alpha: float, year: str = "grid_year") -> DataFrame:
    """First year at which the chance reaches alpha/2, 1/2 and 1 - alpha/2."""
    def first(level):
        return F.min(F.when(F.col("prob") >= level, F.col(year)))
    return cdf.groupBy(*by).agg(first(alpha / 2).alias("low"), first(0.5).alias("median"), first(1 - alpha / 2).alias("high"))


def conformal_width(cal: DataFrame, lo: str, hi: str, actual: str, alpha: float) -> DataFrame:
    """How much to widen ranges so that a share 1 - alpha of outcomes falls inside (finite-sample quantile)."""
    s = cal.select(F.greatest(F.col(lo) - F.col(actual), F.col(actual) - F.col(hi)).cast("double").alias("_s"))
    n = F.col("_n")
    return exact_quantiles(s, [], "_s", {"width": F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n)})


def conformal_years(cal: DataFrame, test: DataFrame, score, alpha: float, first: int, last: int):
    """Median and range of the run-out year of each test row from a classifier's own curve, with the width added.

    Quantile years of the curve are widened by as much as the calibration rows need (less than nothing
    when they were too wide). Returns (rows with ``low``, ``median``, ``high``, width).
    """
    def years(rows):
        return quantile_years(risk_cdf(rows, score, first, last), ["scenario", "run", "run_out"], alpha)
    width = conformal_width(years(cal), "low", "high", "run_out", alpha).scalar()
    return years(test).withColumns({"low": F.col("low") - width, "high": F.col("high") + width}), width


def model_predictions(rows: DataFrame, classifier, calibrate, logistic, rates: DataFrame) -> DataFrame:
    """(model, scenario, run, year, label, prob) of four models in one pass over the stacked rows.

    ``rates`` has one row a year; a year without a rate takes the mean rate.
    """
    wide = calibrate(classifier(logistic(rows).withColumnRenamed("prob", "_logistic")))
    wide = wide.join(rates.select("year", F.col("prob").alias("_rate")), "year", "left")
    mean = rates.agg(F.avg("prob")).scalar()
    named = {"boosted": "prob", "boosted_isotonic": "calibrated", "logistic": "_logistic"}
    models = [F.struct(F.lit(m).alias("model"), F.col(c).alias("prob")) for m, c in named.items()]
    models.append(F.struct(F.lit("year_rate").alias("model"), F.coalesce("_rate", mean).alias("prob")))
    return (wide.select("scenario", "run", "year", "label", F.explode(F.array(*models)).alias("_p"))
            .select("_p.model", "scenario", "run", "year", "label", "_p.prob"))


def linear_conformal(train: DataFrame, cal: DataFrame, alpha: float):
    """Linear model of the run-out year with one width for all. Returns (df -> df with ``linear``, width table)."""
    fit = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_x"),
                           LinearRegression(featuresCol="_x", labelCol="run_out", predictionCol="linear", regParam=1e-6)]).fit(train)
    score = lambda df: fit.transform(df).drop("_x")
    return score, conformal_width(score(cal), "linear", "linear", "run_out", alpha)


def group_split(df: DataFrame, key: str, parts: dict[str, float]) -> DataFrame:
    """Whole groups to train, calibration and test, by the hash order of the distinct keys.

    ``parts`` maps a name to its upper cumulative share.
    """
    keys = df.select(key).distinct().withColumn("_h", hash_unit(key))
    per = keys.groupBy("_h").agg(F.count("*").alias("_n"))
    scan = ordered_scan(per, [], "_h", {"_before": "_n"})
    n = keys.agg(F.count("*")).scalar()
    pos = F.col("_before") / n
    part = None
    for name, top in parts.items():
        part = F.when(pos < top, name) if part is None else part.when(pos < top, name)
    # written and counted: few groups are broadcast, and the rows of a large group stay where they are
    return df.join(bounded(keys.join(scan, "_h").select(key, part.alias("part"))), key)


def risk_scores(pred: DataFrame, by: str = "model", eps: float = 1e-6) -> DataFrame:
    """Brier, log loss, AUC, calibration error and mean error per package and year, per model."""
    p = pred.withColumn("prob", F.least(F.greatest("prob", F.lit(eps)), F.lit(1 - eps)))
    a = p.groupBy(by).agg(brier("label", "prob").alias("brier"), log_loss("label", "prob", eps).alias("log_loss"))
    pack = p.groupBy(by, "scenario", "year").agg(F.avg("prob").alias("_p"), F.avg("label").alias("_y"))
    pack = pack.groupBy(by).agg((F.avg(F.abs(F.col("_p") - F.col("_y"))) * 100).alias("package_error"))
    return (a.join(ece_bins(p, [by], "label", "prob"), by).join(auc(p, [by], "label", "prob"), by).join(pack, by))


def range_scores(pred: DataFrame) -> DataFrame:
    """Coverage, mean width and mean error of the median of run-out ranges."""
    inside = ((F.col("run_out") >= F.col("low")) & (F.col("run_out") <= F.col("high"))).cast("double")
    return pred.agg(F.avg(inside).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("avg_width"),
                    F.avg(F.abs(F.col("median") - F.col("run_out"))).alias("median_error"))


def driver_ranges(drivers: DataFrame, central_run: int = 0) -> DataFrame:
    """1st and 99th percentile of each driver over runs, and its value on the central run."""
    rows = [F.struct(F.lit(c).alias("driver"), F.col(c).alias("value")) for c in DRIVERS]
    long = drivers.select("run", F.explode(F.array(*rows)).alias("r")).select("run", "r.driver", "r.value")
    q = exact_quantiles(long, ["driver"], "value", {"p1": 0.01, "p99": 0.99})
    return q.join(long.where(F.col("run") == central_run).select("driver", F.col("value").alias("central")), "driver", "left")

"""What moves a fitted model's predictions: Shapley values over groups of features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ensure_checkpoint_dir
from .boosting import Boosted, boost
from .waves import subset_weight

Predict = Callable[[DataFrame], DataFrame]
MOST_GROUPS = 6


def boosted(train: DataFrame, features: list[str], value: str, chance: bool = False, depth: int = 4, rounds: int = 300,
            seed: int = 7) -> Predict:
    """Boosted trees at rate 0.05, of a number or (``chance``) of a 0/1 label. Returns df -> df with ``predicted``."""
    ensure_checkpoint_dir(train.sparkSession)       # boosting cuts its lineage there every ten rounds
    kind = GBTClassifier if chance else GBTRegressor
    trees = kind(featuresCol="_x", labelCol=value, maxDepth=depth, stepSize=0.05, maxIter=rounds, seed=seed)
    return Predicted(boost(trees, train, features, value, mean=not chance), chance)


class Predicted:
    """df -> df with ``predicted``; ``lowest`` makes rows equal that the trees cannot tell apart."""

    def __init__(self, model: Boosted, chance: bool):
        self.model, self.lowest = model, model.lowest
        self.result = vector_to_array("probability")[1] if chance else F.col("prediction")

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model(df).withColumn("predicted", self.result).drop("_x", "rawPrediction", "probability", "prediction")


def contributions(df: DataFrame, groups: dict[str, list[str]], predict: Predict, keys: tuple[str, ...] = ()) -> DataFrame:
    """Shapley split of each row's prediction: ``phi_<group>``, which add up to ``predicted`` - ``base``.

    The worth of a set of groups is the prediction with the other groups' features at their means over ``df``; ``base``
    has all of them there. Rows with equal ``keys`` and features become one with its number of rows as ``weight``; for
    boosted trees, rows whose features lie on the same steps are equal, and a feature is shown as the low end of its step.
    Every remaining row meets its 2^k sets (k at most six) in the task that holds it, and the sets are added up
    before the shuffle. Rows with a null feature are left to the caller: the models take none. No rows, no result.
    """
    k = len(groups)
    if k > MOST_GROUPS:
        raise ValueError(f"at most {MOST_GROUPS} feature groups")
    features = [f for fs in groups.values() for f in fs]
    steps = predict.lowest(df) if isinstance(predict, Predicted) else df
    rows = steps.groupBy(*keys, *features).agg(F.count("*").alias("weight"))
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()          # one row of numbers
    bit = {f: 1 << i for i, fs in enumerate(groups.values()) for f in fs}
    sets = rows.withColumns({f"_own_{f}": F.col(f) for f in features}).withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(2 ** k - 1))))
    sets = sets.withColumns({f: F.when(F.col("_m").bitwiseAND(bit[f]) != 0, F.col(f).cast("double")).otherwise(F.lit(means[f]))
                             for f in features})
    worth = F.col("predicted")
    out = predict(sets).groupBy(*keys, *[f"_own_{f}" for f in features]).agg(
        F.first("weight").alias("weight"), F.max(F.when(F.col("_m") == 0, worth)).alias("base"),
        F.max(F.when(F.col("_m") == 2 ** k - 1, worth)).alias("predicted"),
        *[F.sum(subset_weight("_m", i, k) * worth).alias(f"phi_{g}") for i, g in enumerate(groups)])
    return out.withColumnsRenamed({f"_own_{f}": f for f in features})


def mean_contributions(split: DataFrame, groups: dict[str, list[str]], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, driver, importance, direction): weighted means of contributions, without and with their sign."""
    def mean(e):
        return F.sum(e * F.col("weight")) / F.sum("weight")
    parts = [mean(e) for g in groups for e in (F.abs(F.col(f"phi_{g}")), F.col(f"phi_{g}"))]
    rows = [F.struct(F.lit(g).alias("driver"), parts[2 * i].alias("importance"), parts[2 * i + 1].alias("direction"))
            for i, g in enumerate(groups)]
    wide = split.groupBy(*by).agg(F.array(*rows).alias("_r"))
    return wide.select(*by, F.inline("_r")).where(F.col("importance").isNotNull())

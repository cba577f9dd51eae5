"""Boosted trees over counted rows.

Spark's trees see a feature only as at most 32 steps, so rows that agree on all steps are one row with a weight. Training
works on these; their number is bounded by the steps that occur, not by the rows. No row is left out: each counts in
the steps and in its weight.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ensure_checkpoint_dir

STEPS = 32              # Spark's default for maxBins
DRAWS = 100_000         # few cells are parted for subsampling, into about so many pieces in all


def _step(feature: str) -> str:
    return f"_s_{feature}"


def feature_steps(df: DataFrame, features: list[str], most: int = STEPS) -> Bucketizer | None:
    """Quantile steps of the features with more than about ``most`` values; the others stay as they are (None: all)."""
    seen = df.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    many = [f for f in features if seen[f] > most]
    if not many:
        return None
    cuts = df.select(*[F.col(f).cast("double").alias(f) for f in many]).approxQuantile(many, [i / most for i in range(1, most)], 0.001)
    splits = [[float("-inf"), *sorted(set(c)), float("inf")] for c in cuts]
    return Bucketizer(splitsArray=splits, inputCols=many, outputCols=[_step(f) for f in many])


class Boosted:
    """A fitted model: called on rows it adds the model's columns."""

    def __init__(self, model: PipelineModel, bucketizer: Bucketizer | None):
        self.model, self.bucketizer = model, bucketizer
        self.stepped = list(bucketizer.getInputCols()) if bucketizer else []

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).drop(*[_step(f) for f in self.stepped])

    def lowest(self, df: DataFrame) -> DataFrame:
        """The rows with each stepped feature at the low end of its step, which the model predicts alike."""
        if not self.stepped:
            return df
        low = {f: F.get(F.array(*[F.lit(v) for v in s[:-1]]), F.col(_step(f)).cast("int"))
               for f, s in zip(self.stepped, self.bucketizer.getSplitsArray())}
        return self.bucketizer.transform(df).withColumns(low).drop(*[_step(f) for f in self.stepped])


def boost(estimator, train: DataFrame, features: list[str], label: str, mean: bool = False) -> Boosted:
    """Fit ``estimator`` (boosted trees) on the counted rows of ``train``.

    ``mean`` is for numeric labels under squared error, where rows of one cell act as their mean. Otherwise cells are kept
    apart by label. A subsampling rate draws pieces: rows where there are few, and of larger tables equal parts of a cell,
    or a cell with all of its rows. Null features or labels are errors.
    """
    ensure_checkpoint_dir(train.sparkSession)
    steps = feature_steps(train, features)
    many = list(steps.getInputCols()) if steps else []
    names = [_step(f) if f in many else f for f in features]
    rows = steps.transform(train) if steps else train
    if mean:
        value = F.when(F.count(label) == F.count("*"), F.avg(label)).alias(label)      # a null label stays one
        cells = rows.groupBy(*names).agg(F.count("*").cast("double").alias("_weight"), value)
    else:
        cells = rows.groupBy(*names, label).agg(F.count("*").cast("double").alias("_weight"))
    # a fixed order, so that the draws of subsampling do not depend on the shuffle
    order = names if mean else [*names, label]
    cells = cells.repartition(train.sparkSession.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order).checkpoint()
    pieces = DRAWS // max(cells.count(), 1)
    if estimator.getSubsamplingRate() < 1 and pieces > 1:
        cells = (cells.withColumn("_parts", F.least("_weight", F.lit(pieces)).cast("int"))
                 .withColumn("_part", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
                 .withColumn("_weight", F.col("_weight") / F.col("_parts")).drop("_part", "_parts"))
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol=estimator.getFeaturesCol()), estimator.setWeightCol("_weight")]).fit(cells)
    return Boosted(PipelineModel([steps, *model.stages] if steps else model.stages), steps)

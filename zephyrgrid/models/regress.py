"""Regressors on MLlib: forests, kernel features and sequences. Boosted trees are in :mod:`boosting`."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrgrid.models.selection import assemble
from zephyrgrid.operators import metrics as M
from zephyrgrid.operators.contracts import clip_between


def forest_importance(train: DataFrame, columns: list[str], target: str, trees: int = 200, depth: int = 5,
                      seed: int = 42) -> dict[str, float]:
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth,
                                   featureSubsetStrategy="all", seed=seed)
    model = forest.fit(assemble(train.select(*columns, target), columns))
    return dict(zip(columns, model.featureImportances.toArray().tolist()))


def predicted(model, df: DataFrame, columns: list[str], capacity: str | None = "capacity", out: str = "pred") -> DataFrame:
    """Predicted utilisation as energy within the capacity, or as it is without one."""
    scored = model.transform(assemble(df, columns)).drop("features")
    value = F.col("prediction")
    if capacity is not None:
        value = clip_between(value, 0.0, F.lit(1.0)) * F.col(capacity)
    return scored.withColumn(out, value).drop("prediction")


class KernelBaseline:
    """Random Fourier features (Rahimi and Recht, 2007) of an RBF kernel with a Huber line."""

    def __init__(self, columns: list[str], target: str, width: int = 32, gamma: float | None = None,
                 epsilon: float = 1.35, reg: float = 1e-3, seed: int = 42):
        self.columns, self.target, self.width, self.epsilon, self.reg = columns, target, width, epsilon, reg
        rng = np.random.default_rng(seed)
        spread = math.sqrt(2 * (gamma or 1.0 / len(columns)))
        waves, phases = rng.normal(0.0, spread, (width, len(columns))), rng.uniform(0.0, 2 * math.pi, width)
        self.waves = np.c_[waves, phases].tolist()  # the last place of each meets a constant

    def _expand(self, df: DataFrame) -> DataFrame:
        place = [(F.col(c) - self.params[c][0]) / self.params[c][1] for c in self.columns]
        scaled = F.array(*[p.cast("double") for p in place], F.lit(1.0))
        angle = lambda wave: F.aggregate(F.zip_with(scaled, wave, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
        made = F.transform(F.lit(self.waves), lambda wave: F.cos(angle(wave)) * math.sqrt(2.0 / self.width))
        return df.withColumn("features", array_to_vector(made))

    def fit(self, train: DataFrame) -> KernelBaseline:
        from zephyrgrid.models.selection import population_params
        self.params = population_params(train, self.columns)
        line = LinearRegression(featuresCol="features", labelCol=self.target, loss="huber", epsilon=self.epsilon,
                                regParam=self.reg, maxIter=50)
        self.model = line.fit(self._expand(train))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._expand(df.drop("features")))


def sequence_features(seqs: DataFrame) -> DataFrame:
    """A (rows x features) history as one vector."""
    flat = F.transform(F.flatten("sequence"), lambda x: x.cast("double"))
    return seqs.withColumn("features", array_to_vector(flat))


class SettlementEvaluator(Evaluator):
    """The official score for a trainer: mean over groups of error and settlement share.

    Without a group column the rows are one group. ``metric="neg_mae"`` is the fallback.
    """

    def __init__(self, pred: str = "pred", actual: str = "actual", capacity: str = "capacity",
                 group: str = "group", metric: str = "score"):
        super().__init__()
        self.pred, self.actual, self.capacity, self.group, self.metric = pred, actual, capacity, group, metric

    def _evaluate(self, dataset: DataFrame) -> float:
        keys = [self.group] if self.group in dataset.columns else []
        summary = M.group_summary(dataset, keys, self.pred, self.actual, self.capacity)
        if self.metric == "neg_mae":
            return -float(summary.agg(F.avg("mae")).first()[0])
        return float(M.total_score(summary, []).first()["official_score"])

    def isLargerBetter(self) -> bool:
        return True

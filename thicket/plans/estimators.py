"""Estimators: fit(df) on a DataFrame with named columns, predict and predict_proba as columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions import metrics as M
from thicket.functions import objectives as O
from thicket.operators.model import GBDTModel
from thicket.plans import gblinear
from thicket.plans.gbdt import GBDTConfig
from thicket.sources.dataset import Dataset

REGRESSION = ("squared", "absolute", "quantile", "pseudo_huber", "poisson")
CLASSIFICATION = ("logistic", "hinge", "softmax")


class _Estimator:
    tasks: tuple[str, ...] = ()
    default = "squared"

    def __init__(self, features: Sequence[str], label: str, weight: str | None = None, categorical: Sequence[str] = (), objective: O.Objective | str | None = None, metric: M.Metric | str | None = None, **params: Any):
        self.features, self.label, self.weight, self.categorical, self.params = tuple(features), label, weight, tuple(categorical), params
        chosen = O.get(objective) if isinstance(objective, str) and objective != "softmax" else objective
        if isinstance(chosen, O.Objective) and chosen.name in (*REGRESSION, *CLASSIFICATION) and chosen.name not in self.tasks:
            raise ValueError(f"{type(self).__name__} does not take the {chosen.name} objective")
        self.objective = chosen
        self.metric = M.get(metric) if isinstance(metric, str) else metric
        self.model: Any = None

    def _dataset(self, df: DataFrame, categories: Any = None) -> Dataset:
        return Dataset.from_dataframe(df, self.features, self.label, self.weight, self.categorical, categories=categories)

    def _objective(self, df: DataFrame) -> O.Objective:
        return self.objective or O.get(self.default)

    def _train(self, ds: Dataset, valid: Dataset | None, objective: O.Objective) -> Any:
        raise NotImplementedError

    def fit(self, df: DataFrame, eval_set: DataFrame | None = None):
        objective = self._objective(df)
        ds = self._dataset(df)
        self.model = self._train(ds, self._dataset(eval_set, ds.categories) if eval_set is not None else None, objective)
        return self

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        out = self.model.transform(df, "_raw", "_all").drop("_raw")
        one = F.col("_all")[0] if self.model.objective.n_outputs == 1 else F.col("_all")
        return out.withColumn(output, one).drop("_all")


class _Trees:
    def _train(self, ds: Dataset, valid: Dataset | None, objective: O.Objective) -> GBDTModel:
        known = {"max_leaves": "n_leaves", "grow_strategy": "growth", "gamma": "min_gain_to_split", "reg_alpha": "l1", "reg_lambda": "l2"}
        params = {"learning_rate": 0.1} | {known.get(k, k): v for k, v in self.params.items()}
        return GBDTModel.train(ds, GBDTConfig(objective=objective, metric=self.metric or (M.get(objective.metric) if params.get("early_stopping_rounds") else None), **params), valid)

    def feature_importances_(self, spark: Any) -> DataFrame:
        return self.model.feature_importance(spark, "gain")


class _Linear:
    def _train(self, ds: Dataset, valid: Dataset | None, objective: O.Objective) -> gblinear.GBLinearModel:
        return gblinear.train(ds, gblinear.GBLinearConfig(objective=objective, metric=self.metric, **({"l2": 1.0} | self.params)), valid)


class _Classifier(_Estimator):
    """Labels of any type: their sorted values are classes 0 .. K-1. More than two need softmax, which is then chosen."""

    tasks, default = CLASSIFICATION, "logistic"
    classes_: list = []

    def fit(self, df: DataFrame, eval_set: DataFrame | None = None):
        self.classes_ = [r[0] for r in df.select(self.label).where(F.col(self.label).isNotNull()).distinct().orderBy(self.label).collect()]
        return super().fit(self._coded(df), self._coded(eval_set) if eval_set is not None else None)

    def _coded(self, df: DataFrame) -> DataFrame:
        of = F.create_map(*[x for i, c in enumerate(self.classes_) for x in (F.lit(c), F.lit(float(i)))])
        return df.withColumn(self.label, F.try_element_at(of, F.col(self.label)))

    def _objective(self, df: DataFrame) -> O.Objective:
        if len(self.classes_) > 2:
            return self.objective if self.objective is not None and not isinstance(self.objective, str) and self.objective.n_outputs == len(self.classes_) else O.softmax_loss(len(self.classes_))
        return self.objective if isinstance(self.objective, O.Objective) else O.softmax_loss(max(2, len(self.classes_))) if self.objective == "softmax" else O.logistic()

    def predict_proba(self, df: DataFrame, output: str = "probability") -> DataFrame:
        """An array of one probability for each class."""
        out = self.model.transform(df, "_raw", "_all").drop("_raw")
        p = F.col("_all")
        return out.withColumn(output, F.array(1 - p[0], p[0]) if self.model.objective.n_outputs == 1 else p).drop("_all")

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """The class: of two the second from 0.5 on (for hinge: from margin 0), of more the first of the most probable."""
        out = self.model.transform(df, "_raw", "_all")
        least = 0.0 if self.model.objective.name == "hinge" else 0.5
        code = F.when(F.col("_all")[0] >= least, 1).otherwise(0) if self.model.objective.n_outputs == 1 else (F.array_position("_all", F.array_max("_all")) - 1).cast("int")
        names = F.array(*[F.lit(c) for c in self.classes_])
        return out.withColumn(output, F.get(names, code)).drop("_raw", "_all")


class GBDTRegressor(_Trees, _Estimator):
    tasks = REGRESSION


class GBDTClassifier(_Trees, _Classifier):
    pass


class GBLinearRegressor(_Linear, _Estimator):
    tasks = REGRESSION


class GBLinearClassifier(_Linear, _Classifier):
    pass



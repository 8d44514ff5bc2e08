"""Linear boosting by coordinate descent.

With fixed hessians a round's coordinate updates depend on the data only through sums of g x, h x x' and h x, so a round
is one aggregate whatever the order of its features; for squared loss the products are constant and computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions import metrics as M
from thicket.functions import objectives as O
from thicket.plans.gbdt import EarlyStopping
from thicket.sources.dataset import Dataset


class GBLinearError(ValueError):
    pass


@dataclass(frozen=True)
class GBLinearConfig:
    objective: O.Objective = field(default_factory=O.squared)
    metric: M.Metric | None = None
    n_estimators: int = 100
    learning_rate: float = 0.5
    l1: float = 0.0
    l2: float = 0.0
    update_strategy: str = "shotgun"
    selector: str = "cyclic"
    top_k: int = 0
    max_delta_step: float = 0.0
    early_stopping_rounds: int | None = None
    seed: int = 42

    def __post_init__(self):
        if self.update_strategy not in ("shotgun", "sequential"):
            raise ValueError("update_strategy must be shotgun or sequential")
        if self.selector not in ("cyclic", "shuffle", "random", "greedy", "thrifty"):
            raise ValueError("selector must be cyclic, shuffle, random, greedy or thrifty")
        if self.n_estimators < 1 or self.learning_rate <= 0 or min(self.l1, self.l2, self.max_delta_step) < 0:
            raise ValueError("n_estimators and learning_rate must be positive; l1, l2 and max_delta_step not negative")


def clamp(delta: float, most: float) -> float:
    return float(np.clip(delta, -most, most)) if most > 0 else delta


def bias_step(g: float, h: float, rate: float, most: float = 0.0) -> float:
    return clamp(-g / h * rate, most) if h > 1e-10 else 0.0


def coordinate_step(w: float, g: float, h: float, l1: float, l2: float, rate: float, most: float = 0.0) -> float:
    """Elastic net: the weight does not pass 0 in one step. g and h are sums of g x and h x x."""
    if h + l2 < 1e-5:
        return 0.0
    grad = g + l2 * w
    if w - (grad + l1) / (h + l2) >= 0 and w >= 0 or w - (grad + l1) / (h + l2) > 0:
        delta = max(-(grad + l1) / (h + l2), -w)
    elif w - (grad - l1) / (h + l2) < 0:
        delta = min(-(grad - l1) / (h + l2), -w)
    else:
        delta = -w
    return clamp(delta * rate, most)


def magnitude(w: float, g: float, h: float, l1: float, l2: float) -> float:
    return abs(coordinate_step(w, g, h, l1, l2, 1.0))


def order(selector: str, n: int, random: Random, sizes: Callable[[], np.ndarray], top_k: int) -> list[int]:
    """The features of one round. Greedy and thrifty both take the largest steps first, top_k of them if it is not 0."""
    if selector == "cyclic":
        return list(range(n))
    if selector == "shuffle":
        out = list(range(n))
        random.shuffle(out)
        return out
    if selector == "random":
        return [random.randrange(n) for _ in range(n)]
    found = np.argsort(-sizes(), kind="stable").tolist()
    return found[:top_k] if top_k else found


@dataclass
class GBLinearModel:
    """weights [features + 1, outputs]; the last row is the bias."""

    features: tuple[str, ...]
    weights: np.ndarray
    objective: O.Objective
    history: list[dict[str, float]] = field(default_factory=list)
    best_iteration: int = 0

    @property
    def coef_(self) -> np.ndarray:
        return self.weights[:-1]

    @property
    def intercept_(self) -> np.ndarray:
        return self.weights[-1]

    def margins(self) -> list[Column]:
        """Bias plus products; a missing value adds nothing."""
        out = []
        for k in range(self.weights.shape[1]):
            total = F.lit(float(self.weights[-1, k]))
            for f, w in zip(self.features, self.weights[:-1, k], strict=True):
                total = total + F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) * float(w)
            out.append(total)
        return out

    def transform(self, df: DataFrame, raw: str = "raw", prediction: str = "prediction") -> DataFrame:
        """df with arrays of margins and of transformed predictions; stays in the JVM."""
        lost = [f for f in self.features if f not in df.columns]
        if lost:
            raise ValueError(f"features missing: {', '.join(lost)}")
        ms = self.margins()
        return df.withColumns({raw: F.array(*ms), prediction: F.array(*self.objective.applied(ms))})

    def shap(self, df: DataFrame, means: dict[str, float] | None = None, output: str = "shap") -> DataFrame:
        """df with an array by output of attributions w (x - mean), the base value last."""
        from thicket.operators.explain import linear_shap

        return df.withColumn(output, linear_shap(self.features, self.weights, means))


def check(ds: Dataset) -> None:
    """Categories have no order to weigh; targets and weights must be there."""
    if ds.categorical:
        raise GBLinearError(f"categorical features: {', '.join(sorted(ds.categorical))}")
    if not ds.label:
        raise GBLinearError("training needs a label")
    bad = [c for c in (ds.label, ds.weight) if c and not ds.df.where(F.col(c).isNull() | F.isnan(c)).isEmpty()]
    if bad:
        raise GBLinearError(f"missing values in {', '.join(bad)}")


#: features up to which a parallel update of squared loss keeps all products of two features
MOST_PRODUCTS = 512


def sums_of(ds: Dataset, weights: np.ndarray, objective: O.Objective, products: bool) -> list[dict[str, np.ndarray]]:
    """By output: sums G of g, H of h, gx of g x, and hx of h x and hxx of h x x', or of its diagonal without `products`."""
    d, k = len(ds.features), objective.n_outputs
    width = 2 + d + d + (d * d if products else d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width))
        for batch in batches:
            x = np.nan_to_num(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(d)], axis=1), nan=0.0) if d else np.zeros((batch.num_rows, 0))
            y, w = (batch.column(d + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (0, 1))
            g, h = objective.kernel((x @ weights[:-1] + weights[-1]).T, y, w)
            for o in range(k):
                hh = np.broadcast_to(h[o], y.shape)
                second = ((x * hh[:, None]).T @ x).ravel() if products else hh @ (x * x)
                total[o] += np.concatenate([[g[o].sum(), hh.sum()], g[o] @ x, hh @ x, second])
        n = k * width
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

    w = F.coalesce(F.col(ds.weight), F.lit(1.0)) if ds.weight else F.lit(1.0)
    rows = ds.df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(ds.features)], F.col(ds.label).cast("double").alias("_y"), w.cast("double").alias("_w"))
    out = np.zeros(k * width)
    for i, v in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    parts = []
    for row in out.reshape(k, width):
        parts.append({"G": row[0], "H": row[1], "gx": row[2 : 2 + d], "hx": row[2 + d : 2 + 2 * d], "hxx": row[2 + 2 * d :].reshape(d, d) if products else np.diag(row[2 + 2 * d :])})
    return parts


def one_round(w: np.ndarray, s: dict[str, np.ndarray], c: GBLinearConfig, l1: float, l2: float, random: Random) -> np.ndarray:
    """The new weights of one output (bias last)."""
    w, g, total = w.copy(), s["gx"].copy(), s["G"]
    step = bias_step(total, s["H"], c.learning_rate, c.max_delta_step)
    w[-1] += step
    g = g + s["hx"] * step
    d = len(g)
    features = order(c.selector, d, random, lambda: np.array([magnitude(w[j], g[j], s["hxx"][j, j], l1, l2) for j in range(d)]), c.top_k)
    if c.update_strategy == "shotgun":
        deltas = {j: coordinate_step(w[j], g[j], s["hxx"][j, j], l1, l2, c.learning_rate, c.max_delta_step) for j in features}
        for j, delta in deltas.items():
            w[j] += delta
    else:
        for j in features:
            delta = coordinate_step(w[j], g[j], s["hxx"][j, j], l1, l2, c.learning_rate, c.max_delta_step)
            w[j] += delta
            g += s["hxx"][:, j] * delta
    return w


def evaluate(ds: Dataset, model: GBLinearModel, metric: M.Metric) -> float:
    df = model.transform(ds.df, "_raw", "_pred")
    source = "_raw" if metric.kind == "margin" else "_pred"
    names = [f"_m{k}" for k in range(model.weights.shape[1])]
    return metric.evaluate(df.withColumns({n: F.col(source)[k] for k, n in enumerate(names)}), names, ds.label, ds.weight)


def train(ds: Dataset, config: GBLinearConfig = GBLinearConfig(), valid: Dataset | None = None) -> GBLinearModel:
    check(ds)
    if config.early_stopping_rounds and config.metric is None:
        raise ValueError("early stopping needs a metric")
    d, k = ds.n_features, config.objective.n_outputs
    model = GBLinearModel(ds.features, np.zeros((d + 1, k)), config.objective)
    model.weights[-1] = config.objective.base(ds.df, ds.label, ds.weight)
    total = ds.df.agg(F.sum(F.col(ds.weight)) if ds.weight else F.count("*")).first()[0] or 0
    l1, l2 = config.l1 * total, config.l2 * total
    random = Random(config.seed)
    products = config.update_strategy == "sequential"
    stop = EarlyStopping(config.early_stopping_rounds or 0, config.metric.higher_is_better if config.metric else False)
    kept = model.weights.copy()
    cached = ds.with_df(ds.df.persist())
    constant: list | None = None
    try:
        for _ in range(config.n_estimators):
            if constant is None:
                # constant products save later passes, at d x d sums a task; wide data pass again with the diagonal alone
                shortcut = config.objective.name == "squared" and (products or d <= MOST_PRODUCTS)
                sums = sums_of(cached, model.weights, config.objective, products or shortcut)
                if shortcut:
                    constant, first = sums, model.weights.copy()
            else:
                # squared loss: the gradient sums follow from the change of the weights
                change = model.weights - first
                sums = [{**s, "G": s["G"] + s["hx"] @ change[:-1, o] + s["H"] * change[-1, o], "gx": s["gx"] + s["hxx"] @ change[:-1, o] + s["hx"] * change[-1, o]} for o, s in enumerate(constant)]
            model.weights = np.stack([one_round(model.weights[:, o], sums[o], config, l1, l2, random) for o in range(k)], axis=1)
            if config.metric:
                row = {f"train-{config.metric.name}": evaluate(cached, model, config.metric)}
                if valid is not None:
                    row[f"valid-{config.metric.name}"] = evaluate(valid, model, config.metric)
                model.history.append(row)
                said = stop.update(row.get(f"valid-{config.metric.name}", row[f"train-{config.metric.name}"]))
                if said == "improved":
                    kept = model.weights.copy()
                if said == "stop":
                    break
    finally:
        cached.df.unpersist()
    model.best_iteration = stop.best_round if config.early_stopping_rounds else config.n_estimators
    if config.early_stopping_rounds:
        model.weights = kept
    return model

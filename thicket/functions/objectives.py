"""Losses: gradients and hessians as Columns and as numpy kernels, base scores as aggregates, and output transforms.

In both forms p is the margin, y the target and w the weight. Columns serve queries; the kernels run inside the training
loop's Arrow batches. A loss with several outputs takes a list of margins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.session import materialised

#: fixed values that results must share: clamps of exponents, probabilities and hessians
EXP_LIMIT, PROB_FLOOR, HESS_FLOOR, RATE_FLOOR = 30.0, 1e-7, 1e-6, 1e-7


def sigmoid(x: Column) -> Column:
    """Stable for large arguments of either sign."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softmax(xs: Sequence[Column]) -> list[Column]:
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    es = [F.exp(x - top) for x in xs]
    total = sum(es[1:], es[0])
    return [e / total for e in es]


def np_sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def np_softmax(x: np.ndarray) -> np.ndarray:
    """Over axis 0."""
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def weighted_mean(y: Column, w: Column) -> Column:
    return F.when(F.sum(w) > 0, F.sum(w * y) / F.sum(w)).otherwise(F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def weighted_quantile(df: DataFrame, value: str, weight: str | None, alpha: float) -> float:
    """The first value, in order, at which the cumulated weight reaches alpha of all: the lower inverse of the distribution.

    Weights are summed by value before the window, and the window runs over partition sums and then over one partition,
    so that no task sees all rows.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    by = df.select(F.col(value).alias("v"), w.cast("double").alias("w")).where("v IS NOT NULL").groupBy("v").agg(F.sum("w").alias("w"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = materialised(by.repartitionByRange(parts, "v").withColumn("p", F.spark_partition_id()))
    sums = sorted(by.groupBy("p").agg(F.sum("w")).collect())
    goal, before = alpha * sum(s for _, s in sums), 0.0
    for p, s in sums:
        if before + s >= goal:
            cum = F.sum("w").over(Window.partitionBy("p").orderBy("v")) + F.lit(before)
            found = by.where(F.col("p") == p).withColumn("c", cum).where(F.col("c") >= goal).agg(F.min("v")).first()[0]
            if found is not None:
                return float(found)
        before += s
    last = by.agg(F.max("v")).first()[0]
    return float(last) if last is not None else 0.0


@dataclass(frozen=True)
class Objective:
    """name, outputs, gradients in both forms, base scores and the transform of margins ('identity', 'sigmoid' or 'softmax')."""

    name: str
    columns: Callable[[list[Column], Column, Column], list[tuple[Column, Column]]] = field(compare=False, repr=False)
    kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = field(compare=False, repr=False)
    base: Callable[[DataFrame, str, str | None], list[float]] = field(compare=False, repr=False)
    transform: str = "identity"
    n_outputs: int = 1
    params: tuple[tuple[str, Any], ...] = ()
    #: quantile levels by output, for losses whose leaves are quantiles of residuals
    renew: tuple[float, ...] | None = None
    metric: str = "rmse"

    def gradients(self, margins: list[Column], y: Column, w: Column) -> list[tuple[Column, Column]]:
        return self.columns(margins, y, w)

    def applied(self, margins: list[Column]) -> list[Column]:
        return {"identity": lambda m: m, "sigmoid": lambda m: [sigmoid(x) for x in m], "softmax": softmax}[self.transform](margins)

    def applied_np(self, margins: np.ndarray) -> np.ndarray:
        return {"identity": lambda m: m, "sigmoid": np_sigmoid, "softmax": np_softmax}[self.transform](margins)


def _one(f: Callable[[Column, Column, Column], tuple[Column, Column]]) -> Callable:
    return lambda ps, y, w: [f(ps[0], y, w)]


def _one_np(f: Callable) -> Callable:
    def run(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = f(p[0], y, w)
        return g[None], np.broadcast_to(h, g.shape)[None]

    return run


def _mean_base(link: Callable[[float], float]) -> Callable:
    def base(df: DataFrame, y: str, w: str | None) -> list[float]:
        weight = F.col(w) if w else F.lit(1.0)
        total, mean = df.agg(F.sum(weight), weighted_mean(F.col(y), weight)).first()
        return [link(float(mean)) if total and total > 0 else 0.0]

    return base


def squared() -> Objective:
    """The default: gradient w (p - y), hessian w, base the weighted mean."""
    return Objective("squared", _one(lambda p, y, w: (w * (p - y), w)), _one_np(lambda p, y, w: (w * (p - y), w)), _mean_base(lambda m: m))


def absolute() -> Objective:
    """The gradient's sign at zero is +1; base and leaves are medians."""
    return Objective(
        "absolute", _one(lambda p, y, w: (F.when(p - y >= 0, w).otherwise(-w), w)), _one_np(lambda p, y, w: (np.where(p - y >= 0, w, -w), w)),
        lambda df, y, w: [weighted_quantile(df, y, w, 0.5)], renew=(0.5,), metric="mae",
    )


def quantile(alphas: Sequence[float] = (0.5,)) -> Objective:
    """Pinball loss with one output for each level."""
    levels = tuple(float(a) for a in alphas)
    if not levels or any(not 0 < a < 1 for a in levels):
        raise ValueError("alphas must be a non-empty list of numbers between 0 and 1")
    a_np = np.array(levels)[:, None]
    return Objective(
        "quantile", lambda ps, y, w: [(F.when(p < y, -a * w).otherwise((1 - a) * w), w) for p, a in zip(ps, levels, strict=True)],
        lambda p, y, w: (np.where(p < y, -a_np, 1 - a_np) * w, np.broadcast_to(w, p.shape)),
        lambda df, y, w: [weighted_quantile(df, y, w, a) for a in levels], n_outputs=len(levels), params=(("alphas", levels),), renew=levels, metric="quantile",
    )


def pseudo_huber(delta: float = 1.0) -> Objective:
    if delta <= 0:
        raise ValueError("delta must be above 0")

    def columns(p: Column, y: Column, w: Column) -> tuple[Column, Column]:
        r = p - y
        s = 1 + r * r / (delta * delta)
        return w * r / F.sqrt(s), w / (s * F.sqrt(s))

    def kernel(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = p - y
        s = 1 + r * r / (delta * delta)
        return w * r / np.sqrt(s), w / (s * np.sqrt(s))

    return Objective("pseudo_huber", _one(columns), _one_np(kernel), lambda df, y, w: [weighted_quantile(df, y, w, 0.5)], params=(("delta", delta),), metric="huber")


def poisson() -> Objective:
    """Margins are logarithms of rates, and predictions stay so."""
    return Objective(
        "poisson", _one(lambda p, y, w: (w * (F.exp(clamp(p, -EXP_LIMIT, EXP_LIMIT)) - y), F.greatest(w * F.exp(clamp(p, -EXP_LIMIT, EXP_LIMIT)), F.lit(HESS_FLOOR)))),
        _one_np(lambda p, y, w: (w * ((e := np.exp(np.clip(p, -EXP_LIMIT, EXP_LIMIT))) - y), np.maximum(w * e, HESS_FLOOR))), _mean_base(lambda m: float(np.log(max(m, RATE_FLOOR)))),
    )


def logistic() -> Objective:
    def columns(p: Column, y: Column, w: Column) -> tuple[Column, Column]:
        s = sigmoid(p)
        return w * (s - y), F.greatest(w * s * (1 - s), F.lit(HESS_FLOOR))

    def kernel(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np_sigmoid(p)
        return w * (s - y), np.maximum(w * s * (1 - s), HESS_FLOOR)

    logit = lambda m: float(np.log((q := min(max(m, PROB_FLOOR), 1 - PROB_FLOOR)) / (1 - q)))
    return Objective("logistic", _one(columns), _one_np(kernel), _mean_base(logit), transform="sigmoid", metric="logloss")


def hinge() -> Objective:
    """Targets above 0.5 are the positive class."""

    def columns(p: Column, y: Column, w: Column) -> tuple[Column, Column]:
        s = F.when(y > 0.5, 1.0).otherwise(-1.0)
        return F.when(s * p < 1, -w * s).otherwise(F.lit(0.0)), w

    def kernel(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.where(y > 0.5, 1.0, -1.0)
        return np.where(s * p < 1, -w * s, 0.0), w

    return Objective("hinge", _one(columns), _one_np(kernel), lambda df, y, w: [0.0], metric="margin_accuracy")


def softmax_loss(n_classes: int) -> Objective:
    """One output for each class 0 .. n-1; targets are class numbers."""
    if n_classes < 2:
        raise ValueError("softmax needs at least 2 classes")

    def columns(ps: list[Column], y: Column, w: Column) -> list[tuple[Column, Column]]:
        return [(w * (s - F.when(F.round(y) == c, 1.0).otherwise(0.0)), F.greatest(w * s * (1 - s), F.lit(HESS_FLOOR))) for c, s in enumerate(softmax(ps))]

    def kernel(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np_softmax(p)
        return w * (s - (np.arange(n_classes)[:, None] == np.round(y))), np.maximum(w * s * (1 - s), HESS_FLOOR)

    def base(df: DataFrame, y: str, w: str | None) -> list[float]:
        weight = F.col(w) if w else F.lit(1.0)
        got = dict(df.groupBy(F.round(y).cast("int")).agg(F.sum(weight)).collect())
        total = sum(v for v in got.values() if v)
        return [float(np.log(min(max(got.get(c, 0.0) / total, PROB_FLOOR), 1 - PROB_FLOOR))) if total and total > 0 else 0.0 for c in range(n_classes)]

    return Objective("softmax", columns, kernel, base, transform="softmax", n_outputs=n_classes, params=(("n_classes", n_classes),), metric="mlogloss")


def custom(name: str, columns: Callable, kernel: Callable, base: Callable, transform: str = "identity", n_outputs: int = 1, metric: str = "rmse") -> Objective:
    """A loss of the user's: Columns stay in the JVM; the kernel, its numpy twin, trains."""
    return Objective(name, columns, kernel, base, transform=transform, n_outputs=n_outputs, metric=metric)


#: names under which get() knows the built-in losses
NAMES = ("squared", "absolute", "logistic", "hinge", "softmax", "quantile", "pseudo_huber", "poisson")


def get(name: str, **params: Any) -> Objective:
    makers = {"squared": squared, "absolute": absolute, "logistic": logistic, "hinge": hinge, "softmax": softmax_loss, "quantile": quantile, "pseudo_huber": pseudo_huber, "poisson": poisson}
    if name not in makers:
        raise ValueError(f"unknown objective {name!r}; known: {', '.join(NAMES)}")
    return makers[name](**params)

"""Feature importance as queries of the node table, and Shapley values of trees and linear models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.forest import Forest, Tree, apply_kernel

KINDS = ("split", "gain", "average_gain", "cover", "average_cover")


class ExplainError(ValueError):
    pass


def importance(nodes: DataFrame, features: Sequence[str], kind: str = "gain") -> DataFrame:
    """(feature, name, value) for every feature, those that never split with 0."""
    if kind not in KINDS:
        raise ExplainError(f"unknown importance {kind!r}; known: {', '.join(KINDS)}")
    measure = {"split": F.count("*").cast("double"), "gain": F.sum("gain"), "average_gain": F.avg("gain"), "cover": F.sum("cover"), "average_cover": F.avg("cover")}[kind]
    used = nodes.where("NOT is_leaf").groupBy("feature").agg(measure.alias("value"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    return names.join(used, "feature", "left").select("feature", "name", F.coalesce("value", F.lit(0.0)).alias("value"))


def normalised(values: DataFrame) -> DataFrame:
    """Shares that sum to 1; zeros stay."""
    total = F.sum("value").over(Window.partitionBy())
    return values.withColumn("value", F.when(total > 0, F.col("value") / total).otherwise(F.lit(0.0)))


def top(values: DataFrame, k: int) -> DataFrame:
    """The k greatest, ties by feature number."""
    return values.orderBy(F.desc("value"), "feature").limit(k)


def to_map(values: DataFrame) -> dict[str, float]:
    return {r["name"]: r["value"] for r in values.collect()}


def linear_shap(features: Sequence[str], weights: np.ndarray, means: Mapping[str, float] | None = None) -> Column:
    """Array by output of arrays: w (x - mean) for each feature, then bias + sum of w mean. Means default to 0."""
    mean = [float((means or {}).get(f, 0.0)) for f in features]
    outputs = []
    for k in range(weights.shape[1]):
        w = weights[:, k]
        parts = [(F.col(f).cast("double") - m) * float(c) for f, m, c in zip(features, mean, w[:-1], strict=True)]
        outputs.append(F.array(*parts, F.lit(float(w[-1] + np.dot(w[:-1], mean)))))
    return F.array(*outputs)


def expected(t: Tree) -> np.ndarray:
    """The cover-weighted mean of the leaves below each node."""
    out = np.array(t.value, dtype=np.float64)
    for i in sorted(range(t.n_nodes), key=lambda n: -t.depths()[n]) if t.n_nodes > 1 else []:
        if t.feature[i] >= 0:
            a, b = t.left[i], t.right[i]
            total = t.cover[a] + t.cover[b]
            out[i] = (t.cover[a] * out[a] + t.cover[b] * out[b]) / total if total > 0 else (out[a] + out[b]) / 2
    return out


class PathShap:
    """Path-dependent Shapley values of one tree, for all rows of a batch at once.

    A leaf's value is a game over the features of its path: with a feature known the row either follows the path there or
    not, without it the path keeps a share of the covers. Each leaf's game is a product over features, so its Shapley values
    follow from polynomials over the number of known features: one for each leaf, and one division for each feature.
    """

    def __init__(self, tree: Tree):
        self.tree = tree
        self.leaves = []
        stack: list[tuple[int, list[tuple[int, int, bool, float]]]] = [(0, [])]
        while stack:
            node, path = stack.pop()
            f = tree.feature[node]
            if f < 0:
                self.leaves.append((float(tree.value[node]), path))
                continue
            a, b = tree.left[node], tree.right[node]
            total = tree.cover[a] + tree.cover[b]
            for child, is_left in ((a, True), (b, False)):
                share = tree.cover[child] / total if total > 0 else 0.5
                stack.append((child, [*path, (node, f, is_left, share)]))

    def _goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        t = self.tree
        v = x[:, t.feature[node]]
        yes = np.isin(v, t.left_cats[node]) if node in t.left_cats else v < t.threshold[node]
        return np.where(np.isnan(v), t.default_left[node], yes)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """([rows, features] values, expected value)."""
        n, out, base = len(x), np.zeros(x.shape), 0.0
        left = {i: self._goes_left(i, x) for i, f in enumerate(self.tree.feature) if f >= 0}
        for value, path in self.leaves:
            follows: dict[int, np.ndarray] = {}
            keeps: dict[int, float] = {}
            for node, f, is_left, share in path:
                follows[f] = follows.get(f, True) & (left[node] == is_left)
                keeps[f] = keeps.get(f, 1.0) * share
            features = list(follows)
            base += value * float(np.prod([keeps[f] for f in features]))
            if not features:
                continue
            one = np.stack([follows[f].astype(np.float64) for f in features])
            zero = np.array([keeps[f] for f in features])
            d = len(features)
            weights = np.array([1.0 / (d * comb(d - 1, s)) for s in range(d)])
            for i, f in enumerate(features):
                # poly[s]: products over the other features, s of them known
                poly = np.zeros((d, n))
                poly[0] = 1.0
                m = 0
                for j in range(d):
                    if j != i:
                        grown = poly * zero[j]
                        grown[1 : m + 2] += poly[: m + 1] * one[j]
                        poly, m = grown, m + 1
                out[:, f] += value * (one[i] - zero[i]) * (weights @ poly)
        return out, base


def comb(n: int, k: int) -> int:
    from math import comb as choose

    return choose(n, k)


def tree_shap(forest: Forest, x: np.ndarray) -> np.ndarray:
    """[rows, features + 1, outputs]: values, and last the expected margin; their sum is the margin. Linear leaves count with their constant."""
    out = np.zeros((len(x), x.shape[1] + 1, forest.n_groups))
    out[:, -1, :] = forest.base
    for t in forest.trees:
        if t.n_nodes > 1 and not any(t.cover):
            raise ExplainError("the trees have no covers")
        values, base = PathShap(t)(x)
        out[:, :-1, t.group] += values
        out[:, -1, t.group] += base
    return out


def shap(df: DataFrame, forest: Forest, features: Sequence[str], output: str = "shap") -> DataFrame:
    """df with an array by output of arrays: one value a feature, the base value last. Arrow batches; a narrow step."""

    def run(x: np.ndarray) -> list[pa.Array]:
        v = np.moveaxis(tree_shap(forest, x), 2, 1)
        n, k, d = v.shape
        inner = pa.ListArray.from_arrays(pa.array(np.arange(n * k + 1, dtype=np.int32) * d), pa.array(v.ravel()))
        return [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), inner)]

    return apply_kernel(df, features, run, [(output, "array<array<double>>")])


def additivity(df: DataFrame, shap_column: str, margin: str) -> DataFrame:
    """(error): the greatest difference between sums of values and margins (an array by output)."""
    total = F.transform(shap_column, lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v))
    each = F.zip_with(total, F.col(margin), lambda a, b: F.abs(a - b))
    return df.agg(F.max(F.array_max(each)).alias("error"))

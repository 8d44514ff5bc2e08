"""Trees as arrays, the node table, and inference in Arrow batches or as a SQL expression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "tree_id int, group_id int, node_id int, parent int, depth int, is_leaf boolean, feature int, threshold double, left_child int, right_child int, default_left boolean, "
    "left_cats array<int>, value double, gain double, cover double, lin_features array<int>, lin_coefs array<double>, lin_intercept double"
)


class InvalidModel(ValueError):
    pass


@dataclass
class Tree:
    """Nodes by number, the root 0. Leaves have feature -1. A numeric node sends x < threshold left, a categorical one its left_cats; missing goes by default_left.

    A category that is not in left_cats goes right, one never seen too. lin: leaf -> (features, coefficients, intercept).
    """

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    default_left: list[bool] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    left_cats: dict[int, tuple[int, ...]] = field(default_factory=dict)
    lin: dict[int, tuple[list[int], list[float], float]] = field(default_factory=dict)
    group: int = 0

    def add(self, value: float = 0.0, cover: float = 0.0) -> int:
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.default_left, False), (self.value, value), (self.gain, 0.0), (self.cover, cover)):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, default_left: bool, gain: float = 0.0, left_cats: Sequence[int] | None = None, covers: tuple[float, float] = (0.0, 0.0)) -> tuple[int, int]:
        a, b = self.add(cover=covers[0]), self.add(cover=covers[1])
        self.feature[node], self.threshold[node], self.default_left[node], self.gain[node] = feature, threshold, default_left, gain
        self.left[node], self.right[node] = a, b
        if left_cats is not None:
            self.left_cats[node] = tuple(int(c) for c in left_cats)
        return a, b

    @property
    def n_nodes(self) -> int:
        return len(self.feature)

    @property
    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]

    def parents(self) -> list[int]:
        out = [-1] * self.n_nodes
        for i in range(self.n_nodes):
            if self.feature[i] >= 0:
                out[self.left[i]] = out[self.right[i]] = i
        return out

    def depths(self) -> list[int]:
        out, queue = [0] * self.n_nodes, [0]
        while queue:
            i = queue.pop()
            if self.feature[i] >= 0:
                for c in (self.left[i], self.right[i]):
                    out[c] = out[i] + 1
                    queue.append(c)
        return out

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x [rows, features], NaN for missing. Goes down a level at a time."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, default = np.array(self.left), np.array(self.right), np.array(self.default_left)
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, np.int64)
        while len(rows):
            at = node[rows]
            v = x[rows, feature[at]]
            goes = np.where(np.isnan(v), default[at], v < threshold[at])
            for n in np.unique(at[np.isin(at, list(self.left_cats))]) if self.left_cats else ():
                own = at == n
                goes[own] = np.where(np.isnan(v[own]), default[n], np.isin(v[own], self.left_cats[int(n)]))
            node[rows] = np.where(goes, left[at], right[at])
            rows = rows[feature[node[rows]] >= 0]
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        leaf = self.route(x)
        out = np.array(self.value, dtype=np.float64)[leaf]
        for n, (features, coefs, intercept) in self.lin.items():
            own = np.flatnonzero(leaf == n)
            if len(own):
                part = x[np.ix_(own, features)]
                fine = ~np.isnan(part).any(axis=1)
                out[own[fine]] = intercept + part[fine] @ np.array(coefs)
        return out

    def validate(self, n_features: int | None = None) -> None:
        """Every node is reached once from the root; children are in range; no cycles."""
        if not self.n_nodes:
            raise InvalidModel("empty tree")
        seen, queue = set(), [0]
        while queue:
            i = queue.pop()
            if i in seen:
                raise InvalidModel(f"node {i} is reached twice")
            seen.add(i)
            if self.feature[i] >= 0:
                for c in (self.left[i], self.right[i]):
                    if not 0 <= c < self.n_nodes:
                        raise InvalidModel(f"node {i} has child {c}, out of range")
                    if c == i:
                        raise InvalidModel(f"node {i} is its own child")
                    queue.append(c)
                if n_features is not None and self.feature[i] >= n_features:
                    raise InvalidModel(f"node {i} splits on feature {self.feature[i]} of {n_features}")
        if len(seen) < self.n_nodes:
            raise InvalidModel("a node is not reached")

    def expression(self, columns: Sequence[Column], node: int = 0) -> Column:
        """The tree as nested CASE; for shallow trees and few of them."""
        if self.feature[node] < 0:
            constant = F.lit(float(self.value[node]))
            if node not in self.lin:
                return constant
            features, coefs, intercept = self.lin[node]
            total = F.lit(float(intercept))
            for f, c in zip(features, coefs, strict=True):
                total = total + columns[f] * float(c)
            return F.coalesce(total, constant)
        x = columns[self.feature[node]]
        goes = x.isin(*[float(c) for c in self.left_cats[node]]) if node in self.left_cats else x < float(self.threshold[node])
        a, b = self.expression(columns, self.left[node]), self.expression(columns, self.right[node])
        return F.when(x.isNull(), a if self.default_left[node] else b).when(goes, a).otherwise(b)


@dataclass
class Forest:
    trees: list[Tree]
    base: list[float]

    @property
    def n_groups(self) -> int:
        return len(self.base)

    def margins(self, x: np.ndarray, tree_weights: Sequence[float] | None = None) -> np.ndarray:
        """[groups, rows]: base plus leaves; with tree_weights each tree's part is scaled."""
        out = np.repeat(np.array(self.base, dtype=np.float64)[:, None], len(x), axis=1)
        for i, t in enumerate(self.trees):
            out[t.group] += t.predict(x) * (1.0 if tree_weights is None else tree_weights[i])
        return out

    def validate(self, n_features: int | None = None) -> None:
        if not self.base:
            raise InvalidModel("no base score")
        for t in self.trees:
            if not 0 <= t.group < self.n_groups:
                raise InvalidModel(f"group {t.group} of {self.n_groups}")
            t.validate(n_features)

    def rows(self) -> list[tuple]:
        """The node table's rows."""
        out: list[tuple] = []
        for k, t in enumerate(self.trees):
            parents, depths = t.parents(), t.depths()
            for i in range(t.n_nodes):
                leaf = t.feature[i] < 0
                lin = t.lin.get(i)
                out.append((
                    k, t.group, i, parents[i], depths[i], leaf, None if leaf else t.feature[i], None if leaf or i in t.left_cats else float(t.threshold[i]), None if leaf else t.left[i], None if leaf else t.right[i],
                    None if leaf else bool(t.default_left[i]), list(t.left_cats[i]) if i in t.left_cats else None, float(t.value[i]) if leaf else None, None if leaf else float(t.gain[i]), float(t.cover[i]),
                    list(map(int, lin[0])) if lin else None, list(map(float, lin[1])) if lin else None, float(lin[2]) if lin else None,
                ))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODE_SCHEMA)

    @classmethod
    def from_rows(cls, rows: Sequence[Any], base: Sequence[float]) -> Forest:
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["tree_id"], []).append(r)
        trees = []
        for k in sorted(by):
            nodes = sorted(by[k], key=lambda r: r["node_id"])
            t = Tree(group=nodes[0]["group_id"])
            for r in nodes:
                i = t.add(r["value"] if r["value"] is not None else 0.0, r["cover"] or 0.0)
                if not r["is_leaf"]:
                    t.feature[i], t.threshold[i], t.left[i], t.right[i] = r["feature"], r["threshold"] if r["threshold"] is not None else 0.0, r["left_child"], r["right_child"]
                    t.default_left[i], t.gain[i] = bool(r["default_left"]), r["gain"] or 0.0
                    if r["left_cats"] is not None:
                        t.left_cats[i] = tuple(r["left_cats"])
                if r["lin_features"] is not None:
                    t.lin[i] = (list(r["lin_features"]), list(r["lin_coefs"]), r["lin_intercept"])
            trees.append(t)
        return cls(trees, list(base))


def feature_matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """[rows, features] with NaN for missing."""
    x = np.empty((batch.num_rows, len(features)))
    for i, f in enumerate(features):
        x[:, i] = batch.column(f).to_numpy(zero_copy_only=False)
    return x


def apply_kernel(df: DataFrame, features: Sequence[str], kernel: Any, outputs: Sequence[tuple[str, str]]) -> DataFrame:
    """df with the columns that kernel(x [rows, features]) returns, in Arrow batches; a narrow step. Names of outputs replace columns of df."""
    kept = [f.name for f in df.schema.fields if f.name not in {n for n, _ in outputs}]
    inputs = [f"_x{i}" for i in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = kernel(feature_matrix(batch, inputs))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *got], [*kept, *(n for n, _ in outputs)])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in kept), *(f"`{n}` {k}" for n, k in outputs)])
    return df.select(*kept, *[F.col(f).cast("double").alias(i) for f, i in zip(features, inputs, strict=True)]).mapInArrow(run, schema)

"""The boosted-tree model: prediction, attribution, tables and files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import objectives as O
from thicket.operators import explain
from thicket.operators.forest import Forest, apply_kernel
from thicket.sources.dataset import coded


@dataclass
class GBDTModel:
    """A forest with its features, the loss whose transform applies, and the encoding of categories.

    categories: feature -> values; code i is the i-th. transform() encodes raw values by it.
    """

    forest: Forest
    features: tuple[str, ...]
    objective: O.Objective = field(default_factory=O.squared)
    categories: Mapping[str, tuple] = field(default_factory=dict)
    history: list[dict[str, float]] = field(default_factory=list)
    best_iteration: int = 0

    @classmethod
    def train(cls, ds: Any, config: Any = None, valid: Any = None) -> GBDTModel:
        from thicket.plans import gbdt

        c = config or gbdt.GBDTConfig()
        got = gbdt.train(ds, c, valid)
        return cls(got.forest, ds.features, c.objective, ds.categories, got.history, got.best_iteration)

    @property
    def n_trees(self) -> int:
        return len(self.forest.trees)

    def encoded(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """df with a numeric column for each feature, and their names; a category that training did not know is missing."""
        lost = [f for f in self.features if f not in df.columns]
        if lost:
            raise ValueError(f"features missing: {', '.join(lost)}")
        extra, names = {}, []
        for i, f in enumerate(self.features):
            values = self.categories.get(f)
            if values is None:
                names.append(f)
                continue
            kind = df.schema[f].dataType.simpleString()
            if kind in ("string", "boolean") or list(values) != [float(c) for c in range(len(values))]:
                key = F.col(f) if kind in ("string", "boolean") else F.col(f).cast("double")
                df, extra[f"_code{i}"] = coded(df, key, values)
                names.append(f"_code{i}")
            else:
                names.append(f)
        names_before = [c for c in df.columns if not c.startswith("_code_")]
        return (df.select(*names_before, *[c.alias(n) for n, c in extra.items()]) if extra else df), names

    def transform(self, df: DataFrame, raw: str = "raw", prediction: str = "prediction", tree_weights: Sequence[float] | None = None) -> DataFrame:
        """df with arrays of margins (raw) and predictions. One narrow step in Arrow batches; tree_weights scale trees, as for dropped-out ones."""
        coded, names = self.encoded(df)

        def arrays(m: np.ndarray) -> pa.Array:
            k, n = m.shape
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(m.T.ravel()))

        def run(x: np.ndarray) -> list[pa.Array]:
            m = self.forest.margins(x, tree_weights)
            return [arrays(m), arrays(self.objective.applied_np(m))]

        out = apply_kernel(coded, names, run, [(raw, "array<double>"), (prediction, "array<double>")])
        return out.drop(*[n for n in names if n.startswith("_code")])

    predict = transform

    def expressions(self) -> list[Any]:
        """The margins as SQL expressions; for a handful of shallow trees."""
        columns = [F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in self.features]
        out = [F.lit(float(b)) for b in self.forest.base]
        for t in self.forest.trees:
            out[t.group] = out[t.group] + t.expression(columns)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return self.forest.table(spark)

    def feature_importance(self, spark: SparkSession, kind: str = "gain") -> DataFrame:
        if not self.forest.trees:
            raise explain.ExplainError("the model has no trees")
        if kind not in ("split",) and not any(any(t.cover) or any(t.gain) for t in self.forest.trees):
            raise explain.ExplainError("the model's nodes have no gains or covers")
        return explain.importance(self.table(spark), self.features, kind)

    def shap(self, df: DataFrame, output: str = "shap") -> DataFrame:
        coded, names = self.encoded(df)
        return explain.shap(coded, self.forest, names, output).drop(*[n for n in names if n.startswith("_code")])

    def inspect(self, tree: int = 0) -> list[dict[str, Any]]:
        """One tree's nodes: node_id, is_leaf, feature name, threshold, children, value, gain and cover; null on the side that has none."""
        rows = [r for r in self.forest.rows() if r[0] == tree]
        if not rows:
            raise IndexError(f"tree {tree} of {self.n_trees}")
        return [
            {"node_id": r[2], "is_leaf": r[5], "feature": None if r[6] is None else self.features[r[6]], "threshold": r[7], "left_child": r[8], "right_child": r[9], "value": r[12], "gain": r[13], "cover": r[14]}
            for r in rows
        ]

    def plot(self, tree: int = 0) -> str:
        """The tree as indented text."""
        nodes, out = {n["node_id"]: n for n in self.inspect(tree)}, []

        def walk(i: int, depth: int) -> None:
            n = nodes[i]
            out.append("  " * depth + (f"leaf {n['value']:.6g}" if n["is_leaf"] else f"{n['feature']} < {n['threshold']}" if n["threshold"] is not None else f"{n['feature']} in {list(self.forest.trees[tree].left_cats[i])}"))
            if not n["is_leaf"]:
                walk(n["left_child"], depth + 1)
                walk(n["right_child"], depth + 1)

        walk(0, 0)
        return "\n".join(out)

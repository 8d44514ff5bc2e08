"""Linear leaves: a small weighted ridge regression in each leaf, on the features of its path."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from thicket.operators.forest import Tree


@dataclass(frozen=True)
class LinearLeafConfig:
    """alpha is accepted and, as in the result format this follows, not used."""

    l2: float = 0.01
    alpha: float = 0.0
    max_iterations: int = 10
    tolerance: float = 1e-6
    min_samples: int = 50
    coefficient_threshold: float = 1e-6
    max_features: int = 10
    scope: str = "path"
    skip_first: int = 1


def path_features(tree: Tree, leaf: int, numeric: set[int], most: int) -> list[int]:
    """Numeric split features from the leaf up to the root, each once."""
    parents, out, at = tree.parents(), [], leaf
    while (at := parents[at]) >= 0:
        f = tree.feature[at]
        if f in numeric and at not in tree.left_cats and f not in out:
            out.append(f)
    return out[:most]


def global_features(tree: Tree, numeric: set[int], most: int) -> list[int]:
    """Numeric split features by how often they split, then by number."""
    counts: dict[int, int] = {}
    for i, f in enumerate(tree.feature):
        if f in numeric and i not in tree.left_cats:
            counts[f] = counts.get(f, 0) + 1
    return sorted(counts, key=lambda f: (-counts[f], f))[:most]


def moments(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows' sums [1 + d + 1, d + 1]: the weighted products of (x, 1), under them -X'g, and last the row count. Rows with a missing value are left out."""
    fine = ~np.isnan(x).any(axis=1)
    a = np.column_stack([x[fine], np.ones(fine.sum())])
    out = np.zeros((a.shape[1] + 2, a.shape[1]))
    out[:-2] = (a * h[fine, None]).T @ a
    out[-2] = -(a.T @ g[fine])
    out[-1, 0] = fine.sum()
    return out


def solve(sums: np.ndarray, c: LinearLeafConfig) -> tuple[np.ndarray, float] | None:
    """(coefficients, intercept) by Gauss-Seidel sweeps, the ridge on features alone; none for too few rows or no curvature."""
    a, b, n = sums[:-2].copy(), sums[-2], sums[-1, 0]
    d = len(b)
    if n < c.min_samples or d < 2:
        return None
    a[np.arange(d - 1), np.arange(d - 1)] += c.l2
    if (np.diag(a) <= 1e-12).any():
        return None
    x = np.zeros(d)
    for _ in range(c.max_iterations):
        before = x.copy()
        for i in [d - 1, *range(d - 1)]:
            x[i] += (b[i] - a[i] @ x) / a[i, i]
        if np.abs(x - before).max() < c.tolerance:
            break
    return x[:-1], float(x[-1])


def attach(tree: Tree, leaf: int, features: list[int], got: tuple[np.ndarray, float], rate: float, c: LinearLeafConfig) -> None:
    """Small coefficients go; what is left is scaled by the learning rate."""
    kept = [(f, float(k)) for f, k in zip(features, got[0], strict=True) if abs(k) > c.coefficient_threshold]
    if kept:
        tree.lin[leaf] = ([f for f, _ in kept], [k * rate for _, k in kept], got[1] * rate)

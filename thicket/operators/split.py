"""Split search over one node's histogram, on the driver in numpy. operators/histogram.py has the same as window queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class SplitParams:
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    min_child_weight: float = 1.0
    min_samples_leaf: int = 1
    max_onehot_cats: int = 4


@dataclass(frozen=True)
class Split:
    """gain; feature column; bin (numeric: bins up to it go left); left category bins, or none; whether missing goes left; children's sums."""

    gain: float
    feature: int
    bin: int
    left_cats: tuple[int, ...] | None
    default_left: bool
    left: tuple[float, float, float]
    right: tuple[float, float, float]


def score(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + l2 > 0, g * g / (h + l2), 0.0)


def gains(left: np.ndarray, total: np.ndarray, p: SplitParams) -> np.ndarray:
    """Gain of each candidate, single precision as the result format has it; -inf where a child is too small. left: [n, 3] of g, h, count."""
    right = total - left
    raw = 0.5 * (score(left[:, 0], left[:, 1], p.l2) + score(right[:, 0], right[:, 1], p.l2) - score(total[0], total[1], p.l2)) - p.min_gain
    fine = (left[:, 1] >= p.min_child_weight) & (right[:, 1] >= p.min_child_weight) & (left[:, 2] >= p.min_samples_leaf) & (right[:, 2] >= p.min_samples_leaf)
    return np.where(fine, raw.astype(np.float32), -np.inf)


def leaf_weight(g: float, h: float, p: SplitParams) -> float:
    """-G / (H + l2), the gradient soft-thresholded by l1."""
    if h + p.l2 <= 0:
        return 0.0
    return -(np.sign(g) * max(abs(g) - p.l1, 0.0)) / (h + p.l2)


def numeric(hist: np.ndarray, total: np.ndarray, p: SplitParams, missing: bool) -> tuple[float, int, bool, np.ndarray] | None:
    """(gain, bin, default_left, left sums): forward with missing on the right; with a missing bin also backward with it on the left, which must be strictly better."""
    n = len(hist)
    best = None
    if n > 1:
        left = np.cumsum(hist, axis=0)[:-1]
        gain = gains(left, total, p)
        i = int(gain.argmax())
        if np.isfinite(gain[i]):
            best = (float(gain[i]), i, False, left[i])
    if missing and n > 2:
        right = np.cumsum(hist[:-1][::-1], axis=0)[:-1]
        gain = gains(total - right, total, p)
        i = int(gain.argmax())
        if np.isfinite(gain[i]) and (best is None or gain[i] > best[0]):
            best = (float(gain[i]), n - 3 - i, True, total - right[i])
    return best


def categorical(hist: np.ndarray, total: np.ndarray, p: SplitParams) -> tuple[float, tuple[int, ...], np.ndarray] | None:
    """(gain, left bins, left sums). hist has no missing bin. Up to max_onehot_cats categories: one against the rest; above: prefixes in order of -g / (h + 1e-6)."""
    if len(hist) < 2:
        return None
    if len(hist) <= p.max_onehot_cats:
        gain = gains(hist, total, p)
        i = int(gain.argmax())
        return (float(gain[i]), (i,), hist[i]) if np.isfinite(gain[i]) else None
    kept = np.flatnonzero(hist[:, 1] > 1e-10)
    order = kept[np.argsort(-hist[kept, 0] / (hist[kept, 1] + 1e-6), kind="stable")]
    if len(order) < 2:
        return None
    left = np.cumsum(hist[order], axis=0)[:-1]
    gain = gains(left, total, p)
    i = int(gain.argmax())
    return (float(gain[i]), tuple(sorted(order[: i + 1].tolist())), left[i]) if np.isfinite(gain[i]) else None


def find(hists: np.ndarray, total: np.ndarray, n_bins: np.ndarray, is_cat: np.ndarray, has_missing: np.ndarray, p: SplitParams, columns: np.ndarray | None = None) -> Split | None:
    """The best split over the columns; of equal gains the lowest column, then the lowest bin, forward first. hists: [columns, bins, 3]."""
    best: Split | None = None
    for f in columns if columns is not None else range(len(hists)):
        hist = hists[f, : n_bins[f]]
        if is_cat[f]:
            got = categorical(hist[:-1] if has_missing[f] else hist, total, p)
            if got and (best is None or got[0] > best.gain):
                best = Split(got[0], int(f), -1, got[1], False, tuple(got[2]), tuple(total - got[2]))
        else:
            num = numeric(hist, total, p, bool(has_missing[f]))
            if num and (best is None or num[0] > best.gain):
                best = Split(num[0], int(f), num[1], None, num[2], tuple(num[3]), tuple(total - num[3]))
    return best

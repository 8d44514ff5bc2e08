"""Models of two other libraries, from the JSON that they dump, as models of this one."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Any

import numpy as np

from thicket.functions import objectives as O
from thicket.operators.forest import Forest, Tree
from thicket.operators.model import GBDTModel
from thicket.plans.gblinear import GBLinearModel


class ConvertError(ValueError):
    pass


def _document(source: Any) -> Mapping[str, Any]:
    if isinstance(source, Mapping):
        return source
    if hasattr(source, "save_raw"):
        return json.loads(bytes(source.save_raw("json")))
    if hasattr(source, "dump_model"):
        return source.dump_model()
    return json.loads(Path(source).read_text())


def _names(given: Any, n: int) -> tuple[str, ...]:
    return tuple(given) if given and len(given) == n else tuple(f"f{i}" for i in range(n))


# objective names as the dumps spell them
XGB_LOGIT, XGB_LOG = ("binary:logistic", "reg:logistic", "binary:logitraw"), ("count:poisson", "reg:gamma", "reg:tweedie")


def _xgb_objective(name: str, n_classes: int, params: Mapping[str, Any]) -> O.Objective:
    if name.startswith("multi:"):
        return O.softmax_loss(max(2, n_classes))
    if name in ("binary:logistic", "reg:logistic"):
        return O.logistic()
    return {"binary:hinge": O.hinge, "count:poisson": O.poisson, "reg:absoluteerror": O.absolute, "reg:pseudohubererror": O.pseudo_huber}.get(name, O.squared)()


def _xgb_tree(d: Mapping[str, Any], group: int) -> Tree:
    t = Tree(group=group)
    kids = list(zip(d["left_children"], d["right_children"], strict=True))
    kinds = d.get("split_type") or [0] * len(kids)
    cats = {}
    for node, begin, size in zip(d.get("categories_nodes", []), d.get("categories_segments", []), d.get("categories_sizes", []), strict=False):
        cats[node] = set(d["categories"][begin : begin + size])
    # the cuts are single-precision numbers, so an input rounded to single precision is compared; a double input meets the same double
    for i, (a, b) in enumerate(kids):
        t.add(float(d["base_weights"][i]), float(d.get("sum_hessian", [0.0] * len(kids))[i]))
        if a >= 0:
            t.feature[i], t.left[i], t.right[i] = int(d["split_indices"][i]), int(a), int(b)
            t.default_left[i], t.gain[i] = bool(d["default_left"][i]), float(d.get("loss_changes", [0.0] * len(kids))[i])
            if kinds[i] == 1:
                # the dump lists the categories that go right: here they are the left ones, with the children exchanged
                t.left_cats[i], t.left[i], t.right[i], t.default_left[i] = tuple(sorted(cats.get(i, ()))), int(b), int(a), not t.default_left[i]
            else:
                t.threshold[i] = float(np.float32(d["split_conditions"][i]))
    return t


def from_xgboost(source: Any) -> GBDTModel | GBLinearModel:
    """A path, mapping or booster of a JSON model: gbtree, dart (its trees at their weights) or gblinear. The base score moves to margin space."""
    d = _document(source)
    if "learner" not in d:
        raise ConvertError("not a model dump: no learner")
    learner = d["learner"]
    params = learner["learner_model_param"]
    name = learner.get("objective", {}).get("name", "reg:squarederror")
    n, k = int(params["num_feature"]), max(1, int(params.get("num_class", 0)), int(params.get("num_target", 1)))
    text = str(params["base_score"]).strip("[]")
    bases = [float(v) for v in text.split(",")] if text else [0.5]
    if name in XGB_LOGIT and name != "binary:logitraw":
        bases = [float(np.log((q := min(max(b, 1e-7), 1 - 1e-7)) / (1 - q))) for b in bases]
    elif name in XGB_LOG:
        bases = [float(np.log(max(b, 1e-7))) for b in bases]
    bases = bases * k if len(bases) == 1 else bases
    features = _names(learner.get("feature_names"), n)
    objective = _xgb_objective(name, k, params)
    booster, weights = learner["gradient_booster"], None
    if booster.get("name") == "gblinear":
        w = np.array(booster["model"]["weights"], dtype=np.float64).reshape(n + 1, k)
        w[-1] += bases
        return GBLinearModel(features, w, objective)
    if booster.get("name") == "dart":
        weights, booster = booster.get("weight_drop"), booster["gbtree"]
    if "model" not in booster:
        raise ConvertError(f"unknown booster {booster.get('name')!r}")
    trees = [_xgb_tree(t, int(g)) for t, g in zip(booster["model"]["trees"], booster["model"]["tree_info"], strict=True)]
    for t, w in zip(trees, weights or [], strict=False):
        t.value = [v * w for v in t.value]
    forest = Forest(trees, bases)
    forest.validate(n)
    return GBDTModel(forest, features, objective)


def _lgb_nodes(node: Mapping[str, Any]) -> Iterator[Mapping[str, Any]]:
    """Parents before children, left before right."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        if "left_child" in x:
            stack += [x["right_child"], x["left_child"]]


def _lgb_tree(d: Mapping[str, Any], group: int) -> Tree:
    t, number = Tree(group=group), {}
    for x in _lgb_nodes(d["tree_structure"]):
        number[id(x)] = t.add(float(x.get("leaf_value", 0.0)), float(x.get("leaf_weight", x.get("internal_weight", 0.0)) or 0.0))
    for x in _lgb_nodes(d["tree_structure"]):
        i = number[id(x)]
        if "left_child" in x:
            t.feature[i], t.left[i], t.right[i], t.gain[i] = int(x["split_feature"]), number[id(x["left_child"])], number[id(x["right_child"])], float(x.get("split_gain", 0.0))
            t.default_left[i] = bool(x.get("default_left", False))
            if x.get("decision_type", "<=") == "==":
                t.left_cats[i] = tuple(sorted(int(c) for c in str(x["threshold"]).split("||")))
            else:
                t.threshold[i] = float(np.nextafter(float(x["threshold"]), np.inf))  # there a value at the cut goes left
        elif x.get("leaf_features"):
            t.lin[i] = ([int(f) for f in x["leaf_features"]], [float(c) for c in x["leaf_coeff"]], float(x["leaf_const"]))
    return t


def from_lightgbm(source: Any) -> GBDTModel:
    """A path, mapping or booster of a dumped model: numeric and categorical splits, linear leaves, trees dealt to classes in turn."""
    d = _document(source)
    if "tree_info" not in d:
        raise ConvertError("not a model dump: no tree_info")
    k = int(d.get("num_tree_per_iteration", 1))
    trees = [_lgb_tree(t, i % k) for i, t in enumerate(d["tree_info"])]
    n = int(d["max_feature_idx"]) + 1
    name, _, rest = str(d.get("objective", "regression")).partition(" ")
    makers = {"binary": O.logistic, "regression_l1": O.absolute, "poisson": O.poisson}
    objective = O.softmax_loss(k) if name in ("multiclass", "softmax") else O.quantile() if name == "quantile" else makers.get(name, O.squared)()
    forest = Forest(trees, [0.0] * k)
    forest.validate(n)
    return GBDTModel(forest, _names(d.get("feature_names"), n), objective)

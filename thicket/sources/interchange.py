"""Model files of the single-node engine: its JSON envelope and its binary form of MessagePack, both read and written.

There, a categorical node lists the categories that go right; here left_cats go left, so children and default are exchanged
on the way in and out. A split without a stored set is numeric. Values are stored as they are.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Mapping
from typing import Any

import numpy as np

from thicket.functions import objectives as O
from thicket.operators.forest import Forest, InvalidModel, Tree
from thicket.operators.model import GBDTModel
from thicket.plans.gblinear import GBLinearModel
from thicket.sources.persist import ReadError, crc32c

# Fixed values of the format: magic bytes, greatest version, forms of the payload and model types
MAGIC = b"BSTR"
VERSIONS = (1, 2)
PLAIN, COMPRESSED = 1, 2
TYPES = {1: "gbdt", 2: "gblinear"}
HEADER, TRAILER = struct.Struct("<4sIBB22x"), struct.Struct("<QI4x")


# MessagePack, as far as the format needs it


def pack(x: Any) -> bytes:
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if 0 <= x < 128:
            return bytes([x])
        return struct.pack(">BQ", 0xCF, x) if x >= 0 else struct.pack(">Bq", 0xD3, x)
    if isinstance(x, float):
        return struct.pack(">Bd", 0xCB, x)
    if isinstance(x, str):
        b = x.encode()
        return (bytes([0xA0 | len(b)]) if len(b) < 32 else struct.pack(">BI", 0xDB, len(b))) + b
    if isinstance(x, Mapping):
        return struct.pack(">BI", 0xDF, len(x)) + b"".join(pack(k) + pack(v) for k, v in x.items())
    return struct.pack(">BI", 0xDD, len(x)) + b"".join(pack(v) for v in x)


_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZED = {0xD9: ("s", ">B"), 0xDA: ("s", ">H"), 0xDB: ("s", ">I"), 0xC4: ("b", ">B"), 0xC5: ("b", ">H"), 0xC6: ("b", ">I"), 0xDC: ("a", ">H"), 0xDD: ("a", ">I"), 0xDE: ("m", ">H"), 0xDF: ("m", ">I")}


def unpack(data: bytes) -> Any:
    """The one value that data holds."""
    value, at = _unpack(data, 0, 0)
    if at != len(data):
        raise ReadError("decode", "bytes after the value")
    return value


def _unpack(data: bytes, at: int, depth: int) -> tuple[Any, int]:
    if depth > 32 or at >= len(data):
        raise ReadError("decode", "cut short" if at >= len(data) else "too deep")
    c, at = data[at], at + 1
    if c < 0x80:
        return c, at
    if c >= 0xE0:
        return c - 256, at
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], at
    if c in _NUMBERS:
        n = struct.calcsize(_NUMBERS[c])
        if at + n > len(data):
            raise ReadError("decode", "cut short")
        return struct.unpack_from(_NUMBERS[c], data, at)[0], at + n
    if c < 0x90:
        kind, size = "m", c & 15
    elif c < 0xA0:
        kind, size = "a", c & 15
    elif c < 0xC0:
        kind, size = "s", c & 31
    elif c in _SIZED:
        kind, form = _SIZED[c]
        n = struct.calcsize(form)
        if at + n > len(data):
            raise ReadError("decode", "cut short")
        size, at = struct.unpack_from(form, data, at)[0], at + n
    else:
        raise ReadError("decode", f"byte {c:#x}")
    if size > len(data) - at:
        raise ReadError("decode", "cut short")
    if kind in "sb":
        raw = data[at : at + size]
        try:
            return (raw.decode() if kind == "s" else raw), at + size
        except UnicodeDecodeError as e:
            raise ReadError("decode", str(e)) from e
    if kind == "a":
        out = []
        for _ in range(size):
            v, at = _unpack(data, at, depth + 1)
            out.append(v)
        return out, at
    pairs = {}
    for _ in range(size):
        k, at = _unpack(data, at, depth + 1)
        v, at = _unpack(data, at, depth + 1)
        if not isinstance(k, str):
            raise ReadError("decode", "a key is no text")
        pairs[k] = v
    return pairs, at


# Models


def _tree_in(d: Mapping[str, Any], values: list[float], group: int) -> Tree:
    n = d["num_nodes"]
    columns = [d["split_indices"], d["thresholds"], d["children_left"], d["children_right"], d["default_left"], values, d.get("gains") or [0.0] * n, d.get("covers") or [0.0] * n]
    if any(len(c) != n for c in columns):
        raise ReadError("validation", "columns of a tree differ in length")
    sets = dict(zip(d["categories"]["node_indices"], d["categories"]["category_sets"], strict=True)) if d.get("categories") else {}
    t = Tree(group=group)
    for i, (f, cut, a, b, default, value, gain, cover) in enumerate(zip(*columns, strict=True)):
        t.add(float(value), float(cover))
        if a:  # child 0 is the root, so here it says that there is none
            t.feature[i], t.threshold[i], t.left[i], t.right[i], t.default_left[i], t.gain[i] = int(f), float(cut), int(a), int(b), bool(default), float(gain)
            if i in sets:
                t.left_cats[i], t.left[i], t.right[i], t.default_left[i] = tuple(int(c) for c in sets[i]), int(b), int(a), not default
    linear = d.get("linear_coefficients") or {"node_indices": [], "coefficients": []}
    for i, packed in zip(linear["node_indices"], linear["coefficients"], strict=True):
        k = (len(packed) - 1) // 2
        if packed:
            t.lin[int(i)] = ([int(f) for f in packed[1 : 1 + k]], [float(c) for c in packed[1 + k :]], float(packed[0]))
    return t


def _tree_out(t: Tree) -> dict[str, Any]:
    flip = set(t.left_cats)
    pick = lambda own, other: [0 if t.feature[i] < 0 else (other if i in flip else own)[i] for i in range(t.n_nodes)]
    finite = float(np.finfo(np.float32).max)
    return {
        "num_nodes": t.n_nodes, "split_indices": [max(f, 0) for f in t.feature], "thresholds": [float(min(x, finite)) for x in t.threshold], "children_left": pick(t.left, t.right), "children_right": pick(t.right, t.left),
        "default_left": [bool(d) != (i in flip) for i, d in enumerate(t.default_left)], "leaf_values": {"type": "scalar", "values": [float(v) for v in t.value]},
        "categories": {"node_indices": sorted(flip), "category_sets": [list(t.left_cats[i]) for i in sorted(flip)]},
        "linear_coefficients": {"node_indices": sorted(t.lin), "coefficients": [[float(t.lin[i][2]), *map(float, t.lin[i][0]), *map(float, t.lin[i][1])] for i in sorted(t.lin)]},
        "gains": [float(g) for g in t.gain], "covers": [float(c) for c in t.cover],
    }


def _objective(transform: str, groups: int, name: str | None) -> O.Objective:
    if name in ("squared", "absolute", "hinge", "pseudo_huber", "poisson") and transform == "identity":
        return O.get(name)
    return {"identity": O.squared, "sigmoid": O.logistic}.get(transform, lambda: O.softmax_loss(max(2, groups)))()


def model_of(kind: str, m: Mapping[str, Any]) -> GBDTModel | GBLinearModel:
    """From the payload of either form."""
    try:
        meta = m["meta"]
        n = int(meta["num_features"])
        features = tuple(meta.get("feature_names") or [f"f{i}" for i in range(n)])
        if kind == "gblinear":
            w = m["weights"]
            weights = np.array(w["values"], dtype=np.float64).reshape(w["num_features"] + 1, w["num_groups"])
            return GBLinearModel(features, weights, _objective(m["output_transform"], w["num_groups"], meta.get("objective_name")))
        f = m["forest"]
        groups = f.get("tree_groups") or [0] * len(f["trees"])
        trees = []
        for d, g in zip(f["trees"], groups, strict=True):
            leaf = d["leaf_values"]
            if leaf["type"] == "scalar":
                trees.append(_tree_in(d, leaf["values"], int(g)))
            else:  # a vector a leaf: one tree for each place
                k = len(leaf["values"][0]) if leaf["values"] else 0
                trees += [_tree_in(d, [v[j] for v in leaf["values"]], j if k > 1 else int(g)) for j in range(k)]
        forest = Forest(trees, [float(b) for b in f["base_score"]])
        if len(forest.base) != f["n_groups"]:
            raise ReadError("validation", "base scores and groups differ")
        forest.validate(n)
        cats = [x for x, t in zip(features, meta.get("feature_types") or [], strict=False) if t == "categorical"]
        top = {x: max((c for t in trees for i, s in t.left_cats.items() if features[t.feature[i]] == x for c in s), default=-1) for x in cats}
        return GBDTModel(forest, features, _objective(m["output_transform"], f["n_groups"], meta.get("objective_name")), {x: tuple(float(c) for c in range(k + 1)) for x, k in top.items() if k < 0})
    except InvalidModel as e:
        raise ReadError("validation", str(e)) from e
    except (KeyError, TypeError, IndexError, ValueError, AttributeError) as e:
        if isinstance(e, ReadError):
            raise
        raise ReadError("validation", repr(e)) from e


def payload_of(model: GBDTModel | GBLinearModel) -> tuple[str, dict[str, Any]]:
    meta = {"num_features": len(model.features), "feature_names": list(model.features), "objective_name": model.objective.name}
    if isinstance(model, GBLinearModel):
        k = model.weights.shape[1]
        body = {"meta": {**meta, "num_groups": k, "objective_name": None}, "weights": {"values": [float(v) for v in model.weights.ravel()], "num_features": len(model.features), "num_groups": k}, "base_score": [0.0] * k, "output_transform": model.objective.transform}
        return "gblinear", body
    used = {model.features[t.feature[i]] for t in model.forest.trees for i in t.left_cats} | set(model.categories)
    meta |= {"num_groups": model.forest.n_groups, "feature_types": ["categorical" if f in used else "numeric" for f in model.features]}
    forest = {"trees": [_tree_out(t) for t in model.forest.trees], "tree_groups": [t.group for t in model.forest.trees], "n_groups": model.forest.n_groups, "base_score": [float(b) for b in model.forest.base]}
    return "gbdt", {"meta": meta, "forest": forest, "output_transform": model.objective.transform}


def read_json(data: bytes) -> GBDTModel | GBLinearModel:
    try:
        d = json.loads(data)
    except ValueError as e:
        raise ReadError("json", str(e)) from e
    if not isinstance(d, dict) or not {"bstr_version", "model_type", "model"} <= set(d):
        raise ReadError("json", "no envelope")
    if d["bstr_version"] not in VERSIONS:
        raise ReadError("version", str(d["bstr_version"]))
    if d["model_type"] not in TYPES.values():
        raise ReadError("type", str(d["model_type"]))
    return model_of(d["model_type"], d["model"])


def write_json(model: GBDTModel | GBLinearModel, pretty: bool = False) -> bytes:
    kind, body = payload_of(model)
    return json.dumps({"bstr_version": VERSIONS[-1], "model_type": kind, "model": body}, indent=2 if pretty else None, allow_nan=False).encode()


def read_binary(data: bytes) -> GBDTModel | GBLinearModel:
    if len(data) < HEADER.size + TRAILER.size:
        raise ReadError("truncated", f"{len(data)} bytes")
    magic, version, form, kind = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ReadError("magic")
    if version not in VERSIONS:
        raise ReadError("version", str(version))
    if form not in (PLAIN, COMPRESSED):
        raise ReadError("format", str(form))
    if kind not in TYPES:
        raise ReadError("type", str(kind))
    payload = data[HEADER.size : -TRAILER.size]
    size, checksum = TRAILER.unpack(data[-TRAILER.size :])
    if size != len(payload):
        raise ReadError("truncated", "payload")
    if crc32c(payload) != checksum:
        raise ReadError("checksum")
    if form == COMPRESSED:
        import zstandard

        try:
            payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
        except zstandard.ZstdError as e:
            raise ReadError("decompress", str(e)) from e
    return model_of(TYPES[kind], unpack(payload))


def write_binary(model: GBDTModel | GBLinearModel, compress: bool = True) -> bytes:
    kind, body = payload_of(model)
    payload = pack(body)
    if compress:
        import zstandard

        payload = zstandard.ZstdCompressor(level=3).compress(payload)
    code = next(k for k, v in TYPES.items() if v == kind)
    return HEADER.pack(MAGIC, VERSIONS[-1], COMPRESSED if compress else PLAIN, code) + payload + TRAILER.pack(len(payload), crc32c(payload))


def read(data: bytes) -> GBDTModel | GBLinearModel:
    """Either form, told apart by the first bytes."""
    return read_binary(data) if data[:4] == MAGIC else read_json(data)

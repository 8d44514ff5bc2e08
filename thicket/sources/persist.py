"""Model files: a JSON envelope, a checked binary form of the same, and a Parquet folder of node rows.

Binary: magic, version, model type, form of the payload, its length and CRC32C, then JSON in UTF-8, plain or zstd.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from thicket.functions import objectives as O
from thicket.operators.forest import Forest, InvalidModel, Tree
from thicket.operators.model import GBDTModel
from thicket.plans.gblinear import GBLinearModel

MAGIC, VERSION = b"THKT", 1
TYPES = {1: "gbdt", 2: "gblinear"}
FORMS = {0: "json", 1: "json+zstd"}
HEADER = struct.Struct("<4sHBBQI12x")  # 32 bytes
LEVEL = 3


class ReadError(ValueError):
    """kind: magic, version, type, format, truncated, checksum, decompress, json or validation."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


_TABLE = _crc_table()


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ _TABLE[(c ^ b) & 0xFF]
    return c ^ 0xFFFFFFFF


def _number(x: float) -> Any:
    return float(x) if np.isfinite(x) else str(float(x))


def to_dict(model: GBDTModel | GBLinearModel) -> dict[str, Any]:
    """The envelope: version, type and model. Infinite numbers are strings."""
    o = model.objective
    common = {"features": list(model.features), "objective": {"name": o.name, "params": {k: list(v) if isinstance(v, tuple) else v for k, v in o.params}}, "best_iteration": model.best_iteration}
    if isinstance(model, GBLinearModel):
        body = common | {"weights": [[_number(v) for v in row] for row in model.weights]}
        return {"version": VERSION, "model_type": "gblinear", "model": body}
    trees = []
    for t in model.forest.trees:
        trees.append({
            "group": t.group, "feature": t.feature, "threshold": [_number(v) for v in t.threshold], "left": t.left, "right": t.right, "default_left": [bool(v) for v in t.default_left],
            "value": [_number(v) for v in t.value], "gain": [_number(v) for v in t.gain], "cover": [_number(v) for v in t.cover],
            "left_cats": {str(k): list(v) for k, v in t.left_cats.items()}, "linear": {str(k): [list(map(int, v[0])), list(map(float, v[1])), float(v[2])] for k, v in t.lin.items()},
        })
    body = common | {"base": [_number(b) for b in model.forest.base], "trees": trees, "categories": {k: list(v) for k, v in model.categories.items()}}
    return {"version": VERSION, "model_type": "gbdt", "model": body}


def _objective(d: Mapping[str, Any]) -> O.Objective:
    if d["name"] not in O.NAMES:
        raise ReadError("validation", f"objective {d['name']!r} is not built in")
    return O.get(d["name"], **d["params"])


def from_dict(d: Mapping[str, Any]) -> GBDTModel | GBLinearModel:
    try:
        if migrate(d)["model_type"] == "gblinear":
            m = d["model"]
            return GBLinearModel(tuple(m["features"]), np.array([[float(v) for v in row] for row in m["weights"]]), _objective(m["objective"]), best_iteration=m["best_iteration"])
        if d["model_type"] != "gbdt":
            raise ReadError("type", str(d["model_type"]))
        m = d["model"]
        trees = []
        for t in m["trees"]:
            floats = {k: [float(v) for v in t[k]] for k in ("threshold", "value", "gain", "cover")}
            trees.append(Tree(feature=list(t["feature"]), left=list(t["left"]), right=list(t["right"]), default_left=list(t["default_left"]), group=t["group"], left_cats={int(k): tuple(v) for k, v in t["left_cats"].items()}, lin={int(k): (v[0], v[1], v[2]) for k, v in t["linear"].items()}, **floats))
            if len({len(c) for c in (t["feature"], t["left"], t["right"], t["default_left"], *floats.values())}) > 1:
                raise ReadError("validation", "columns of a tree differ in length")
        forest = Forest(trees, [float(b) for b in m["base"]])
        forest.validate(len(m["features"]))
        return GBDTModel(forest, tuple(m["features"]), _objective(m["objective"]), {k: tuple(v) for k, v in m["categories"].items()}, best_iteration=m["best_iteration"])
    except InvalidModel as e:
        raise ReadError("validation", str(e)) from e
    except (KeyError, TypeError, IndexError, AttributeError) as e:
        raise ReadError("validation", repr(e)) from e


def migrate(d: Mapping[str, Any]) -> Mapping[str, Any]:
    """An envelope of an earlier version as one of this version; there is only one so far."""
    if d.get("version") != VERSION:
        raise ReadError("version", str(d.get("version")))
    return d


def to_json_bytes(model: GBDTModel | GBLinearModel, pretty: bool = False) -> bytes:
    return json.dumps(to_dict(model), indent=2 if pretty else None, allow_nan=False).encode()


def from_json_bytes(data: bytes) -> GBDTModel | GBLinearModel:
    try:
        d = json.loads(data)
    except ValueError as e:
        raise ReadError("json", str(e)) from e
    if not isinstance(d, dict) or "model_type" not in d:
        raise ReadError("json", "no envelope")
    return from_dict(d)


def to_bytes(model: GBDTModel | GBLinearModel, compress: bool = True) -> bytes:
    payload = json.dumps(to_dict(model), allow_nan=False).encode()
    if compress:
        import zstandard

        payload = zstandard.ZstdCompressor(level=LEVEL).compress(payload)
    kind = 2 if isinstance(model, GBLinearModel) else 1
    return HEADER.pack(MAGIC, VERSION, kind, int(compress), len(payload), crc32c(payload)) + payload


def inspect_bytes(data: bytes) -> dict[str, Any]:
    """What the header says."""
    if len(data) < HEADER.size:
        raise ReadError("truncated", f"{len(data)} bytes")
    magic, version, kind, form, size, crc = HEADER.unpack(data[: HEADER.size])
    if magic != MAGIC:
        raise ReadError("magic")
    if version != VERSION:
        raise ReadError("version", str(version))
    if kind not in TYPES:
        raise ReadError("type", str(kind))
    if form not in FORMS:
        raise ReadError("format", str(form))
    return {"version": version, "model_type": TYPES[kind], "format": FORMS[form], "payload_bytes": size, "checksum": crc}


def from_bytes(data: bytes) -> GBDTModel | GBLinearModel:
    info = inspect_bytes(data)
    payload = data[HEADER.size : HEADER.size + info["payload_bytes"]]
    if len(payload) < info["payload_bytes"]:
        raise ReadError("truncated", "payload")
    if crc32c(payload) != info["checksum"]:
        raise ReadError("checksum")
    if info["format"] == "json+zstd":
        import zstandard

        try:
            payload = zstandard.ZstdDecompressor().decompress(payload)
        except zstandard.ZstdError as e:
            raise ReadError("decompress", str(e)) from e
    model = from_json_bytes(payload)
    if info["model_type"] != ("gblinear" if isinstance(model, GBLinearModel) else "gbdt"):
        raise ReadError("type", "header and payload differ")
    return model


def save(model: GBDTModel | GBLinearModel, path: str | Path, pretty: bool = False) -> None:
    """JSON for a name that ends in .json, else binary."""
    Path(path).write_bytes(to_json_bytes(model, pretty) if str(path).endswith(".json") else to_bytes(model))


def load(path: str | Path) -> GBDTModel | GBLinearModel:
    """Either form, told apart by its first bytes."""
    data = Path(path).read_bytes()
    return from_bytes(data) if data[:4] == MAGIC else from_json_bytes(data)


def write_table(model: GBDTModel, spark: SparkSession, path: str) -> None:
    """A folder of two Parquet tables: nodes, and one row of everything else as JSON. Any store that Spark writes to."""
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = to_dict(GBDTModel(Forest([], model.forest.base), model.features, model.objective, model.categories, best_iteration=model.best_iteration))
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_table(spark: SparkSession, path: str) -> GBDTModel:
    model = from_dict(json.loads(spark.read.parquet(f"{path}/meta").first()[0]))
    model.forest = Forest.from_rows(spark.read.parquet(f"{path}/nodes").collect(), model.forest.base)
    model.forest.validate(len(model.features))
    return model


def invalid_nodes(nodes: Any) -> Any:
    """(tree_id, node_id, problem) of a node table, as a query: children out of the table, nodes that are not the child of exactly one node, and splits without children."""
    edges = nodes.where("NOT is_leaf").select("tree_id", F.col("node_id").alias("parent"), F.explode(F.array("left_child", "right_child")).alias("node_id"))
    ids = nodes.select("tree_id", "node_id")
    lost = edges.join(ids, ["tree_id", "node_id"], "left_anti").select("tree_id", "node_id", F.lit("child out of range").alias("problem"))
    into = edges.groupBy("tree_id", "node_id").agg(F.count("*").alias("n"))
    odd = ids.join(into, ["tree_id", "node_id"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where((F.col("node_id") == 0) & (F.col("n") != 0) | (F.col("node_id") != 0) & (F.col("n") != 1))
    loop = edges.where("parent = node_id").select("tree_id", "node_id", F.lit("its own child").alias("problem"))
    return lost.unionByName(odd.select("tree_id", "node_id", F.when(F.col("n") == 0, "not reached").otherwise("reached twice").alias("problem"))).unionByName(loop)

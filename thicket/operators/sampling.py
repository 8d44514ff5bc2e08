"""Row and column sampling by hashes of row ids and a seed: the same rows for every partitioning, also when a task runs again."""

from __future__ import annotations

from collections.abc import Sequence
from random import Random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.ranking import numbered

MASK = np.uint64(2**64 - 1)


def hash01(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from ids and a salt, by the SplitMix64 finaliser."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64)
        for s in salt:
            x = x + np.uint64((s * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def uniform_rows(df: DataFrame, row: str, share: float, seed: int, round_: int = 0) -> DataFrame:
    """Exactly max(1, floor(n * share)) rows, those of the smallest hashes."""
    n = df.count()
    k = max(1, int(n * share)) if n else 0
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(round_), row))
    return numbered(hashed, ["_h", row]).where(F.col("_n") < k).drop("_n", "_h")


def goss(df: DataFrame, row: str, g: str, h: str, top: float, other: float, seed: int, round_: int = 0) -> DataFrame:
    """Gradient-based one-side sampling: all rows whose |g h| reaches the top-k-th greatest (ties too), and a hash sample of the rest.

    The rest's g and h grow by (n - k) / (rows drawn). Columns: those of df.
    """
    n = df.count()
    k, m = max(1, int(n * top)), max(1, int(n * other))
    size: Column = F.abs(F.col(g) * F.col(h))
    marked = df.withColumn("_size", size)
    least = numbered(marked.select("_size"), [F.desc("_size")]).where(F.col("_n") == k - 1).first()
    if least is None:
        return df
    least = least["_size"]
    hashed = marked.where(F.col("_size") < least).withColumn("_h", F.xxhash64(F.lit(seed), F.lit(round_), row))
    rest = numbered(hashed, ["_h", row]).where(F.col("_n") < m).drop("_n", "_h")
    drawn = rest.count()
    scale = (n - k) / drawn if drawn else 1.0
    scaled = rest.withColumns({g: F.col(g) * scale, h: F.col(h) * scale})
    return marked.where(F.col("_size") >= least).unionByName(scaled).drop("_size")


def columns(of: Sequence[int], share: float, *seed: int) -> list[int]:
    """ceil(share * n) of the columns, at least one, in order."""
    if share >= 1 or not of:
        return list(of)
    k = max(1, int(np.ceil(share * len(of))))
    return sorted(Random(repr(seed)).sample(list(of), k))

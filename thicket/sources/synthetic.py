"""Generated tables in the JVM, the same for every partitioning."""

from __future__ import annotations

from random import Random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, stream: int, low: float = -1.0, high: float = 1.0) -> Column:
    """Uniform by row id, from the top 52 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), F.col("_row")), 12)
    return low + (high - low) * bits.cast("double") / float(2**52)


def _scored(spark: SparkSession, n: int, f: int, seed: int, outputs: int, noise: float) -> tuple[DataFrame, list[str]]:
    r = Random(seed)
    rows = spark.range(n).select(F.col("id").alias("_row")).withColumns({f"f{i}": uniform(seed, i) for i in range(f)})
    names = []
    for k in range(outputs):
        total = F.lit(r.uniform(-0.25, 0.25))
        for i in range(f):
            total = total + r.uniform(-1, 1) * F.col(f"f{i}")
        names.append(f"_s{k}")
        rows = rows.withColumn(names[-1], total + (uniform(seed, 10_000 + k, -noise, noise) if noise else F.lit(0.0)))
    return rows, names


def regression(spark: SparkSession, n: int, f: int, seed: int = 42, noise: float = 0.05) -> DataFrame:
    """_row, f0 .. and y: a weighted sum of uniform features, a bias and uniform noise."""
    rows, names = _scored(spark, n, f, seed, 1, noise)
    return rows.withColumnRenamed(names[0], "y")


def binary(spark: SparkSession, n: int, f: int, seed: int = 42, noise: float = 0.05) -> DataFrame:
    rows, names = _scored(spark, n, f, seed, 1, noise)
    return rows.withColumn("y", F.when(F.col(names[0]) > 0, 1.0).otherwise(0.0)).drop(*names)


def multiclass(spark: SparkSession, n: int, f: int, classes: int, seed: int = 42, noise: float = 0.05) -> DataFrame:
    """y is the class of the greatest of one score a class."""
    rows, names = _scored(spark, n, f, seed, classes, noise)
    scores = F.array(*names)
    return rows.withColumn("y", (F.array_position(scores, F.array_max(scores)) - 1).cast("double")).drop(*names)

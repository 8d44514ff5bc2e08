"""Places of rows in an order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.session import materialised


def numbered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df with _n: the place of each row in the order, from 0. Ranges and their counts, so no task sees all rows; the ranges are written, as their bounds must not be drawn anew."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    ranged = materialised(ranged)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("c")).collect()
    before, total = {}, 0
    for p, c in sorted(counts):
        before[p], total = total, total + c
    offset = F.try_element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_p")) if before else F.lit(0)
    return ranged.withColumn("_n", offset + F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1).drop("_p")

"""Models on streams: scoring adds columns in a narrow step, and a metric keeps running sums by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators.model import GBDTModel


def scored(stream: DataFrame, model: GBDTModel) -> DataFrame:
    """The stream with raw and prediction; without state, so any output mode will do."""
    return model.transform(stream)


def windowed_error(stream: DataFrame, model: GBDTModel, ts: str, y: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, n, rmse, mae) of each window of event time; rows later than the watermark are left out."""
    p = F.col("prediction")[0]
    rows = scored(stream.withWatermark(ts, late), model)
    return rows.groupBy(F.window(ts, length)).agg(F.count("*").alias("n"), F.sqrt(F.avg((p - F.col(y)) * (p - F.col(y)))).alias("rmse"), F.avg(F.abs(p - F.col(y))).alias("mae"))

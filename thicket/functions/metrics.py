"""Weighted metrics as aggregate expressions; AUC and quantile scores as window queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.session import materialised

#: fixed values that results must share
PROB_CLIP, MAPE_FLOOR, RATE_CLIP, TIE = 1e-15, 1e-15, 1e-9, 1e-10


def ratio(top: Column, w: Column) -> Column:
    """sum(w * top) / sum(w); 0 for no rows or no weight."""
    return F.when(F.sum(w) > 0, F.sum(w * top) / F.sum(w)).otherwise(F.lit(0.0))


def mean_of(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0]) / len(parts)


def rmse(ps: Sequence[Column], y: Column, w: Column) -> Column:
    """The root for each output, then their mean."""
    return mean_of([F.sqrt(ratio((p - y) * (p - y), w)) for p in ps])


def mae(ps: Sequence[Column], y: Column, w: Column) -> Column:
    return mean_of([ratio(F.abs(p - y), w) for p in ps])


def mape(ps: Sequence[Column], y: Column, w: Column) -> Column:
    return 100 * ratio(F.abs(ps[0] - y) / F.greatest(F.abs(y), F.lit(MAPE_FLOOR)), w)


def pinball(ps: Sequence[Column], y: Column, w: Column, alphas: Sequence[float]) -> Column:
    parts = [ratio(F.when(y >= p, a * (y - p)).otherwise((1 - a) * (p - y)), w) for p, a in zip(ps, alphas, strict=True)]
    return mean_of(parts)


def poisson(ps: Sequence[Column], y: Column, w: Column) -> Column:
    mu = F.greatest(ps[0], F.lit(RATE_CLIP))
    return ratio(F.when(y <= RATE_CLIP, 2 * mu).otherwise(2 * (y * F.log(y / mu) - (y - mu))), w)


def huber(ps: Sequence[Column], y: Column, w: Column, delta: float = 1.0) -> Column:
    r = F.abs(ps[0] - y)
    return ratio(F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta)), w)


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(PROB_CLIP), F.least(F.lit(1 - PROB_CLIP), p))


def logloss(ps: Sequence[Column], y: Column, w: Column) -> Column:
    p = clipped(ps[0])
    return ratio(-(y * F.log(p) + (1 - y) * F.log(1 - p)), w)


def accuracy(ps: Sequence[Column], y: Column, w: Column, threshold: float = 0.5) -> Column:
    hit = F.abs(F.when(ps[0] >= threshold, 1.0).otherwise(0.0) - y) < 0.5
    return ratio(F.when(hit, 1.0).otherwise(0.0), w)


def margin_accuracy(ps: Sequence[Column], y: Column, w: Column) -> Column:
    return accuracy(ps, y, w, 0.0)


def mlogloss(ps: Sequence[Column], y: Column, w: Column) -> Column:
    own = F.element_at(F.array(*ps), F.round(y).cast("int") + 1)
    return ratio(-F.log(clipped(own)), w)


def argmax_last(ps: Sequence[Column]) -> Column:
    """The class of the greatest value; of equal ones the last."""
    top = F.greatest(*ps) if len(ps) > 1 else ps[0]
    out = F.lit(0)
    for c, p in enumerate(ps):
        out = F.when(p == top, c).otherwise(out)
    return out


def multiclass_accuracy(ps: Sequence[Column], y: Column, w: Column) -> Column:
    """Named merror among the metrics, though more is better. A single output is itself a class number."""
    said = F.round(ps[0]).cast("int") if len(ps) == 1 else argmax_last(ps)
    return ratio(F.when(said == F.round(y).cast("int"), 1.0).otherwise(0.0), w)


def auc(df: DataFrame, p: str, y: str, w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Weighted area under the ROC curve, one row for each group of `by`: pairs of equal score count half; 0.5 for one class.

    Scores within a tie of 1e-10 are one. Rows are first summed by score, partitions of scores by range then run their own
    window, and sums of whole partitions come from a small table: no task holds all rows.
    """
    weight = F.col(w) if w else F.lit(1.0)
    scored = df.select(*by, F.round(F.col(p) / TIE).alias("_s"), F.when(F.col(y) > 0.5, weight).otherwise(0.0).alias("_pos"), F.when(F.col(y) > 0.5, 0.0).otherwise(weight).alias("_neg"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = scored.groupBy(*by, "_s").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")).repartitionByRange(parts, *by, "_s").withColumn("_p", F.spark_partition_id())
    # written once: each use of a range partitioning would sample bounds of its own
    ties = materialised(ties)
    sums = ties.groupBy(*by, "_p").agg(F.sum("_neg").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy(*by, "_p").orderBy("_s")
    ranked = ties.withColumn("_cum", F.sum("_neg").over(inside) - F.col("_neg")).join(before, [*by, "_p"])
    area = F.sum(F.col("_pos") * (F.col("_before") + F.col("_cum") + 0.5 * F.col("_neg")))
    total = F.sum("_pos") * F.sum("_neg")
    return ranked.groupBy(*by).agg(F.when(total > 0, area / total).otherwise(F.lit(0.5)).alias("auc"))


@dataclass(frozen=True)
class Metric:
    """name; which predictions it reads ('margin', 'value', 'probability'); its direction; expr(predictions, y, w), or none for AUC."""

    name: str
    kind: str
    higher_is_better: bool
    expr: Callable[[Sequence[Column], Column, Column], Column] | None = field(default=None, compare=False, repr=False)

    def evaluate(self, df: DataFrame, predictions: Sequence[str], y: str, w: str | None = None) -> float:
        if self.expr is None:
            rows = auc(df, predictions[0], y, w).collect()
            return float(rows[0][0]) if rows and rows[0][0] is not None else 0.5
        got = df.agg(self.expr([F.col(p) for p in predictions], F.col(y), F.col(w) if w else F.lit(1.0))).first()[0]
        return float(got) if got is not None else 0.0


def get(name: str, alphas: Sequence[float] = (0.5,), delta: float = 1.0, threshold: float = 0.5) -> Metric:
    known = {
        "rmse": Metric("rmse", "value", False, rmse), "mae": Metric("mae", "value", False, mae), "mape": Metric("mape", "value", False, mape),
        "quantile": Metric("quantile", "value", False, lambda ps, y, w: pinball(ps, y, w, alphas)), "poisson": Metric("poisson", "value", False, poisson),
        "huber": Metric("huber", "value", False, lambda ps, y, w: huber(ps, y, w, delta)), "logloss": Metric("logloss", "probability", False, logloss),
        "accuracy": Metric("accuracy", "probability", True, lambda ps, y, w: accuracy(ps, y, w, threshold)), "margin_accuracy": Metric("margin_accuracy", "margin", True, margin_accuracy),
        "auc": Metric("auc", "probability", True), "mlogloss": Metric("mlogloss", "probability", False, mlogloss), "merror": Metric("merror", "probability", True, multiclass_accuracy),
    }
    if name not in known:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(known)}")
    return known[name]


def custom(name: str, expr: Callable, kind: str = "value", higher_is_better: bool = False) -> Metric:
    """expr(predictions, y, w) returns an aggregate Column."""
    return Metric(name, kind, higher_is_better, expr)

"""Gradient histograms and split scans as queries. The training loop builds the same histograms in Arrow batches (plans/gbdt.py)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.split import SplitParams


def build(df: DataFrame, bins: Sequence[str], g: str = "g", h: str = "h", node: str | None = None) -> DataFrame:
    """(node, feature, bin, sg, sh, n): sums by node, feature number and bin. One shuffle, combined on the map side."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(b).cast("int").alias("bin")) for i, b in enumerate(bins)])).alias("e")
    rows = df.select((F.col(node) if node else F.lit(0)).alias("node"), F.col(g).alias("g"), F.col(h).alias("h"), each)
    return rows.groupBy("node", "e.feature", "e.bin").agg(F.sum("g").alias("sg"), F.sum("h").alias("sh"), F.count("*").alias("n"))


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The sibling's histogram: parent less child, by feature and bin; bins left without rows go."""
    keys = ["feature", "bin"]
    both = parent.drop("node").join(child.drop("node").withColumnsRenamed({"sg": "cg", "sh": "ch", "n": "cn"}), keys, "left")
    out = both.select(*keys, *[(F.col(a) - F.coalesce(b, F.lit(0))).alias(a) for a, b in (("sg", "cg"), ("sh", "ch"), ("n", "cn"))])
    return out.where("n > 0")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of two histograms."""
    return a.unionByName(b).groupBy("node", "feature", "bin").agg(F.sum("sg").alias("sg"), F.sum("sh").alias("sh"), F.sum("n").alias("n"))


def totals(hist: DataFrame) -> DataFrame:
    """(node, g, h, rows) by node, from one feature's bins."""
    first = hist.groupBy("node").agg(F.min("feature").alias("feature"))
    return hist.join(first, ["node", "feature"]).groupBy("node").agg(F.sum("sg").alias("g"), F.sum("sh").alias("h"), F.sum("n").alias("rows"))


def score(g: Column, h: Column, l2: float) -> Column:
    return F.when(h + l2 > 0, g * g / (h + l2)).otherwise(F.lit(0.0))


def _gain(gl: Column, hl: Column, nl: Column, p: SplitParams) -> Column:
    gr, hr, nr = F.col("tg") - gl, F.col("th") - hl, F.col("tn") - nl
    raw = 0.5 * (score(gl, hl, p.l2) + score(gr, hr, p.l2) - score(F.col("tg"), F.col("th"), p.l2)) - p.min_gain
    fine = (hl >= p.min_child_weight) & (hr >= p.min_child_weight) & (nl >= p.min_samples_leaf) & (nr >= p.min_samples_leaf)
    return F.when(fine, raw)


def _with_totals(hist: DataFrame) -> DataFrame:
    w = Window.partitionBy("node", "feature")
    return hist.withColumns({"tg": F.sum("sg").over(w), "th": F.sum("sh").over(w), "tn": F.sum("n").over(w)})


def forward_gains(hist: DataFrame, last_bin: int, p: SplitParams) -> DataFrame:
    """(node, feature, bin, gain): bins up to `bin` go left, from prefix sums. The last bin is no candidate."""
    w = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = _with_totals(hist).withColumns({"gl": F.sum("sg").over(w), "hl": F.sum("sh").over(w), "nl": F.sum("n").over(w)})
    return scanned.where(F.col("bin") < last_bin).select("node", "feature", "bin", _gain(F.col("gl"), F.col("hl"), F.col("nl"), p).alias("gain"), F.lit(False).alias("default_left"))


def backward_gains(hist: DataFrame, missing_bin: int, p: SplitParams) -> DataFrame:
    """The same with the missing bin on the left: suffix sums over the other bins; the split is at the bin before the suffix."""
    w = Window.partitionBy("node", "feature").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = _with_totals(hist).where(F.col("bin") < missing_bin).withColumns({"gr": F.sum("sg").over(w), "hr": F.sum("sh").over(w), "nr": F.sum("n").over(w)})
    gain = _gain(F.col("tg") - F.col("gr"), F.col("th") - F.col("hr"), F.col("tn") - F.col("nr"), p)
    return scanned.where("bin > 0").select("node", "feature", (F.col("bin") - 1).alias("bin"), gain.alias("gain"), F.lit(True).alias("default_left"))


def onehot_gains(hist: DataFrame, p: SplitParams) -> DataFrame:
    """(node, feature, bin, gain): one category against the rest."""
    return _with_totals(hist).select("node", "feature", "bin", _gain(F.col("sg"), F.col("sh"), F.col("n"), p).alias("gain"))


def sorted_gains(hist: DataFrame, p: SplitParams) -> DataFrame:
    """(node, feature, k, gain, left_cats): the k categories of the least -g / (h + 1e-6) go left."""
    w = Window.partitionBy("node", "feature").orderBy(-F.col("sg") / (F.col("sh") + 1e-6), "bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = _with_totals(hist).where("sh > 1e-10").withColumns({"gl": F.sum("sg").over(w), "hl": F.sum("sh").over(w), "nl": F.sum("n").over(w), "k": F.count("*").over(w), "left_cats": F.sort_array(F.collect_list("bin").over(w))})
    kept = kept.withColumn("m", F.count("*").over(Window.partitionBy("node", "feature")))
    return kept.where("k < m").select("node", "feature", "k", _gain(F.col("gl"), F.col("hl"), F.col("nl"), p).alias("gain"), "left_cats")


def best(candidates: DataFrame) -> DataFrame:
    """One candidate a node: the greatest gain, then the lowest feature, forward first, then the lowest bin."""
    order = Window.partitionBy("node").orderBy(F.desc("gain"), "feature", "default_left", "bin")
    return candidates.where("gain IS NOT NULL").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def leaf_value(g: Column, h: Column, p: SplitParams) -> Column:
    return F.when(h + p.l2 > 0, -F.signum(g) * F.greatest(F.abs(g) - p.l1, F.lit(0.0)) / (h + p.l2)).otherwise(F.lit(0.0))

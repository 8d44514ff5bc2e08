"""Queries over the driver's tables, one or more for each operator, and the same in ANSI SQL.

Floating results are rounded on both sides, to six digits or, for sums of many rows, to fewer.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import metrics as M
from thicket.functions import objectives as O
from thicket.operators import binning, explain, histogram, sampling
from thicket.operators.forest import Forest, Tree
from thicket.operators.model import GBDTModel
from thicket.operators.split import SplitParams
from thicket.plans import evaluate as E
from thicket.plans import gblinear
from thicket.sources import persist
from thicket.sources.dataset import Dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column, name: str) -> Column:
    return F.round(c.cast("double"), 6).alias(name)


def rounded(x: float, digits: int = 6) -> float:
    """As SQL rounds doubles: halves of the scaled value away from 0. round() decides them by digits beyond, which a midpoint of two values may have or not."""
    return math.copysign(math.floor(abs(x) * 10**digits + 0.5), x) / 10**digits


# Rows with a target, features (one of them missing at times), a weight and margins

ROWS_SQL = """rows AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice / 10000 AS y, l_quantity AS q, CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END AS disc, l_tax AS tax,
  l_returnflag AS flag, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS yb, CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END AS yc, (l_quantity + 1) / 25 AS w, l_tax * 20 - l_discount * 10 AS m, l_discount * 8 - 0.4 AS m2, l_tax - 0.03 AS m3 FROM lineitem)"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    t, c = read(spark, d, "lineitem"), F.col
    return t.select(
        c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), (c("l_extendedprice") / 10000).alias("y"), c("l_quantity").alias("q"), F.when(c("l_linenumber") % 5 != 0, c("l_discount")).alias("disc"), c("l_tax").alias("tax"),
        c("l_returnflag").alias("flag"), F.when(c("l_returnflag") == "R", 1.0).otherwise(0.0).alias("yb"), F.when(c("l_returnflag") == "A", 0.0).when(c("l_returnflag") == "N", 1.0).otherwise(2.0).alias("yc"),
        ((c("l_quantity") + 1) / 25).alias("w"), (c("l_tax") * 20 - c("l_discount") * 10).alias("m"), (c("l_discount") * 8 - 0.4).alias("m2"), (c("l_tax") - 0.03).alias("m3"),
    )


def dataset(spark: SparkSession, d: str) -> Dataset:
    return Dataset.from_dataframe(rows(spark, d), ["q", "disc", "tax", "flag"], "y", "w", row=F.col("k") * 8 + F.col("n"))


# Losses

SIG = "(1 / (1 + exp(-({0}))))"
GRADIENTS = {
    "squared": (O.squared(), "y", [("w * (m - y)", "w")]),
    "absolute": (O.absolute(), "y", [("CASE WHEN m - y >= 0 THEN w ELSE -w END", "w")]),
    "quantile": (O.quantile((0.2, 0.8)), "y", [("CASE WHEN m < y THEN -0.2 * w ELSE 0.8 * w END", "w"), ("CASE WHEN m2 < y THEN -0.8 * w ELSE (1 - 0.8) * w END", "w")]),
    "pseudo_huber": (O.pseudo_huber(1.5), "y", [("w * (m - y) / sqrt(1 + (m - y) * (m - y) / 2.25)", "w / ((1 + (m - y) * (m - y) / 2.25) * sqrt(1 + (m - y) * (m - y) / 2.25))")]),
    "poisson": (O.poisson(), "y", [("w * (exp(m) - y)", "greatest(w * exp(m), 1e-6)")]),
    "logistic": (O.logistic(), "yb", [(f"w * ({SIG.format('m')} - yb)", f"greatest(w * {SIG.format('m')} * (1 - {SIG.format('m')}), 1e-6)")]),
    "hinge": (O.hinge(), "yb", [("CASE WHEN yb > 0.5 THEN CASE WHEN m < 1 THEN -w ELSE 0 END ELSE CASE WHEN -m < 1 THEN w ELSE 0 END END", "w")]),
    "softmax": (O.softmax_loss(3), "yc", [(f"w * (exp({m}) / (exp(m) + exp(m2) + exp(m3)) - CASE WHEN yc = {c} THEN 1 ELSE 0 END)", f"greatest(w * (exp({m}) / (exp(m) + exp(m2) + exp(m3))) * (1 - exp({m}) / (exp(m) + exp(m2) + exp(m3))), 1e-6)") for c, m in enumerate(("m", "m2", "m3"))]),
}


def _gradient_query(name: str) -> None:
    objective, target, parts = GRADIENTS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        made = objective.gradients([F.col(x) for x in ("m", "m2", "m3")[: objective.n_outputs]], F.col(target), F.col("w"))
        return rows(spark, d).select("k", "n", *[r6(c, f"{kind}{i}") for i, gh in enumerate(made) for kind, c in zip("gh", gh, strict=True)])

    run.__name__ = f"gradients_{name}"
    columns = ", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {kind}{i}" for i, gh in enumerate(parts) for kind, sql in zip("gh", gh, strict=True))
    query(f"WITH {ROWS_SQL} SELECT k, n, {columns} FROM rows")(run)


for _name in GRADIENTS:
    _gradient_query(_name)


@query(f"""WITH {ROWS_SQL}, mean AS (SELECT sum(w * y) / sum(w) AS m, sum(w * yb) / sum(w) AS b, sum(w * CASE WHEN yc = 0 THEN 1 ELSE 0 END) / sum(w) AS c0, sum(w * CASE WHEN yc = 1 THEN 1 ELSE 0 END) / sum(w) AS c1, sum(w * CASE WHEN yc = 2 THEN 1 ELSE 0 END) / sum(w) AS c2 FROM rows),
cum AS (SELECT y, sum(sw) OVER (ORDER BY y) AS c, sum(sw) OVER () AS t FROM (SELECT y, sum(w) AS sw FROM rows GROUP BY y)),
q AS (SELECT a, min(y) AS v FROM cum, (VALUES (0.2), (0.5), (0.8)) v(a) WHERE c >= a * t GROUP BY a)
SELECT * FROM (SELECT 'squared' AS loss, 0 AS output, round(m, 6) AS base FROM mean UNION ALL SELECT 'poisson', 0, round(ln(greatest(m, 1e-7)), 6) FROM mean UNION ALL SELECT 'logistic', 0, round(ln(b / (1 - b)), 6) FROM mean UNION ALL SELECT 'hinge', 0, 0.0
UNION ALL SELECT 'absolute', 0, round(v, 6) FROM q WHERE a = 0.5 UNION ALL SELECT 'pseudo_huber', 0, round(v, 6) FROM q WHERE a = 0.5 UNION ALL SELECT 'quantile', 0, round(v, 6) FROM q WHERE a = 0.2 UNION ALL SELECT 'quantile', 1, round(v, 6) FROM q WHERE a = 0.8
UNION ALL SELECT 'softmax', 0, round(ln(c0), 6) FROM mean UNION ALL SELECT 'softmax', 1, round(ln(c1), 6) FROM mean UNION ALL SELECT 'softmax', 2, round(ln(c2), 6) FROM mean)""")
def base_scores(spark: SparkSession, d: str) -> DataFrame:
    t = rows(spark, d)
    out = [(name, i, round(b, 6)) for name, (o, target, _) in GRADIENTS.items() for i, b in enumerate(o.base(t, target, "w"))]
    return spark.createDataFrame(out, "loss string, output int, base double")


@query(f"""WITH {ROWS_SQL} SELECT k, n, round(1 / (1 + exp(-m)), 6) AS sigmoid, round(exp(m) / (exp(m) + exp(m2) + exp(m3)), 6) AS softmax0, round(exp(m2) / (exp(m) + exp(m2) + exp(m3)), 6) AS softmax1, round(exp(m3) / (exp(m) + exp(m2) + exp(m3)), 6) AS softmax2 FROM rows""")
def transforms(spark: SparkSession, d: str) -> DataFrame:
    s = O.softmax([F.col(c) for c in ("m", "m2", "m3")])
    return rows(spark, d).select("k", "n", r6(O.sigmoid(F.col("m")), "sigmoid"), *[r6(c, f"softmax{i}") for i, c in enumerate(s)])


# Metrics

P = SIG.format("m")
SM = [f"exp({m}) / (exp(m) + exp(m2) + exp(m3))" for m in ("m", "m2", "m3")]


@query(f"""WITH {ROWS_SQL} SELECT round((sqrt(sum(w * (m - y) * (m - y)) / sum(w)) + sqrt(sum(w * (m2 - y) * (m2 - y)) / sum(w))) / 2, 6) AS rmse, round((sum(w * abs(m - y)) + sum(w * abs(m2 - y))) / sum(w) / 2, 6) AS mae, round(100 * sum(w * abs(m - y) / greatest(abs(y), 1e-15)) / sum(w), 6) AS mape,
round((sum(w * CASE WHEN y >= m THEN 0.2 * (y - m) ELSE 0.8 * (m - y) END) + sum(w * CASE WHEN y >= m2 THEN 0.8 * (y - m2) ELSE (1 - 0.8) * (m2 - y) END)) / sum(w) / 2, 6) AS quantile,
round(sum(w * CASE WHEN y <= 1e-9 THEN 2 * greatest(exp(m), 1e-9) ELSE 2 * (y * ln(y / greatest(exp(m), 1e-9)) - (y - greatest(exp(m), 1e-9))) END) / sum(w), 6) AS poisson, round(sum(w * CASE WHEN abs(m - y) <= 1.5 THEN 0.5 * (m - y) * (m - y) ELSE 1.5 * (abs(m - y) - 0.75) END) / sum(w), 6) AS huber FROM rows""")
def metrics_regression(spark: SparkSession, d: str) -> DataFrame:
    y, w, ps = F.col("y"), F.col("w"), [F.col("m"), F.col("m2")]
    return rows(spark, d).agg(r6(M.rmse(ps, y, w), "rmse"), r6(M.mae(ps, y, w), "mae"), r6(M.mape(ps, y, w), "mape"), r6(M.pinball(ps, y, w, (0.2, 0.8)), "quantile"), r6(M.poisson([F.exp("m")], y, w), "poisson"), r6(M.huber(ps, y, w, 1.5), "huber"))


@query(f"""WITH {ROWS_SQL} SELECT round(-sum(w * (yb * ln({P}) + (1 - yb) * ln(1 - {P}))) / sum(w), 6) AS logloss, round(sum(CASE WHEN (CASE WHEN {P} >= 0.5 THEN 1 ELSE 0 END) = yb THEN w ELSE 0 END) / sum(w), 6) AS accuracy, round(sum(CASE WHEN (CASE WHEN m >= 0 THEN 1 ELSE 0 END) = yb THEN w ELSE 0 END) / sum(w), 6) AS margin_accuracy,
round(-sum(w * ln(CASE yc WHEN 0 THEN {SM[0]} WHEN 1 THEN {SM[1]} ELSE {SM[2]} END)) / sum(w), 6) AS mlogloss, round(sum(CASE WHEN (CASE WHEN m3 >= m2 AND m3 >= m THEN 2 WHEN m2 >= m THEN 1 ELSE 0 END) = yc THEN w ELSE 0 END) / sum(w), 6) AS merror FROM rows""")
def metrics_classification(spark: SparkSession, d: str) -> DataFrame:
    p, w, ms = O.sigmoid(F.col("m")), F.col("w"), [F.col(c) for c in ("m", "m2", "m3")]
    return rows(spark, d).agg(
        r6(M.logloss([p], F.col("yb"), w), "logloss"), r6(M.accuracy([p], F.col("yb"), w), "accuracy"), r6(M.margin_accuracy([F.col("m")], F.col("yb"), w), "margin_accuracy"),
        r6(M.mlogloss(O.softmax(ms), F.col("yc"), w), "mlogloss"), r6(M.multiclass_accuracy(ms, F.col("yc"), w), "merror"),
    )


@query(f"""WITH {ROWS_SQL}, s AS (SELECT n, round(m / 1e-10) AS s, sum(yb * w) AS pos, sum((1 - yb) * w) AS neg FROM rows GROUP BY n, round(m / 1e-10)), c AS (SELECT n, pos, neg, sum(neg) OVER (PARTITION BY n ORDER BY s) - neg AS below FROM s)
SELECT n, round(CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) ELSE 0.5 END, 6) AS auc FROM c GROUP BY n""")
def metric_auc_weighted(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(rows(spark, d), "m", "yb", "w", by=["n"]).select("n", r6(F.col("auc"), "auc"))


@query(f"""WITH {ROWS_SQL}, r AS (SELECT yb, avg(rn) OVER (PARTITION BY s) AS rank FROM (SELECT yb, round(m / 1e-10) AS s, row_number() OVER (ORDER BY round(m / 1e-10)) AS rn FROM rows))
SELECT round((sum(CASE WHEN yb = 1 THEN rank END) - sum(yb) * (sum(yb) + 1) / 2) / (sum(yb) * sum(1 - yb)), 6) AS auc FROM r""")
def metric_auc(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(rows(spark, d), "m", "yb").select(r6(F.col("auc"), "auc"))


# Binning


@query(f"""WITH {ROWS_SQL}, f AS (SELECT 'q' AS feature, q AS v FROM rows UNION ALL SELECT 'disc', disc FROM rows UNION ALL SELECT 'tax', tax FROM rows)
SELECT feature, count(*) AS n, count(v) AS n_valid, count(*) - count(v) AS n_missing, count(CASE WHEN v <> 0 THEN 1 END) AS n_nonzero, count(DISTINCT v) AS n_unique, min(v) AS low, max(v) AS high, bool_and(v = floor(v)) AS all_integer FROM f GROUP BY feature""")
def feature_analysis(spark: SparkSession, d: str) -> DataFrame:
    ds = Dataset.from_dataframe(rows(spark, d), ["q", "disc", "tax"])
    got = [(a.feature, a.n, a.n_valid, a.n_missing, a.n_nonzero, a.n_unique, a.low, a.high, a.all_integer) for a in binning.analyse(ds)]
    return spark.createDataFrame(got, "feature string, n long, n_valid long, n_missing long, n_nonzero long, n_unique long, low double, high double, all_integer boolean")


@query("""WITH v AS (SELECT DISTINCT c_acctbal AS v FROM customer), r AS (SELECT v, lead(v) OVER (ORDER BY v) AS f, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM v),
w AS (SELECT DISTINCT least(CAST(floor(i / 64.0 * (n - 1)) AS BIGINT), n - 2) AS k FROM (SELECT max(n) AS n FROM r), range(1, 64) t(i))
SELECT round((v + f) / 2, 6) AS bound FROM r JOIN w USING (k)""")
def bin_bounds(spark: SparkSession, d: str) -> DataFrame:
    ds = Dataset.from_dataframe(read(spark, d, "customer"), ["c_acctbal"], row="c_custkey")
    (m,) = binning.fit(ds, binning.BinningConfig(max_bins=64))
    return spark.createDataFrame([(rounded(b),) for b in m.bounds[:-1]], "bound double")


@query(f"""WITH {ROWS_SQL}, b AS (SELECT k, n, disc, (SELECT count(*) FROM (SELECT DISTINCT disc AS x FROM rows WHERE disc IS NOT NULL) d) AS m, dense_rank() OVER (ORDER BY disc NULLS LAST) - 1 AS r FROM rows)
SELECT k, n, CASE WHEN disc IS NULL THEN m ELSE r END AS bin FROM b""")
def bin_apply(spark: SparkSession, d: str) -> DataFrame:
    ds = Dataset.from_dataframe(rows(spark, d), ["disc"], row=F.col("k") * 8 + F.col("n"))
    (m,) = binning.fit(ds)
    return rows(spark, d).select("k", "n", m.column(F.col("disc")).cast("long").alias("bin"))


@query("SELECT c_mktsegment AS category, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    ds = Dataset.from_dataframe(read(spark, d, "customer"), ["c_mktsegment"])
    return spark.createDataFrame([(v, i) for i, v in enumerate(ds.categories["c_mktsegment"])], "category string, code long")


ONE_HOT = [f"nat{i}" for i in range(25)]


def one_hot(spark: SparkSession, d: str) -> DataFrame:
    hot = [F.when((F.col("c_nationkey") == i) | ((F.col("c_custkey") % 40 == 0) & (F.col("c_nationkey") == (i + 1) % 25)), 1.0).otherwise(0.0).alias(f"nat{i}") for i in range(25)]
    return read(spark, d, "customer").select("c_custkey", *hot)


@query("""WITH h AS (SELECT c_custkey, i FROM customer, range(0, 25) t(i) WHERE c_nationkey = i OR (c_custkey % 40 = 0 AND c_nationkey = (i + 1) % 25))
SELECT 'nat' || a.i AS f1, 'nat' || b.i AS f2, count(*) AS n FROM h a JOIN h b ON a.c_custkey = b.c_custkey AND a.i < b.i GROUP BY 1, 2""")
def bundle_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return binning.conflicts(one_hot(spark, d), ONE_HOT)


@query("""SELECT c_custkey, 2 * first + 2 AS code FROM (SELECT c_custkey, min(i) AS first FROM customer, range(0, 25) t(i) WHERE c_nationkey = i OR (c_custkey % 40 = 0 AND c_nationkey = (i + 1) % 25) GROUP BY c_custkey)""")
def bundle_encode(spark: SparkSession, d: str) -> DataFrame:
    mappers = {f: binning.Mapper(f, True, (0.0, 1.0), False) for f in ONE_HOT}
    return one_hot(spark, d).select("c_custkey", binning.encode_bundle(ONE_HOT, mappers).cast("long").alias("code"))


# Histograms and splits: y against quantity (50 values), discount (11, at times missing) and the return flag

HIST_SQL = f"""{ROWS_SQL}, gh AS (SELECT CASE WHEN tax < 0.04 THEN 0 ELSE 1 END AS node, CAST(q AS INT) - 1 AS b0, CASE WHEN disc IS NULL THEN 11 ELSE CAST(round(disc * 100) AS INT) END AS b1, CAST(yc AS INT) AS b2, w * (5 - y) AS g, w AS h FROM rows),
hist AS (SELECT node, feature, bin, sum(g) AS sg, sum(h) AS sh, count(*) AS n FROM (SELECT node, 0 AS feature, b0 AS bin, g, h FROM gh UNION ALL SELECT node, 1, b1, g, h FROM gh UNION ALL SELECT node, 2, b2, g, h FROM gh) GROUP BY node, feature, bin),
tot AS (SELECT *, sum(sg) OVER p AS tg, sum(sh) OVER p AS th, sum(n) OVER p AS tn FROM hist WINDOW p AS (PARTITION BY node, feature))"""
GAIN_SQL = "round(CASE WHEN hl >= 1 AND th - hl >= 1 AND nl >= 5 AND tn - nl >= 5 THEN 0.5 * (gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1)) END, 4)"
SPLIT = SplitParams(min_samples_leaf=5)


def binned(spark: SparkSession, d: str) -> DataFrame:
    b1 = F.when(F.col("disc").isNull(), 11).otherwise(F.round(F.col("disc") * 100).cast("int"))
    return rows(spark, d).select(F.when(F.col("tax") < 0.04, 0).otherwise(1).alias("node"), (F.col("q").cast("int") - 1).alias("b0"), b1.alias("b1"), F.col("yc").cast("int").alias("b2"), (F.col("w") * (5 - F.col("y"))).alias("g"), F.col("w").alias("h"))


def hist(spark: SparkSession, d: str) -> DataFrame:
    return histogram.build(binned(spark, d), ["b0", "b1", "b2"], node="node")


def r4_all(df: DataFrame, *names: str) -> DataFrame:
    """Sums of many rows, which differ by the order of addition."""
    return df.withColumns({n: F.round(n, 4) for n in names})


@query(f"WITH {HIST_SQL} SELECT node, feature, bin, round(sg, 4) AS sg, round(sh, 4) AS sh, n FROM hist")
def histograms(spark: SparkSession, d: str) -> DataFrame:
    return r4_all(hist(spark, d), "sg", "sh")


@query(f"WITH {HIST_SQL} SELECT feature, bin, round(sum(sg), 4) AS sg, round(sum(sh), 4) AS sh, CAST(sum(n) AS BIGINT) AS n FROM hist WHERE node = 1 GROUP BY feature, bin")
def histogram_subtract(spark: SparkSession, d: str) -> DataFrame:
    whole = histogram.build(binned(spark, d), ["b0", "b1", "b2"])
    return r4_all(histogram.subtract(whole, hist(spark, d).where("node = 0")), "sg", "sh")


@query(f"WITH {HIST_SQL} SELECT node, feature, bin, round(2 * sg, 4) AS sg, round(2 * sh, 4) AS sh, 2 * n AS n FROM hist")
def histogram_merge(spark: SparkSession, d: str) -> DataFrame:
    h = hist(spark, d)
    return r4_all(histogram.merge(h, h), "sg", "sh")


@query(f"WITH {HIST_SQL} SELECT node, round(sum(g), 4) AS g, round(sum(h), 4) AS h, count(*) AS rows FROM gh GROUP BY node")
def node_totals(spark: SparkSession, d: str) -> DataFrame:
    return r4_all(histogram.totals(hist(spark, d)), "g", "h")


@query(f"WITH {HIST_SQL}, s AS (SELECT *, sum(sg) OVER p AS gl, sum(sh) OVER p AS hl, sum(n) OVER p AS nl FROM tot WHERE feature = 0 WINDOW p AS (PARTITION BY node ORDER BY bin)) SELECT node, feature, bin, {GAIN_SQL} AS gain, false AS default_left FROM s WHERE bin < 49")
def split_forward(spark: SparkSession, d: str) -> DataFrame:
    return r4_all(histogram.forward_gains(hist(spark, d).where("feature = 0"), 49, SPLIT), "gain")


@query(f"WITH {HIST_SQL}, s AS (SELECT *, tg - sum(sg) OVER p AS gl, th - sum(sh) OVER p AS hl, tn - sum(n) OVER p AS nl FROM tot WHERE feature = 1 AND bin < 11 WINDOW p AS (PARTITION BY node ORDER BY bin DESC)) SELECT node, feature, bin - 1 AS bin, {GAIN_SQL} AS gain, true AS default_left FROM s WHERE bin > 0")
def split_backward(spark: SparkSession, d: str) -> DataFrame:
    return r4_all(histogram.backward_gains(hist(spark, d).where("feature = 1"), 11, SPLIT), "gain")


@query(f"WITH {HIST_SQL}, s AS (SELECT *, sg AS gl, sh AS hl, n AS nl FROM tot WHERE feature = 2) SELECT node, feature, bin, {GAIN_SQL} AS gain FROM s")
def split_onehot(spark: SparkSession, d: str) -> DataFrame:
    return r4_all(histogram.onehot_gains(hist(spark, d).where("feature = 2"), SPLIT), "gain")


@query(f"""WITH {HIST_SQL}, s AS (SELECT *, sum(sg) OVER p AS gl, sum(sh) OVER p AS hl, sum(n) OVER p AS nl, count(*) OVER p AS k, count(*) OVER (PARTITION BY node) AS m, sum(CAST(power(2, bin) AS BIGINT)) OVER p AS left_bits FROM tot WHERE feature = 1 AND sh > 1e-10 WINDOW p AS (PARTITION BY node ORDER BY -sg / (sh + 1e-6), bin ROWS UNBOUNDED PRECEDING))
SELECT node, feature, k, {GAIN_SQL} AS gain, CAST(left_bits AS BIGINT) AS left_bits FROM s WHERE k < m""")
def split_sorted_categories(spark: SparkSession, d: str) -> DataFrame:
    got = r4_all(histogram.sorted_gains(hist(spark, d).where("feature = 1"), SPLIT), "gain")
    return got.withColumn("left_bits", F.aggregate("left_cats", F.lit(0).cast("long"), lambda a, b: a + F.pow(F.lit(2.0), b).cast("long"))).drop("left_cats")


@query(f"""WITH {HIST_SQL}, f AS (SELECT *, sum(sg) OVER p AS gl, sum(sh) OVER p AS hl, sum(n) OVER p AS nl FROM tot WHERE feature < 2 WINDOW p AS (PARTITION BY node, feature ORDER BY bin)), b AS (SELECT *, tg - sum(sg) OVER p AS gl, th - sum(sh) OVER p AS hl, tn - sum(n) OVER p AS nl FROM tot WHERE feature = 1 AND bin < 11 WINDOW p AS (PARTITION BY node ORDER BY bin DESC)),
c AS (SELECT node, feature, bin, {GAIN_SQL} AS gain, 0 AS dir FROM f WHERE bin < CASE feature WHEN 0 THEN 49 ELSE 11 END UNION ALL SELECT node, feature, bin - 1, {GAIN_SQL}, 1 FROM b WHERE bin > 0)
SELECT node, feature, bin, gain, dir = 1 AS default_left FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, dir, bin) AS r FROM c WHERE gain IS NOT NULL) WHERE r = 1""")
def best_splits(spark: SparkSession, d: str) -> DataFrame:
    h = hist(spark, d)
    all_ = histogram.forward_gains(h.where("feature = 0"), 49, SPLIT).unionByName(histogram.forward_gains(h.where("feature = 1"), 11, SPLIT)).unionByName(histogram.backward_gains(h.where("feature = 1"), 11, SPLIT))
    return histogram.best(r4_all(all_, "gain"))


@query(f"WITH {HIST_SQL} SELECT node, round(-sign(sum(g)) * greatest(abs(sum(g)) - 10, 0) / (sum(h) + 2), 4) AS value FROM gh GROUP BY node")
def leaf_values(spark: SparkSession, d: str) -> DataFrame:
    t = histogram.totals(hist(spark, d))
    return t.select("node", F.round(histogram.leaf_value(F.col("g"), F.col("h"), SplitParams(l1=10, l2=2)), 4).alias("value"))


@query(f"""WITH {ROWS_SQL}, base AS (SELECT sum(w * y) / sum(w) AS b FROM rows), cells AS (SELECT q, sum(w * (b - y)) AS g, sum(w) AS h, count(*) AS n FROM rows, base GROUP BY q), s AS (SELECT q, lead(q) OVER (ORDER BY q) AS nq, sum(g) OVER (ORDER BY q) AS gl, sum(h) OVER (ORDER BY q) AS hl, sum(n) OVER (ORDER BY q) AS nl, sum(g) OVER () AS tg, sum(h) OVER () AS th, sum(n) OVER () AS tn FROM cells),
best AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1)) AS gain FROM s WHERE nq IS NOT NULL AND hl >= 1 AND th - hl >= 1 ORDER BY gain DESC, q LIMIT 1)
SELECT k, n, round(b + 0.3 * CASE WHEN rows.q <= best.q THEN -gl / (hl + 1) ELSE -(tg - gl) / (th - hl + 1) END, 6) AS prediction FROM rows, base, best""")
def train_stump(spark: SparkSession, d: str) -> DataFrame:
    """One round of one split, trained by the engine's loop."""
    from thicket.plans.gbdt import GBDTConfig

    t = rows(spark, d)
    model = GBDTModel.train(Dataset.from_dataframe(t, ["q"], "y", "w", row=F.col("k") * 8 + F.col("n")), GBDTConfig(n_estimators=1, max_depth=1))
    return model.transform(t).select("k", "n", r6(F.col("prediction")[0], "prediction"))


@query()
def train_linear_leaves(spark: SparkSession, d: str) -> DataFrame:
    from thicket.operators.linear_leaf import LinearLeafConfig
    from thicket.plans.gbdt import GBDTConfig

    ds = Dataset.from_dataframe(rows(spark, d), ["q", "tax"], "y", row=F.col("k") * 8 + F.col("n"))
    return GBDTModel.train(ds, GBDTConfig(n_estimators=2, max_depth=2, linear_leaves=LinearLeafConfig())).table(spark)


# A fixed forest


def fixed_model() -> GBDTModel:
    """Two trees: numeric with a missing side, categorical, and a linear leaf."""
    a, b = Tree(), Tree()
    a.add(cover=100.0)
    left, right = a.split(0, 0, 25.5, False, gain=8.0, covers=(60.0, 40.0))
    a.value[left] = -0.5
    x, y = a.split(right, 1, 0.05, True, gain=3.0, covers=(15.0, 25.0))
    a.value[x], a.value[y] = 0.25, 1.5
    b.add(cover=100.0)
    left, right = b.split(0, 2, 0.0, False, gain=5.0, left_cats=(0, 2), covers=(70.0, 30.0))
    b.value[left], b.value[right] = 0.75, -0.25
    b.lin[right] = ([0, 1], [0.01, 2.0], -0.3)
    return GBDTModel(Forest([a, b], [1.0]), ("q", "disc", "flag"), categories={"flag": ("A", "N", "R")})


TREE_A = "CASE WHEN q < 25.5 THEN -0.5 WHEN disc IS NULL OR disc < 0.05 THEN 0.25 ELSE 1.5 END"
TREE_B = "CASE WHEN flag IN ('A', 'R') THEN 0.75 ELSE coalesce(-0.3 + 0.01 * q + 2 * disc, -0.25) END"


@query(f"WITH {ROWS_SQL} SELECT k, n, round(1 + {TREE_A} + {TREE_B}, 6) AS prediction FROM rows")
def predict_forest(spark: SparkSession, d: str) -> DataFrame:
    return fixed_model().transform(rows(spark, d)).select("k", "n", r6(F.col("prediction")[0], "prediction"))


@query(f"WITH {ROWS_SQL} SELECT k, n, round(1 + 0.5 * {TREE_A} + 0.25 * {TREE_B}, 6) AS prediction FROM rows")
def predict_weighted_trees(spark: SparkSession, d: str) -> DataFrame:
    return fixed_model().transform(rows(spark, d), tree_weights=[0.5, 0.25]).select("k", "n", r6(F.col("prediction")[0], "prediction"))


@query(f"WITH {ROWS_SQL} SELECT k, n, round(1 + {TREE_A} + {TREE_B}, 6) AS prediction FROM rows")
def predict_expression(spark: SparkSession, d: str) -> DataFrame:
    """The same forest as one SQL expression."""
    coded, _ = fixed_model().encoded(rows(spark, d))
    return coded.withColumn("flag", F.col("_code2")).select("k", "n", r6(fixed_model().expressions()[0], "prediction"))


# the first tree's expected values: of nothing, of q alone, of disc alone; covers are 60 and 40, 15 and 25
LATE = "(15 * 0.25 + 25 * 1.5) / 40"
DISC = "CASE WHEN disc IS NULL OR disc < 0.05 THEN 0.25 ELSE 1.5 END"
NOTHING, ONLY_Q, ONLY_DISC = f"(0.6 * -0.5 + 0.4 * {LATE})", f"CASE WHEN q < 25.5 THEN -0.5 ELSE {LATE} END", f"(0.6 * -0.5 + 0.4 * {DISC})"


@query(f"""WITH {ROWS_SQL} SELECT k, n, round((({ONLY_Q}) - {NOTHING} + ({TREE_A}) - {ONLY_DISC}) / 2, 6) AS q, round(({ONLY_DISC} - {NOTHING} + ({TREE_A}) - ({ONLY_Q})) / 2, 6) AS disc,
round(CASE WHEN flag IN ('A', 'R') THEN 0.75 ELSE -0.25 END - (0.7 * 0.75 + 0.3 * -0.25), 6) AS flag, round(1 + {NOTHING} + 0.7 * 0.75 + 0.3 * -0.25, 6) AS base FROM rows""")
def tree_shap(spark: SparkSession, d: str) -> DataFrame:
    """All Shapley values of a forest of two trees, one of them with two interacting features, against their definition."""
    m = fixed_model()
    m.forest.trees[1].lin = {}
    return m.shap(rows(spark, d)).select("k", "n", *[r6(F.col("shap")[0][i], c) for i, c in enumerate(("q", "disc", "flag", "base"))])


@query(f"WITH {ROWS_SQL} SELECT k, n, round(1 + ({TREE_A}) + CASE WHEN flag IN ('A', 'R') THEN 0.75 ELSE -0.25 END, 6) AS total FROM rows")
def tree_shap_sums(spark: SparkSession, d: str) -> DataFrame:
    """Values and base add up to the margin."""
    m = fixed_model()
    m.forest.trees[1].lin = {}
    return m.shap(rows(spark, d)).select("k", "n", r6(F.aggregate(F.col("shap")[0], F.lit(0.0), lambda a, b: a + b), "total"))


@query("""WITH e AS (SELECT DISTINCT n_nationkey AS tree_id, n_regionkey AS r FROM nation) SELECT CAST(tree_id AS INT) AS tree_id, 7 AS node_id, 'child out of range' AS problem FROM e WHERE r = 1 UNION ALL SELECT CAST(tree_id AS INT), 2, 'not reached' FROM e WHERE r = 1
UNION ALL SELECT CAST(tree_id AS INT), 2, 'not reached' FROM e WHERE r = 2 UNION ALL SELECT CAST(tree_id AS INT), 1, 'reached twice' FROM e WHERE r = 2 UNION ALL SELECT CAST(tree_id AS INT), 0, 'reached twice' FROM e WHERE r = 3 UNION ALL SELECT CAST(tree_id AS INT), 0, 'its own child' FROM e WHERE r = 3 UNION ALL SELECT CAST(tree_id AS INT), 2, 'not reached' FROM e WHERE r = 3""")
def validate_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One tree of three nodes for each nation, broken by its region: a child out of range, one child twice, a root that is its own child."""
    t = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("tree_id"), F.col("n_regionkey").alias("r")).distinct()
    right = F.when(F.col("r") == 1, 7).when(F.col("r") == 2, 1).when(F.col("r") == 3, 0).otherwise(2)
    node = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    nodes = t.select("tree_id", "r", node.alias("node_id"))
    root = F.col("node_id") == 0
    nodes = nodes.select("tree_id", "node_id", (~root).alias("is_leaf"), F.when(root, 1).alias("left_child"), F.when(root, right).alias("right_child"))
    return persist.invalid_nodes(nodes)


@query(f"WITH {ROWS_SQL} SELECT k, n, round(1 + {TREE_A} + {TREE_B}, 6) AS prediction FROM rows")
def persist_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The fixed forest after the binary and the JSON form."""
    m = persist.from_json_bytes(persist.to_json_bytes(persist.from_bytes(persist.to_bytes(fixed_model()))))
    return m.transform(rows(spark, d)).select("k", "n", r6(F.col("prediction")[0], "prediction"))


def xgboost_dump() -> dict:
    """TREE_A as the other library's JSON has it."""
    tree = {
        "tree_param": {"num_nodes": "5", "size_leaf_vector": "1"}, "left_children": [1, -1, 3, -1, -1], "right_children": [2, -1, 4, -1, -1], "split_indices": [0, 0, 1, 0, 0], "split_conditions": [25.5, -0.5, 0.045, 0.25, 1.5], "base_weights": [0.0, -0.5, 0.0, 0.25, 1.5],
        "default_left": [0, 0, 1, 0, 0], "loss_changes": [8.0, 0, 3.0, 0, 0], "sum_hessian": [100.0, 60.0, 40.0, 15.0, 25.0], "split_type": [0] * 5, "categories": [], "categories_nodes": [], "categories_segments": [], "categories_sizes": [],
    }
    return {"learner": {"feature_names": ["q", "disc"], "learner_model_param": {"base_score": "1", "num_class": "0", "num_feature": "2"}, "objective": {"name": "reg:squarederror"}, "gradient_booster": {"name": "gbtree", "model": {"trees": [tree], "tree_info": [0]}}}}


@query(f"WITH {ROWS_SQL} SELECT k, n, round(1 + {TREE_A}, 4) AS prediction FROM rows")
def convert_xgboost(spark: SparkSession, d: str) -> DataFrame:
    from thicket.sources import convert

    return convert.from_xgboost(xgboost_dump()).transform(rows(spark, d)).select("k", "n", F.round(F.col("prediction")[0], 4).alias("prediction"))


def lightgbm_dump() -> dict:
    """The same tree with its cuts on the left, as that library compares."""
    late = {"split_index": 1, "split_feature": 1, "threshold": 0.045, "decision_type": "<=", "default_left": True, "missing_type": "NaN", "split_gain": 3.0, "internal_weight": 40.0, "internal_count": 40, "left_child": {"leaf_index": 1, "leaf_value": 0.25, "leaf_weight": 15.0}, "right_child": {"leaf_index": 2, "leaf_value": 1.5, "leaf_weight": 25.0}}
    root = {"split_index": 0, "split_feature": 0, "threshold": 25.0, "decision_type": "<=", "default_left": False, "missing_type": "None", "split_gain": 8.0, "internal_weight": 100.0, "internal_count": 100, "left_child": {"leaf_index": 0, "leaf_value": -0.5, "leaf_weight": 60.0}, "right_child": late}
    return {"name": "tree", "num_class": 1, "num_tree_per_iteration": 1, "objective": "regression", "max_feature_idx": 1, "feature_names": ["q", "disc"], "tree_info": [{"tree_index": 0, "num_leaves": 3, "num_cat": 0, "shrinkage": 1, "tree_structure": root}]}


@query(f"WITH {ROWS_SQL} SELECT k, n, round({TREE_A}, 4) AS prediction FROM rows")
def convert_lightgbm(spark: SparkSession, d: str) -> DataFrame:
    from thicket.sources import convert

    return convert.from_lightgbm(lightgbm_dump()).transform(rows(spark, d)).select("k", "n", F.round(F.col("prediction")[0], 4).alias("prediction"))


# Linear booster


def linear_model() -> gblinear.GBLinearModel:
    return gblinear.GBLinearModel(("q", "disc", "tax"), np.array([[0.1], [-2.0], [3.5], [0.75]]), O.squared())


@query(f"WITH {ROWS_SQL} SELECT k, n, round(0.75 + 0.1 * q - 2 * coalesce(disc, 0) + 3.5 * tax, 6) AS prediction FROM rows")
def predict_linear(spark: SparkSession, d: str) -> DataFrame:
    return linear_model().transform(rows(spark, d)).select("k", "n", r6(F.col("prediction")[0], "prediction"))


@query(f"WITH {ROWS_SQL} SELECT k, n, round(0.1 * (q - 25), 6) AS q, round(-2 * (disc - 0.05), 6) AS disc, round(3.5 * tax, 6) AS tax, round(0.75 + 2.5 - 0.1, 6) AS base FROM rows")
def linear_shap(spark: SparkSession, d: str) -> DataFrame:
    s = linear_model().shap(rows(spark, d).select("k", "n", "q", "disc", "tax"), {"q": 25.0, "disc": 0.05}).withColumn("s", F.col("shap")[0])
    return s.select("k", "n", *[r6(F.col("s")[i], c) for i, c in enumerate(("q", "disc", "tax", "base"))])


@query(f"""WITH {ROWS_SQL}, z AS (SELECT q, coalesce(disc, 0) AS disc, w, w * (0.5 - y) AS g FROM rows) SELECT * FROM (SELECT 'G' AS what, round(sum(g), 2) AS v FROM z UNION ALL SELECT 'H', round(sum(w), 2) FROM z UNION ALL SELECT 'gx0', round(sum(g * q), 2) FROM z UNION ALL SELECT 'gx1', round(sum(g * disc), 2) FROM z
UNION ALL SELECT 'hx0', round(sum(w * q), 2) FROM z UNION ALL SELECT 'hx1', round(sum(w * disc), 2) FROM z UNION ALL SELECT 'hxx00', round(sum(w * q * q), 2) FROM z UNION ALL SELECT 'hxx01', round(sum(w * q * disc), 2) FROM z UNION ALL SELECT 'hxx11', round(sum(w * disc * disc), 2) FROM z)""")
def linear_sums(spark: SparkSession, d: str) -> DataFrame:
    ds = Dataset.from_dataframe(rows(spark, d), ["q", "disc"], "y", "w")
    (s,) = gblinear.sums_of(ds, np.array([[0.0], [0.0], [0.5]]), O.squared(), True)
    flat = [("G", s["G"]), ("H", s["H"]), *((f"gx{i}", s["gx"][i]) for i in (0, 1)), *((f"hx{i}", s["hx"][i]) for i in (0, 1)), *((f"hxx{i}{j}", s["hxx"][i, j]) for i, j in ((0, 0), (0, 1), (1, 1)))]
    return spark.createDataFrame([(k, round(float(v), 2)) for k, v in flat], "what string, v double")


@query(f"""WITH {ROWS_SQL}, base AS (SELECT sum(w * y) / sum(w) AS b, sum(w) AS h FROM rows), s AS (SELECT b, sum(w * (b - y)) AS g, sum(w * (b - y) * q) AS gq, sum(w * q * q) AS hq, sum(w * q) AS hx, max(h) AS h FROM rows, base GROUP BY b)
SELECT round(-0.5 * (gq + hx * (-g / h * 0.5)) / hq, 6) AS q, round(b - g / h * 0.5, 6) AS bias FROM s""")
def train_linear_round(spark: SparkSession, d: str) -> DataFrame:
    """One shotgun round on one feature: the bias step, then the coordinate's Newton step."""
    ds = Dataset.from_dataframe(rows(spark, d), ["q"], "y", "w")
    m = gblinear.train(ds, gblinear.GBLinearConfig(n_estimators=1))
    return spark.createDataFrame([(round(float(m.weights[0, 0]), 6), round(float(m.weights[1, 0]), 6))], "q double, bias double")


@query()
def train_linear_sequential(spark: SparkSession, d: str) -> DataFrame:
    ds = Dataset.from_dataframe(rows(spark, d), ["q", "disc", "tax"], "yb", "w")
    m = gblinear.train(ds, gblinear.GBLinearConfig(objective=O.logistic(), n_estimators=3, update_strategy="sequential", selector="greedy", l2=0.01))
    return spark.createDataFrame([(f, float(w)) for f, w in zip((*m.features, "bias"), m.weights[:, 0], strict=True)], "feature string, weight double")


# Sampling


@query("SELECT greatest(1, CAST(floor(count(*) * 0.3) AS BIGINT)) AS n FROM lineitem")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    t = rows(spark, d).withColumn("id", F.col("k") * 8 + F.col("n"))
    return sampling.uniform_rows(t, "id", 0.3, 42).agg(F.count("*").alias("n"))


@query(f"""WITH {ROWS_SQL}, s AS (SELECT abs(w * (5 - y) * w) AS m FROM rows), r AS (SELECT m, row_number() OVER (ORDER BY m DESC) AS i, count(*) OVER () AS n FROM s), t AS (SELECT max(n) AS n, min(m) AS least FROM r WHERE i <= floor(n * 0.2)) SELECT (SELECT count(*) FROM s, t WHERE m >= least) AS kept FROM t""")
def sample_goss(spark: SparkSession, d: str) -> DataFrame:
    """How many rows stay for their gradient; those drawn from the rest differ by their scaled hessian."""
    t = rows(spark, d).select((F.col("k") * 8 + F.col("n")).alias("id"), (F.col("w") * (5 - F.col("y"))).alias("g"), F.col("w").alias("h"), F.col("w").alias("own"))
    return sampling.goss(t, "id", "g", "h", 0.2, 0.1, 42).where("h = own").agg(F.count("*").alias("kept"))


# Evaluation


@query("""SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id""")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    return E.keep_last(read(spark, d, "events").select("user_id", "ts"), "user_id", "ts")


@query("""SELECT event_id, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST((hour(ts) * 60 + minute(ts)) // 15 AS INT) AS quarter_of_day FROM events""")
def date_features(spark: SparkSession, d: str) -> DataFrame:
    return E.with_dates(read(spark, d, "events"), "ts").select("event_id", "day_of_week", "quarter_of_day")


@query("""SELECT event_id, lag(value, 3) OVER p AS lag3, lag(value, 7) OVER p AS lag7 FROM events WINDOW p AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    return E.with_lags(read(spark, d, "events"), "value", ["ts", "event_id"], {"lag3": 3, "lag7": 7}, by=["event_type"]).select("event_id", "lag3", "lag7")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS ts, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT l.ts, round(l.v, 6) AS load, round(w.v, 6) AS weather, round(e.v, 6) AS price, round(p.v, 6) AS profile FROM (SELECT * FROM h WHERE event_type = 'view') l JOIN (SELECT * FROM h WHERE event_type = 'click') w USING (ts) LEFT JOIN (SELECT * FROM h WHERE event_type = 'purchase') e USING (ts) LEFT JOIN (SELECT * FROM h WHERE event_type = 'signup') p USING (ts)""")
def forecast_join(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("ts"), "event_type").agg(F.avg("value").alias("v"))
    of = lambda kind, name: h.where(F.col("event_type") == kind).select("ts", r6(F.col("v"), name))
    return E.forecast_table(of("view", "load"), of("click", "weather"), of("purchase", "price"), of("signup", "profile"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i >= 100 AND i < 400")
def row_slice(spark: SparkSession, d: str) -> DataFrame:
    return E.slice_rows(read(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 100, 300).select("event_id")


@query("SELECT CAST(floor(count(*) * 0.2) AS BIGINT) AS valid, count(*) - CAST(floor(count(*) * 0.2) AS BIGINT) AS train, CAST(0 AS BIGINT) AS shared FROM orders")
def random_split(spark: SparkSession, d: str) -> DataFrame:
    train, valid = E.train_valid_split(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)
    counts = valid.agg(F.count("*").alias("valid")).crossJoin(train.agg(F.count("*").alias("train")))  # one row each
    return counts.withColumn("shared", F.lit(train.join(valid, "o_orderkey").count()).cast("long"))


@query("""SELECT event_id, CASE WHEN i < n // 2 THEN 'train' ELSE 'valid' END AS part FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)""")
def rolling_split(spark: SparkSession, d: str) -> DataFrame:
    """Windows that together hold all rows leave one cut to draw: every row's part is known."""
    t = read(spark, d, "events").select("event_id", "ts")
    n = t.count()
    train, valid, _ = E.rolling_origin(t, ["ts", "event_id"], n // 2, n - n // 2, 3)
    return train.select("event_id", F.lit("train").alias("part")).unionByName(valid.select("event_id", F.lit("valid").alias("part")))


@query(f"""WITH {ROWS_SQL}, z AS (SELECT y, m2 AS a, m2 + 1 AS b, m2 + 4 AS c FROM rows), l AS (SELECT y, CASE WHEN y >= a THEN 0 ELSE a - y END AS l0, CASE WHEN y >= a THEN 0.1 * (y - a) ELSE 0.9 * (a - y) END AS l1, CASE WHEN y >= b THEN 0.5 * (y - b) ELSE 0.5 * (b - y) END AS l2, CASE WHEN y >= c THEN 0.9 * (y - c) ELSE (1 - 0.9) * (c - y) END AS l3, CASE WHEN y >= c THEN y - c ELSE 0 END AS l4 FROM z)
SELECT round(avg(2 * ((l0 + l1) / 2 * 0.1 + (l1 + l2) / 2 * 0.4 + (l2 + l3) / 2 * 0.4 + (l3 + l4) / 2 * 0.1)) / (quantile_cont(y, 0.95) - quantile_cont(y, 0.05)), 6) AS rcrps FROM l""")
def measures_rcrps(spark: SparkSession, d: str) -> DataFrame:
    t = rows(spark, d).select("y", F.col("m2").alias("a"), (F.col("m2") + 1).alias("b"), (F.col("m2") + 4).alias("c"))
    return spark.createDataFrame([(round(E.rcrps(t, ["a", "b", "c"], "y", (0.1, 0.5, 0.9)), 6),)], "rcrps double")


@query("""SELECT event_id, lag(value, 2) OVER (ORDER BY ts, event_id) AS lag2 FROM events""")
def lag_whole_table(spark: SparkSession, d: str) -> DataFrame:
    return E.with_lags(read(spark, d, "events"), "value", ["ts", "event_id"], {"lag2": 2}).select("event_id", "lag2")


@query("SELECT event_id, ts FROM events WHERE event_id % 3 <> 0")
def parse_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are no timestamp go."""
    text = F.when(F.col("event_id") % 3 == 0, "no time").otherwise(F.col("ts").cast("string"))
    return E.parsed(read(spark, d, "events").select("event_id", text.alias("ts")), "ts").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT o_orderstatus AS dataset, 'gbdt' AS booster, o_orderpriority AS library, 'rmse' AS metric, round(avg(o_totalprice / 1000), 4) AS mean, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 3")
def summary_of_task(spark: SparkSession, d: str) -> DataFrame:
    res = fake_results(spark, d).withColumn("task", F.when(F.col("seed") % 2 == 0, "binary").otherwise("regression"))
    return r4_all(E.summary_by_task(res, "binary"), "mean").select("dataset", "booster", "library", "metric", "mean", "n")


@query("SELECT event_id, event_id AS user_id_count, value FROM events")
def numeric_projection(spark: SparkSession, d: str) -> DataFrame:
    """Numeric columns by name, without those that a join doubled."""
    t = read(spark, d, "events")
    joined = t.select("event_id", "ts", "event_type", "value", F.col("event_id").alias("user_id_count"), F.col("value").alias("value_x"), F.col("user_id").alias("user_id_y"))
    return E.numeric_columns(joined)


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 4) AS z FROM orders")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return E.standardised(t, t, "o_totalprice")[0].select("o_orderkey", F.round("o_totalprice", 4).alias("z"))


@query(f"""WITH {ROWS_SQL} SELECT round(sqrt(sum(w * (m - y) * (m - y)) / sum(w)), 6) AS rmse, round(sum(w * abs(m - y)) / sum(w), 6) AS mae, round(sum(w * abs(m - y)) / sum(w * abs(y)), 6) AS rmae, round(1 - sum(w * (m - y) * (m - y)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)), 6) AS r2 FROM rows""")
def measures_regression(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).agg(*[r6(c, k) for k, c in E.regression_measures(F.col("m"), F.col("y"), F.col("w")).items()])


@query(f"""WITH {ROWS_SQL}, z AS (SELECT y, m2 AS a, m2 + 1 AS b, m2 + 4 AS c, w FROM rows), l AS (SELECT w, CASE WHEN y >= a THEN 0 ELSE a - y END AS l0, CASE WHEN y >= a THEN 0.1 * (y - a) ELSE 0.9 * (a - y) END AS l1, CASE WHEN y >= b THEN 0.5 * (y - b) ELSE 0.5 * (b - y) END AS l2, CASE WHEN y >= c THEN 0.9 * (y - c) ELSE (1 - 0.9) * (c - y) END AS l3, CASE WHEN y >= c THEN y - c ELSE 0 END AS l4 FROM z)
SELECT round(sum(w * 2 * ((l0 + l1) / 2 * 0.1 + (l1 + l2) / 2 * 0.4 + (l2 + l3) / 2 * 0.4 + (l3 + l4) / 2 * 0.1)) / sum(w), 6) AS crps FROM l""")
def measures_crps(spark: SparkSession, d: str) -> DataFrame:
    ps = [F.col("m2"), F.col("m2") + 1, F.col("m2") + 4]
    return rows(spark, d).agg(r6(F.sum(F.col("w") * E.crps(ps, F.col("y"), (0.1, 0.5, 0.9))) / F.sum("w"), "crps"))


def fake_results(spark: SparkSession, d: str) -> DataFrame:
    """A result table from orders: priorities are libraries, statuses datasets."""
    t = read(spark, d, "orders")
    return t.select(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("config"), F.col("o_orderpriority").alias("library"), F.col("o_orderkey").alias("seed"), F.lit("regression").alias("task"), F.lit("gbdt").alias("booster"), F.col("o_orderstatus").alias("dataset"), F.create_map(F.lit("rmse"), F.col("o_totalprice") / 1000).alias("metrics"))


@query("SELECT o_orderstatus AS dataset, 'gbdt' AS booster, o_orderpriority AS library, 'rmse' AS metric, round(avg(o_totalprice / 1000), 4) AS mean, round(stddev_samp(o_totalprice / 1000), 4) AS std, count(*) AS n FROM orders GROUP BY 1, 3")
def result_summary(spark: SparkSession, d: str) -> DataFrame:
    return r4_all(E.summary(fake_results(spark, d)), "mean", "std")


@query("""WITH a AS (SELECT o_orderstatus || '/' || o_orderpriority AS config, o_orderpriority AS library, avg(o_totalprice / 1000) AS mean FROM orders GROUP BY 1, 2) SELECT config, library, 'rmse' AS metric, round(mean, 4) AS mean, 150.0 AS baseline, mean > 153 AS regressed FROM a""")
def baseline_check(spark: SparkSession, d: str) -> DataFrame:
    res = fake_results(spark, d)
    body: dict = {"version": 1, "configs": {}}
    for c, lib in res.select("config", "library").distinct().collect():
        body["configs"].setdefault(c, {})[lib] = {"rmse": {"mean": 150.0, "std": None, "n": 1}}
    return r4_all(E.check_baseline(res, body), "mean")


@query(f"""WITH {ROWS_SQL}, c AS (SELECT quantile_cont(y, 0.8) AS cut FROM rows) SELECT k, n, CASE WHEN y > cut THEN 5.0 ELSE 1.0 END AS weight FROM rows, c""")
def derived_weights(spark: SparkSession, d: str) -> DataFrame:
    return E.with_weights(rows(spark, d), "y", "k", 3, noise=0.0).select("k", "n", F.col("_w").alias("weight"))


@query(f"WITH {ROWS_SQL} SELECT k, n, CASE WHEN y <= 5 THEN q END AS q FROM rows")
def missing_injection(spark: SparkSession, d: str) -> DataFrame:
    """All rows above the middle lose a value; none below does. (Which rows a smaller share hits is a hash's choice.)"""
    t = E.with_missing(rows(spark, d).withColumn("id", F.col("k") * 8 + F.col("n")), "q", "id", 1.0, 5, F.col("y") > 5)
    return t.select("k", "n", F.nanvl("q", F.lit(None).cast("double")).alias("q"))


@query(f"""WITH {ROWS_SQL}, c AS (SELECT y, sum(sw) OVER (ORDER BY y) / sum(sw) OVER () AS c FROM (SELECT y, sum(w) AS sw FROM rows GROUP BY y)), q AS (SELECT * FROM (VALUES (0.05), (0.5), (0.95)) v(q)),
b AS (SELECT q, max(CASE WHEN c < q THEN c END) AS c0, max(CASE WHEN c < q THEN y END) AS y0, min(CASE WHEN c >= q THEN c END) AS c1, min(CASE WHEN c >= q THEN y END) AS y1 FROM c, q GROUP BY q) SELECT CAST(q AS DOUBLE) AS q, round(y0 + (y1 - y0) * (q - c0) / (c1 - c0), 4) AS value FROM b""")
def quantiles_interpolated(spark: SparkSession, d: str) -> DataFrame:
    q = (0.05, 0.5, 0.95)
    got = E.weighted_quantile_interpolated(rows(spark, d), "y", "w", q)
    return spark.createDataFrame([(a, round(v, 4)) for a, v in zip(q, got, strict=True)], "q double, value double")


@query(f"""WITH {ROWS_SQL}, c AS (SELECT y, sum(sw) OVER (ORDER BY y) AS c, sum(sw) OVER () AS t FROM (SELECT y, sum(w) AS sw FROM rows GROUP BY y)) SELECT round(min(y), 6) AS value FROM c WHERE c >= 0.3 * t""")
def quantile_lower(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(O.weighted_quantile(rows(spark, d), "y", "w", 0.3), 6),)], "value double")


@query("""SELECT o_orderstatus AS dataset, 'gbdt' AS booster, o_orderpriority AS library, count(*) AS n, round(min(o_totalprice / 1000), 6) AS low, round(max(o_totalprice / 1000), 6) AS high FROM orders GROUP BY 1, 3""")
def values_by_library(spark: SparkSession, d: str) -> DataFrame:
    v = E.values_by_library(fake_results(spark, d), "rmse")
    return v.select("dataset", "booster", "library", F.size("values").cast("long").alias("n"), r6(F.col("values")[0], "low"), r6(F.element_at("values", -1), "high"))


@query(f"""WITH z AS (SELECT date_trunc('hour', ts) AS start, value - (1 + {TREE_A} + {TREE_B}) AS e FROM (SELECT ts, value, user_id % 50 AS q, 0.02 AS disc, 'A' AS flag FROM events)) SELECT start, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM z GROUP BY start""")
def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a stream and scored; windowed errors."""
    import uuid

    from thicket.session import shared_dir
    from thicket.streaming.score import windowed_error

    src = read(spark, d, "events")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows_ = stream.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 50).cast("double").alias("q"), F.lit(0.02).alias("disc"), F.lit("A").alias("flag"), F.col("value").alias("y"))
    name = f"windows_{uuid.uuid4().hex}"
    out = windowed_error(rows_, fixed_model(), "ts", "y").writeStream.format("memory").queryName(name).outputMode("complete")
    out.option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start().awaitTermination(300)
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", r6(F.col("rmse"), "rmse"), r6(F.col("mae"), "mae"))


@query()
def synthetic_suite(spark: SparkSession, d: str) -> DataFrame:
    """A minimal suite of two generated datasets."""
    from thicket.sources import synthetic

    reg = E.RunConfig("synthetic_reg", "regression", lambda s: Dataset.from_dataframe(synthetic.regression(s, 500, 5), [f"f{i}" for i in range(5)], "y", row="_row"))
    lin = E.RunConfig("synthetic_lin", "binary", lambda s: Dataset.from_dataframe(synthetic.binary(s, 500, 5), [f"f{i}" for i in range(5)], "y", row="_row"), booster="gblinear")
    return E.run_suite(spark, E.Suite("own", (reg, lin), settings={"n_estimators": 3})).select("config", "seed", "metrics", "error")


# the queries that train register themselves after those above
from thicket import training_queries  # noqa: E402, F401

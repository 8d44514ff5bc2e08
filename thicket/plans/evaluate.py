"""Evaluation: preparation and splits of tables, quality measures, suites of runs, their summaries, and baselines."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import metrics as M
from thicket.functions import objectives as O
from thicket.operators.model import GBDTModel
from thicket.operators.ranking import numbered
from thicket.plans import gblinear
from thicket.plans.gbdt import GBDTConfig
from thicket.session import materialised
from thicket.sources.dataset import Dataset

# Preparation


def keep_last(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: that of the greatest version, nulls first."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def parsed(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is a timestamp, as one."""
    return df.withColumn(column, F.try_to_timestamp(column)).where(F.col(column).isNotNull())


def forecast_table(load: DataFrame, weather: DataFrame, prices: DataFrame, profiles: DataFrame, on: str = "ts") -> DataFrame:
    """load with weather where both are; prices and profiles where they are."""
    return load.join(weather, on, "inner").join(prices, on, "left").join(profiles, on, "left")


def with_dates(df: DataFrame, ts: str) -> DataFrame:
    """day_of_week from Monday = 0, and quarter_of_day, the quarter hour."""
    return df.withColumns({"day_of_week": F.weekday(ts), "quarter_of_day": F.floor((F.hour(ts) * 60 + F.minute(ts)) / 15).cast("int")})


def with_lags(df: DataFrame, column: str, order: Sequence[str], lags: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    """Values of so many rows before, within each series of `by`; a table that is one series is numbered by ranges and met with itself."""
    if not by:
        rows = numbered(df, order)
        out = rows
        for n, k in lags.items():
            out = out.drop(n).join(rows.select((F.col("_n") + k).alias("_n"), F.col(column).alias(n)), "_n", "left")
        return out.drop("_n")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({n: F.lag(column, k).over(w) for n, k in lags.items()})


def slice_rows(df: DataFrame, order: Sequence[str], skip: int, keep: int) -> DataFrame:
    return numbered(df, order).where((F.col("_n") >= skip) & (F.col("_n") < skip + keep)).drop("_n")


def numeric_columns(df: DataFrame, drop_suffixes: Sequence[str] = ("_x", "_y")) -> DataFrame:
    """Numeric columns by name, without those that a join doubled."""
    from pyspark.sql.types import NumericType

    names = sorted(f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and not f.name.endswith(tuple(drop_suffixes)))
    return df.select(names)


def rolling_origin(df: DataFrame, order: Sequence[str], train_window: int, valid_window: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(train, valid, cut): the windows before and after a cut drawn from those that leave room for both."""
    rows = numbered(df, order)
    n = rows.count()
    if n < train_window + valid_window:
        raise ValueError(f"{n} rows are too few for {train_window} and {valid_window}")
    cut = int(np.random.default_rng(seed).integers(train_window, n - valid_window + 1))
    c = F.col("_n")
    return rows.where((c >= cut - train_window) & (c < cut)).drop("_n"), rows.where((c >= cut) & (c < cut + valid_window)).drop("_n"), cut


def train_valid_split(df: DataFrame, key: str, seed: int, valid_fraction: float = 0.2, max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact counts by hash order of the key; with max_samples only so many rows, those of the smallest hashes, take part."""
    h = F.xxhash64(F.lit(seed), key)
    rows = numbered(df.withColumn("_h", h), ["_h", key]).drop("_h")
    n = min(rows.count(), max_samples or 2**62)
    k = int(n * valid_fraction)
    c = F.col("_n")
    return rows.where((c >= k) & (c < n)).drop("_n"), rows.where(c < k).drop("_n")


def with_missing(df: DataFrame, column: str, key: str, share: float, seed: int, where: Column | None = None) -> DataFrame:
    """NaN in a hash share of the rows, of those that a condition holds for."""
    hit = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.withColumn(column, F.when(hit & (where if where is not None else F.lit(True)), F.lit(float("nan"))).otherwise(F.col(column).cast("double")))


def percentile(df: DataFrame, column: str, level: float) -> float | None:
    """Linear between the two values next to place level * (n - 1); none without values. Places come from ranges, so no task holds all values."""
    rows = numbered(df.select(F.col(column).alias("v")).where("v IS NOT NULL"), ["v"])
    at = level * (rows.count() - 1)
    if at < 0:
        return None
    got = dict(map(tuple, rows.where(F.col("_n").isin(math.floor(at), math.ceil(at))).select("_n", F.col("v").cast("double")).collect()))
    low, high = got[math.floor(at)], got[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def with_weights(df: DataFrame, target: str, key: str, seed: int, factor: float = 5.0, level: float = 0.8, noise: float = 0.1) -> DataFrame:
    """_w: `factor` above the level-quantile of the target and 1 below, with noise, at least 0.01."""
    cut = percentile(df, target, level)
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**20)) / float(2**20)
    return df.withColumn("_w", F.greatest(F.lit(0.01), F.when(F.col(target) > F.lit(cut), factor).otherwise(1.0) + noise * (2 * u - 1)))


def standardised(train: DataFrame, valid: DataFrame, target: str) -> tuple[DataFrame, DataFrame, float, float]:
    """Both with the target less the training mean over the training deviation of the population."""
    mean, std = train.agg(F.avg(target), F.stddev_pop(target)).first()
    mean, std = mean or 0.0, std or 1.0
    scaled = lambda df: df.withColumn(target, ((F.col(target) - mean) / std).cast("float").cast("double"))
    return scaled(train), scaled(valid), mean, std


# Measures


def check_quantiles(q: Sequence[float]) -> None:
    if not q or any(not 0 < x < 1 for x in q) or any(b <= a for a, b in zip(q, q[1:], strict=False)):
        raise ValueError("quantiles must increase within (0, 1)")


def checked_weight(df: DataFrame, w: str | None) -> Column:
    """The weight; an error for a negative one, 1 for all if all are 0."""
    if w is None:
        return F.lit(1.0)
    least, total = df.agg(F.min(w), F.sum(w)).first()
    if least is not None and least < 0:
        raise ValueError("weights must not be negative")
    return F.col(w) if total else F.lit(1.0)


def regression_measures(p: Column, y: Column, w: Column) -> dict[str, Column]:
    """rmse, mae, rmae (mae over the mean size of y) and r2."""
    d = p - y
    mae, size = F.sum(w * F.abs(d)) / F.sum(w), F.sum(w * F.abs(y)) / F.sum(w)
    mean = F.sum(w * y) / F.sum(w)
    spread = F.sum(w * y * y) - F.sum(w) * mean * mean
    return {"rmse": F.sqrt(F.sum(w * d * d) / F.sum(w)), "mae": mae, "rmae": F.when(size > 0, mae / size), "r2": F.when(spread > 0, 1 - F.sum(w * d * d) / spread)}


def crps(ps: Sequence[Column], y: Column, q: Sequence[float]) -> Column:
    """Twice the pinball loss over the levels by trapezoids; the ends are held up to 0 and 1."""
    loss = [F.when(y >= p, a * (y - p)).otherwise((1 - a) * (p - y)) for p, a in zip(ps, q, strict=True)]
    # beyond the outer levels the outer quantiles stand, at levels 0 and 1
    first = F.when(y >= ps[0], 0.0).otherwise(ps[0] - y)
    last = F.when(y >= ps[-1], y - ps[-1]).otherwise(0.0)
    total = F.lit(0.0)
    points = [(0.0, first), *zip(q, loss, strict=True), (1.0, last)]
    for (a, x), (b, z) in zip(points, points[1:], strict=False):
        total = total + (x + z) / 2 * (b - a)
    return 2 * total


def weighted_quantile_interpolated(df: DataFrame, value: str, w: str | None, q: Sequence[float]) -> list[float]:
    """Linear between values at their cumulated share of weight; unlike objectives.weighted_quantile.

    Values with their weights are written once by ranges. One job sums each range, one more reads the ranges in which levels lie: their number is that of the shuffle's partitions, however many values there are.
    """
    weight = F.col(w) if w else F.lit(1.0)
    by = df.select(F.col(value).alias("v"), weight.cast("double").alias("w")).where("v IS NOT NULL").groupBy("v").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(materialised(by).repartitionByRange(parts, "v").withColumn("p", F.spark_partition_id()))
    sums = sorted(ranged.groupBy("p").agg(F.sum("w"), F.max("v")).collect())
    total, before, asked = sum(s for _, s, _ in sums), 0.0, {}
    for i, (p, s, _) in enumerate(sums):
        for k, level in enumerate(q):
            if k not in asked and (before + s >= level * total or i == len(sums) - 1):
                asked[k] = (p, before, (sums[i - 1][2], before) if i else None)
        before += s
    if not asked:
        return []
    starts = {p: b for p, b, _ in asked.values()}
    start = F.try_element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("p"))
    cum = F.sum("w").over(Window.partitionBy("p").orderBy("v")) + start
    found = []
    for k, (p, _, _) in asked.items():
        own, goal = F.col("p") == p, q[k] * total
        found += [F.min(F.when(own & (F.col("c") >= goal), F.struct("v", "c"))).alias(f"above{k}"), F.max(F.when(own & (F.col("c") < goal), F.struct("v", "c"))).alias(f"below{k}")]
    row = ranged.where(F.col("p").isin(*starts)).withColumn("c", cum).agg(*found).first()
    out = []
    for k, level in enumerate(q):
        goal, above, low = level * total, row[f"above{k}"], row[f"below{k}"] or asked[k][2]
        if above is None:
            out.append(float(low[0]))
        elif low is None:
            out.append(float(above["v"]))
        else:
            out.append(float(low[0] + (above["v"] - low[0]) * (goal - low[1]) / (above["c"] - low[1])))
    return out


def rcrps(df: DataFrame, ps: Sequence[str], y: str, q: Sequence[float], w: str | None = None) -> float:
    """CRPS over the spread between the 5 % and 95 % quantiles of the target; NaN for no spread."""
    check_quantiles(q)
    weight = checked_weight(df, w)
    top = df.agg(F.sum(weight * crps([F.col(p) for p in ps], F.col(y), q)) / F.sum(weight)).first()[0]
    low, high = weighted_quantile_interpolated(df, y, w, (0.05, 0.95)) if w else (percentile(df, y, 0.05), percentile(df, y, 0.95))
    return top / (high - low) if high != low else math.nan


# Suites


@dataclass(frozen=True)
class RunConfig:
    """One dataset and booster; what is None comes from the suite."""

    name: str
    task: str
    load: Callable[[SparkSession], Dataset] = field(compare=False, repr=False, default=None)
    booster: str = "gbdt"
    n_classes: int = 2
    quantiles: tuple[float, ...] = ()
    settings: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Suite:
    name: str
    configs: tuple[RunConfig, ...]
    seeds: tuple[int, ...] = (42,)
    settings: Mapping[str, Any] = field(default_factory=dict)


#: settings by booster, dataset and suite; later ones win, and a call's own win over all
BOOSTER_DEFAULTS = {"gbdt": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6}, "gblinear": {"n_estimators": 100, "learning_rate": 0.5}, "linear_trees": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6}}
SUITES = {"quick": {"seeds": (42, 1379, 2716), "n_estimators": 50}, "full": {"seeds": (42, 1379, 2716, 4053, 5390), "n_estimators": 100}, "minimal": {"seeds": (42,), "n_estimators": 10}}
ABLATIONS = {"depth": {"max_depth": (4, 6, 8)}, "learning_rate": {"learning_rate": (0.01, 0.1, 0.3)}, "growth": {"growth": ("depthwise", "leafwise")}}


def suite(name: str, configs: Sequence[RunConfig]) -> Suite:
    """quick, full or minimal over these configurations."""
    s = SUITES[name]
    return Suite(name, tuple(configs), s["seeds"], {"n_estimators": s["n_estimators"]})


def ablation(kind: str, config: RunConfig) -> list[RunConfig]:
    """The configuration once for each value of what the ablation varies."""
    (key, values), = ABLATIONS[kind].items()
    return [replace(config, name=f"{config.name}/{key}={v}", settings={**config.settings, key: v}) for v in values]


def resolved(config: RunConfig, of: Suite, **own: Any) -> dict[str, Any]:
    return {**BOOSTER_DEFAULTS.get(config.booster, {}), **config.settings, **of.settings, **own}


def run_seed(seed: int, config: str, library: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{config}:{library}".encode()).digest()[:4], "big")


RESULTS = "config string, library string, seed long, task string, booster string, dataset string, metrics map<string,double>, train_s double, predict_s double, error string"


def objective_of(c: RunConfig) -> O.Objective:
    if c.task == "quantile":
        check_quantiles(c.quantiles)
        return O.quantile(c.quantiles)
    return {"regression": O.squared, "binary": O.logistic}.get(c.task, lambda: O.softmax_loss(c.n_classes))()


def measures(df: DataFrame, c: RunConfig, label: str, w: str | None) -> dict[str, float]:
    """df has the array `prediction`."""
    weight, y, p = (F.col(w) if w else F.lit(1.0)), F.col(label), F.col("prediction")
    if c.task == "regression":
        exprs = regression_measures(p[0], y, weight)
    elif c.task == "binary":
        exprs = {"logloss": M.logloss([p[0]], y, weight), "accuracy": M.accuracy([p[0]], y, weight)}
    elif c.task == "quantile":
        ps = [p[i] for i in range(len(c.quantiles))]
        exprs = {"pinball": M.pinball(ps, y, weight, c.quantiles)}
    else:
        ps = [p[i] for i in range(c.n_classes)]
        exprs = {"mlogloss": M.mlogloss(ps, y, weight), "accuracy": M.multiclass_accuracy(ps, y, weight)}
    row = df.agg(*[v.alias(k) for k, v in exprs.items()]).first().asDict()
    if c.task == "quantile":
        flat = df.withColumns({f"_q{i}": p[i] for i in range(len(c.quantiles))})
        row["rcrps"] = rcrps(flat, [f"_q{i}" for i in range(len(c.quantiles))], label, c.quantiles, w)
    return {k: float(v) for k, v in row.items() if v is not None}


#: how a booster of that name trains: (dataset, config, settings, seed) -> a model with transform(); more can be registered
RUNNERS: dict[str, Callable[..., Any]] = {}


def runner(name: str) -> Callable:
    """Registers a way to train under a booster's name, for suites of one's own."""

    def add(f: Callable) -> Callable:
        RUNNERS[name] = f
        return f

    return add


@runner("gblinear")
def _linear(ds: Dataset, c: RunConfig, settings: Mapping[str, Any], seed: int) -> Any:
    kept = tuple(f for f in ds.features if f not in ds.categorical)
    return gblinear.train(replace(ds, features=kept, categorical=frozenset()), gblinear.GBLinearConfig(objective=objective_of(c), seed=seed, **settings))


@runner("linear_trees")
@runner("gbdt")
def _trees(ds: Dataset, c: RunConfig, settings: Mapping[str, Any], seed: int) -> Any:
    from thicket.operators.linear_leaf import LinearLeafConfig

    model = GBDTModel.train(ds, GBDTConfig(objective=objective_of(c), seed=seed, linear_leaves=LinearLeafConfig() if c.booster == "linear_trees" else None, **settings))
    model.categories = {}  # ds is encoded
    return model


def run_one(spark: SparkSession, c: RunConfig, settings: Mapping[str, Any], seed: int) -> tuple[dict[str, float], float, float]:
    ds = c.load(spark)
    train_df, valid_df = train_valid_split(ds.df, "_row", seed)
    if c.task in ("regression", "quantile"):
        train_df, valid_df, _, _ = standardised(train_df, valid_df, ds.label)
    ds = ds.with_df(train_df)
    began = time.perf_counter()
    if c.booster not in RUNNERS:
        raise ValueError(f"no runner for {c.booster!r}; known: {', '.join(sorted(RUNNERS))}")
    model: Any = RUNNERS[c.booster](ds, c, settings, seed)
    trained = time.perf_counter()
    got = measures(model.transform(valid_df), c, ds.label, ds.weight)
    return got, trained - began, time.perf_counter() - trained


def run_suite(spark: SparkSession, of: Suite, library: str = "thicket", **own: Any) -> DataFrame:
    """One row a run; a run that fails has its error instead of metrics."""
    rows = []
    for c in of.configs:
        for seed in of.seeds:
            try:
                metrics, train_s, predict_s = run_one(spark, c, resolved(c, of, **own), run_seed(seed, c.name, library))
                rows.append((c.name, library, seed, c.task, c.booster, c.name.split("/")[0], metrics, train_s, predict_s, None))
            except Exception as e:  # noqa: BLE001
                rows.append((c.name, library, seed, c.task, c.booster, c.name.split("/")[0], {}, None, None, repr(e)))
    return spark.createDataFrame(rows, RESULTS)


# Summaries


def long_form(results: DataFrame) -> DataFrame:
    return results.select("config", "library", "seed", "task", "booster", "dataset", F.explode("metrics").alias("metric", "value"))


def summary(results: DataFrame, by: Sequence[str] = ("dataset", "booster", "library")) -> DataFrame:
    """Mean, sample deviation and count of each metric."""
    return long_form(results).groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))


def summary_by_task(results: DataFrame, task: str) -> DataFrame:
    return summary(results.where(F.col("task") == task))


def values_by_library(results: DataFrame, metric: str) -> DataFrame:
    return long_form(results).where(F.col("metric") == metric).groupBy("dataset", "booster", "library").agg(F.sort_array(F.collect_list("value")).alias("values"))


def student_tail(t: float, df: float) -> float:
    """P(|T| > t) of Student's distribution: the regularised incomplete beta function by its continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = (b, a, 1 - x) if flip else (a, b, x)
    # modified Lentz
    tiny, c, d = 1e-300, 1.0, 1 - (p + q) * z / (p + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    value = front * h / p
    return 1 - value if flip else value


def differs(a: Sequence[float], b: Sequence[float], alpha: float = 0.05) -> bool:
    """Welch's test. Fewer than two values never differ; without any spread unequal means do."""
    if min(len(a), len(b)) < 2:
        return False
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    if va + vb == 0:
        return bool(np.mean(a) != np.mean(b))
    t = abs(np.mean(a) - np.mean(b)) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    return bool(student_tail(float(t), float(df)) < alpha)


HIGHER_IS_BETTER = ("accuracy", "r2", "auc")


def machine(spark: SparkSession) -> dict[str, str]:
    """Where results were made: the driver's system, and what Spark runs on."""
    import platform

    sc = spark.sparkContext
    return {"system": platform.platform(), "python": platform.python_version(), "spark": spark.version, "java": spark._jvm.System.getProperty("java.version"), "master": sc.master, "cores": str(sc.defaultParallelism)}


def report(rows: DataFrame) -> str:
    """The table and the machine."""
    return markdown(rows) + "\n\n" + "\n".join(f"- {k}: {v}" for k, v in machine(rows.sparkSession).items())


def markdown(rows: DataFrame) -> str:
    """A summary as a table, the best mean of each dataset and metric in bold."""
    w = Window.partitionBy("dataset", "metric")
    better = F.when(F.col("metric").isin(*HIGHER_IS_BETTER), F.max("mean").over(w)).otherwise(F.min("mean").over(w))
    got = rows.withColumn("best", F.col("mean") == better).orderBy("dataset", "metric", "booster", "library").collect()
    lines = ["| dataset | metric | booster | library | value |", "| --- | --- | --- | --- | --- |"]
    for r in got:
        text = f"{r['mean']:.4f}" + (f"±{r['std']:.4f}" if r["std"] is not None else "")
        lines.append(f"| {r['dataset']} | {r['metric']} | {r['booster']} | {r['library']} | {f'**{text}**' if r['best'] else text} |")
    return "\n".join(lines)


# Baselines


BASELINE_VERSION = 1


def is_regression(current: float, baseline: float, metric: str, tolerance: float = 0.02) -> bool:
    """Worse than the baseline by more than the relative tolerance."""
    slack = tolerance * abs(baseline)
    return current < baseline - slack if metric in HIGHER_IS_BETTER else current > baseline + slack


def record_baseline(results: DataFrame, path: str) -> None:
    rows = summary(results, ("config", "library")).collect()
    body: dict[str, Any] = {"version": BASELINE_VERSION, "configs": {}}
    for r in rows:
        body["configs"].setdefault(r["config"], {}).setdefault(r["library"], {})[r["metric"]] = {"mean": r["mean"], "std": r["std"], "n": r["n"]}
    Path(path).write_text(json.dumps(body, indent=1, sort_keys=True))


def load_baseline(path: str) -> dict[str, Any]:
    body = json.loads(Path(path).read_text())
    if body.get("version") != BASELINE_VERSION:
        raise ValueError(f"baseline version {body.get('version')}")
    return body


def check_baseline(results: DataFrame, baseline: Mapping[str, Any], tolerance: float = 0.02) -> DataFrame:
    """(config, library, metric, mean, baseline, regressed) of what both have."""
    spark = results.sparkSession
    rows = [(c, lib, m, float(v["mean"])) for c, libs in baseline["configs"].items() for lib, ms in libs.items() for m, v in ms.items()]
    old = spark.createDataFrame(rows, "config string, library string, metric string, baseline double")
    both = summary(results, ("config", "library")).join(old, ["config", "library", "metric"])
    slack = tolerance * F.abs("baseline")
    worse = F.when(F.col("metric").isin(*HIGHER_IS_BETTER), F.col("mean") < F.col("baseline") - slack).otherwise(F.col("mean") > F.col("baseline") + slack)
    return both.select("config", "library", "metric", "mean", "baseline", worse.alias("regressed"))


def write_results(results: DataFrame, path: str, form: str = "json") -> None:
    """JSON lines, or CSV in long form."""
    if form == "json":
        results.write.mode("overwrite").json(path)
    elif form == "csv":
        long_form(results).write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError("form must be json or csv")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).json(path)

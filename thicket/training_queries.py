"""Queries that run the training loop itself, and ANSI SQL that grows the same trees.

The SQL is generated: bins are dense ranks (exact while a feature has no more distinct values than bins), each level of a tree
sums gradients by node, feature and bin, scans them in both directions, and moves rows to the children of each node's best
split. Gains are compared in single precision, as results have them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import metrics as M
from thicket.functions import objectives as O
from thicket.operators.binning import BinningConfig
from thicket.operators.model import GBDTModel
from thicket.plans.gbdt import GBDTConfig, Trainer
from thicket.queries import ROWS_SQL, SIG, dataset, one_hot, query, r6, read, rows
from thicket.sources.dataset import Dataset


@dataclass(frozen=True)
class Loss:
    """y and w as SQL, base(y, w), gradient and hessian of margin p, and the quantile level of leaves that are quantiles of residuals."""

    y: str = "y"
    w: str = "w"
    base: str = "sum(w * y) / sum(w)"
    g: str = "w * (p - y)"
    h: str = "w"
    level: float | None = None


SQUARED = Loss()
LOGISTIC = Loss("yb", "1.0", "ln(avg(y) / (1 - avg(y)))", f"{SIG.format('p')} - y", f"greatest({SIG.format('p')} * (1 - {SIG.format('p')}), 1e-6)")


@dataclass(frozen=True)
class Boosted:
    """features: (column, 'num' or 'cat'), with `missing` those that have nulls; splits of at most `leaves` leaves a tree if leaf-wise."""

    features: Sequence[tuple[str, str]]
    rounds: int
    depth: int
    loss: Loss = SQUARED
    missing: Sequence[str] = ()
    rate: float = 0.3
    train: str = "true"
    leaves: int | None = None

    def sql(self, prefix: str = "", margin: str | None = None) -> str:
        """CTEs up to {prefix}p{rounds}: all columns of rows, b0.., tr, and p, the margin. margin: the start, instead of the base."""
        x, loss = prefix, self.loss
        bins = ", ".join(f"dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS b{i}" for i, (c, _) in enumerate(self.features))
        parts = [f"{x}r AS MATERIALIZED (SELECT * REPLACE (CAST({loss.y} AS DOUBLE) AS y, CAST({loss.w} AS DOUBLE) AS w), {bins}, {self.train} AS tr FROM rows)"]
        absent = [f"max(CASE WHEN {c} IS NULL THEN b{i} END) AS lost{i}" for i, (c, _) in enumerate(self.features)]
        parts.append(f"{x}k AS MATERIALIZED (SELECT {', '.join(absent)} FROM {x}r)")
        start = margin or loss.base
        parts.append(f"{x}p0 AS MATERIALIZED (SELECT {x}r.*, s.p FROM {x}r, (SELECT {start} AS p FROM {x}r WHERE tr) s)")
        for t in range(self.rounds):
            parts.append(f"{x}x{t}_0 AS MATERIALIZED (SELECT *, {loss.g} AS g, {loss.h} AS h, CAST(1 AS BIGINT) AS nd FROM {x}p{t})")
            steps = self.leaves - 1 if self.leaves else self.depth
            for d in range(steps):
                parts += self.level(f"{x}x{t}_{d}", f"{x}x{t}_{d + 1}", x)
            last = f"{x}x{t}_{steps}"
            value = "-sum(g) / (sum(h) + 1)"
            if loss.level is not None:
                parts.append(f"{last}c AS (SELECT nd, e, sum(sw) OVER (PARTITION BY nd ORDER BY e) AS c, sum(sw) OVER (PARTITION BY nd) AS a FROM (SELECT nd, y - p AS e, sum(w) AS sw FROM {last} WHERE tr GROUP BY 1, 2))")
                parts.append(f"{last}v AS MATERIALIZED (SELECT nd, min(e) AS v FROM {last}c WHERE c >= {loss.level} * a * (1 - 1e-12) GROUP BY nd)")
            else:
                parts.append(f"{last}v AS MATERIALIZED (SELECT nd, {value} AS v FROM {last} WHERE tr GROUP BY nd)")
            parts.append(f"{x}p{t + 1} AS MATERIALIZED (SELECT {last}.* EXCLUDE (g, h, nd, p), p + {self.rate} * v AS p FROM {last} JOIN {last}v USING (nd))")
        return ", ".join(parts)

    def level(self, now: str, new: str, x: str) -> list[str]:
        numeric = [i for i, (_, kind) in enumerate(self.features) if kind == "num"]
        cats = [i for i, (_, kind) in enumerate(self.features) if kind == "cat"]
        cells = " UNION ALL ".join(f"SELECT nd, {i} AS f, b{i} AS b, g, h FROM {now} WHERE tr" for i in range(len(self.features)))
        out = [f"{now}c AS MATERIALIZED (SELECT *, sum(sg) OVER q AS tg, sum(sh) OVER q AS th, sum(n) OVER q AS tn FROM (SELECT nd, f, b, sum(g) AS sg, sum(h) AS sh, count(*) AS n FROM ({cells}) GROUP BY 1, 2, 3) WINDOW q AS (PARTITION BY nd, f))"]
        over = "OVER (PARTITION BY nd, f ORDER BY b)"
        scans = [f"SELECT nd, f, b, 0 AS dir, sum(sg) {over} AS gl, sum(sh) {over} AS hl, sum(n) {over} AS nl, tg, th, tn FROM {now}c WHERE f IN ({', '.join(map(str, numeric))})"] if numeric else []
        over = over.replace("ORDER BY b", "ORDER BY b DESC")
        for i in numeric:
            if self.features[i][0] in self.missing:
                scans.append(f"SELECT nd, f, b - 1, 1, tg - sum(sg) {over}, th - sum(sh) {over}, tn - sum(n) {over}, tg, th, tn FROM {now}c WHERE f = {i} AND b > 0 AND b < (SELECT lost{i} FROM {x}k)")
        scans += [f"SELECT nd, f, b, 0, sg, sh, n, tg, th, tn FROM {now}c WHERE f = {i}" for i in cats]
        out.append(f"{now}g AS (SELECT nd, f, b, dir, hl, nl, tg, th, tn, CAST(0.5 * (gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1)) AS FLOAT) AS gain FROM ({' UNION ALL '.join(scans)}) WHERE hl >= 1 AND th - hl >= 1 AND nl >= 1 AND tn - nl >= 1)")
        best = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nd ORDER BY gain DESC, f, dir, CASE dir WHEN 0 THEN b ELSE -b END) AS r FROM {now}g) WHERE r = 1 AND gain > 0"
        if self.leaves:
            # of the leaves the one of the greatest gain; of equal gains the later one
            best = f"SELECT * FROM ({best}) ORDER BY gain DESC, nd DESC LIMIT 1"
        out.append(f"{now}b AS MATERIALIZED ({best})")
        own = "CASE f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(len(self.features))) + " END"
        absent = "CASE f " + " ".join(f"WHEN {i} THEN lost{i}" for i in range(len(self.features))) + " END"
        left = f"CASE WHEN f IN ({', '.join(map(str, cats))}) THEN bb = b ELSE bb <= b OR (dir = 1 AND bb = mm) END" if cats else "bb <= b OR (dir = 1 AND bb = mm)"
        out.append(f"{new} AS MATERIALIZED (SELECT * EXCLUDE (f, b, dir, bb, mm) REPLACE (CASE WHEN f IS NULL THEN nd WHEN {left} THEN 2 * nd ELSE 2 * nd + 1 END AS nd) FROM (SELECT {now}.*, s.f, s.b, s.dir, {own} AS bb, {absent} AS mm FROM {now} LEFT JOIN {now}b s ON {now}.nd = s.nd, {x}k))")
        return out


def row_id() -> F.Column:
    return F.col("k") * 8 + F.col("n")


FOUR = [("q", "num"), ("disc", "num"), ("tax", "num"), ("flag", "cat")]
DEEP = Boosted(FOUR, 3, 4, missing=("disc",))


@query(f"WITH {ROWS_SQL}, {DEEP.sql()} SELECT k, n, round(p, 6) AS prediction FROM p3")
def train_gbdt(spark: SparkSession, d: str) -> DataFrame:
    """Three depth-wise trees of four levels over numeric, missing and categorical features; predictions of all rows."""
    model = GBDTModel.train(dataset(spark, d), GBDTConfig(n_estimators=3, max_depth=4))
    return model.transform(rows(spark, d)).select("k", "n", r6(F.col("prediction")[0], "prediction"))


def _softmax(c: int) -> Loss:
    e = [f"exp({'p' if i == c else f'base{i}'})" for i in range(3)]
    p = f"({e[c]} / ({' + '.join(e)}))"
    return Loss(f"CASE WHEN yc = {c} THEN 1 ELSE 0 END", "1.0", "", f"{p} - y", f"greatest({p} * (1 - {p}), 1e-6)")


def _leafwise_sql() -> str:
    shares = ", ".join(f"ln(avg(CASE WHEN yc = {c} THEN 1.0 ELSE 0.0 END)) AS base{c}" for c in range(3))
    parts = [ROWS_SQL.replace("rows AS (", "rows0 AS (", 1), f"rows AS MATERIALIZED (SELECT rows0.*, s.*, row_number() OVER () AS rid FROM rows0, (SELECT {shares} FROM rows0) s)"]
    for c in range(3):
        parts.append(Boosted(FOUR[:3], 1, 0, _softmax(c), ("disc",), leaves=4).sql(f"o{c}", f"max(base{c})"))
    return f"WITH {', '.join(parts)} SELECT o0p1.k, o0p1.n, {', '.join(f'round(o{c}p1.p, 6) AS margin{c}' for c in range(3))} FROM o0p1 JOIN o1p1 USING (rid) JOIN o2p1 USING (rid)"


@query(_leafwise_sql())
def train_leafwise_softmax(spark: SparkSession, d: str) -> DataFrame:
    """One leaf-wise round of three outputs with four leaves each: margins of all rows."""
    t = rows(spark, d)
    ds = Dataset.from_dataframe(t, ["q", "disc", "tax"], "yc", row=row_id())
    model = GBDTModel.train(ds, GBDTConfig(objective=O.softmax_loss(3), n_estimators=1, growth="leafwise", n_leaves=4))
    return model.transform(t).select("k", "n", *[r6(F.col("raw")[c], f"margin{c}") for c in range(3)])


HISTORY = Boosted(FOUR[:2], 3, 2, missing=("disc",), train="k % 5 <> 0")


@query(f"""WITH {ROWS_SQL}, {HISTORY.sql()} SELECT * FROM ({' UNION ALL '.join(f"SELECT CAST({t} AS BIGINT) AS round, round(sqrt(sum(CASE WHEN tr THEN w * (p - y) * (p - y) END) / sum(CASE WHEN tr THEN w END)), 6) AS train, round(sqrt(sum(CASE WHEN NOT tr THEN w * (p - y) * (p - y) END) / sum(CASE WHEN NOT tr THEN w END)), 6) AS valid FROM p{t}" for t in (1, 2, 3))})""")
def train_history(spark: SparkSession, d: str) -> DataFrame:
    """Errors of training and held-out rows after each round, from the margins that are kept with both."""
    t = rows(spark, d)
    made = lambda where: Dataset.from_dataframe(t.where(where), ["q", "disc"], "y", "w", row=row_id())
    model = GBDTModel.train(made("k % 5 <> 0"), GBDTConfig(n_estimators=3, max_depth=2, metric=M.get("rmse"), margin_rounds=2), made("k % 5 = 0"))
    return spark.createDataFrame([(i + 1, round(h["train-rmse"], 6), round(h["valid-rmse"], 6)) for i, h in enumerate(model.history)], "round long, train double, valid double")


MEDIANS = Boosted(FOUR[:1], 2, 2, Loss(base="max((SELECT min(y) FROM (SELECT y, sum(sum(w)) OVER (ORDER BY y) AS c, sum(sum(w)) OVER () AS a FROM r GROUP BY y) WHERE c >= 0.5 * a))", g="CASE WHEN p - y >= 0 THEN w ELSE -w END", level=0.5))


@query(f"WITH {ROWS_SQL}, {MEDIANS.sql()} SELECT k, n, round(p, 6) AS prediction FROM p2")
def train_absolute(spark: SparkSession, d: str) -> DataFrame:
    """Leaves that are weighted medians of their residuals."""
    t = rows(spark, d)
    model = GBDTModel.train(Dataset.from_dataframe(t, ["q"], "y", "w", row=row_id()), GBDTConfig(objective=O.absolute(), n_estimators=2, max_depth=2))
    return model.transform(t).select("k", "n", r6(F.col("prediction")[0], "prediction"))


PROBA = Boosted(FOUR[:3], 2, 2, LOGISTIC, ("disc",), rate=0.1)


@query(f"WITH {ROWS_SQL}, {PROBA.sql()} SELECT k, n, round(1 - {SIG.format('p')}, 6) AS p0, round({SIG.format('p')}, 6) AS p1, CASE WHEN {SIG.format('p')} >= 0.5 THEN 'yes' ELSE 'no' END AS said FROM p2")
def estimator_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities and classes of an estimator whose labels are words."""
    from thicket.plans.estimators import GBDTClassifier

    t = rows(spark, d).withColumn("label", F.when(F.col("yb") == 1, "yes").otherwise("no"))
    e = GBDTClassifier(["q", "disc", "tax"], "label", n_estimators=2, max_depth=2).fit(t)
    out = e.predict_proba(e.predict(t, "said"), "p")
    return out.select("k", "n", r6(F.col("p")[0], "p0"), r6(F.col("p")[1], "p1"), "said")


LEVEL = Boosted(FOUR, 1, 2, missing=("disc",))


def started(spark: SparkSession, d: str) -> tuple[Trainer, dict]:
    """The loop after its first split: both children's histograms are there, one counted and one by subtraction."""
    trainer = Trainer(dataset(spark, d), GBDTConfig(n_estimators=1, max_depth=3))
    growing = trainer.start([0])
    trainer.count(growing, {0: [trainer.apply(growing[0], 0)]})
    return trainer, growing


@query(f"WITH {ROWS_SQL}, {LEVEL.sql()} SELECT CAST(nd - 1 AS INT) AS node, CAST(f AS INT) AS feature, CAST(b AS INT) AS bin, round(sg, 4) AS sg, round(sh, 4) AS sh, n FROM x0_1c")
def trainer_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of the root's children as the training loop has them."""
    trainer, _ = started(spark, d)
    out = []
    for node in (1, 2):
        hist = trainer.pool[0, node]
        for f, b in zip(*np.nonzero(np.rint(hist[..., 2])), strict=True):
            out.append((node, int(f), int(b), round(float(hist[f, b, 0]), 4), round(float(hist[f, b, 1]), 4), int(round(hist[f, b, 2]))))
    trainer.close()
    return spark.createDataFrame(out, "node int, feature int, bin int, sg double, sh double, n long")


@query(f"WITH {ROWS_SQL}, {LEVEL.sql()} SELECT CAST(nd - 1 AS INT) AS node, CAST(f AS INT) AS feature, CASE WHEN f = 3 THEN -1 ELSE CAST(b AS INT) END AS bin, dir = 1 AS default_left, round(CAST(gain AS DOUBLE), 3) AS gain, round(th, 4) AS h, CAST(tn AS BIGINT) AS n, round(-tg / (th + 1), 6) AS weight FROM (SELECT * FROM x0_0b UNION ALL SELECT * FROM x0_1b)")
def trainer_splits(spark: SparkSession, d: str) -> DataFrame:
    """The best splits of the root and its children as the training loop finds them, with node totals and leaf weights."""
    from thicket.operators.split import leaf_weight

    trainer, growing = started(spark, d)
    g = growing[0]
    out = [(n, s.feature, s.bin, bool(s.default_left), round(s.gain, 3), round(float(g.sums[n][1]), 4), int(round(g.sums[n][2])), round(float(leaf_weight(g.sums[n][0], g.sums[n][1], trainer.c.split)), 6)) for n, s in g.splits.items() if s]
    trainer.close()
    return spark.createDataFrame(out, "node int, feature int, bin int, default_left boolean, gain double, h double, n long, weight double")


SHALLOW = Boosted(FOUR[:2], 1, 2, missing=("disc",))
SPLITS = "(SELECT * FROM x0_0b UNION ALL SELECT * FROM x0_1b)"


def shallow_model(spark: SparkSession, d: str) -> GBDTModel:
    ds = Dataset.from_dataframe(rows(spark, d), ["q", "disc"], "y", "w", row=row_id())
    return GBDTModel.train(ds, GBDTConfig(n_estimators=1, max_depth=2))


@query(f"""WITH {ROWS_SQL}, {SHALLOW.sql()}, u AS (SELECT CAST(f AS INT) AS feature, CASE f WHEN 0 THEN 'q' ELSE 'disc' END AS name, count(*) AS c, sum(CAST(gain AS DOUBLE)) AS g, sum(th) AS h FROM {SPLITS} GROUP BY f)
SELECT feature, name, 'split' AS kind, round(CAST(c AS DOUBLE), 3) AS value FROM u UNION ALL SELECT feature, name, 'gain', round(g, 3) FROM u UNION ALL SELECT feature, name, 'average_gain', round(g / c, 3) FROM u UNION ALL SELECT feature, name, 'cover', round(h, 3) FROM u UNION ALL SELECT feature, name, 'average_cover', round(h / c, 3) FROM u""")
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """All kinds of importance of a trained tree; features without a split have none."""
    from thicket.operators import explain

    m, out = shallow_model(spark, d), None
    for k in explain.KINDS:
        part = m.feature_importance(spark, k).withColumn("kind", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.where("value <> 0").withColumn("value", F.round("value", 3))


@query(f"WITH {ROWS_SQL}, {SHALLOW.sql()}, u AS (SELECT CAST(f AS INT) AS feature, CASE f WHEN 0 THEN 'q' ELSE 'disc' END AS name, sum(CAST(gain AS DOUBLE)) AS g FROM {SPLITS} GROUP BY f) SELECT feature, name, round(g / (SELECT sum(g) FROM u), 4) AS value FROM u ORDER BY g DESC LIMIT 1")
def importance_top(spark: SparkSession, d: str) -> DataFrame:
    from thicket.operators import explain

    return explain.top(explain.normalised(shallow_model(spark, d).feature_importance(spark, "gain")), 1).withColumn("value", F.round("value", 4))


@query(f"""WITH {ROWS_SQL}, {SHALLOW.sql()}, v AS (SELECT 0 AS f, q AS v, b0 AS b FROM r UNION SELECT 1, disc, b1 FROM r WHERE disc IS NOT NULL), t AS (SELECT f, b, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut FROM v)
SELECT CAST(s.nd - 1 AS INT) AS at, CASE s.f WHEN 0 THEN 'q' ELSE 'disc' END AS feature, round(cut, 6) AS threshold, round(CAST(gain AS DOUBLE), 3) AS gain, round(th, 3) AS cover FROM {SPLITS} s LEFT JOIN t ON s.f = t.f AND s.b = t.b WHERE t.cut IS NOT NULL""")
def inspect_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The splits of a trained tree as its node table names them: raw thresholds halfway between values. A split of all values from missing ones has none."""
    nodes = [n for n in shallow_model(spark, d).inspect(0) if not n["is_leaf"] and n["threshold"] != float("inf")]
    out = [(n["node_id"], n["feature"], round(n["threshold"], 6), round(n["gain"], 3), round(n["cover"], 3)) for n in nodes]
    return spark.createDataFrame(out, "at int, feature string, threshold double, gain double, cover double")


# Bundles: 25 exclusive one-hot columns and the account balance's sign


def hot_dataset(spark: SparkSession, d: str) -> Dataset:
    names = [f"nat{i}" for i in range(25)]
    t = read(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("y"), *[F.when(F.col("c_nationkey") == i, 1.0).otherwise(0.0).alias(n) for i, n in enumerate(names)])
    return Dataset.from_dataframe(t, names, "y", categorical=names, row="c_custkey")


@query("""WITH c AS (SELECT c_nationkey AS f, c_acctbal / 1000 - avg(c_acctbal / 1000) OVER () AS e FROM customer), n AS (SELECT count(*) AS n, sum(-e) AS g FROM c), s AS (SELECT f, sum(-e) AS g, count(*) AS n FROM c GROUP BY f)
SELECT CAST(f AS INT) AS feature, 1 AS bin, round(g, 4) AS sg, n FROM s UNION ALL SELECT CAST(f AS INT), 0, round(n.g - s.g, 4), n.n - s.n FROM s, n""")
def bundled_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of one-hot columns that the training loop keeps in one bundled column."""
    ds = hot_dataset(spark, d)
    trainer = Trainer(ds, GBDTConfig(n_estimators=1, binning=BinningConfig(sparsity_threshold=0.8)))
    assert trainer.state.layout.height < len(trainer.mappers)
    trainer.start([0])
    hist, out = trainer.pool[0, 0], []
    for f, b in zip(*np.nonzero(np.rint(hist[..., 2])), strict=True):
        out.append((int(trainer.mappers[f].feature[3:]), int(b), round(float(hist[f, b, 0]), 4) + 0.0, int(round(hist[f, b, 2]))))
    trainer.close()
    return spark.createDataFrame(out, "feature int, bin int, sg double, n long")


@query("""WITH h AS (SELECT i, sum(CASE WHEN c_nationkey = i OR (c_custkey % 40 = 0 AND c_nationkey = (i + 1) % 25) THEN 1 ELSE 0 END) AS hot, count(*) AS n FROM customer, range(0, 25) t(i) GROUP BY i)
SELECT 'nat' || i AS feature, CAST(hot AS BIGINT) AS n_nonzero, hot / n <= 0.05 AS sparse, hot = 0 AS trivial FROM h""")
def sparse_analysis(spark: SparkSession, d: str) -> DataFrame:
    from thicket.operators import binning

    ds = Dataset.from_dataframe(one_hot(spark, d), [f"nat{i}" for i in range(25)], row="c_custkey")
    got = [(a.feature, a.n_nonzero, a.sparse, a.trivial) for a in binning.analyse(ds, BinningConfig(sparsity_threshold=0.95))]
    return spark.createDataFrame(got, "feature string, n_nonzero long, sparse boolean, trivial boolean")


@query("""WITH v AS (SELECT DISTINCT l_quantity AS v FROM lineitem), r AS (SELECT v, lag(v) OVER (ORDER BY v) AS p, lead(v) OVER (ORDER BY v) AS f, row_number() OVER (ORDER BY v) - 1 AS bin, min(v) OVER () AS low, max(v) OVER () AS high FROM v)
SELECT CAST(bin AS INT) AS bin, round((v + f) / 2, 6) AS upper, round((coalesce((p + v) / 2, low) + coalesce((v + f) / 2, high)) / 2, 6) AS middle FROM r""")
def bin_values(spark: SparkSession, d: str) -> DataFrame:
    """Each bin's upper bound (none for the last) and its middle."""
    from thicket.operators import binning

    (m,) = binning.fit(Dataset.from_dataframe(read(spark, d, "lineitem"), ["l_quantity"], row=F.col("l_orderkey") * 8 + F.col("l_linenumber")))
    out = [(b, None if m.value(b) >= binning.BIG else round(m.value(b), 6), round(m.midpoint(b), 6)) for b in range(m.n_bins)]
    return spark.createDataFrame(out, "bin int, upper double, middle double")


def custom(weight: float) -> Callable:
    """A loss of one's own: four times as steep above the target."""

    def columns(ps, y, w):
        slope = F.when(ps[0] > y, 4.0).otherwise(1.0) * w * weight
        return [(slope * (ps[0] - y), slope)]

    return columns


@query(f"WITH {ROWS_SQL} SELECT k, n, round(CASE WHEN m > y THEN 4.0 ELSE 1.0 END * w * (m - y), 6) AS g, round(CASE WHEN m > y THEN 4.0 ELSE 1.0 END * w, 6) AS h FROM rows")
def gradients_custom(spark: SparkSession, d: str) -> DataFrame:
    own = O.custom("steep", custom(1.0), lambda p, y, w: (w * (p[0] - y), w), lambda df, y, w: [0.0])
    ((g, h),) = own.gradients([F.col("m")], F.col("y"), F.col("w"))
    return rows(spark, d).select("k", "n", r6(g, "g"), r6(h, "h"))


@query(f"WITH {ROWS_SQL} SELECT round(sum(w * CASE WHEN m > y THEN 1 ELSE 0 END) / sum(w), 6) AS above FROM rows")
def metric_custom(spark: SparkSession, d: str) -> DataFrame:
    own = M.custom("above", lambda ps, y, w: M.ratio(F.when(ps[0] > y, 1.0).otherwise(0.0), w))
    return spark.createDataFrame([(round(own.evaluate(rows(spark, d), ["m"], "y", "w"), 6),)], "above double")


@query("""SELECT CAST(user_id AS BIGINT) AS user_id, round(coalesce(sum(CASE WHEN event_type = 'view' THEN value END), 0), 4) AS view, round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0), 4) AS purchase FROM events GROUP BY user_id""")
def sparse_long(spark: SparkSession, d: str) -> DataFrame:
    """A sparse matrix of users by event types from its entries; absent entries are 0."""
    t = read(spark, d, "events")
    entries = t.where(F.col("event_type").isin("view", "purchase")).groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    ds = Dataset.from_long(entries, ["view", "purchase"], "user_id", "event_type", rows=t.select("user_id").distinct())
    return ds.df.select(F.col("_row").alias("user_id"), F.round("view", 4).alias("view"), F.round("purchase", 4).alias("purchase"))

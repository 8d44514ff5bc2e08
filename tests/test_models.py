"""Model files, conversion, attribution, estimators, datasets and streams."""

import itertools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.functions import objectives as O
from thicket.operators import explain
from thicket.operators.forest import Forest, InvalidModel, Tree
from thicket.operators.model import GBDTModel
from thicket.plans import evaluate as E
from thicket.plans import gblinear
from thicket.plans.estimators import GBDTClassifier, GBDTRegressor, GBLinearRegressor
from thicket.queries import fixed_model, linear_model
from thicket.sources import convert, persist, synthetic
from thicket.sources.dataset import Dataset, DatasetBuilder, DatasetError


def random_tree(rng, n_features=4, depth=3, cats=True):
    t = Tree()
    t.add(cover=100.0)

    def grow(node, d):
        if d == 0 or rng.random() < 0.2:
            t.value[node] = float(rng.normal())
            return
        share = rng.uniform(0.2, 0.8)
        left_cats = [int(c) for c in np.flatnonzero(rng.random(4) < 0.5)] if cats and rng.random() < 0.3 else None
        a, b = t.split(node, int(rng.integers(n_features)), float(rng.normal()), bool(rng.random() < 0.5), 1.0, left_cats, (t.cover[node] * share, t.cover[node] * (1 - share)))
        grow(a, d - 1)
        grow(b, d - 1)

    grow(0, depth)
    return t


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.booleans())
def test_forests_survive_both_forms(seed, compress):
    rng = np.random.default_rng(seed)
    m = GBDTModel(Forest([random_tree(rng) for _ in range(3)], [0.5]), tuple("abcd"), O.logistic())
    m.forest.trees[0].threshold[0] = math.inf
    again = persist.from_bytes(persist.to_bytes(m, compress))
    assert again == m and persist.from_json_bytes(persist.to_json_bytes(m, True)) == m
    assert persist.inspect_bytes(persist.to_bytes(m, compress))["model_type"] == "gbdt"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_no_bytes_do_worse_than_a_read_error(data):
    for f in (persist.from_bytes, persist.from_json_bytes, lambda d: persist.from_bytes(persist.to_bytes(fixed_model())[:40] + d)):
        with pytest.raises(persist.ReadError):
            f(data)


def test_each_corruption_has_its_kind(tmp_path):
    good = persist.to_bytes(fixed_model())
    kinds = {}
    for kind, bad in {"magic": b"XXXX" + good[4:], "version": good[:4] + b"\xff\xff" + good[6:], "type": good[:6] + b"\x09" + good[7:], "format": good[:7] + b"\x09" + good[8:], "truncated": good[:-3], "checksum": good[:-1] + bytes([good[-1] ^ 1])}.items():
        with pytest.raises(persist.ReadError) as e:
            persist.from_bytes(bad)
        kinds[kind] = e.value.kind
    assert all(k == v for k, v in kinds.items())
    assert persist.crc32c(b"123456789") == 0xE3069283
    for name in ("m.json", "m.bin"):
        persist.save(linear_model(), tmp_path / name)
        assert (persist.load(tmp_path / name).weights == linear_model().weights).all()
    d = persist.to_dict(fixed_model())
    d["model"]["trees"][0]["left"][0] = 0
    with pytest.raises(persist.ReadError):
        persist.from_dict(d)


def test_table_form(spark, tmp_path):
    m = fixed_model()
    persist.write_table(m, spark, f"{tmp_path}/m")
    assert persist.read_table(spark, f"{tmp_path}/m").forest == m.forest
    bad = m.table(spark).where("node_id <> 3 OR tree_id <> 0")
    assert {(r.tree_id, r.node_id) for r in persist.invalid_nodes(bad).collect()} == {(0, 3)}
    assert "q < 25.5" in m.plot() and m.inspect()[0]["feature"] == "q"


@pytest.mark.parametrize("break_", [lambda t: t.left.__setitem__(0, 9), lambda t: t.left.__setitem__(0, 0), lambda t: t.right.__setitem__(0, t.left[0]), lambda t: t.add()])
def test_invalid_trees(break_):
    t = random_tree(np.random.default_rng(1))
    while t.n_nodes < 3:
        t = random_tree(np.random.default_rng(2))
    break_(t)
    with pytest.raises(InvalidModel):
        t.validate()


def test_tree_shap_matches_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(12):
        t = random_tree(rng, 3, 3)
        x = rng.normal(size=(5, 3)).round()
        x[0, 0] = np.nan

        def value(node, row, known):
            if t.feature[node] < 0:
                return t.value[node]
            a, b, f = t.left[node], t.right[node], t.feature[node]
            if f in known:
                v = row[f]
                goes = t.default_left[node] if np.isnan(v) else (v in t.left_cats[node]) if node in t.left_cats else v < t.threshold[node]
                return value(a if goes else b, row, known)
            s = t.cover[a] + t.cover[b]
            return (t.cover[a] * value(a, row, known) + t.cover[b] * value(b, row, known)) / s

        got = explain.tree_shap(Forest([t], [0.25]), x)
        for i, row in enumerate(x):
            for f in range(3):
                phi = 0.0
                others = [g for g in range(3) if g != f]
                for k in range(3):
                    for s in itertools.combinations(others, k):
                        weight = math.factorial(k) * math.factorial(2 - k) / math.factorial(3)
                        phi += weight * (value(0, row, {*s, f}) - value(0, row, set(s)))
                assert abs(phi - got[i, f, 0]) < 1e-9
        assert np.abs(got.sum(axis=1)[:, 0] - Forest([t], [0.25]).margins(x)[0]).max() < 1e-9


def test_converters():
    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [1, 0, 0], "split_conditions": [0.5, 0, 0], "default_left": [1, 0, 0], "base_weights": [0.0, -1.0, 2.0], "loss_changes": [3.0, 0, 0], "sum_hessian": [10, 4, 6]}
    doc = {"learner": {"learner_model_param": {"num_feature": "2", "num_class": "0", "base_score": "5E-1"}, "objective": {"name": "binary:logistic"}, "feature_names": ["a", "b"], "gradient_booster": {"name": "gbtree", "model": {"trees": [tree], "tree_info": [0]}}}}
    m = convert.from_xgboost(doc)
    assert m.forest.base == [0.0] and m.forest.margins(np.array([[0, 0.4], [0, 0.5], [0, np.nan]]))[0].tolist() == [-1, 2, -1] and m.features == ("a", "b")
    doc["learner"]["gradient_booster"] = {"name": "dart", "gbtree": {"model": {"trees": [tree], "tree_info": [0]}}, "weight_drop": [0.5]}
    assert convert.from_xgboost(doc).forest.margins(np.zeros((1, 2)))[0, 0] == -0.5
    doc["learner"]["gradient_booster"] = {"name": "gblinear", "model": {"weights": [1.0, 2.0, 0.25]}}
    assert convert.from_xgboost(doc).weights.ravel().tolist() == [1, 2, 0.25]
    lgb = {"num_tree_per_iteration": 1, "max_feature_idx": 1, "objective": "regression", "feature_names": ["a", "b"], "tree_info": [{"tree_structure": {"split_feature": 0, "threshold": 1.5, "decision_type": "<=", "default_left": True, "left_child": {"leaf_value": 1.0}, "right_child": {"split_feature": 1, "threshold": "0||2", "decision_type": "==", "left_child": {"leaf_value": 2.0, "leaf_features": [0], "leaf_coeff": [3.0], "leaf_const": 1.0}, "right_child": {"leaf_value": 4.0}}}}]}
    assert convert.from_lightgbm(json.loads(json.dumps(lgb))).forest.margins(np.array([[1.5, 0], [2, 2], [2, 1]]))[0].tolist() == [1, 7, 4]
    with pytest.raises(convert.ConvertError):
        convert.from_lightgbm({})


def test_estimators(spark):
    df = synthetic.regression(spark, 400, 3).withColumn("kind", F.when(F.col("f0") > 0, "up").otherwise("down")).withColumn("name", F.when(F.col("y") > 0.2, "hi").when(F.col("y") < -0.2, "lo").otherwise("mid"))
    got = GBDTRegressor(["f0", "f1", "f2", "kind"], "y", n_estimators=5).fit(df).predict(df)
    assert got.agg(F.corr("prediction", "y")).first()[0] > 0.8
    c = GBDTClassifier(["f0", "f1", "f2"], "name", n_estimators=4, learning_rate=0.3).fit(df)
    assert c.classes_ == ["hi", "lo", "mid"] and c.predict(df).where("prediction = name").count() > 300
    assert c.predict_proba(df).where(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).count() == 0
    two = GBDTClassifier(["f0", "f1"], "kind", n_estimators=2).fit(df)
    assert two.predict(df).where("prediction = kind").count() >= 395
    lin = GBLinearRegressor(["f0", "f1", "f2"], "y", l2=0.0, n_estimators=60, update_strategy="sequential").fit(df)
    assert lin.predict(df).agg(F.corr("prediction", "y")).first()[0] > 0.99
    with pytest.raises(ValueError):
        GBDTRegressor(["f0"], "y", objective="logistic")


def test_linear_booster(spark):
    df = synthetic.regression(spark, 500, 4, noise=0.0)
    ds = Dataset.from_dataframe(df, [f"f{i}" for i in range(4)], "y", row="_row")
    for strategy, selector in (("shotgun", "cyclic"), ("sequential", "shuffle"), ("sequential", "random"), ("sequential", "greedy"), ("sequential", "thrifty")):
        m = gblinear.train(ds, gblinear.GBLinearConfig(n_estimators=80, update_strategy=strategy, selector=selector))
        err = m.transform(df).agg(F.max(F.abs(F.col("prediction")[0] - F.col("y")))).first()[0]
        assert err < 0.02, (strategy, selector, err)
    assert abs(gblinear.coordinate_step(0.0, 1.0, 2.0, 3.0, 0.0, 1.0)) == 0
    with pytest.raises(gblinear.GBLinearError):
        gblinear.train(Dataset.from_dataframe(df.withColumn("c", F.lit("x")), ["f0", "c"], "y"))


def test_builders_and_errors(spark):
    b = DatasetBuilder(spark).add_feature([1, 2, 3], "a").add_categorical([0, 2, 0], "c").add_sparse([1], [5.0], 3, "s")
    ds = b.labels([0, 1, 0]).weights([1, 1, 2]).build()
    assert ds.features == ("a", "c", "s") and ds.categorical == {"c"} and [tuple(r)[1:] for r in ds.df.orderBy("_row").collect()] == [(1, 0, 0, 0, 1), (2, 1, 5, 1, 1), (3, 0, 0, 0, 2)]
    for kind, f in {
        "empty_features": lambda: DatasetBuilder(spark).build(), "shape_mismatch": lambda: DatasetBuilder(spark).add_feature([1]).add_feature([1, 2]), "duplicate_index": lambda: DatasetBuilder(spark).add_sparse([1, 1], [1, 1], 3),
        "unsorted_index": lambda: DatasetBuilder(spark).add_sparse([2, 1], [1, 1], 3), "index_out_of_bounds": lambda: DatasetBuilder(spark).add_sparse([3], [1], 3),
    }.items():
        with pytest.raises(DatasetError) as e:
            f()
        assert e.value.kind == kind


def test_interpolated_quantiles_take_the_same_jobs_for_any_number_of_values(spark):
    def jobs(n):
        df = spark.range(n).selectExpr("IF(id % 7 = 3, NULL, CAST(id AS DOUBLE)) AS y", "1.0 + id % 3 AS w")
        spark.sparkContext.setJobGroup(f"quantiles {n}", "")
        got = E.weighted_quantile_interpolated(df, "y", "w", [0.05, 0.5, 0.95])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        v = np.arange(n, dtype=float)[np.arange(n) % 7 != 3]
        w = 1.0 + v % 3
        assert np.abs(np.array(got) - np.interp([0.05, 0.5, 0.95], np.cumsum(w) / w.sum(), v)).max() < 1e-6
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"quantiles {n}"))

    assert jobs(5_000) == jobs(900_000)
    df = spark.createDataFrame([(2.0, 1.0)], "y double, w double")
    assert E.weighted_quantile_interpolated(df, "y", None, [0.1, 0.9]) == [2.0, 2.0]


def test_quantile_measures_and_tests(spark):
    df = spark.createDataFrame([(float(i), 1.0 + i % 3, float(i % 5)) for i in range(50)], "y double, w double, p double")
    v, w = np.arange(50.0), np.array([1.0 + i % 3 for i in range(50)])
    want = np.interp([0.1, 0.5, 0.95], np.cumsum(w) / w.sum(), v)
    assert np.abs(np.array(E.weighted_quantile_interpolated(df, "y", "w", [0.1, 0.5, 0.95])) - want).max() < 1e-9
    assert abs(O.weighted_quantile(df, "y", "w", 0.3) - v[np.searchsorted(np.cumsum(w), 0.3 * w.sum())]) < 1e-12
    assert abs(E.student_tail(2.228138852, 10) - 0.05) < 1e-6 and abs(E.student_tail(12.706204736, 1) - 0.05) < 1e-6
    assert E.differs([1, 1.1, 0.9], [2, 2.1, 1.9]) and not E.differs([1, 2, 3], [1.5, 2.5, 2]) and not E.differs([1], [2])
    assert E.is_regression(1.03, 1.0, "rmse") and not E.is_regression(1.03, 1.0, "accuracy")
    with pytest.raises(ValueError):
        E.rcrps(df, ["p"], "y", [0.5, 0.2])


def test_scores_a_stream(spark, tmp_path):
    from thicket.streaming import score

    m = fixed_model()
    src = spark.range(20).selectExpr("cast(id as double) * 3 as q", "cast(id as double) / 100 as disc", "CASE WHEN id % 2 = 0 THEN 'A' ELSE 'N' END AS flag", "timestamp_seconds(id * 600) AS ts", "1.0D AS y")
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = score.windowed_error(stream, m, "ts", "y").writeStream.format("memory").queryName("windowed_error").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windowed_error").agg(F.sum("n")).first()[0] == 20


def test_auc_of_very_many_scores_is_exact_and_repeats(spark):
    from pyspark.sql import functions as F

    from thicket.functions import metrics as M

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    df = spark.range(0, 1_200_000, 1, 16).select(((F.xxhash64("id") % 1_000_003) / 1_000_003 + F.col("id") * 1e-9).alias("p"), F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1000)).alias("u"))
    df = df.select("p", F.when(F.col("u") / 1000 < 0.5 + F.col("p") / 3, 1.0).otherwise(0.0).alias("y"))
    got = [M.auc(df, "p", "y").first()[0] for _ in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    t = df.toPandas()
    s = np.rint(t["p"].to_numpy() / 1e-10)
    _, at, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    y = t["y"].to_numpy()
    pos = y.sum()
    want = (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))
    assert len(n) > 1_000_000 and len(set(got)) == 1 and abs(got[0] - want) < 1e-9


def test_labels_of_several_outputs_stay(spark):
    x, y = np.arange(12.0).reshape(6, 2), np.stack([np.arange(6.0), -np.arange(6.0)])
    for labels in (y, y.T):
        ds = Dataset.from_numpy(spark, x, labels)
        assert (ds.label, ds.more_labels, ds.n_outputs) == ("y", ("y1",), 2)
        assert [(r.y, r.y1) for r in ds.df.orderBy("_row").collect()] == [(i, -i) for i in range(6)]
    with pytest.raises(DatasetError):
        Dataset.from_numpy(spark, x, np.zeros((3, 4)))


def test_sparse_entries(spark):
    e = spark.createDataFrame([(1, "a", 2.0), (3, "b", None), (3, "a", 4.0), (9, "a", 1.0)], "row long, feature string, value double")
    rows = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 2.0)], "row long, y double")
    ds = Dataset.from_long(e, ["a", "b"], rows=rows, label="y")
    assert [(r["_row"], r.a, r.b, r.y) for r in ds.df.orderBy("_row").collect()] == [(1, 2.0, 0.0, 0.5), (2, 0.0, 0.0, 1.0), (3, 4.0, None, 2.0)]
    for bad, kind in ((e.union(e.limit(1)), "duplicate_index"), (e, "index_out_of_bounds")):
        with pytest.raises(DatasetError) as error:
            Dataset.from_long(bad, ["a", "b"] if kind == "duplicate_index" else ["a"])
        assert error.value.kind == kind


def test_very_many_categories_are_a_joined_table(spark):
    from thicket.sources import dataset as D

    df = spark.range(5000).select("id", F.concat(F.lit("c"), F.col("id") % 2500).alias("c"), (F.col("id") % 7).cast("double").alias("y"))
    ds = Dataset.from_dataframe(df, ["c"], "y", row="id")
    assert len(ds.categories["c"]) == 2500 > D.MOST_INLINE
    place = {v: i for i, v in enumerate(ds.categories["c"])}
    assert all(r.c == place[f"c{r['_row'] % 2500}"] for r in ds.df.collect())
    t = Tree()
    t.add(cover=2.0)
    a, b = t.split(0, 0, 0.0, False, left_cats=range(100))
    t.value[a], t.value[b] = 1.0, 2.0
    m = GBDTModel(Forest([t], [0.0]), ("c",), categories=ds.categories)
    got = m.transform(df.union(spark.createDataFrame([(-1, "unknown", 0.0)], df.schema))).collect()
    assert all(r.prediction[0] == (1.0 if place.get(r.c, 999) < 100 else 2.0) for r in got) and len(got) == 5001 and set(got[0].asDict()) == {"id", "c", "y", "raw", "prediction"}

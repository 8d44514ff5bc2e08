"""Training against a single-node twin, and its invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions import metrics as M
from thicket.functions import objectives as O
from thicket.operators.linear_leaf import LinearLeafConfig
from thicket.operators.model import GBDTModel
from thicket.operators.split import SplitParams, find, leaf_weight
from thicket.plans.gbdt import EarlyStopping, GBDTConfig, train
from thicket.sources.dataset import Dataset


def data(n=600, seed=0, missing=True):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n).round(1), rng.integers(0, 7, n)]).astype(float)
    y = 2 * x[:, 0] + np.sin(x[:, 1]) * 4 + np.where(np.isin(x[:, 2], [1, 4, 6]), 9.0, 0.0) + rng.normal(size=n) * 0.1
    if missing:
        x[rng.random(n) < 0.1, 1] = np.nan
    return x, y


def twin(x, y, w, c, cats=()):
    """One depth-wise boosting run in plain numpy on exact bins."""
    d = x.shape[1]
    values = [np.unique(x[~np.isnan(x[:, f]), f]) for f in range(d)]
    has = [f in cats or np.isnan(x[:, f]).any() for f in range(d)]
    bins = np.stack([np.where(np.isnan(x[:, f]), len(values[f]), np.searchsorted(values[f], np.nan_to_num(x[:, f]))) for f in range(d)])
    n_bins = np.array([len(v) + h for v, h in zip(values, has, strict=True)])
    p = np.full(len(y), np.average(y, weights=w))
    for _ in range(c.n_estimators):
        g, h = w * (p - y), w.copy()
        new = np.zeros(len(y))
        level = [np.arange(len(y))]
        for depth in range(c.max_depth + 1):
            following = []
            for rows in level:
                total = np.array([g[rows].sum(), h[rows].sum(), len(rows)])
                hist = np.zeros((d, n_bins.max(), 3))
                for f in range(d):
                    for j, v in enumerate((g[rows], h[rows], np.ones(len(rows)))):
                        hist[f, :, j] = np.bincount(bins[f, rows], v, n_bins.max())
                s = find(hist, total, n_bins, np.array([f in cats for f in range(d)]), np.array(has), c.split) if depth < c.max_depth else None
                if s is None or s.gain <= c.min_gain_to_split:
                    new[rows] = c.learning_rate * leaf_weight(total[0], total[1], c.split)
                    continue
                b = bins[s.feature, rows]
                goes = np.isin(b, s.left_cats) if s.left_cats is not None else b <= s.bin
                if has[s.feature]:
                    goes = np.where(b == n_bins[s.feature] - 1, s.default_left, goes)
                following += [rows[goes], rows[~goes]]
            level = following
        p = p + new
    return p


@pytest.mark.parametrize("cats", [(), (2,)])
@pytest.mark.parametrize("weighted", [False, True])
def test_matches_the_single_node_twin(spark, cats, weighted):
    x, y = data()
    w = np.random.default_rng(1).random(len(y)) + 0.5 if weighted else np.ones(len(y))
    ds = Dataset.from_numpy(spark, x, y, w if weighted else None, categorical_features=cats)
    c = GBDTConfig(n_estimators=4, max_depth=4, learning_rate=0.3, min_samples_leaf=3)
    model = GBDTModel.train(ds.with_df(ds.df.repartition(5)), c)
    got = model.transform(ds.df).orderBy("_row").select("_row", F.col("prediction")[0].alias("p")).collect()
    assert np.abs(np.array([r.p for r in got]) - twin(x, y, w, c, cats)).max() < 1e-6
    model.forest.validate(3)


def test_leafwise_fits_and_respects_its_leaves(spark):
    x, y = data()
    ds = Dataset.from_numpy(spark, x, y)
    got = train(ds, GBDTConfig(n_estimators=3, growth="leafwise", n_leaves=8, min_samples_leaf=5))
    assert all(len(t.leaves) <= 8 for t in got.forest.trees)
    p = got.forest.margins(x)[0]
    assert np.sqrt(np.mean((p - y) ** 2)) < 0.6 * y.std()


@pytest.mark.parametrize("objective", [O.absolute(), O.quantile([0.2, 0.8]), O.pseudo_huber(), O.logistic(), O.hinge(), O.softmax_loss(3), O.poisson()])
def test_losses_beat_their_base(spark, objective):
    x, y = data(400)
    if objective.name in ("logistic", "hinge"):
        y = (y > np.median(y)).astype(float)
    elif objective.name == "softmax":
        y = np.digitize(y, np.quantile(y, [1 / 3, 2 / 3])).astype(float)
    elif objective.name == "poisson":
        y = np.abs(y).round()
    ds = Dataset.from_numpy(spark, x, y)
    metric = M.get(objective.metric, alphas=(0.2, 0.8))
    got = train(ds, GBDTConfig(objective=objective, metric=metric, n_estimators=2, max_depth=3))
    first, last = got.history[0], got.history[-1]
    name = f"train-{metric.name}"
    assert (last[name] >= first[name]) if metric.higher_is_better else (last[name] <= first[name] + 1e-12) or objective.name == "poisson"
    if objective.name == "quantile":
        low, high = got.forest.margins(x)
        assert low.mean() < high.mean()


def test_absolute_loss_leaves_are_medians(spark):
    x, y = data(300, missing=False)
    ds = Dataset.from_numpy(spark, x, y)
    got = train(ds, GBDTConfig(objective=O.absolute(), n_estimators=1, max_depth=2, learning_rate=1.0))
    t = got.forest.trees[0]
    leaf = t.route(x)
    r = y - got.forest.base[0]
    for k in t.leaves:
        own = np.sort(r[leaf == k])
        assert abs(t.value[k] - own[int(np.ceil(0.5 * len(own))) - 1]) < 1e-6


def test_sampling_early_stopping_and_columns(spark):
    x, y = data(800)
    ds = Dataset.from_numpy(spark, x, y)
    a = train(ds, GBDTConfig(n_estimators=2, subsample=0.5, colsample_bytree=0.5, colsample_bynode=0.5, seed=3)).forest
    b = train(ds.with_df(ds.df.repartition(7)), GBDTConfig(n_estimators=2, subsample=0.5, colsample_bytree=0.5, colsample_bynode=0.5, seed=3)).forest
    assert np.abs(a.margins(x) - b.margins(x)).max() < 1e-9
    g = train(ds, GBDTConfig(n_estimators=4, learning_rate=0.5, goss=(0.2, 0.2))).forest
    assert np.mean((g.margins(x)[0] - y) ** 2) < 0.5 * y.var()
    noise = Dataset.from_numpy(spark, x[:200], np.random.default_rng(0).normal(size=200))
    stopped = train(ds, GBDTConfig(n_estimators=6, metric=M.get("rmse"), early_stopping_rounds=1), noise)
    assert stopped.best_iteration == len(stopped.forest.trees) and len(stopped.history) <= 6
    with pytest.raises(ValueError):
        train(ds, GBDTConfig(early_stopping_rounds=2))


def test_linear_leaves_help_on_linear_data(spark):
    rng = np.random.default_rng(0)
    x = rng.random((1500, 2))
    y = 3 * x[:, 0] + 2 * x[:, 1] + rng.uniform(-0.17, 0.17, 1500)
    ds = Dataset.from_numpy(spark, x, y)
    errors = []
    for linear in (None, LinearLeafConfig()):
        f = train(ds, GBDTConfig(n_estimators=4, max_depth=3, linear_leaves=linear)).forest
        errors.append(np.sqrt(np.mean((f.margins(x)[0] - y) ** 2)))
    assert errors[1] < 0.95 * errors[0]


def test_odd_inputs(spark):
    ds = Dataset.from_numpy(spark, np.full((20, 2), 5.0), np.arange(20.0))
    f = train(ds, GBDTConfig(n_estimators=2)).forest
    assert all(t.n_nodes == 1 for t in f.trees) and abs(f.margins(np.zeros((1, 2)))[0, 0] - 9.5) < 1e-9
    with pytest.raises(ValueError):
        train(Dataset.from_numpy(spark, np.ones((3, 1))))
    with pytest.raises(ValueError):
        GBDTConfig(subsample=0)
    s = EarlyStopping(2, False)
    assert [s.update(v) for v in (3, 2, 2, 2)] == ["improved", "improved", "continue", "stop"]
    assert find(np.zeros((1, 2, 3)), np.zeros(3), np.array([2]), np.array([False]), np.array([False]), SplitParams()) is None


def same(a, b):
    return [vars(t) for t in a.trees] == [vars(t) for t in b.trees]


def test_a_round_costs_the_same_however_long_the_forest(spark):
    """Without memory for margins a job adds the trees since the last write, never the whole forest; trees and metrics are those of one twin."""
    from thicket.plans.gbdt import Trainer

    x, y = data()
    ds = Dataset.from_numpy(spark, x[:400], y[:400])
    valid = Dataset.from_numpy(spark, x[400:], y[400:])
    c = GBDTConfig(n_estimators=7, max_depth=2, margin_rounds=3, margin_bytes=0, min_samples_leaf=3)
    trainer, metric = Trainer(ds, c, valid), M.get("rmse")
    for _ in range(c.n_estimators):
        trainer.round()
        assert len(trainer.state.trees) < c.margin_rounds
    p = trainer.evaluate("valid", metric)
    from thicket.operators.forest import Forest

    forest = Forest(trainer.made, trainer.base)
    assert abs(p - np.sqrt(np.mean((forest.margins(x[400:])[0] - y[400:]) ** 2))) < 1e-9
    assert np.abs(forest.margins(x[:400])[0] - twin(x[:400], y[:400], np.ones(400), c)).max() < 1e-6
    trainer.close()


def test_evicted_histograms_are_counted_again(spark):
    x, y = data(300)
    ds = Dataset.from_numpy(spark, x, y, categorical_features=[2])
    for growth in ("depthwise", "leafwise"):
        a, b = (train(ds, GBDTConfig(n_estimators=2, max_depth=3, n_leaves=6, growth=growth, histogram_bytes=n)).forest for n in (0, 1 << 30))
        assert np.abs(a.margins(x) - b.margins(x)).max() < 1e-9 and [t.feature for t in a.trees] == [t.feature for t in b.trees]


def test_pool_keeps_the_last_used():
    from thicket.plans.gbdt import HistogramPool

    pool = HistogramPool(3 * 80)
    for i in range(3):
        pool[0, i] = np.zeros(10)
    assert pool.use((0, 0)) is not None
    pool[0, 3] = np.zeros(10)
    assert sorted(pool) == [(0, 0), (0, 2), (0, 3)] and pool.held == 240 and pool.use((0, 1)) is None


def test_bundled_columns_give_the_same_trees(spark):
    from thicket.operators.binning import BinningConfig
    from thicket.plans.gbdt import Trainer

    rng = np.random.default_rng(4)
    n = 900
    hot = rng.integers(0, 30, n)
    x = np.column_stack([rng.normal(size=n).round(1), *((hot == k) * float(rng.integers(1, 4)) for k in range(25))])
    x[:, 3] = np.where(rng.random(n) < 0.02, np.nan, x[:, 3])
    y = x[:, 0] + np.isin(hot, [2, 5, 9, 20]) * 4.0 + rng.normal(size=n) * 0.1
    ds = Dataset.from_numpy(spark, x, y, categorical_features=range(1, 26))
    configs = [GBDTConfig(n_estimators=3, max_depth=4, binning=BinningConfig(enable_bundling=on)) for on in (True, False)]
    trainer = Trainer(ds, configs[0])
    assert trainer.bundles and trainer.state.layout.height < 12 < len(trainer.mappers)
    trainer.close()
    a, b = (train(ds, c).forest for c in configs)
    assert np.abs(a.margins(x) - b.margins(x)).max() < 1e-9
    assert [t.feature for t in a.trees] == [t.feature for t in b.trees] and any(f > 0 for t in a.trees for f in t.feature)


def test_goss_keeps_exactly_the_greatest(spark):
    from thicket.plans.gbdt import Trainer

    x, y = data(700)
    w = np.random.default_rng(2).random(700)
    trainer = Trainer(Dataset.from_numpy(spark, x, y, w), GBDTConfig(learning_rate=1.0, goss=(0.2, 0.1)))
    trainer.round()  # the warm-up
    m = trainer.made[0].predict(x) + trainer.base[0]
    size = np.sort(np.abs(w * (m - y) * w))[::-1]
    least, share, scale = trainer.goss_bounds()
    assert abs(least - size[139]) < 1e-12
    above = int((size >= least).sum())
    assert abs(share - 70 / (700 - above)) < 1e-12 and abs(scale - 560 / 70) < 1e-9
    trainer.close()


def test_bounds_come_from_the_values_of_all_rows(spark):
    from thicket.operators.binning import BinningConfig, fit, wanted_ranks
    from thicket.queries import rounded

    n = 250_000
    v = np.random.default_rng(8).permutation(n) * 0.5 - 20_000.0
    (m,) = fit(Dataset.from_numpy(spark, v[:, None]), BinningConfig(max_bins=64))
    s = np.sort(v)
    assert m.bounds[:-1] == tuple((s[r] + s[r + 1]) / 2 for r in wanted_ranks(n, 64))
    assert rounded(-480.6837665) == -480.683767 and rounded(2.5, 0) == 3.0


def test_workers_remember_no_margins_that_the_blocks_have(spark):
    """A view of a block's own margins would keep its whole batch; base margins need no memory."""
    from thicket.plans import kernel as K

    K._margins.clear()
    K._held = 0
    layout = K.layout_of(np.array([4]))
    state = K.State("one", [], [0.5, 1.5], np.array([-1]), lambda m, y, w: (m, m), layout)

    def block(i, stored):
        n = 100
        m = np.full((2, n), 3.0) if stored else np.empty(0)
        return K.Block(i, n, np.arange(n, dtype=np.uint16)[None] % 4, np.zeros(n), np.ones(n), m, None, np.empty(0))

    for i in range(4):
        assert (K.margins(state, block(i, True)) == 3.0).all() and (K.margins(state, block(i, False)) == [[0.5], [1.5]]).all()
    assert not K._margins and not K._held


def test_what_workers_remember_stays_within_its_bytes():
    """Of more blocks than fit, the first stay, so a pass over all finds them again; another run's go first."""
    from dataclasses import replace

    from thicket.plans import kernel as K

    K._margins.clear()
    K._held = 0
    n = 100
    state = K.State("one", [K.BinTree(value=[1.0])], [0.5], np.array([-1]), lambda m, y, w: (m, m), K.layout_of(np.array([4])), memory=3 * 8 * n)
    made = [K.Block(i, n, np.zeros((1, n), np.uint16), np.zeros(n), np.ones(n), np.empty(0), None, np.empty(0)) for i in range(6)]
    for state in (state, replace(state, run="one", trees=state.trees * 2), replace(state, run="two")):
        for b in made:
            assert (K.margins(state, b) == 0.5 + len(state.trees)).all()
            assert K._held <= state.memory and K._held == sum(m.nbytes for _, m in K._margins.values())
        assert sorted(K._margins) == [(state.run, i) for i in range(3)]


def test_a_first_round_leaves_nothing_in_a_worker():
    import pyarrow as pa

    from thicket.plans import kernel as K

    K._margins.clear()
    K._held = 0
    n = 50
    state = K.State("first", [], [0.5], np.array([-1]), lambda m, y, w: (w * (m - y), w[None]), K.layout_of(np.array([4])))
    bins = (np.arange(n) % 4).astype(np.uint16)
    made = pa.RecordBatch.from_pydict({"block": [1, 2], "n": pa.array([n, n], pa.int32()), "bins": [bins.tobytes()] * 2, "y": [np.ones(n).tobytes()] * 2, "w": [np.ones(n).tobytes()] * 2, "m": [b""] * 2})
    tree = K.BinTree()
    tree.split(0, 0, 1, False, None)
    got = pa.Table.from_batches(K.histogram_job(state, {0: tree}, {0: [1, 2]})(iter([made])))
    assert got["n"].to_pylist() == [26.0, 26.0, 24.0, 24.0] and got["g"].to_pylist() == [-13.0, -13.0, -12.0, -12.0]
    assert not K._margins and not K._held

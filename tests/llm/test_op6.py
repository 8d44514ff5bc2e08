import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from thicket.llm import op6_ann as op


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = op.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, ids, k):
    out = []
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, x in {i: v for i, v in fine if i in ids}.items():
        d = sorted({(math.dist(x, v), i) for i, v in fine if i != q})
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d[:k])]
    return sorted(out)


def test_search_matches_brute_force_over_copies_and_odd_vectors(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(1000, 1400)]  # one vector of a third of the rows
    rows += [(3000, None), (3010, [0.0] * 6), (3020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3030, [float("nan")] * 6), (3040, [float("inf")] * 6), (3050, []), (None, [1.0] * 6), (10, rows[10][1])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, rep long").repartition(6)
    got = sorted(tuple(r) for r in op.search(df, F.col("vec_id") % 10 == 0, k=10, curves=3).neighbours.collect())
    want = brute(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, 10)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    hit = len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) / len(want)
    assert hit >= 0.9
    at = {i: v for i, v in rows}
    assert all(abs(math.dist(at[q], at[i]) - s) < 1e-12 for q, _, i, s in got)
    hot = [r for r in got if r[0] == 1000]
    assert [r[2] for r in hot] == [3, *range(1001, 1010)]


def test_few_rows(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in op.search(df, F.col("vec_id") % 100 == 0).neighbours.collect()] == [(100, 1, 1, 0.5)]
    assert op.search(df.limit(0), F.col("vec_id") % 100 == 0).neighbours.count() == 0
    assert op.search(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).neighbours.count() == 0


def recall_on(spark, x):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)
    found = op.search(df, F.col("vec_id") % 100 == 0)
    got = {(r.query_id, r.vec_id): r.score for r in found.neighbours.collect()}
    hit = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.argsort(d, kind="stable")[:10]
        hit += sum((q, int(i)) in got for i in true)
        assert all(abs(got[q, int(i)] - d[i]) < 1e-9 for i in true if (q, int(i)) in got)
    assert len(got) == 10 * len(range(0, len(x), 100))
    return hit / len(got), found


def test_recall_on_a_surface_with_windows_far_below_the_table(spark):
    """20,000 vectors of 64 components near a surface of 3 dimensions: windows hold a small part of the table."""
    rng = np.random.default_rng(0)
    x = np.tanh(rng.standard_normal((20_000, 3)) @ rng.standard_normal((3, 64))).astype(np.float32)
    recall, found = recall_on(spark, x)
    assert recall >= 0.9 and found.recall >= 0.95 and 2 * found.window < 20_000 / 10


def test_recall_without_any_structure(spark):
    """Where no order can help, windows grow until the recall holds."""
    x = np.random.default_rng(1).standard_normal((12_000, 64)).astype(np.float32)
    recall, found = recall_on(spark, x)
    assert recall >= 0.9 and found.recall >= 0.95

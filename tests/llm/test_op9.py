import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import re
import xxhash

from thicket.llm import op9_simhash as op


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones.update(k for k in range(64) if h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


TEXTS = ["", None, " \n", "one", "Two WORDS", "a b c", "a b c d a b c", "é x y Straße \x1f z", " lead and trail \t", "x" * 5000, "w " * 3000]


def test_fingerprints_match_brute_force():
    assert op.fingerprints(pa.array(TEXTS), 3).tolist() == [slow_fingerprint(t) for t in TEXTS]
    assert op.fingerprints(pa.array([], pa.string()), 3).tolist() == []


def test_linked_pairs_share_an_anchor():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        code, first = op.anchors(np.array([x, y], np.uint64))
        a, b = (set(code[i][first[i]].tolist()) for i in (0, 1))
        assert a & b and max(len(a), len(b)) <= 32


def brute_components(fps, ids):
    label = {}
    for i in range(len(fps)):
        seen, queue = {i}, [i]
        while queue:
            k = queue.pop()
            for j in range(len(fps)):
                if j not in seen and bin(fps[k] ^ fps[j]).count("1") <= 2:
                    seen.add(j)
                    queue.append(j)
        known = [ids[j] for j in seen if ids[j] is not None]
        label[i] = min(known) if known else None
    return label


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(120)) for _ in range(12)]
    texts = [*TEXTS]
    for t in base:
        texts += [t, t, *(" ".join(w if rng.random() > 0.01 else "changed" for w in t.split()) for _ in range(6))]
    rows = [(i if i % 17 else None, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string"), rows


def test_components_match_brute_force(spark, near):
    df, rows = near
    made, classes = op.near_classes(df.select("doc_id", "text"), ["doc_id"])
    got = Counter((r[0], r[1]) for r in op.component_ids(made, classes).select("doc_id", "component_id").collect())
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    label = brute_components(fps, [r[0] for r in rows])
    assert got == Counter((r[0], label[i]) for i, r in enumerate(rows))


def test_keep_one_keeps_one_of_each_class(spark, near):
    df, rows = near
    df = df.union(df.limit(3))
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    kept = op.keep_one(df).collect()
    assert len({r[2] for r in kept}) == 1 and kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    n = 0
    seen = set()
    for i in range(len(fps)):
        if i in seen:
            continue
        n += 1
        queue = [i]
        seen.add(i)
        while queue:
            k = queue.pop()
            for j in range(len(fps)):
                if j not in seen and bin(fps[k] ^ fps[j]).count("1") <= 2:
                    seen.add(j)
                    queue.append(j)
    assert len(kept) == n


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, op.components(edges).collect()))
    assert {k: v for k, v in got.items() if k < 50} == {i: 0 for i in range(41)} and got[101] == got[100] == 100


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    made, classes = op.near_classes(df, ["doc_id"])
    assert op.component_ids(made, classes).count() == 0 and op.keep_one(df).count() == 0

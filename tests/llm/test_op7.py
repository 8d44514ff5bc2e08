import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from thicket.llm import op7_brown as op


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def corpus():
    rng = random.Random(0)
    words = [["the", "and", "thing", "was", "of"], ["le", "la", "eau", "que", "des"]]
    out = []
    for _ in range(300):
        w = words[rng.random() < 0.4]
        out.append(" ".join(rng.choice(w) if rng.random() < 0.7 else rng.choice(w) + rng.choice(w) + str(rng.randint(0, 30)) for _ in range(40)))
    return out + [None, "", " \t", "X" * 3000, "The THE", "The THE"]


def likelihood(n, label, classes):
    hot = np.eye(classes)[label]
    pair = hot.T @ n @ hot
    return op.xlogx(pair).sum() - op.xlogx(pair.sum(0)).sum() - op.xlogx(pair.sum(1)).sum()


def test_endings_are_taken_of_other_words_alone(monkeypatch):
    words = pa.array("the thing é the 水 was of thing x".split()).slice(1)
    ids, hashes, known = op.hash_words(words)
    assert [known[i].decode() for i in ids] == words.to_pylist() and len(set(known)) == len(known)
    assert hashes.view(np.uint64).tolist() == [xxhash.xxh64_intdigest(w) for w in known]
    units = op.Units(np.sort(hashes[:3]), 16)
    want = [units.heads.tolist().index(h) if h in units.heads else 3 + xxhash.xxh32_intdigest(w[-3:]) % 16 for h, w in zip(hashes.tolist(), known, strict=True)]
    asked, plain = [], op.ending
    monkeypatch.setattr(op, "ending", lambda known, endings: asked.extend(known) or plain(known, endings))
    assert units.of(hashes, known).tolist() == want and asked == known[3:]
    assert [len(x) for x in op.hash_words(pa.array([], pa.string()))] == [0, 0, 0]


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 30, (25, 25)).astype(float)
    n[:12, 12:] //= 10
    n[12:, :12] //= 10
    label = op.exchange(n, 5, rounds=50)
    assert label[-1] == 4 and (label[:-1] < 4).all()
    best = likelihood(n, label, 5)
    for u in range(24):
        for k in range(4):
            other = label.copy()
            other[u] = k
            assert likelihood(n, other, 5) <= best + 1e-6


@pytest.mark.parametrize("frequent", [5, 10_000])
def test_scores_match_brute_force(spark, frequent):
    rows = list(enumerate(corpus())) + [(None, "the null")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, h string").repartition(4)
    train = [t for i, t in rows if i is not None and i % 4]
    model = op.fit(df.where("doc_id % 4 <> 0"), seeds=8, endings=16, classes=6, frequent=frequent)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in op.score(df, model, ["doc_id"]).collect())
    c = Counter(w for t in train for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    assert (model.total, model.distinct) == (total, distinct)

    def label(w):
        if w is None:
            return model.label[-1]
        _, h, known = op.hash_words(op.pa.array([w]))
        return model.label[model.units.of(h, known)[0]]

    of = {w: label(w) for _, t in rows for w in tokens(t)}
    size, kinds, pair, row = Counter(), Counter(of[w] for w in c), Counter(), Counter()
    for t in train:
        before = of[None]
        for w in tokens(t):
            size[of[w]] += 1
            pair[before, of[w]] += 1
            row[before] += 1
            before = of[w]
    want = Counter()
    for i, t in rows:
        base = score = 0.0
        before = of[None]
        for w in tokens(t):
            k = of[w]
            base += math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1)))
            share = (size[k] + 0.5) / (total + 0.5 * 6)
            score += math.log10((pair[before, k] + 6 * share) / (row[before] + 6))
            if w is not None:
                score += math.log10((c[w] + 0.5) / (size[k] + 0.5 * (kinds[k] + 1)))
            before = k
        want[(i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(base, 6), round(score, 6))] += 1
    assert got == want
    held = [r for r in op.score(df, model, ["doc_id"]).collect() if r.doc_id is not None and r.doc_id % 4 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_frequent_word_has_the_best_class_of_its_own_contexts(spark):
    rows = [(i, t) for i, t in enumerate(corpus())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes, least = 6, 2
    model = op.fit(df, seeds=4, endings=8, classes=classes, least=least, rounds=0)
    c = Counter(w for _, t in rows for w in tokens(t) if w is not None)
    hashes = {w: int(op.hash_words(op.pa.array([w]))[1][0]) for w in c}
    # the clustered vocabulary is that of the corpus, not of a fixed size
    assert set(model.units.heads.tolist()) == {hashes[w] for w in c if c[w] >= least} and len(model.units.heads) > 400
    counted = op.count_pairs(df, "text", model.units, model.label.astype(int), classes, contexts=True)
    pair = op.pair_matrix(counted, classes)
    got = {r.word: r.label for r in op.moved(counted, pair, classes).collect()}
    label = {w: model.label[model.units.of(*op.hash_words(op.pa.array([w]))[1:])[0]] for w in c} | {None: model.label[-1]}
    left, right, want = {w: Counter() for w in c}, {w: Counter() for w in c}, np.zeros((classes, classes))
    for _, t in rows:
        before = None
        for w in tokens(t):
            want[label[before], label[w]] += 1
            if w is not None:
                left[w][label[before]] += 1
            if before is not None:
                right[before][label[w]] += 1
            before = w
    assert (pair == want).all()
    place = {h: i for i, h in enumerate(model.units.heads.tolist())}
    for w in c:
        if c[w] >= least:
            gain = [sum(n * math.log(pair[a, k] + 0.5) for a, n in left[w].items()) + sum(n * math.log(pair[k, b] + 0.5) for b, n in right[w].items()) - c[w] * (math.log(pair[k].sum() + 0.5) + math.log(pair[:, k].sum() + 0.5)) for k in range(classes - 1)]
            assert gain[got[place[hashes[w]]]] >= max(gain) - 1e-6
    # moving by contexts pays on the training text
    total = lambda m: sum(r.score for r in op.score(df, m, ["doc_id"]).collect())
    assert total(op.fit(df, seeds=4, endings=8, classes=classes, least=least, rounds=2)) > total(model)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x", 7)], "doc_id long, text string, _h int, score string, _row int")
    got = op.score(df, op.fit(df), df.columns)
    assert got.columns == ["doc_id", "text", "_h", "_row", "n_tokens", "n_known", "base_score", "score"] and got.first()[:4] == (1, "a b", 5, 7)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.score(df, op.fit(df), ["doc_id"]).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert op.score(one, op.fit(df), ["doc_id"]).first().n_known == 0

import random
import re
from collections import defaultdict

import pytest

from thicket.llm import op3_mixing as op


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets():
    assert op.targets([100, 100, 100], [5, 2, 1], 300) == [187.5, 75.0, 37.5]
    got = op.targets([10, 1000, 1000], [5, 2, 1], 2010)
    assert got[0] == 30 and abs(sum(got) - 2010) < 1e-9 and abs(got[1] - 2 * got[2]) < 1e-9
    assert op.targets([], [], 0) == [] and op.targets([0, 5], [5, 2], 5) == [0, 5]
    assert op.by_turns(["b", None, "\U0001F600", "￿", "a"]) == {"a": 5, "b": 2, "￿": 1, "\U0001F600": 5, None: 2}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, rng.choice(["hot"] * 6 + ["a", "b", "c", None, "tiny"][: 4 + (i % 50 == 0)]), "w " * rng.randint(0, 60)) for i in range(3000)]
    return out + [(5000, "a", None), (5001, "empty", ""), (5002, "long", "x " * 20_000), (None, "b", "null id " * 3), (7, "b", "again")]


def check(got, rows):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for s, n, own, goal, t in got:
        assert t in (0, n, 2 * n, 3 * n)
        size[s] += n
        taken[s] += t
        assert target.setdefault(s, (own, goal)) == (own, goal)
    names = sorted((s for s in size if s is not None)) + [None]
    want = op.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(size.values()))
    longest = defaultdict(int)
    for s, n, *_ in got:
        longest[s] = max(longest[s], n)
    for s, w in zip(names, want, strict=True):
        assert target[s][0] == size[s] and abs(target[s][1] - w) < 1e-6
        assert abs(taken[s] - w) <= longest[s] / 2 + 1e-6, (s, taken[s], w)


@pytest.mark.parametrize("parts", [1, 7])
def test_mix_meets_its_targets(spark, rows, parts):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, n long").repartition(parts)
    out = op.mix(df, op.n_words("text"))
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r._size == words(r.text)
    check([(r.source, r._size, r._source_size, r._target, r._taken) for r in got], rows)
    again = op.mix(df.repartition(3), op.n_words("text")).collect()
    assert sorted((str(r.doc_id), r.text or "", r._taken) for r in got) == sorted((str(r.doc_id), r.text or "", r._taken) for r in again)


def test_documents_too_long_for_what_is_left_are_skipped(spark):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 2], "w " * (rng.choice((4000, 9000, 20_000)) if i % 40 < 2 else rng.randint(1, 60))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    for seed in (17, 18, 19):
        taken, goal = defaultdict(int), {}
        for r in op.mix(df, op.n_words("text"), weights=lambda names: dict.fromkeys(names, 1.0), share=0.37, seed=seed).collect():
            taken[r.source] += r._taken
            goal[r.source] = r._target
        assert all(abs(taken[s] - goal[s]) <= 0.001 * goal[s] for s in "ab"), (taken, goal)


def test_repeated_rows_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = op.repeated(df)
    assert out.columns == df.columns
    assert abs(sum(words(r.text) for r in out.collect()) - sum(words(t) for _, _, t in rows)) < 40_000
    assert op.mix(df.limit(0), op.n_words("text")).count() == 0 and op.repeated(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, None, "a b")], "doc_id long, source string, text string")
    assert [tuple(r)[3:] for r in op.mix(one, op.n_words("text")).collect()] == [(2, 2, 2.0, 2)]


NAMES = ("_size", "_key", "_s", "_epochs", "_rest", "_low", "_extra", "_ps", "_p", "_left", "_target", "_taken", "_times", "_source_size", "n", "before")


def test_columns_of_any_name(spark):
    rows = [(i, "ab"[i % 2], "w " * (i + 1), *([777] * len(NAMES))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"`{n}` int" for n in NAMES)).coalesce(1)
    out = op.mix(df, op.n_words("text"))
    kept = [n for n in NAMES if n not in op.RESULTS]
    assert out.columns == ["doc_id", "source", "text", *kept, *op.RESULTS]
    got = out.collect()
    assert sorted(r.doc_id for r in got) == list(range(20)) and all(r["_size"] == r.doc_id + 1 for r in got)
    assert all(r[n] == 777 for r in got for n in kept)
    again = op.repeated(df)
    assert again.columns == df.columns and all(r[n] == 777 for r in again.collect() for n in NAMES)


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(op, "MOST_SOURCES", 2)
    df = spark.createDataFrame([(i, f"s{i}", "a") for i in range(4)], "doc_id long, source string, text string")
    with pytest.raises(ValueError, match="more than 2 sources"):
        op.mix(df, op.n_words("text"))

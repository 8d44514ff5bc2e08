"""The pipeline stage by stage on a small table, against plain versions of each decision."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from thicket.llm.common import stored
from thicket.llm.op5_pii import OPEN_KEY, Pseudonyms
from thicket.llm.op9_simhash import fingerprints

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=120):
    rng = random.Random(0)
    vocabulary = {"en": "the and thing tion er ing was of", "fr": "le la eau que des ment é aux"}
    rows = []
    for i in range(n):
        k = rng.choice(["en", "fr"])
        text = " ".join(rng.choice(vocabulary[k].split()) + rng.choice(vocabulary[k].split()) for _ in range(rng.randint(30, 200)))
        if i % 10 == 0:
            text += " call +1 (425) 555-0100 or 4111111111111111"
        rows.append((i, text, k if i % 7 else None, rng.choice(["a", "a", "b", None]), len(text)))
    rows += [(1000 + i, rows[i][1], rows[i][2], "b", rows[i][4]) for i in range(0, 40, 2)]  # exact copies
    rows += [(2000, None, "en", "a", 0), (2001, "", "en", "a", 0), (2002, "123 !!! 456", "en", "a", 11), (2003, "the thing " * 5000, "en", "c", 50_000), rows[5], (None, "la eau que des " * 9, "fr", "b", 1)]
    return rows


def classes(rows):
    fps = fingerprints(__import__("pyarrow").array([r[1] for r in rows]), 3).tolist()
    left, out = set(range(len(rows))), []
    while left:
        queue, seen = [left.pop()], set()
        while queue:
            i = queue.pop()
            seen.add(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= 2}
            left -= near
            queue += near
        out.append(seen)
    return out


def test_stages(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, str(tmp_path)))
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        seen.append((name, docs, out))
        docs = out
    got = {name: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for name, a, b in seen}

    before, after = got["language_id"]
    fine = [r for r in before if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert Counter((r[0], r[1], r[3]) for r in after) == Counter((r[0], r[1], r[3]) for r in fine) and all(r[2] for r in after)

    before, after = got["near_dedup"]
    assert len(after) == len(classes(before)) and not Counter(after) - Counter(before)
    ids = {r[0] for r in after}
    for c in classes(before):
        known = [before[i][0] for i in c if before[i][0] is not None]
        assert not known or min(known) in ids

    before, after = got["pii"]
    change = Pseudonyms(OPEN_KEY.encode())
    assert Counter((r[0], r[1]) for r in after) == Counter((r[0], change(r[1])[0]) for r in before)
    assert not any("4111111111111111" in r[1] or "555-0100" in r[1] for r in after)

    before, after = got["mixing"]
    n = lambda t: len(t.split())
    size, taken = defaultdict(int), defaultdict(int)
    for r in before:
        size[r[3]] += n(r[1])
    for r in after:
        taken[r[3]] += n(r[1])
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    from thicket.llm.op3_mixing import by_turns, targets

    names = list(size)
    weight = by_turns(names)
    for s, t in zip(names, targets([size[s] for s in names], [weight[s] for s in names], sum(size.values())), strict=True):
        assert abs(taken[s] - t) <= max(n(r[1]) for r in before if r[3] == s) / 2 + 1

    before, after = got["packing"]
    starts = Counter(r[0] for r in after if r[1] == 0)
    assert starts == Counter(r[0] for r in before)
    by = defaultdict(list)
    for r in after:
        by[r[5]].append((r[6], r[3]))
    for v in by.values():
        at = 0
        for o, k in sorted(v):
            assert o == at
            at += k
        assert at <= 2048
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

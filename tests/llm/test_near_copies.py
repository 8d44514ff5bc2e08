"""The pipeline's near copies against exact similarities of all pairs."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.conftest import ROOT
from thicket.llm import near_copies
from thicket.llm.op9_simhash import shingle_hashes


def edited(rng, text, changes):
    words = text.split()
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"changed{rng.randint(0, 10**6)}"
    return " ".join(words)


def texts():
    rng = random.Random(5)
    new = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    out = ["", None, " \n", "one", "One", "a b c", "a b  C", "a b c d", "x y " * 400]
    for n in (40, 100, 300):
        for _ in range(8):
            t = new(n)
            out += [t, t.upper(), *(edited(rng, t, k) for k in (1, 1, n // 60 + 1, n // 45 + 1, n // 20, n // 8))]
    # a chain, whose ends are far apart, and one band's many texts of which few are similar
    t = new(200)
    for _ in range(12):
        out.append(t)
        t = edited(rng, t, 3)
    shared = new(120)
    out += [f"{shared} {new(80)}" for _ in range(60)]
    return out


def classes(rows):
    offsets, hashes = shingle_hashes(pa.array(rows), 5)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    root = list(range(len(rows)))
    pairs = 0
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, pairs


@pytest.mark.parametrize("part", [near_copies.PART_TEXTS, 10])
def test_stage_keeps_one_of_each_class(spark, tmp_path, monkeypatch, part):
    """Blocks as wholes, and in parts of about ten texts: copies, a chain and texts with one long passage in common."""
    monkeypatch.setattr(near_copies, "PART_TEXTS", part)
    rows = texts()
    root, pairs = classes(rows)
    assert pairs > 150 and len(set(root)) > 80
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs = docs.union(docs.where("doc_id % 9 = 0"))  # equal rows
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert kept.dtypes == docs.dtypes and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_anchors_find_the_classes_without_bands(spark, tmp_path, monkeypatch):
    """Texts of more than SHORT shingles are found by their fingerprints' anchors alone."""
    monkeypatch.setattr(near_copies, "SHORT", 0)
    rows = [t for t in texts() if t and len(t.split()) >= 40]
    root, pairs = classes(rows)
    assert pairs > 150
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    monkeypatch.setattr(near_copies, "bands", None)
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


@pytest.mark.parametrize("anchors, shards", [(2_000_000, 1), (5_000, 1), (5_000, 8)])
def test_blocks_at_two_bits_meet(monkeypatch, anchors, shards):
    """Whole, in several passes and in shards: every pair of blocks at distance 2 or less with near fingerprints, and none with far ones."""
    monkeypatch.setattr(near_copies, "ANCHORS", anchors)
    rng = np.random.default_rng(1)
    points = np.zeros(1200, near_copies.POINT)
    points["id"] = rng.permutation(1200) + 7
    points["word"][:400] = rng.integers(0, 2**32, 400)
    points["check"][:400] = rng.integers(0, 2**32, (400, 4))
    points["word"][:20] = points["word"][0]  # a large cell
    points["check"][:20] = points["check"][0]
    points[400:800] = points[800:] = points[:400]
    points["id"] = rng.permutation(1200) + 7
    for i in range(400, 800):
        for bit in rng.choice(31, 2, replace=False).tolist():
            points["word"][i] ^= np.uint32(1 << bit)
        points["check"][i, 0] ^= np.uint32(2**32 - 1)
    points["check"][800:] = rng.integers(0, 2**32, (400, 4))
    root = {int(i): int(i) for i in points["id"]}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for shard in range(shards):
        for a, b in zip(*near_copies.meeting(points, shard, shards), strict=True):
            root[find(int(a))] = find(int(b))
    ids = points["id"].tolist()
    assert all(find(ids[i]) == find(ids[400 + i]) for i in range(400))
    assert len({find(i) for i in ids[:20]}) == 1 and len({find(i) for i in ids[:400]}) == 381
    assert all(find(i) == i for i in ids[800:])


def test_shards_find_the_same(spark, monkeypatch):
    """More texts than a task holds at once: blocks in shards of anchors."""
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 90, dtype=np.uint64)
        sets += [x, np.concatenate([x[:83], rng.integers(0, 2**63, 7, dtype=np.uint64)])]
    bits = near_copies.wide_fingerprints(sets)
    rows = spark.createDataFrame([(i, bytearray(b.tobytes())) for i, b in enumerate(bits)], "id long, bits binary").repartition(3)
    monkeypatch.setattr(near_copies, "POINTS", 50)
    got = {(r.a, r.b) if r.a < r.b else (r.b, r.a) for r in near_copies.candidates(rows).collect()}
    assert got == {(i, i + 1) for i in range(0, 120, 2)}


def test_bands_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    y = np.concatenate([x[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])  # 800 of 1000 shared
    keys = near_copies.bands(np.array([0, 900, 1800]), np.concatenate([x, y]))
    assert 2 <= (keys[0] == keys[1]).sum() <= 20  # 0.8 ** 6 * 40 = 10


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).count() == 0


def test_freed_memory_goes_back():
    """Pieces freed between pieces that stay: 200 MB that the process would hold for its next task."""
    code = """
import re
import numpy as np
from thicket.llm.common import give_back
mb = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
pieces = [np.ones(1 << (13 if i % 2 else 7)) for i in range(6400)]
kept = pieces[::2]
del pieces
held = mb()
give_back()
print(held - mb())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert float(out.stdout) > 100

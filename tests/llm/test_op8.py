import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from thicket.llm import op8_tokens as op
from thicket.llm.op4_packing import Encoder

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("size", [2, 6, 64])
def test_counts_match_brute_force(spark, size):
    rng = np.random.default_rng(size)
    rows, want = [], {}
    for f in range(6):
        ids = np.where(rng.random(400) < (0.02 if f % 2 else 0.4), 9, rng.integers(0, 9, 400)) if f else np.full(50, 1)
        data = ids.astype("<u2").tobytes()
        rows += [(f, 3 * b, data[k : k + size]) for b, k in enumerate(range(0, len(data), size))]
        cuts = [-1, *np.flatnonzero(ids == 9).tolist()]
        want[f] = ([b - a - 1 for a, b in zip(cuts, cuts[1:])], len(ids) - cuts[-1] - 1)
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(f, b, bytearray(d), 0) for f, b, d in rows], "file int, block long, data binary, head int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    got = {}
    for r in op.counts(df, 9).orderBy("file", "block").collect():
        v = got.setdefault(r.file, ([], []))
        v[0].extend(r.lengths)
        v[1].append(r.open)
    assert {f: (a, o[-1]) for f, (a, o) in got.items()} == want and all(x is None for _, o in got.values() for x in o[:-1])
    assert op.counts(df.limit(0), 9).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("block", [2, 8, 1 << 20])
def test_flat_files_name_their_documents(spark, block):
    rng = random.Random(1)
    rows = [(i if i % 7 else None, rng.choice([None, "", "a b", "long text " * 30, "one two three"])) for i in range(60)] + [(99, "a b"), (99, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = op.written(df, JSON, block_bytes=block).cache()
    e = Encoder(JSON)
    assert all(len(r.data) == block for r in blocks.collect() if r.block < max(x.block for x in blocks.collect() if x.file == r.file))
    found = op.counts(blocks).join(blocks.select("file", "block", "doc_ids"), ["file", "block"])
    got = found.select(F.explode(F.arrays_zip("lengths", "doc_ids")).alias("d")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.d.doc_ids, r.d.lengths) for r in got), key=key) == sorted(((i, len(e.plain(t or "")) // 4) for i, t in rows), key=key)
    assert {r.open for r in found.collect()} <= {None, 0}
    blocks.unpersist()


@pytest.mark.parametrize("size", [2, 10, 1 << 20])
def test_byte_ranges_of_real_files(spark, tmp_path, size):
    rng = np.random.default_rng(7)
    want = {}
    for f, n in (("a.bin", 5000), ("b.bin", 1), ("c.bin", 0), ("d.bin", 700)):
        ids = rng.integers(0, 40, n)
        ids[rng.random(n) < 0.01] = 9
        if f == "d.bin":
            ids[:] = 1  # no separator at all
        ids.astype("<u2").tofile(tmp_path / f)
        cuts = [-1, *np.flatnonzero(ids == 9).tolist()]
        if n:
            want[f] = ([b - a - 1 for a, b in zip(cuts, cuts[1:])], n - cuts[-1] - 1)
    got = {}
    for r in op.counts(op.ranges(spark, str(tmp_path), block_bytes=size), 9).orderBy("file", "block").collect():
        v = got.setdefault(r.file.rsplit("/", 1)[1], ([], []))
        v[0].extend(r.lengths)
        v[1].append(r.open)
    assert {f: (a, o[-1]) for f, (a, o) in got.items()} == want


def test_ids_must_fit_their_width(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(Exception, match="needs more than 1 bytes"):
        op.written(df, JSON, width=1).collect()


def test_a_very_long_text_over_many_blocks(spark):
    df = spark.createDataFrame([(1, "word here " * 200_000), (2, "<|endoftext|> end")], "doc_id long, text string").coalesce(1)
    blocks = op.written(df, JSON, block_bytes=4096)
    found = op.counts(blocks).join(blocks.select("file", "block", "doc_ids"), ["file", "block"]).select(F.explode(F.arrays_zip("lengths", "doc_ids")).alias("d")).collect()
    e = Encoder(JSON)
    assert {r.d.doc_ids: r.d.lengths for r in found} == {1: len(e.plain("word here " * 200_000)) // 4, 2: len(e.plain("<|endoftext|> end")) // 4}

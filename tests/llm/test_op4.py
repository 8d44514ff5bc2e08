import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from thicket.llm import op4_packing as op

JSON = public_tokenizers.path("byte_bpe_50k.json")


def tricky():
    rng = random.Random(2)
    out = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b c  d", "it's they'll  12 34abc!? <|endoftext|> x", "\x1f \x1c a", "日本語 テキスト", "word" * 300]
    for _ in range(200):
        out.append("".join(rng.choice(["a", "the", " ", " ", "\n", "\t", "é", "'s", "1", " ", "\x1d", "."]) for _ in range(rng.randint(0, 40))))
    return out


def test_encoder_matches_tokenizers():
    t = Tokenizer.from_file(JSON)
    e = op.Encoder(JSON, most=50)
    more = ["hi <|endoftext|> there", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n b", "<|endoftext", "  <|endoftext|>  "]
    for x in [*tricky(), *more]:
        assert np.frombuffer(e(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    t.encode_special_tokens = True
    for x in more:
        assert np.frombuffer(e.plain(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_knapsack_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        cap = 12
        price = np.concatenate([[0], np.where(rng.random(cap) < 0.5, rng.random(cap), 0)])
        best = np.zeros(cap + 1)
        for c in range(1, cap + 1):
            best[c] = max([best[c - 1]] + [price[k] + best[c - k] for k in range(1, c + 1)])
        value, choice = op.knapsack(price, cap)
        got = op.configuration(choice, cap)
        assert np.allclose(value, best) and sum(k * t for k, t in got.items()) <= cap and abs(sum(price[k] * t for k, t in got.items()) - best[cap]) < 1e-12


def checked(counts, capacity=2048):
    plan = op.pack_lengths(counts, capacity)
    used = np.zeros(capacity + 1, int)
    for config, times in plan.sequences:
        assert config.sum() <= capacity and times > 0
        np.add.at(used, config, times)
    assert (used == counts).all()
    assert plan.bound <= plan.total + 1e-6
    return plan


def test_the_program_places_nearly_all_sequences():
    rng = np.random.default_rng(3)
    for n, share in ((1_000, 0.75), (20_000, 0.9), (2_000_000, 0.99)):
        lengths = np.minimum(rng.lognormal(6, 1, n).astype(int) + 1, 2048)
        plan = checked(np.bincount(lengths, minlength=2049))
        assert plan.gap <= 0.01 and plan.total <= 1.005 * plan.bound + 2
        assert plan.by_program >= share * plan.total
    assert op.pack_lengths(np.zeros(2049, int)).sequences == []


def test_prices_prove_bounds_beyond_the_volume():
    # two of these never share a sequence, so the volume bound of 60 is far off
    plan = checked(np.bincount([6] * 60 + [7] * 40, minlength=11), 10)
    assert plan.total == 100 and plan.bound > 95
    rng = np.random.default_rng(5)
    for _ in range(20):
        checked(rng.integers(0, 9, 13) * np.r_[0, np.ones(12, int)], 12)


def test_packing_is_whole(spark):
    rng = random.Random(4)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(tricky())] + [(7, None), (7, "a b c"), (7, "a b c"), (1000, "long text here " * 4000)]
    rows += [(2000 + i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(1, 3000)))) for i in range(40)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, length int").repartition(5)
    got = op.pack(df, JSON).collect()
    encode = op.Encoder(JSON)
    want = []
    for i, t in rows:
        ids = encode(t or "") + b"\0\0\0\0"
        n = len(ids) // 4
        at, k, j = 0, (n - 1) % 2048 + 1, 0
        while at < n:
            want.append((i, j, at, k, zlib.crc32(ids[4 * at : 4 * (at + k)])))
            at, k, j = at + k, 2048, j + 1
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, k in sorted(v):
            assert o == at
            at += k
        assert at <= 2048
    assert op.pack(spark.createDataFrame([], "doc_id long, text string"), JSON).count() == 0
